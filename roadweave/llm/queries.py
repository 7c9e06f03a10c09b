"""Queries over the synthetic tables, one for each operator, with what SQL can say about them."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from roadweave.llm.decontam import decontaminate
from roadweave.llm.langid import language
from roadweave.llm.license_scan import license_scan
from roadweave.llm.lm_scoring import stupid_backoff
from roadweave.llm.ngram_join import ngram_join
from roadweave.llm.packing import best_fit_packing
from roadweave.llm.suffix_dedup import digest, suffix_dedup
from roadweave.llm.token_codes import token_codes
from roadweave.llm.topk import exact_topk
from roadweave.llm.toxicity import toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stupid_backoff(table(spark, sf_dir, "documents"))


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(suffix_dedup(table(spark, sf_dir, "documents")))


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk(table(spark, sf_dir, "embeddings"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def license_base_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say about ``op5_license_scan``: words and base phrases."""
    return op5_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def op6_token_id_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_codes(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.where("leaked = 1").select("doc_id", "item_id", "score", "question_overlap", "answer_overlap", "first_word")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


QUERIES = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_suffix_array_dedup": op2_suffix_array_dedup,
    "op3_exact_topk": op3_exact_topk,
    "op4_toxicity": op4_toxicity,
    "op5_license_scan": op5_license_scan,
    "license_base_phrases": license_base_phrases,
    "op6_token_id_codes": op6_token_id_codes,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_benchmark_decontamination": op8_benchmark_decontamination,
    "op9_language_id": op9_language_id,
    "op10_ngram_jaccard_join": op10_ngram_jaccard_join,
}

#: Words of DuckDB text, A-Z as a-z.
WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

ALNUM = WORDS.replace(r"[^\x20\x09-\x0D]+", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

ORACLE_SQL = {
    "op2_suffix_array_dedup": """
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
        w AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 800)) AS k FROM d, unnest(range(0, n - 399)) AS t(i)),
        m AS (SELECT doc_id, i FROM w JOIN (SELECT k FROM w GROUP BY k HAVING count(*) > 1) USING (k)),
        f AS (SELECT *, sum(CASE WHEN i > before + 400 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (SELECT *, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM m)),
        r AS (SELECT doc_id, min(i) AS a, max(i) + 400 AS b FROM f GROUP BY doc_id, run),
        e AS (SELECT doc_id, a, b, true AS run FROM r UNION ALL SELECT doc_id, n, n, false FROM d),
        p AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a, b), 0) AS since FROM e),
        k AS (SELECT doc_id, sum(b - a) AS removed, count(*) FILTER (run) AS spans, string_agg(substr(h, 2 * since + 1, 2 * (a - since)), '' ORDER BY a, b) AS left_hex FROM p JOIN d USING (doc_id) GROUP BY doc_id)
        SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(removed AS BIGINT) AS n_removed, spans AS n_spans, sha256(unhex(left_hex)) AS kept_sha256 FROM d JOIN k USING (doc_id)""",
    "op1_lm_scoring": f"""
        WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
        t AS (SELECT doc_id, i, w[i] AS c, CASE WHEN i > 1 THEN w[i - 1] END AS b, CASE WHEN i > 2 THEN w[i - 2] END AS a FROM d, unnest(range(1, len(w) + 1)) AS x(i)),
        n1 AS (SELECT c, count(*) AS n FROM t GROUP BY 1),
        n2 AS (SELECT b, c, count(*) AS n FROM t WHERE b IS NOT NULL GROUP BY 1, 2),
        n3 AS (SELECT a, b, c, count(*) AS n FROM t WHERE a IS NOT NULL GROUP BY 1, 2, 3),
        s AS (SELECT t.doc_id, i, CASE WHEN n3.n >= 2 THEN 3 WHEN n2.n >= 2 THEN 2 ELSE 1 END AS level,
            CASE WHEN n3.n >= 2 THEN ln(n3.n) - ln(h2.n) WHEN n2.n >= 2 THEN ln(n2.n) - ln(h1.n) ELSE ln(n1.n) - ln((SELECT count(*) FROM t)) END
            + ln(0.4) * (least(i, 3) - CASE WHEN n3.n >= 2 THEN 3 WHEN n2.n >= 2 THEN 2 ELSE 1 END) AS score
            FROM t JOIN n1 ON n1.c = t.c LEFT JOIN n2 ON n2.b = t.b AND n2.c = t.c LEFT JOIN n3 ON n3.a = t.a AND n3.b = t.b AND n3.c = t.c
            LEFT JOIN n2 h2 ON h2.b = t.a AND h2.c = t.b LEFT JOIN n1 h1 ON h1.c = t.b)
        SELECT d.doc_id, count(i) AS n_words, count(*) FILTER (level = 3) AS n_trigram, count(*) FILTER (level = 2) AS n_bigram,
            count(*) FILTER (level = 1) AS n_unigram, round(coalesce(sum(score), 0), 4) AS score
        FROM d LEFT JOIN s ON s.doc_id = d.doc_id GROUP BY d.doc_id""",
    "op3_exact_topk": """
        WITH v AS (SELECT vec_id, [floor(1024 * CAST(x AS DOUBLE)) for x in embedding] AS e FROM embeddings),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id)
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
        FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10""",
    "license_base_phrases": f"""
        WITH d AS (SELECT doc_id, {ALNUM} AS w FROM documents),
        p(phrase, label) AS (VALUES (['gnu', 'general', 'public', 'license'], 'gpl'), (['apache', 'license'], 'apache'), (['cc', 'by'], 'cc-by'), (['mit', 'license'], 'mit')),
        f AS (SELECT doc_id, i, label FROM d, unnest(range(1, len(w) + 1)) AS t(i), p WHERE w[i : i + len(phrase) - 1] = phrase)
        SELECT d.doc_id, CAST(len(any_value(w)) AS BIGINT) AS n_words, count(i) AS n_base, min(i) - 1 AS first_word, max(i) - 1 AS last_word, coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS base_labels
        FROM d LEFT JOIN f ON f.doc_id = d.doc_id GROUP BY d.doc_id""",
    "op10_ngram_jaccard_join": f"""
        WITH RECURSIVE w AS (SELECT doc_id, {WORDS} AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS t(i) WHERE len(w) > 0),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        links AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 80 * (x.n + y.n - o)),
        reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
        SELECT a AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(b) AS component_id FROM reach LEFT JOIN n ON n.doc_id = a GROUP BY a""",
}
