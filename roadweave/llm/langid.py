"""Language of web pages from all that speaks for it: text, declared language, address, and what the host's other pages are.

log P(l | page) is the sum of: the text's likelihood (hashed byte 4-grams, one table per language from at most SAMPLE of its labelled documents), tempered to EFFECTIVE
4-grams as neighbours depend on each other; the likelihood of the declared language and of the address' language, each right with a fixed share; and a prior of
the host, smoothed by its domain's, that by its suffix', that by all pages'. Priors are grouped sums of the pages' own posteriors without a prior.
"""

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadweave.llm import textkernel as K
from roadweave.llm.shared import chunks, written

#: Labelled documents of a language to learn from. All languages that have one are told apart: each takes 256 kB of the table.
SAMPLE = 1000
BUCKETS = 1 << 16
EFFECTIVE = 40.0
#: How often a declaration, and an address, names the language right.
DECLARED, ADDRESS = 0.9, 0.75
#: Pages that each level of the prior weighs against its own.
SMOOTH = 5.0
#: Country suffixes and their main language.
SUFFIXES = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "uk": "en", "us": "en", "au": "en", "ie": "en", "it": "it", "pt": "pt", "br": "pt", "nl": "nl", "pl": "pl", "ru": "ru", "jp": "ja", "cn": "zh", "kr": "ko", "se": "sv"}

#: What doesn't show: scripts, styles and comments up to their end or that of the page, tags, entities. No place is looked at twice.
HIDDEN = re.compile(rb"<(script|style)\b.*?(?:</\1\s*>|\Z)|<!--.*?(?:-->|\Z)|<[^<>]*>|&[#\w]{1,32};", re.S | re.I)
DECLARATION = re.compile(r"<html\b[^<>]*?\blang\s*=\s*[\"']?([a-zA-Z]{2,3})|<meta\b([^<>]*)", re.I)
META = re.compile(r"content\s*=\s*[\"']?([a-zA-Z]{2,3})", re.I)


def gram_buckets(data: np.ndarray) -> np.ndarray:
    low = K.LOWER[data].astype(np.uint32)
    if len(low) < 4:
        return np.zeros(0, np.int64)
    h = low[:-3] * np.uint32(2654435761) + low[1:-2] * np.uint32(2246822519) + low[2:-1] * np.uint32(3266489917) + low[3:] * np.uint32(668265263)
    return ((h ^ (h >> np.uint32(15))) & np.uint32(BUCKETS - 1)).astype(np.int64)


def declaration(html: str) -> str | None:
    """The language that the page declares first, in its root tag or a content-language tag."""
    for m in DECLARATION.finditer(html):
        own = m[1]
        if own is None and "content-language" in m[2].lower():
            own = (x := META.search(m[2])) and x[1]
        if own:
            return own.lower()
    return None


def learn(docs: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """The languages, and log probabilities by 4-gram bucket and language, from at most ``sample`` documents of each with a text and a language."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.trim(F.col("lang").cast("string"))).alias("lang"), F.col("text").cast("string").alias("text")).where("doc_id is not null and lang <> ''")
    have = sorted((r["lang"], r["count"]) for r in own.groupBy("lang").count().collect())
    names = [lang for lang, _ in have]
    if not names:
        return names, np.zeros((BUCKETS, 0), np.float32)
    # about as many as wanted by a hash of the id first, a few more, then the least hashes of those
    share = F.create_map(*[F.lit(x) for lang, n in have for x in (lang, min(1.0, (sample + 5 * sample**0.5) / n))])[F.col("lang")]
    order = F.xxhash64("doc_id", "text")
    some = own.withColumn("place", order).where(F.pmod(F.col("place"), F.lit(1 << 30)) < share * (1 << 30))
    found = some.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("place"))).where(F.col("nth") <= sample).select("lang", "text")
    number = {lang: k for k, lang in enumerate(names)}

    def count(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for lang, value in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                own = total.setdefault(number[lang], np.zeros(BUCKETS, np.int64))
                own += np.bincount(gram_buckets(np.frombuffer((value or "").encode(), np.uint8)), minlength=BUCKETS)
        for k, own in total.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k)), pa.array(at), pa.array(own[at])], ["lang", "at", "n"])

    table = np.full((len(names), BUCKETS), 0.1)
    sums = found.mapInArrow(count, "lang long, at long, n long").groupBy("lang", "at").agg(F.sum("n").alias("n")).toArrow()
    table[np.asarray(sums["lang"]), np.asarray(sums["at"])] += np.asarray(sums["n"])  # bounded: a table of BUCKETS for each language
    return names, np.log(table / table.sum(axis=1, keepdims=True)).T.astype(np.float32).copy()


def visible(html: str) -> bytes:
    return HIDDEN.sub(b" ", html.encode())


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


def _evidence(held):
    def run(batches):
        names, table = held.value
        for _, chunk in chunks(batches, "html"):
            text, declared, own = [], [], []
            for html in chunk.column("html").to_pylist():
                grams = gram_buckets(np.frombuffer(visible(html or ""), np.uint8))
                x = table[grams].sum(axis=0, dtype=np.float64) * (EFFECTIVE / max(len(grams), EFFECTIVE)) if len(grams) else np.zeros(len(names))
                declared.append(declaration(html or ""))
                own.append(x.tolist())
                text.append(names[int(x.argmax())] if len(grams) and len(names) else None)
            yield pa.RecordBatch.from_arrays([chunk.column("page_id"), chunk.column("url"), pa.array(own, pa.list_(pa.float64())), pa.array(text, pa.string()), pa.array(declared, pa.string())], ["page_id", "url", "likelihood", "text_lang", "declared_lang"])

    return run


def language(pages: DataFrame, docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """page_id, lang, probability, text_lang, declared_lang, host of every page; documents (doc_id, text, lang) are what text models learn from.

    A null or empty page has no text evidence, a null address no host: its priors are those of all pages. Without labelled documents no language is named. Pages that
    are alike count each. Likelihoods of equal height name the first language by name. Other columns are left out.
    """
    spark = pages.sparkSession
    names, table = learn(docs, sample)
    held = spark.sparkContext.broadcast((names, table))
    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    evidence = source.mapInArrow(_evidence(held), "page_id long, url string, likelihood array<double>, text_lang string, declared_lang string")
    if not names:
        return evidence.select("page_id", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("probability"), "text_lang", "declared_lang", F.lit(None).cast("string").alias("host"))
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    evidence = evidence.withColumn("host", F.when(host != "", host))
    evidence = evidence.withColumn("suffix", F.substring_index("host", ".", -1)).withColumn("domain", F.substring_index("host", ".", -2))
    path = F.lower(F.regexp_extract("url", r"^[^:]+://[^/]+/([A-Za-z]{2})(?:/|$)", 1))
    known = F.array(*map(F.lit, names))
    by_suffix = F.create_map(*[F.lit(x) for pair in SUFFIXES.items() for x in pair])
    named = F.when(F.array_contains(known, path), path).otherwise(F.try_element_at(by_suffix, F.col("suffix")))
    wrong = max(1, len(names) - 1)

    def told(column, right):
        """Log likelihoods of a named language; nothing if none of the known ones is named."""
        return [F.when(F.coalesce(F.array_contains(known, column), F.lit(False)), F.when(column == x, float(np.log(right))).otherwise(float(np.log((1 - right) / wrong)))).otherwise(0.0) for x in names]

    first = [F.element_at("likelihood", k + 1) + a + b for k, (a, b) in enumerate(zip(told(F.col("declared_lang"), DECLARED), told(named, ADDRESS)))]
    rows = evidence.withColumn("log", F.array(*first))
    top = F.array_max("log")
    rows = rows.withColumn("e", F.transform("log", lambda x: F.exp(x - top)))
    total = F.aggregate("e", F.lit(0.0), lambda a, x: a + x)
    rows = written(rows.select("page_id", "host", "domain", "suffix", "text_lang", "declared_lang", "log", F.transform("e", lambda x: x / total).alias("p")), "evidence")

    def sums(frame, *keys):
        return frame.groupBy(*keys).agg(F.sum("n").alias("n"), *(F.sum(f"p{k}").alias(f"p{k}") for k in range(len(names))))

    hosts = rows.where("host is not null").groupBy("host", "domain", "suffix").agg(F.count("*").alias("n"), *(F.sum(F.element_at("p", k + 1)).alias(f"p{k}") for k in range(len(names))))
    hosts = written(hosts, "hosts")
    every = sums(hosts).first()
    n = every["n"] or 0
    base = [((every[f"p{k}"] or 0.0) + 1.0) / (n + len(names)) for k in range(len(names))]

    def smoothed(frame, prior):
        return F.array(*((F.col(f"p{k}") + SMOOTH * prior(k)) / (F.col("n") + SMOOTH) for k in range(len(names)))).alias("prior")

    suffixes = sums(hosts, "suffix").select("suffix", smoothed(None, lambda k: F.lit(base[k])).alias("suffix_prior"))
    domains = sums(hosts, "domain", "suffix").join(suffixes, "suffix").select("domain", smoothed(None, lambda k: F.element_at("suffix_prior", k + 1)).alias("domain_prior"))
    priors = hosts.join(domains, "domain").select("host", smoothed(None, lambda k: F.element_at("domain_prior", k + 1)).alias("prior"))
    joined = rows.join(priors, "host", "left").withColumn("prior", F.coalesce("prior", F.array(*map(F.lit, base))))
    joined = joined.withColumn("log", F.zip_with("log", "prior", lambda a, b: a + F.log(b)))
    top = F.array_max("log")
    total = F.aggregate("log", F.lit(0.0), lambda a, x: a + F.exp(x - top))
    lang = F.element_at(known, F.array_position("log", top).cast("int"))
    return joined.select("page_id", lang.alias("lang"), F.round(1 / total, 6).alias("probability"), "text_lang", "declared_lang", "host")
