import random
import re

import pytest

LOWER = str.maketrans({chr(k): chr(k + 32) for k in range(65, 91)})


def space_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def alnum_words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))


def corpus(seed=3):
    """Texts with nulls, blanks, copies, near copies, shared passages, a long one and odd characters."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["ta", "ri", "né", "so", "lu", "ka", "Mo", "ß"]) for _ in range(rng.randint(1, 3)))
    text = lambda n: " ".join(word() for _ in range(n))
    base = [text(rng.randint(20, 120)) for _ in range(12)]
    passage = text(130)
    near = base[0].split(" ")
    near[3] = "changed"
    rows = [None, "", " \n\t ", "a", "one two three", "one two three", "One TWO three", "z" * 900, "ab " * 400, *base, base[0], base[0], base[1], " ".join(near), base[2] + " end", passage, text(10) + " " + passage, passage + "\n" + text(12), text(9000), "x.\ny, z. q", "  lead", "trail ", "tab\there", "naïve — “quoted” 漢字 🙂"]
    return rows


@pytest.fixture(scope="session")
def texts():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, texts):
    """With columns whose names the operators use themselves."""
    rows = [(k, t, "en", 7, "s", None) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score int, class string, key double").repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)
