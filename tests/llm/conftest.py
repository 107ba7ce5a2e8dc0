"""A small corpus with every awkward case, and empty and widened versions of it."""

import random

import pytest
from pyspark.sql import functions as F

from rasterloom.llm.common import ship

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# names that operators use inside or return
CLASHING = "kept keep_id group_size size taken target m key rep spans needs part start length n mins _text _bytes _size _src text_sha256"


def corpus():
    rng = random.Random(11)
    letters = "abcdefgh"
    vocabulary = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) for _ in range(300)]

    def words(n):
        return [rng.choice(vocabulary) for _ in range(n)]

    passage = " ".join(words(60))
    texts = [None, "", "  \t ", "one", "one two", "ONE Two", "É été naïve “x” 中文字", "<|endoftext|> a <|endoftext|>"]
    texts += ["same words again. " * 40, "line a\nline b\nline a\n\n" * 9, "x" * 900, "ab" * 700]
    for _ in range(25):
        texts.append(" ".join(words(rng.randint(5, 160))))
    for _ in range(6):
        texts.append(" ".join([*words(20), passage, *words(15)]))
    base = words(120)
    for k in range(8):
        edited = list(base)
        for _ in range(k):
            edited[rng.randrange(len(edited))] = rng.choice(vocabulary)
        texts.append(" ".join(edited))
    texts.append(texts[12].upper())
    texts += [texts[13]] * 3
    texts.append(" ".join(words(9000)))
    sources = ["s0", "s0", "s0", "s1", None, "", "S2"]
    rows = [(i, t, "en", rng.choice(sources), None if t is None else len(t)) for i, t in enumerate(texts)]
    return [rows[i] for i in rng.sample(range(len(rows)), len(rows))]


@pytest.fixture(scope="session")
def rows():
    return sorted(corpus())


@pytest.fixture(scope="session")
def docs(spark):
    ship(spark)
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    ship(spark)
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def wide(docs):
    return docs.withColumns({c: F.lit("?") for c in CLASHING.split()})
