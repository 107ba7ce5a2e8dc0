"""Exact vector codes against Python's integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from rasterloom.llm import codebooks
from rasterloom.llm.common import ship

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows):
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    if not kept:
        return []
    width = -(-max(len(r[1]) for r in kept) // 4) * 4
    part = width // 4

    def whole(x):
        return math.floor(x * 1024) if abs(x) < 2.0**1000 else int(x) * 1024

    ints = [[*map(whole, r[1]), *[0] * (width - len(r[1]))] for r in kept]
    order = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, kept[i][1]))
    books = [[ints[i][p * part : (p + 1) * part] for i in order[:256]] for p in range(4)]

    def assign():
        out = []
        for v in ints:
            found = []
            for p in range(4):
                x = v[p * part : (p + 1) * part]
                found.append(min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(books[p])))
            out.append(found)
        return out

    for _ in range(4):
        found = assign()
        for p in range(4):
            for e in range(len(books[p])):
                own = [v[p * part : (p + 1) * part] for v, f in zip(ints, found) if f[p][1] == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own)]
    found = assign()
    sha = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    most = (1 << 63) - 1
    errors = [min(sum(d for d, _ in f), most) for f in found]
    by_label = {}
    for r, e in zip(kept, errors):
        by_label[r[2]] = min(by_label.get(r[2], 0) + e, most)
    return [
        (r[0], "".join(f"{e:02x}" for _, e in f), err, by_label[r[2]], sha) for r, f, err in zip(kept, found, errors)
    ]


def rows_of(df):
    key = lambda r: tuple((x is not None, x) for x in r)
    return sorted((tuple(r[c] for c in ("vec_id", "code", "error", "label_error", "codebooks_sha256")) for r in df.collect()), key=key)


def check(spark, rows, partitions=3):
    ship(spark)
    key = lambda r: tuple((x is not None, x) for x in r)
    df = spark.createDataFrame(rows, SCHEMA).repartition(partitions)
    assert rows_of(codebooks.compress(df)) == sorted(brute(rows), key=key)
    return df


def test_vectors(spark):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(12)], rng.choice([1, 2, None])) for i in range(0, 900, 2)]
    rows += [(1, None, 1), (3, [None] * 12, 1), (5, [float("nan")] * 12, 2), (7, [float("-inf"), *[0.0] * 11], 2)]
    rows += [rows[3], rows[3], (None, rows[4][1], 1), (8, rows[9][1], 3)]  # repeated rows, ids and vectors
    df = check(spark, rows)
    want = rows_of(codebooks.compress(df))
    assert rows_of(codebooks.compress(df.selectExpr("*", "1 AS code", "2 AS error", "3 AS _label", "4 AS part"))) == want
    assert codebooks.compress(df.limit(0)).collect() == []
    assert codebooks.compress(df.filter("embedding IS NULL")).collect() == []


def test_ragged_few_and_large(spark):
    check(spark, [(1, [0.5, -1.0, 2.0], 1), (2, [], None), (3, [0.1, 0.2, 0.3, 0.4, 0.5], 1)])
    check(spark, [(2, [], 1), (1, [], None)])
    rng = random.Random(4)
    huge = [(i, [rng.choice([1e18, -1e30, 1e306, 3.7, -0.1]) for _ in range(8)], 1) for i in range(300)]
    check(spark, huge)
    check(spark, [(i, [rng.uniform(-2e5, 2e5) for _ in range(8)], i % 2) for i in range(300)])


@pytest.mark.parametrize("reach", [10, 1 << 23, 1 << 26, 1 << 28])
def test_products_are_exact(reach):
    rng = np.random.default_rng(reach)
    x, y = rng.integers(-reach, reach, (40, 24)), rng.integers(-reach, reach, (30, 24))
    x[0], y[0] = -reach, reach
    want = [[sum(int(a) * int(b) for a, b in zip(r, c)) for c in y] for r in x]
    assert codebooks.dot(x, y).tolist() == want
    width = 1 << codebooks.limb_bits(24)
    assert all(np.abs(part).max() < width for part in codebooks.limbs(x, codebooks.limb_bits(24)))
    assert 24 * (width - 1) ** 2 < 1 << 53


def test_first_of_equal_entries_wins():
    at, distance = codebooks.nearest(np.array([[1, 1], [5, 5]]), np.array([[0, 0], [2, 2], [0, 0], [2, 2]]))
    assert at.tolist() == [0, 1] and distance.tolist() == [2, 18]
