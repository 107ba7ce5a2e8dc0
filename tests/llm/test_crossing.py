"""Nodes that stay large: members outside the largest part meet all others, in blocks, against brute force."""

import itertools
import random

import numpy as np
import pytest

from rasterloom.llm import chosen_path
from rasterloom.llm.common import settled, ship, stored


def made(seed, n):
    """Members (rep, part, set) around one base set; some share a part, one set is a copy of another."""
    rng = random.Random(seed)
    base = rng.sample(range(1 << 62), 60)
    members = []
    for rep in range(n):
        own = set(base)
        for value in rng.sample(base, rng.randint(0, 12)):
            own.discard(value)
            own.add(rng.randrange(1 << 62))
        members.append((rep, rep % 7 if rep % 3 else 0, np.array(sorted(own), "<u8")))
    return [*members, (n, n, members[0][2])]


def joined(links, members):
    """Sets of parts that the links connect."""
    part = {rep: p for rep, p, _ in members}
    at = {p: p for p in part.values()}

    def top(p):
        while at[p] != p:
            p = at[p]
        return p

    for u, v in links:
        at[top(part[u])] = top(part[v])
    return {frozenset(p for p in at if top(p) == t) for t in map(top, at)}


def brute(members):
    links = []
    for (u, p, x), (v, q, y) in itertools.combinations(members, 2):
        both = len(np.intersect1d(x, y))
        if p != q and 100 * both >= 80 * (len(x) + len(y) - both):
            links.append((u, v))
    return links


@pytest.mark.parametrize("block", [1 << 20, 3000])
def test_crossing(spark, monkeypatch, block):
    ship(spark)
    monkeypatch.setattr(chosen_path, "BLOCK_BYTES", block)
    members = made(3, 60)
    sets = spark.createDataFrame([(r, bytearray(s.tobytes())) for r, _, s in members], "rep long, set binary")
    leaves = spark.createDataFrame([(5, r, p) for r, p, _ in members], "key long, rep long, part long")
    links = [tuple(r) for r in chosen_path.crossing(leaves, sets, 80).collect()]
    want = brute(members)
    assert {(min(e), max(e)) for e in links} <= set(want)
    assert joined(links, members) == joined(want, members)
    assert chosen_path.crossing(leaves.limit(0), sets, 80).collect() == []


def test_settled(spark):
    passed = []

    def make():
        passed.append(stored(spark.range(9), "test-passing"))
        return passed[0].filter("id > 3")

    kept = settled(spark, make, "test-settled")
    assert sorted(r.id for r in kept.collect()) == [4, 5, 6, 7, 8]
    path = spark._jvm.org.apache.hadoop.fs.Path(passed[0].inputFiles()[0])
    assert not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
