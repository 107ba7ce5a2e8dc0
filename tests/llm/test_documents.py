"""Operators on documents against brute force, with nulls, ties, copies, long texts and clashing columns."""

import collections
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from rasterloom.llm import chosen_path, exact, mixture, packing, ppm, rans, repetition, substrings, transducer
from rasterloom.session import work_folder

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile("[^\x20\x09-\x0d]+")


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def text_of(row):
    return row[1] or ""


# -- suffix-array repetition


def brute_repetition(text, least):
    w = WORD.findall(text)
    best = [0] * len(w)
    where = collections.defaultdict(list)
    for i, x in enumerate(w):
        for j in where[x]:
            n = 0
            while i + n < len(w) and w[i + n] == w[j + n]:
                n += 1
            best[i], best[j] = max(best[i], n), max(best[j], n)
        where[x].append(i)
    seen = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    window, spans = set(), set()
    for i in range(len(w) - 7):
        if seen[tuple(w[i : i + 8])] > 1:
            window.update(range(i, i + 8))
    for i, n in enumerate(best):
        if n >= least:
            spans.update(range(i, i + n))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (
        len(w),
        sum(map(len, w)),
        len(re.findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)),
        len(window),
        len(spans) / max(len(w), 1),
        max(best, default=0),
    )


def test_repetition(docs, wide, none, rows):
    rules = repetition.Rules()
    got = by_id(repetition.repetition_rules(docs))
    names = "n_words word_chars n_symbols n_dup_lines n_repeat_words covered_fraction longest_repeat".split()
    for row in rows:
        if len(text_of(row)) > 20_000:
            continue
        expected = brute_repetition(text_of(row), rules.min_words)
        out = got[row[0]]
        assert tuple(out[n] for n in names) == pytest.approx(expected), row
        failed = expected[0] < 20 or 100 * expected[4] > 30 * expected[0]
        assert out.base_failed == failed
        assert out.kept == (not failed and expected[5] <= rules.max_covered and expected[6] <= rules.max_longest)
    assert by_id(repetition.repetition_rules(wide)) == got
    assert repetition.repetition_rules(none).collect() == []


# -- range coding of ids


@pytest.mark.parametrize("n,lanes", [(0, 4), (1, 4), (7, 4), (1000, 16), (70_000, 64)])
def test_block_round_trip(n, lanes):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.3, n), 499).astype(np.uint32)
    model = rans.Model.fit(np.bincount(ids, minlength=500))
    assert model.freq.min() >= 1 and model.freq.sum() == 1 << rans.SCALE
    raw = rans.encode_block(ids, [5, None], np.array([n // 2, n - n // 2]), model, lanes, every=8)
    block = rans.Block(raw)
    assert block.doc_ids == [5, None] and block.lengths.tolist() == [n // 2, n - n // 2]
    slots = model.slots()
    assert (block.decode(model, slots) == ids).all()
    width = 8 * lanes  # segments decode alone, in any order
    for k in reversed(range(len(block.at))):
        assert (block.segment(k, model, slots) == ids[k * width : (k + 1) * width]).all()
    if n > 100:
        with pytest.raises(ValueError, match="damaged"):
            rans.Block(raw[:-2] + bytes([raw[-2] ^ 1]) + raw[-1:])


def test_blocks_hold_the_library_ids(spark, docs, wide, none, rows):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    folder = work_folder(spark, "test-blocks")
    model = rans.encode_documents(docs, folder, path, end_id=0)
    got = by_id(rans.with_starts(rans.read_blocks(spark, folder, model)))
    start = 0
    for row in rows:
        ids = [*library.encode(text_of(row), add_special_tokens=False).ids, 0]
        out = got[row[0]]
        assert np.frombuffer(out.ids, "<u4").tolist() == ids and (out.start, out.n_tokens) == (start, len(ids))
        start += len(ids)
    firsts = [r.first_id for r in spark.read.parquet(folder).orderBy("part", "block").collect()]
    assert firsts == sorted(firsts)
    folder = work_folder(spark, "test-blocks")
    model = rans.encode_documents(wide, folder, path, end_id=0)
    crcs = by_id(rans.read_blocks(spark, folder, model, digest=True))
    assert all(crcs[i].ids_crc32 == zlib.crc32(bytes(r.ids)) for i, r in got.items())
    folder = work_folder(spark, "test-blocks")
    assert rans.read_blocks(spark, folder, rans.encode_documents(none, folder, path, end_id=0)).collect() == []


# -- exact duplicates


def test_exact(spark, docs, wide, none, rows):
    groups = collections.defaultdict(list)
    for row in rows:
        groups[text_of(row).translate(LOW)].append(row[0])
    got = by_id(exact.exact_duplicates(docs))
    for ids in groups.values():
        for i in ids:
            assert tuple(got[i]) == (i, max(ids), len(ids), i == max(ids))
    assert by_id(exact.exact_duplicates(wide)) == got
    assert exact.exact_duplicates(none).collect() == []
    odd = spark.createDataFrame([(1, "a"), (1, "a"), (None, "A"), (2, None), (3, "")], "doc_id long, text string")
    assert sorted(map(tuple, exact.exact_duplicates(odd).collect()), key=str) == sorted(
        [(1, 1, 3, True), (1, 1, 3, True), (None, 1, 3, False), (2, 3, 2, False), (3, 3, 2, True)], key=str
    )


def test_exact_query_with_null_ids(spark, tmp_path):
    """Every row comes back once with its own digest, also where ids are null or repeated."""
    from hashlib import sha256

    import __spark_entry__ as entry

    odd = [(None, "a"), (None, "b"), (None, "A"), (1, "a"), (1, "a"), (2, None), (3, "long and alone")]
    spark.createDataFrame(odd, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = entry.queries()["op3_progressive_exact"](spark, str(tmp_path)).collect()

    def sha(text):
        return sha256(text.encode()).hexdigest()

    wanted = [(None, 1, 4, False, sha("a"))] * 2 + [(1, 1, 4, True, sha("a"))] * 2
    wanted += [(None, None, 1, True, sha("b")), (2, 2, 1, True, sha("")), (3, 3, 1, True, sha("long and alone"))]
    columns = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert sorted((tuple(r[c] for c in columns) for r in got), key=str) == sorted(wanted, key=str)


# -- near duplicates


def brute_components(rows, width):
    sets = {}
    for row in rows:
        w = WORD.findall(text_of(row).translate(LOW))
        sets[row[0]] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    least = {i: i for i in sets}

    def find(i):
        while least[i] != i:
            i = least[i]
        return i

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                least[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("width,node", [(2, 16), (5, 2)])
def test_near(docs, wide, none, rows, width, node):
    """``node=2`` makes almost every node a large one, so stars and last nodes do the work."""
    search = chosen_path.Search(node=node, last_depth=3)
    got = by_id(chosen_path.near_duplicates(docs, width, search))
    for i, (n, least) in brute_components(rows, width).items():
        assert tuple(got[i]) == (i, n, least, i == least)
    if node == 16:
        assert by_id(chosen_path.near_duplicates(wide, width, search)) == got
        assert chosen_path.near_duplicates(none, width).collect() == []


# -- repeated substrings


def brute_repeats(texts, length):
    seen = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(t), sum(gone), runs, bytes(b for b, g in zip(t, gone) if not g)))
    return out


@pytest.mark.parametrize("together", [256, 1])
def test_repeats(docs, wide, none, rows, together):
    """``together=1`` sends every anchor with different stretches the way of the very frequent ones."""
    got = by_id(substrings.repeated_substrings(docs, length=60, gram=12, together=together))
    for row, expected in zip(rows, brute_repeats([text_of(r).encode() for r in rows], 60)):
        out = got[row[0]]
        assert (out.n_bytes, out.n_removed, out.n_spans, bytes(out.kept_text)) == expected, row[0]
    if together == 256:
        assert by_id(substrings.repeated_substrings(wide, length=60, gram=12)) == got
        assert substrings.repeated_substrings(none).collect() == []


@pytest.mark.parametrize("pairwise", [64, 1])
def test_shared_strings_of_an_anchor(monkeypatch, pairwise):
    """Both ways of comparing stretches against brute force."""
    monkeypatch.setattr(substrings, "PAIRWISE", pairwise)
    rng = np.random.default_rng(9)
    length, anchor = 24, b"ANCHOR"
    keys, at, left, right, windows = [], [], [], [], []
    for key in range(12):
        for _ in range(rng.integers(1, 9)):
            before = bytes(rng.choice([97, 98], 2).astype(np.uint8)) * 6
            before = before[: rng.integers(0, 13)]
            count = int(rng.integers(1, len(before) + 2))
            after = anchor + bytes(rng.choice([97, 98], 2).astype(np.uint8)) * 12
            whole = (before + after)[: count - 1 + length]
            keys.append(key), at.append(1000 << 16 | count << 8 | len(before))
            left.append(before[::-1]), right.append(whole[len(before) :])
            windows.append([(key, len(before) - i, whole[i : i + length]) for i in range(count)])
    seen = collections.Counter(w for own in windows for w in set(own))
    expected = {(n, 1000 + i + j) for n, own in enumerate(windows) for i, w in enumerate(own) if seen[w] > 1 for j in range(length)}
    who, start, stop = substrings.repeated(np.array(keys), np.array(at), left, right, length)
    assert {(n, p) for n, a, b in zip(who.tolist(), start.tolist(), stop.tolist()) for p in range(a, b)} == expected


def test_deep_shallow_order():
    rng = np.random.default_rng(5)
    for _ in range(60):
        base = bytes(rng.choice([0, 97, 98], 60).astype(np.uint8))
        strings = [
            base[: rng.integers(0, 61)] + bytes(rng.choice([0, 97, 98], rng.integers(0, 9)).astype(np.uint8))
            for _ in range(rng.integers(1, 40))
        ]
        group = np.sort(rng.integers(0, 3, len(strings)))
        order, lcp = substrings.deep_shallow(strings, group, shallow=8)
        for g in range(3):
            members = [strings[i] for i in order if group[i] == g]
            assert members == sorted(members) and len(members) == (group == g).sum()
        for k in range(1, len(order)):
            a, b = strings[order[k - 1]], strings[order[k]]
            if group[order[k]] == group[order[k - 1]]:
                common = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
                assert lcp[k] == common


# -- token counts


def test_transducer(docs, wide, none, rows):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    got = by_id(transducer.token_counts(docs, path))
    for row in rows:
        n = len(library.encode(text_of(row), add_special_tokens=False).ids)
        assert tuple(got[row[0]]) == (row[0], len(text_of(row).encode()), n, n > 1024)
    assert by_id(transducer.token_counts(wide, path)) == got
    assert transducer.token_counts(none, path).collect() == []


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoders_agree_with_the_library(name):
    import random

    import pyarrow as pa

    from rasterloom.llm.common import flat
    from rasterloom.llm.tokens import Encoder

    rng = random.Random(4)
    alphabet = [*"ab é'sßtrevmld  \n\t.,!_²½09 \u0085ΣςŐ中ñ́İ", "<|endoftext|>", "'ll", " the", "  ", ".\n"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(4000)]
    texts += ["'r", "a'v", " 've", "\n\n 're", "x" * 3000, " " * 900]
    # every code point below U+0250, alone, doubled and between others; and random ones of all planes
    low = [chr(c) for c in range(0x250)]
    texts += [t for c in low for t in (c, c + c, f"a{c}b", f" {c}'ll {c} 9{c}")]
    texts += ["".join(rng.choice(low) for _ in range(rng.randint(1, 12))) for _ in range(6000)]
    wild = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts += ["".join(rng.choice([chr(rng.choice(wild)), rng.choice(low), " ", "a"]) for _ in range(rng.randint(1, 12))) for _ in range(6000)]
    path = public_tokenizers.path(name)
    library = Tokenizer.from_file(path)
    expected = [library.encode(t, add_special_tokens=False).ids for t in texts]
    ids, counts = Encoder(path).encode(*flat(pa.array(texts)))
    assert counts.tolist() == [len(e) for e in expected] and ids.tolist() == [i for e in expected for i in e]
    if name.startswith("byte"):
        assert transducer.Counter(path).count(*flat(pa.array(texts))).tolist() == counts.tolist()


# -- mixture


def test_mixture(docs, wide, none, rows):
    got = by_id(mixture.mix(docs, block=16))
    sizes = {r[0]: len(WORD.findall(text_of(r))) for r in rows}
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is None, (s or "").encode()))
    total = {s: sum(sizes[r[0]] for r in rows if r[3] == s) for s in sources}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}
    held = set()
    while True:
        level = (sum(total.values()) - sum(3 * total[s] for s in held)) / sum(weight[s] for s in sources if s not in held)
        over = {s for s in sources if s not in held and level * weight[s] > 3 * total[s]}
        if not over:
            break
        held |= over
    taken = collections.Counter()
    for row in rows:
        out = got[row[0]]
        target = 3 * total[row[3]] if row[3] in held else level * weight[row[3]]
        assert (out["size"], out.source_size, out.target) == (sizes[row[0]], total[row[3]], pytest.approx(target))
        assert out.taken <= 3 * out["size"]
        taken[row[3]] += out.taken
        taken[row[3], "t"] = round(target)
    assert all(taken[s] == taken[s, "t"] for s in sources)
    assert by_id(mixture.mix(wide, block=16)) == got
    assert mixture.mix(none).collect() == []


def test_schedule_is_spread_evenly(docs):
    """Every stretch of the schedule holds each source by its weight, up to a few slots."""
    from pyspark.sql import functions as F

    sizes = docs.sparkSession.createDataFrame([(s, 40_000) for s in "abc"], "_src string, size long").withColumn(
        "_no_src", F.lit(False)
    )
    targets = mixture.source_targets(sizes)
    slots = mixture.schedule(targets, block=64).orderBy("slot", "rank").collect()
    order = [s.source_no for s in slots]
    share = collections.Counter(order)
    assert [share[i] for i in range(3)] == pytest.approx([len(order) * w / 8 for w in (5, 2, 1)], abs=2)
    for begin in range(0, len(order) - 200, 97):
        part = collections.Counter(order[begin : begin + 200])
        assert [part[i] for i in range(3)] == pytest.approx([125, 50, 25], abs=6)
    for i in range(3):
        assert sorted(s.rank for s in slots if s.source_no == i) == list(range(share[i]))


# -- language model


def brute_ppm(train, text, order):
    """Probability of a text by walking contexts one by one."""
    import math

    def symbols(t):
        return [*t.encode(), 256]

    counts = collections.defaultdict(collections.Counter)
    for t in train:
        s = symbols(t)
        for i, x in enumerate(s):
            for k in range(min(i, order) + 1):
                counts[tuple(s[i - k : i])][x] += 1
    total = 0.0
    s = symbols(text)
    for i, x in enumerate(s):
        excluded: set = set()
        for k in range(min(i, order), -1, -1):
            found = {y: c for y, c in counts.get(tuple(s[i - k : i]), {}).items() if y not in excluded}
            if not found:
                continue
            mass = sum(found.values())
            if x in found:
                total += math.log10((found[x] - 0.5) / mass)
                break
            total += math.log10(len(found) / (2 * mass))
            excluded |= set(found)
        else:
            total -= math.log10(257 - len(excluded))
    return total


def test_ppm(spark, docs, wide, none, rows):
    import math

    got = by_id(ppm.scores(docs))
    low = {r[0]: text_of(r).translate(LOW) for r in rows}
    out = {i for i in low if zlib.crc32(str(i).encode()) % 5 == 1}
    train = [t for i, t in low.items() if i not in out]
    counts = collections.Counter(w for t in train for w in [*WORD.findall(t), None])
    n, v = sum(counts.values()), len(counts)
    for i, t in low.items():
        tokens = [*WORD.findall(t), None]
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens)
        row = got[i]
        assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens) == (i in out, len(tokens), sum(counts[w] > 0 for w in tokens), n)
        assert row.base_score == pytest.approx(base)
        if len(t) < 2000:
            assert row.score == pytest.approx(brute_ppm(train, t, ppm.ORDER)), i
    again = by_id(ppm.scores(wide))
    assert all(again[i].score == pytest.approx(got[i].score) for i in got)
    assert ppm.scores(none).collect() == []


# -- packing


def test_packing(docs, wide, none, rows):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    pieces = packing.stored(packing.token_pieces(docs, path, 1, capacity=256, with_ids=True), "test-pieces")
    packed = packing.pack(pieces, ["doc_id", "piece"], capacity=256)
    got = packed.collect()
    whole = collections.defaultdict(list)
    for r in sorted(got, key=lambda r: (r.doc_id, r.piece)):
        assert r.start == len(whole[r.doc_id]) and r.ids_crc32 == zlib.crc32(bytes(r.ids))
        whole[r.doc_id] += np.frombuffer(bytes(r.ids), "<u4").tolist()
    assert whole == {r[0]: [*library.encode(text_of(r), add_special_tokens=False).ids, 1] for r in rows}
    bins = collections.defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    assert len(bins) <= -(-sum(r.length for r in got) // 256) * 1.1 + 1
    assert {r.sequence_id: r.length for r in packing.sequences(packed).collect()} == {
        b: sum(n for _, n in parts) for b, parts in bins.items()
    }
    assert packing.pack_documents(wide, path, 1).count() == packing.pack_documents(docs, path, 1).count()
    assert packing.pack_documents(none, path, 1).collect() == []


def test_runs_equal_best_fit_one_by_one():
    import random

    rng = random.Random(8)
    for _ in range(50):
        capacity = rng.choice([10, 64, 100])
        lengths = collections.Counter(rng.randint(1, capacity) for _ in range(rng.randint(1, 200)))
        moves = packing.place_runs(lengths, capacity)
        fill = collections.Counter()
        placed = collections.Counter()
        for length, low, high, first, offset in moves:
            for k in range(high - low):
                assert fill[first + k] == offset
                fill[first + k] += length
            assert placed[length] == low
            placed[length] = high
        assert placed == lengths and max(fill.values()) <= capacity
        gaps: list = []
        for length in sorted(lengths.elements(), reverse=True):
            fits = [g for g in gaps if g >= length]
            if fits:
                gaps.remove(min(fits))
                gaps.append(min(fits) - length)
            else:
                gaps.append(capacity - length)
        assert len(fill) <= len(gaps) + 1
