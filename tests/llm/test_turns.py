"""Repair of conversations against exhaustive search."""

import functools
import hashlib
import random
import re
import zlib

from rasterloom.llm import turns
from rasterloom.llm.common import ship

SCHEMA = "conv_id long, turn long, role string, text string"
WORDS = re.compile("[^\x20\x09-\x0d]")


def brute(codes, most=4):
    """Every script of edits with at most ``most`` inserts: least cost, then least audit."""
    best = None

    def step(i, out, cost, audit):
        nonlocal best
        if best and cost > best[0]:
            return
        follow = "a" if out.endswith("u") else "u"
        if audit.count("I") < most:
            step(i, out + follow, cost + 5, audit + "I")
        if i == len(codes):
            if not out or out.endswith("a"):
                best = min(best or (cost, audit), (cost, audit))
            return
        initial, extra, gone = codes[i]
        step(i + 1, out, cost + 2, audit + "D")
        if gone:
            return
        if initial == follow or (initial == "s" and not out):
            step(i + 1, out + initial, cost + extra, audit + "K")
        step(i + 1, out + follow, cost + extra + 1, audit + "R")

    step(0, "", 0, "")
    return best


def states(codes):
    """The same by a table over phases, for long conversations; audits never are each other's prefixes."""
    best = {"": (0, "")}

    def inserted(best):
        for _ in range(2):
            for phase, (cost, audit) in list(best.items()):
                to = "a" if phase == "u" else "u"
                best[to] = min(best.get(to, (1 << 40, "")), (cost + 5, audit + "I"), key=lambda x: x)
        return best

    for initial, extra, gone in codes:
        before, best = inserted(dict(best)), {}

        def put(phase, cost, audit):
            if phase not in best or (cost, audit) < best[phase]:
                best[phase] = (cost, audit)

        for phase, (cost, audit) in before.items():
            put(phase, cost + 2, audit + "D")
            if not gone:
                to = "a" if phase == "u" else "u"
                if initial == to or (initial == "s" and phase == ""):
                    put(initial, cost + extra, audit + "K")
                put(to, cost + extra + 1, audit + "R")
    return min((cost, audit) for phase, (cost, audit) in inserted(dict(best)).items() if phase in ("", "a"))


def coded(rows):
    return "".join(
        (turns.GONE if gone else turns.CUT if extra else turns.FINE)["sua".find(initial) if initial in "sua" else 3]
        for initial, extra, gone in rows
    )


def some_turns(rng, n):
    return [(rng.choice("suauauauo"), rng.choice((0, 0, 0, 5)), rng.random() < 0.15) for _ in range(n)]


def test_alignment_equals_every_script():
    rng = random.Random(3)
    for _ in range(400):
        rows = some_turns(rng, rng.randint(1, 6))
        codes = coded(rows)
        assert turns.finish(turns.whole(codes)) == brute(rows) == states(rows)
        for width in (1, 2, 4):
            blocks = [codes[i : i + width] for i in range(0, len(codes), width)]
            paths = turns.between(blocks[0], "")
            for block in blocks[1:]:
                more = {k: v for start in ("", "s", "u", "a") for k, v in turns.between(block, start).items()}
                paths = turns.compose(paths, more)
            assert turns.finish(paths) == brute(rows)


def test_band_leaves_costly_lengths():
    assert turns.align("uaua", "uaua", 0, True) == (0, "KKKK")
    assert turns.align("uaua", "ua", 3, True) is None
    assert turns.align("uaua", "ua", 4, True) == (4, "DDKK")
    assert turns.align("3", "ua", 12, True) == (12, "DII")


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = ":".join(" " if x is None else str(x) for x in (conv, turn))
        lot = zlib.crc32(key.encode()) % 20
        if lot == 0:
            continue
        if lot == 1:
            text = ""
        if lot == 2:
            text = re.sub("[.!?]", "", text)
        if lot == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if lot == 3 else 1)
    return out


def expected(rows, search):
    out = {}
    for conv in {r[0] for r in rows}:
        own = [r for r in damaged(rows) if r[0] == conv]
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).digest()))
        seen, codes, counts = set(), [], [0, 0, 0]
        for _, _, role, text in own:
            blank = not WORDS.search(text)
            again = not blank and (role, text) in seen
            cut = not blank and not again and WORDS.findall(text)[-1] not in ".!?"
            seen.add((role, text))
            counts = [a + b for a, b in zip(counts, (blank, again, cut))]
            codes.append((role[:1], 5 * cut, blank or again))
        initials = [r[2][:1] for r in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        numbers = {r[1] for r in own if r[1] is not None}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        cost, audit = search(codes) if codes else (0, "")
        lines, phase, at = [], "", 0
        for op in audit:
            if op in "IR":
                phase = "a" if phase == "u" else "u"
                lines.append(turns.ROLES[phase] + ":" + ("" if op == "I" else own[at][3]))
            if op == "K":
                phase = own[at][2][:1]
                lines.append(own[at][2] + ":" + own[at][3])
            at += op != "I"
        sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[conv] = (gaps, *counts, illegal, cost, audit, sha)
    return out


def conversations():
    rng = random.Random(5)
    texts = ["Yes.", "No!", "Why?", "cut off", " ", "", None, "a b.\n", "é中…", "x.  "]
    roles = ["user", "assistant", "user", "assistant", "system", None, "", "tool", "agent"]
    rows = []
    for conv in [*range(60), None]:
        for turn in range(rng.randint(0, 6)):
            number = rng.choice([turn, turn, turn, turn + 3, None, -turn])
            rows.append((conv, number, rng.choice(roles), rng.choice(texts)))
    rows += rows[:7]  # repeated rows
    rng.shuffle(rows)
    return rows


def found(df):
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    return {r["conv_id"]: tuple(r[n] for n in names) for r in df.collect()}


def repair(rows):
    broken = turns.damage(rows)
    return turns.digests(broken, turns.audits(broken, rows))


def test_whole_tables(spark):
    ship(spark)
    rows = conversations()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = expected(rows, functools.partial(brute, most=3))
    assert found(repair(df)) == want
    assert want == expected(rows, states)
    wide = df.selectExpr("*", "1 AS cost", "'?' AS audit", "2 AS _at", "3 AS _block", "4 AS illegal", "5 AS _kind")
    assert found(repair(wide)) == want
    assert repair(df.limit(0)).collect() == []


def test_long_conversations_are_composed_from_blocks(spark, monkeypatch):
    """One conversation of a third of all rows: several blocks, several rounds."""
    ship(spark)
    monkeypatch.setattr(turns, "FAN", 3)
    rng = random.Random(8)
    rows = [(1, t, rng.choice(["user", "assistant", "user", "assistant", "tool"]), f"{rng.choice('abc')} {t}{rng.choice('..!,')}") for t in range(700)]
    rows += [(c, t, "user" if t % 2 == 0 else "assistant", f"{t}.") for c in range(2, 60) for t in range(rng.randint(30, 34))]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert found(repair(df)) == expected(rows, states)


def test_repaired_turns(spark):
    ship(spark)
    rows = conversations()
    broken = turns.damage(spark.createDataFrame(rows, SCHEMA))
    fixed = turns.repaired(broken, turns.audits(broken)).collect()
    lines = {}
    for r in sorted(fixed, key=lambda r: r["place"]):
        lines.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    for conv, out in expected(rows, states).items():
        assert hashlib.sha256("\n".join(lines.get(conv, [])).encode()).hexdigest() == out[-1]
        initials = "".join(x[0] for x in lines.get(conv, []))
        assert re.fullmatch("(s?(ua)+)?", initials)
