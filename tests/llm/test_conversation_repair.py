"""The repair of conversations against a plain search over all edits."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from quietroom.llm import conversation_repair as cr

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
LEGAL = {"su", "ua", "au"}


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        key = ":".join(" " if x is None else str(x) for x in (conv, turn))
        drawn = zlib.crc32(key.encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        if drawn == 0:
            continue
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(drawn, text)
        role = "user" if drawn == 4 else role
        out += [(conv, turn, role, text)] * (2 if drawn == 3 else 1)
    return out


def following(state, initial):
    """The automaton of (s?(ua)+)?, by what may come after what has been."""
    return {
        ("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u",
    }.get((state, initial))


def plain_repair(rows):
    """Facts, cost, audit and repaired lines of the ordered (turn, role, text) rows of one conversation."""
    seen, faults = set(), []
    for _, role, text in rows:
        tail = re.findall(r"[^\x20\x09-\x0d]", text)
        if not tail:
            faults.append("blank")
        elif (role, text) in seen:
            faults.append("duplicate")
        else:
            faults.append("truncated" if tail[-1] not in ".!?" else "")
        seen.add((role, text))

    # Least (cost, audit) from each state on, from the last row back; an edit changes one thing.
    after = {}
    for at in range(len(rows), -1, -1):
        here = {}
        for inserted in (3, 2, 1, 0):
            for state in ("", "s", "u", "a"):
                ways = []
                if at == len(rows) and state in ("", "a"):
                    ways.append((0, "", None))
                if inserted < 3:
                    for role in ("user", "assistant"):
                        if to := following(state, role[0]):
                            cost, audit, lines = here[to, inserted + 1]
                            ways.append((cost + 3, "I" + audit, (f"{role}:", lines)))
                if at < len(rows):
                    _, old, text = rows[at]
                    cost, audit, lines = after[state, 0]
                    ways.append((cost + 4, "D" + audit, lines))
                    if faults[at] in ("", "truncated"):
                        extra = 3 * (faults[at] == "truncated")
                        for edit, role in (("K", old), ("R", "user"), ("R", "assistant")):
                            if to := following(state, role[:1]):
                                cost, audit, lines = after[to, 0]
                                cost += extra + 3 * (edit == "R")
                                ways.append((cost, edit + audit, (f"{role}:{text}", lines)))
                here[state, inserted] = min(ways, default=(10**9, "~", None), key=lambda w: w[:2])
        after = here
    cost, audit, rest = after["", 0]
    lines = []
    while rest is not None:
        line, rest = rest
        lines.append(line)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in LEGAL for a, b in zip(rows, rows[1:], strict=False))
    counts = [faults.count(x) for x in ("blank", "duplicate", "truncated")]
    digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return (gaps, *counts, illegal, cost, audit, digest)


def plain(rows):
    """One result for each conversation of rows whose turns don't tie, but for equal rows."""
    groups = {}
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        groups.setdefault(conv, []).append((turn, role, text))
    return {
        conv: plain_repair(sorted(found, key=lambda r: (r[0] is not None, r[0] or 0)))
        for conv, found in groups.items()
    }


def made(spark, rows, segment=cr.SEGMENT):
    found = cr.repair(spark.createDataFrame(rows, SCHEMA).repartition(3), segment)
    hashes = {r["conv_id"]: r["sha256"] for r in cr.digests(found.rows).collect()}
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    return {
        r["conv_id"]: (*[r[c] for c in names], hashes.get(r["conv_id"], cr.EMPTY_HASH))
        for r in found.conversations.collect()
    }


def random_rows(seed, conversations, longest):
    draw = random.Random(seed)
    out = []
    for conv in range(conversations):
        turns = draw.sample(range(2 * longest), draw.randint(1, longest))
        for place, turn in enumerate(sorted(turns)):
            row = (
                conv if conv else None,
                None if place == 0 and conv % 3 == 0 else turn,
                draw.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]),
                draw.choice(["A.", "B", "  ", "", None, f"text {turn}!", f"{turn}?  \n", "É… ."]),
            )
            out += [row] * draw.choice([1, 1, 1, 2, 3])
    return out


def test_small_conversations(spark):
    rows = random_rows(1, 150, 7)
    assert made(spark, rows) == plain(rows)


def test_long_conversations_in_pieces(spark):
    """The conversation is spread over partitions and cut into pieces of a few rows."""
    rows = random_rows(2, 4, 120)
    want = plain(rows)
    assert made(spark, rows) == want
    assert made(spark, rows, segment=5) == want


@pytest.mark.parametrize("kinds", ["K", "AB"])
def test_long_runs(spark, kinds):
    """Equal symbols one after the other: the binary powers and the way back through them."""
    texts = {"K": ["user"], "AB": ["user"] * 40 + ["assistant"] * 37 + ["tool"] * 50}[kinds]
    rows = [(1, i, texts[i % len(texts)], f"{i}." if i % 90 < 60 else f"{i}") for i in range(300)]
    assert made(spark, rows, segment=64) == plain(rows)


def test_copies_of_a_row(spark):
    rows = [(1, 0, "user", "A?")] * 500 + [(1, 1, "assistant", "B.")] * 400
    found = made(spark, rows)[1]
    assert found == plain(rows)[1]
    assert found[:5] == (0, 0, 898, 0, 898) and found[6].count("D") == 898


def test_turns_that_tie(spark):
    """Rows that share a turn come by role; the order of the input does not matter."""
    rows = [(1, 0, "user", "A."), (1, 0, "assistant", "B."), (1, None, "user", "C."), (1, 1, "user", "D.")]
    found = made(spark, rows)
    assert found == made(spark, rows[::-1])
    assert found[1][6] == plain(sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2])))[1][6]


def test_extra_columns_and_no_rows(spark):
    df = spark.createDataFrame([(1, 0, "user", "A.")], SCHEMA)
    wide = df.withColumns({c: F.lit("x") for c in ("h1", "n", "audit", "part", "conv", "kind", "drawn")})
    assert cr.repair(wide).conversations.collect()[0]["audit"] == "KI"
    empty = cr.repair(df.limit(0))
    assert empty.conversations.count() == 0 and empty.rows.count() == 0
    assert cr.digests(empty.rows).count() == 0
    assert cr.damage(wide).columns == ["conv_id", "turn", "role", "text"]


def test_rows_of_the_repair(spark):
    rows = [(7, 0, "system", "S."), (7, 1, "assistant", "no end"), (7, 2, "tool", " "), (7, 4, "user", "U?")]
    found = cr.repair(spark.createDataFrame(rows, SCHEMA))
    facts = found.conversations.first().asDict()
    assert facts["audit"] == plain(rows)[7][6]
    out = [(r["edit"], r["turn"], r["role"], r["text"]) for r in found.rows.orderBy("part", "k", "i").collect()]
    assert re.fullmatch("(s?(ua)+)?", "".join(role[0] for _, _, role, _ in out))
    assert [e for e, _, _, _ in out] == [x for x in facts["audit"] if x != "D"]


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select(
        "conv_id", "turn", "role", "text").collect()]
    want = plain(plain_damage(rows))
    empty = (0, 0, 0, 0, 0, 0, "", cr.EMPTY_HASH)
    want = {conv: want.get(conv, empty) for conv in {r[0] for r in rows}}
    found = cr.op11_conversation_repair(spark, sf).collect()
    assert {r["conv_id"]: tuple(r)[1:] for r in found} == want
    assert len(found) == len(want)


def test_damage_with_nulls(spark):
    rows = [(c, t, r, x) for c in (None, *range(60)) for t in (None, 0, 1, 5)
            for r, x in [("assistant", "A. B! C?")] if (c or 0) % 2 == 0]
    rows += [(1, 1, None, None), (3, None, None, "x"), (5, 2, "user", None)]
    found = cr.damage(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, plain_damage(rows)))
    keys = {(r[0], r[1]) for r in plain_damage(rows)}
    assert len(keys) < len({(r[0], r[1]) for r in rows})
