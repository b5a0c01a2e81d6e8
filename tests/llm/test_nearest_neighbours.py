"""Nearest neighbours against all inner products."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quietroom.llm import nearest_neighbours as nn

SCHEMA = "vec_id bigint, embedding array<double>"


def plain(rows, k=20, step=20):
    """``[(query_id, [(score, vec_id), ...]), ...]``; rows that share an id are rows of their own."""
    able = [
        (i, np.array(v, float)) for i, v in rows
        if i is not None and v and None not in v and np.isfinite(v).all() and any(v)
    ]
    out = []
    for a, (i, q) in enumerate(able):
        if i % step == 0:
            near = [(-float((q * v).sum()), j) for b, (j, v) in enumerate(able) if a != b and len(q) == len(v)]
            out.append((i, [(-s, j) for s, j in sorted(near)[:k]]))
    return out


def made(df):
    found = {}
    for r in df.orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["score"], r["vec_id"], r["rank"]))
    return found


def recall(found, want):
    """Share of the wanted scores reached; checks order, ranks and numbers on the way."""
    hits = total = 0
    for i, near in want:
        got = found.get(i, [])
        assert [rank for _, _, rank in got] == list(range(1, len(near) + 1))
        assert got == sorted(got, key=lambda g: (-g[0], g[1]))
        assert i not in [j for _, j, _ in got]
        least = near[-1][0] if near else 0
        hits += sum(score >= least - 1e-9 for score, _, _ in got)
        total += len(near)
    return hits / max(total, 1)


def table(spark, vectors, first=0):
    rows = [(first + i, v.tolist()) for i, v in enumerate(vectors)]
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_random_unit_vectors_in_blocks(spark):
    draw = np.random.default_rng(1)
    vectors = draw.standard_normal((3000, 48))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    rows, df = table(spark, vectors)
    want = plain(rows)
    for block in (8192, 700):
        assert recall(made(nn.nearest(df, block=block)), want) >= 0.95


def test_lengths_that_differ(spark):
    """Inner products favour long vectors; one vector a thousand times as long as the others."""
    draw = np.random.default_rng(2)
    vectors = draw.standard_normal((1500, 24)) * np.exp(draw.standard_normal((1500, 1)))
    vectors[77] *= 1000
    rows, df = table(spark, vectors)
    found = made(nn.nearest(df))
    assert recall(found, plain(rows)) >= 0.95
    for i, near in found.items():
        for score, j, _ in near:
            assert math.isclose(score, float(vectors[i] @ vectors[j]), rel_tol=1e-12, abs_tol=1e-12)


def test_copies_and_ties(spark):
    """A third of the rows are one vector: exact ties, in order of their ids, whatever the blocks."""
    draw = np.random.default_rng(3)
    vectors = draw.standard_normal((900, 16))
    vectors[::3] = vectors[0]
    rows, df = table(spark, vectors)
    found = made(nn.nearest(df, block=200))
    copies = list(range(0, 900, 3))
    for i in copies:
        if i % 20 == 0:
            assert [j for _, j, _ in found[i]] == [j for j in copies if j != i][:20]
    assert recall(found, plain(rows)) >= 0.95


def test_few_candidates_odd_vectors_and_clashing_names(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.0, 0.0]), (3, None), (4, []), (5, [1.0, None]),
        (6, [nan, 1.0]), (7, [inf, 1.0]), (None, [1.0, 1.0]), (8, [-1.0, 0.0]), (20, [1.0, 2.0, 3.0]),
        (40, [1e-200, 1e-200]), (60, [1.0, 0.0]), (60, [1.0, 0.0]), (80, [0.0, 0.0]), (-20, [2.0, 1.0]),
    ]
    clashes = ["row", "dims", "band", "block", "query_block", "score", "rank", "label", "parts", "largest"]
    df = spark.createDataFrame(rows, SCHEMA)
    df = df.withColumns({c: F.lit("x") for c in clashes}).repartition(3)
    got = [(r["query_id"], r["score"], r["vec_id"]) for r in nn.nearest(df).collect()]
    want = [(i, s, j) for i, near in plain(rows) for s, j in near]
    assert sorted(got) == sorted(want)
    assert (20 not in {q for q, _, _ in got}) and len([1 for q, _, _ in got if q == 60]) == 2 * 6


def test_nothing(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert nn.nearest(df).columns == ["query_id", "rank", "vec_id", "score"]
    assert nn.nearest(df).count() == 0
    assert nn.nearest(spark.createDataFrame([(1, [1.0])], SCHEMA)).count() == 0


def test_threshold():
    """Simulated collisions of vectors at the radius reach the count as often as is said."""
    draw = np.random.default_rng(4)
    hits = (np.abs(draw.standard_normal((200_000, nn.PROJECTIONS))) < nn.WINDOW).sum(axis=1)
    assert (hits >= nn.needed_count()).mean() >= nn.RECALL - 0.002
    assert (hits >= nn.needed_count() + 1).mean() < nn.RECALL + 0.002


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_query(spark, folder):
    folder = f"/root/testdata/{folder}"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    want = plain(rows)
    found = made(nn.op12_nearest_neighbours(spark, folder))
    assert set(found) == {i for i, _ in want}
    assert recall(found, want) >= 0.95
