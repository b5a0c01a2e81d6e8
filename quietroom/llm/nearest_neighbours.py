"""Approximate nearest neighbours by largest inner product, with collision-counting hashing.

Inner products become distances: of the vectors of a block, all get the length of the longest one by
one more component, which queries do not have; queries are scaled to the same length. Every vector is
projected on PROJECTIONS random directions, orthogonal ones as far as there are, and each projection is one sorted array. A query looks
into windows around its own projections, of half width WINDOW times a radius. Virtual rehashing
widens them: the same arrays serve every radius, and only what a wider window adds is counted. A vector
within the radius falls into each window with the same chance, which fixes the number of collisions
that all but 1 - RECALL of such vectors reach; vectors that reach it are verified by their exact inner
product. When the K-th nearest found lies within the radius, the block is done. The radius never grows
beyond that distance, and nothing caps the number of candidates.

Vectors are dealt to blocks of BLOCK, by length first, so that one long vector spoils no contrast;
queries are dealt to blocks too, and each pair of blocks is a task, which returns K rows for a query.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quietroom.llm.base import query, stored, table

K = 20
QUERY_STEP = 20
PROJECTIONS = 32
WINDOW = 0.8
# For independent directions; orthogonal ones spread less, so more vectors than that are found.
RECALL = 0.9
# First radius, as a share of the vectors' length, and by what the radius grows.
FIRST_RADIUS = 0.8
GROWTH = 1.5
BLOCK = 8192
SEED = 40_009


def needed_count() -> int:
    """The largest count that a vector within the radius reaches with a probability of RECALL."""
    p = math.erf(WINDOW / math.sqrt(2))
    missed, count = 0.0, 0
    while count < PROJECTIONS:
        missed += math.comb(PROJECTIONS, count) * p**count * (1 - p) ** (PROJECTIONS - count)
        if missed > 1 - RECALL:
            break
        count += 1
    return count


_known: dict[int, np.ndarray] = {}


def directions(dimensions: int) -> np.ndarray:
    """Random directions, orthogonal among so many of them as there are dimensions."""
    if dimensions not in _known:
        draw, found = np.random.default_rng(SEED), []
        for at in range(0, PROJECTIONS, dimensions):
            width = min(dimensions, PROJECTIONS - at)
            turned, _ = np.linalg.qr(draw.standard_normal((dimensions, width)))
            found.append(turned * math.sqrt(dimensions))
        _known[dimensions] = np.concatenate(found, axis=1)
    return _known[dimensions]


def lengths(vectors: np.ndarray) -> np.ndarray:
    largest = np.abs(vectors).max(axis=1)
    return largest * np.linalg.norm(vectors / largest[:, None], axis=1)


class SortedProjections:
    """The vectors of a block, ready for queries."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        self.n = len(vectors)
        self.length = float(lengths(vectors).max())
        unit = vectors / self.length
        rest = np.sqrt(np.maximum(1 - np.einsum("ij,ij->i", unit, unit), 0))
        on = directions(vectors.shape[1] + 1)
        placed = unit @ on[:-1] + rest[:, None] * on[-1]
        order = np.argsort(placed, axis=0, kind="stable")
        self.order = order.T.ravel()  # one array after the other
        self.first = np.arange(PROJECTIONS) * self.n
        ranked = np.take_along_axis(placed, order, axis=0).T
        # Apart from each other, so that one search serves all arrays.
        self.apart = np.arange(PROJECTIONS) * (4 * np.abs(ranked).max() + 1)
        self.ranked = (ranked + self.apart[:, None]).ravel()
        self.needed = needed_count()

    def nearest(self, query: np.ndarray, own: int | None, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions and exact inner products of the verified vectors, the k nearest among them.

        ``own`` is the position of the query itself if it is in the block; it is left out.
        """
        scale = float(lengths(query[None, :])[0])
        unit = query / scale
        centre = unit @ directions(len(query) + 1)[:-1] + self.apart
        low = high = None
        counts = np.zeros(self.n, np.int64)
        waiting = np.ones(self.n, bool)
        if own is not None:
            waiting[own] = False
        wanted = min(k, int(waiting.sum()))
        found, scores, farthest = [np.zeros(0, np.int64)], [np.zeros(0)], math.inf
        seen, radius = 0, FIRST_RADIUS
        while wanted:
            half = WINDOW * radius
            new_low = np.clip(np.searchsorted(self.ranked, centre - half), self.first, self.first + self.n)
            new_high = np.clip(
                np.searchsorted(self.ranked, centre + half, "right"), self.first, self.first + self.n
            )
            if low is None:
                spans = zip(new_low.tolist(), new_high.tolist(), strict=True)
            else:
                spans = zip(
                    [*new_low.tolist(), *high.tolist()], [*low.tolist(), *new_high.tolist()], strict=True
                )
            added = np.concatenate([self.order[a:b] for a, b in spans])
            counts += np.bincount(added, minlength=self.n)
            low, high = new_low, new_high
            near = np.flatnonzero((counts >= self.needed) & waiting)
            if len(near):
                waiting[near] = False
                found.append(near)
                scores.append(np.einsum("ij,j->i", self.vectors[near], query))
                seen += len(near)
                if seen >= wanted:
                    every = np.concatenate(scores)
                    least = np.partition(every, len(every) - wanted)[len(every) - wanted]
                    apart = 2 - 2 * (least / scale) / self.length
                    farthest = math.sqrt(max(apart, 0.0))
            if radius >= farthest or seen >= wanted and seen == self.n - (own is not None):
                break
            radius = min(GROWTH * radius, max(farthest, FIRST_RADIUS))
        return np.concatenate(found), np.concatenate(scores)


def best_of(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k largest scores, equal ones by id."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        kept = np.flatnonzero(scores >= least)
    else:
        kept = np.arange(len(scores))
    return kept[np.lexsort((ids[kept], -scores[kept]))[:k]]


def block_neighbours(rows: DataFrame, k: int) -> DataFrame:
    """``query_row, query_id, vec_id, score``: the k nearest in each pair of blocks.

    ``rows`` has ``is_query, row, vec_id, embedding`` and the keys of the pair.
    """

    def run(group: pa.Table) -> pa.Table:
        asked = group["is_query"].to_numpy()
        row, ids = group["row"].to_numpy(), group["vec_id"].to_numpy()
        flat = group["embedding"].combine_chunks().flatten().to_numpy()
        vectors = flat.reshape(len(row), -1)
        there = np.flatnonzero(~asked)
        parts = []
        if len(there):
            block = SortedProjections(vectors[there])
            at = {r: i for i, r in enumerate(row[there].tolist())}
            for q in np.flatnonzero(asked).tolist():
                near, scores = block.nearest(vectors[q], at.get(int(row[q])), k)
                best = best_of(ids[there[near]], scores, k)
                parts.append((np.full(len(best), q), there[near[best]], scores[best]))
        q, v, score = (
            np.concatenate(x) if parts else np.zeros(0, np.int64)
            for x in (zip(*parts, strict=True) if parts else [[]] * 3)
        )
        return pa.table(
            {
                "query_row": pa.array(row[q]),
                "query_id": pa.array(ids[q]),
                "vec_id": pa.array(ids[v]),
                "score": pa.array(score, pa.float64()),
            }
        )

    schema = "query_row bigint, query_id bigint, vec_id bigint, score double"
    return rows.groupBy("dims", "band", "block", "query_block").applyInArrow(run, schema)


def usable(vectors: DataFrame) -> DataFrame:
    """``row, vec_id, dims, band, embedding`` of the rows that take part, stored.

    ``row`` tells rows that share an id apart; ``band`` is the power of two of the vector's length.
    """
    finite = F.forall(
        "embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    ) & F.exists("embedding", lambda x: x != 0)
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>")
    )
    largest = F.array_max(F.transform("embedding", F.abs))
    square = F.aggregate(
        "embedding", F.lit(0.0), lambda total, x: total + (x / F.col("largest")) ** 2
    )
    return stored(
        rows.where(F.coalesce(finite, F.lit(False)) & F.col("vec_id").isNotNull())
        .withColumn("largest", largest)
        .select(
            F.monotonically_increasing_id().alias("row"),
            "vec_id",
            F.size("embedding").alias("dims"),
            F.floor(F.log2(F.col("largest")) + F.log2(square) / 2).cast("int").alias("band"),
            "embedding",
        ),
        "vectors-to-search",
    )


def nearest(
    vectors: DataFrame, k: int = K, query_step: int = QUERY_STEP, block: int = BLOCK
) -> DataFrame:
    """The ``k`` nearest rows of each query among the ``vec_id, embedding`` rows.

    Queries are the rows whose ``vec_id`` is divisible by ``query_step``; candidates are all rows but
    the query's own; nearest is the largest inner product in double precision. Returns ``query_id,
    rank, vec_id, score``, ranks from 1, equal scores by ``vec_id``; where there are fewer than ``k``
    candidates, all of them. Rows with a null id or a vector that is null, empty, zero or holds null
    or non-finite components take no part. Vectors are compared with those of equal length only. Rows
    sharing an id are rows of their own, as queries and as candidates. Products beyond the range of
    doubles are not looked after. Further columns are not used; an empty table gives an empty table.
    """
    rows = usable(vectors)
    asked = rows.where(F.col("vec_id") % query_step == 0)

    def parts(df, *by):
        return df.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts"))

    def spread(count):
        return F.explode(F.sequence(F.lit(0), count - 1))

    blocks, query_blocks = parts(rows, "dims", "band"), parts(asked, "dims")
    own = F.pmod(F.xxhash64("row"), F.col("parts")).cast("int")
    candidates = (
        rows.join(blocks, ["dims", "band"])
        .withColumn("block", own)
        .drop("parts")
        .join(query_blocks, "dims")
        .withColumn("query_block", spread(F.col("parts")))
    )
    bands = blocks.groupBy("dims").agg(  # a row for each power of two among the lengths
        F.collect_list(F.struct("band", "parts")).alias("bands")
    )
    queries = (
        asked.drop("band")
        .join(query_blocks, "dims")
        .withColumn("query_block", own)
        .drop("parts")
        .join(bands, "dims")
        .withColumn("at", F.explode("bands"))
        .withColumn("band", F.col("at.band"))
        .withColumn("block", spread(F.col("at.parts")))
    )
    names = ["dims", "band", "block", "query_block", "row", "vec_id", "embedding"]
    pairs = candidates.select(F.lit(False).alias("is_query"), *names).unionByName(
        queries.select(F.lit(True).alias("is_query"), *names)
    )
    best = Window.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id")
    return (
        block_neighbours(pairs, k)
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


@query("op12_nearest_neighbours")
def op12_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return nearest(table(spark, folder, "embeddings"))
