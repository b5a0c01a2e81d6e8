"""Near-duplicate embeddings by counting collisions in one-dimensional projections.

Every vector is projected on PROJECTIONS random directions. For two unit vectors at the threshold
the difference of a projection is normal with deviation ``sqrt(2 - 2 * cosine)``; a pair collides
in a projection when one lies in the window of half width WINDOW deviations around the other. The
number of collisions of a linked pair is binomial, which fixes the count that all but 1 - RECALL of
them reach; pairs that reach it are verified by their exact cosine in double precision.

Vectors of one label are dealt to strips along the first projection and, where a strip is large,
to chunks of about CHUNK vectors, so a hot label is many tasks. Each pair of chunks whose strips are
within STRIP_WINDOW deviations is one task, and each pair of vectors is looked at in one task only.
Tasks return counts and a spanning forest of their links, never pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quietroom.llm.base import query, stored, table, with_arrow_columns
from quietroom.llm.components import components

COSINE = 0.93
PROJECTIONS = 24
WINDOW = 2.0
RECALL = 0.9999
# A linked pair leaves the strips' window with a probability of 6e-5.
STRIP_WINDOW = 4.0
CHUNK = 1024
SEED = 20_011


def deviation(cosine: float) -> float:
    return math.sqrt(max(2 - 2 * cosine, 1e-12))


def needed_count(projections: int = PROJECTIONS, window: float = WINDOW) -> int:
    """The largest count that a linked pair reaches with a probability of RECALL."""
    p = math.erf(window / math.sqrt(2))
    missed, count = 0.0, 0
    while count < projections:
        missed += math.comb(projections, count) * p**count * (1 - p) ** (projections - count)
        if missed > 1 - RECALL:
            break
        count += 1
    return count


def directions(dimensions: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((dimensions, PROJECTIONS))


def unit(vectors: np.ndarray) -> np.ndarray:
    largest = np.abs(vectors).max(axis=1, keepdims=True)
    vectors = vectors / largest  # no overflow or underflow in the squares
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def collision_counts(a: np.ndarray, b: np.ndarray, half: float) -> np.ndarray:
    """For each row of ``a`` and of ``b``, in how many projections b lies in a's window."""
    total = np.zeros((len(a), len(b)), np.int8)
    rows = np.arange(len(a))
    for j in range(a.shape[1]):
        order = np.argsort(b[:, j], kind="stable")
        ranked = b[order, j]
        marks = np.zeros((len(a), len(b) + 1), np.int8)
        marks[rows, np.searchsorted(ranked, a[:, j] - half, "left")] += 1
        marks[rows, np.searchsorted(ranked, a[:, j] + half, "right")] -= 1
        total[:, order] += np.cumsum(marks[:, :-1], axis=1, dtype=np.int8)
    return total


def linked_pairs(
    a: np.ndarray, b: np.ndarray, same: bool, cosine: float
) -> tuple[np.ndarray, np.ndarray]:
    """Positions of linked rows of two blocks; of one block, each pair once."""
    on = directions(a.shape[1])
    counts = collision_counts(a @ on, b @ on, WINDOW * deviation(cosine))
    u, v = np.nonzero(counts >= needed_count())
    if same:
        u, v = u[u < v], v[u < v]
    exact = np.empty(len(u), bool)
    for at in range(0, len(u), 100_000):
        part = slice(at, at + 100_000)
        exact[part] = np.einsum("ij,ij->i", a[u[part]], b[v[part]]) >= cosine
    return u[exact], v[exact]


def forest(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The smallest position reachable from each of ``n`` positions."""
    root = np.arange(n)
    while True:
        least = root.copy()
        np.minimum.at(least, u, root[v])
        np.minimum.at(least, v, root[u])
        least = np.minimum(least, least[least])
        if (least == root).all():
            return root
        root = least


def strips(rows: DataFrame, cosine: float) -> DataFrame:
    """``rows`` with ``strip``: the first projection in steps of half the strips' window."""
    step = STRIP_WINDOW * deviation(cosine) / 2

    def compute(batch):
        column = batch.column(batch.schema.get_field_index("embedding"))
        found = np.empty(len(column), np.int64)
        for i, vector in enumerate(column.to_numpy(zero_copy_only=False)):
            vector = unit(np.asarray(vector, float)[None, :])
            found[i] = math.floor((vector @ directions_of(vector.shape[1])[:, 0])[0] / step)
        return [pa.array(found)]

    return with_arrow_columns(rows, compute, ["strip bigint"])


_known: dict[int, np.ndarray] = {}


def directions_of(dimensions: int) -> np.ndarray:
    if dimensions not in _known:
        _known[dimensions] = directions(dimensions)
    return _known[dimensions]


def chunk_pairs(rows: DataFrame, chunk: int) -> DataFrame:
    """``rows`` once for each task that needs them: ``label, dims, s, i, t, j, left``.

    A task compares chunk i of strip s with chunk j of strip t, where t is s, s + 1 or s + 2.
    """
    group = ["label", "dims"]
    sizes = rows.groupBy(*group, "strip").agg(
        F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("k")
    )
    around = sizes.select(
        *group, F.explode(F.array(*[F.col("strip") + d for d in range(-2, 3)])).alias("near"),
        F.struct(F.col("strip").alias("at"), "k").alias("side"),
    )
    sides = around.groupBy(*group, F.col("near").alias("strip")).agg(
        F.collect_list("side").alias("sides")  # five at most
    )
    own = sizes.join(sides, [*group, "strip"])
    placed = rows.join(own, [*group, "strip"]).withColumn(
        "i", F.pmod(F.xxhash64("vec_id"), F.col("k")).cast("int")
    )
    seen = placed.withColumn("side", F.explode("sides"))
    seen = seen.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("side.k") - 1)))
    at, here = F.col("side.at"), F.col("strip")
    left = (at > here) | ((at == here) & (F.col("j") >= F.col("i")))

    def pick(a, b):
        return F.when(left, F.col(a) if isinstance(a, str) else a).otherwise(
            F.col(b) if isinstance(b, str) else b
        )

    return seen.select(
        *group,
        pick("strip", at).alias("s"),
        pick("i", "j").alias("first"),
        pick(at, "strip").alias("t"),
        pick("j", "i").alias("second"),
        left.alias("left"),
        "vec_id",
        "copies",
        "embedding",
    )


def embedding_links(rows: DataFrame, cosine: float, chunk: int) -> DataFrame:
    """``vec_id, links, root``: link counts within each task and a smaller linked vector."""

    def run(group: pa.Table) -> pa.Table:
        ids = group["vec_id"].to_numpy()
        copies = group["copies"].to_numpy()
        left = group["left"].to_numpy()
        vectors = np.stack(group["embedding"].to_numpy()).astype(float)
        same = group["s"][0].as_py() == group["t"][0].as_py()
        same = same and group["first"][0].as_py() == group["second"][0].as_py()
        vectors = unit(vectors)
        order = np.argsort(ids, kind="stable")
        if same:
            a = b = order
        else:
            a, b = order[left[order]], order[~left[order]]
        if not len(a) or not len(b):
            empty = pa.array([], pa.int64())
            return pa.table({"vec_id": empty, "links": empty, "root": empty})
        u, v = linked_pairs(vectors[a], vectors[b], same, cosine)
        u, v = a[u], b[v]
        links = np.zeros(len(ids), np.int64)
        np.add.at(links, u, copies[v])
        np.add.at(links, v, copies[u])
        rank = np.empty(len(ids), np.int64)
        rank[order] = np.arange(len(ids))
        root = forest(rank[u], rank[v], len(ids))
        hit = np.flatnonzero(links > 0)
        return pa.table(
            {
                "vec_id": pa.array(ids[hit]),
                "links": pa.array(links[hit]),
                "root": pa.array(ids[order][root[rank[hit]]]),
            }
        )

    tasks = chunk_pairs(strips(rows, cosine), chunk)
    return tasks.groupBy("label", "dims", "s", "first", "t", "second").applyInArrow(
        run, "vec_id bigint, links bigint, root bigint"
    )


def embedding_dedup(
    vectors: DataFrame, cosine: float = COSINE, chunk: int = CHUNK
) -> DataFrame:
    """Link the rows of ``vec_id, embedding, label`` of equal label with cosine at least ``cosine``.

    Returns a row for each input row: ``vec_id, n_links`` (other rows linked directly),
    ``component_id`` (the smallest ``vec_id`` reachable) and ``kept``. Equal vectors of one label
    are compared once and counted as often as they occur. Rows with a null label, a vector that is
    null, empty, zero or holds null or non-finite components, or a null id link with nothing; a null
    id gives a null component and is not kept. Vectors of different lengths do not link. Rows
    sharing an id count each. Further columns are not used; an empty table gives an empty table.
    """
    rows = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>"))
    finite = F.forall(
        "embedding",
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))),
    ) & F.exists("embedding", lambda x: x != 0)
    good = F.coalesce(finite, F.lit(False)) & F.expr("label IS NOT NULL AND vec_id IS NOT NULL")
    able = rows.where(good)
    classes = stored(
        able.groupBy("label", "embedding")
        .agg(
            F.min("vec_id").alias("least"),
            F.count(F.lit(1)).alias("copies"),
        )
        .select(
            "label",
            F.size("embedding").alias("dims"),
            F.col("least").alias("vec_id"),
            "copies",
            "embedding",
        ),
        "vectors",
    )
    found = stored(embedding_links(classes, cosine, chunk), "vector-links")
    edges = found.where("vec_id <> root").select(
        F.col("vec_id").alias("u"), F.col("root").alias("v")
    )
    counts = found.groupBy("vec_id").agg(F.sum("links").alias("links"))
    roots = components(edges).withColumnsRenamed({"node": "vec_id", "root": "component_id"})
    least = classes.select("label", "embedding", "vec_id", "copies")
    known = (
        least.join(counts, "vec_id", "left")
        .join(roots, "vec_id", "left")
        .select(
            "label",
            "embedding",
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("component_id", "vec_id").alias("component_id"),
        )
    )
    linked = able.join(known, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~good).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    return linked.unionByName(alone).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))
    )


@query("op2_embedding_dedup")
def op2_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return embedding_dedup(table(spark, folder, "embeddings"))
