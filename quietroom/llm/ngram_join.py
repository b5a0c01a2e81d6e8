"""Exact Jaccard self-join of word-shingle sets by a partition of the universe.

Sizes are cut into bands. Two sets that link, the smaller one in band b, differ in at most
H = floor(hi_b * (100 - t) / t) shingles. Shingles are hashed into the band's segments, some taken
as they are and some with their one-deletion neighbourhoods (all ways to leave one shingle out);
with ``exact + 2 * deletion = H + 1`` segments, at least one of them must agree, so every link shares
a signature. Empty segments agree by chance; the other plan takes more segments, so many that every
set of the corpus fills more than H of them, and leaves empty ones out: of the segments that agree,
one then is not empty. Each band takes the plan of the least cost: signatures written plus expected
partners by chance, from the number of sets in the band; a band where some set fills too few segments
keeps to the first plan.

Equal sets are one node. The nodes that share a signature are a star around the least of them. Stars
are compared each on its own and not as the clusters that they connect to: signatures of passages that
many texts share chain most of a large corpus. Small stars are packed together. Counts of shingles in
bins bound what two sets can share, so they say which nodes of a star can link, without losing one.
What these connect is small next to the corpus; its clusters are cut into blocks, and each pair of blocks
is verified in one task by exact intersections of whole sets, which returns a spanning forest of the
links and never the pairs.
"""

from __future__ import annotations

import bisect
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quietroom.llm.base import query, slices, stored, table, with_arrow_columns
from quietroom.llm.components import components
from quietroom.llm.words import mix, shingles, word_hashes
from quietroom.session import settle

_U = np.uint64
BAND_RATIO = 1.5
# In the cost model: chance that a shingle of one set is in another set of the same band.
SHARED_CHANCE = 0.0005
# What a partner by chance costs, in signatures.
PARTNER_COST = 50
# Deviations by which the filled segments of the smallest sets of a band should exceed H.
SLACK = 6.0
ROWS_OUT = 200_000
BLOCK, BLOCK_BYTES = 512, 64 << 20
# The same for blocks of bins, and how many cells of them are compared at a time.
BIN_BLOCK, BIN_BYTES, BIN_CELLS = 1024, 8 << 20, 4 << 20
# Rows of bins in a pack of small stars; larger stars stay alone.
PACK = 512
LARGE_PER_TASK, PACKS_PER_TASK = 2, 64
# Bits that say which texts are needed again.
MARKS = 1 << 25
SEEN = 10_000


@dataclass(frozen=True)
class Band:
    number: int
    low: int
    high: int
    exact: int
    deletion: int
    filled: bool = False  # only segments that are not empty give signatures

    @property
    def segments(self) -> int:
        return self.exact + self.deletion


def band_edges(largest: int, percent: int) -> list[tuple[int, int]]:
    """Size bands from the smallest size that can have an unequal partner up to ``largest``."""
    low, out = max(1, math.ceil(percent / (100 - percent))), []
    while low <= largest:
        high = max(low, math.ceil(low * BAND_RATIO) - 1)
        out.append((low, high))
        low = high + 1
    return out


def differing(high: int, percent: int) -> int:
    """Shingles in which two linked sets differ at most, the smaller one of at most ``high``."""
    return high * (100 - percent) // percent


def filled_segments(low: int, high: int, percent: int) -> int | None:
    """Segments of which sets of ``low`` shingles and more fill over H, but for rare ones."""
    differ = differing(high, percent)
    count = np.arange(differ + 1, 8 * differ + 64)
    empty = np.exp(-low / count)
    spread = np.sqrt(np.maximum(count * empty * (1 - (1 + low / count) * empty), 0))
    enough = np.flatnonzero(count * (1 - empty) - SLACK * spread > differ)
    return int(count[enough[0]]) if len(enough) else None


def plan(number: int, low: int, high: int, sets: int, percent: int, irregular: bool) -> Band:
    """The cheaper plan for a band; ``irregular`` rules out the one without empty segments."""
    exact, deletion, cost = allocate(low, high, sets, percent)
    count = None if irregular else filled_segments(low, high, percent)
    if count is not None:
        chance = SHARED_CHANCE ** max(1.0, (low + high) / 2 / count)
        if count * (1 + PARTNER_COST * sets * chance) < cost:
            return Band(number, low, high, count, 0, True)
    return Band(number, low, high, exact, deletion)


def allocate(low: int, high: int, sets: int, percent: int) -> tuple[int, int, float]:
    """Numbers of exact and one-deletion segments of the least cost, and that cost."""
    differ = differing(high, percent)
    deletion = np.arange((differ + 1) // 2 + 1)
    exact = differ + 1 - 2 * deletion
    tokens = (low + high) / 2 / (exact + deletion)
    signatures = exact + deletion * (1 + tokens)
    by_chance = SHARED_CHANCE**tokens + np.exp(-2 * tokens)
    # two segments of at most one shingle always agree
    near_chance = (1 + tokens) * SHARED_CHANCE ** (tokens - 1)
    near_chance = near_chance + (1 + tokens) ** 2 * np.exp(-2 * tokens)
    cost = signatures + PARTNER_COST * sets * (exact * by_chance + deletion * near_chance)
    best = int(np.argmin(cost))
    return int(exact[best]), int(deletion[best]), float(cost[best])


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    return np.unique(shingles(words, k))


def set_hash(found: np.ndarray) -> int:
    """A 64-bit hash of a whole set; -1 for the empty one. Equal hashes are taken as equal sets."""
    if not len(found):
        return -1
    total = np.sum(mix(found + _U(0x51ED270B7A5D1A31)), dtype=_U, keepdims=True)
    return int(mix(total + np.array([len(found)], _U))[0] >> _U(1))


def bin_number(size: int) -> int:
    """How many bins a set of this size has: the largest power of two up to it."""
    return 1 << (max(size, 1).bit_length() - 1)


def bin_counts(found: np.ndarray) -> np.ndarray:
    """How many shingles each bin holds, in one byte each if that is enough.

    Two sets share at most the sum of the smaller counts; of unrelated ones that is far below what
    links ask for. Bins fold to half their number by adding the second half to the first.
    """
    bins = bin_number(len(found))
    counts = np.bincount((mix(found + _U(0x7F4A7C15)) % _U(bins)).astype(np.int64), minlength=bins)
    return counts.astype(np.uint8 if counts.max(initial=0) < 256 else "<u4")


def segment_of(found: np.ndarray, segments: int) -> np.ndarray:
    return (mix(found ^ _U(0x2545F4914F6CDD1D)) % _U(segments)).astype(np.int64)


def signatures(found: np.ndarray, band: Band) -> np.ndarray:
    """The signatures of one set under a band's segments."""
    place = segment_of(found, band.segments)
    order = np.argsort(place, kind="stable")
    place, value = place[order], mix(found[order] + _U(0x3C79AC492BA7B653))
    counts = np.bincount(place, minlength=band.segments)
    sums = np.zeros(band.segments, _U)
    starts = np.cumsum(counts) - counts
    full = counts > 0
    sums[full] = np.add.reduceat(value, starts[full])
    seed = np.arange(band.segments, dtype=_U) * _U(0x1C69B3F74AC4AE35)
    seed += _U((band.number + 1) * 0xA24BAED4963EE407 % 2**64)
    size = _U(0x9FB21C651E98DF25)
    whole = mix(sums + seed + counts.astype(_U) * size)
    if not band.deletion:
        return whole[full] if band.filled else whole
    near = place >= band.exact
    at = place[near]
    less = mix(sums[at] - value[near] + seed[at] + (counts[at] - 1).astype(_U) * size)
    return np.unique(np.concatenate([whole, less]))


def reached(size: int, lows: list[int], highs: list[int], percent: int) -> list[int]:
    """The bands in which a set of ``size`` gives signatures: its own and those of its partners."""
    at = bisect.bisect_right(lows, size) - 1
    least, out = -(-size * percent // 100), []
    while at >= 0 and highs[at] >= least:
        out.append(at)
        at -= 1
    return out


def set_sizes(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """``doc_id, text_hash, n_shingles, node, bins, irregular`` of every row; node is the hash of the set.

    ``bins`` are those of ``bin_counts``.
    ``irregular`` lists the bands in whose plan without empty segments the set fills too few.
    """

    def compute(batch):
        words, ends = word_hashes(batch.column(batch.schema.get_field_index("text")))
        sizes, nodes, bins, irregular, known = [], [], [], [], {}
        for i in range(len(ends) - 1):
            found = shingle_set(words[ends[i] : ends[i + 1]], k)
            sizes.append(len(found))
            nodes.append(set_hash(found))
            bins.append(bin_counts(found).tobytes())
            edges = band_edges(len(found), percent)
            wrong = []
            for at in reached(len(found), [e[0] for e in edges], [e[1] for e in edges], percent):
                if at not in known:
                    known[at] = filled_segments(*edges[at], percent)
                count = known[at]
                if count is not None:
                    filled = np.count_nonzero(np.bincount(segment_of(found, count)))
                    if filled <= differing(edges[at][1], percent):
                        wrong.append(at)
            irregular.append(wrong)
        return (
            pa.array(sizes, pa.int64()),
            pa.array(nodes, pa.int64()),
            pa.array(bins, pa.binary()),
            pa.array(irregular, pa.list_(pa.int32())),
        )

    fields = ["n_shingles bigint", "node bigint", "bins binary", "irregular array<int>"]
    named = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return with_arrow_columns(named, compute, fields).drop("text")


def signature_rows(texts: DataFrame, k: int, percent: int, bands: list[Band]) -> DataFrame:
    """``sig, node``: the signatures of every set in its own band and in those of its partners."""
    lows, highs = [b.low for b in bands], [b.high for b in bands]

    def block(sigs, nodes):
        sig = np.concatenate(sigs).view(np.int64)
        node = np.repeat(np.array(nodes, np.int64), [len(s) for s in sigs])
        return pa.RecordBatch.from_arrays([pa.array(sig), pa.array(node)], ["sig", "node"])

    def run(batches):
        seen = set()  # nodes of the last rows; repeated signatures would do no harm
        for batch in (part for whole in batches for part in slices(whole)):
            words, ends = word_hashes(batch.column(0))
            sigs, nodes, waiting = [], [], 0
            if len(seen) > SEEN:
                seen.clear()
            for i in range(len(ends) - 1):
                found = shingle_set(words[ends[i] : ends[i + 1]], k)
                node = set_hash(found)
                if node in seen:
                    continue
                seen.add(node)
                for at in reached(len(found), lows, highs, percent):
                    sigs.append(signatures(found, bands[at]))
                    nodes.append(node)
                    waiting += len(sigs[-1])
                if waiting >= ROWS_OUT:
                    yield block(sigs, nodes)
                    sigs, nodes, waiting = [], [], 0
            if sigs:
                yield block(sigs, nodes)

    return texts.mapInArrow(run, "sig bigint, node bigint")


def marked(wanted: DataFrame) -> np.ndarray:
    """A table of MARKS bits with those of the wanted ``doc_id`` set, whatever their number."""
    at = F.pmod(F.xxhash64("doc_id"), F.lit(MARKS)) + 1
    rows = wanted.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")
    )
    found = np.zeros(MARKS, bool)
    for r in rows.collect():  # MARKS / 32768 rows of 4 KB at most
        bits = np.unpackbits(np.frombuffer(r["bits"], np.uint8), bitorder="little")
        low = (r["bucket"] - 1) * len(bits)
        found[low : low + len(bits)] = bits[: MARKS - low]
    return np.packbits(found, bitorder="little")


def set_table(texts: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """``cluster, node, n_shingles, items``: whole sets of the wanted ``doc_id, node``, packed.

    Texts whose id's bit is not set are left out before anything is shuffled; the bits have a fixed
    size, so with very many wanted rows more texts pass them, and the join alone decides.
    """
    bits = texts.sparkSession.sparkContext.broadcast(marked(wanted))

    def run(batches):
        seen = set()  # repeated rows need not come again; some may
        for batch in (part for whole in batches for part in slices(whole)):
            at = batch.column(2).to_numpy()
            asked = np.flatnonzero(bits.value[at >> 3] >> (at & 7) & 1)
            if not len(asked):
                continue
            batch = batch.take(pa.array(asked))
            words, ends = word_hashes(batch.column(1))
            rows, nodes, packed = [], [], []
            if len(seen) > SEEN:
                seen.clear()
            for i, name in enumerate(batch.column(0).to_pylist()):
                found = shingle_set(words[ends[i] : ends[i + 1]], k)
                node = set_hash(found)
                if (name, node) in seen:
                    continue
                seen.add((name, node))
                rows.append(name)
                nodes.append(node)
                packed.append(found.astype("<u8").tobytes())
            arrays = [pa.array(rows, pa.int64()), pa.array(nodes, pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [*arrays, pa.array(packed, pa.binary())], ["doc_id", "node", "items"]
            )

    at = F.pmod(F.xxhash64("doc_id"), F.lit(MARKS)).alias("at")
    found = texts.select("doc_id", "text", at).mapInArrow(
        run, "doc_id bigint, node bigint, items binary"
    )
    return found.join(wanted, ["doc_id", "node"]).select("cluster", "node", "n_shingles", "items")


def folded(rows: list[np.ndarray], bins: int) -> np.ndarray:
    """Counts of several sets as a matrix of so many bins."""
    out = np.zeros((len(rows), bins), np.int32)
    for i, counts in enumerate(rows):
        out[i] = counts.reshape(-1, bins).sum(axis=0)
    return out


def possible_pairs(
    a: list[np.ndarray], b: list[np.ndarray], sizes: tuple[np.ndarray, np.ndarray], percent: int
) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the pairs of two lists of bin counts that may link: none that links is missing."""
    us, vs = [], []
    kinds = [np.array([len(x) for x in rows]) for rows in (a, b)]
    for m in np.unique(kinds[0]):
        one = np.flatnonzero(kinds[0] == m)
        for n in np.unique(kinds[1]):
            two = np.flatnonzero(kinds[1] == n)
            # Sizes go with the number of bins, to a factor of two.
            if 200 * min(m, n) <= percent * max(m, n):
                continue
            bins = int(min(m, n))
            kind = np.float32 if bins < 1 << 24 else np.float64  # holds sums up to so many
            step = max(1, min(BIN_BLOCK, BIN_CELLS // bins))
            for start in range(0, len(two), step):
                others = two[start : start + step]
                right = folded([b[i] for i in others], bins)
                for at in range(0, len(one), step):
                    rows = one[at : at + step]
                    left = folded([a[i] for i in rows], bins)
                    shared = np.zeros((len(rows), len(others)), np.float64)
                    for least in range(1, int(min(left.max(), right.max())) + 1):
                        x, y = (left >= least).astype(kind), (right >= least).astype(kind)
                        used = np.flatnonzero(x.any(axis=0) & y.any(axis=0))
                        if 2 * len(used) < bins:
                            x, y = x[:, used], y[:, used]
                        shared += x @ y.T
                    total = sizes[0][rows][:, None] + sizes[1][others][None, :]
                    u, v = np.nonzero(100 * shared >= percent * (total - shared))
                    us.append(rows[u])
                    vs.append(others[v])
    nothing = np.zeros(0, np.int64)
    return np.concatenate([nothing, *us]), np.concatenate([nothing, *vs])


def _with_itself(group: pa.Table) -> bool:
    c, i, d, j = (group[name][0].as_py() for name in ("c", "i", "d", "j"))
    return (c, i) == (d, j)


def compatible(blocks: DataFrame, percent: int) -> DataFrame:
    """``u, v``: a spanning forest, in each pair of blocks, of the nodes whose bins allow a link.

    ``blocks`` are those of ``paired_blocks`` with ``n_shingles, bins``.
    """

    def run(group: pa.Table) -> pa.Table:
        nodes, left = group["node"].to_numpy(), group["left"].to_numpy()
        sizes = group["n_shingles"].to_numpy()
        counts = [
            np.frombuffer(x.as_buffer(), np.uint8 if len(x.as_buffer()) == bin_number(int(n)) else "<u4")
            for x, n in zip(group["bins"], sizes, strict=True)
        ]
        one = np.flatnonzero(left)
        same = _with_itself(group)
        two = one if same else np.flatnonzero(~left)
        u, v = possible_pairs(
            [counts[x] for x in one], [counts[x] for x in two], (sizes[one], sizes[two]), percent
        )
        root = least_reachable(one[u], two[v], len(nodes))
        linked = np.flatnonzero(root != np.arange(len(nodes)))
        return pa.table({"u": nodes[linked], "v": nodes[root[linked]]})

    return blocks.groupBy(*PAIR).applyInArrow(run, "u bigint, v bigint")


def shared_counts(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every set of ``a`` with every set of ``b``."""
    counts = np.zeros((len(a), len(b)), np.int32)
    owners = [np.repeat(np.arange(len(s)), [len(x) for x in s]) for s in (a, b)]
    items = [np.concatenate(s) for s in (a, b)]
    orders = [np.argsort(x, kind="stable") for x in items]
    items = [x[o] for x, o in zip(items, orders, strict=True)]
    owners = [x[o] for x, o in zip(owners, orders, strict=True)]
    shared = np.intersect1d(*map(np.unique, items), assume_unique=True)
    (al, ar), (bl, br) = (
        (np.searchsorted(x, shared, "left"), np.searchsorted(x, shared, "right")) for x in items
    )
    for i, j, k, m in zip(al, ar, bl, br, strict=True):
        counts[owners[0][i:j, None], owners[1][None, k:m]] += 1
    return counts


def least_reachable(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The smallest of ``n`` positions that each can reach over the edges ``u, v``."""
    root = np.arange(n)
    while True:
        least = root.copy()
        np.minimum.at(least, u, root[v])
        np.minimum.at(least, v, root[u])
        least = np.minimum(least, least[least])
        if (least == root).all():
            return root
        root = least


def block_links(blocks: DataFrame, percent: int) -> DataFrame:
    """``u, v``: a spanning forest of the links in each pair of blocks of a cluster.

    ``blocks`` are those of ``paired_blocks`` with ``items``.
    """

    def run(group: pa.Table) -> pa.Table:
        nodes = group["node"].to_numpy()
        left = group["left"].to_numpy()
        sets = [np.frombuffer(x.as_buffer(), "<u8") for x in group["items"]]
        same = _with_itself(group)
        one = np.flatnonzero(left)
        two = one if same else np.flatnonzero(~left)
        edges = pa.array([], pa.int64())
        if not len(one) or not len(two):
            return pa.table({"u": edges, "v": edges})
        both = shared_counts([sets[x] for x in one], [sets[x] for x in two])
        sizes = np.array([len(x) for x in sets], np.int64)
        whole = sizes[one][:, None] + sizes[two][None, :] - both
        u, v = np.nonzero(100 * both.astype(np.int64) >= percent * whole)
        root = least_reachable(one[u], two[v], len(nodes))
        linked = np.flatnonzero(root != np.arange(len(nodes)))
        return pa.table({"u": nodes[linked], "v": nodes[root[linked]]})

    return blocks.groupBy(*PAIR).applyInArrow(run, "u bigint, v bigint")


PAIR = ["cluster", "c", "i", "d", "j"]


def paired_blocks(
    rows: DataFrame,
    counted: DataFrame,
    columns: list[str],
    percent: int,
    size: str,
    most: int,
    limit: int,
    larger: int = 1,
    packed: Column | None = None,
) -> DataFrame:
    """``rows`` of ``cluster, node, n_shingles`` once for each pair of blocks that needs them.

    ``counted`` has the same rows, or those that they come from, without what is dear to make.

    Sets that link have sizes of the same class or of neighbouring ones. A class of a cluster is cut
    into blocks by a hash, of about ``most`` rows and ``limit`` bytes of ``size``; of large classes, a
    quarter up to ``larger`` times as many rows, so that copies grow later. Clusters that are ``packed``
    have a single class. Every pair of
    blocks of a class or of two neighbouring ones is a group: block ``i`` of class ``c`` with block
    ``j`` of class ``d``, whose rows are ``left`` or not; a block with itself has left ones only.
    Groups are dealt to a number of tasks that goes by that of the large ones, as their work does not go by
    bytes.
    """
    spark = rows.sparkSession
    # A little more than the ratio, so that rounding parts no sizes.
    base = math.log(100 / percent * 1.001)
    own_class = F.floor(F.log(F.col("n_shingles").cast("double")) / base)
    if packed is not None:
        own_class = F.when(packed, F.lit(-2).cast("bigint")).otherwise(own_class)
    rows_of_block = F.greatest(F.lit(most), F.least(F.lit(most * larger), F.count(F.lit(1)) / 4))
    sizes = stored(
        counted.select("cluster", own_class.alias("c"), F.expr(size).alias("size"))
        .groupBy("cluster", "c")
        .agg(
            F.greatest(
                F.ceil(F.count(F.lit(1)) / rows_of_block), F.ceil(F.sum("size") / limit), F.lit(1)
            ).cast("int").alias("n")
        ),
        "block-numbers",
    )
    above = sizes.select("cluster", (F.col("c") - 1).alias("c"), F.col("n").alias("above"))
    below = sizes.select("cluster", (F.col("c") + 1).alias("c"), F.col("n").alias("below"))
    around = stored(
        sizes.join(above, ["cluster", "c"], "left").join(below, ["cluster", "c"], "left")
        .na.fill(0, ["above", "below"]),
        "block-pairs",
    )
    groups = F.col("n") * (F.col("n") + 1) / 2 + F.col("n") * F.col("above")
    large = around.where("n > 1 OR above > 1").agg(F.sum(groups)).first()[0] or 0
    packs = around.where("c < 0").count()
    tasks = math.ceil(large / LARGE_PER_TASK + packs / PACKS_PER_TASK)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), tasks)

    own = F.pmod(F.xxhash64("node"), F.col("n")).cast("int").alias("own")
    placed = rows.withColumn("c", own_class).join(around, ["cluster", "c"]).select("*", own)
    other = F.explode(
        F.concat(
            F.transform(_until("n"), lambda x: _side(0, x)),
            F.transform(_until("above"), lambda x: _side(1, x)),
            F.transform(_until("below"), lambda x: _side(-1, x)),
        )
    ).alias("o")
    seen = placed.select("cluster", "c", "own", "node", *columns, other)
    at, here, step = F.col("o.at"), F.col("own"), F.col("o.step")
    left = F.when(step == 0, here <= at).otherwise(step > 0)
    return seen.select(
        "cluster",
        F.when(step < 0, F.col("c") - 1).otherwise(F.col("c")).alias("c"),
        F.when(left, here).otherwise(at).alias("i"),
        F.when(step > 0, F.col("c") + 1).otherwise(F.col("c")).alias("d"),
        F.when(left, at).otherwise(here).alias("j"),
        left.alias("left"),
        "node",
        *columns,
    ).repartition(tasks, *PAIR)


def _until(count: str):
    """0 .. count - 1, nothing for 0."""
    return F.when(F.col(count) > 0, F.sequence(F.lit(0), F.col(count) - 1)).otherwise(
        F.array().cast("array<int>")
    )


def _side(step: int, at):
    return F.struct(F.lit(step).alias("step"), at.alias("at"))


def placed_stars(rows: DataFrame, members: DataFrame) -> DataFrame:
    """``cluster, node, n_shingles, packed``: the stars of ``sig, node``, small ones packed together.

    The nodes that share a signature go with the least of them, in a single scan whatever their number;
    those of several signatures with the same least node are one star. Every two nodes that share a
    signature have a cluster in common.
    """
    least = F.first("node").over(Window.partitionBy("sig").orderBy("node"))
    points = stored(
        rows.select("node", least.alias("low")).where("node <> low").distinct(), "star-points"
    )
    stars = points.unionByName(points.select(F.col("low").alias("node"), "low").distinct())
    sizes = points.groupBy("low").agg((F.count(F.lit(1)) + 1).alias("n"))
    small = sizes.where(F.col("n") <= PACK).agg(F.sum("n")).first()[0] or 0
    packs = max(1, math.ceil(small / PACK))
    packed = F.col("n") <= PACK
    pack = F.pmod(F.xxhash64("low"), F.lit(packs))
    whole = members.groupBy("node").agg(F.max("n_shingles").alias("n_shingles"))
    return (
        stars.join(sizes, "low")
        .select(F.when(packed, pack).otherwise(F.col("low")).alias("cluster"), "node", packed.alias("packed"))
        .distinct()
        .join(whole, "node")
    )


def links(docs: DataFrame, members: DataFrame, k: int, percent: int) -> DataFrame:
    """Edges ``u, v`` between nodes that connect all nodes which links connect; all are links."""
    spark = docs.sparkSession
    nothing = spark.createDataFrame([], "u bigint, v bigint")
    named = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text")
    texts = named.select("text")
    largest = members.agg(F.max("n_shingles")).first()[0] or 0
    edges = band_edges(largest, percent)
    if not edges:
        return nothing
    number = F.lit(0)
    for low, _ in edges:
        number = number + F.when(F.col("n_shingles") >= low, 1).otherwise(0)
    counts = dict(members.groupBy(number.alias("b")).count().collect())  # one row for each band
    odd = {r[0] for r in members.select(F.explode("irregular")).distinct().collect()}
    bands = [
        plan(i, low, high, counts.get(i + 1, 0), percent, i in odd)
        for i, (low, high) in enumerate(edges)
    ]

    rows = signature_rows(texts, k, percent, bands)
    stars = stored(placed_stars(rows, members), "placed-stars")
    nodes = members.groupBy("node").agg(
        F.min("doc_id").alias("doc_id"),
        F.max("n_shingles").alias("n_shingles"),
        F.max("bins").alias("bins"),  # equal for equal sets
    )
    paired = paired_blocks(
        stars.join(nodes.select("node", "bins"), "node"),
        stars,
        ["n_shingles", "bins"],
        percent,
        "n_shingles",
        BIN_BLOCK,
        BIN_BYTES,
        larger=4,
        packed=F.col("packed"),
    )
    near = stored(compatible(paired, percent), "compatible")
    clusters = stored(components(near), "near-clusters")
    wanted = stored(
        clusters.withColumnRenamed("root", "cluster").join(nodes.drop("bins"), "node"), "wanted-sets"
    )
    sets = set_table(named, wanted, k)
    paired = paired_blocks(sets, wanted, ["items"], percent, "8 * n_shingles", BLOCK, BLOCK_BYTES)
    return stored(block_links(paired, percent), "links")


def ngram_join(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Group the rows of ``doc_id, text`` whose shingle sets link at ``percent`` or more.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; a set holds the distinct runs of ``k``
    words, or the whole sequence of fewer words. Returns ``doc_id, n_shingles, node, text_hash, root,
    component_id``, one row for each input row: ``node`` stands for the set and ``root`` for all that
    is reachable by links, ``text_hash`` is the text's ``xxhash64``; ``component_id`` is the smallest id
    reachable by links, the own id where there is none. Null and empty texts have empty sets and link
    with nothing. A null id has a null component and links with nothing. Rows sharing an id stay
    separate rows; each belongs to the component of its own text. Further columns are not used. An
    empty table gives an empty table.
    """

    def made() -> DataFrame:
        members = stored(set_sizes(docs, k, percent), "sets-of-documents")
        able = members.where("doc_id IS NOT NULL AND n_shingles > 0")
        roots = components(links(docs, able, k, percent))
        classes = (
            able.groupBy("node")
            .agg(F.min("doc_id").alias("least"))
            .join(roots, "node", "left")
            .withColumn("root", F.coalesce("root", "node"))
        )
        least = classes.groupBy("root").agg(F.min("least").alias("component_id"))
        found = classes.join(least, "root").select("node", "root", "component_id")
        alone = members.where("doc_id IS NULL OR n_shingles = 0").select(
            "doc_id",
            "n_shingles",
            "node",
            "text_hash",
            F.lit(None).cast("bigint").alias("root"),
            F.col("doc_id").alias("component_id"),
        )
        return able.join(found, "node").select(*alone.columns).unionByName(alone)

    return settle(docs.sparkSession, made, "llm-ngram-join")


def one_of_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``docs`` of which one stays for each component of ``ngram_join``'s ``found``.

    It is a row with the component's smallest id; of several such rows, of repeated ones too, one.
    Rows with a null id or an empty set all stay. Only rows that go, or repeat, are looked up, so the
    texts of the others are not shuffled where those are few.
    """
    linked = found.where("root IS NOT NULL")
    least = F.when(F.col("doc_id") == F.col("component_id"), F.struct("node", "text_hash"))
    kept = linked.groupBy("root").agg(F.min(least).alias("kept"))
    rows = linked.groupBy("root", "doc_id", "component_id", "node", "text_hash").agg(
        F.count(F.lit(1)).alias("copies")
    )
    stays = (F.col("doc_id") == F.col("component_id")) & (F.struct("node", "text_hash") == F.col("kept"))
    marked = rows.join(kept, "root").withColumn("stays", stays)
    lost = stored(
        marked.where("NOT stays OR copies > 1").select("doc_id", "text_hash", "stays"), "lost-rows"
    )
    key = ["doc_id", "text_hash"]
    hashed = docs.withColumn("text_hash", F.xxhash64("text"))
    others = hashed.join(lost.select(*key), key, "left_anti")
    repeated = hashed.join(lost.where("stays").select(*key), key, "left_semi")
    return others.unionByName(repeated.dropDuplicates(key)).drop("text_hash")


@query("op8_ngram_join")
def op8_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return ngram_join(docs, k=3, percent=90).select("doc_id", "n_shingles", "component_id")
