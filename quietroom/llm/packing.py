"""Lexical retrieval packing: BM25 neighbours of a seed document fill its window.

Documents are tokenised once and stored. Document frequencies and the mean length cover all of
them. They are then ordered by their strongest BM25 terms, so that related documents lie together
wherever they came from, and runs of SHARD_DOCS documents of this order are shards; a frequent
first term goes on by the next ones, and at last by a hash. Each shard scores its documents
against each other over all their terms; seeds are taken from the longest open text down, and the unused neighbours of a seed, best score first, fill its window. The last one is cut
where the window ends and its rest stays open. What is left at the end of a shard goes into
sequences whose lengths are powers of two, so nothing needs padding.
"""

from __future__ import annotations

import bisect
import functools
import math
import re
import struct
import unicodedata
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quietroom.llm.base import (
    query,
    rows_per_batch,
    slices,
    slices_by_bytes,
    stored,
    table,
    with_arrow_columns,
)

WINDOW = 2048
END_ID = 1
SHARD_DOCS = 512
# Strongest terms of a document that place it in the order; scores use all terms.
KEY_TERMS = 4
# Bytes of token ids that a task packs.
PART_BYTES = 16 << 20
K1, B = 1.2, 0.75
# Words, and stretches between white space, whose ids a Python worker remembers; then it starts anew.
MEMORY_WORDS, MEMORY_STRETCHES = 250_000, 250_000
# Bytes of text that are encoded at once: the more, the fewer words are looked up again.
TEXT_BYTES = 8 << 20
# Rows that Spark sends to a Python worker at once, which holds their texts whole.
TEXT_ROWS = 2000
# Rows whose keys are looked at, for each task, to deal documents to tasks by key.
SAMPLED_ROWS, MOST_SAMPLED = 20, 1_000_000


def _class(kind: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(0x250) if unicodedata.category(chr(c))[0] == kind)


# The Latin part of Unicode, without control characters: here lower case, composition and the
# pattern of the tokenizer file are plain; any other text goes through the tokenizer as a whole, and
# so do letters whose lower case lies outside.
_LEAVING = "".join(chr(c) for c in range(0x250) if not "\0" <= chr(c).lower() <= "ɏ" or len(chr(c).lower()) > 1)
_OTHER = re.compile(f"[^\t\n\x0b\x0c\r\x20-\x7e\xa0-ɏ]|<\\||[{_LEAVING}]")
_WORDS = re.compile(
    "[{0}]+|'s|'t|'re|'ve|'m|'ll|'d|[{1}]|[^\\s{0}{1}]+".format(_class("L"), _class("N"))
)


def _byte_letters() -> dict[int, int]:
    """Byte-level vocabularies write a byte that is no visible Latin-1 character as one from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: 256 + i for i, b in enumerate(hidden)}


_BYTE_LETTERS = _byte_letters()
# Words as the pattern cuts them.
_PROBE = ["the", "a", "zzxqv", "naïve", "éàüß", "ɏ", "ā", "½", "'", "?!", "7", "ñueque", "«»"]


class TokenIds:
    """Token ids of texts as packed little-endian 32-bit numbers, with a memory for words."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # such strings in a text are ordinary text
        self.stretches: dict[str, bytes] = {}  # between white space, with what clings to words
        self.words: dict[str, bytes] = {}
        # Another kind of vocabulary is asked for whole texts.
        self.by_word = [self._word(w) for w in _PROBE] == self.whole(_PROBE)

    def whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def _word(self, word: str) -> bytes:
        """Ids of one word as the pattern cuts it, in lower case."""
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(_BYTE_LETTERS)
        ids = [token.id for token in self.tokenizer.model.tokenize(word)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _stretch(self, stretch: str) -> bytes:
        words, parts = self.words, []
        for word in [stretch] if stretch.isalpha() else _WORDS.findall(stretch):
            ids = words.get(word)
            if ids is None:
                ids = words[word] = self._word(word)
            parts.append(ids)
        return b"".join(parts)

    def packed(self, texts: list[str]) -> list[bytes]:
        ids, sizes = self.encoded(pa.array(texts, pa.string()))
        return [f.astype("<u4").tobytes() for f in np.split(ids, np.cumsum(sizes)[:-1])]

    def encoded(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one text after the other, and how many each has."""
        plain = np.zeros(len(texts), bool)
        if self.by_word:
            plain = ~pc.match_substring_regex(texts, _OTHER.pattern).to_numpy(zero_copy_only=False)
        ids, sizes = self._plain(texts.filter(pa.array(plain)))
        if plain.all():
            return ids, sizes
        rows = iter(np.split(ids, np.cumsum(sizes)))
        found = [
            next(rows) if easy else np.frombuffer(self.whole([text])[0], "<u4")
            for easy, text in zip(plain, texts.to_pylist(), strict=True)
        ]
        return np.concatenate(found), np.array([len(f) for f in found], np.int64)

    def _plain(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """``encoded`` by stretches, each different one of which is looked up once.

        No word reaches over white space, and in plain texts all kinds of it are the same.
        """
        for known, most in ((self.stretches, MEMORY_STRETCHES), (self.words, MEMORY_WORDS)):
            if len(known) > most:
                known.clear()
        lists = pc.utf8_split_whitespace(pc.utf8_lower(texts))
        coded = lists.flatten().dictionary_encode()
        known, parts = self.stretches, []
        for stretch in coded.dictionary.to_pylist():
            ids = known.get(stretch)
            if ids is None:
                ids = known[stretch] = self._stretch(stretch)
            parts.append(ids)
        held = np.frombuffer(b"".join(parts), "<u4")
        size = np.array([len(p) for p in parts], np.int64) // 4
        first, at = np.cumsum(size) - size, coded.indices.to_numpy()
        ends = np.append(0, np.cumsum(size[at]))
        place = np.arange(ends[-1]) + np.repeat(first[at] - ends[:-1], size[at])
        bounds = np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy()))
        return held[place], np.diff(ends[bounds])


@functools.cache
def token_ids(path: str) -> TokenIds:
    return TokenIds(path)


def default_tokenizer() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


def _packed(ids: np.ndarray, sizes: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """The columns ``ids`` and ``n`` of ``tokenised`` for rows of these sizes."""
    if not len(ids) or ids.max() < 1 << 16:
        ends = np.append(0, 2 * np.cumsum(sizes)).astype(np.int32)
        buffers = [None, pa.py_buffer(ends), pa.py_buffer(ids.astype("<u2"))]
        return pa.Array.from_buffers(pa.binary(), len(sizes), buffers), pa.array(sizes)
    rows = np.split(ids, np.cumsum(sizes)[:-1])
    small = [int(row.max()) < 1 << 16 for row in rows]
    packed = [row.astype("<u2" if s else "<u4").tobytes() for row, s in zip(rows, small, strict=True)]
    return pa.array(packed, pa.binary()), pa.array(np.where(small, sizes, -sizes))


def tokenised(docs: DataFrame, tokenizer: str) -> DataFrame:
    """``doc_id, ids, n``: each text's ids as packed 16-bit numbers (32-bit if n is negative)."""

    def run(batches):
        pa.default_memory_pool().release_unused()  # what the worker's tasks before had
        encode = token_ids(tokenizer)
        for batch in batches:
            for part in slices_by_bytes(batch, "text", TEXT_BYTES):
                ids, sizes = encode.encoded(pc.fill_null(part.column("text"), ""))
                ids = np.insert(ids, np.cumsum(sizes), END_ID)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *_packed(ids, sizes + 1)], ["doc_id", "ids", "n"]
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, ids binary, n bigint")


def term_counts(documents: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``owner, term, count`` of each document's terms, all documents side by side."""
    owner = np.repeat(np.arange(len(documents)), [len(ids) for ids in documents])
    keys = np.concatenate(documents).astype(np.int64) | owner << 32
    keys.sort()
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    count = np.diff(np.append(first, len(keys)))
    keys = keys[first]
    return keys >> 32, keys & 0xFFFFFFFF, count


@dataclass(frozen=True)
class Statistics:
    """Of all documents: how many, their mean length and in how many each term occurs."""

    documents: int
    mean_length: float
    frequencies: np.ndarray

    @classmethod
    def of(cls, documents: list[np.ndarray]) -> Statistics:
        _, terms, _ = term_counts(documents)
        length = sum(map(len, documents)) / len(documents)
        return cls(len(documents), length, np.bincount(terms))

    def weights(self, term: np.ndarray, count: np.ndarray, length) -> np.ndarray:
        """BM25 weights of terms in documents of these lengths."""
        frequency = self.frequencies[term]
        idf = np.log(1 + (self.documents - frequency + 0.5) / (frequency + 0.5))
        norm = K1 * (1 - B + B * length / self.mean_length)
        return idf * count * (K1 + 1) / (count + norm)


class InvertedIndex:
    """BM25 over the documents of one shard, with the statistics of all documents if given.

    Postings are the documents of each term with their weights, one list after the other.
    """

    def __init__(self, documents: list[np.ndarray], statistics: Statistics | None = None):
        self.n = len(documents)
        owner, term, count = term_counts(documents)
        lengths = np.array([len(ids) for ids in documents], float)
        statistics = statistics or Statistics.of(documents)
        weight = statistics.weights(term, count, lengths[owner])
        order = np.argsort(term, kind="stable")
        self.owner, self.weight = owner[order], weight[order]
        found, place = np.unique(term, return_inverse=True)
        self.starts = np.searchsorted(term[order], found)
        self.ends = np.append(self.starts[1:], len(term))
        # Of each document: which lists its terms have.
        self.lists, self.bounds = place, np.searchsorted(owner, np.arange(self.n + 1))

    def scores(self, seed: int) -> np.ndarray:
        """The score of each document against the terms of ``seed``."""
        asked = self.lists[self.bounds[seed] : self.bounds[seed + 1]]
        starts, sizes = self.starts[asked], self.ends[asked] - self.starts[asked]
        at = np.arange(sizes.sum()) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)
        return np.bincount(self.owner[at], weights=self.weight[at], minlength=self.n)

    def neighbours(self, seed: int) -> np.ndarray:
        """All documents by falling score against the seed, equal scores in order."""
        return np.argsort(-self.scores(seed), kind="stable")


def unpacked(batch: pa.RecordBatch) -> list[np.ndarray]:
    """The ids of the rows of ``tokenised``."""
    kinds = ["<u2" if n > 0 else "<u4" for n in batch.column("n").to_pylist()]
    packed = batch.column("ids").to_pylist()
    return [np.frombuffer(b, k) for b, k in zip(packed, kinds, strict=True)]


def statistics_of(ids: DataFrame) -> Statistics:
    """Over all rows of ``tokenised``; the driver gets one row for each id of the vocabulary."""

    def run(batches):
        token_ids.cache_clear()  # the worker may have encoded texts before
        seen, rows, length = np.zeros(0, np.int64), 0, 0
        for batch in batches:
            for part in slices(batch):
                documents = unpacked(part)
                found = np.bincount(term_counts(documents)[1], minlength=len(seen))
                found[: len(seen)] += seen
                seen, rows = found, rows + len(documents)
                length += sum(map(len, documents))
        held = np.flatnonzero(seen)
        yield pa.RecordBatch.from_pydict(
            {"term": [-2, -1, *held.tolist()], "n": [length, rows, *seen[held].tolist()]}
        )

    counts = ids.select("ids", "n").mapInArrow(run, "term bigint, n bigint")
    found = dict(counts.groupBy("term").agg(F.sum("n")).collect())
    length, rows = found.pop(-2, 0), found.pop(-1, 0)
    frequencies = np.zeros(max(found, default=0) + 1, np.int64)
    frequencies[list(found)] = list(found.values())
    return Statistics(rows, length / max(rows, 1), frequencies)


def with_keys(ids: DataFrame, shared, bounds=None) -> DataFrame:
    """``ids`` with ``terms``, the strongest terms that occur in another document too, and ``part``.

    ``bounds`` are the first keys, ``(terms, place)``, of the parts from 1 on; without them all is
    part 0.
    """

    def compute(batch):
        token_ids.cache_clear()
        documents = unpacked(batch)
        lengths = np.array([len(ids) for ids in documents], float)
        owner, term, count = term_counts(documents)
        often = shared.value.frequencies[term] > 1
        owner, term, count = owner[often], term[often], count[often]
        weight = shared.value.weights(term, count, lengths[owner])
        order = np.lexsort((term, -weight, owner))
        owner, term = owner[order], term[order]
        place = np.arange(len(owner)) - np.searchsorted(owner, np.arange(len(documents)))[owner]
        owner, term = owner[place < KEY_TERMS], term[place < KEY_TERMS]
        ends = np.searchsorted(owner, np.arange(len(documents) + 1))
        terms = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(term, pa.int32()))
        keys = zip(terms.to_pylist(), batch.column("place").to_pylist(), strict=True)
        cuts = bounds.value if bounds else []
        part = [bisect.bisect_right(cuts, key) for key in keys]
        return [terms, pa.array(part, pa.int32())]

    return with_arrow_columns(ids, compute, ["terms array<int>", "part int"])


def part_bounds(placed: DataFrame, shared, parts: int, documents: int) -> list[tuple[list[int], int]]:
    """Keys that cut the documents into ``parts`` of about equal numbers, from a few rows for each.

    The rows are drawn by their hash, so a repeated run has the same bounds; the driver sees at most
    about MOST_SAMPLED of them. Bounds only deal documents to tasks, whatever they are.
    """
    if parts < 2:
        return []
    share = min(1.0, min(SAMPLED_ROWS * parts, MOST_SAMPLED) / max(1, documents))
    drawn = F.pmod(F.xxhash64("place", F.lit(31)), F.lit(1_000_000)) < F.lit(share * 1_000_000)
    rows = with_keys(placed.where(drawn), shared).select("terms", "place").collect()
    keys = sorted((list(r["terms"]), r["place"]) for r in rows)
    return [keys[len(keys) * i // parts] for i in range(1, parts) if keys]


def fill(
    documents: list[np.ndarray], window: int, statistics: Statistics | None = None
) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) pieces that hold every id exactly once."""
    pieces, sequence = [], 0
    taken = np.zeros(len(documents), np.int64)
    lengths = np.array([len(ids) for ids in documents], np.int64)
    for i, n in enumerate(lengths):
        for _ in range(n // window):
            pieces.append((i, int(taken[i]), window, sequence, 0))
            taken[i] += window
            sequence += 1
    index = InvertedIndex(documents, statistics)
    left = int((lengths - taken).sum())
    for seed in np.argsort(-(lengths - taken), kind="stable"):
        # A cut neighbour may have lost some of its rest by now, or all.
        if left < window:
            break
        if taken[seed] == lengths[seed]:
            continue
        room = window
        order = index.neighbours(seed)
        used = taken[order] == lengths[order]
        for i in (seed, *order[~used]):
            length = int(min(room, lengths[i] - taken[i]))
            if length:
                pieces.append((int(i), int(taken[i]), length, sequence, window - room))
                taken[i] += length
                room -= length
            if not room:
                break
        left -= window
        sequence += 1
    # Fewer ids than a window are left: sequences of falling powers of two.
    room, size = 0, 0
    for i in np.flatnonzero(taken < lengths):
        while taken[i] < lengths[i]:
            if not room:
                size = room = 1 << (left.bit_length() - 1)
            length = int(min(room, lengths[i] - taken[i]))
            pieces.append((int(i), int(taken[i]), length, sequence, size - room))
            taken[i] += length
            room -= length
            left -= length
            sequence += not room
    return pieces


PIECE = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
    "sequence_id bigint, offset bigint"
)


def pack(
    docs: DataFrame,
    window: int = WINDOW,
    tokenizer: str | None = None,
    shard_docs: int = SHARD_DOCS,
    keep_ids: bool = False,
) -> DataFrame:
    """Pack the texts of ``doc_id, text`` into sequences of ``window`` ids.

    Returns a row for each piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset`` and, if asked for, ``ids array<int>``. A document is its ids and then id 1; null and
    empty texts are that one id. Rows sharing an id are documents of their own, whose pieces carry
    the same ``doc_id``; a null id is a value like others. Further columns are not used. An empty
    table gives an empty table. Sequences are full or, at the end of a shard, a power of two long.
    """
    spark = docs.sparkSession
    with rows_per_batch(spark, TEXT_ROWS):
        ids = stored(tokenised(docs, tokenizer or default_tokenizer()), "token-ids")
    statistics = statistics_of(ids)
    shared = spark.sparkContext.broadcast(statistics)  # a number for each id of the vocabulary
    shards = max(1, math.ceil(statistics.documents / shard_docs))
    ids_bytes = 2 * statistics.documents * statistics.mean_length
    parts = max(1, min(shards, math.ceil(ids_bytes / PART_BYTES)))
    placed = ids.withColumn("place", F.xxhash64("doc_id", "n", "ids"))
    bounds = part_bounds(placed, shared, parts, statistics.documents)
    cuts = spark.sparkContext.broadcast(bounds)  # a key for each task
    dealt = (
        with_keys(placed, shared, cuts)
        .repartitionById(parts, "part")
        .sortWithinPartitions("terms", "place")
        .select("doc_id", "ids", "n")
    )
    columns = [c.split()[0] for c in PIECE.split(", ")]

    def packed(names: list, documents: list[np.ndarray], first: int) -> tuple[pa.RecordBatch, int]:
        rows, cut = [], []
        for i, start, length, sequence, offset in fill(documents, window, shared.value):
            piece = documents[i][start : start + length].astype("<u4")
            crc, number = zlib.crc32(piece.tobytes()), first + sequence
            rows.append((names[i], start, length, crc, len(documents[i]), number, offset))
            if keep_ids:
                cut.append(piece.astype(np.int32))
        arrays = [pa.array(values, pa.int64()) for values in zip(*rows, strict=True)]
        if keep_ids:
            arrays.append(pa.array(cut, pa.list_(pa.int32())))
        out = pa.RecordBatch.from_arrays(arrays, [*columns, *["ids"] * keep_ids])
        return out, max(r[5] for r in rows) + 1

    def run(batches):
        token_ids.cache_clear()
        first = TaskContext.get().partitionId() << 40
        names, documents = [], []
        for batch in batches:
            for part in slices(batch):
                names += part.column("doc_id").to_pylist()
                documents += unpacked(part)
                while len(documents) >= shard_docs:
                    out, first = packed(names[:shard_docs], documents[:shard_docs], first)
                    names, documents = names[shard_docs:], documents[shard_docs:]
                    yield out
        if documents:
            yield packed(names, documents, first)[0]

    return dealt.mapInArrow(run, PIECE + (", ids array<int>" if keep_ids else ""))


@query("op10_packing")
def op10_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack(table(spark, folder, "documents"))
