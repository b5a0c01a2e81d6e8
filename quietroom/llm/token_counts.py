"""Token counts by a linear longest-match automaton.

The vocabulary becomes a trie. Every node has a failure link, to where matching goes on when the
node has no child for the next byte, and the number of tokens that are thereby complete. Greedy
longest-match counts then follow from one walk over a word, without building its tokens.
"""

from __future__ import annotations

import base64
import functools

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from quietroom.llm.base import query, table, with_arrow_columns

MEMORY_WORDS = 1_000_000
LONG_TEXT = 1_000_000


class Automaton:
    """Counts of greedy longest-match tokens over byte strings.

    ``unknown`` is the count of a word that the vocabulary cannot cover.
    """

    def __init__(self, vocabulary, unknown: int = 1):
        self.unknown = unknown
        self.children: list[dict[int, int]] = [{}]
        final = [False]
        for token in vocabulary:
            node = 0
            for byte in token:
                following = self.children[node].get(byte)
                if following is None:
                    following = self.children[node][byte] = len(self.children)
                    self.children.append({})
                    final.append(False)
                node = following
            if node:
                final[node] = True
        # fails[v]: node to go on from, -1 where no token matches; pops[v]: tokens completed by it
        self.fails = [-1] * len(self.children)
        self.pops = [0] * len(self.children)
        level = [0]
        while level:
            below = []
            for parent in level:
                for byte, node in self.children[parent].items():
                    below.append(node)
                    if final[node]:
                        self.fails[node], self.pops[node] = 0, 1
                        continue
                    at, popped = self.fails[parent], self.pops[parent]
                    while at >= 0 and byte not in self.children[at]:
                        popped += self.pops[at]
                        at = self.fails[at]
                    if at >= 0:
                        self.fails[node] = self.children[at][byte]
                        self.pops[node] = popped
            level = below

    def count(self, word: bytes) -> int:
        children, fails, pops = self.children, self.fails, self.pops
        node = found = 0
        for byte in word:
            while (following := children[node].get(byte)) is None:
                found += pops[node]
                node = fails[node]
                if node < 0:
                    return self.unknown
            node = following
        while node:
            found += pops[node]
            node = fails[node]
            if node < 0:
                return self.unknown
        return found


class WordCounts(dict):
    """Remembers the counts of words; starts anew when it grows large."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: str) -> int:
        if len(self) >= MEMORY_WORDS:
            self.clear()
        found = self[word] = self.automaton.count(word.encode())
        return found


@functools.cache
def word_counts(path: str) -> WordCounts:
    with open(path, "rb") as file:
        vocabulary = [base64.b64decode(line.split()[0]) for line in file if line.strip()]
    return WordCounts(Automaton(vocabulary))


def default_vocabulary() -> str:
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def token_counts(
    docs: DataFrame, vocabulary: str | None = None, pattern: str = public_tokenizers.PATTERN
) -> DataFrame:
    """``docs`` with ``n_words`` and ``n_tokens`` of ``text``.

    ``vocabulary`` is a rank file on every executor: a token in base 64 and a number on each line.
    Words are the matches of ``pattern``; a word's tokens are found by taking the longest
    vocabulary entry from the left, again and again; a word that cannot be covered counts as one
    token. Null and empty texts have 0 of both. Other columns pass through, those with the names of
    the results are replaced; an empty table gives an empty table.
    """
    path = vocabulary or default_vocabulary()
    split = regex.compile(pattern)

    def compute(batch):
        counts = word_counts(path)
        words, tokens = [], []
        for text in batch.column(batch.schema.get_field_index("text")):
            text = text.as_py() or ""
            if len(text) < LONG_TEXT:
                found = split.findall(text)
                words.append(len(found))
                tokens.append(sum(map(counts.__getitem__, found)))
            else:  # word by word, in memory that does not grow
                n = total = 0
                for match in split.finditer(text):
                    n += 1
                    total += counts[match[0]]
                words.append(n)
                tokens.append(total)
        return pa.array(words, pa.int64()), pa.array(tokens, pa.int64())

    return with_arrow_columns(docs, compute, ["n_words bigint", "n_tokens bigint"])


@query("op4_token_counts")
def op4_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return token_counts(docs).select("doc_id", "n_words", "n_tokens")
