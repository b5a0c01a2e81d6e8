"""Text expressions; all stay on the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quietroom.settings import LONG_ABOVE_WORDS, SHORT_BELOW_WORDS

# Fixed patterns. Java's plain \s is ASCII only, so the Unicode class is switched
# on and the four separator controls are listed. Word characters are letters,
# digits and underscore, without combining marks.
WHITESPACE = r"(?U)[\s\x1c-\x1f]+"
NON_WHITESPACE = r"(?U)[^\s\x1c-\x1f]+"
TOKEN = r"[\p{L}\p{N}_]{2,}"
WORD = r"[\p{L}\p{N}_]+"
PIECE = r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]"


def clean_text(text: Column) -> Column:
    """Lower-case, collapse whitespace and trim; a missing text becomes ``nan``."""
    collapsed = F.regexp_replace(F.lower(text.cast("string")), WHITESPACE, " ")
    return F.coalesce(F.trim(collapsed), F.lit("nan"))


def token_text(text: Column) -> Column:
    """What ``word_tokens`` needs of a cleaned text: white space parts words, collapsed or not."""
    return F.coalesce(F.lower(text.cast("string")), F.lit("nan"))


def word_count(text: Column) -> Column:
    """Number of whitespace-separated words, counted without building an array."""
    return F.coalesce(F.regexp_count(text, F.lit(NON_WHITESPACE)), F.lit(1))


def length_bucket(words: Column) -> Column:
    return (
        F.when(words < SHORT_BELOW_WORDS, "short")
        .when(words > LONG_ABOVE_WORDS, "long")
        .otherwise("mid")
    )


def word_tokens(clean: Column) -> Column:
    """Runs of at least two word characters, in text order."""
    return F.regexp_extract_all(clean, F.lit(TOKEN), F.lit(0))


def bigrams(tokens: Column) -> Column:
    pairs = F.greatest(F.size(tokens) - 1, F.lit(0))
    left, right = F.slice(tokens, 1, pairs), F.slice(tokens, 2, pairs)
    return F.zip_with(left, right, lambda a, b: F.concat(a, F.lit(" "), b))


def ngrams(tokens: Column) -> Column:
    """Single tokens followed by adjacent pairs."""
    return F.concat(tokens, bigrams(tokens))


def sequence_pieces(clean: Column) -> Column:
    """Words and single punctuation marks, the units of sequence encoding."""
    return F.regexp_extract_all(clean, F.lit(PIECE), F.lit(0))


def pipe_join(labels: Column) -> Column:
    return F.array_join(labels, "|")


def pipe_split(joined: Column) -> Column:
    return F.when(joined == "", F.array().cast("array<string>")).otherwise(
        F.split(joined, r"\|")
    )


def flags_text(flags: Column) -> Column:
    return F.array_join(flags, ", ")


def score_text(score: Column) -> Column:
    """Score with two decimals."""
    return F.format_string("%.2f", score)


def iso_time(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
