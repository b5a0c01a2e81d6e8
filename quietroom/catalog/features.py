"""Vocabularies, TF-IDF, sequence encoding, pooling, linear contributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quietroom.catalog.base import (
    LABELS,
    query,
    r,
    sql_clean,
    sql_digest,
    sql_number,
    sql_tokens,
    table,
    texts,
)
from quietroom.functions.hashing import digest, digest_number
from quietroom.operators.encode import (
    encode_sequences,
    length_batches,
    padded_to,
    word_ids,
    word_lengths,
)
from quietroom.operators.pooling import pool_groups
from quietroom.operators.tfidf import (
    FittedVocabulary,
    linear_contributions,
    terms_of_tokens,
    tfidf_long,
    with_tokens,
)
from quietroom.operators.vocabulary import (
    prefiltered_vocabulary,
    term_frequencies,
    vocabulary,
)
from quietroom.session import materialize
from quietroom.settings import MAX_FEATURES

_TERMS = (
    "SELECT doc_id, unnest(list_concat(t, list_transform(list_zip(t[:-2], t[2:]), "
    f"lambda p: p[1] || ' ' || p[2]))) AS term FROM (SELECT doc_id, {sql_tokens('text')} AS t FROM documents)"
)
_PER_DOC = f"SELECT doc_id, term, count(*) AS c FROM ({_TERMS}) GROUP BY doc_id, term"
_COUNTS = f"SELECT term, CAST(sum(c) AS BIGINT) AS tf, count(*) AS df FROM ({_PER_DOC}) GROUP BY term"
_VOCAB = (
    "SELECT term, tf, df, CAST(row_number() OVER (ORDER BY tf DESC, term) - 1 AS INTEGER) AS idx "
    f"FROM ({_COUNTS}) QUALIFY idx < {MAX_FEATURES}"
)
_WEIGHED = (
    "SELECT p.doc_id, p.term, v.idx, p.c * (ln((1 + (SELECT count(*) FROM documents))::DOUBLE "
    f"/ (1 + v.df)) + 1) AS w FROM ({_PER_DOC}) p JOIN ({_VOCAB}) v USING (term)"
)
_TFIDF = (
    "SELECT doc_id, term, idx, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS tfidf "
    f"FROM ({_WEIGHED})"
)


@query("term_doc_freq", _COUNTS)
def term_doc_freq(spark, sf):
    return term_frequencies(with_tokens(texts(spark, sf)), F.col("tokens"), pairs=True)


def _tokens(spark, sf):
    """``id, tokens`` of the documents: cut into words once, for the vocabulary and the vectors."""
    return materialize(with_tokens(texts(spark, sf)).select("id", "tokens"), "document-tokens")


@query("top_vocab", _VOCAB)
def top_vocab(spark, sf):
    return vocabulary(with_tokens(texts(spark, sf)), F.col("tokens"), pairs=True)


# Few enough that the sketches of three megabytes of text overflow.
COUNTERS = 150_000


@query("top_vocab_sketched", _VOCAB)
def top_vocab_sketched(spark, sf):
    """The same vocabulary, counting only the terms that sketches of the partitions leave possible."""
    return prefiltered_vocabulary(_tokens(spark, sf), F.col("tokens"), counters=COUNTERS, pairs=True)


@query(
    "tfidf_l2", f"SELECT doc_id AS id, term, round(tfidf, 9) AS tfidf FROM ({_TFIDF})"
)
def tfidf_l2(spark, sf):
    docs = _tokens(spark, sf)
    vocab = FittedVocabulary.fit_tokens(docs)
    return tfidf_long(terms_of_tokens(docs), vocab).withColumn("tfidf", r("tfidf"))


def _sql_coefficient(label: str) -> str:
    return f"(({sql_number(sql_digest(repr('coef'), repr(label), 'term'))} % 201 - 100) / 100.0::DOUBLE)"


_CONTRIBUTIONS = " UNION ALL ".join(
    f"SELECT doc_id, term, idx, '{c}' AS label, tfidf * {_sql_coefficient(c)} AS weight FROM tfidf"
    for c in LABELS
)


@query(
    "linear_contributions",
    f"WITH tfidf AS MATERIALIZED ({_TFIDF}) "
    "SELECT doc_id AS id, label, term AS token, round(weight, 6) AS weight, CAST(rank AS INTEGER) AS rank "
    "FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, label ORDER BY round(abs(weight), 9) DESC, idx) AS rank "
    f"FROM ({_CONTRIBUTIONS}) WHERE weight <> 0) WHERE rank <= 10",
)
def contributions(spark, sf):
    """Top terms under coefficients drawn from each vocabulary term's digest."""
    docs = _tokens(spark, sf)
    vocab = FittedVocabulary.fit_tokens(docs)
    drawn = [
        ((digest_number(digest("coef", c, F.col("term"))) % 201 - 100) / F.lit(100.0)).alias(c)
        for c in LABELS
    ]
    rows = vocab.table(spark).select("idx", *drawn).orderBy("idx").collect()
    coefficients = {c: [row[c] for row in rows] for c in LABELS}
    return linear_contributions(terms_of_tokens(docs), vocab, coefficients).withColumn("weight", r("weight", 6))


# Words of the vocabulary that the query encodes with.
MAX_WORDS = 30_000

_PIECES = (
    r"regexp_extract_all("
    + sql_clean("text")
    + r", '[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]')"
)


@query(
    "encode_sequence",
    f"""
    WITH pieces AS (SELECT doc_id, {_PIECES} AS t FROM documents),
    words AS (SELECT term, row_number() OVER (ORDER BY count(*) DESC, term) + 3 AS token_id
              FROM (SELECT unnest(t) AS term FROM pieces) GROUP BY term
              QUALIFY token_id < {MAX_WORDS} + 4),
    placed AS (SELECT doc_id, unnest(t[1:126]) AS term, unnest(range(len(t[1:126]))) AS pos FROM pieces),
    body AS (SELECT doc_id, string_agg(coalesce(token_id, 1)::VARCHAR, ',' ORDER BY pos) AS ids, count(*) AS n
             FROM placed LEFT JOIN words USING (term) GROUP BY doc_id)
    SELECT doc_id AS id, '2,' || coalesce(ids || ',', '') || '3' || repeat(',0', CAST(126 - coalesce(n, 0) AS INTEGER)) AS ids,
           CAST(2 + coalesce(n, 0) AS INTEGER) AS n_used, 128 AS length, 0 AS type_sum
    FROM pieces LEFT JOIN body USING (doc_id)
    """,
)
def encoded(spark, sf):
    docs = texts(spark, sf)
    rows = encode_sequences(docs, word_ids(docs, MAX_WORDS))

    def total(name: str):
        return F.aggregate(name, F.lit(0), lambda a, x: a + x)

    return rows.select(
        "id",
        F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"),
        total("mask").alias("n_used"),
        F.size("ids").alias("length"),
        total("token_type_ids").alias("type_sum"),
    )


@query(
    "dynamic_padding",
    f"""
    WITH used AS (SELECT doc_id, least(len({_PIECES}) + 2, 128) AS n_used FROM documents),
    numbered AS (SELECT doc_id, n_used, (row_number() OVER (
        ORDER BY (n_used - 1) // 8, {sql_digest('doc_id')}, doc_id) - 1) // 32 AS batch FROM used)
    SELECT doc_id AS id, CAST(n_used AS INTEGER) AS n_used, batch,
           CAST(max(n_used) OVER (PARTITION BY batch) AS INTEGER) AS width FROM numbered
    """,
)
def dynamic_padding(spark, sf):
    """Batches of about equal lengths, each padded to its longest text."""
    return length_batches(word_lengths(texts(spark, sf)))


@query(
    "padding_saved",
    f"""
    WITH used AS (SELECT doc_id, least(len({_PIECES}) + 2, 128) AS n_used FROM documents),
    numbered AS (SELECT n_used, (row_number() OVER (
        ORDER BY (n_used - 1) // 8, {sql_digest('doc_id')}, doc_id) - 1) // 32 AS batch FROM used),
    widths AS (SELECT batch, count(*) AS n, max(n_used) AS width, sum(n_used) AS n_used FROM numbered GROUP BY batch)
    SELECT sum(n)::BIGINT AS n_rows, sum(n * width)::BIGINT AS n_ids, sum(n * width - n_used)::BIGINT AS n_padding,
           sum(n * 128 - n_used) >= sum(n * width - n_used) AS is_less FROM widths
    """,
)
def padding_saved(spark, sf):
    """Encoded texts cut to their batches' widths: no word is lost, and padding shrinks."""
    docs = texts(spark, sf)
    encoded_rows = encode_sequences(docs, word_ids(docs, MAX_WORDS))
    cut = padded_to(encoded_rows, length_batches(word_lengths(docs)))
    used = F.aggregate("mask", F.lit(0), lambda a, x: a + x)
    sizes = cut.select(F.size("ids").cast("bigint").alias("width"), used.cast("bigint").alias("n"))
    padding = F.sum(F.col("width") - F.col("n"))
    return sizes.agg(
        F.count("*").alias("n_rows"),
        F.sum("width").alias("n_ids"),
        padding.alias("n_padding"),
        (F.sum(128 - F.col("n")) >= padding).alias("is_less"),
    )


@query(
    "pool_mean_max",
    """
    WITH cells AS (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS dim FROM embeddings),
    pooled AS (SELECT label, dim, count(*) AS n, avg(x) AS mean, max(x) AS top FROM cells GROUP BY label, dim)
    SELECT label, n, CAST(dim AS INTEGER) AS pos, round(mean, 6) AS value FROM pooled
    UNION ALL SELECT label, n, CAST(dim + (SELECT max(len(embedding)) FROM embeddings) AS INTEGER), round(top, 6) FROM pooled
    """,
)
def pooled_vectors(spark, sf):
    pooled = pool_groups(table(spark, sf, "embeddings"), "label", "embedding")
    return pooled.select("label", "n", F.posexplode("pooled").alias("pos", "value")).withColumn(
        "value", r("value", 6)
    )
