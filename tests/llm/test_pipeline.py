"""The stages one by one against plain versions, and the pipeline as a whole."""

from collections import Counter

import pytest
from test_operators import TEXTS, encoded, plain_join, plain_leaks, plain_lines, split_words

import corpus_pipeline

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def docs(spark, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    odd = [(10**6 + (d or 0), t, "en", None, None) for d, t in TEXTS]
    return table.unionByName(spark.createDataFrame(odd, SCHEMA)).cache()


def rows(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_stages_but_the_last_return_documents(spark, docs, sf):
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "language_id", "line_dedup", "ngram_join", "decontamination", "packing"
    ]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == corpus_pipeline.COLUMNS
        assert stage(spark, docs.limit(0), sf).count() == 0


def test_language_stage_keeps_clean_texts(spark, docs, sf):
    kept = dict(rows(corpus_pipeline.language_stage(spark, docs, sf)))
    gone = {d for d, _ in rows(docs)} - set(kept)
    assert gone == {10**6 + d for d in (4, 5, 6, 11)}


def test_line_stage(spark, docs, sf):
    found = corpus_pipeline.line_stage(spark, docs, sf)
    want = plain_lines(rows(docs))
    assert sorted(rows(found)) == sorted((d, t) for (d, t, _, _), n in want.items() for _ in range(n))
    assert found.where("n_chars <> char_length(text)").isEmpty()


def plain_near_duplicates(rows, k=5, percent=80):
    """One row of each component; of rows with its smallest id any, which is why ids are counted."""
    found, kept, empty = [], Counter(), Counter()
    for doc, text in rows:
        words = split_words(text)
        n = min(k, len(words))
        found.append({tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set())
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            both = len(found[a] & found[b])
            named = rows[a][0] is not None and rows[b][0] is not None
            if named and found[a] and 100 * both >= percent * (len(found[a]) + len(found[b]) - both):
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    least = {}
    for (doc, text), g, own in zip(rows, group, found, strict=True):
        if doc is None or not own:
            empty[doc, text] += 1
        else:
            least[g] = min(doc, least.get(g, doc))
    for doc in least.values():
        kept[doc] += 1
    return kept, empty


def test_near_duplicate_stage(spark, docs, sf):
    stays = rows(corpus_pipeline.near_duplicate_stage(spark, docs, sf))
    assert set(stays) <= set(rows(docs))
    kept, empty = plain_near_duplicates(rows(docs))
    assert Counter(d for d, _ in stays) == kept + Counter(d for d, _ in empty.elements())


def test_near_duplicates_among_repeated_rows_and_ids(spark, sf):
    """Copies of a row leave one, and an id that is a copy in one row keeps its other text."""
    same = "one two three four five six seven eight nine ten eleven twelve"
    clean, other = "alpha beta gamma delta epsilon zeta eta theta", "quite another text of its own, here"
    table = [(5, same)] * 3 + [(6, same), (6, clean), (7, clean.upper()), (7, other), (7, other), (5, other)]
    table += [(None, same), (None, same), (8, ""), (8, ""), (9, None)]
    df = spark.createDataFrame([(d, t, "en", str(i), None) for i, (d, t) in enumerate(table)], SCHEMA)
    stays = Counter(rows(corpus_pipeline.near_duplicate_stage(spark, df.repartition(4), sf)))
    assert stays == Counter(
        {(5, same): 1, (6, clean): 1, (5, other): 1, (None, same): 2, (8, ""): 2, (9, None): 1}
    )
    kept, empty = plain_near_duplicates(table)
    assert Counter(d for d, _ in stays.elements()) == kept + Counter(d for d, _ in empty.elements())


def test_decontamination_stage(spark, docs, sf):
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    short = [(d, t) for d, t in rows(docs) if t is None or len(t) < 3000]
    small = docs.where("text IS NULL OR length(text) < 3000")
    kept = {d for d, _ in rows(corpus_pipeline.decontamination_stage(spark, small, sf))}
    assert kept == {d for d, _ in short} - {d for d, _ in plain_leaks(short, items)}


def test_run(spark, sf):
    """The whole pipeline against the plain versions one after the other."""
    pieces = corpus_pipeline.run(spark, sf).collect()
    left = rows(spark.read.parquet(f"{sf}/documents.parquet"))
    left = [(d, t) for d, t in left if t and any(map(str.isalpha, t))]
    left = [(d, t) for (d, t, _, _), n in plain_lines(left).items() for _ in range(n)]
    alone = {d for d, _, least in plain_join(left, 5, 80) if d == least}
    left = [(d, t) for d, t in left if d in alone]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    dirty = {d for d, _ in plain_leaks(left, items)}
    want = {d: len(encoded(t)) for d, t in left if d not in dirty}
    found = {}
    for p in pieces:
        found[p["doc_id"]] = found.get(p["doc_id"], 0) + p["length"]
    assert found == want and dirty
    assert len({p["sequence_id"] for p in pieces}) > 1
