"""Fitted models: candidates, optimality, vectors by join, saving, comparison; split CSV; sketches."""

import csv
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quietroom.catalog.base import parts
from quietroom.operators.encode import encode_sequences, length_batches, padded_to, word_ids, word_lengths
from quietroom.operators.explain import explain, fidelity, scored_variants
from quietroom.operators.pooling import pool_counts, pool_terms
from quietroom.operators.tfidf import with_terms, with_tokens
from quietroom.operators.vocabulary import (
    _counted,
    _pieces,
    frequent_sketch,
    prefiltered_vocabulary,
    vocabulary,
)
from quietroom.plans.compare import measured
from quietroom.plans.scorers import BatchScorer, DigestScorer, TfidfScorer, lexical_predictor, load
from quietroom.plans.train import fit_candidates
from quietroom.session import shared_root, work_path
from quietroom.sources.comments import read_comments_csv, read_csv_rows
from quietroom.sources.records import csv_records, _lines, split_states
from quietroom.streaming.jobs import read_batches, request_stream, start_measured

LABELS = ["toxic", "quality"]


@pytest.fixture(scope="module")
def rows(spark, sf):
    return parts(spark, sf).cache()


# --- split CSV --------------------------------------------------------------------

TEXTS = [
    "plain", 'He said ""hi""', "two\nlines", "\n\nbreaks\r\nonly\n", "", "comma, and\nbreak", 'x" , "y', " spaces ",
    "a\r", "é\n" * 50, "long " * 400, "q\"\n\"\n\"",
]


def write_csv(path, n, newline="\n"):
    with open(path, "w", newline="", encoding="utf-8") as file:
        out = csv.writer(file, quoting=csv.QUOTE_ALL, lineterminator=newline)
        out.writerow(["id", "comment_text", "toxic"])
        for i in range(n):
            out.writerow([i, TEXTS[i % len(TEXTS)], i % 2])
            if i % 7 == 0:
                file.write(newline)  # a blank line between records
    return str(path)


def in_splits(spark, size):
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)


@pytest.fixture
def small_splits(spark):
    keys = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    before = {k: spark.conf.get(k) for k in keys}
    in_splits(spark, 2500)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("newline", ["\n", "\r\n"])
def test_one_file_in_many_splits(spark, tmp_path, small_splits, newline):
    path = write_csv(tmp_path / "train.csv", 240, newline)
    split = read_csv_rows(spark, path, ["toxic"], split_files=True)
    lines = _lines(spark, path)
    assert lines.rdd.getNumPartitions() > 8
    states = split_states(lines).collect()
    assert len(states) > 8 and {s["inside"] for s in states} == {0, 1}
    got = sorted((int(r["id"]), r["comment_text"], r["toxic"], r["reason"]) for r in split.collect())
    # An empty quoted field is NULL, as for the reader of whole files.
    assert got == [(i, TEXTS[i % len(TEXTS)] or None, i % 2, None) for i in range(240)]
    if newline == "\n":  # in the other case the reader of whole files changes line breaks in texts
        whole = read_csv_rows(spark, path, ["toxic"]).collect()
        assert got == sorted((int(r["id"]), r["comment_text"], r["toxic"], r["reason"]) for r in whole)


def test_split_states_by_shuffle(spark, tmp_path, small_splits):
    """Too many splits for a broadcast: lines are shuffled to their split's state."""
    path = write_csv(tmp_path / "train.csv", 120)
    want = sorted(map(tuple, csv_records(spark, path).collect()))
    assert sorted(map(tuple, csv_records(spark, path, max_broadcast=0).collect())) == want
    assert len(want) == 121 and [h for _, h in want].count(True) == 1


def test_records_over_many_splits(spark, tmp_path, small_splits):
    """One text reaches over several splits, and one quote is never closed."""
    path = tmp_path / "long.csv"
    long = "line\n" * 1000
    path.write_text(f'id,comment_text\n1,"{long}"\n2,b\n3,"open\nend')
    got = {r["id"]: r["comment_text"] for r in read_csv_rows(spark, str(path), split_files=True).collect()}
    assert got["1"] == long and got["2"] == "b" and got["3"].startswith("open")


def test_several_files_bad_rows_and_headers(spark, tmp_path):
    folder = tmp_path / "files"
    folder.mkdir()
    (folder / "a.csv").write_text('id,comment_text,toxic\n1,"x\ny",1\n2,z\n')
    (folder / "b.csv").write_text('id,comment_text,toxic\r\n3,"x",yes\r\n4,w,0.0\r\n')
    got = read_csv_rows(spark, str(folder), ["toxic"], split_files=True).orderBy("id").collect()
    assert [(r["id"], r["comment_text"], r["toxic"], r["reason"]) for r in got] == [
        ("1", "x\ny", 1, None), ("2", "z", None, "malformed"),
        ("3", "x", None, "label:toxic"), ("4", "w", 0, None),
    ]
    kept = read_comments_csv(spark, str(folder), ["toxic"], split_files=True)
    assert sorted(r["id"] for r in kept.collect()) == ["1", "4"]
    (folder / "c.csv").write_text("id,toxic,comment_text\n5,1,q\n")
    with pytest.raises(Exception, match="header does not conform"):
        read_csv_rows(spark, str(folder), ["toxic"], split_files=True).collect()


# --- candidates and optimality -----------------------------------------------------


def test_candidates(spark, rows):
    train, val = rows.where("split = 'train'"), rows.where("split = 'val'")
    penalties = {"a": 5.0, "b": 0.5, "c": 0.5}
    found = fit_candidates(train, val, LABELS, penalties, max_features=500)
    losses = {r["candidate"]: r["val_loss"] for r in found.losses.collect()}
    # The loss by the definition, from each scorer's own probabilities.
    counts = train.agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in LABELS]).first()
    weights = [(counts["n"] - counts[c]) / (counts[c] + 1e-6) for c in LABELS]
    for name, scorer in found.scorers.items():
        scored = scorer.scored(val).collect()
        p, y = (np.array([r[c] for r in scored], float) for c in ("prob", "y"))
        loss = -(np.array(weights) * y * np.log(p) + (1 - y) * np.log(1 - p)).mean()
        assert losses[name] == pytest.approx(loss, rel=1e-9)
    path = f"{shared_root(spark)}/best"
    name = found.keep_best(spark, path)
    assert losses[name] == min(losses.values())
    again = load(spark, path)
    assert again.coefficients() == found.scorers[name].coefficients()


def test_no_validation_rows_keep_nothing(spark, rows):
    train = rows.where("split = 'train'")
    found = fit_candidates(train, train.limit(0), LABELS, {"a": 1.0}, max_features=50, max_iter=2)
    assert found.keep_best(spark, f"{shared_root(spark)}/none") is None


def test_gradients_are_those_of_the_objective(spark, rows):
    """Few iterations leave gradients far from zero; numpy computes the same ones."""
    train = rows.where("split = 'train'").cache()
    scorer = TfidfScorer.fit(train, LABELS, max_features=300, max_iter=3)
    found = {r["label"]: r for r in scorer.optimality(train).collect()}
    vectors = scorer.features.transform(
        train.withColumn("terms", F.lit(None).cast("array<string>")).limit(0)
    ).columns
    assert "features" in vectors
    from quietroom.operators.tfidf import with_terms

    table = scorer.features.transform(with_terms(train, "comment_text")).collect()
    x = np.array([r["features"].toArray() for r in table])
    for i, label in enumerate(LABELS):
        y = np.array([r[label] for r in table], float)
        n, pos = len(y), y.sum()
        w = np.where(y == 1, n / (2 * pos), n / (2 * (n - pos)))
        beta, b = np.array(scorer.coefficients()[label]), scorer.intercepts()[i]
        rest = w * (1 / (1 + np.exp(-(x @ beta + b))) - y)
        gradient = x.T @ rest / w.sum() + beta / n
        row = found[label]
        assert row["n_features"] == 300
        assert row["max_gradient"] == pytest.approx(np.abs(gradient).max(), rel=1e-6)
        assert row["gap"] == pytest.approx((gradient**2).sum() * n / 2, rel=1e-6)
        assert row["intercept_gradient"] == pytest.approx(rest.sum() / w.sum(), abs=1e-9)
    better = TfidfScorer.fit(train, LABELS, max_features=300, max_iter=100).optimality(train).collect()
    assert all(r["max_gradient"] < found[r["label"]]["max_gradient"] / 10 for r in better)


# --- pooling -----------------------------------------------------------------------


def test_pooling_by_join_sends_a_vector_once_a_block(spark):
    from quietroom.operators.pooling import block_vectors

    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(60)]
    vectors = rng.normal(size=(60, 3)).astype(np.float32)
    texts = [(i, [words[j] for j in rng.integers(0, 60, rng.integers(0, 50))]) for i in range(400)]
    texts += [(7, ["w1", "w1", "none"]), (None, ["w2"]), (1000, None)]
    tokens = spark.createDataFrame(texts, "id bigint, terms array<string>")
    table = spark.createDataFrame(
        list(zip(words, vectors.tolist(), strict=True)) + [("w3", [9.0, 9.0, 9.0])],
        "term string, vector array<float>",
    )
    placed = tokens.withColumn("_block", F.col("id") % 2).where("id IS NOT NULL")
    assert block_vectors(placed, table).count() <= 2 * 61
    assert block_vectors(placed, table).count() < placed.select(F.explode("terms")).count() / 50

    table_of = {w: [v] for w, v in zip(words, vectors, strict=True)}
    table_of["w3"].append(np.array([9.0, 9.0, 9.0]))
    merged: dict = {}
    for key, terms in texts:
        merged.setdefault(key, []).extend(v for w in terms or [] for v in table_of.get(w, []))
    got = pool_terms(tokens, table, "id", 6, block_texts=100).collect()
    assert sorted(str(r["id"]) for r in got) == sorted(str(key) for key, _ in texts)
    for row in got:
        held = np.array(merged[row["id"]]) if row["id"] is not None else []
        want = np.concatenate([held.mean(0), held.max(0)]) if len(held) else np.zeros(6)
        assert np.allclose(row["pooled"], want)


def test_pooling_by_join_and_by_broadcast(spark):
    vectors = {"a": [1.0, -2.0], "b": [3.0, 0.5], "c": [-1.0, -1.0]}
    texts = [(1, ["a", "b", "a"]), (2, []), (3, ["zzz"]), (4, ["c"]), (5, None), (6, ["c", "zzz", "c", "b"])]
    tokens = spark.createDataFrame(texts, "id bigint, terms array<string>")
    table = spark.createDataFrame(list(vectors.items()), "term string, vector array<float>")
    got = {r["id"]: r["pooled"] for r in pool_terms(tokens, table, "id", 4).collect()}
    want = {}
    for i, terms in texts:
        known = np.array([vectors[t] for t in terms or [] if t in vectors])
        want[i] = [*known.mean(axis=0), *known.max(axis=0)] if len(known) else [0.0] * 4
    assert {i: pytest.approx(v) for i, v in want.items()} == got
    shared = spark.sparkContext.broadcast(np.array(list(vectors.values()), np.float32))
    counts = [(1, [0, 1], [2.0, 1.0]), (2, [], []), (4, [2], [1.0]), (5, None, None), (6, [1, 2], [1.0, 2.0])]
    df = spark.createDataFrame(counts, "id bigint, i array<int>, c array<double>")
    found = df.select("id", pool_counts(shared, F.col("i"), F.col("c")).alias("p")).collect()
    assert {r["id"]: pytest.approx(want[r["id"]]) for r in found} == {r["id"]: list(r["p"]) for r in found}


# --- portable tier 3, comparison ---------------------------------------------------


def test_batch_scorer_saved(spark, rows):
    scorer = BatchScorer(LABELS, lexical_predictor({"toxic": ["the"], "quality": ["of"]}), batch_size=7)
    path = f"{shared_root(spark)}/lexical"
    scorer.save(spark, path)
    again = load(spark, path)
    assert (again.labels, again.batch_size, again.clean) == (LABELS, 7, True)
    one, two = ({r["id"]: r["prob"] for r in s.scored(rows).collect()} for s in (scorer, again))
    assert one == two and any(p[0] > 0 for p in one.values())


def test_batch_scorer_of_the_wrong_width(spark, rows):
    scorer = BatchScorer(LABELS, lexical_predictor({"toxic": ["the"]}))
    with pytest.raises(Exception, match="expected 2 scores per text"):
        scorer.scored(rows).collect()


def test_measured(spark, rows):
    held = rows.where("split <> 'train'")
    scorers = {
        "lexical": BatchScorer(LABELS, lexical_predictor({"toxic": ["the"], "quality": ["of"]})),
        "digest": DigestScorer(LABELS),
    }
    found = {r["model"]: r for r in measured(scorers, held).collect()}
    assert set(found) == set(scorers)
    for r in found.values():
        assert r["n_rows"] == held.count() and r["latency_ms"] > 0 and 0 < r["size_mb"] < 1
        assert 0 <= r["f1_score"] <= 1 and 0 <= r["recall_safety"] <= 1
    assert min(r["latency_ratio"] for r in found.values()) == 1


# --- sketches, padding, explanations, streams --------------------------------------


@pytest.mark.parametrize("counters", [4, 30, 1000])
def test_sketch_bounds_and_vocabulary(spark, counters):
    draw = np.random.default_rng(8)
    lists = [[f"t{int(x)}" for x in draw.zipf(1.3, 40) if x < 5000] for _ in range(400)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "id int, terms array<string>").repartition(5)
    sketch, error = frequent_sketch(df, F.col("terms"), counters)
    low = {r["term"]: r["low"] for r in sketch.collect()}
    counts = {}
    for terms in lists:
        for t in terms:
            counts[t] = counts.get(t, 0) + 1
    assert all(low.get(t, 0) <= n <= low.get(t, 0) + error for t, n in counts.items())
    assert (error > 0) == (counters < 1000)
    assert error <= sum(counts.values()) / counters
    for limit in (1, 5, 50, 10_000):
        got = prefiltered_vocabulary(df, F.col("terms"), limit, counters).orderBy("idx").collect()
        assert got == vocabulary(df, F.col("terms"), limit).orderBy("idx").collect()


def test_pieces_of_batches():
    lists = pa.array([["a"] * 3, None, [], ["b"] * 9, ["c"] * 2, ["d"] * 3, ["e"]])
    pieces = list(_pieces(lists, 5))
    assert pa.concat_arrays(pieces).equals(lists)
    assert [[len(x or []) for x in p.to_pylist()] for p in pieces] == [[3, 0, 0], [9], [2, 3], [1]]


@pytest.mark.parametrize("pairs", [False, True])
def test_counted(pairs):
    draw = np.random.default_rng(5)
    rows = [[f"w{x}" for x in draw.zipf(1.5, n) if x < 99] for n in draw.integers(0, 40, 60)]
    rows[3:5] = None, [None, "w1", None, "w1", "w1", None]
    tf, df = Counter(), Counter()
    for words in rows:
        both = zip(words or [], (words or [])[1:]) if pairs else []
        terms = [*(words or []), *(None if None in p else " ".join(p) for p in both)]
        tf.update(terms)
        df.update(set(terms))
    (found,) = _counted(pa.array(rows), pairs)
    sums = {t: [0, 0] for t in found.column("term").to_pylist()}
    for t, n, d in zip(*found.to_pydict().values(), strict=True):
        sums[t][0] += n
        sums[t][1] += d
    assert sums == {t: [tf[t], df[t]] for t in tf}
    assert not list(_counted(pa.array([None, []], pa.list_(pa.string())), pairs))


@pytest.mark.parametrize("counters", [20, 2000])
def test_vocabulary_of_tokens(spark, comments, counters):
    """N-grams counted from the words are those counted from the texts' arrays of n-grams."""
    rows = comments.select("id", "comment_text")
    want = vocabulary(with_terms(rows), F.col("terms"), 300).orderBy("idx").collect()
    tokens = with_tokens(rows)
    assert vocabulary(tokens, F.col("tokens"), 300, pairs=True).orderBy("idx").collect() == want
    got = prefiltered_vocabulary(tokens, F.col("tokens"), 300, counters, pairs=True)
    assert got.orderBy("idx").collect() == want


def test_sketch_of_nothing(spark):
    df = spark.createDataFrame([(1, None), (2, [])], "id int, terms array<string>")
    assert prefiltered_vocabulary(df, F.col("terms"), 5).count() == 0


def test_length_batches(spark):
    texts = [(i, "word " * (i % 23)) for i in range(100)] + [(200, None), (201, "x " * 500)]
    df = spark.createDataFrame(texts, "id bigint, comment_text string")
    encoded = encode_sequences(df, word_ids(df, 10), max_len=32)
    lengths = word_lengths(df, max_len=32)
    used = {r["id"]: sum(r["mask"]) for r in encoded.collect()}
    assert {r["id"]: r["n_used"] for r in lengths.collect()} == used
    batches = length_batches(lengths, batch_size=8, class_width=4)
    by_batch = {}
    for r in batches.collect():
        by_batch.setdefault(r["batch"], []).append((r["n_used"], r["width"]))
    assert sorted(map(len, by_batch.values())) == [6, *[8] * 12]
    assert all({w for _, w in b} == {max(n for n, _ in b)} for b in by_batch.values())
    cut = padded_to(encoded, batches).collect()
    assert all(len(r["ids"]) == len(r["mask"]) and sum(r["mask"]) == used[r["id"]] for r in cut)
    assert sum(len(r["ids"]) for r in cut) < 32 * len(texts)


def test_fidelity(spark):
    texts = [(1, "the the of worthless idea"), (2, ""), (3, None), (4, "one"), (5, "of a b c d e f g h i j k")]
    df = spark.createDataFrame(texts, "id bigint, comment_text string")
    scorer = BatchScorer(LABELS, lexical_predictor({"toxic": ["worthless", "the"], "quality": ["of"]}))
    found = explain(df, scorer).cache()
    checked = fidelity(found, df, scorer).collect()
    assert {(r["id"], r["label"]) for r in checked} == {(i, c) for i in (1, 4, 5) for c in LABELS}
    assert all(r["slope"] < 1e-9 for r in checked)
    assert max(r["r2"] for r in checked if r["r2"] is not None) > 0.9
    assert any(r["r2"] is None for r in checked)  # "one": scores don't vary
    # Other weights than the fitted ones are noticed.
    wrong = fidelity(found.withColumn("weight", F.col("weight") + 0.05), df, scorer).collect()
    assert all(r["slope"] > 1e-3 for r in wrong)


def test_measured_stream(spark):
    texts = [(i, ["the end", "", None, "fine"][i % 4]) for i in range(40)]
    df = spark.createDataFrame(texts, "id bigint, text string")
    folder, out = work_path(spark, "in"), work_path(spark, "out")
    df.repartition(3).write.parquet(folder)
    scorer = BatchScorer(LABELS, lexical_predictor({"toxic": ["the"], "quality": ["of"]}))
    for _ in range(2):  # the second run finds nothing new
        live = request_stream(spark, folder, df.schema, files_per_trigger=1)
        start_measured(live, scorer, out, f"{out}-mark").awaitTermination()
    batches = read_batches(spark, out).collect()
    assert len(batches) == 3
    total = {c: sum(b[c] for b in batches) for c in ("n_rows", "accepted", "rejected", "flagged")}
    assert total == {"n_rows": 40, "accepted": 20, "rejected": 20, "flagged": 10}
    answers = spark.read.parquet(f"{out}/answers")
    assert answers.where("reason IS NULL AND scores IS NULL").isEmpty()
    assert answers.where("reason IS NOT NULL AND scores IS NOT NULL").isEmpty()


def test_word2vec_tasks_stay_as_long_whatever_the_input(spark):
    from quietroom.plans.scorers import _w2v_partitions

    df = spark.createDataFrame([(["a"] * 10,)] * 100 + [([],)], "terms array<string>")
    assert [_w2v_partitions(df, 8, words) for words in (10_000, 125, 100, 7)] == [8, 8, 10, 143]
    assert _w2v_partitions(df.where("false"), 8) == 8


def test_token_text_has_the_words_of_the_cleaned_text(spark):
    from quietroom.functions.text import clean_text, token_text, word_tokens

    texts = ["a bc  De f\x1cgh\x85ij_k ", " \tÀÉ ß́x İSTANBUL 　漢字 12 x", "", " ", None, "nan", "\U0001d400\U0001d401 ok"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for row in df.select(word_tokens(clean_text(F.col("t"))).alias("a"), word_tokens(token_text(F.col("t"))).alias("b")).collect():
        assert row["a"] == row["b"]


def test_variants_are_made_in_tasks_by_number_of_comments(spark):
    """Comments of one file are dealt before their variants are made; these are not shuffled."""
    texts = [(i % 440, "the the of worthless idea" if i % 9 else "") for i in range(450)]  # keys repeat
    df = spark.createDataFrame(texts, "id bigint, comment_text string").coalesce(1)
    scorer = DigestScorer(LABELS)
    found = explain(df, scorer, samples=20)
    plan = found._jdf.queryExecution().toString()
    plan = plan[plan.index("== Physical Plan ==") :]
    assert plan.count("Exchange") == 1 and plan.index("Generate explode(") < plan.index("Exchange")
    variants = scored_variants(df, scorer, samples=20)
    assert variants.rdd.getNumPartitions() == 2
    rows = lambda x: sorted(map(tuple, x.collect()))
    assert rows(explain(df, scorer, samples=20, variants=variants.cache())) == rows(found)


def test_fidelity_reads_the_variants_that_were_explained(spark, sf, monkeypatch):
    from quietroom.catalog import models

    calls = []

    class Counted(BatchScorer):
        def score(self, df, text="comment_text"):
            calls.append(text)
            return super().score(df, text)

    scorer = Counted(LABELS, lexical_predictor(models.LEXICONS))
    monkeypatch.setattr(models, "fitted", lambda *_: scorer)
    rows = models.explanation_fidelity(spark, sf).collect()
    assert len(calls) == 1
    assert {r["label"]: r["n_explained"] == r["n_fitted"] > 0 for r in rows} == {c: True for c in LABELS}
