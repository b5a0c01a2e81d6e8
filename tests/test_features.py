import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quietroom.operators.encode import encode_sequences, word_ids
from quietroom.operators.explain import _explain_one, explain, perturb
from quietroom.operators.pooling import pool_counts, pool_groups
from quietroom.operators.tfidf import (
    FittedVocabulary,
    linear_contributions,
    tfidf_long,
    with_terms,
)
from quietroom.operators.vocabulary import most_frequent, term_frequencies
from quietroom.plans.scorers import BatchScorer, lexical_predictor

TEXTS = ["the cat sat on the mat", "the dog", "a cat, a dog; CAT!", "", None, "x"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "id int, comment_text string")


def python_terms(text):
    import re

    words = re.findall(r"\b\w\w+\b", "nan" if text is None else text.lower())
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def test_term_frequencies(docs):
    terms = [python_terms(t) for t in TEXTS]
    tf = Counter(w for t in terms for w in t)
    df = Counter(w for t in terms for w in set(t))
    got = term_frequencies(with_terms(docs), F.col("terms")).collect()
    assert {r["term"]: (r["tf"], r["df"]) for r in got} == {w: (tf[w], df[w]) for w in tf}


@pytest.mark.parametrize("limit", [1, 5, 50, 400, 5000])
def test_most_frequent(spark, limit):
    rng = random.Random(limit)
    rows = [(f"t{i}", int(rng.paretovariate(0.7))) for i in range(1000)]
    counts = spark.createDataFrame(rows, "term string, tf long")
    want = [t for t, _ in sorted(rows, key=lambda e: (-e[1], e[0]))[:limit]]
    got = most_frequent(counts, limit).orderBy("idx").collect()
    assert [r["term"] for r in got] == want
    assert [r["idx"] for r in got] == list(range(len(want)))


def test_tfidf(docs):
    terms = [python_terms(t) for t in TEXTS]
    df = Counter(w for t in terms for w in set(t))
    want = {}
    for i, t in enumerate(terms):
        raw = {w: c * (math.log((1 + len(TEXTS)) / (1 + df[w])) + 1) for w, c in Counter(t).items()}
        norm = math.sqrt(sum(v * v for v in raw.values()))
        want |= {(i, w): v / norm for w, v in raw.items()}
    vocab = FittedVocabulary.fit(with_terms(docs))
    got = {(r["id"], r["term"]): r["tfidf"] for r in tfidf_long(docs, vocab).collect()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)


def test_linear_contributions(docs):
    vocab = FittedVocabulary.fit(with_terms(docs))
    coef = {"a": [(-1) ** i * (i + 1.0) for i in range(len(vocab.terms))], "b": [0.0] * len(vocab.terms)}
    weights = {(r["id"], r["term"]): r["tfidf"] for r in tfidf_long(docs, vocab).collect()}
    got = linear_contributions(docs, vocab, coef, top=3).collect()
    assert {r["label"] for r in got} == {"a"}
    for i in {r["id"] for r in got}:
        mine = {t: v * coef["a"][vocab.terms.index(t)] for (d, t), v in weights.items() if d == i}
        want = sorted(mine, key=lambda t: (-round(abs(mine[t]), 9), vocab.terms.index(t)))[:3]
        rows = sorted((r for r in got if r["id"] == i), key=lambda r: r["rank"])
        assert [r["token"] for r in rows] == want
        assert all(r["weight"] == pytest.approx(mine[r["token"]]) for r in rows)


def test_encode(docs):
    ids = {r["term"]: r["token_id"] for r in word_ids(docs, 6).collect()}
    assert len(ids) == 6 and min(ids.values()) == 4
    rows = {r["id"]: r for r in encode_sequences(docs, word_ids(docs, 6), max_len=6).collect()}
    assert len(rows) == len(TEXTS)
    for r in rows.values():
        assert len(r["ids"]) == len(r["mask"]) == len(r["token_type_ids"]) == 6
        assert sum(r["mask"]) == sum(1 for v in r["ids"] if v != 0)
    assert rows[0]["ids"] == [2, *[ids.get(w, 1) for w in "the cat sat on".split()], 3]
    assert rows[3]["ids"] == [2, 3, 0, 0, 0, 0]
    assert rows[1]["ids"][:4] == [2, ids.get("the", 1), ids.get("dog", 1), 3]


def test_pool_groups_with_hot_group(spark):
    rng = np.random.default_rng(0)
    rows = [(int(g), rng.normal(size=4).tolist()) for g in rng.choice([0, 1, 2], 900, p=[0.8, 0.1, 0.1])]
    df = spark.createDataFrame(rows, "g int, v array<double>").repartition(4)
    for r in pool_groups(df, "g", "v").collect():
        m = np.array([v for g, v in rows if g == r["g"]])
        assert np.allclose(r["pooled"], np.concatenate([m.mean(0), m.max(0)]))


def test_pool_counts(spark):
    table = np.arange(12, dtype=np.float32).reshape(4, 3)
    shared = spark.sparkContext.broadcast(table)
    df = spark.createDataFrame([([0, 3], [1.0, 3.0]), ([], [])], "i array<int>, c array<double>")
    got = [r[0] for r in df.select(pool_counts(shared, F.col("i"), F.col("c"))).collect()]
    assert np.allclose(got[0], [*((table[0] + 3 * table[3]) / 4), *table[3]])
    assert got[1] == [0.0] * 6


def test_perturb(docs):
    rows = perturb(docs, samples=40).collect()
    assert len(rows) == 40 * len(TEXTS)
    mine = [r for r in rows if r["id"] == 0]
    assert next(r for r in mine if r["sample"] == 0)["comment_text"] == TEXTS[0]
    words = set(TEXTS[0].split())
    sizes = set()
    for r in mine:
        left = r["comment_text"].split()
        assert set(left) <= words
        assert left.count("the") in (0, 2)
        sizes.add(len(set(left)))
    assert sizes == {0, 1, 2, 3, 4, 5}
    again = perturb(docs.repartition(3), samples=40).collect()
    key = lambda r: (r["id"], r["sample"])
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, again), key=str)
    assert len({key(r) for r in rows}) == len(rows)


def ridge_reference(x, y, w, alpha):
    """Weighted ridge with a free intercept, as one augmented least-squares problem."""
    n, d = x.shape
    a = np.hstack([np.ones((n, 1)), x])
    penalty = alpha * np.diag([0.0] + [1.0] * d)
    return np.linalg.solve(a.T @ (a * w[:, None]) + penalty, a.T @ (w * y))[1:]


def test_solver_matches_primal_ridge():
    rng = np.random.default_rng(3)
    mask = (rng.random((100, 30)) > 0.4).astype(float)
    mask[0] = 1
    probs = 1 / (1 + np.exp(-(mask[:, :5] @ np.array([3, -2, 1, 0.5, 0.2]) - 1)))[:, None]
    kept = mask.sum(1)
    w = np.sqrt(np.exp(-(((1 - np.sqrt(kept / 30)) * 100) ** 2) / 25**2))
    first = ridge_reference(mask, probs[:, 0], w, 0.01)
    chosen = np.argsort(-np.abs(first), kind="stable")[:10]
    second = ridge_reference(mask[:, chosen], probs[:, 0], w, 1.0)
    where, weights = next(_explain_one(mask, probs, 10))
    assert set(where) == set(chosen)
    assert np.allclose(dict(zip(where, weights))[where[0]], dict(zip(chosen, second))[where[0]])
    assert where[0] == 0 and list(np.abs(weights)) == sorted(np.abs(weights), reverse=True)


def test_explain_finds_the_word(spark):
    rows = [(1, "you are a huge idiot my friend"), (2, "nice day"), (3, " !! ")]
    df = spark.createDataFrame(rows, "id int, comment_text string")
    scorer = BatchScorer(["toxic", "nice"], lexical_predictor({"toxic": ["idiot"], "nice": ["nice"]}))
    got = explain(df, scorer, samples=60).collect()
    top = {(r["id"], r["label"]): r["token"] for r in got if r["rank"] == 1 and abs(r["weight"]) > 1e-6}
    assert top == {(1, "toxic"): "idiot", (2, "nice"): "nice"}
    assert {r["id"] for r in got} == {1, 2}
    assert max(r["rank"] for r in got if r["id"] == 2) == 2
