import math

import pytest
from pyspark.sql import functions as F

from quietroom.functions import scores as S
from quietroom.functions import text as T
from quietroom.functions.noise import adjacent_swap, fixed_swap, random_swaps
from quietroom.operators.reshape import validate_requests
from quietroom.operators.robustness import with_length
from quietroom.settings import threshold_grid


def values(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def test_clean_text(spark):
    texts = ["  Hello\nWORLD \t x ", "You!! @me", None, "a\u00a0b\x1cc", "", "ÉCOLE"]
    got = values(spark, [(t,) for t in texts], "t string", T.clean_text(F.col("t")))
    assert [g[0] for g in got] == ["hello world x", "you!! @me", "nan", "a b c", "", "école"]


def test_word_count_and_buckets(spark):
    texts = ["", "   ", "a  b", *[" ".join(["w"] * n) for n in (19, 20, 100, 101)]]
    df = spark.createDataFrame([(t,) for t in texts], "comment_text string")
    got = [(r["n_words"], r["bucket"]) for r in with_length(df).collect()]
    assert got == [
        (0, "short"),
        (0, "short"),
        (2, "short"),
        (19, "short"),
        (20, "mid"),
        (100, "mid"),
        (101, "long"),
    ]


def test_tokens_and_ngrams(spark):
    rows = [("a bb_1 cc é éé",), ("x",), ("",)]
    got = values(spark, rows, "t string", T.ngrams(T.word_tokens(F.col("t"))))
    assert got[0][0] == ["bb_1", "cc", "éé", "bb_1 cc", "cc éé"]
    assert got[1][0] == [] and got[2][0] == []


def test_label_strings(spark):
    rows = [(["toxic", "insult"],), ([],)]
    joined = T.pipe_join(F.col("l"))
    got = values(spark, rows, "l array<string>", joined, T.pipe_split(joined), T.flags_text(F.col("l")))
    assert got == [
        ("toxic|insult", ["toxic", "insult"], "toxic, insult"),
        ("", [], ""),
    ]


def test_grid_is_the_double_range():
    grid = threshold_grid()
    assert len(grid) == 17 and grid[0] == 0.1 and grid[-1] == 0.9000000000000002


def test_decisions(spark):
    labels = ["toxic", "insult"]
    rows = [([0.5, 0.2],), ([0.9, 0.9],), ([0.1, 0.2],)]
    p = F.col("p")
    flags = S.flag_list(labels, p, {"insult": 0.2})
    got = values(
        spark, rows, "p array<double>", flags, S.any_over_half(p), S.verdict(flags),
        S.map_get(S.scores_map(labels, p), "threat", 0.0), S.predictions_array(labels, p),
    )
    assert got[0] == (["toxic", "insult"], False, "toxic", 0.0, [1, 0])
    assert got[1] == (["toxic", "insult"], True, "toxic", 0.0, [1, 1])
    assert got[2][0] == ["insult"]


def test_sigmoid_and_loss(spark):
    rows = [(0.0, 1), (30.0, 0), (-800.0, 1)]
    x, y = F.col("x"), F.col("y")
    got = values(spark, rows, "x double, y int", S.sigmoid(x), S.bce_with_logits(x, y, 2.0))
    assert got[0][0] == 0.5 and got[0][1] == pytest.approx(2 * math.log(2))
    assert got[1][1] == pytest.approx(30.0)
    assert got[2][1] == pytest.approx(1600.0)


def test_fixed_swap(spark):
    got = values(spark, [("abcd",), ("abc",), ("abcdef",), ("",)], "t string", fixed_swap(F.col("t")))
    assert [g[0] for g in got] == ["abdc", "abc", "abdcef", ""]


def test_adjacent_swap(spark):
    rows = [(i, t) for i, t in enumerate(["", "a", "ab", "abcdefgh", "été😀x"])]
    got = values(spark, rows, "id int, t string", adjacent_swap(F.col("t"), F.col("id")))
    for (_, before), (after,) in zip(rows, got):
        assert sorted(before) == sorted(after)
        moved = [i for i, (a, b) in enumerate(zip(before, after)) if a != b]
        assert moved in ([], [moved[0], moved[0] + 1] if moved else [])
    assert got[2][0] == "ba"


def test_random_swaps(spark):
    rows = [(1, ""), (2, "a"), (3, "abcdefghi"), (4, "abcdefghij" * 20), (5, None)]
    df = spark.createDataFrame(rows, "id int, t string")
    noisy = random_swaps(F.col("t"), F.col("id"))
    one = {r[0]: r[1] for r in df.repartition(1).select("id", noisy).collect()}
    many = {r[0]: r[1] for r in df.repartition(4).select("id", noisy).collect()}
    assert one == many
    assert (one[1], one[2], one[3], one[5]) == ("", "a", "abcdefghi", None)
    assert sorted(one[4]) == sorted(rows[3][1]) and one[4] != rows[3][1]


def test_validation(spark):
    df = spark.createDataFrame([("hi",), ("",), ("  \n",), (None,)], "text string")
    plain = [r["reason"] is None for r in validate_requests(df).collect()]
    strict = [r["reason"] is None for r in validate_requests(df, strict=True).collect()]
    assert plain == [True, False, True, False]
    assert strict == [True, False, False, False]


def test_noise_holds_few_code_points_at_once(monkeypatch):
    import numpy as np
    import pandas as pd

    from quietroom.functions import noise

    draw = np.random.default_rng(3)
    texts = pd.Series([None if i % 17 == 0 else "aä😀 " * int(draw.integers(0, 60)) for i in range(500)], dtype=object)
    keys = pd.Series(draw.integers(-(2**62), 2**62, 500))
    whole = noise._swap_batch(texts, keys, 0.1, 10**9)
    held, one = [], noise._swap_texts
    monkeypatch.setattr(noise, "_swap_texts", lambda t, k, level: held.append(t.str.len().sum()) or one(t, k, level))
    found = noise._swap_batch(texts, keys, 0.1, 1000)
    assert found.equals(whole) and max(held) <= 1000 and len(held) > 20
    assert noise._swap_batch(texts[:0], keys[:0], 0.1).empty
    assert noise._swap_batch(pd.Series([None, None]), keys[:2], 0.1).isna().all()
