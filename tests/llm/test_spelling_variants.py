"""Spelling variants against all pairs of words."""

import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quietroom.llm import spelling_variants as sv

TEXTS = [
    (1, "Colour colour COLOUR color color coler colou, Überall überall Überall"),
    (2, None),
    (3, ""),
    (None, "colour colour color's naïve naïve naïve naive naive naive Naive"),
    (4, "123 colour-color×÷ straße strasse Straße straße élan élans élans Élans"),
    (5, " ".join(["colour", "colours", "abcde", "abcdf"] * 4)),
    (5, " ".join(["colour", "colours", "abcde", "abcdf"] * 4)),
    (6, "x" * 5000 + " " + "x" * 4999 + " " + "x" * 5000 + " " + "x" * 4999 + "y"),
    (7, "x" * 5000 + " " + "x" * 4999 + " " + "x" * 4999 + "y " + "x" * 4999 + "y 你好你好你"),
    (8, "İstanbul İstanbul İstanbul ſsomething"),
]


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def plain_words(rows):
    found = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 5 and n >= 3}


def plain_variants(counts):
    form, out = {}, {}
    for w, n in counts.items():
        others = [x for x in counts if near(w, x)]
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * n else None
        out[w] = len(others)
    rows = []
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        rows.append((w, form[w], root, n, out[w], counts.get(form[w])))
    return sorted(rows)


def made(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(TEXTS, "doc_id bigint, text string")
    clashes = ["word", "n", "reduced", "near", "form", "root", "other"]
    return df.withColumns({c: F.lit("x") for c in clashes}).repartition(3, "text")


def test_words_and_variants(docs):
    counted = sv.word_counts(docs)
    want = plain_words(TEXTS)
    assert {r["word"]: r["n"] for r in counted.collect()} == want
    assert made(sv.spelling_variants(counted)) == plain_variants(want)


def test_random_words(spark):
    """Few letters, so that words have many near ones, ties and long chains of forms."""
    draw = random.Random(5)
    counts = {}
    for _ in range(700):
        word = "".join(draw.choice("abÿçx") for _ in range(draw.randint(1, 7)))
        counts[word] = draw.choice([3, 3, 5, 6, 12, 24, 50, 100, 250, 1000])
    rows = spark.createDataFrame(list(counts.items()), "word string, n bigint").repartition(3)
    found = made(sv.spelling_variants(rows))
    assert found == plain_variants(counts)
    assert any(form is not None and root != form for _, form, root, *_ in found)


def test_chain_of_forms(spark):
    """Each word's form is the next one; the way to the root is longer than any one step."""
    words = ["a" * i for i in range(1, 40)]
    rows = [(w, 2**i) for i, w in enumerate(words)]
    found = made(sv.spelling_variants(spark.createDataFrame(rows, "word string, n bigint")))
    assert {r[2] for r in found} == {words[-1]}
    assert found == plain_variants(dict(rows))


def test_neighbourhoods_are_whole_and_without_repeats():
    draw = random.Random(3)
    words = ["".join(draw.choice("abcdefghijé") for _ in range(n)) for n in (1, 2, 5, 9)]
    reduced = sv._Reduced(words)
    near_ones, owner = reduced.neighbours()
    letters = {}
    for code in itertools.chain(range(97, 123), range(0xC0, 0x100)):
        letters.setdefault(int(sv._Reduced([chr(code)]).symbol[0]), chr(code))
    assert len(letters) == sv.SYMBOLS
    for i, word in enumerate(words):
        spelled = {word}
        for at in range(len(word) + 1):
            for x in letters.values():
                spelled.add(word[:at] + x + word[at:])
                if at < len(word):
                    spelled.add(word[:at] + x + word[at + 1 :])
            if at < len(word) and len(word) > 1:
                spelled.add(word[:at] + word[at + 1 :])
        want = set(sv._Reduced(sorted(spelled)).hashes().tolist())
        got = near_ones[owner == i].tolist()
        assert len(got) == len(set(got))
        assert want <= set(got)
        assert len(set(got) - want) <= (len(word) == 1)  # the empty word


def test_reduced_words_of_near_words_are_near():
    draw = random.Random(4)
    for _ in range(200):
        word = "".join(draw.choice("abcdefghijklmnopqrstuvwxyzéüß") for _ in range(draw.randint(2, 9)))
        at, x = draw.randrange(len(word)), draw.choice("qé")
        for other in (word[:at] + word[at + 1 :], word[:at] + x + word[at:], word[:at] + x + word[at + 1 :]):
            near_ones, _ = sv._Reduced([word]).neighbours()
            assert sv._Reduced([other]).hashes()[0] in near_ones


def test_long_texts_are_cut_between_runs(monkeypatch):
    text = " ".join("ab" * (i % 13) for i in range(500))
    want = sv.runs(text)
    monkeypatch.setattr(sv, "CHUNK", 7)
    assert sv.runs(text) == want


def test_nothing(spark, docs):
    empty = sv.spelling_variants(sv.word_counts(docs.limit(0)))
    assert empty.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert empty.count() == 0
    odd = spark.createDataFrame([(None, 3), ("", 4), ("abc", None)], "word string, n bigint")
    assert made(sv.spelling_variants(odd)) == [("abc", None, "abc", 0, 0, None)]


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = plain_variants(plain_words(rows))
    found = made(sv.op13_spelling_variants(spark, sf))
    assert found == want and any(r[1] for r in found)
    assert np.mean([r[4] > 0 for r in found]) < 1
