"""Language identification against a plain version: grams, frequencies, centroids, nearest cosine."""

import zlib
from collections import Counter

import numpy as np
import pytest

from quietroom.llm import language_id


def plain_counts(text):
    """Buckets of the 1- to 3-grams of lower-cased bytes, runs of other bytes being one space."""
    codes, after_letter = [32], False
    for byte in (text or "").lower().encode():
        letter = 97 <= byte <= 122 or byte >= 128
        if letter or after_letter:
            codes.append(byte if letter else 32)
        after_letter = letter
    counts = Counter()
    for n in (1, 2, 3):
        for i in range(len(codes) - n + 1):
            gram = codes[i : i + n]
            if gram != [32] * n:
                value = 0
                for code in gram:
                    value = value * 257 + code
                hashed = (value + n) * int(language_id._MULTIPLIERS[n - 1]) % 2**64
                counts[(hashed >> 16) % language_id.DIMENSIONS] += 1
    return counts


def plain_vector(counts, idf):
    vector = np.zeros(language_id.DIMENSIONS)
    for bucket, n in counts.items():
        vector[bucket] = np.log1p(n) * idf[bucket]
    norm = np.sqrt((vector**2).sum())
    return vector / norm if norm else vector


def plain_centroids(vectors, clusters, iterations):
    """Starts: the row nearest to the mean, then each the row least near to those chosen."""
    mean = sum(vectors) / len(vectors)
    chosen = [max(range(len(vectors)), key=lambda i: (vectors[i] @ mean, -i))]
    while len(chosen) < min(clusters, len(vectors)):
        nearest = [max(v @ vectors[c] for c in chosen) for v in vectors]
        chosen.append(min(range(len(vectors)), key=lambda i: (nearest[i], i)))
    centroids = [vectors[c] for c in chosen]
    for _ in range(iterations):
        members = [[] for _ in centroids]
        for v in vectors:
            near = [v @ c for c in centroids]
            members[near.index(max(near))].append(v)
        for k, own in enumerate(members):
            if own:
                total = sum(own) / len(own)
                centroids[k] = total / np.sqrt((total**2).sum())
    return centroids


@pytest.fixture(scope="module")
def plain(spark, sf):
    table = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select(
        "doc_id", "text", "lang").collect()]
    train = [
        r for r in table if r[2] is not None and zlib.crc32(str(r[0]).encode()) % 3 != 1
    ]
    counts = {(d, t): plain_counts(t) for d, t, _ in table}
    held = Counter(b for d, t, _ in train for b in counts[d, t])
    idf = [np.log((1 + len(train)) / (1 + held[b])) + 1 for b in range(language_id.DIMENSIONS)]
    vectors = {key: plain_vector(c, idf) for key, c in counts.items()}
    return table, train, idf, vectors


def test_frequencies_and_centroids(spark, sf, plain):
    _, train, idf, vectors = plain
    model = language_id.fit(spark.read.parquet(f"{sf}/documents.parquet"))
    assert np.allclose(model.idf, idf, rtol=1e-6)
    for lang in sorted({lang for _, _, lang in train}):
        own = sorted((d, t) for d, t, known in train if known == lang)
        want = plain_centroids(
            [vectors[key] for key in own if vectors[key].any()],
            language_id.CLUSTERS, language_id.ITERATIONS,
        )
        found = [c for c, name in zip(model.centroids, model.languages, strict=True) if name == lang]
        assert len(found) == len(want)
        for c in want:
            assert max(float(c @ f) for f in found) > 1 - 1e-4


def test_predictions_are_the_nearest_centroid(spark, sf, plain):
    table, _, _, vectors = plain
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = language_id.fit(docs)
    got = {r["doc_id"]: r for r in language_id.op3_language_id(spark, sf).collect()}
    assert len(got) == len(table)
    for doc, text, _ in table:
        row, near = got[doc], model.centroids @ vectors[doc, text]
        assert row["held_out"] == (zlib.crc32(str(doc).encode()) % 3 == 1)
        if text is None or not any(map(str.isalpha, text)):
            assert row["lang_pred"] == "und"
            continue
        assert row["score"] == pytest.approx(max(near.max(), 0), abs=1e-5)
        others = [c for c, name in zip(near, model.languages, strict=True) if name != row["lang_pred"]]
        own = [c for c, name in zip(near, model.languages, strict=True) if name == row["lang_pred"]]
        assert max(own) >= max(others) - 1e-5


def test_ties_go_to_the_first_centroid():
    import pyarrow as pa

    one = np.zeros(language_id.DIMENSIONS, np.float32)
    one[list(plain_counts("abc"))] = 1
    one /= np.linalg.norm(one)
    model = language_id.LanguageModel(
        ["aa", "bb"], np.stack([one, one]), np.ones(language_id.DIMENSIONS, np.float32)
    )
    names, scores, _, _ = model.predict(pa.array(["abc", "abc abc", None]))
    assert names == ["aa"] * 3 and scores[0] > 0.99 and scores[2] == 0
