"""Each operator against a plain version of its definition, on small tables with every odd case."""

import gzip
import hashlib
import io
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quietroom.llm import decontamination, embedding_dedup, language_id, line_dedup, ngram_join
from quietroom.llm import packing, quality, sharding, token_counts, warc, words
from quietroom.llm.base import shared_path, slices_by_bytes
from quietroom.llm.components import components

LINE = "This line is long enough to count as shared text"
TEXTS = [
    (1, f"{LINE}\nalpha beta gamma delta"),
    (2, f"  {LINE.upper()}\t\nsomething else here entirely\n"),
    (3, f"{LINE}\n\n{LINE}\nshort\nÉlan vital Überall und nirgends"),
    (4, None),
    (5, ""),
    (6, "\n\n"),
    (7, "one two three four five six seven eight nine ten eleven twelve"),
    (8, "one two three four five six seven eight nine ten eleven twelve"),
    (8, "one two three four five six seven eight nine ten eleven twelve"),
    (9, "ONE two three four five six seven eight nine ten eleven twelve"),
    (10, "word"),
    (11, "%%% $$$ 12 345"),
    (None, f"{LINE}\nfrom nowhere"),
    (12, " ".join(f"w{i % 977}" for i in range(60_000))),
    (13, "Ünïcödé «quotes» ΣΊΣΥΦΟΣ İstanbul 你好 世界 \x1f <|endoftext|> don't"),
]
SCHEMA = "doc_id bigint, text string"
# Names that the operators' results also use.
CLASHES = ["score", "kept", "n_lines", "leaks", "shard", "lang_pred", "n_tokens", "node", "ids", "n"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(TEXTS, SCHEMA)
    return df.withColumns({c: F.lit(None).cast("string") for c in CLASHES}).repartition(3, "text")


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def split_words(text):
    return re.findall(r"[^\x20\x09-\x0d]+", fold(text or ""))


# --- 1 line dedup ---------------------------------------------------------------


def plain_lines(rows, min_chars=20, min_docs=3):
    holders = defaultdict(set)
    keys = lambda text: [fold(x.strip(" \t\n\x0b\x0c\r")) for x in (text or "").split("\n")]
    for doc, text in rows:
        for key in keys(text):
            if len(key) >= min_chars:
                holders[key].add(doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        gone = [
            len(holders[k]) >= min_docs and max(d for d in holders[k] if d is not None) != doc
            for k in keys(text)
        ]
        kept = "\n".join(x for x, g in zip(lines, gone, strict=True) if not g)
        out.append((doc, kept, len(lines), sum(gone)))
    return Counter(out)


@pytest.mark.parametrize("batches,fanout", [(1, 2), (4, 2), (5, 3)])
def test_line_dedup(docs, batches, fanout):
    found = line_dedup.line_dedup(docs, batches=batches, fanout=fanout)
    assert Counter(map(tuple, found.select("doc_id", "kept", "n_lines", "n_dropped").collect())) == (
        plain_lines(TEXTS)
    )


def test_line_runs_are_compacted_and_skip_settled_lines(spark):
    runs = line_dedup.LineRuns(spark, shared_path(spark, "test-runs"), fanout=2)
    for keeper in (9, 8, 7, 6, 5):
        runs.add(spark.createDataFrame([(1, 1, 1, keeper)], runs.SCHEMA), 3)
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    assert [tuple(r) for r in line_dedup.merge_runs(runs.read()).collect()] == [(1, 1, 3, 9)]


def test_line_dedup_of_nothing(nothing):
    assert line_dedup.line_dedup(nothing).count() == 0


# --- 2 embeddings ----------------------------------------------------------------


def plain_embeddings(rows, cosine):
    able = [
        (k, i, np.array(v, float) / np.linalg.norm(np.array(v, float)), label)
        for k, (i, v, label) in enumerate(rows)
        if i is not None and label is not None and v
        and all(x is not None and np.isfinite(x) for x in v) and any(v)
    ]
    links, group = Counter(), {k: k for k, *_ in able}
    for a, (k, _, x, p) in enumerate(able):
        for m, _, y, q in able[a + 1 :]:
            if p == q and len(x) == len(y) and x @ y >= cosine:
                links[k] += 1
                links[m] += 1
                old, new = group[m], group[k]
                group = {n: new if g == old else g for n, g in group.items()}
    ids = {k: i for k, i, *_ in able}
    out = []
    for k, (i, _, _) in enumerate(rows):
        own = [ids[n] for n, g in group.items() if g == group[k]] if k in group else [i]
        out.append((i, links[k], None if i is None else min(own), i is not None and min(own) == i))
    return Counter(out)


def test_embedding_dedup(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(300):
        base = rng.standard_normal(16) if i % 3 == 0 else base + 0.09 * rng.standard_normal(16)
        rows.append((i, [float(x) for x in base.astype(np.float32)], [0, 0, 0, 1][i % 4]))
    rows += [(400 + k, rows[0][1], 0) for k in range(5)]
    rows += [(500, None, 0), (501, [0.0] * 16, 0), (502, [float("nan")] * 16, 0), (503, [], 0)]
    rows += [(504, rows[0][1], None), (None, rows[0][1], 0), (505, [1.0, None], 0)]
    rows += [(506, [float("inf")] + [1.0] * 15, 0), (507, [1e-30] * 16, 1), (508, [1.0, 2.0], 0)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    found = embedding_dedup.embedding_dedup(df.withColumn("links", F.lit(1)), chunk=40)
    assert Counter(map(tuple, found.collect())) == plain_embeddings(rows, 0.93)
    assert embedding_dedup.embedding_dedup(df.limit(0)).count() == 0


def test_collision_counts_and_threshold():
    rng = np.random.default_rng(1)
    a, b = rng.standard_normal((20, 5)), rng.standard_normal((30, 5))
    plain = (np.abs(a[:, None, :] - b[None, :, :]) <= 0.7).sum(axis=2)
    assert (embedding_dedup.collision_counts(a, b, 0.7) == plain).all()
    # pairs at the threshold reach the count
    u = rng.standard_normal((4000, 64))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    w = rng.standard_normal((4000, 64))
    w -= (w * u).sum(axis=1, keepdims=True) * u
    v = 0.93 * u + np.sqrt(1 - 0.93**2) * w / np.linalg.norm(w, axis=1, keepdims=True)
    on = embedding_dedup.directions(64)
    half = embedding_dedup.WINDOW * embedding_dedup.deviation(0.93)
    hits = (np.abs(u @ on - v @ on) <= half).sum(axis=1)
    assert (hits >= embedding_dedup.needed_count()).mean() > 0.995


# --- 3 language ------------------------------------------------------------------


def test_language_id(spark, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    model = language_id.fit(table)
    found = language_id.identify(table, model).where(language_id.held_out()).collect()
    right = np.mean([r["lang"] == r["lang_pred"] for r in found])
    assert right > 0.95 and not any(r["rejected"] for r in found)
    assert all(0 <= r["score"] <= 1 for r in found)


def test_language_id_odd_texts(docs, nothing, spark, sf):
    model = language_id.fit(spark.read.parquet(f"{sf}/documents.parquet"))
    rows = language_id.identify(docs, model).collect()
    by = {r["text"]: r for r in rows}
    assert len(rows) == len(TEXTS)
    for text in (None, "", "\n\n", "%%% $$$ 12 345"):
        assert (by[text]["lang_pred"], by[text]["score"], by[text]["rejected"]) == ("und", 0.0, True)
    assert by[TEXTS[0][1]]["lang_pred"] in model.languages
    far = language_id.identify(spark.createDataFrame([(1, "ქართული ენა")], SCHEMA), model)
    assert far.first()["rejected"]
    empty = language_id.fit(nothing.withColumn("lang", F.lit("en")))
    assert language_id.identify(docs, empty).where("lang_pred <> 'und'").isEmpty()
    assert language_id.identify(nothing, model).count() == 0


UNSEEN = {
    "ka": "ყველა ადამიანი იბადება თავისუფალი და თანასწორი თავისი ღირსებითა და უფლებებით.",
    "el": "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα.",
    "ru": "Все люди рождаются свободными и равными в своем достоинстве и правах.",
    "fi": "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on "
    "annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä.",
    "pl": "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni "
    "obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa.",
    "tr": "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana "
    "sahiptirler ve birbirlerine karşı kardeşlik zihniyeti ile hareket etmelidirler.",
}


def test_unseen_languages_are_rejected_and_clean_short_texts_are_not(spark, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    model = language_id.fit(table)
    letters = np.random.default_rng(3).choice(list("abcdefghijklmnopqrstuvwxyz    "), 4000)
    far = [*UNSEEN.values(), *(f"{t} " * 20 for t in UNSEEN.values()), "".join(letters)]
    rows = language_id.identify(spark.createDataFrame([*enumerate(far)], SCHEMA), model).collect()
    assert [r["text"][:20] for r in rows if not r["rejected"]] == []
    held = table.where(language_id.held_out() & F.col("text").isNotNull())
    short = held.select("doc_id", F.substring("text", 1, 40).alias("text"), "lang")
    words = [(1, "word"), (2, "the house"), (3, "guten Tag"), (4, "la casa de los"), (5, "les des")]
    for clean in (short, spark.createDataFrame(words, SCHEMA)):
        assert language_id.identify(clean, model).where("rejected").isEmpty()


# --- 4 token counts --------------------------------------------------------------


def greedy(word, vocabulary):
    at = found = 0
    while at < len(word):
        ends = [e for e in range(len(word), at, -1) if word[at:e] in vocabulary]
        if not ends:
            return 1
        at, found = ends[0], found + 1
    return found


def test_automaton_is_greedy_longest_match():
    rng = np.random.default_rng(5)
    for _ in range(200):
        letters = b"abc"[: rng.integers(1, 4)]
        draw = lambda n: bytes(rng.choice(list(letters), n))
        vocabulary = {draw(rng.integers(1, 6)) for _ in range(rng.integers(1, 12))}
        automaton = token_counts.Automaton(vocabulary)
        for _ in range(30):
            word = draw(rng.integers(1, 15))
            assert automaton.count(word) == greedy(word, vocabulary), (word, vocabulary)


def test_token_counts(docs, nothing):
    with open(token_counts.default_vocabulary(), "rb") as file:
        import base64

        vocabulary = {base64.b64decode(line.split()[0]) for line in file}
    import public_tokenizers
    import regex

    for row in token_counts.token_counts(docs).collect():
        if row["doc_id"] != 12:
            found = regex.findall(public_tokenizers.PATTERN, row["text"] or "")
            want = (len(found), sum(greedy(w.encode(), vocabulary) for w in found))
            assert (row["n_words"], row["n_tokens"]) == want
    assert token_counts.token_counts(nothing).count() == 0


# --- 5 sharding ------------------------------------------------------------------


def test_permutation_and_its_inverse(spark):
    for n in (1, 2, 3, 5, 64, 1000):
        keys = spark.range(n).withColumnRenamed("id", "r")
        found = [r["p"] for r in sharding.permuted(keys, "r", n, 7, "p").orderBy("r").collect()]
        assert found == [sharding.place_of(i, n, 7) for i in range(n)]
        assert sorted(found) == list(range(n))
        assert [sharding.row_at(p, n, 7) for p in found] == list(range(n))


def test_shard_rows(docs, nothing):
    rows = sharding.shard_rows(docs, 4).collect()
    want = Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in TEXTS)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        place = sharding.place_of(r["row_number"], len(TEXTS), 42)
        assert (r["shard"], r["slot"]) == (place % 4, place // 4)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    again = sharding.shard_rows(docs.repartition(5), 4).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, rows))
    assert sharding.shard_rows(nothing, 4).count() == 0


# --- 6 decontamination -----------------------------------------------------------


def plain_leaks(texts, items, similarity=0.8):
    def grams(found):
        k = min(5, len(found))
        return Counter(tuple(found[i : i + k]) for i in range(len(found) - k + 1)) if found else None

    norm = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    out = set()
    for doc, text in texts:
        own = norm(text)
        for item, want in items:
            target = norm(want)
            if not target or not grams(own) or not grams(target):
                continue
            k = min(5, len(target))
            if not {tuple(own[i : i + k]) for i in range(len(own))} & set(grams(target)):
                continue  # similarity 0 everywhere
            for at in range(len(own) - len(target) + 1 if target else 0):
                a, b = grams(own[at : at + len(target)]), grams(target)
                both = sum((a & b).values())
                if both >= similarity * (sum(a.values()) + sum(b.values()) - both):
                    out.add((doc, item))
                    break
    return out


def test_find_leaks(spark, nothing):
    rng = np.random.default_rng(2)
    vocabulary = [f"v{i}" for i in range(400)]
    draw = lambda n: [str(w) for w in rng.choice(vocabulary, n)]
    items = [(i, " ".join(draw(rng.integers(12, 50)))) for i in range(12)]
    items += [(90, "Tiny one!"), (91, ""), (92, None), (None, "a b c d e f g"), (93, "w w w w w w w")]
    texts = []
    for i in range(80):
        body = draw(rng.integers(5, 200))
        if i % 2:
            passage = items[i % 12][1].upper().split()
            if i % 3 == 0:
                passage[-1] = "changed"
            if i % 5 == 0:
                passage[len(passage) // 2] = "changed"
            at = rng.integers(0, len(body))
            body[at:at] = passage
        texts.append((i, ", ".join(body) if i % 7 else "\n".join(body)))
    texts += [(100, None), (101, ""), (102, "so tiny, one"), (103, "w " * 300), (104, items[3][1])]
    docs = spark.createDataFrame(texts, SCHEMA).withColumn("leaks", F.lit("x"))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    found = decontamination.find_leaks(docs, bench).select("doc_id", F.inline("leaks"))
    want = plain_leaks(texts, [x for x in items if x[0] is not None])
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == want and len(want) > 20
    sliced = decontamination.find_leaks(docs, bench, pass_chars=600)
    assert {(r[0], r[1]) for r in sliced.select("doc_id", F.inline("leaks")).collect()} == want
    clean = {r["doc_id"] for r in decontamination.decontaminate(docs, bench).collect()}
    assert clean == {d for d, _ in texts} - {d for d, _ in want}
    assert decontamination.decontaminate(docs, bench.limit(0)).count() == len(texts)
    assert decontamination.find_leaks(nothing, bench).count() == 0


def test_passes_hold_one_slice_at_a_time(spark, monkeypatch):
    from pyspark import Broadcast, SparkContext

    rng = np.random.default_rng(15)
    items = [(i, " ".join(f"w{x}" for x in rng.integers(0, 10**6, 20))) for i in range(30)]
    texts = [(i, f"before {items[i][1]} after") for i in range(0, 30, 2)] + [(99, "nothing of it")]
    alive, most = set(), []
    send, give_up = SparkContext.broadcast, Broadcast.destroy

    def counted(self, value):
        sent = send(self, value)
        if isinstance(value, decontamination.LeakIndex):
            alive.add(id(sent))
            most.append(len(alive))
        return sent

    def dropped(self, *args):
        alive.discard(id(self))
        return give_up(self, *args)

    monkeypatch.setattr(SparkContext, "broadcast", counted)
    monkeypatch.setattr(Broadcast, "destroy", dropped)
    docs = spark.createDataFrame(texts, SCHEMA)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    found = decontamination.find_leaks(docs, bench, pass_chars=1000)
    assert {(r[0], r[1]) for r in found.select("doc_id", F.inline("leaks")).collect()} == {
        (i, i) for i in range(0, 30, 2)
    }
    assert len(most) >= 3 and max(most) == 1


def plain_short_leaks(texts, items, similarity=0.8):
    """Leaks of texts that have fewer words than the item, compared as a whole."""
    norm = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    grams = lambda w: Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    out = set()
    for doc, text in texts:
        for item, want in items:
            if len(norm(text)) < len(norm(want)):
                a, b = grams(norm(text)), grams(norm(want))
                both = sum((a & b).values())
                if both >= similarity * (a.total() + b.total() - both):
                    out.add((doc, item))
    return out


def test_find_leaks_in_texts_shorter_than_the_item(spark):
    rng = np.random.default_rng(8)
    vocabulary = [f"v{i}" for i in range(400)]
    items = [(n, " ".join(rng.choice(vocabulary, n))) for n in range(16, 60)]
    items.append((4, "just four words here"))
    texts = []
    for n, text in items:
        own = text.split()
        gone = [own[:-1], own[1:], own[:-4], own[: n // 2] + own[n // 2 + 1 :], own[: n // 2]]
        texts += [(100 * n + i, " ".join(words)) for i, words in enumerate(gone)]
    docs = spark.createDataFrame(texts, SCHEMA)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    found = decontamination.find_leaks(docs, bench).select("doc_id", F.inline("leaks")).collect()
    want = plain_short_leaks(texts, [x for x in items if x[0] > 4])
    assert {(r["doc_id"], r["item_id"]) for r in found} == want
    assert {(100 * 59, 59), (100 * 59 + 3, 59)} <= want and len(want) > 120
    words = {d: len(t.split()) for d, t in texts}
    assert all((r["start"], r["n_words"]) == (0, words[r["doc_id"]]) for r in found)


def test_multi_index_finds_all_fingerprints_in_the_radius():
    rng = np.random.default_rng(9)
    group = decontamination.SizeIndex(20)
    for i in range(30):
        group.items.append(i)
        group.grams.append(rng.integers(0, 2**63, 16, dtype=np.uint64))
    group.build()
    probes = []
    for p in rng.choice(group.prints, 400):
        flips = rng.choice(64, rng.integers(0, 30), replace=False)
        probes.append(p ^ np.uint64(sum(1 << int(b) for b in flips)))
    probes = np.array(probes, np.uint64)
    near = np.bitwise_count(probes[:, None] ^ group.prints[None, :]) <= decontamination.RADIUS
    found = set(zip(*map(list, group.candidates(probes)), strict=True))
    assert found == set(zip(*map(list, np.nonzero(near)), strict=True))


# --- 7 quality -------------------------------------------------------------------


def test_quality(spark, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    forest = quality.fit(table, labels)
    scored = quality.quality_scores(table.select("doc_id", "text"), forest)
    rows = scored.join(labels, "doc_id").where(quality.held_out()).collect()
    good = [r["score"] for r in rows if r["quality"] == 1]
    bad = [r["score"] for r in rows if r["quality"] == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.9


def test_quality_odd_tables(docs, nothing, spark):
    labels = spark.createDataFrame(
        [(1, 1), (2, 0), (3, None), (None, 1), (5, 0), (7, 1)], "doc_id bigint, quality int"
    )
    for forest in (quality.fit(docs, labels), quality.fit(nothing, labels)):
        rows = quality.quality_scores(docs, forest).collect()
        assert len(rows) == len(TEXTS) and all(0 <= r["score"] <= 1 for r in rows)
        assert all(r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert quality.quality_scores(nothing, forest).count() == 0


def test_flat_trees_equal_a_walk_node_by_node():
    rng = np.random.default_rng(4)
    rows = rng.standard_normal((500, 5))
    target = (rows[:, 0] * rows[:, 1] > 0).astype(float)
    forest = quality.grow(rows, target, trees=20, depth=3)

    def walk(row):
        total = forest.start
        for t in range(20):
            node = 0
            while node < 7:
                right = row[forest.feature[t, node]] > forest.threshold[t, node]
                node = 2 * node + 1 + int(right)
            total += forest.value[t, node - 7]
        return 1 / (1 + np.exp(-total))

    scores = forest.scores(rows)
    assert np.allclose(scores, [walk(r) for r in rows])
    assert ((scores >= 0.5) == target).mean() > 0.9


# --- 8 n-gram join ---------------------------------------------------------------


def plain_join(rows, k, percent):
    sets = []
    for _, text in rows:
        found = split_words(text)
        n = min(k, len(found))
        sets.append({tuple(found[i : i + n]) for i in range(len(found) - n + 1)} if n else set())
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            named = rows[a][0] is not None and rows[b][0] is not None
            if named and sets[a] and sets[b]:
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    old, new = group[a], group[b]
                    group = [new if g == old else g for g in group]
    least = {}
    for (doc, _), g in zip(rows, group, strict=True):
        if doc is not None:
            least[g] = min(doc, least.get(g, doc))
    return Counter(
        (doc, len(s), None if doc is None else least[g])
        for (doc, _), s, g in zip(rows, sets, group, strict=True)
    )


@pytest.mark.parametrize("k,percent", [(3, 90), (5, 80), (2, 60)])
def test_ngram_join(spark, docs, k, percent):
    rng = np.random.default_rng(k)
    vocabulary = [f"t{i}" for i in range(300)]
    rows = list(TEXTS)
    for family in range(12):
        base = [str(w) for w in rng.choice(vocabulary, rng.integers(8, 120))]
        for copy in range(6):
            changed = list(base)
            for _ in range(copy):
                changed[rng.integers(0, len(changed))] = str(rng.choice(vocabulary))
            rows.append((1000 + 10 * family + copy, " ".join(changed)))
    df = spark.createDataFrame(rows, SCHEMA).withColumn("node", F.lit("x"))
    found = ngram_join.ngram_join(df, k, percent)
    got = found.select("doc_id", "n_shingles", "component_id").collect()
    assert Counter(map(tuple, got)) == plain_join(rows, k, percent)


def test_ngram_join_of_nothing(nothing):
    assert ngram_join.ngram_join(nothing).count() == 0


def test_every_allocation_finds_all_links():
    rng = np.random.default_rng(8)
    percent, low, high = 80, 40, 59
    differ = high * (100 - percent) // percent
    for deletion in range((differ + 1) // 2 + 1):
        band = ngram_join.Band(3, low, high, differ + 1 - 2 * deletion, deletion)
        for _ in range(20):
            a = rng.integers(0, 2**63, rng.integers(low, high + 1), dtype=np.uint64)
            drop = rng.integers(0, len(a) // 9 + 1)
            b = np.concatenate([a[drop:], rng.integers(0, 2**63, drop, dtype=np.uint64)])
            both = len(np.intersect1d(a, b))
            if 100 * both >= percent * (len(a) + len(b) - both):
                x, y = (ngram_join.signatures(np.unique(s), band) for s in (a, b))
                assert len(np.intersect1d(x, y))


def test_components(spark):
    rng = np.random.default_rng(6)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 120, (70, 2))]
    edges += [(200 + i, 201 + i) for i in range(40)] + [(7, 7), (None, 3)]
    root = {n: n for e in edges for n in e}
    for _ in range(200):
        for a, b in edges:
            if a is not None:
                root[a] = root[b] = min(root[a], root[b])
    found = dict(map(tuple, components(spark.createDataFrame(edges, "u long, v long")).collect()))
    linked = {n for a, b in edges if a is not None and a != b for n in (a, b)}
    assert found == {n: root[n] for n in linked}


# --- 9 WARC ----------------------------------------------------------------------


PAGES = [
    (1, "http://a/", "<p>same</p>"), (2, "http://b/", "<p>same</p>"), (3, None, "<p>same</p>"),
    (4, "http://c/\r\nX: y", None), (5, "http://d/", ""), (None, "http://e/", "<p>same</p>"),
    (6, "http://f/", "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n"),
    (7, "http://g/ü", "é\x00ü" * 5000), (7, "http://g/ü", "é\x00ü" * 5000), (8, "", "\r\n\r\n"),
]


@pytest.mark.parametrize("min_bytes", [0, 5])
def test_warc_round_trip(spark, min_bytes):
    pages = spark.createDataFrame(PAGES, "page_id bigint, url string, html string")
    path = shared_path(spark, "test-warc")
    warc.write_archive(pages.withColumn("last", F.lit(1)), path, min_bytes)
    rows = warc.assemble(warc.read_records(spark, path)).collect()
    import base64
    import json

    got, bodies = Counter(), {}
    for r in rows:
        info = json.loads(r["metadata"]["info"])
        origin = json.loads(r["origin"])["page_id"] if r["origin"] else None
        response = r["response"]
        got[
            info.get("page_id"), info.get("url"), response["payload_bytes"],
            response["payload_digest"], response["kind"], origin,
        ] += 1
        assert r["request"]["target_uri"] == response["target_uri"]
        if response["kind"] == "response":
            bodies[info.get("page_id")] = bytes(response["payload"]).decode()
    last, want = {}, Counter()
    key = lambda p: (-1 if p[0] is None else p[0], p[1] or "")
    for p in PAGES:
        body = p[2] or ""
        if len(body.encode()) >= min_bytes:
            last[body] = max(last.get(body, p), p, key=key)
    for p in PAGES:
        body = (p[2] or "").encode()
        again = len(body) >= min_bytes and last[p[2] or ""][:2] != p[:2]
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        want[
            p[0], p[1], len(body), digest, "revisit" if again else "response",
            last[p[2] or ""][0] if again else None,
        ] += 1
    assert got == want
    assert all(bodies[p[0]] == (p[2] or "") for p in PAGES if p[0] in bodies)


def test_warc_files_are_plain_records(spark):
    pages = spark.createDataFrame(PAGES, "page_id bigint, url string, html string")
    path = shared_path(spark, "test-warc")
    warc.write_archive(pages, path)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).collect()
    kinds = Counter()
    for file in files:
        for fields, _ in warc.parse_records(gzip.open(io.BytesIO(file["content"]))):
            kinds[fields["warc-type"]] += 1
    assert kinds["request"] == kinds["metadata"] == len(PAGES)
    assert kinds["response"] + kinds["revisit"] == len(PAGES)
    with pytest.raises(ValueError):
        list(warc.parse_records(io.BytesIO(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nshort")))


def test_warc_of_nothing(spark):
    path = shared_path(spark, "test-warc")
    warc.write_archive(spark.createDataFrame([], "page_id bigint, url string, html string"), path)
    assert warc.assemble(warc.read_records(spark, path)).count() == 0


# --- 10 packing ------------------------------------------------------------------


def encoded(text):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    tokenizer.encode_special_tokens = True
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


@pytest.mark.parametrize("window,shard_docs", [(2048, 512), (16, 3)])
def test_packing(docs, window, shard_docs):
    pieces = packing.pack(docs, window, shard_docs=shard_docs, keep_ids=True).collect()
    sequences, ids = defaultdict(dict), defaultdict(dict)
    for p in pieces:
        sequences[p["sequence_id"]][p["offset"]] = p["length"]
        assert len(p["ids"]) == p["length"] > 0
        assert zlib.crc32(np.array(p["ids"], "<u4").tobytes()) == p["ids_crc32"]
    for parts in sequences.values():
        at = 0
        for offset in sorted(parts):
            assert offset == at
            at += parts[offset]
        assert at == window or at < window and at & (at - 1) == 0
    total = Counter()
    for p in pieces:
        total[p["doc_id"], p["doc_tokens"]] += p["length"]
    want = Counter()
    for doc, text in TEXTS:
        n = len(encoded(text))
        want[doc, n] += n
    assert total == want
    for p in pieces:
        if p["doc_id"] != 8:
            ids[p["doc_id"]][p["start"]] = p["ids"]
    for doc, text in TEXTS:
        if doc != 8:
            joined = [x for start in sorted(ids[doc]) for x in ids[doc][start]]
            assert joined == encoded(text)


def test_token_ids_equal_the_tokenizer():
    texts = [t or "" for _, t in TEXTS] + ["It's 12½ o'clock—naïve façade ²x", "é combining", "x'll'S"]
    found = packing.token_ids(packing.default_tokenizer()).packed(texts)
    assert [[*np.frombuffer(f, "<u4"), 1] for f in found] == [encoded(t) for t in texts]


def test_token_ids_side_by_side():
    """Many texts are encoded as one column; whatever stands in them, ids are those of the whole texts."""
    draw = random.Random(3)
    letters = [chr(c) for c in range(1, 0x250)] + [*" \t\n\xa0\u3000 'stre<|"] * 20 + ["Σ", "中", "😀"]
    texts = ["".join(draw.choices(letters, k=draw.randrange(40))) for _ in range(3000)] + ["", " ", "a<|b"]
    encode = packing.token_ids(packing.default_tokenizer())
    ids, sizes = encode.encoded(pa.array(texts))
    assert [len(w) // 4 for w in encode.whole(texts)] == sizes.tolist()
    assert ids.astype("<u4").tobytes() == b"".join(encode.whole(texts))
    ids, sizes = np.insert(ids, np.cumsum(sizes), packing.END_ID), sizes + 1
    many = np.append(ids, 1 << 16)  # beyond 16 bits
    packed, n = packing._packed(many, np.append(sizes, 1))
    assert n.to_pylist()[-1] == -1 and packed.to_pylist()[-1] == b"\0\0\1\0"
    narrow, count = packing._packed(ids, sizes)
    assert [len(b) for b in narrow.to_pylist()] == (2 * sizes).tolist() and count.to_pylist() == sizes.tolist()
    assert packed.slice(0, len(sizes)).to_pylist() == narrow.to_pylist()


def test_slices_by_bytes():
    batch = pa.RecordBatch.from_pydict({"text": ["aaa", None, "", "é" * 9, "b", "ccc", "d"]})
    parts = list(slices_by_bytes(batch, "text", 4))
    assert pa.Table.from_batches(parts).to_pydict() == batch.to_pydict()
    assert [p.num_rows for p in parts] == [3, 1, 2, 1]
    assert not list(slices_by_bytes(batch.slice(0, 0), "text", 4))


def test_token_ids_of_every_word_the_pattern_knows(sf):
    """Words of all letters that go word by word, and of real texts, one by one and side by side."""
    encode = packing.token_ids(packing.default_tokenizer())
    assert encode.by_word
    letters = [chr(c) for c in range(0x21, 0x250) if not packing._OTHER.search(chr(c))]
    rng = np.random.default_rng(21)
    texts = ["".join(rng.choice(letters, rng.integers(1, 12))) for _ in range(3000)] + letters
    import pyarrow.parquet as pq

    texts += [t or "" for t in pq.read_table(f"{sf}/documents.parquet")["text"].to_pylist()]
    texts.append(" ".join(texts[:1000]))
    assert encode.packed(texts) == encode.whole(texts)


def test_neighbours_share_words():
    documents = [np.array(d) for d in ([1, 2, 3, 4], [9, 9, 8, 8], [1, 2, 3, 7], [8, 5, 6, 6])]
    index = packing.InvertedIndex(documents)
    assert list(index.neighbours(0)[:2]) == [0, 2]
    assert list(index.neighbours(1)[:2]) == [1, 3]


def test_neighbours_use_all_terms_of_the_seed():
    documents = [np.arange(100), np.arange(30), np.arange(40, 100), np.arange(200, 260)]
    assert list(packing.InvertedIndex(documents).neighbours(0)[:3]) == [0, 2, 1]


def test_related_documents_meet_wherever_they_are(spark):
    rng = np.random.default_rng(6)
    draw = lambda: "".join(rng.choice(list("bcdfghklmnprstvz"), 7))
    common, topics = [draw() for _ in range(40)], [[draw() for _ in range(6)] for _ in range(40)]
    topic_of = {int(d): i % 40 for i, d in enumerate(rng.permutation(320))}
    texts = [
        (d, " ".join([*rng.choice(common, 10), *rng.choice(topics[t], 20)]))
        for d, t in topic_of.items()
    ]
    docs = spark.createDataFrame(texts, SCHEMA).repartition(5)
    pieces = packing.pack(docs, 512, shard_docs=16).collect()
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p["sequence_id"]] += [topic_of[p["doc_id"]]] * p["length"]
    # The share of ids that belong to the most frequent topic of their sequence; 1 in 40 by chance.
    share = sum(max(Counter(s).values()) for s in sequences.values())
    assert share / sum(map(len, sequences.values())) > 0.6
    ids = packing.tokenised(docs, packing.default_tokenizer())
    found = packing.statistics_of(ids)
    plain = packing.Statistics.of([np.array(encoded(t)) for _, t in texts])
    assert (found.documents, found.mean_length) == (plain.documents, plain.mean_length)
    assert (found.frequencies == plain.frequencies).all()


def plain_scores(documents, seed):
    """BM25 of each document against the distinct terms of the seed, term by term."""
    n, mean = len(documents), sum(map(len, documents)) / len(documents)
    holders = Counter(t for d in documents for t in set(d.tolist()))
    out = []
    for d in documents:
        counts, score = Counter(d.tolist()), 0.0
        for term in sorted(set(documents[seed].tolist())):
            if counts[term]:
                idf = np.log(1 + (n - holders[term] + 0.5) / (holders[term] + 0.5))
                norm = packing.K1 * (1 - packing.B + packing.B * len(d) / mean)
                score += idf * counts[term] * (packing.K1 + 1) / (counts[term] + norm)
        out.append(score)
    return out


def plain_fill(documents, window):
    """Whole windows first; then the longest open text takes its nearest open ones, best first."""
    pieces, sequence, taken = [], 0, [0] * len(documents)

    def put(i, length, offset):
        pieces.append((i, taken[i], length, sequence, offset))
        taken[i] += length

    for i, d in enumerate(documents):
        while len(d) - taken[i] >= window:
            put(i, window, 0)
            sequence += 1
    rest = [len(d) - t for d, t in zip(documents, taken, strict=True)]
    for seed in sorted(range(len(documents)), key=lambda i: (-rest[i], i)):
        left = [len(d) - t for d, t in zip(documents, taken, strict=True)]
        if sum(left) < window:
            break
        if not left[seed]:
            continue
        scores, offset = plain_scores(documents, seed), 0
        for i in [seed, *sorted(range(len(documents)), key=lambda i: (-scores[i], i))]:
            length = min(window - offset, len(documents[i]) - taken[i])
            if length:
                put(i, length, offset)
                offset += length
        sequence += 1
    size = room = 0
    for i, d in enumerate(documents):
        while taken[i] < len(d):
            if not room:
                left = sum(map(len, documents)) - sum(taken)
                size = room = 2 ** int(np.log2(left))
            length = min(room, len(d) - taken[i])
            put(i, length, size - room)
            room -= length
            sequence += not room
    return pieces


@pytest.mark.parametrize("seed,window", [(1, 32), (2, 64), (3, 16), (4, 512)])
def test_scores_and_fill_against_plain_versions(seed, window):
    rng = np.random.default_rng(seed)
    documents = [rng.zipf(1.4, rng.integers(1, 90)) % 60 for _ in range(40)]
    documents += [documents[3], documents[5][::-1], documents[3], np.array([1])]  # equal scores
    index = packing.InvertedIndex(documents)
    for i in range(len(documents)):
        assert np.allclose(index.scores(i), plain_scores(documents, i), rtol=1e-12)
    assert index.scores(0)[3] == index.scores(0)[42] and index.scores(0)[3] == index.scores(0)[40]
    assert packing.fill(documents, window) == plain_fill(documents, window)


def test_term_counts():
    documents = [np.array(d) for d in ([5, 3, 5, 1], [2], [3, 3, 70_000])]
    owner, term, count = (x.tolist() for x in packing.term_counts(documents))
    assert owner == [0, 0, 0, 1, 2, 2] and term == [1, 3, 5, 2, 3, 70_000] and count == [1, 1, 2, 1, 2, 1]


def test_packing_of_nothing(nothing):
    assert packing.pack(nothing).count() == 0


# --- words -----------------------------------------------------------------------


def test_word_hashes(monkeypatch):
    monkeypatch.setattr(words, "CHUNK", 64)
    texts = [t for _, t in TEXTS if t is None or len(t) < 10_000] + ["x" * 300 + " y", " pad\x0b\x0c"]
    found, ends = words.word_hashes(pa.array([*texts, "skipped"])[:-1])
    known = {}
    for i, text in enumerate(texts):
        own = split_words(text)
        assert len(own) == ends[i + 1] - ends[i]
        for word, value in zip(own, found[ends[i] : ends[i + 1]], strict=True):
            assert known.setdefault(word, value) == value
    assert len(set(known.values())) == len(known)


@pytest.mark.parametrize("percent", [60, 80, 90])
def test_bins_never_part_a_link(percent):
    rng = np.random.default_rng(percent)
    draw = lambda n: np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
    sets = [draw(rng.choice([1, 2, 7, 60, 130, 700])) for _ in range(60)]
    for s in sets[:40]:  # partners at all distances
        gone = int(len(s) * rng.uniform(0, 0.5))
        sets.append(np.unique(np.concatenate([s[gone:], draw(rng.integers(0, gone + 1))])))
    one, two = sets[:60], sets[40:]
    counts = [[ngram_join.bin_counts(s) for s in part] for part in (one, two)]
    sizes = tuple(np.array([len(s) for s in part]) for part in (one, two))
    found = set(zip(*(x.tolist() for x in ngram_join.possible_pairs(*counts, sizes, percent))))
    linked = {
        (i, j) for i, a in enumerate(one) for j, b in enumerate(two)
        if 100 * len(np.intersect1d(a, b)) >= percent * len(np.union1d(a, b))
    }
    assert linked <= found and linked
    # The bound itself: what the smaller counts allow.
    for i, j in list(found)[:50]:
        m = min(len(counts[0][i]), len(counts[1][j]))
        both = np.minimum(*(ngram_join.folded([c], m)[0] for c in (counts[0][i], counts[1][j]))).sum()
        assert both >= len(np.intersect1d(one[i], two[j]))
        assert 100 * both >= percent * (len(one[i]) + len(two[j]) - both)
    assert len(found) < 0.2 * len(one) * len(two)


def test_bins_of_large_sets_take_four_bytes():
    same = np.arange(1, 2000, dtype=np.uint64)
    assert ngram_join.bin_counts(same).dtype == np.uint8 and len(ngram_join.bin_counts(same)) == 1024
    assert ngram_join.bin_counts(same).sum() == len(same)


@pytest.mark.parametrize("percent", [60, 90])
def test_every_pair_that_may_link_meets_in_one_group(spark, percent):
    rng = np.random.default_rng(30)
    rows = [(c, 100 * c + i, int(n)) for c in (1, 2) for i, n in enumerate(rng.integers(1, 300, 60))]
    rows += [(3, 900 + i, n) for i, n in enumerate([9, 10, 90, 100, 81, 729, 810, 900, 1000, 54, 6])]
    df = spark.createDataFrame(rows, "cluster bigint, node bigint, n_shingles bigint").repartition(3)
    paired = ngram_join.paired_blocks(df, df, ["n_shingles"], percent, "n_shingles", 7, 400)
    groups = defaultdict(lambda: ([], []))
    for r in paired.collect():
        groups[tuple(r[c] for c in ngram_join.PAIR)][not r["left"]].append(r["node"])
    met = Counter()
    for (_, c, i, d, j), (left, right) in groups.items():
        if (c, i) == (d, j):
            assert not right
            met.update((a, b) for a in left for b in left if a < b)
        else:
            met.update((min(a, b), max(a, b)) for a in left for b in right)
    assert set(met.values()) == {1}
    for ca, a, n in rows:
        for cb, b, m in rows:
            if ca == cb and a < b and 100 * min(n, m) >= percent * max(n, m):
                assert met[a, b] == 1
    assert len(met) < sum(60 * 59 / 2 for _ in (1, 2))


def test_marked_texts(spark):
    ids = [0, 1, 7, 10**12, -5]
    wanted = spark.createDataFrame([(i,) for i in ids], "doc_id bigint")
    bits = ngram_join.marked(wanted)
    at = spark.range(3).crossJoin(wanted).select(
        F.pmod(F.xxhash64("doc_id"), F.lit(ngram_join.MARKS)).alias("at"))
    places = {r["at"] for r in at.collect()}
    assert all(bits[p >> 3] >> (p & 7) & 1 for p in places)
    assert np.unpackbits(bits).sum() == len(places)


def test_filled_segments_never_miss_a_link():
    rng = np.random.default_rng(12)
    percent, low, high = 80, 108, 161
    count = ngram_join.filled_segments(low, high, percent)
    band = ngram_join.Band(5, low, high, count, 0, True)
    assert count > ngram_join.differing(high, percent) + 1
    for _ in range(60):
        a = np.unique(rng.integers(0, 2**63, rng.integers(low, high + 1), dtype=np.uint64))
        drop = len(a) // 9
        b = np.unique(np.concatenate([a[drop:], rng.integers(0, 2**63, drop, dtype=np.uint64)]))
        regular = all(
            len(np.unique(ngram_join.segment_of(s, count))) > ngram_join.differing(high, percent)
            for s in (a, b)
        )
        both = len(np.intersect1d(a, b))
        if regular and 100 * both >= percent * (len(a) + len(b) - both):
            x, y = (ngram_join.signatures(s, band) for s in (a, b))
            assert len(np.intersect1d(x, y))
    odd = ngram_join.plan(5, low, high, 10**9, percent, irregular=True)
    assert not odd.filled and odd.exact + 2 * odd.deletion == ngram_join.differing(high, percent) + 1


def test_chained_texts_are_compared_with_neighbours_only(spark, monkeypatch):
    """Each text shares a passage with the next: one chain, of which no two texts link."""
    word = lambda *at: " ".join(f"w{'x'.join(map(str, at))}x{i}" for i in range(40))
    n = 200
    rows = [(i, " ".join([word(i), word(i, i + 1), word(i - 1, i)])) for i in range(n)]
    rows += [(n + i, rows[i][1] + " more") for i in (3, 77)]
    monkeypatch.setattr(ngram_join, "BIN_BLOCK", 16)
    monkeypatch.setattr(ngram_join, "PACK", 16, raising=False)
    compared = []

    def spy(blocks, percent, real=ngram_join.compatible):
        compared.append(blocks.count())
        return real(blocks, percent)

    monkeypatch.setattr(ngram_join, "compatible", spy)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    found = {r["doc_id"]: r["component_id"] for r in ngram_join.ngram_join(df, k=1).collect()}
    assert found == {**{i: i for i in range(n)}, n + 3: 3, n + 77: 77}
    assert 200 < compared[0] < 4 * n


def test_stars_put_nodes_of_a_signature_together(spark):
    rng = np.random.default_rng(8)
    members = [(int(x), 50) for x in rng.integers(1, 2**60, 3000)]
    nodes = [m[0] for m in members]
    buckets = [rng.choice(nodes, size, replace=False) for size in [2] * 300 + [40] * 20 + [1200, 1]]
    rows = [(sig, int(x)) for sig, own in enumerate(buckets) for x in [*own, own[0]]]
    df = spark.createDataFrame(rows, "sig bigint, node bigint").repartition(3)
    known = spark.createDataFrame(members, "node bigint, n_shingles bigint")
    clusters = defaultdict(set)
    for r in ngram_join.placed_stars(df, known).collect():
        assert r["node"] not in clusters[r["cluster"]] and r["n_shingles"] == 50
        clusters[r["cluster"]].add(r["node"])
    assert all(any(set(own) <= found for found in clusters.values()) for own in buckets[:-1])
    assert sorted(map(len, clusters.values()))[-2:][0] <= 3 * ngram_join.PACK
