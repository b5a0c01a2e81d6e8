import pytest
from pyspark.sql import functions as F

from quietroom.operators.ranking import hash_position, shuffled
from quietroom.operators.split import hash_split, stratified_split
from quietroom.sources.comments import (
    MissingLabels,
    missing_labels,
    project_comments,
    read_comments_csv,
)
from quietroom.sources.feedback import append_feedback, read_feedback, stamp_now
from quietroom.sources.reports import load_thresholds, with_default_thresholds, write_report

CSV = 'id,comment_text,toxic\n1,"He said ""hi""\nline, two",1\n2,null,0\n3,,0\n'


@pytest.fixture
def csv_file(tmp_path):
    path = tmp_path / "train.csv"
    path.write_text(CSV)
    return str(path)


def test_csv_quoting(spark, csv_file):
    rows = read_comments_csv(spark, csv_file, ["toxic"]).orderBy("id").collect()
    assert rows[0]["comment_text"] == 'He said "hi"\nline, two' and rows[0]["toxic"] == 1
    assert rows[1]["comment_text"] == "null" and rows[2]["comment_text"] is None
    rows = read_comments_csv(spark, csv_file, ["toxic"], null_value="null").orderBy("id").collect()
    assert rows[1]["comment_text"] is None


def test_csv_without_labels_or_id(spark, csv_file):
    assert read_comments_csv(spark, csv_file).columns == ["id", "comment_text"]
    keyed = read_comments_csv(spark, csv_file, id_col="key")
    assert keyed.select("id").distinct().count() == 3


def test_csv_copies_without_id_stay_apart(spark, tmp_path):
    path = tmp_path / "copies.csv"
    path.write_text("comment_text,toxic\n" + "same text,1\n" * 50 + "other,0\n" * 10)
    rows = read_comments_csv(spark, str(path), ["toxic"])
    assert rows.select("id").distinct().count() == 60
    assert stratified_split(rows).groupBy("split").count().count() == 3


def test_missing_labels(spark, csv_file):
    df = read_comments_csv(spark, csv_file, ["toxic"])
    assert missing_labels(df, ["toxic", "threat"]) == ["threat"]
    with pytest.raises(MissingLabels, match="threat"):
        project_comments(df, ["toxic", "threat"])


def test_thresholds_default(spark, tmp_path):
    known = spark.createDataFrame([("a", 0.7)], "label string, threshold double")
    got = dict(map(tuple, with_default_thresholds(known, ["a", "b"]).collect()))
    assert got == {"a": 0.7, "b": 0.5}
    assert load_thresholds(spark, str(tmp_path / "absent"), ["a"]) == {"a": 0.5}
    report = spark.createDataFrame(
        [({"a": 0.9000000000000002}, (0.5, 0.5, 0.5, 0.5, 0.5), (None, 0.1, 0.2, 0.3))],
        "thresholds map<string,double>, "
        "metrics struct<f1:double,precision:double,recall:double,roc_auc:double,pr_auc:double>, "
        "robustness struct<short_f1:double,long_f1:double,noisy_f1:double,noise_drop:double>",
    )
    path = str(tmp_path / "report")
    write_report(report, path)
    assert load_thresholds(spark, path, ["a", "b"]) == {"a": 0.9000000000000002, "b": 0.5}
    assert '"short_f1":null' in spark.read.text(path).first()[0]


def test_feedback_append(spark, tmp_path):
    path = str(tmp_path / "feedback")
    rows = [('say "no",\nplease', ["toxic", "insult"], "why?"), ("b", [], "")]
    events = stamp_now(
        spark.createDataFrame(rows, "text string, suggested_labels array<string>, user_comment string")
    )
    append_feedback(events, path)
    append_feedback(events, path)
    got = read_feedback(spark, path)
    assert got.count() == 4
    back = {(r["text"], tuple(r["suggested_labels"])) for r in got.collect()}
    assert back == {(t, tuple(l)) for t, l, _ in rows}
    assert got.where(F.col("timestamp").rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{6}$")).count() == 4


def brute_split(rows):
    import hashlib

    out = {}
    for cls in {c for _, c in rows}:
        ids = sorted(
            (hashlib.md5(f"42|{i}".encode()).hexdigest(), i) for i, c in rows if c == cls
        )
        n = len(ids)
        for rn, (_, i) in enumerate(ids, start=1):
            out[i] = "train" if rn * 10 <= 8 * n else "val" if rn * 10 <= 9 * n else "test"
    return out


@pytest.mark.parametrize("digits", [1, 4])
def test_stratified_split_matches_brute_force(spark, digits):
    rows = [(i, 0 if i % 3 else (None if i % 2 else 1)) for i in range(997)] + [(5000, 7)]
    df = spark.createDataFrame(rows, "id int, toxic int")
    got = {r["id"]: r["split"] for r in stratified_split(df, digits=digits).collect()}
    assert got == brute_split(rows)
    again = {r["id"]: r["split"] for r in stratified_split(df.repartition(7)).collect()}
    assert again == got


def test_hash_split_share(spark):
    df = spark.range(20000).select(hash_split(F.col("id")).alias("s"))
    share = df.where("s = 'train'").count() / 20000
    assert 0.78 < share < 0.82


def test_positions(spark):
    df = spark.range(500)
    got = hash_position(df).orderBy("position").collect()
    assert [r["position"] for r in got] == list(range(1, 501))
    assert [r["id"] for r in got] == [r["id"] for r in shuffled(df).collect()]
