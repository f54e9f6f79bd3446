"""Publishing and resuming: what fails leaves the last good state, and a second run does only what is left."""

import random

import pytest
from pyspark.sql import functions as F

from lexgrain.operators import evidence
from lexgrain.sources import page_store, sinks
from lexgrain.sources.versions import Published, publish_with_report, run

SCHEMA = "abk string, norm_id string, text_hash string, n int"
NORMS = "abk string, norm_id string, text_hash string"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def failing(df):
    """df, whose last partition raises when it is read."""
    return df.repartition(2).withColumn("n", F.when(F.col("norm_id") == "böse", F.raise_error(F.lit("kaputt"))).otherwise(F.col("n")))


def test_a_failing_publish_leaves_the_last_version(spark, tmp_path):
    store = Published(spark, f"file://{tmp_path}/p", SCHEMA)
    assert rows(store.read()) == []
    first = [("a", "1", "h", 1), ("a", "2", "h", None), ("b", "1", "h", 1), (None, "1", "h", 1)]
    store.publish(spark.createDataFrame(first, SCHEMA))
    assert rows(store.read()) == sorted(first, key=str)
    with pytest.raises(Exception, match="kaputt"):
        store.publish(failing(spark.createDataFrame([("a", str(k), "h", 9) for k in range(50)] + [("a", "böse", "h", 9)], SCHEMA)))
    assert rows(store.read()) == sorted(first, key=str)
    store.publish(spark.createDataFrame([("a", "3", "neu", 2), (None, "2", "neu", 2)], SCHEMA))
    wanted = sorted([("a", "3", "neu", 2), ("b", "1", "h", 1), (None, "2", "neu", 2)], key=str)
    assert rows(store.read()) == wanted
    before = store.folder.names("data")
    store.vacuum(keep=1)
    assert len(before) == 3 and len(store.folder.names("data")) == 2 and rows(store.read()) == wanted


def test_a_manifest_without_an_end_is_not_followed(spark, tmp_path):
    store = Published(spark, f"file://{tmp_path}/p", SCHEMA)
    store.publish(spark.createDataFrame([("a", "1", "h", 1)], SCHEMA))
    (tmp_path / "p/manifest/2").mkdir()
    (tmp_path / "p/manifest/2/part-0.parquet").write_bytes(b"halb")
    assert rows(store.read()) == [("a", "1", "h", 1)]
    store.publish(spark.createDataFrame([("a", "1", "h", 2)], SCHEMA))
    assert rows(store.read()) == [("a", "1", "h", 2)]


def test_a_second_run_does_what_is_left(spark, tmp_path):
    store, done = Published(spark, f"file://{tmp_path}/p", SCHEMA), []
    norms = [("a", f"{k}", "h") for k in range(30)] + [("b", "1", "h"), ("b", "böse", "h")]

    def annotate(df, fail=False):
        done.extend((r["abk"], r["norm_id"]) for r in df.collect())
        return failing(df.withColumn("n", F.lit(1))) if fail else df.withColumn("n", F.lit(2))

    df = spark.createDataFrame(norms, NORMS)
    with pytest.raises(Exception, match="kaputt"):
        run(df, lambda x: annotate(x, fail=True), store, waves=5)
    kept = {(r["abk"], r["norm_id"]) for r in store.partial().collect()}
    assert rows(store.read()) == [] and set(done) >= kept
    done.clear()
    run(df, annotate, store, waves=5)
    assert sorted(done) == sorted({(a, n) for a, n, _ in norms} - kept)
    got = {(a, n): k for a, n, _, k in rows(store.read())}
    assert set(got) == {(a, n) for a, n, _ in norms} and all(got[k] == 1 for k in kept) and got["b", "böse"] == 2
    done.clear()
    run(df, annotate, store, waves=2)
    assert done == [] and store.folder.names("partial") == []
    run(spark.createDataFrame([("a", "1", "neu"), ("a", "2", "h")], NORMS), annotate, store)
    assert done == [("a", "1")] and [r[:3] for r in rows(store.read()) if r[0] == "a"] == [("a", "1", "neu"), ("a", "2", "h")]


def test_a_dry_run_writes_nothing(spark, tmp_path):
    table = spark.createDataFrame([("a", 1)], "abk string, n int")
    sinks.publish(table, f"file://{tmp_path}/q", dry_run=True)
    assert not (tmp_path / "q").exists()
    sinks.publish(table, f"file://{tmp_path}/q")
    assert rows(Published(spark, f"file://{tmp_path}/q", "abk string, n int").read()) == [("a", 1)]


@pytest.mark.parametrize("fail", [False, True])
def test_runs_of_a_budget_are_one_run_of_their_sum(spark, tmp_path, fail):
    draw = random.Random(4)
    norms = spark.createDataFrame([(draw.choice("ab"), str(k), f"h{k}", draw.randrange(9)) for k in range(20)], NORMS + ", seq int")
    asked = []

    def annotate(df):
        asked.extend((r["seq"], r["abk"], r["norm_id"]) for r in df.collect())
        return df.select("abk", "norm_id", "text_hash", F.col("seq").alias("n"))

    store, once = Published(spark, f"file://{tmp_path}/p", SCHEMA), Published(spark, f"file://{tmp_path}/q", SCHEMA)
    assert run(norms, annotate, once, waves=1, budget=18, order=("seq",))
    wanted, parts = sorted(asked), rows(once.partial())
    asked.clear()
    for k in range(3):
        if fail and k == 1:
            with pytest.raises(Exception, match="kaputt"):
                run(norms, lambda df: annotate(df).withColumn("n", F.when(F.col("norm_id") >= "0", F.raise_error(F.lit("kaputt"))).otherwise(1)), store, waves=1, budget=6, order=("seq",))
            asked = asked[:6]
        assert run(norms, annotate, store, waves=2, budget=6, order=("seq",)) and rows(store.read()) == []
    assert sorted(asked) == wanted and rows(store.partial()) == parts
    assert not run(norms, annotate, store, budget=6, order=("seq",)) and len(rows(store.read())) == 20 and rows(store.partial()) == []


def test_the_report_is_observed_while_writing(spark, tmp_path):
    schema = "abk string, norm_id string, markierbar boolean, abgelehnt array<string>"
    data = [("a", "1", True, ["x", "y"]), ("a", "2", None, None), ("b", "1", False, [])]
    store, runs = Published(spark, f"file://{tmp_path}/p", schema), spark.sparkContext.accumulator(0)
    table = spark.createDataFrame(data, schema).where(F.udf(lambda x: runs.add(1) or True, "boolean")("norm_id"))
    assert publish_with_report(table, store) == {"normen": 3, "markierbar": 1, "abgelehnt": 2} and runs.value == 3
    assert len(rows(store.read())) == 3
    assert publish_with_report(spark.createDataFrame([], schema), store) == {"normen": 0, "markierbar": 0, "abgelehnt": 0}


def test_only_changed_pages_are_read_again(spark, tmp_path):
    html = lambda k, more="": f"<h2>AEAO zu § {k}</h2><p>{'Text der Vorschrift ' * 5}{k}{more}</p>"
    pages = [(f"https://h/{k}.html", f"e{k}" if k % 2 else None, html(k)) for k in range(200)] + [(None, "e", "x"), ("https://h/leer.html", None, None)]
    frame = lambda ps: spark.createDataFrame(ps, "url string, etag string, html string")
    store = page_store.open_store(spark, f"file://{tmp_path}/s")
    assert page_store.refresh(frame(pages), store, parts=16) == 16
    before = {r["schluessel"]: r["version"] for r in store.manifest().collect()}
    assert page_store.refresh(frame(pages + pages), store, parts=16) == 0 and store.folder.names("manifest") == ["1"] and len(store.folder.names("data")) == 1
    newer = {4: html(4, " neu"), 6: html(6, " neu"), 7: html(7, " neu")}
    again = [(u, e, newer[k]) if k in newer else (u, e, h) for k, (u, e, h) in enumerate(pages)] + [("https://h/neu.html", "x", html(999))]
    n = page_store.refresh(frame(again), store, parts=16)
    after = {r["schluessel"]: r["version"] for r in store.manifest().collect()}
    assert 0 < n <= 3 and sum(after[k] != before[k] for k in after) == n
    got = {r["url"]: r["abschnitte"] for r in store.read().collect()}
    again[7] = pages[7]  # its etag says that it is the same
    assert got == {r["url"]: r["abschnitte"] for r in evidence.sections(frame(again)).where("url is not null").collect() if r["abschnitte"] is not None}
    assert page_store.refresh(frame(pages[:3]), store, parts=16) == 0 and store.read().count() == 202
