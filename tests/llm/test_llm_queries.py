"""The registered queries over the small tables, and the pipeline stage by stage."""

import hashlib
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest

import corpus_pipeline
from lexgrain.llm import decontaminate, queries, simhash
from lexgrain.llm.shared import materialize

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query_runs(spark, name):
    got = queries.queries()[name](spark, SF).toPandas()
    assert len(got) > 0
    if name in queries.oracle_sql():
        c = duckdb.connect()
        c.execute(f"create view documents as select * from '{SF}/documents.parquet'")
        wanted = c.execute(queries.oracle_sql()[name]).df()
        key = got.columns[0]
        pd.testing.assert_frame_equal(got.sort_values(key).reset_index(drop=True), wanted[got.columns].sort_values(key).reset_index(drop=True), check_dtype=False)


def table(name, columns):
    return duckdb.sql(f"select {columns} from '{SF}/{name}.parquet' order by 1").fetchall()


def test_op1_against_the_full_edit_table(spark):
    """Least edits of each item at any place of each text, row by row over the whole text."""
    budget = decontaminate.Budget()
    items = [(i, decontaminate.plain(t)) for i, t in table("benchmark", "item_id, text")]
    code = lambda t: np.frombuffer(t.encode("utf-32-le"), np.uint32)
    wanted = {}
    for doc_id, text in table("documents", "doc_id, text"):
        text = code(decontaminate.plain(text))
        at = np.arange(len(text) + 1)
        for item_id, item in items:
            row = np.zeros(len(text) + 1, np.int64)
            for c in code(item):
                step = np.minimum(row[1:] + 1, row[:-1] + (text != c))
                row = np.minimum.accumulate(np.r_[row[0] + 1, step] - at) + at
            if row.min() <= budget.edits(len(item)):
                wanted[doc_id, item_id] = int(row.min())
    found = {}
    for r in queries.op1_benchmark_decontamination(spark, SF).collect():
        key = r["doc_id"], r["item_id"]
        found[key] = min(r["edits"], found.get(key, 99))
    assert wanted and found == wanted


def test_op3_by_its_law(spark):
    texts = dict(table("documents", "doc_id, text"))
    got = queries.op3_histogram_shards(spark, SF).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    sizes, slots = {}, {}
    for r in got:
        data = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 1, zlib.crc32(data), "bytes", None)
        sizes[r["shard"]] = sizes.get(r["shard"], 0) + r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    mean, most = sum(sizes.values()) / 16, max(r["size"] for r in got)
    assert set(sizes) == set(range(16)) and all(abs(x - mean) <= most + 0.02 * mean for x in sizes.values())
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_op6_against_direct_hashes(spark):
    pages = [(i, (h or "").encode()) for i, h in table("pages", "page_id, html")]
    first = {}
    for i, data in pages:
        first.setdefault(data, i)
    wanted = {i: (len(d), hashlib.sha256(d).hexdigest(), "revisit", first[d]) if len(d) >= 100 and first[d] != i else (len(d), hashlib.sha256(d).hexdigest(), "response", None) for i, d in pages}
    got = {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in queries.op6_warc_round_trip(spark, SF).collect()}
    assert got == wanted


def test_op7_rates_and_copies(spark):
    rows = table("documents", "doc_id, source")
    n = Counter(s for _, s in rows)
    weight = {s: k**0.5 for s, k in n.items()}
    rate = {s: weight[s] / sum(weight.values()) * len(rows) / n[s] for s in n}
    got = queries.op7_source_mixing(spark, SF).collect()
    of, source = {}, dict(rows)
    for r in got:
        assert abs(r["rate"] - rate[r["source"]]) < 1e-9 and r["source"] == source[r["doc_id"]]
        of.setdefault(r["doc_id"], []).append((r["copy"], r["copies"]))
    assert all(sorted(x) == [(k + 1, len(x)) for k in range(len(x))] for x in of.values())
    assert abs(len(got) - len(rows)) < 5 * len(rows) ** 0.5


def test_op10_against_brute_force(spark):
    rows = table("documents", "doc_id, text")
    prints = [int.from_bytes(simhash.fingerprint(t, 4, 64, 42), "big") for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4 and root[i] != root[j]:
                a, b = sorted((root[i], root[j]))
                root = [a if x == b else x for x in root]
    wanted = {rows[i][0]: (f"{prints[i]:016x}", rows[root[i]][0]) for i in range(len(rows))}
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op10_simhash_near_dedup(spark, SF).collect()} == wanted


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "simhash near-dedup", "benchmark decontamination", "source mixing", "sharding"]
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = materialize(stage(spark, docs, SF), "stage")
        if name == "sharding":
            assert docs.columns == [*columns, "shard", "slot"] and docs.count() == before.count()
        else:
            assert docs.columns == columns and docs.count() > 0
        if name == "benchmark decontamination":
            items = [decontaminate.plain(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            leaks = [r["doc_id"] for r in before.collect() if any(i in decontaminate.plain(r["text"]) for i in items)]
            kept = {r["doc_id"] for r in docs.collect()}
            assert leaks and not kept & set(leaks) and len(kept) == before.count() - len(leaks)
    assert corpus_pipeline.run(spark, SF).count() == docs.count()


def test_the_pipeline_on_empty_tables_and_on_odd_rows(spark, tmp_path):
    """No rows give no rows; null and empty texts and repeated rows pass the stages or go with the quality rules, columns stay."""
    docs, bench = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    docs.limit(0).write.parquet(f"file://{tmp_path}/leer/documents.parquet")
    bench.limit(0).write.parquet(f"file://{tmp_path}/leer/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}/leer").count() == 0
    good = docs.join(spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1"), "doc_id").select(docs.columns).limit(12)
    odd = spark.createDataFrame([(None, None, None, None, None), (-1, "", "de", "x", 0)], docs.schema)
    good.unionByName(good).unionByName(odd).withColumnRenamed("n_chars", "rate").write.parquet(f"file://{tmp_path}/odd/documents.parquet")
    bench.limit(0).write.parquet(f"file://{tmp_path}/odd/benchmark.parquet")
    kept = spark.read.parquet(f"file://{tmp_path}/odd/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:3]:
        kept = materialize(stage(spark, kept, f"file://{tmp_path}/odd"), name.replace(" ", "-"))
        assert kept.columns == ["doc_id", "text", "lang", "source", "rate"]
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids and len(ids) == len(set(ids)) and None not in ids and -1 not in ids
