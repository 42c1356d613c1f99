"""Result documents: built, written, read back, and taken through the gate."""

import json

import pyspark.sql.functions as F

from inkgauge.operators import tables
from inkgauge.plans import documents, fixtures
from inkgauge.sources.schemas import CELLS


def test_best_rotation(spark):
    rows = [(1, 0, "rotation_0", 1.0, None), (1, 1, "rotation_90", 5.0, "broken"), (1, 2, "rotation_180", 3.0, None), (1, 3, "rotation_270", 3.0, None), (2, 0, "rotation_0", 0.0, None), (2, 1, "rotation_90", -1.0, None), (3, 0, "rotation_0", 9.0, "broken")]
    got = {r["doc_id"]: r for r in documents.best_rotation(spark.createDataFrame(rows, "doc_id long, ordinal int, name string, score double, error string"), "doc_id").collect()}
    assert [(got[i]["best_rotation"], got[i]["rotation_score"]) for i in (1, 2, 3)] == [("rotation_180", 3.0), ("rotation_0", None), ("rotation_0", None)]
    assert len({got[i]["rotation_note"] for i in (1, 2, 3)}) == 3


def test_images_to_read(spark):
    d = spark.createDataFrame([("a", True), ("denoised", False), ("c", None)], "name string, run_ocr boolean")
    assert [r["name"] for r in documents.to_read(d).collect()] == ["a", "c"]


def _built(spark):
    t, v = fixtures.tables(spark), fixtures.variants(spark)
    v = v.withColumn("text_path", F.concat(F.lit("ocr/"), "name", F.lit(".txt"))).withColumn("error", F.lit(None).cast("string"))
    docs = t.select("doc_id").union(v.select("doc_id")).union(spark.createDataFrame([(-1,)], "doc_id long")).distinct()
    docs = docs.selectExpr("doc_id", "concat('in/page', doc_id, '.png') AS path", "'out' AS experiment_dir", "'kor+eng' AS lang", "'2025-01-01T00:00:00+00:00' AS created_at", "array('note') AS warnings")
    block = f"doc_id long, table_id string, cell_structure {CELLS}"
    some = t.where("ordinal = 0").select(F.col("doc_id").cast("long").alias("doc_id"), "table_id", F.from_json(F.lit('{"method":"uniform_grid","row_count":2}'), CELLS).alias("cell_structure"))
    return t, v, documents.results(docs, v, t, some.union(spark.createDataFrame([], block)))


def test_round_trip(spark, tmp_path):
    t, v, found = _built(spark)
    documents.write_results(found, str(tmp_path / "r"))
    got = {r["input"]["file_name"]: r for r in documents.read_results(spark, str(tmp_path / "r")).collect()}
    want = {r["input"]["file_name"]: r for r in found.drop("doc_id").collect()}
    assert got == want and len(got) == found.count()
    empty = got["page-1.png"]
    assert empty["tables"] == [] and empty["ocr_results"] == [] and empty["table_summary"]["detected_count"] == 0 and empty["table_summary"]["warnings"] == ["note"]
    raw = [json.loads(x) for p in (tmp_path / "r").glob("*.json") for x in p.read_text(encoding="utf-8").splitlines()]
    assert all(r["schema_version"] == "1.0" and "cell_structure" in x for r in raw for x in r["tables"])


def test_agrees_with_the_operators(spark):
    t, v, found = _built(spark)
    rows = {r["doc_id"]: r for r in found.collect()}
    for r in tables.table_results(t, v).collect():
        (one,) = [x for x in rows[r["doc_id"]]["tables"] if x["table_id"] == r["table_id"]]
        assert (one["table_priority_score"], one["is_candidate"], one["filter_reason"], one["best_table_ocr_variant"]) == (r["table_priority_score"], r["is_candidate"], r["filter_reason"], r["best_variant"])
        if r["best_variant"]:
            best = one["ocr_variants"][r["best_variant"]]
            assert best["score"] == max(x["score"] for x in one["ocr_variants"].values()) and best["text_path"].startswith(f"ocr/{r['table_id']}")
    for r in v.groupBy("doc_id").count().collect():
        assert len(rows[r["doc_id"]]["ocr_results"]) == r["count"]
