"""Files in: texts that result documents point to."""

import json

import pyspark.sql.functions as F
import pytest

from inkgauge.plans import gate
from inkgauge.sources import engine, files


def _write(path, body):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(body, encoding="utf-8")


def test_text_paths_are_resolved_from_their_own_document(spark, tmp_path):
    for name in ("a", "b"):
        _write(tmp_path / name / "ocr" / "original.txt", f"text of {name}")
    _write(tmp_path / "shared.txt", "above")
    absolute = str(tmp_path / "a" / "ocr" / "original.txt")
    for name in ("a", "b"):
        listed = ["ocr/original.txt", "./ocr/original.txt", "shared.txt", "nowhere.txt", absolute, "", None]
        found = {"ocr_results": [{"name": f"v{i}", "status": "ok", "text_path": p} for i, p in enumerate(listed)], "tables": []}
        _write(tmp_path / name / "result.json", json.dumps(found))
    got = files.result_variants(files.results(spark, str(tmp_path / "*" / "result.json")), files.texts(spark, f"{tmp_path}/*/ocr/*.txt").union(files.texts(spark, f"{tmp_path}/*.txt")))
    by = {(r["path"].split("/")[-2], r["name"]): r["text"] for r in got.collect()}
    assert by == {(n, v): t for n in "ab" for v, t in (("v0", f"text of {n}"), ("v1", f"text of {n}"), ("v2", "above"), ("v3", ""), ("v4", "text of a"))}


def test_working_folder_comes_first_and_no_results_give_no_rows(spark, tmp_path):
    _write(tmp_path / "e" / "x.txt", "own")
    _write(tmp_path / "w" / "x.txt", "working")
    _write(tmp_path / "e" / "result.json", json.dumps({"ocr_results": [{"name": "v", "status": "ok", "text_path": "x.txt"}]}))
    results, texts = files.results(spark, str(tmp_path / "e" / "result.json")), files.texts(spark, f"{tmp_path}/*/*.txt")
    assert [r["text"] for r in files.result_variants(results, texts).collect()] == ["own"]
    assert [r["text"] for r in files.result_variants(results, texts, cwd=str(tmp_path / "w")).collect()] == ["working"]
    assert files.result_variants(results.limit(0), texts).count() == 0


def test_gate_and_model_input_files(spark, tmp_path):
    docs = spark.createDataFrame([(1, "안내문입니다. 문의 02-123-4567\n" * 3), (2, None), (3, "")], "doc_id long, text string")
    decided = gate.decide(gate.scored(docs))
    key = decided.columns[0]
    files.write_gate(decided, str(tmp_path / "g"))
    assert {r[key] for r in spark.read.parquet(str(tmp_path / "g" / "texts")).collect()} == {1, 2, 3}
    assert spark.read.json(str(tmp_path / "g" / "quality_report")).count() == spark.read.json(str(tmp_path / "g" / "key_patterns")).count() == 3
    files.write_model_input(gate.model_input(docs), str(tmp_path / "m"))
    a, b = (spark.read.parquet(str(tmp_path / "m" / n)).orderBy("doc_id").collect() for n in ("model_input_text", "review_text"))
    assert a == b and len(a) == 3 and spark.read.json(str(tmp_path / "m" / "normalization_report")).count() == 3


def test_layout_counts_and_paths(spark, tmp_path):
    d = spark.createDataFrame([(1, ["a", "b"]), (2, None)], "page long, words array<string>")
    assert files.write_layouts(d, str(tmp_path / "l"), "words") == {"layouts": 2, "words": 2}
    got = spark.createDataFrame([("/a/b/c",), ("/x",), (None,)], "p string").select(files.relative(F.col("p"), "/a").alias("r")).collect()
    assert [r["r"] for r in got] == ["b/c", "/x", None]


def test_engine_settings(tmp_path, monkeypatch):
    monkeypatch.delenv(engine.COMMAND, raising=False)
    monkeypatch.setenv(engine.LANGUAGES, "from the environment")
    _write(tmp_path / "env", f"# {engine.COMMAND}=no\n\nno value\n{engine.COMMAND} = '{tmp_path}/none'\n{engine.LANGUAGES}=file\n")
    found = engine.settings(str(tmp_path / "env"))
    assert found == {engine.COMMAND: f"{tmp_path}/none", engine.LANGUAGES: "from the environment"}
    with pytest.raises(engine.EngineMissing):
        engine.available(found)
    with pytest.raises(engine.EngineMissing):
        engine.available({}, "no such program")
    assert engine.available({engine.COMMAND: str(tmp_path / "env")}) == str(tmp_path / "env")


def test_engine_errors(spark):
    def read(content, config):
        if content == b"bad":
            raise RuntimeError("unreadable")
        if content == b"lang":
            raise RuntimeError("Failed loading language 'kor'")
        return content.decode() + config

    rows = [(1, "a", b"x", "--psm 6", True), (1, "b", b"bad", None, None), (1, "c", b"y", None, False)]
    d = spark.createDataFrame(rows, "doc_id long, name string, content binary, config string, run_ocr boolean")
    got = {r["name"]: (r["text"], r["status"], r["error"]) for r in engine.recognised(d, read, "doc_id").collect()}
    assert got == {"a": ("x--psm 6", "ok", None), "b": ("", "runtime_error", "unreadable")}
    with pytest.raises(Exception, match="Failed loading language"):
        engine.recognised(spark.createDataFrame([(1, "a", b"lang")], "doc_id long, name string, content binary"), read, "doc_id").collect()
