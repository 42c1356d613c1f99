"""Text, result, layout and image files in; gate and model-input outputs out."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession

from inkgauge.sources.schemas import RESULT


def texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole text files."""
    return spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def results(spark: SparkSession, path: str) -> DataFrame:
    """Result documents with their path; unknown fields are ignored, missing ones null."""
    return spark.read.schema(RESULT).option("multiLine", True).json(path).withColumn("path", F.col("_metadata.file_path"))


def path_key(path: Column) -> Column:
    """A path without scheme and authority and without steps that stay in place; '..' stays as it is."""
    return F.regexp_replace(F.regexp_replace(path, "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", ""), r"(?<=^|/)(\./)+|/+(?=/)", "")


def places(base: Column, path: Column, cwd: str | None = None) -> Column:
    """Where a path found in a document of folder `base` may lie, in the order of trial.

    An absolute path lies there alone; a relative one under cwd, if given, under the folder, and
    under each folder above it but the root.
    """
    parts = F.split(base, "/")
    above = F.when(F.size(parts) >= 2, F.transform(F.sequence(F.size(parts), F.lit(2), F.lit(-1)), lambda i: F.concat_ws("/", F.array_join(F.slice(parts, 1, i), "/"), path))).otherwise(F.array().cast("array<string>"))
    first = F.array(F.concat(F.lit(cwd.rstrip("/") + "/"), path)) if cwd else F.array().cast("array<string>")
    return F.when(path.startswith("/"), F.array(path)).otherwise(F.concat(first, above))


def result_variants(found: DataFrame, texts_: DataFrame, cwd: str | None = None) -> DataFrame:
    """(path, o, name, status, text_path, text) of documents' and tables' OCR texts, o being their order.

    texts_ are (path, text). A text path is resolved from its result document's own folder, see places(), and met by
    equality; the first place that has a text counts, and a text that is nowhere is empty.
    """
    docs = found.select("path", F.posexplode("ocr_results").alias("n", "r")).select("path", F.struct(F.lit(0).alias("a"), "n", F.lit(0).alias("m")).alias("o"), "r.name", "r.status", "r.text_path")
    tables = found.select("path", F.posexplode("tables").alias("n", "t")).select("path", "n", "t.table_id", F.posexplode(F.map_entries("t.ocr_variants")).alias("m", "v"))
    tables = tables.select("path", F.struct(F.lit(1).alias("a"), "n", "m").alias("o"), F.concat_ws("_", "table_id", "v.key").alias("name"), "v.value.status", "v.value.text_path")
    every = docs.unionByName(tables).where("text_path is not null and text_path <> ''")
    base = F.regexp_replace(path_key(F.col("path")), "/[^/]*$", "")
    tried = every.select("path", "o", "name", "status", "text_path", F.posexplode_outer(places(base, path_key(F.col("text_path")), cwd)).alias("rank", "key"))
    named = texts_.groupBy(path_key(F.col("path")).alias("key")).agg(F.min("text").alias("text"))
    met = tried.join(named, "key", "left").groupBy("path", "o", "name", "status", "text_path")
    best = met.agg(F.min(F.when(F.col("text").isNotNull(), F.struct("rank", "text"))).alias("best"))
    return best.select("path", "o", "name", "status", "text_path", F.coalesce("best.text", F.lit("")).alias("text"))


def images(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of JPEG and PNG files."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return found.where(F.lower("path").rlike(r"\.(jpe?g|png)$")).select("path", "content")


def safe_stem(path: Column) -> Column:
    """A file's name without its extension, other characters than letters, digits, dot, line and dash as one underscore."""
    stem = F.trim(F.regexp_replace(F.substring_index(path, "/", -1), r"(?<=.)\.[^.]*$", ""))
    return F.regexp_replace(F.when(stem == "", "image").otherwise(stem), "[^A-Za-z0-9._-]+", "_")


def relative(path: Column, base: str) -> Column:
    """A path below base without base; other paths as they are."""
    folder = base.rstrip("/") + "/"
    return F.when(path.startswith(folder), F.substring(path, len(folder) + 1, 1 << 30)).otherwise(path)


def write_gate(decided: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """texts by route (verified and review), key_patterns and quality_report of decided documents.

    A document's text is under one route; the other route has none of it. Reports and patterns are JSON lines.
    """
    rest = [c for c in decided.columns if c not in ("clean", "patterns")]
    key = decided.columns[0]
    decided.select(key, F.concat("clean", F.lit("\n")).alias("text"), "route").write.mode(mode).partitionBy("route").parquet(f"{path}/texts")
    decided.select(key, "patterns").write.mode(mode).option("ignoreNullFields", False).json(f"{path}/key_patterns")
    decided.select(*rest).write.mode(mode).option("ignoreNullFields", False).json(f"{path}/quality_report")


def write_model_input(built: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """model_input_text, review_text (the same texts), key_patterns and normalization_report of plans.gate.model_input."""
    key = built.columns[0]
    for name in ("model_input_text", "review_text"):
        built.select(key, F.col("model_input_text").alias("text")).write.mode(mode).parquet(f"{path}/{name}")
    built.select(key, "patterns").write.mode(mode).option("ignoreNullFields", False).json(f"{path}/key_patterns")
    built.drop("model_input_text", "patterns", "sections").write.mode(mode).option("ignoreNullFields", False).json(f"{path}/normalization_report")


def write_texts(texts_: DataFrame, path: str, *keys: str, mode: str = "errorifexists") -> None:
    """Texts under a folder for each value of keys; for few values, such as a variant's name."""
    texts_.write.mode(mode).partitionBy(*keys).parquet(path)


def write_metrics(metrics: DataFrame, path: str, mode: str = "errorifexists") -> None:
    metrics.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_layouts(layouts: DataFrame, path: str, *lists: str, mode: str = "errorifexists") -> dict[str, int]:
    """Layouts as JSON lines; the number of layouts and of the entries in each list column."""
    layouts.write.mode(mode).option("ignoreNullFields", False).json(path)
    read = layouts.sparkSession.read.schema(layouts.schema).json(path)
    n = read.agg(F.count("*").alias("layouts"), *[F.coalesce(F.sum(F.coalesce(F.size(c), F.lit(0))), F.lit(0)).alias(c) for c in lists])
    return n.first().asDict()
