"""Result documents: built from OCR results and tables, written, read back and decided on."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.types import StructType

from inkgauge.functions import fixed
from inkgauge.operators.tables import best_variant, first_by, table_results, table_summary, table_variants
from inkgauge.sources.schemas import PATTERNS5, RESULT


def to_read(images: DataFrame) -> DataFrame:
    """The image variants that OCR reads; null counts as read."""
    return images.where(F.coalesce("run_ocr", F.lit(True)))


def best_rotation(candidates: DataFrame, *keys: str) -> DataFrame:
    """(keys..., best_rotation, rotation_score, rotation_note) of candidates (keys..., ordinal, name, score, error).

    Candidates with an error take no part; without a positive score the page stays as it is. The first of equals counts.
    """
    every = candidates.select(*keys).distinct()
    best = first_by(candidates.where("error is null"), list(keys), F.desc("score"), "ordinal").select(*keys, "name", "score")
    j = every.join(best, list(keys), "left")
    useful = F.coalesce(F.col("score") > 0, F.lit(False))
    note = F.when(F.col("name").isNull(), fixed.ROTATION_FAILED).when(useful, fixed.ROTATION_BEST).otherwise(fixed.ROTATION_USELESS)
    return j.select(*keys, F.when(useful, F.col("name")).otherwise("rotation_0").alias("best_rotation"), F.when(useful, F.col("score")).alias("rotation_score"), note.alias("rotation_note"))


def variant_maps(tables: DataFrame, variants: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, table_id, ocr_variants, best_table_ocr_variant): a table's results by label, in the labels' order.

    variants: (key, name, ordinal, text, status, text_path, error).
    """
    named = first_by(variants, [key, "name"], F.desc("ordinal")).select(key, "name", "text_path", "error")
    suffix = F.create_map(*[F.lit(x) for pair in fixed.TABLE_VARIANTS for x in pair])
    got = table_variants(tables, variants.select(key, "name", "ordinal", "text", "status"), key)
    best = best_variant(got, key).select(key, "table_id", F.col("label").alias("best_table_ocr_variant"))
    got = got.withColumn("name", F.concat("table_id", suffix[F.col("label")])).join(named, [key, "name"], "left")
    one = F.struct("text_path", F.col("patterns").cast(PATTERNS5).alias("patterns"), F.col("score").cast("double").alias("score"), F.col("text_length").cast("int").alias("text_length"), "status", "error")
    every = got.groupBy(key, "table_id").agg(F.array_sort(F.collect_list(F.struct("label_no", "label", one.alias("v")))).alias("_v"))
    return every.select(key, "table_id", F.map_from_entries(F.transform("_v", lambda x: F.struct(x["label"], x["v"]))).alias("ocr_variants")).join(best, [key, "table_id"], "left")


def _fields(df: DataFrame, kind: str, given: dict[str, Column]) -> Column:
    """A struct of the type `kind`: the given columns, else those of df by name, else nulls."""
    names = StructType.fromDDL(f"x {kind}")["x"].dataType
    of = lambda f: given.get(f.name, F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
    return F.struct(*[of(f) for f in names.fields])


def results(docs: DataFrame, variants: DataFrame, tables: DataFrame, structures: DataFrame, key: str = "doc_id") -> DataFrame:
    """A result document for each row of docs, as columns of the schema of results, beside the key.

    docs: (key, path, experiment_dir, lang, created_at, warnings); variants: (key, name, ordinal, status, text, text_path,
    debug_image_path, error), the documents' and the tables' texts; tables: (key, table_id, ordinal, candidate columns);
    structures: (key, table_id, cell_structure). Documents without results or tables have empty lists. All joins are on
    the document, and a list holds one document's results or tables.
    """
    schema = StructType.fromDDL(RESULT)
    element = lambda name: schema[name].dataType.elementType.simpleString()
    listed = variants.withColumn("text_length", F.length(F.coalesce("text", F.lit(""))))
    ocr = listed.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", _fields(listed, element("ocr_results"), {}).alias("r")))), lambda x: x["r"]).alias("ocr_results"))
    found = table_results(tables, variants.select(key, "name", "ordinal", "text", "status"), key)
    maps = variant_maps(tables, variants, key)
    kept = [c for c in tables.columns if c not in ("is_candidate", "filter_reason", "candidate_priority_score", "ordinal", "patterns", "cell_structure")]
    t = found.join(tables.select(*kept), [key, "table_id"], "left").join(maps, [key, "table_id"], "left").join(structures, [key, "table_id"], "left")
    path = lambda label: F.col("ocr_variants")[label]["text_path"]
    none = F.from_json(F.lit('{"urls":[],"phones":[],"dates":[],"times":[],"amounts":[]}'), PATTERNS5)
    given = {
        "ocr_text_path": path("default"), "zoom2x_ocr_text_path": path("zoom2x"), "zoom3x_ocr_text_path": path("zoom3x"),
        "patterns": F.coalesce(F.col("patterns").cast(PATTERNS5), none), "ocr_variants": F.coalesce("ocr_variants", F.map_from_arrays(F.array(), F.array()).cast(schema["tables"].dataType.elementType["ocr_variants"].dataType)),
    }
    blocks = t.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "table_id", F.to_json(_fields(t, element("tables"), given)).alias("t")))), lambda x: F.from_json(x["t"], element("tables"))).alias("tables"))
    summary = table_summary(found, key)
    summaries = summary.select(key, _fields(summary, schema["table_summary"].dataType.simpleString(), {}).alias("table_summary"))
    d = docs.join(ocr, key, "left").join(blocks, key, "left").join(summaries, key, "left")
    empty = F.array().cast("array<string>")
    noted = F.coalesce("warnings", empty) if "warnings" in docs.columns else empty
    zero = F.from_json(F.lit('{"detected_count":0,"candidate_count":0,"found_urls":[],"found_phones":[],"found_dates":[],"found_times":[],"found_amounts":[],"warnings":[]}'), schema["table_summary"].dataType)
    block = F.coalesce("table_summary", zero)
    return d.select(
        key, F.lit("1.0").alias("schema_version"), F.col("created_at").cast("string").alias("created_at"),
        F.struct("path", F.substring_index("path", "/", -1).alias("file_name")).alias("input"), "experiment_dir",
        F.struct(F.lit(fixed.ENGINE).alias("name"), "lang").alias("ocr_engine"), F.coalesce("ocr_results", F.array().cast(schema["ocr_results"].dataType)).alias("ocr_results"),
        F.coalesce("tables", F.array().cast(schema["tables"].dataType)).alias("tables"),
        block.withField("warnings", F.concat(noted, F.coalesce(block["warnings"], empty))).alias("table_summary"), noted.alias("warnings"),
        F.array(*map(F.lit, fixed.CAUTIONS)).alias("cautions"), F.array(*map(F.lit, fixed.TODO)).alias("todo"),
    )


def write_results(found: DataFrame, path: str, key: str = "doc_id", mode: str = "errorifexists") -> None:
    """Result documents as JSON lines, nulls written; read_results() reads them back."""
    found.drop(key).write.mode(mode).option("ignoreNullFields", False).json(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RESULT).json(path)
