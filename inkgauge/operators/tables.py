"""Table candidates: OCR variants, priorities, summaries and scores."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame
from pyspark.sql.window import Window as W

from inkgauge.functions import fixed
from inkgauge.functions.patterns import any_pattern, table_patterns, table_text_score, upto
from inkgauge.functions.text import clamp, strip, unique


def first_by(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row of each key; ties must be settled by an ordinal in order."""
    return df.withColumn("_rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_rank = 1").drop("_rank")


def table_variants(tables: DataFrame, variants: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, table_id, label, label_no, text, status, patterns, score, text_length): each table's results by their names.

    variants: (key, name, ordinal, text, status). Of results with one name the last counts; names without a result are skipped.
    """
    named = first_by(variants, [key, "name"], F.desc("ordinal"))
    labels = F.array(*[F.struct(F.lit(i).alias("label_no"), F.lit(label).alias("label"), F.lit(suffix).alias("suffix")) for i, (label, suffix) in enumerate(fixed.TABLE_VARIANTS)])
    wanted = tables.select(key, "table_id", F.explode(labels).alias("v")).select(key, "table_id", "v.label", "v.label_no", F.concat("table_id", "v.suffix").alias("name"))
    got = wanted.join(named.drop("ordinal"), [key, "name"]).withColumn("text", F.coalesce("text", F.lit("")))
    got = got.withColumn("patterns", table_patterns(F.col("text")))
    return got.withColumn("score", table_text_score(F.col("patterns"), F.col("text"))).withColumn("text_length", F.length("text"))


def best_variant(found: DataFrame, key: str = "doc_id") -> DataFrame:
    return first_by(found, [key, "table_id"], F.desc("score"), F.desc("text_length"), "label_no")


def table_results(tables: DataFrame, variants: DataFrame, key: str = "doc_id") -> DataFrame:
    """tables with their best variant, its patterns, the table's priority and its effective candidacy."""
    best = best_variant(table_variants(tables, variants, key), key).select(key, "table_id", F.col("label").alias("best_variant"), "patterns", "score", "text_length")
    t = tables.join(best, [key, "table_id"], "left")
    patterns = any_pattern(F.col("patterns"))
    weak = ~F.coalesce(patterns, F.lit(False)) & (F.coalesce("text_length", F.lit(0)) < 100)
    reason = F.nullif(F.array_join(F.array_compact(F.array(F.nullif("filter_reason", F.lit("")), F.when(weak, "low_ocr_signal"))), ", "), F.lit(""))
    priority = F.col("candidate_priority_score") + F.coalesce("score", F.lit(0.0)) - F.when(weak, 4.0).otherwise(0.0)
    return t.select(
        key, "table_id", "ordinal", "best_variant", "patterns", "candidate_priority_score", priority.alias("table_priority_score"), reason.alias("filter_reason"),
        (F.col("is_candidate") & reason.isNull()).alias("is_candidate"),
    )


def merged(column: str, key: str) -> Column:
    """An array column's values over a group in the order of `ordinal`, distinct."""
    ordered = F.array_sort(F.collect_list(F.struct("ordinal", F.coalesce(F.col(column)[key], F.array().cast("array<string>")).alias("v"))))
    return unique(F.flatten(F.transform(ordered, lambda s: s["v"])))


def merged_values(rows: DataFrame, group: str, column: str, keys: tuple[str, ...]) -> DataFrame:
    """(group, keys...): an array column's distinct values over a group, in the order of `ordinal` and place.

    Values are made distinct by partial aggregation before a group's are put together, so a task holds a
    group's distinct values, which are the result, and not its rows. Groups without values have empty arrays.
    """
    of = lambda k: F.transform(F.coalesce(F.col(column)[k], F.array().cast("array<string>")), lambda v, i: F.struct(F.lit(k).alias("k"), i.alias("i"), v.alias("v")))
    each = rows.select(F.col(group).alias("g"), "ordinal", F.explode(F.concat(*[of(k) for k in keys])).alias("x"))
    first = each.groupBy("g", "x.k", "x.v").agg(F.min(F.struct("ordinal", "x.i")).alias("first"))
    ordered = lambda k: F.transform(F.array_sort(F.collect_list(F.when(F.col("k") == k, F.struct("first", "v")))), lambda s: s["v"]).alias(k)
    found = first.groupBy("g").agg(*[ordered(k) for k in keys])
    every = rows.select(group).distinct()
    none = F.array().cast("array<string>")
    return every.join(found, every[group].eqNullSafe(found["g"]), "left").select(group, *[F.coalesce(k, none).alias(k) for k in keys])


def table_summary(results: DataFrame, key: str = "doc_id") -> DataFrame:
    """A row for each document: counts, best table and why, merged patterns, warnings."""
    best = first_by(results, [key], F.desc("table_priority_score"), "ordinal").select(key, F.col("table_id").alias("best_table_id"), F.col("patterns").alias("_p"))
    n = lambda k: F.coalesce(F.size(F.col("_p")[k]), F.lit(0)) > 0
    why = F.when(n("urls"), "URL pattern detected").when(n("phones"), "Phone pattern detected").when(n("dates"), "Date pattern detected").otherwise("Highest table priority score")
    flagged = F.array_sort(F.collect_list(F.when(F.col("filter_reason").isNotNull(), F.struct("ordinal", F.concat("table_id", F.lit(" flagged: "), "filter_reason").alias("m")))))
    counts = results.groupBy(key).agg(
        F.count("*").alias("detected_count"), F.count_if("is_candidate").alias("candidate_count"), *[merged("patterns", k).alias("found_" + k) for k in fixed.TABLE_KEYS],
        F.transform(flagged, lambda s: s["m"]).alias("warnings"),
    )
    return counts.join(best, key).withColumn("best_table_reason", why).drop("_p")


def table_score(summary: DataFrame, tables: DataFrame, cells: DataFrame, key: str = "doc_id") -> DataFrame:
    """Score, ratios and warnings of a document's tables; one row for each row of summary.

    summary: (key, detected_count, candidate_count, best_table_id), counts null or 0 where unknown;
    tables: (key, table_id, table_priority_score, is_candidate); cells: (key, text, patterns).
    """
    t = tables.groupBy(key).agg(F.count("*").alias("_n"), F.count_if("is_candidate").alias("_c"), F.greatest(F.max(F.coalesce("table_priority_score", F.lit(0.0))), F.lit(0.0)).alias("_best"))
    c = cells.groupBy(key).agg(
        F.count("*").alias("_cells"), F.count_if(strip(F.coalesce("text", F.lit(""))) != "").alias("_full"), F.count_if(any_pattern(F.col("patterns"))).alias("_hits")
    )
    j = summary.join(t, key, "left").join(c, key, "left").fillna(0, ["_n", "_c", "_best", "_cells", "_full", "_hits"])
    seen = lambda own, other: F.coalesce(F.nullif(own, F.lit(0)), F.col(other))
    j = j.withColumn("detected", seen("detected_count", "_n")).withColumn("candidates", seen("candidate_count", "_c"))
    share = lambda x: F.col(x) / F.greatest("_cells", F.lit(1))
    score = upto(F.col("detected"), 3) * 0.18 + upto(F.col("candidates"), 2) * 0.18 + F.when(F.coalesce("best_table_id", F.lit("")) != "", 0.18).otherwise(0.0)
    score = score + upto(F.col("_best"), 100) * 0.20 + share("_full") * 0.18 + share("_hits") * 0.08
    warnings = F.array_compact(F.array(
        F.when(F.col("detected") == 0, fixed.NO_TABLE),
        F.when((F.col("_cells") > 0) & (share("_full") < 0.35), fixed.SPARSE_CELLS),
        F.when((F.col("_cells") == 0) & (F.col("_n") > 0), fixed.NO_CELLS),
    ))
    return j.select(
        key, clamp(score).alias("score"), F.col("detected").alias("detected_count"), F.col("candidates").alias("candidate_count"), "best_table_id",
        F.col("_best").alias("best_table_priority_score"), F.col("_cells").alias("cell_count"), share("_full").alias("non_empty_cell_ratio"), share("_hits").alias("cell_pattern_ratio"), warnings.alias("warnings"),
    )


def structure_hint(cells: DataFrame, *keys: str) -> DataFrame:
    """(keys..., structure_hint) from the number of URLs, dates, times and phones in a table's cells."""
    total = lambda k: F.sum(F.coalesce(F.size(F.col("patterns")[k]), F.lit(0)))
    n = cells.groupBy(*keys).agg(*[total(k).alias("_" + k) for k in ("urls", "dates", "times", "phones")])
    u, d, t, p = (F.col("_" + k) for k in ("urls", "dates", "times", "phones"))
    hint = (
        F.when(u >= 2, "multi_url_table_candidate").when((u == 1) & (d >= 2), "url_and_schedule_table").when(u == 1, "url_table_candidate")
        .when((d >= 3) | (t >= 2), "schedule_table_candidate").when(p >= 1, "contact_table_candidate").when((d >= 1) | (t >= 1), "date_or_time_table_candidate")
    )
    return n.select(*keys, hint.alias("structure_hint"))


def priority_tables(tables: DataFrame, key: str = "doc_id", most: int = 5) -> DataFrame:
    """The first tables by priority, by candidate score where that is 0 or null; ordinal settles ties."""
    p = F.coalesce(F.nullif("table_priority_score", F.lit(0.0)), F.nullif("candidate_priority_score", F.lit(0.0)), F.lit(0.0))
    return tables.withColumn("_p", p).withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(F.desc("_p"), "ordinal"))).where(F.col("rank") <= most).drop("_p")
