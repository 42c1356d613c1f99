"""Query registry: name -> callable over (spark, sf_dir), name -> DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from inkgauge.functions import edit, fixed, geometry, patterns, text
from inkgauge.operators import cells, highlights, layout, tables
from inkgauge.operators.lines import line_duplicates, line_islands, longest_first
from inkgauge.plans import fixtures, gate, sql


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark, sf_dir) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def _joined(c, sep="|"):
    return F.array_join(c, sep)


def text_profile(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", *text.profile(F.col("text")))


def normalize_text(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(text.normalized(F.col("text"))).alias("clean_md5"), F.length(text.normalized(F.col("text"))).alias("n_chars"))


def line_dedup(spark, sf_dir):
    kept = text.deduplicated(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", F.size(kept).alias("n_kept"), F.md5(F.array_join(kept, "\n")).alias("kept_md5"))


def line_quality(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", *text.line_counts(F.col("text")))


def text_quality_score(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", "text", *text.profile(F.col("text")), *text.line_counts(F.col("text")))
    return d.select("doc_id", text.text_score(F.col("text")).alias("score"), F.size(text.text_warnings(F.col("text"))).alias("n_warnings"))


def urls(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", _joined(F.array_sort(patterns.found(F.col("text"), fixed.URL, fixed.SHORT_URL))).alias("urls"))


def table_dates(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", _joined(F.array_sort(patterns.found(F.col("text"), fixed.TABLE_DATE, fixed.TABLE_SHORT_DATE))).alias("dates"))


def table_phones_times(spark, sf_dir):
    c = F.col("text")
    return _docs(spark, sf_dir).select("doc_id", _joined(F.array_sort(patterns.found(c, fixed.TABLE_PHONE))).alias("phones"), _joined(F.array_sort(patterns.found(c, fixed.TABLE_TIME))).alias("times"))


def table_text_score(spark, sf_dir):
    d = _docs(spark, sf_dir).withColumn("p", patterns.table_patterns(F.col("text")))
    return d.select("doc_id", patterns.table_text_score(F.col("p"), F.col("text")).alias("score"))


def rotation_score(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", patterns.rotation_score(F.col("text")).alias("score"))


def best_rotation(spark, sf_dir):
    d = _table(spark, sf_dir, "conversations").select("conv_id", "turn", patterns.rotation_score(F.coalesce("text", F.lit(""))).alias("score"))
    best = tables.first_by(d, ["conv_id"], F.desc("score"), "turn")
    return best.select("conv_id", F.when(F.col("score") > 0, F.col("turn")).otherwise(F.lit(0)).cast("long").alias("turn"), "score")


def doc_type_words(spark, sf_dir):
    both = fixtures.notices(spark)
    c = F.col("text")
    return both.select("doc_id", patterns.doc_type(c).alias("doc_type"), patterns.menu_words(c).cast("long").alias("menu_words"), patterns.notice_words(c).cast("long").alias("notice_words"))


def gate_patterns(spark, sf_dir):
    p = fixtures.notices(spark).select("doc_id", patterns.gate_patterns(F.col("text")).alias("p"))
    return p.select("doc_id", *[_joined(F.col("p")[k]).alias(k) for k in ("dates", "times", "amounts", "phones", "urls", "meal_dates", "nutrition_numbers", "allergy_numbers")])


def table_patterns(spark, sf_dir):
    p = fixtures.notices(spark).select("doc_id", patterns.table_patterns(F.col("text")).alias("p"))
    return p.select("doc_id", *[_joined(F.col("p")[k]).alias(k) for k in fixed.TABLE_KEYS])


def suspicious_urls(spark, sf_dir):
    c = F.col("text")
    bad = patterns.suspicious_urls(c, patterns.found(c, fixed.URL, fixed.SHORT_URL))
    return _docs(spark, sf_dir).select("doc_id", F.size(bad).alias("n_bad"), _joined(F.array_sort(bad)).alias("bad"))


def suspicious_phones(spark, sf_dir):
    c = F.col("text")
    bad = patterns.suspicious_phones(c, patterns.phones(c))
    return _docs(spark, sf_dir).select("doc_id", F.size(bad).alias("n_bad"), _joined(F.array_sort(bad)).alias("bad"))


def pattern_score(spark, sf_dir):
    d = gate.scored(_docs(spark, sf_dir), cleaned=True)
    return d.select("doc_id", "doc_type", "pattern_score", F.size("pattern_warnings").alias("n_warnings"))


def gate_decision(spark, sf_dir):
    d = gate.gate(_docs(spark, sf_dir))
    return d.select("doc_id", "doc_type", F.md5("clean").alias("clean_md5"), "text_score", "pattern_score", "garbage_ratio", "auto_pass", "route", _joined("reasons", "; ").alias("reasons"))


def route_counts(spark, sf_dir):
    d = gate.gate(_docs(spark, sf_dir), threshold=0.5)
    return d.groupBy("route").agg(F.count("*").alias("n"), F.count_if(F.array_contains("reasons", fixed.BELOW_THRESHOLD)).alias("n_below"), F.count_if(F.array_contains("reasons", fixed.NO_CORE)).alias("n_no_core"))


def gate_fixture(spark, sf_dir):
    d = gate.gate(fixtures.notices(spark), threshold=0.3)
    return d.select("doc_id", "doc_type", F.round("pattern_score", 6).alias("pattern_score"), "auto_pass", _joined("reasons", "; ").alias("reasons"))


def gate_vs_labels(spark, sf_dir):
    d = text_quality_score(spark, sf_dir).join(_table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    return d.groupBy("quality").agg(F.count("*").alias("n"), F.avg("score").alias("mean_score"))


def sections(spark, sf_dir):
    s = fixtures.notices(spark).select("doc_id", gate.sections(F.col("text")).alias("s"))
    return s.select("doc_id", "s.title", *[_joined(F.split(F.col("s")[k], "\n"), "/").alias(k) for k in ("notice", "meal_table", "origin_info", "public_report_info")])


def first_section(spark, sf_dir):
    full = text.full_lines(F.col("text"))
    first = F.array_min(F.transform(full, lambda x, i: F.when(x.rlike(r"(?U)\d{1,2}/\d{1,2}"), i)))
    return _docs(spark, sf_dir).select("doc_id", F.coalesce(first, F.lit(-1)).cast("long").alias("first_line"))


def model_input(spark, sf_dir):
    d = gate.model_input(_docs(spark, sf_dir))
    return d.select("doc_id", "original_length", "normalized_length", "line_count_before", "line_count_after", "removed_duplicate_lines")


def model_input_text(spark, sf_dir):
    d = gate.model_input(fixtures.notices(spark))
    return d.select("doc_id", F.replace("model_input_text", F.lit("\n"), F.lit("/")).alias("rendered"))


def _variants(spark, sf_dir):
    c = _table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("ordinal"), F.concat(F.lit("v"), F.col("turn")).alias("name"), F.lit("ok").alias("status"), F.coalesce("text", F.lit("")).alias("text"))


def best_variant(spark, sf_dir):
    n = _variants(spark, sf_dir).withColumn("n", text.normalized(F.col("text"))).where("n <> ''")
    n = n.select("*", *text.profile(F.col("n")), *text.line_counts(F.col("n"))).withColumn("quality", text.text_score(F.col("n")))
    return tables.first_by(n, ["doc_id"], F.desc("quality"), "ordinal").select("doc_id", "ordinal", "quality")


def priority_topk(spark, sf_dir):
    v = _variants(spark, sf_dir).select("doc_id", "ordinal", F.when(F.col("ordinal") % 2 == 0, F.length("text").cast("double")).otherwise(0.0).alias("table_priority_score"), (F.length("text") / 2).alias("candidate_priority_score"))
    return tables.priority_tables(v, "doc_id", 3).select("doc_id", "ordinal", F.col("rank").cast("long").alias("rank"))


def _pairs(spark, sf_dir):
    c = _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("truth"))
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("truth").alias("hyp"))
    return c.join(nxt, ["conv_id", "turn"])


def token_prf(spark, sf_dir):
    d = _pairs(spark, sf_dir).withColumn("a", edit.gate_tokens(F.col("truth"))).withColumn("b", edit.gate_tokens(F.col("hyp")))
    return d.select("conv_id", "turn", *edit.precision_recall(edit.multiset_overlap(F.col("a"), F.col("b")), F.size("a"), F.size("b")))


def char_prf(spark, sf_dir):
    d = _pairs(spark, sf_dir).withColumn("a", edit.characters(F.col("truth"))).withColumn("b", edit.characters(F.col("hyp")))
    return d.select("conv_id", "turn", *edit.precision_recall(edit.multiset_overlap(F.col("a"), F.col("b")), F.size("a"), F.size("b")))


def line_accuracy(spark, sf_dir):
    return _pairs(spark, sf_dir).select("conv_id", "turn", edit.line_accuracy(F.col("truth"), F.col("hyp")).alias("line_accuracy"))


def cer_ascii(spark, sf_dir):
    d = _pairs(spark, sf_dir).where(F.col("truth").rlike(r"^\p{ASCII}*$") & F.col("hyp").rlike(r"^\p{ASCII}*$"))
    return d.select("conv_id", "turn", edit.cer(F.col("truth"), F.col("hyp")).alias("cer"), edit.gate_cer(F.col("truth"), F.col("hyp")).alias("gate_cer"))


def evaluate(spark, sf_dir):
    d = gate.evaluate(_pairs(spark, sf_dir))
    return d.select("conv_id", "turn", "cer", "wer", "jamo_cer", "line_accuracy", "precision", "recall", "f1")


def metric_fixture(spark, sf_dir):
    d = gate.evaluate(fixtures.slot_cases(spark).select("case_id", F.col("expected").alias("truth"), F.col("raw").alias("hyp")))
    d = d.withColumn("distance", F.levenshtein("hyp", "truth"))
    return d.select("case_id", F.col("distance").cast("long").alias("distance"), F.round("cer", 9).alias("cer"), F.round("wer", 9).alias("wer"), F.round("jamo_cer", 9).alias("jamo_cer"))


def reference_metrics(spark, sf_dir):
    d = gate.reference_metrics(fixtures.slot_cases(spark), F.col("expected"), F.col("raw"))
    return d.select("case_id", *[F.round(c, 9).alias(c) for c in ("cer", "precision", "recall", "f1")])


def pattern_merge(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("ordinal"), patterns.table_patterns(F.coalesce("text", F.lit(""))).alias("patterns"))
    return tables.merged_values(d, "source", "patterns", ("urls", "dates")).select("source", *[_joined(F.array_sort(F.col(k))).alias(k) for k in ("urls", "dates")])


def word_lines(spark, sf_dir):
    got = layout.words_to_lines(fixtures.words(spark), "doc_id", "page")
    return got.select("doc_id", "page", "text", "x", "y", "width", "height")


def event_lines(spark, sf_dir):
    """Words laid out from events: the user's number is the page, the value the height."""
    e = _table(spark, sf_dir, "events").select(F.col("user_id").alias("page"), F.col("event_type").alias("text"), (F.col("event_id") % 1000).cast("double").alias("x0"), ((F.col("event_id") % 1000) + 5).cast("double").alias("x1"), F.col("value").alias("top"), (F.col("value") + 2).alias("bottom"))
    got = layout.words_to_lines(e.where("value is not null"), "page")
    return got.select("page", F.length("text").alias("n"), F.md5("text").alias("text_md5"), "x", "y", "width")


def box_iou(spark, sf_dir):
    b = fixtures.boxes(spark)
    a, c = b.alias("a"), b.alias("b")
    j = a.join(c, (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.ordinal") < F.col("b.ordinal")))
    x, y = geometry.box("a."), geometry.box("b.")
    u = geometry.union(x, y)
    return j.select(
        "a.doc_id", F.col("a.ordinal").alias("i"), F.col("b.ordinal").alias("j"), geometry.iou(x, y).alias("iou"), geometry.contains(x, y).alias("contains"), geometry.nearby(x, y).alias("nearby"),
        *[u[k].alias("u_" + k) for k in geometry.BOX],
    )


def box_padding(spark, sf_dir):
    p = geometry.padded(geometry.box(), F.col("image_w"), F.col("image_h"))
    return fixtures.boxes(spark).select("doc_id", "ordinal", *[p[k].alias("p_" + k) for k in geometry.BOX])


def box_containment(spark, sf_dir):
    return layout.without_contained(fixtures.boxes(spark), "doc_id").select("doc_id", "ordinal", *geometry.BOX)


def box_merge(spark, sf_dir):
    return layout.merge_boxes(fixtures.boxes(spark), "doc_id")


def table_boxes(spark, sf_dir):
    b = fixtures.boxes(spark)
    return layout.table_boxes(b, "doc_id", F.lit(1000), F.lit(1400)).select("doc_id", *geometry.BOX, "rank")


def geometry_score(spark, sf_dir):
    b = fixtures.boxes(spark).withColumn("density", (F.col("ordinal") % 5) * 0.02)
    got = b.select("doc_id", "ordinal", *geometry.geometry_flags(geometry.box(), F.col("image_w"), F.col("image_h"), F.col("density")))
    return got.withColumn("filter_reason", F.coalesce("filter_reason", F.lit("")))


def run_islands(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    e = e.select("user_id", "value", (F.row_number().over(W.partitionBy("user_id").orderBy("event_id")) - 1).alias("i"))
    got = layout.run_centers(e, "user_id", threshold=F.lit(50.0))
    return got.select("user_id", F.col("center").cast("long").alias("center"))


def _positions(spark, sf_dir):
    e = _table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_set((F.col("event_id") % 997).cast("int"))).alias("positions"))
    return e


def tolerance_dedup(spark, sf_dir):
    return _positions(spark, sf_dir).select("user_id", _joined(F.transform(layout.spaced(F.col("positions")), lambda x: x.cast("string")), ",").alias("kept"))


def boundaries(spark, sf_dir):
    b = layout.boundaries(F.col("positions"), F.lit(0), F.lit(1000))
    return _positions(spark, sf_dir).select("user_id", F.size(b).alias("n"), F.element_at(b, -2).alias("second_last"))


def line_parameters(spark, sf_dir):
    """The best of 27 line-detection settings over synthetic counts; the first of equals."""
    ratios, fractions = F.array(*map(F.lit, fixed.KERNEL_RATIOS)), F.array(*map(F.lit, fixed.LINE_FRACTIONS))
    u = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("table_id"))
    g = u.select("table_id", F.posexplode(ratios).alias("hi", "h_ratio")).select("*", F.posexplode(ratios).alias("vi", "v_ratio")).select("*", F.posexplode(fractions).alias("ti", "t_fraction"))
    g = g.withColumn("h", (F.col("table_id") * F.col("h_ratio") + F.col("ti")) % 9).withColumn("v", (F.col("table_id") + F.col("v_ratio") * (F.col("ti") + 1)) % 8)
    g = g.withColumn("score", geometry.line_count_score(F.col("h"), F.col("v")))
    return tables.first_by(g, ["table_id"], F.desc("score"), "hi", "vi", "ti").select("table_id", "h_ratio", "v_ratio", "t_fraction", "score")


def grids(spark, sf_dir):
    p = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") * 20).alias("w"), (F.col("p_partkey") % 700 + 50).cast("int").alias("h"))
    g = p.select("id", "w", "h", F.posexplode(geometry.grid_candidates(F.col("w"), F.col("h"))).alias("ordinal", "g"))
    b = geometry.uniform(F.col("w"), F.col("g.n_cols"))
    return g.select("id", "ordinal", "g.n_rows", "g.n_cols", _joined(F.transform(b, lambda x: x.cast("string")), ",").alias("col_boundaries"), geometry.columns_by_aspect(F.col("w"), F.col("h")).alias("cols"), geometry.rows_by_aspect(F.col("w"), F.col("h")).alias("rows"), geometry.grid_method(F.col("ordinal"), F.col("g.n_rows")).alias("method"))


def cell_limit(spark, sf_dir):
    """Cells in row-major order: tiny ones skipped, the first 30 kept with their zoom."""
    li = _table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("table_id"), F.col("l_orderkey").alias("row"), F.col("l_linenumber").alias("col"), F.col("l_quantity").alias("w"), (F.col("l_tax") * 1000).alias("h"))
    n = F.row_number().over(W.partitionBy("table_id").orderBy("row", "col", "w", "h"))
    kept = li.withColumn("n", n).where(F.col("n") <= fixed.MOST_CELLS)
    return kept.select("table_id", F.col("n").cast("long").alias("n"), F.when(cells.too_small(F.col("w"), F.col("h")), 0.0).otherwise(cells.zoom(F.col("w"), F.col("h"))).alias("zoom"))


def grid_cells(spark, sf_dir):
    """Cells of tables whose size is a part's: lines where its keys give some, else an even grid."""
    k = F.col("p_partkey")
    lines = lambda n, step: F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: (i * step).cast("int"))).otherwise(F.array().cast("array<int>"))
    p = _table(spark, sf_dir, "part").select(k.alias("id"), (F.col("p_size") * 20 + 100).cast("int").alias("width"), (k % 700 + 150).cast("int").alias("height"), (k % 3).cast("int").alias("_h"), (k % 2).cast("int").alias("_v"))
    p = p.select("id", "width", "height", lines(F.col("_h"), 40).alias("h_positions"), lines(F.col("_v") * 2, 30).alias("v_positions"), F.lit(3).alias("n_rows"), F.lit(4).alias("n_cols"))
    c = cells.grid_cells(cells.grid(p).select("id", "method", "row_boundaries", "col_boundaries"), "id", "method")
    return c.select("id", "method", "row", "col", "x", "y", "w", "h", F.coalesce("zoom", F.lit(0.0)).alias("zoom"))


def slot_corrections(spark, sf_dir):
    d = gate.slot_corrected(fixtures.slot_cases(spark), text_col="raw")
    return d.select("case_id", "corrected", F.size("corrections").alias("n"), F.coalesce("review_required", F.lit(False)).alias("review_required"))


def slot_corrections_documents(spark, sf_dir):
    d = gate.slot_corrected(_docs(spark, sf_dir))
    return d.select("doc_id", F.size("corrections").alias("n"), F.md5("corrected").alias("corrected_md5"))


def highlight_links(spark, sf_dir):
    lines = highlights.layout_lines(fixtures.layouts(spark), "doc_id", "layout")
    got = highlights.assign(fixtures.cards(spark), lines, "doc_id")
    return got.select("doc_id", "highlight_id", "page", "source", F.col("bbox.x").alias("x"), F.col("page_size.width").alias("page_width"), F.col("page_size.height").alias("page_height"), "category", F.round("importance", 3).alias("importance"))


def highlight_exact_substring(spark, sf_dir):
    """Benchmark items whose key lies in a document line's key, by a hash join on the key's first 24 characters' places."""
    d = _docs(spark, sf_dir).select("doc_id", F.posexplode(text.full_lines(F.col("text"))).alias("line", "t")).select("doc_id", "line", highlights.match_key(F.col("t")).alias("c"))
    b = _table(spark, sf_dir, "benchmark").select("item_id", highlights.match_key(F.col("text")).alias("q")).where(F.length("q") >= 24)
    grams = d.where(F.length("c") >= 24).select("doc_id", "line", "c", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("c") - 23), lambda i: F.xxhash64(F.substr("c", i, F.lit(24)))))).alias("g"))
    j = grams.join(b.withColumn("g", F.xxhash64(F.substring("q", 1, 24))), "g").where(F.contains(F.col("c"), F.col("q")))
    return j.select("item_id", "doc_id", F.col("line").cast("long").alias("line"), (F.length("q") / F.length("c")).alias("score")).distinct()


def table_results(spark, sf_dir):
    r = tables.table_results(fixtures.tables(spark), fixtures.variants(spark))
    return r.select("doc_id", "table_id", "best_variant", "table_priority_score", F.coalesce("filter_reason", F.lit("")).alias("filter_reason"), "is_candidate")


def table_summary(spark, sf_dir):
    s = tables.table_summary(tables.table_results(fixtures.tables(spark), fixtures.variants(spark)))
    return s.select("doc_id", "detected_count", "candidate_count", "best_table_id", "best_table_reason", _joined("found_urls").alias("found_urls"), _joined("found_dates").alias("found_dates"), _joined("warnings", "; ").alias("warnings"))


def _result_cells(spark):
    v = tables.table_variants(fixtures.tables(spark), fixtures.variants(spark))
    return v.select("doc_id", "table_id", F.col("label_no").alias("ordinal"), "text", "patterns", "label")


def table_score(spark, sf_dir):
    r = tables.table_results(fixtures.tables(spark), fixtures.variants(spark))
    s = tables.table_summary(r).select("doc_id", "detected_count", "candidate_count", "best_table_id").unionByName(spark.sql("SELECT 99L AS doc_id, 0L AS detected_count, 0L AS candidate_count, CAST(NULL AS STRING) AS best_table_id"))
    got = tables.table_score(s, r, _result_cells(spark))
    return got.select("doc_id", F.round("score", 9).alias("score"), "detected_count", "candidate_count", F.col("cell_count").cast("long").alias("cell_count"), F.round("non_empty_cell_ratio", 9).alias("non_empty_cell_ratio"), _joined("warnings", "; ").alias("warnings"))


def structure_hints(spark, sf_dir):
    return tables.structure_hint(_result_cells(spark), "doc_id", "table_id").withColumn("structure_hint", F.coalesce("structure_hint", F.lit("none")))


def ocr_text(spark, sf_dir):
    r = tables.table_results(fixtures.tables(spark), fixtures.variants(spark)).withColumn("ocr_text", F.lit(None).cast("string"))
    got = gate.ocr_text(fixtures.variants(spark), r, _result_cells(spark).select("doc_id", "table_id", "label", "text"), _result_cells(spark))
    return got.select("doc_id", F.replace("clean", F.lit("\n"), F.lit("/")).alias("clean"))


def collected_text(spark, sf_dir):
    v = _variants(spark, sf_dir).withColumn("path", F.concat(F.lit("p"), F.col("ordinal") % 3))
    got = gate.collected(v)
    return got.select("doc_id", F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"))


def gate_with_tables(spark, sf_dir):
    """The whole gate over result documents: chosen text, table score, decision."""
    r = tables.table_results(fixtures.tables(spark), fixtures.variants(spark)).withColumn("ocr_text", F.lit(None).cast("string"))
    clean = gate.ocr_text(fixtures.variants(spark), r, _result_cells(spark).select("doc_id", "table_id", "label", "text"), _result_cells(spark))
    score = tables.table_score(tables.table_summary(r).select("doc_id", "detected_count", "candidate_count", "best_table_id"), r, _result_cells(spark))
    s = gate.scored(clean, text_col="clean", cleaned=True).join(score.select("doc_id", F.col("score").alias("table_score"), "detected_count", F.col("warnings").alias("table_warnings")), "doc_id")
    d = gate.decide(s, table_mode=True)
    return d.select("doc_id", F.round("overall_score", 6).alias("overall_score"), "auto_pass", _joined("reasons", "; ").alias("reasons"))


def duplicate_lines(spark, sf_dir):
    return line_duplicates(_docs(spark, sf_dir))


def meal_months(spark, sf_dir):
    d = fixtures.notices(spark).select("doc_id", patterns.dominant_month(patterns.found(F.col("text"), fixed.MEAL_DATE)).alias("d"))
    return d.select("doc_id", _joined("d").alias("meal_dates"))


def score_islands(spark, sf_dir):
    return line_islands(_docs(spark, sf_dir))


def longest_lines(spark, sf_dir):
    return longest_first(_docs(spark, sf_dir), 3)


_NAMES = (
    "text_profile normalize_text line_dedup line_quality text_quality_score urls table_dates table_phones_times table_text_score rotation_score best_rotation doc_type_words gate_patterns "
    "table_patterns suspicious_urls suspicious_phones pattern_score gate_decision route_counts gate_fixture gate_vs_labels sections first_section model_input model_input_text best_variant priority_topk "
    "token_prf char_prf line_accuracy cer_ascii evaluate metric_fixture reference_metrics pattern_merge word_lines event_lines box_iou box_padding box_containment box_merge table_boxes geometry_score run_islands "
    "tolerance_dedup boundaries line_parameters grids cell_limit grid_cells slot_corrections slot_corrections_documents highlight_links highlight_exact_substring table_results table_summary table_score structure_hints "
    "ocr_text collected_text gate_with_tables duplicate_lines meal_months score_islands longest_lines"
).split()

QUERIES = {name: globals()[name] for name in _NAMES}
ORACLE_SQL: dict[str, str] = {name: text_ for name, text_ in sql.ORACLE_SQL.items() if name in QUERIES}
