"""Composite queries: the quality gate, model input, evaluation and choice of OCR text."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from inkgauge.functions import edit, fixed, patterns, text
from inkgauge.operators import slots
from inkgauge.operators.tables import first_by, priority_tables


def scored(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", cleaned: bool = False) -> DataFrame:
    """(id_col, clean, patterns, counts, doc_type, text_score, garbage_ratio, pattern_score, text and pattern warnings).

    Everything is narrow: a text is cleaned, matched and scored where it lies.
    """
    t = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(id_col, (t if cleaned else text.clean(t)).alias("clean"))
    c = F.col("clean")
    base = base.select(id_col, "clean", patterns.gate_patterns(c).alias("patterns"), patterns.doc_type(c).alias("doc_type"), *text.profile(c), *text.line_counts(c))
    p = F.col("patterns")
    base = base.withColumn("suspicious_urls", patterns.suspicious_urls(c, p["urls"])).withColumn("suspicious_phones", patterns.suspicious_phones(c, p["phones"]))
    return base.select(
        id_col, "clean", "patterns", "doc_type", "suspicious_urls", "suspicious_phones",
        text.text_score(c).alias("text_score"), text.ratio(F.col("garbage"), F.col("total")).alias("garbage_ratio"), text.text_warnings(c).alias("text_warnings"),
        patterns.pattern_score(p, F.col("doc_type"), c).alias("pattern_score"),
        patterns.pattern_warnings(p, F.col("doc_type"), F.col("suspicious_urls"), F.col("suspicious_phones")).alias("pattern_warnings"),
    )


def decide(df: DataFrame, *, threshold: float = fixed.THRESHOLD, table_mode: bool = False, reference: bool = False) -> DataFrame:
    """df with overall_score, reasons, auto_pass and route.

    df has what scored() gives; in table mode also table_score, detected_count and table_warnings, with a
    reference also f1 and cer. Scores enter rounded to four places, as reports carry them.
    """
    four = lambda c: F.round(F.col(c), 4)
    with_table = F.col("detected_count") > 0 if table_mode else F.lit(False)
    pair = lambda i: F.when(with_table, fixed.WEIGHTS_TABLE[i]).otherwise(fixed.WEIGHTS_TEXT[i])
    overall = four("text_score") * pair(0) + four("pattern_score") * pair(1) + (four("table_score") * pair(2) if table_mode else F.lit(0.0))
    soft = lambda m: ((m == fixed.BROKEN_URLS) & (F.size("patterns.urls") > 0)) | ((m == fixed.BROKEN_PHONES) & (F.size("patterns.phones") > 0))
    parts = [
        F.array_compact(F.array(F.when(overall < threshold, fixed.BELOW_THRESHOLD), F.when(four("garbage_ratio") > 0.10, fixed.GARBAGE_REASON))),
        F.filter("pattern_warnings", lambda m: ~soft(m)),
    ]
    if table_mode:
        parts.append(F.col("table_warnings"))
    if reference:
        parts.append(F.array_compact(F.array(F.when(F.col("f1") < fixed.TARGET_F1, fixed.F1_REASON), F.when(F.col("cer") > fixed.TARGET_CER, fixed.CER_REASON))))
    reasons = F.array_distinct(F.concat(*parts))
    out = df.withColumn("overall_score", text.clamp(overall)).withColumn("reasons", reasons).withColumn("auto_pass", F.size("reasons") == 0)
    return out.withColumn("route", F.when(F.col("auto_pass"), "verified").otherwise("review"))


def gate(docs: DataFrame, *, threshold: float = fixed.THRESHOLD, **columns) -> DataFrame:
    """The quality gate over raw texts: clean, score, decide."""
    return decide(scored(docs, **columns), threshold=threshold)


def reference_metrics(df: DataFrame, truth: Column, hyp: Column) -> DataFrame:
    """df with the gate's cer, precision, recall and f1 of hyp against truth."""
    df = df.withColumn("_t", edit.gate_tokens(truth)).withColumn("_h", edit.gate_tokens(hyp)).withColumn("cer", edit.gate_cer(truth, hyp))
    hit = edit.multiset_overlap(F.col("_t"), F.col("_h"))
    return df.withColumn("_hit", hit).select("*", *edit.precision_recall(F.col("_hit"), F.size("_t"), F.size("_h"))).drop("_t", "_h", "_hit")


def evaluate(pairs: DataFrame, *, truth: str = "truth", hyp: str = "hyp") -> DataFrame:
    """pairs with cer, wer, jamo_cer, line_accuracy and character precision, recall and f1."""
    df = pairs.withColumn("_a", edit.eval_normalized(F.col(truth))).withColumn("_b", edit.eval_normalized(F.col(hyp)))
    a, b = F.col("_a"), F.col("_b")
    df = df.withColumn("_x", edit.characters(a)).withColumn("_y", edit.characters(b))
    df = df.withColumn("_hit", edit.multiset_overlap(F.col("_x"), F.col("_y")))
    return df.select(
        "*", edit.cer(a, b).alias("cer"), edit.wer(a, b).alias("wer"), edit.jamo_cer(a, b).alias("jamo_cer"), edit.line_accuracy(a, b).alias("line_accuracy"),
        *edit.precision_recall(F.col("_hit"), F.size("_x"), F.size("_y")),
    ).drop("_a", "_b", "_x", "_y", "_hit")


def sections(c: Column) -> Column:
    """Struct of title, notice, meal_table, origin_info and public_report_info of a clean text."""
    first = lambda full, pattern: F.array_min(F.transform(full, lambda x, i: F.when(x.rlike(pattern), i)))
    marks = lambda full: F.struct(*[first(full, p).alias(k) for k, p in (("meal", fixed.MEAL_START), ("origin", fixed.ORIGIN_START), ("public", fixed.PUBLIC_START), ("title", fixed.TITLE_START))])

    def cut(full: Column, start: Column, ends: list[Column], most: int) -> Column:
        near = F.array_min(F.array(*[F.when(e > start, e) for e in ends]))
        end = F.coalesce(near, F.least(start + most, F.size(full)))
        return F.when(start.isNotNull(), F.array_join(F.slice(full, start + 1, F.greatest(end - start, F.lit(0))), "\n")).otherwise("")

    def sliced(full: Column, m: Column) -> Column:
        return F.struct(
            F.coalesce(F.get(full, F.coalesce(m["title"], F.lit(0))), F.lit("")).alias("title"),
            cut(full, F.lit(0), [m["meal"], m["origin"], m["public"]], 30).alias("notice"),
            cut(full, m["meal"], [m["origin"], m["public"]], 120).alias("meal_table"),
            cut(full, m["origin"], [m["public"]], 80).alias("origin_info"),
            F.when(m["public"].isNotNull(), F.array_join(F.slice(full, m["public"] + 1, 30), "\n")).otherwise("").alias("public_report_info"),
        )

    return text.let(text.full_lines(c), lambda full: text.let(marks(full), lambda m: sliced(full, m)))


def limited(block: Column, most: int) -> Column:
    """Lines of a section without noise lines, at most so many."""
    kept = F.filter(F.split(block, "\n"), lambda x: (text.strip(x) != "") & ~text.is_noise(x, 0.25))
    return text.strip(F.array_join(F.slice(kept, 1, most), "\n"))


def rendered(s: Column, p: Column) -> Column:
    """The labelled blocks a reader or model gets, always with the caution last."""
    block = lambda key, body: F.when(body != "", F.concat(F.lit(fixed.BLOCKS[key] + "\n"), body))
    listed = F.array_compact(F.array(*[F.when(F.size(p[k]) > 0, F.concat(F.lit(label + ": "), F.array_join(F.slice(p[k], 1, fixed.VALUE_CAP), ", "))) for label, k in fixed.PATTERN_LABELS]))
    numbers = lambda k: F.array_join(F.slice(p[k], 1, fixed.NUMBER_CAP), "\n")
    parts = [
        block("title", limited(s["title"], 1)), block("notice", limited(s["notice"], 20)), block("meal_table", limited(s["meal_table"], 80)), block("patterns", F.array_join(listed, "\n")),
        block("nutrition", numbers("nutrition_numbers")), block("allergy", numbers("allergy_numbers")), block("origin_info", limited(s["origin_info"], 40)),
        block("public_report_info", limited(s["public_report_info"], 30)), F.lit(fixed.CAUTION),
    ]
    return F.concat(F.array_join(F.array_compact(F.array(*parts)), "\n\n"), F.lit("\n"))


def model_input(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, model_input_text, patterns, original_length, normalized_length, line counts before and after, removed)."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(id_col, F.length(t).alias("original_length"), text.normalized(t).alias("_n"))
    base = base.withColumn("clean", text.strip(F.array_join(text.deduplicated(F.col("_n")), "\n")))
    base = base.withColumn("patterns", patterns.gate_patterns(F.col("clean"))).withColumn("sections", sections(F.col("clean")))
    before, after = F.size(text.full_lines(F.col("_n"))), F.size(text.full_lines(F.col("clean")))
    return base.select(
        id_col, rendered(F.col("sections"), F.col("patterns")).alias("model_input_text"), "patterns", "sections", "original_length", F.length("clean").alias("normalized_length"),
        before.alias("line_count_before"), after.alias("line_count_after"), F.greatest(before - after, F.lit(0)).alias("removed_duplicate_lines"),
    )


def best_documents(variants: DataFrame, key: str = "doc_id") -> DataFrame:
    """The best document-level text variant of each key by text score; the first one wins a tie.

    variants: (key, name, ordinal, status, text). Table and cell variants and blank texts don't take part.
    """
    mine = variants.where((F.col("status") == "ok") & ~F.col("name").startswith("table_") & ~F.col("name").startswith("cell_") & (text.strip(F.coalesce("text", F.lit(""))) != ""))
    n = mine.withColumn("_n", text.normalized(F.col("text")))
    n = n.select("*", *text.profile(F.col("_n")), *text.line_counts(F.col("_n"))).withColumn("quality", F.round(text.text_score(F.col("_n")), 4))
    return first_by(n, [key], F.desc("quality"), "ordinal").select(key, "name", "text", "quality")


def ocr_text(variants: DataFrame, tables: DataFrame, table_texts: DataFrame, cells: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, clean): a result's texts in fixed order, normalised and deduplicated.

    First the best document variant, then the priority tables' texts (best variant, then the common
    ones), then cells with patterns, then the fallback variants. variants as for best_documents();
    tables: (key, table_id, ordinal, priorities, best_variant, ocr_text); table_texts: (key, table_id, label, text);
    cells: (key, ordinal, text, patterns).
    """
    chunk = lambda df, stage, a, b=F.lit(0): df.select(key, F.lit(stage).alias("stage"), a.cast("long").alias("a"), b.cast("long").alias("b"), F.coalesce("text", F.lit("")).alias("text"))
    top = priority_tables(tables, key)
    has = table_texts.select(key, "table_id", F.col("label").alias("best_variant"), "text")
    best = top.join(has, [key, "table_id", "best_variant"], "left").withColumn("text", F.coalesce("text", "ocr_text")).where("text is not null")
    order = F.array_position(F.array(*map(F.lit, fixed.CHUNK_VARIANTS)), F.col("label"))
    more = top.select(key, "table_id", "rank").join(table_texts.where(F.col("label").isin(*fixed.CHUNK_VARIANTS)), [key, "table_id"])
    hits = cells.where(patterns.any_pattern(F.col("patterns")) & (text.strip(F.coalesce("text", F.lit(""))) != "")).withColumn("text", text.strip(F.col("text")))
    late = variants.where((F.col("status") == "ok") & F.col("name").isin(*fixed.FALLBACK_NAMES))
    every = (
        chunk(best_documents(variants, key), 1, F.lit(0))
        .unionByName(chunk(best, 2, F.col("rank")))
        .unionByName(chunk(more, 2, F.col("rank"), order))
        .unionByName(chunk(hits, 3, F.col("ordinal")))
        .unionByName(chunk(late, 4, F.col("ordinal")))
    )
    joined = every.where(text.strip(F.col("text")) != "").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("stage", "a", "b", "text"))).alias("_c"))
    whole = F.array_join(F.transform("_c", lambda c: c["text"]), "\n")
    return joined.select(key, text.clean(whole).alias("clean"))


def collected(variants: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, text): every distinct text path's text in order, joined by a blank line; any status counts.

    variants: (key, ordinal, path, text) with documents' before tables'.
    """
    once = first_by(variants, [key, "path"], "ordinal")
    parts = once.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ordinal", F.coalesce("text", F.lit("")).alias("text")))).alias("_c"))
    return parts.select(key, F.array_join(F.transform("_c", lambda c: c["text"]), "\n\n").alias("text"))


def slot_corrected(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """docs with corrected text, the kept corrections and whether one needs review."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.withColumn("corrections", slots.applied(slots.find_corrections(t)))
    return df.withColumn("corrected", slots.corrected(t, F.col("corrections"))).withColumn("review_required", F.exists("corrections", lambda c: c["review_required"]))

