"""Lines from words, runs and boundaries from profiles, boxes merged and pruned."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from inkgauge.functions import geometry
from inkgauge.functions.text import strip


def words_to_lines(words: DataFrame, *keys: str, tolerance: float = 4.0) -> DataFrame:
    """words (keys..., text, x0, x1, top, bottom) -> visual lines (keys..., text, x, y, width, height).

    Words belong to a line by top / tolerance, rounded half to even; one shuffle on the keys and bucket.
    Lines without text are left out; boxes are unrounded.
    """
    bucket = F.rint(F.coalesce("top", F.lit(0.0)) / tolerance).cast("long")
    by = words.withColumn("_bucket", bucket).groupBy(*keys, "_bucket")
    ordered = F.array_sort(F.collect_list(F.struct("x0", "top", "text")))
    got = by.agg(ordered.alias("_w"), F.min("x0").alias("x"), F.min("top").alias("y"), F.max("x1").alias("_r"), F.max("bottom").alias("_b"))
    text = strip(F.array_join(F.transform("_w", lambda w: w["text"]), " "))
    return got.select(*keys, text.alias("text"), "x", "y", (F.col("_r") - F.col("x")).alias("width"), (F.col("_b") - F.col("y")).alias("height")).where("text <> ''")


def run_centers(profile: DataFrame, *keys: str, threshold: Column) -> DataFrame:
    """profile (keys..., i, value), i gapless from 0 -> (keys..., center) of each run of values at threshold or above.

    The end of a run is the first place behind it; the center is rounded down.
    """
    w = W.partitionBy(*keys).orderBy("i")
    inside = F.col("value") >= threshold
    runs = profile.withColumn("_run", F.sum((~inside).cast("int")).over(w)).where(inside)
    return runs.groupBy(*keys, "_run").agg(F.floor((F.min("i") + F.max("i") + 1) / 2).cast("int").alias("center")).drop("_run")


def spaced(positions: Column, tolerance: int = 5) -> Column:
    """Of the sorted positions those more than tolerance behind the last kept one.

    The first kept one is the first given, as sorting starts behind it.
    """
    first = F.get(positions, F.lit(0))
    rest = F.slice(F.array_sort(positions), 2, F.greatest(F.size(positions) - 1, F.lit(0)))
    kept = F.aggregate(rest, F.array(first), lambda acc, p: F.when(p - F.element_at(acc, -1) > tolerance, F.array_append(acc, p)).otherwise(acc))
    return F.when(F.size(positions) > 0, kept).otherwise(positions)


def boundaries(positions: Column, start: Column, end: Column, tolerance: int = 5) -> Column:
    """start, the positions and end, thinned from the start; end is always last."""
    raw = F.concat(F.array_sort(positions), F.array(end))
    kept = F.aggregate(raw, F.array(start), lambda acc, p: F.when(p - F.element_at(acc, -1) > tolerance, F.array_append(acc, p)).otherwise(acc))
    return F.when(F.element_at(kept, -1) == end, kept).otherwise(F.array_append(kept, end))


def without_contained(boxes: DataFrame, key: str) -> DataFrame:
    """Boxes not contained in another box of their key; equal boxes don't contain each other.

    A hash join on the key with the containment as residual condition.
    """
    other = boxes.select(F.col(key).alias("_key"), *[F.col(k).alias("_" + k) for k in geometry.BOX])
    a, b = geometry.box("_"), geometry.box()
    differ = ~((a["x"] == b["x"]) & (a["y"] == b["y"]) & (a["width"] == b["width"]) & (a["height"] == b["height"]))
    return boxes.join(other, (F.col(key) == F.col("_key")) & differ & geometry.contains(a, b), "left_anti")


def merge_boxes(boxes: DataFrame, key: str) -> DataFrame:
    """Boxes (key, ordinal, x, y, width, height) merged in one pass, largest first.

    Each box goes into the first merged one it overlaps (IoU over 0.25) or lies near; the result
    depends on that order and isn't a transitive closure, so a key's boxes, a page's candidates, are one group.
    """

    def overlap(a, b) -> float:
        w = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])
        h = min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
        if w <= 0 or h <= 0:
            return 0.0
        both = w * h
        return both / (a[2] * a[3] + b[2] * b[3] - both)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ordinal")
        order = (pdf["width"] * pdf["height"]).sort_values(ascending=False, kind="stable").index
        out: list[list] = []
        for x, y, w, h in pdf.loc[order, list(geometry.BOX)].itertuples(index=False, name=None):
            for m in out:
                if overlap((x, y, w, h), m) > 0.25 or overlap((x - 12, y - 12, w + 24, h + 24), m) > 0.05:
                    right, bottom = max(m[0] + m[2], x + w), max(m[1] + m[3], y + h)
                    m[0], m[1] = min(m[0], x), min(m[1], y)
                    m[2], m[3] = right - m[0], bottom - m[1]
                    break
            else:
                out.append([x, y, w, h])
        return pd.DataFrame([(pdf[key].iloc[0], i, *m) for i, m in enumerate(out)], columns=[key, "ordinal", *geometry.BOX])

    kinds = {f.name: f.dataType.simpleString() for f in boxes.schema}
    schema = ", ".join(f"{c} {kinds[c]}" for c in (key, "ordinal", *geometry.BOX))
    return boxes.select(key, "ordinal", *geometry.BOX).groupBy(key).applyInPandas(run, schema)


def table_boxes(boxes: DataFrame, key: str, image_w: Column, image_h: Column, least_w: int = 100, least_h: int = 40, most: int = 10) -> DataFrame:
    """Raw contour boxes filtered, merged, pruned of contained ones, and the first by (y, x)."""
    area = F.col("width") * F.col("height")
    whole = image_w * image_h
    fit = boxes.where((F.col("width") >= least_w) & (F.col("height") >= least_h) & area.between(whole * 0.003, whole * 0.8))
    kept = without_contained(merge_boxes(fit, key), key)
    return kept.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy("y", "x", "ordinal"))).where(F.col("rank") <= most)
