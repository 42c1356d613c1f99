"""Boxes (x, y, width, height) and grids, as Column functions."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column

from inkgauge.functions import fixed

BOX = ("x", "y", "width", "height")


def box(prefix: str = "") -> dict[str, Column]:
    return {k: F.col(prefix + k) for k in BOX}


def iou(a: dict, b: dict) -> Column:
    """Intersection over union; 0 where boxes only touch."""
    wide = F.least(a["x"] + a["width"], b["x"] + b["width"]) - F.greatest(a["x"], b["x"])
    high = F.least(a["y"] + a["height"], b["y"] + b["height"]) - F.greatest(a["y"], b["y"])
    both = wide * high
    either = a["width"] * a["height"] + b["width"] * b["height"] - both
    return F.when((wide <= 0) | (high <= 0) | (either == 0), 0.0).otherwise(both / F.when(either != 0, either))


def union(a: dict, b: dict) -> dict[str, Column]:
    x, y = F.least(a["x"], b["x"]), F.least(a["y"], b["y"])
    return {"x": x, "y": y, "width": F.greatest(a["x"] + a["width"], b["x"] + b["width"]) - x, "height": F.greatest(a["y"] + a["height"], b["y"] + b["height"]) - y}


def contains(outer: dict, inner: dict) -> Column:
    """Edges may touch."""
    return (
        (outer["x"] <= inner["x"]) & (outer["y"] <= inner["y"])
        & (outer["x"] + outer["width"] >= inner["x"] + inner["width"]) & (outer["y"] + outer["height"] >= inner["y"] + inner["height"])
    )


def nearby(a: dict, b: dict, margin: int = 12, least: float = 0.05) -> Column:
    wider = {"x": a["x"] - margin, "y": a["y"] - margin, "width": a["width"] + 2 * margin, "height": a["height"] + 2 * margin}
    return iou(wider, b) > least


def padded(a: dict, image_w: Column, image_h: Column, by: int = 20) -> dict[str, Column]:
    left, top = F.greatest(a["x"] - by, F.lit(0)), F.greatest(a["y"] - by, F.lit(0))
    return {"x": left, "y": top, "width": F.least(a["x"] + a["width"] + by, image_w) - left, "height": F.least(a["y"] + a["height"] + by, image_h) - top}


def uniform(size: Column, n: Column) -> Column:
    """n + 1 boundaries of a side cut into n, rounded half to even."""
    return F.transform(F.sequence(F.lit(0), n), lambda i: F.rint(size * i / n).cast("int"))


def columns_by_aspect(w: Column, h: Column) -> Column:
    return F.when(F.when(h > 0, w / F.when(h > 0, h)).otherwise(1.0) >= 3.0, 3).otherwise(2)


def rows_by_aspect(w: Column, h: Column) -> Column:
    aspect = F.when(h > 0, w / F.when(h > 0, h)).otherwise(1.0)
    return F.when(aspect < 0.5, 4).when(aspect < 1.0, 3).otherwise(2)


def grid_candidates(w: Column, h: Column) -> Column:
    """Array of (n_rows, n_cols) to try for a table of that aspect, at most 20 cells each."""
    aspect = F.when(h > 0, w / F.when(h > 0, h)).otherwise(1.0)
    listed = lambda g: F.array(*[F.struct(F.lit(r).alias("n_rows"), F.lit(c).alias("n_cols")) for r, c in g if r * c <= fixed.MOST_GRID_CELLS])
    out = listed(fixed.GRIDS[-1][1])
    for least, grids in reversed(fixed.GRIDS[:-1]):
        out = F.when(aspect >= least, listed(grids)).otherwise(out)
    return out


def line_count_score(h: Column, v: Column) -> Column:
    side = lambda n: F.when(n == 0, 0.0).otherwise(F.least(n, F.lit(5)) - F.greatest(n - 5, F.lit(0)) * 0.5)
    return side(h) + side(v) + F.when((h > 0) & (v > 0), 2.0).otherwise(0.0)


def grid_method(n_rows: Column, n_cols: Column) -> Column:
    """By the number of boundaries found on each axis."""
    h, v = n_rows >= 3, n_cols >= 3
    return F.when(h & v, "line_split").when(h, "line_split_rows_only").when(v, "line_split_cols_only").otherwise("uniform_grid")


def geometry_flags(a: dict, image_w: Column, image_h: Column, density: Column, least_w: int = 100, least_h: int = 40) -> list[Column]:
    """Flags of a table candidate, its reasons and its priority."""
    area, whole = a["width"] * a["height"], image_w * image_h
    share = F.when(whole > 0, area / F.when(whole > 0, whole)).otherwise(0.0)
    aspect = F.when(a["height"] > 0, a["width"] / F.when(a["height"] > 0, a["height"])).otherwise(0.0)
    small = (a["width"] < least_w) | (a["height"] < least_h) | (share < 0.003)
    large = share > 0.8
    header = (a["y"] < image_h * 0.20) & (density < 0.08)
    faint = density < 0.015
    reasons = F.array_join(F.array_compact(F.array(F.when(small, "too_small"), F.when(large, "too_large"), F.when(header, "header_or_logo_like"), F.when(faint, "low_text_density"))), ", ")
    cost = lambda flag, n: F.when(flag, float(n)).otherwise(0.0)
    score = F.least(share * 100, F.lit(8.0)) + F.least(density * 80, F.lit(8.0)) + F.when(aspect.between(1.2, 8), 2.0).otherwise(0.0) - cost(header, 4) - cost(small, 5) - cost(large, 6) - cost(faint, 3)
    return [
        area.alias("area"), share.alias("relative_area"), aspect.alias("aspect_ratio"), small.alias("is_too_small"), large.alias("is_too_large"), header.alias("is_header_like"),
        faint.alias("is_low_text_density"), F.nullif(reasons, F.lit("")).alias("filter_reason"), score.alias("candidate_priority_score"), (~(small | large | header | faint)).alias("is_candidate"),
    ]
