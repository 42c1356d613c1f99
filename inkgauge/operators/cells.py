"""Cells of a table: lines found in profiles, boundaries, the grid, the cells' texts and the cell structure.

A table's lines, boundaries and cells are one projection over its row; only the texts of cells and of tried grids are
grouped, by table, and a table has 30 cells at most. Null or empty profiles have no lines.
"""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from inkgauge.functions import fixed, geometry
from inkgauge.functions.patterns import table_patterns, table_text_score
from inkgauge.functions.text import count
from inkgauge.operators import layout
from inkgauge.operators.tables import first_by, structure_hint

PLACES = "array<int>"


def centers(profile: Column, threshold: Column) -> Column:
    """The center of each run of values at threshold or above, rounded down; the end of a run is the first place behind it."""
    n = F.size(profile)
    inside = lambda i: F.coalesce(F.get(profile, i) >= threshold, F.lit(False))
    every = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast(PLACES))
    starts = F.filter(every, lambda i: inside(i) & ~inside(i - 1))
    ends = F.filter(every, lambda i: inside(i) & ~inside(i + 1))
    return F.zip_with(starts, ends, lambda a, b: F.floor((a + b + 1) / 2).cast("int"))


def best_lines(tables: DataFrame) -> DataFrame:
    """tables with h_positions, v_positions and selected_params of the best of 27 settings; the first of equals.

    tables has width, height and h_profiles, v_profiles: for each kernel ratio the covered pixels of a row or column.
    """
    none = F.array().cast(PLACES)

    def sides(name: str, side: str, least: float) -> Column:
        found = lambda p, t: F.coalesce(layout.spaced(centers(p, F.greatest(F.col(side) * t, F.lit(least)))), none)
        return F.array(*[F.array(*[found(F.get(F.col(name), F.lit(k)), t) for t in fixed.LINE_FRACTIONS]) for k in range(len(fixed.KERNEL_RATIOS))])

    d = tables.withColumn("_h", sides("h_profiles", "width", 20.0)).withColumn("_v", sides("v_profiles", "height", 15.0))
    tried = []
    for i, hr in enumerate(fixed.KERNEL_RATIOS):
        for j, vr in enumerate(fixed.KERNEL_RATIOS):
            for k, t in enumerate(fixed.LINE_FRACTIONS):
                h, v = F.col("_h")[i][k], F.col("_v")[j][k]
                params = F.struct(F.lit(float(hr)).alias("horizontal_kernel_ratio"), F.lit(float(vr)).alias("vertical_kernel_ratio"), F.lit(t).alias("threshold_fraction"))
                tried.append(F.struct(geometry.line_count_score(F.size(h), F.size(v)).alias("score"), F.lit(-len(tried)).alias("first"), h.alias("h"), v.alias("v"), params.alias("params")))
    best = F.array_max(F.array(*tried))
    return d.withColumn("_b", best).withColumns({"h_positions": F.col("_b.h"), "v_positions": F.col("_b.v"), "selected_params": F.col("_b.params")}).drop("_h", "_v", "_b")


def zoom(w: Column, h: Column, side: float = 80.0, most: float = 4.0) -> Column:
    """How much a cell is enlarged before it is read."""
    return F.greatest(F.lit(2.0), F.least(side / F.greatest(F.least(w, h), F.lit(1)), F.lit(most)))


def too_small(w: Column, h: Column) -> Column:
    return (w < fixed.LEAST_CELL) | (h < fixed.LEAST_CELL)


def _boxes(rows: Column, cols: Column) -> Column:
    """Cells (row, col, x, y, w, h) of boundaries, in row-major order."""
    side = lambda b: F.when(F.size(b) > 1, F.sequence(F.lit(0), F.size(b) - 2)).otherwise(F.array().cast(PLACES))
    cell = lambda r, c: F.struct(
        r.alias("row"), c.alias("col"), F.get(cols, c).alias("x"), F.get(rows, r).alias("y"), (F.get(cols, c + 1) - F.get(cols, c)).alias("w"), (F.get(rows, r + 1) - F.get(rows, r)).alias("h")
    )
    return F.flatten(F.transform(side(rows), lambda r: F.transform(side(cols), lambda c: cell(r, c))))


def grid_trials(tables: DataFrame, *keys: str) -> DataFrame:
    """(keys..., ordinal, n_rows, n_cols, row, col, x, y, w, h, zoom): the cells to read of each grid to try; small ones aren't read."""
    g = tables.select(*keys, "width", "height", F.posexplode(geometry.grid_candidates(F.col("width"), F.col("height"))).alias("ordinal", "g"))
    boxes = _boxes(geometry.uniform(F.col("height"), F.col("g.n_rows")), geometry.uniform(F.col("width"), F.col("g.n_cols")))
    c = g.select(*keys, "ordinal", "g.n_rows", "g.n_cols", F.explode(boxes).alias("c")).select(*keys, "ordinal", "n_rows", "n_cols", "c.*")
    return c.where(~too_small(F.col("w"), F.col("h"))).withColumn("zoom", zoom(F.col("w"), F.col("h"), 60.0, 3.0))


def best_grid(tables: DataFrame, texts: DataFrame, *keys: str) -> DataFrame:
    """(keys..., n_rows, n_cols, selected_grid_reason, grid_candidates): by patterns, then score; the first of equals.

    texts: (keys..., ordinal, text) of the cells in grid_trials(); a cell that couldn't be read has no row.
    """
    p = texts.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("_p", table_patterns(F.col("text")))
    hits = sum((F.size(F.col("_p")[k]) for k in fixed.TABLE_KEYS[1:]), F.size(F.col("_p")[fixed.TABLE_KEYS[0]]))
    scored = p.groupBy(*keys, "ordinal").agg(F.sum(hits).alias("_n"), F.sum(table_text_score(F.col("_p"), F.col("text"))).alias("_s"))
    g = tables.select(*keys, F.posexplode(geometry.grid_candidates(F.col("width"), F.col("height"))).alias("ordinal", "g")).join(scored, [*keys, "ordinal"], "left")
    one = F.struct(F.array("g.n_rows", "g.n_cols").alias("grid"), F.round(F.coalesce("_s", F.lit(0.0)).cast("double"), 2).alias("score"), F.coalesce("_n", F.lit(0)).cast("int").alias("pattern_count"))
    every = g.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ordinal", one.alias("g")))).alias("_g"))
    best = F.array_max(F.transform("_g", lambda x: F.struct(x["g"]["pattern_count"].alias("n"), x["g"]["score"].alias("s"), (-x["ordinal"]).alias("o"), x["g"]["grid"].alias("grid"))))
    d = every.withColumn("_b", best).withColumn("n_rows", F.col("_b.grid")[0]).withColumn("n_cols", F.col("_b.grid")[1])
    why = F.concat(F.lit("grid_"), "n_rows", F.lit("x"), "n_cols", F.lit(" selected: pattern_count="), "_b.n", F.lit(", score="), F.col("_b.s").cast("string"))
    return d.select(*keys, "n_rows", "n_cols", why.alias("selected_grid_reason"), F.transform("_g", lambda x: x["g"]).alias("grid_candidates"))


def grid(tables: DataFrame) -> DataFrame:
    """tables with row_boundaries, col_boundaries, method and warnings.

    tables: width, height, h_positions, v_positions, and n_rows, n_cols for tables without lines (2 and 2 where null).
    """
    b = tables.withColumn("_r", layout.boundaries(F.col("h_positions"), F.lit(0), F.col("height"))).withColumn("_c", layout.boundaries(F.col("v_positions"), F.lit(0), F.col("width")))
    d = b.withColumn("method", geometry.grid_method(F.size("_r"), F.size("_c")))
    w, h, m = F.col("width"), F.col("height"), F.col("method")
    n_rows = F.when(m == "uniform_grid", F.coalesce("n_rows", F.lit(2))).otherwise(geometry.rows_by_aspect(w, h))
    n_cols = F.when(m == "uniform_grid", F.coalesce("n_cols", F.lit(2))).otherwise(geometry.columns_by_aspect(w, h))
    nh, nv = F.size("h_positions").cast("string"), F.size("v_positions").cast("string")
    note = (
        F.when(m == "line_split_rows_only", F.concat(F.lit("Only h_lines detected ("), nh, F.lit("). Using uniform "), n_cols, F.lit(" columns.")))
        .when(m == "line_split_cols_only", F.concat(F.lit("Only v_lines detected ("), nv, F.lit("). Using uniform "), n_rows, F.lit(" rows.")))
        .when(m == "uniform_grid", F.concat(F.lit("No interior lines detected (h="), nh, F.lit(", v="), nv, F.lit("). Best grid: "), n_rows, F.lit("x"), n_cols, F.lit(".")))
    )
    d = d.withColumn("row_boundaries", F.when(m.isin("line_split", "line_split_rows_only"), F.col("_r")).otherwise(geometry.uniform(h, n_rows)))
    d = d.withColumn("col_boundaries", F.when(m.isin("line_split", "line_split_cols_only"), F.col("_c")).otherwise(geometry.uniform(w, n_cols)))
    cells = (F.size("row_boundaries") - 1) * (F.size("col_boundaries") - 1)
    over = F.when(cells > fixed.MOST_CELLS, F.concat(F.lit("Cell count ("), cells, F.lit(f") exceeds limit ({fixed.MOST_CELLS}). Truncating.")))
    return d.withColumn("warnings", F.array_compact(F.array(note, over))).drop("_r", "_c")


def grid_cells(grids: DataFrame, *keys: str) -> DataFrame:
    """(keys..., n, row, col, x, y, w, h, skipped, zoom): the first 30 cells in row-major order; tiny ones are skipped, not read."""
    c = grids.select(*keys, F.posexplode(F.slice(_boxes(F.col("row_boundaries"), F.col("col_boundaries")), 1, fixed.MOST_CELLS)).alias("n", "c")).select(*keys, "n", "c.*")
    small = too_small(F.col("w"), F.col("h"))
    return c.withColumn("skipped", small).withColumn("zoom", F.when(~small, zoom(F.col("w"), F.col("h"))))


def cell_texts(cells: DataFrame, texts: DataFrame, *keys: str) -> DataFrame:
    """cells with text, patterns and ocr_variant: the variant with the most of 10 x pattern score + 0.1 x letters and digits.

    texts: (keys..., row, col, ordinal, variant, text); the first of equals counts, null texts count as not read.
    """
    t = texts.where("text is not null").withColumn("_p", table_patterns(F.col("text")))
    score = table_text_score(F.col("_p"), F.col("text")) * 10.0 + count(F.col("text"), r"[\p{L}\p{Nd}]") * 0.1
    t = first_by(t.withColumn("_score", score).where("_score > -1"), [*keys, "row", "col"], F.desc("_score"), "ordinal").select(*keys, "row", "col", "variant", F.col("text").alias("_text"))
    j = cells.join(t, [*keys, "row", "col"], "left")
    found = F.when(F.col("skipped"), "").otherwise(F.coalesce("_text", F.lit("")))
    j = j.withColumn("text", found).withColumn("ocr_variant", F.when(F.col("skipped"), "skipped").otherwise(F.coalesce("variant", F.lit("psm6"))))
    return j.withColumn("patterns", table_patterns(F.col("text"))).drop("_text", "variant")


def structures(grids: DataFrame, read: DataFrame, *keys: str) -> DataFrame:
    """(keys..., cell_structure): a table's block of the result document, from grid() and cell_texts().

    keys end with the table's id. Cells beyond the limit are only empty texts in rows. grids may carry selected_grid_reason and grid_candidates.
    """
    hint = structure_hint(read, *keys)
    small = F.concat(F.lit("Cell "), F.col(keys[-1]), F.lit("_r"), "row", F.lit("c"), "col", F.lit(" too small ("), "w", F.lit("x"), "h", F.lit("), skipping."))
    cell = F.struct("n", F.struct("row", "col", F.array("x", "y", "w", "h").alias("bbox"), "text", "patterns", "ocr_variant").alias("cell"), F.when(F.col("skipped"), small).alias("warning"))
    cells = read.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("n", cell.alias("c")))).alias("_cells"))
    j = grids.join(cells, list(keys), "left").join(hint, list(keys), "left")
    at = lambda i: F.coalesce(F.get(F.col("_cells"), i)["c"]["cell"]["text"], F.lit(""))
    n_rows, n_cols = F.size("row_boundaries") - 1, F.size("col_boundaries") - 1
    rows = F.transform(F.sequence(F.lit(0), n_rows - 1), lambda r: F.transform(F.sequence(F.lit(0), n_cols - 1), lambda c: at(r * n_cols + c)))
    other = lambda c: F.col(c) if c in grids.columns else F.lit(None)
    uniform = lambda c, kind: F.when(F.col("method") == "uniform_grid", other(c).cast(kind)).alias(c)
    params = F.from_json(F.to_json("selected_params"), "map<string,double>") if "selected_params" in grids.columns else F.lit(None).cast("map<string,double>")
    block = F.struct(
        "method", n_rows.alias("row_count"), n_cols.alias("col_count"), rows.alias("rows"),
        F.struct(F.size("h_positions").alias("h_lines"), F.size("v_positions").alias("v_lines"), params.alias("selected_params")).alias("line_detection"), "structure_hint",
        uniform("grid_candidates", "array<struct<grid:array<int>,score:double,pattern_count:int>>"), uniform("selected_grid_reason", "string"),
        F.transform("_cells", lambda c: c["c"]["cell"]).alias("cells"), F.concat("warnings", F.array_compact(F.transform("_cells", lambda c: c["c"]["warning"]))).alias("warnings"),
    )
    return j.select(*keys, block.alias("cell_structure"))


def with_structures(tables: DataFrame, found: DataFrame, *keys: str) -> DataFrame:
    """tables with their cell_structure, null for tables that have none."""
    return tables.join(found, list(keys), "left")
