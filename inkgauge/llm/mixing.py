"""Mixing sources to target weights by entropy balancing.

Each source s has a token target T_s. Documents get rates r_i that keep the Kullback-Leibler
divergence from rate 1 least under sum(r_i * size_i) = T_s and r_i <= cap. The optimum is an
exponential tilt r_i = min(cap, exp(lambda_s * x_i)) with x_i = size_i / mean size of the source,
where lambda_s solves a convex dual in one variable for each source. Safeguarded Newton steps solve all duals at
once, each as one distributed aggregation over the (source, size) histogram. Rates are rounded
into copies by systematic rounding in order of size, so that a source's words miss its target
by about one short document.

Everything here is DataFrame operations. Lambdas, targets and histograms stay distributed;
the driver sees only scalars (an error, a water level).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from inkgauge.llm.common import fresh, stage, table, word_count

#: Rows of one (source, size) cell that are ranked together.
CELL_ROWS = 256
#: Parts into which one cell is split at most.
CELL_PARTS = 4096


def source_key(column: str | Column) -> Column:
    """A join key that tells null from every string and sorts by code point, null last."""
    c = F.col(column) if isinstance(column, str) else column
    return F.when(c.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), c.cast("string")))


def ranked(df: DataFrame, by: str, name: str) -> DataFrame:
    """Rows of df numbered from 0 in the order of by, without sending all rows to one task.

    A range sort gives each partition a stretch of the order; the partitions' counts,
    a row each, give the offsets.
    """
    held = stage(
        df.repartitionByRange(F.col(by)).sortWithinPartitions(by).select("*", F.monotonically_increasing_id().alias("_seq")),
        "ranked",
    ).withColumn("_part", F.shiftright("_seq", 33)).withColumn("_row", F.col("_seq").bitwiseAND(F.lit((1 << 33) - 1)))
    counts = held.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))
    return held.join(before, "_part").withColumn(name, F.col("_row") + F.col("_before")).drop("_seq", "_part", "_row", "_before")


def targets(sources: DataFrame, weights: tuple[float, ...], cap: float) -> DataFrame:
    """(skey, words, docs) -> with target: shares by weight of all words, held to cap * words.

    The excess of held sources is shared anew by weight until none is above. All sources that
    aren't held lie on one water level (words for each unit of weight), so a round is one
    aggregation to one row; the held set only grows.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    weighed = stage(ranked(sources, "skey", "rank").withColumn("weight", w), "sources")
    limit = F.col("words") * F.lit(float(cap))
    total = float(weighed.agg(F.sum("words")).first()[0] or 0)
    level = 0.0
    while True:
        held = F.lit(level) * F.col("weight") >= limit
        r = weighed.agg(
            F.sum(F.when(held, limit).otherwise(0.0)).alias("fixed"),
            F.sum(F.when(held, 0.0).otherwise(F.col("weight"))).alias("open"),
        ).first()
        if not r or not r["open"]:
            break
        new = (total - r["fixed"]) / r["open"]
        if new <= level * (1 + 1e-15):
            break
        level = new
    return weighed.withColumn("target", F.least(F.lit(level) * F.col("weight"), limit))


def tilt(lam: Column, x: Column, cap: float) -> Column:
    return F.when(lam * x >= math.log(cap), F.lit(float(cap))).otherwise(F.exp(F.greatest(lam * x, F.lit(-700.0))))


def solve(hist: DataFrame, sources: DataFrame, cap: float, tol: float, max_iter: int) -> DataFrame:
    """lambda for each source by safeguarded Newton steps on the dual.

    hist: (skey, size, n), sources: (skey, words, docs, target). A step aggregates the dual's
    gradient and curvature over the histogram, keeps the bracket, and bisects where Newton would
    leave it. Sources with nothing to solve (no words, target at the cap or at their words) are done at once.
    """
    s = sources.withColumn("mean", F.col("words") / F.greatest(F.col("docs"), F.lit(1)))
    ratio = F.when(F.col("words") > 0, F.col("target") / F.col("words")).otherwise(1.0)
    full = ratio >= cap * (1 - 1e-12)
    least = hist.where("size > 0").groupBy("skey").agg(F.min("size").alias("least"))
    s = s.join(least, "skey", "left").select(
        "skey", "mean", "target", "words",
        F.when(full, F.lit(float("inf"))).when(ratio == 1, 0.0).otherwise(F.log(ratio)).alias("lam"),
        F.when(ratio < 1, F.lit(-1e6)).otherwise(0.0).alias("lo"),
        F.when(ratio < 1, 0.0).otherwise(math.log(cap) * F.col("mean") / F.coalesce(F.col("least"), F.lit(1)) + 1).alias("hi"),
        (full | (ratio == 1)).alias("done"),
    )
    state = stage(s, "lambda")
    for _ in range(max_iter):
        if not state.where("not done").limit(1).count():
            break
        x = F.col("size") / F.col("mean")
        r = tilt(F.col("lam"), x, cap)
        sums = (
            hist.join(state.where("not done").select("skey", "mean", "lam"), "skey")
            .groupBy("skey")
            .agg(
                F.sum(r * F.col("size") * F.col("n")).alias("got"),
                F.sum(F.when(r < cap, r * x).otherwise(0.0) * F.col("size") * F.col("n")).alias("slope"),
            )
        )
        gap = F.col("got") - F.col("target")
        lo = F.when(gap < 0, F.col("lam")).otherwise(F.col("lo"))
        hi = F.when(gap > 0, F.col("lam")).otherwise(F.col("hi"))
        step = F.col("lam") - gap / F.when(F.col("slope") > 0, F.col("slope"))
        near = F.abs(gap) <= tol * F.greatest(F.col("target"), F.lit(1.0))
        moved = F.when((step > F.col("lo2")) & (step < F.col("hi2")), step).otherwise((F.col("lo2") + F.col("hi2")) / 2)
        state = stage(
            state.join(sums, "skey", "left")
            .withColumn("lo2", F.when(F.col("done"), F.col("lo")).otherwise(lo))
            .withColumn("hi2", F.when(F.col("done"), F.col("hi")).otherwise(hi))
            .withColumn("end", F.coalesce(F.col("done") | near, F.lit(True)))
            .select(
                "skey", "mean", "target", "words",
                F.when(F.col("end"), F.col("lam")).otherwise(moved).alias("lam"),
                F.col("lo2").alias("lo"), F.col("hi2").alias("hi"), F.col("end").alias("done"),
            ),
            "lambda",
        )
    return state


def allot(cells: DataFrame, solved: DataFrame, cap: float) -> DataFrame:
    """(skey, size, part, n) -> with copies, the copies all of a cell's documents get together.

    Systematic rounding: down the sizes of a source, a cell gets the whole part of its expected
    copies plus what the running sum of the fractions passes. What a source still misses, about
    one document, is mended by adding or taking single copies in a few cells of each power of
    two of the size, largest first.
    """
    x = F.col("size") / F.col("mean")
    rate = F.least(tilt(F.col("lam"), x, cap), F.lit(float(cap)))
    r = cells.join(solved.select("skey", "mean", "lam", "target"), "skey").withColumn("want", F.when(F.col("size") > 0, rate).otherwise(1.0) * F.col("n"))
    down = W.partitionBy("skey").orderBy(F.desc("size"), "part")
    up_to = F.sum(F.col("want") - F.floor("want")).over(down.rowsBetween(W.unboundedPreceding, 0))
    frac = F.col("want") - F.floor("want")
    r = r.withColumn("sum", up_to).withColumn("extra", F.floor(F.col("sum") + 0.5) - F.floor(F.col("sum") - frac + 0.5))
    most = F.floor(F.lit(float(cap)) * F.col("n")).cast("long")
    r = stage(r.withColumn("copies", F.greatest(F.lit(0), F.least(F.floor("want") + F.col("extra"), most)).cast("long")), "cells")
    left = r.groupBy("skey").agg((F.first("target") - F.sum(F.col("copies") * F.col("size"))).alias("left"))
    band = F.floor(F.log2(F.col("size").cast("double")))
    pick = W.partitionBy("skey", "sign", "band").orderBy("size", "part")
    room = (
        r.where("size > 0")
        .select("skey", "size", "part", band.alias("band"), F.explode(F.array(F.lit(1), F.lit(-1))).alias("sign"), "copies", most.alias("most"))
        .where("(sign = 1 and copies < most) or (sign = -1 and copies > 0)")
        .withColumn("k", F.row_number().over(pick))
        .where("k <= 4")
        .groupBy("skey")
        .agg(F.sort_array(F.collect_list(F.struct("size", "sign", "part")), asc=False).alias("room"))
    )
    start = F.struct(F.col("left").alias("left"), F.array().cast("array<struct<size:bigint,part:bigint,sign:int>>").alias("done"))

    def mend(acc, c):
        by = c["sign"] * c["size"]
        one = F.struct(c["size"].alias("size"), c["part"].alias("part"), c["sign"].alias("sign"))
        free = ~F.exists(acc["done"], lambda d: (d["size"] == c["size"]) & (d["part"] == c["part"]))
        good = (F.abs(acc["left"] - by) < F.abs(acc["left"])) & free
        return F.struct(
            F.when(good, acc["left"] - by).otherwise(acc["left"]).alias("left"),
            F.when(good, F.concat(acc["done"], F.array(one))).otherwise(acc["done"]).alias("done"),
        )

    mended = (
        left.join(room, "skey")
        .select("skey", F.explode(F.aggregate("room", start, mend, lambda a: a["done"])).alias("d"))
        .select("skey", F.col("d.size").alias("size"), F.col("d.part").alias("part"), F.col("d.sign").alias("sign"))
    )
    return r.join(mended, ["skey", "size", "part"], "left").select("skey", "size", "part", "n", (F.col("copies") + F.coalesce("sign", F.lit(0))).alias("copies"))


def mix(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (1.0, 2.0, 3.0),
    cap: float = 3.0,
    tol: float = 1e-6,
    max_iter: int = 60,
) -> DataFrame:
    """One row for each row of docs: its id, source, text_hash, size, source_size, target and copies.

    Sources in code-point order, null last as a source of its own, take the weights in turn.
    Null and empty texts have size 0, count nowhere and get one copy of no words. Repeated rows
    and ids are rows of their own. Where all texts are empty every target is 0; an empty table
    gives no rows. Other columns of docs are ignored, whatever their names. Reruns agree: ties
    are broken by hashes of the row, and rows alike in all these columns are interchangeable.
    """
    rows = stage(
        docs.select(
            F.col(id_col).alias("id"), F.col(source_col).alias("source"), source_key(source_col).alias("skey"),
            F.xxhash64(text_col).alias("text_hash"), word_count(text_col).alias("size"),
        ),
        "sizes",
    )
    hist = stage(rows.groupBy("skey", "size").agg(F.count("*").alias("n")), "histogram")
    per_source = hist.groupBy("skey").agg(F.sum(F.col("size") * F.col("n")).alias("words"), F.sum("n").alias("docs"))
    goal = stage(targets(per_source, weights, cap), "targets")
    solved = solve(hist, goal, cap, tol, max_iter)
    parts = F.least(F.lit(CELL_PARTS), F.ceil(F.col("n") / CELL_ROWS)).cast("long")
    split = hist.select("skey", "size", parts.alias("parts"))
    order = F.xxhash64("id", "text_hash", F.lit(17))
    dealt = rows.join(split, ["skey", "size"]).withColumn("order", order).withColumn("part", F.pmod("order", F.col("parts"))).drop("parts")
    cells = dealt.groupBy("skey", "size", "part").agg(F.count("*").alias("n"))
    copies = stage(allot(cells, solved, cap), "copies")
    nth = F.row_number().over(W.partitionBy("skey", "size", "part").orderBy("order", "id", "text_hash"))
    got = F.floor(F.col("copies") / F.col("n")) + (nth <= F.col("copies") % F.col("n")).cast("long")
    done = dealt.join(copies, ["skey", "size", "part"]).withColumn("got", got)
    return done.join(goal.select("skey", F.col("words").alias("source_size"), "target"), "skey").select(
        F.col("id").alias(id_col), F.col("source").alias(source_col) if source_col != id_col else F.col("source"),
        "text_hash", "size", "source_size", "target", F.col("got").cast("long").alias("copies"),
    )


def resample(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """docs with each row repeated as often as mix() says; same columns. Rows with no copies go."""
    plan = mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, **options)
    i, s, h, n, k = fresh(docs, "_mix_id", "_mix_source", "_mix_hash", "_mix_copies", "_mix_rows")
    plan = stage(plan, "plan").groupBy(F.col(id_col).alias(i), F.col(source_col).alias(s), F.col("text_hash").alias(h)).agg(F.sum("copies").alias(n), F.count("*").alias(k))
    keyed = docs.withColumn(h + "d", F.xxhash64(text_col))
    on = F.col(id_col).eqNullSafe(F.col(i)) & F.col(source_col).eqNullSafe(F.col(s)) & (F.col(h + "d") == F.col(h))
    joined = keyed.join(plan, on)
    if plan.where(F.col(k) > 1).limit(1).count():  # rows alike in id, source and text share their copies
        nth = F.row_number().over(W.partitionBy(i, s, h).orderBy(F.lit(1)))
        joined = joined.withColumn(n, F.floor(F.col(n) / F.col(k)) + (nth <= F.col(n) % F.col(k)).cast("long"))
    some = joined.where(F.col(n) > 0)
    return some.withColumn(k, F.explode(F.array_repeat(F.lit(0), F.col(n).cast("int")))).select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    """op2: all documents mixed with weights 1, 2, 3 in turn and at most 3 copies of a document."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
