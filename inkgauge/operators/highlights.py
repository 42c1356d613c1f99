"""Cards linked to layout lines: fuzzy one-to-one matching within a document."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

LEAST_SCORE, MOST_HIGHLIGHTS = 0.62, 12
#: Fixed value: what is ignored in matching.
IGNORED = r"[^0-9A-Za-z가-힣]+"


def match_key(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), IGNORED, ""))


@F.pandas_udf(DoubleType())
def _similarity(q: pd.Series, c: pd.Series) -> pd.Series:
    return pd.Series([None if a is None or b is None else SequenceMatcher(None, a, b).ratio() for a, b in zip(q, c, strict=True)], dtype="float64")


def match_score(q: Column, c: Column) -> Column:
    """1 for equal keys, the length ratio where one holds the other, else sequence similarity; 0 for empty ones."""
    a, b = F.length(q), F.length(c)
    inside = (F.contains(c, q)) | (F.contains(q, c))
    easy = F.when((a == 0) | (b == 0), 0.0).when(q == c, 1.0).when(inside, F.least(a, b) / F.greatest(a, b, F.lit(1)))
    hard = easy.isNull()  # other pairs go to the UDF as nulls, since it runs for all rows
    return F.coalesce(easy, _similarity(F.when(hard, q), F.when(hard, c)))


LAYOUT_LINE = "struct<text:string,page:int,source:string,bbox:struct<x:double,y:double,width:double,height:double>,x:double,y:double,width:double,height:double,page_size:struct<width:double,height:double>,page_width:double,page_height:double>"


def layout_lines(docs: DataFrame, key: str, json_col: str) -> DataFrame:
    """(key, ordinal, page, source, text, bbox, page_size) of a flat or a paged layout document.

    Invalid JSON and null give no lines; a line without its own page or page size takes the page's.
    """
    flat = F.from_json(json_col, f"array<{LAYOUT_LINE}>", {"mode": "PERMISSIVE"})
    paged = F.from_json(json_col, f"struct<pages:array<struct<page:int,width:double,height:double,lines:array<{LAYOUT_LINE}>>>>", {"mode": "PERMISSIVE"})["pages"]
    is_list = F.ltrim(json_col).startswith("[")
    size = lambda w, h: F.struct(w.alias("width"), h.alias("height"))

    def line(ln: Column, page: Column | None) -> Column:
        zero = lambda x: F.coalesce(x, F.lit(0.0))
        box = F.when(ln["bbox"].isNotNull(), F.struct(*[zero(ln["bbox"][k]).alias(k) for k in ("x", "y", "width", "height")])).when(
            ln["x"].isNotNull() & ln["y"].isNotNull() & ln["width"].isNotNull() & ln["height"].isNotNull(), F.struct(*[zero(ln[k]).alias(k) for k in ("x", "y", "width", "height")])
        )
        own = F.coalesce(ln["page_size"], size(page["width"], page["height"])) if page is not None else F.coalesce(ln["page_size"], size(ln["page_width"], ln["page_height"]))
        number = F.coalesce(ln["page"], page["page"], F.lit(1)) if page is not None else F.coalesce(ln["page"], F.lit(1))
        return F.struct(number.alias("page"), F.coalesce(ln["source"], F.lit("layout_line")).alias("source"), F.coalesce(ln["text"], F.lit("")).alias("text"), box.alias("bbox"), size(zero(own["width"]), zero(own["height"])).alias("page_size"))

    listed = F.filter(flat, lambda x: x.isNotNull())
    from_pages = F.flatten(F.transform(F.filter(paged, lambda p: p.isNotNull()), lambda p: F.transform(F.coalesce(p["lines"], F.array().cast(f"array<{LAYOUT_LINE}>")), lambda x: line(x, p))))
    every = F.when(is_list, F.transform(listed, lambda x: line(x, None))).otherwise(from_pages)
    return docs.select(key, F.posexplode(every).alias("ordinal", "l")).select(key, "ordinal", "l.*")


def assign(cards: DataFrame, lines: DataFrame, key: str, least: float = LEAST_SCORE, most: int = MOST_HIGHLIGHTS) -> DataFrame:
    """Highlights: cards in order take the best free line of their document that reaches the score.

    Scores come from a join on the key; the assignment, which depends on the order, is a grouped function over
    a document's scored pairs. A best line without a box is passed over but stays free; equal scores go to the first line.
    """
    query = F.coalesce(F.nullif(F.col("value_ko"), F.lit("")), F.nullif(F.col("title_ko"), F.lit("")))
    c = cards.select(key, F.col("ordinal").alias("card"), query.alias("query"), "chip", "importance", "value_translated", "value_easy_ko").where("query is not null")
    pairs = c.join(lines.select(key, F.col("ordinal").alias("line"), "page", "source", "text", "bbox", "page_size"), key)
    pairs = pairs.withColumn("score", match_score(match_key(F.col("query")), match_key(F.col("text")))).where(F.col("score") > 0)
    slim = pairs.select(key, "card", "line", "score", F.col("bbox").isNotNull().alias("boxed"))
    kind = cards.schema[key].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        used, out = set(), []
        for card, rows in pdf.sort_values(["card", "line"]).groupby("card", sort=True):
            free = rows[~rows["line"].isin(used)]
            if free.empty:
                continue
            best = free.loc[free["score"].idxmax()]
            if best["score"] < least or not best["boxed"]:
                continue
            used.add(best["line"])
            out.append((best[key], int(card), int(best["line"]), float(best["score"]), f"h_{len(out) + 1:03d}"))
            if len(out) >= most:
                break
        return pd.DataFrame(out, columns=[key, "card", "line", "score", "highlight_id"])

    chosen = slim.groupBy(key).applyInPandas(run, f"{key} {kind}, card int, line int, score double, highlight_id string")
    full = pairs.drop("score").join(chosen, [key, "card", "line"])
    return full.select(
        key, "highlight_id", "page", "source", "bbox", "page_size", "text", F.col("chip").alias("category"), F.coalesce("importance", F.round("score", 3)).alias("importance"),
        F.coalesce("value_translated", F.lit("")).alias("translated"), F.coalesce("value_easy_ko", F.lit("")).alias("easy_ko"),
    )
