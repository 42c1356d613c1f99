"""Line dedup by site-relative frequency.

For each host, the pages that contain a line are divided by all pages of the host; lines above
a boilerplate ratio go from every page of that host. Counting is one partial aggregation on
(host, line hash), so neither a hot host nor a hot line meets in one task; pages are cleaned by a
join on (host, text hash), which adaptive execution may split or broadcast by its measured size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkgauge.llm.common import fresh, table, text_of
from inkgauge.llm.mixing import source_key

#: A line goes from a host when more than this share of the host's pages have it ...
RATIO = 0.05
#: ... and at least so many pages.
MIN_PAGES = 3
TRIM = " \t\r"


def _bare(line: Column) -> Column:
    return F.trim(line, F.lit(TRIM))


def _line_key(line: Column) -> Column:
    return F.xxhash64(_bare(line))


def boilerplate(docs: DataFrame, *, text_col: str = "text", host_col: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host key, line key, pages, host_pages) of the lines above the ratio.

    A page is a row; a line counts once for a page however often it stands there. Lines are
    compared without spaces, tabs and carriage returns at their ends; blank ones don't count.
    """
    pages = docs.select(source_key(host_col).alias("host"), text_col)
    totals = pages.groupBy("host").agg(F.count("*").alias("host_pages"))
    return _page_lines(pages, text_col).groupBy("host", "line").agg(F.count("*").alias("pages")).join(totals, "host").where((F.col("pages") > ratio * F.col("host_pages")) & (F.col("pages") >= min_pages))


def _page_lines(pages: DataFrame, text_col: str, *keep: str) -> DataFrame:
    lines = F.filter(F.split(text_of(text_col), "\n"), lambda x: _bare(x) != "")
    return pages.select("host", *keep, F.explode(F.array_distinct(F.transform(lines, _line_key))).alias("line"))


def dedup_lines(docs: DataFrame, *, text_col: str = "text", host_col: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """docs with boilerplate lines cut out of text_col, plus n_lines and n_dropped (non-blank lines).

    Every row stays, also one whose lines all go (its text is then empty or blank lines). Null
    texts stay null with 0 lines; null hosts are a host of their own; repeated rows are pages of
    their own; an empty table gives no rows. Other columns pass through; the two counts get a
    trailing underscore where docs has their names already. Order of lines is kept.
    """
    bad = boilerplate(docs, text_col=text_col, host_col=host_col, ratio=ratio, min_pages=min_pages).select("host", "line")
    host, text, gone, n_lines, n_dropped = fresh(docs, "_host", "_text_key", "_gone", "n_lines", "n_dropped")
    pages = docs.select(source_key(host_col).alias("host"), F.xxhash64(text_col).alias("text_key"), text_col).where(F.col(text_col).isNotNull())
    per_text = (
        _page_lines(pages, text_col, "text_key")
        .join(bad, ["host", "line"])
        .groupBy(F.col("host").alias(host), F.col("text_key").alias(text))
        .agg(F.collect_set("line").alias(gone))
    )
    lines = F.split(text_of(text_col), "\n")
    full = F.filter(lines, lambda x: _bare(x) != "")
    kept = F.filter(lines, lambda x: (_bare(x) == "") | ~F.array_contains(gone, _line_key(x)))
    clean = F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    keyed = docs.withColumn(host, source_key(host_col)).withColumn(text, F.xxhash64(text_col))
    joined = keyed.join(per_text, [host, text], "left")
    dropped = F.when(F.col(gone).isNull(), F.lit(0)).otherwise(F.size(lines) - F.size(kept))
    return joined.select(
        *[clean.alias(c) if c == text_col else F.col(c) for c in docs.columns],
        F.size(full).cast("long").alias(n_lines),
        dropped.cast("long").alias(n_dropped),
    )


def query(spark, sf_dir: str) -> DataFrame:
    """op10: documents, with the source as host."""
    cleaned = dedup_lines(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.md5(text_of()).alias("kept_md5"))


SQL = f"""
WITH pages AS (
  SELECT row_number() OVER () AS page, doc_id, source, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), exploded AS (
  SELECT page, doc_id, source, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM pages
), bare AS (
  SELECT page, source, pos, line, trim(line, ' ' || chr(9) || chr(13)) AS b FROM exploded
), counted AS (
  SELECT source, b, count(DISTINCT page) AS pages FROM bare WHERE b <> '' GROUP BY ALL
), totals AS (
  SELECT source, count(*) AS host_pages FROM pages GROUP BY source
), bad AS (
  SELECT c.source, b FROM counted c JOIN totals t ON c.source IS NOT DISTINCT FROM t.source
  WHERE c.pages > {RATIO} * t.host_pages AND c.pages >= {MIN_PAGES}
), marked AS (
  SELECT x.page, x.pos, x.line, x.b, bad.b IS NOT NULL AS gone
  FROM bare x LEFT JOIN bad ON x.source IS NOT DISTINCT FROM bad.source AND x.b = bad.b
)
SELECT p.doc_id,
       count(*) FILTER (b <> '') AS n_lines,
       count(*) FILTER (gone) AS n_dropped,
       md5(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_md5
FROM marked m JOIN pages p USING (page) GROUP BY p.page, p.doc_id
"""
