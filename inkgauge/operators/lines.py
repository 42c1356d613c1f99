"""Long-form line operators: where grouping, ranking or islands over lines are asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from inkgauge.functions import fixed, text


def line_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, line_no, line): non-blank stripped lines, numbered from 0."""
    return docs.select(id_col, F.posexplode(text.full_lines(F.coalesce(F.col(text_col), F.lit("")))).alias("line_no", "line"))


def line_duplicates(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id_col, n_lines, n_distinct, most): lines of a document, distinct ones without white space, and the most frequent one's count."""
    by = line_table(docs, id_col).groupBy(id_col, text.compact(F.col("line")).alias("k")).agg(F.count("*").alias("n"))
    return by.groupBy(id_col).agg(F.sum("n").alias("n_lines"), F.count("*").alias("n_distinct"), F.max("n").alias("most"))


def line_islands(docs: DataFrame, id_col: str = "doc_id", least: int = 40) -> DataFrame:
    """(id_col, first_line, n): runs of lines of at least so many characters."""
    lines = line_table(docs, id_col).withColumn("long", F.length("line") >= least)
    w = W.partitionBy(id_col).orderBy("line_no")
    runs = lines.withColumn("run", F.sum((~F.col("long")).cast("int")).over(w)).where("long")
    return runs.groupBy(id_col, "run").agg(F.min("line_no").cast("long").alias("first_line"), F.count("*").alias("n")).drop("run")


def longest_first(docs: DataFrame, most: int, id_col: str = "doc_id") -> DataFrame:
    """(id_col, line_no, rank, meaningful): a document's lines with the most letters and digits."""
    lines = line_table(docs, id_col).withColumn("meaningful", text.count(F.col("line"), fixed.MEANINGFUL))
    w = W.partitionBy(id_col).orderBy(F.desc("meaningful"), "line_no")
    got = lines.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
    return got.select(id_col, F.col("line_no").cast("long").alias("line_no"), F.col("rank").cast("long").alias("rank"), F.col("meaningful").cast("long").alias("meaningful"))
