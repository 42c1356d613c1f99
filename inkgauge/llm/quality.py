"""Quality classifier: document evidence with hierarchical empirical Bayes site priors.

A logistic regression on a few text statistics gives each document log odds of being good. Its
class probabilities are summed by host and by host and path. Site rates are posterior means of
Beta models: a path shrinks toward its host, a host toward the corpus, with weights (prior
counts) estimated from the spread between sites by the method of moments. A document's score adds
its evidence to the log odds of its path's rate, computed without the document itself.

Statistics are built-in expressions; fitting uses at most MAX_LABELLED labelled rows (the least
hashes of the id), and only their statistics reach the driver. Site rates are partial aggregations; their join is
left to adaptive execution, which may broadcast by measured size or split hot sites.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkgauge.llm.common import SPACES, stage, table, text_of
from inkgauge.llm.mixing import source_key
from inkgauge.llm.toxicity import held_out

MAX_LABELLED = 20_000
THRESHOLD = 0.5
FEATURES = ("upper", "symbols", "digits", "repeated", "word_length", "log_words")
LEAST_PRIOR, MOST_PRIOR = 1.0, 10_000.0


def statistics(text: Column) -> list[Column]:
    """The features of a text; an empty one has zeros."""
    size = F.greatest(F.length(text), F.lit(1))
    words = F.filter(F.split(F.translate(text, SPACES, " " * len(SPACES)), " "), lambda w: w != "")
    n = F.greatest(F.size(words), F.lit(1))
    return [
        (F.regexp_count(text, F.lit(r"\p{Lu}")) / size).alias("upper"),
        (F.regexp_count(text, F.lit(r"[^\p{L}\p{N}\s.,;:'\"()-]")) / size).alias("symbols"),
        (F.regexp_count(text, F.lit(r"\p{N}")) / size).alias("digits"),
        (1 - F.size(F.array_distinct(words)) / n).alias("repeated"),
        (F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]")) / n / 10).alias("word_length"),
        (F.log1p(F.size(words).cast("double")) / 10).alias("log_words"),
    ]


def fit(features: np.ndarray, y: np.ndarray, l2: float = 1e-3, steps: int = 30) -> dict:
    """Logistic regression by Newton steps on standardised features. One class alone gives no evidence."""
    rate = (y.sum() + 1) / (len(y) + 2)
    if not 0 < y.sum() < len(y):
        return {"weights": [0.0] * len(FEATURES), "bias": float(np.log(rate / (1 - rate))), "rate": float(rate)}
    mean, scale = features.mean(0), features.std(0) + 1e-9
    x = np.column_stack([(features - mean) / scale, np.ones(len(y))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) / len(y) + l2 * np.append(w[:-1], 0)
        hess = (x * (p * (1 - p))[:, None]).T @ x / len(y) + np.diag([*[l2] * len(FEATURES), 1e-9])
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    weights = w[:-1] / scale
    return {"weights": weights.tolist(), "bias": float(w[-1] - weights @ mean), "rate": float(rate)}


def train(measured: DataFrame, labels: DataFrame, id_col: str, label_col: str, most: int = MAX_LABELLED) -> dict:
    """Fit on labelled rows that aren't held out. An id labelled twice takes the larger label; other labels than 0 and 1 are ignored."""
    usable = (
        labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col))
        .groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("double").alias("y"))
    )
    chosen = stage(usable.orderBy(F.xxhash64("id", F.lit(9)), "id").limit(most), "chosen")
    got = measured.join(F.broadcast(chosen), "id").select("y", *FEATURES).toArrow()
    x = np.column_stack([got.column(f).to_numpy() for f in FEATURES]) if len(got) else np.zeros((0, len(FEATURES)))
    return fit(x, got.column("y").to_numpy())


def logit(p: Column) -> Column:
    return F.log(p) - F.log(1 - p)


def prior_count(groups: DataFrame, rate: Column) -> Column:
    """The Beta prior's count from the spread of group rates around rate, as an aggregate expression.

    Sampling alone would give rate * (1 - rate) / n; what the spread has beyond is between sites.
    """
    n, s = F.col("n"), F.col("s")
    spread = F.sum(n * (s / n - rate) ** 2) / F.sum(n)
    within = F.sum(F.greatest(rate * (1 - rate), F.lit(1e-9))) / F.sum(n)
    between = F.greatest(spread - within, F.lit(1e-12))
    inner = F.sum(n * rate * (1 - rate)) / F.sum(n)
    return F.least(F.greatest(inner / between - 1, F.lit(LEAST_PRIOR)), F.lit(MOST_PRIOR))


def judge(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", label_col: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of docs: id_col, evidence, host_rate, path_rate, score, keep (1 if score >= threshold).

    Null and empty texts are scored from zero statistics. Null hosts and null paths are sites
    of their own. A site with one document has its parent's rate. Repeated rows and ids are rows
    of their own. Labels of one class only, or none, leave the evidence constant. An empty table
    gives no rows; other columns are ignored.
    """
    text = text_of(text_col)
    measured = stage(
        docs.select(F.col(id_col).alias("id"), source_key(host_col).alias("host"), source_key(path_col).alias("path"), *statistics(text)), "measured"
    )
    model = train(measured, labels, id_col, label_col)
    evidence = F.lit(model["bias"])
    for f, w in zip(FEATURES, model["weights"], strict=True):
        evidence = evidence + F.col(f) * w
    evidence = F.least(F.greatest(evidence, F.lit(-12.0)), F.lit(12.0))
    rows = stage(measured.select("id", "host", "path", evidence.alias("evidence")).withColumn("p", 1 / (1 + F.exp(-F.col("evidence")))), "evidence")
    paths = stage(rows.groupBy("host", "path").agg(F.sum("p").alias("s"), F.count("*").alias("n")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    whole = hosts.agg(F.sum("s").alias("s"), F.sum("n").alias("n")).first()
    if not whole["n"]:
        return rows.select(F.col("id").alias(id_col), "evidence", F.col("p").alias("host_rate"), F.col("p").alias("path_rate"), F.col("p").alias("score"), F.lit(1).alias("keep"))
    rate = min(max(whole["s"] / whole["n"], 1e-4), 1 - 1e-4)
    k_host = hosts.agg(prior_count(hosts, F.lit(rate)).alias("k")).first()["k"]
    hosts = hosts.withColumn("host_rate", (F.col("s") + k_host * rate) / (F.col("n") + k_host))
    joined = paths.join(hosts.select("host", "host_rate"), "host")
    k_path = joined.agg(prior_count(joined, F.col("host_rate")).alias("k")).first()["k"]
    site = stage(joined, "sites")
    path_rate = (F.col("s") - F.col("p") + k_path * F.col("host_rate")) / (F.col("n") - 1 + k_path)
    prior = F.least(F.greatest(path_rate, F.lit(1e-4)), F.lit(1 - 1e-4))
    total = F.col("evidence") - logit(F.lit(model["rate"])) + logit(prior)
    scored = rows.join(site, ["host", "path"]).withColumn("path_rate", prior).withColumn("score", 1 / (1 + F.exp(-total)))
    return scored.select(F.col("id").alias(id_col), "evidence", "host_rate", "path_rate", "score", (F.col("score") >= threshold).cast("int").alias("keep"))


def site_of(url: str) -> list[Column]:
    """(host, first path segment) of a URL column, for tables that carry URLs."""
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))
    return [host.alias("host"), F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*/([^/?#]*)", 1).alias("path")]


def query(spark, sf_dir: str) -> DataFrame:
    """op9: documents, the source as host and the language as the section below it."""
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
