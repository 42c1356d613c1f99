"""Toxicity: a character n-gram linear classifier with naive Bayes log-count ratios as feature scales.

Features are character n-grams (orders 3 to 6, lower-cased, white space as one blank), hashed to
BUCKETS. A feature's value is its rate: occurrences for each 1000 characters of the whole text,
with SHRINK characters added so that short texts don't jump, held to MOST_RATE so that one
repeated phrase can't decide. From labelled documents come the smoothed log ratio r_j of the mean
rates in toxic and clean texts; the buckets with the largest likelihood-ratio statistic are kept,
and a logistic regression is fitted on rate * r_j.
Fitting uses a bounded sample of labelled rows (MAX_TOXIC, MAX_CLEAN, the least hashes of the id),
weighted back to the true class shares. Scoring covers every text, whole, in Arrow batches cut
into chunks of bounded size; the broadcast model is at most FEATURES weights and one
BUCKETS-long index.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkgauge.llm.common import fresh, lean, stage, table

ORDERS = (3, 4, 5, 6)
BITS = 20
BUCKETS = 1 << BITS
FEATURES = 6000
MAX_TOXIC = 4000
MAX_CLEAN = 8000
THRESHOLD = 0.7
SHRINK = 200
MOST_RATE = 6.0
CHUNK_CHARS = 1 << 18
_GAP = " " + "\0" * (max(ORDERS) - 1) + " "


def chunks(texts: list[str | None], most: int = CHUNK_CHARS) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of the first text, code points, start of each text in them and their end); null is the empty text."""
    first, parts, size, starts = 0, [], 0, []

    def packed():
        code = np.frombuffer(("".join(parts) + _GAP).encode("utf-32-le", "surrogatepass"), np.uint32)
        return first, np.where((code >= 9) & (code <= 13), np.uint32(32), code), np.array([*starts, size])

    for i, text in enumerate(texts):
        raw = (text or "").lower()
        if size and size + len(raw) > most:
            yield packed()
            first, parts, size, starts = i, [], 0, []
        starts.append(size)
        parts.append(_GAP + raw)
        size += len(raw) + len(_GAP)
    if starts:
        yield packed()


def buckets(code: np.ndarray) -> Iterator[np.ndarray]:
    """For each order, the bucket of the n-gram that starts at each character."""
    mul = np.uint32(0x01000193)
    low = ORDERS[0]
    h = code[: len(code) - (low - 1)].copy()
    for j in range(1, low):
        h = h * mul + code[j : len(code) - (low - 1) + j]
    for n in range(low, ORDERS[-1] + 1):
        if n > low:
            h = h[:-1] * mul + code[n - 1 :]
        if n in ORDERS:
            yield ((h ^ (h >> np.uint32(15))) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)


def rates(texts: list[str | None], index: np.ndarray | None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first text, texts, row, column, rate), each (row, column) once; index maps a bucket to its column or -1."""
    for first, code, starts in chunks(texts):
        keys = []
        for b in buckets(code):
            b = b[: starts[-1]]  # grams of the gap behind the last text are nobody's
            if index is None:
                pos, col = np.arange(len(b)), b.astype(np.int64)
            else:
                col = index[b]
                pos = np.flatnonzero(col >= 0)
                col = col[pos].astype(np.int64)
            row = np.searchsorted(starts[:-1], pos, side="right") - 1
            keys.append(row * BUCKETS + col)
        key, count = np.unique(np.concatenate(keys), return_counts=True)
        row = key // BUCKETS
        length = np.diff(starts) - len(_GAP) + SHRINK
        yield first, len(starts) - 1, row, key % BUCKETS, np.minimum(1000.0 * count / length[row], MOST_RATE)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen, held = np.zeros((2, BUCKETS)), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        toxic = batch.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64)
        for first, _, row, col, rate in rates(batch.column("text").to_pylist(), None):
            label = toxic[first + row]
            for y in (0, 1):
                seen[y] += np.bincount(col[label == y], rate[label == y], minlength=BUCKETS)
            held += np.bincount(col, minlength=BUCKETS)
    hit = np.flatnonzero(held)
    yield pa.record_batch({"bucket": pa.array(hit, pa.int64()), "docs": pa.array(held[hit]), "clean": pa.array(seen[0, hit]), "toxic": pa.array(seen[1, hit])})


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_toxic: int, max_clean: int) -> tuple[DataFrame, int, int]:
    """(text, toxic) of at most max_toxic + max_clean labelled ids, and the true counts of both classes.

    Ids whose crc32 as text leaves 1 on division by 3 are held out. An id labelled twice takes
    the larger label; labels other than 0 and 1, and null ids, are ignored.
    """
    usable = (
        labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col))
        .groupBy(F.col(id_col).alias("id"))
        .agg(F.max(label_col).cast("int").alias("toxic"))
    )
    usable = stage(usable, "labels")
    counts = {r["toxic"]: r["count"] for r in usable.groupBy("toxic").count().collect()}
    order = F.xxhash64(F.col("id"), F.lit(4))
    take = lambda y, n: usable.where(F.col("toxic") == y).orderBy(order, "id").limit(n)
    chosen = stage(take(1, max_toxic).unionAll(take(0, max_clean)), "chosen")
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id").select("text", "toxic")
    return stage(picked, "labelled"), counts.get(0, 0), counts.get(1, 0)


def held_out(id_col: str):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(labelled: DataFrame, clean: int, toxic: int, features: int = FEATURES) -> dict:
    """The model: index (bucket -> column or -1), weights by column, bias. Without both classes, a constant."""
    constant = {"index": np.full(BUCKETS, -1, np.int16), "weights": np.zeros(1), "bias": -4.0}
    rows = labelled.groupBy("toxic").count().collect()
    size = {r["toxic"]: r["count"] for r in rows}
    if not size.get(0) or not size.get(1):
        return constant
    counted = labelled.mapInArrow(lean(_counted), "bucket long, docs long, clean double, toxic double")
    counted = counted.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in ("docs", "clean", "toxic")])
    n0, n1 = size[0], size[1]
    ratio = F.log((F.col("toxic") + 1) / (n1 + 1.0)) - F.log((F.col("clean") + 1) / (n0 + 1.0))
    both = F.col("toxic") + F.col("clean")
    part = lambda o, e: F.when(o > 0, o * F.log(o / e)).otherwise(0.0)
    p = n1 / (n0 + n1)
    g2 = part(F.col("toxic"), both * p) + part(F.col("clean"), both * (1 - p))
    best = counted.where("docs >= 5").select("bucket", ratio.alias("ratio"), g2.alias("g2")).orderBy(F.desc("g2"), "bucket").limit(features).collect()
    index = np.full(BUCKETS, -1, np.int16)
    index[[r["bucket"] for r in best]] = np.arange(len(best))
    scale = np.array([r["ratio"] for r in best])
    shared = labelled.sparkSession.sparkContext.broadcast(index)

    def sparse(batches):
        for batch in batches:
            toxic = batch.column("toxic").to_pylist()
            cols, vals = [b""] * len(toxic), [b""] * len(toxic)
            for first, n, row, col, rate in rates(batch.column("text").to_pylist(), shared.value):
                cut = np.searchsorted(row, np.arange(1, n))
                for i, (c, v) in enumerate(zip(np.split(col, cut), np.split(rate, cut), strict=True)):
                    cols[first + i], vals[first + i] = c.astype(np.int16).tobytes(), v.astype(np.float32).tobytes()
            yield pa.record_batch({"toxic": pa.array(toxic, pa.int32()), "cols": pa.array(cols, pa.binary()), "vals": pa.array(vals, pa.binary())})

    got = labelled.mapInArrow(lean(sparse), "toxic int, cols binary, vals binary").toArrow()
    y = got.column("toxic").to_numpy().astype(float)
    cols = got.column("cols").to_pylist()
    row = np.repeat(np.arange(len(y)), [len(c) // 2 for c in cols])
    col = np.frombuffer(b"".join(cols), np.int16).astype(np.int64)
    rate = np.frombuffer(b"".join(got.column("vals").to_pylist()), np.float32).astype(float)
    weight = np.where(y == 1, toxic / max(n1, 1), clean / max(n0, 1))
    w, bias = logistic(row, col, scale[col] * rate, y, weight / weight.mean(), len(best))
    return {"index": index, "weights": w * scale, "bias": bias}


def logistic(row, col, value, y, weight, k: int, l2: float = 0.3, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weighted logistic regression on sparse rows: accelerated full-batch descent with a backtracked step."""
    w, b = np.zeros(k), 0.0
    vw, vb, t = w, b, 1.0
    step = 1e-3

    def look(w, b):
        z = np.bincount(row, value * w[col], minlength=len(y)) + b
        loss = float(np.sum(weight * (np.logaddexp(0, z) - y * z)) + l2 / 2 * w @ w)
        e = weight * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y)
        return loss, np.bincount(col, value * e[row], minlength=k) + l2 * w, e.sum()

    for _ in range(steps):
        loss, gw, gb = look(vw, vb)
        step *= 1.3
        while True:
            nw, nb = vw - step * gw, vb - step * gb
            new, _, _ = look(nw, nb)
            if new <= loss - step / 2 * (gw @ gw + gb * gb) + 1e-9:
                break
            step /= 2
        u = (1 + (1 + 4 * t * t) ** 0.5) / 2
        vw, vb = nw + (t - 1) / u * (nw - w), nb + (t - 1) / u * (nb - b)
        done = np.abs(nw - w).max(initial=0) < 1e-6
        w, b, t = nw, nb, u
        if done:
            break
    return w, float(b)


def score_texts(texts: list[str | None], model: dict) -> np.ndarray:
    z = np.full(len(texts), model["bias"])
    for first, n, row, col, rate in rates(texts, model["index"]):
        z[first : first + n] += np.bincount(row, model["weights"][col] * rate, minlength=n)
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def score(docs: DataFrame, model: dict, *, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with score_col from 0 to 1 for the whole text; null and empty texts get the bias alone.

    A column of docs with that name is replaced. Rows are independent: repeated rows score alike,
    and no other column is read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return lean(lambda batches: (pa.array(score_texts(texts.to_pylist(), shared.value), pa.float64()) for texts in batches))(batches)

    return docs.withColumn(score_col, scored(F.col(text_col)))


def train(docs: DataFrame, labels: DataFrame, *, id_col="doc_id", text_col="text", label_col="toxic", max_toxic=MAX_TOXIC, max_clean=MAX_CLEAN) -> dict:
    """Fit on at most max_toxic + max_clean labelled documents that aren't held out."""
    return fit(*sample(docs, labels, id_col, text_col, label_col, max_toxic, max_clean))


def keep_clean(docs: DataFrame, model: dict, *, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs without those that score at least threshold; same columns."""
    (name,) = fresh(docs, "_toxicity")
    return score(docs, model, text_col=text_col, score_col=name).where(F.col(name) < threshold).drop(name)


def query(spark, sf_dir: str) -> DataFrame:
    """op4: every document scored by a model fitted on the labels that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
