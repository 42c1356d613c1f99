"""Maximum inner product search with score-aware anisotropic product quantisation.

Vectors are cut into two-dimensional subspaces with 16 centres each, one four-bit code a subspace.
Codebooks and codes minimise |r|^2 + (eta - 1) * (r . x / |x|)^2 of the residual r: error along
the vector, which is what shifts large inner products, costs eta times the rest. Codebooks come
from a bounded sample by coordinate descent; every row is coded and searched.

A search broadcasts the queries where they fit in one bounded block, and else deals blocks of queries
and stretches of rows into a grid of tasks. Tasks scan their rows' codes, two four-bit codes a byte and so one 256-entry table a byte. The best by table
sum are scored with inner products of the original vectors in double precision; their k-th score
is a floor. Then every row is scored whose table sum plus the bound on its error, query norm times
residual norm, reaches the floor, so the k nearest are exact, ties by smaller id. Each
task hands on at most k rows for a query, merged in two rounds of window functions.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from inkgauge.llm.common import stage, table

CENTRES = 16
SUB_DIM = 2
#: Rows that train the codebooks, by least hash of the id.
SAMPLE = 16_384
#: Queries broadcast at once.
QUERY_BLOCK = 8_192
#: Rows that meet a block of queries in one task where queries fill several blocks.
GRID_ROWS = 262_144
#: Rows of a task that are scanned together, and how many of them set a query's first floor.
SCAN_ROWS = 16_384
RERANK = 160
#: Queries scored together in a task.
SCAN_QUERIES = 256
#: Pairs of a query and a row scored at once.
EXACT_PAIRS = 32_768
#: What rounding in float32 tables and sums can add to an error, as a share of the norms; 64 additions stay below it.
ROUNDING = 1e-5
#: What the order of summing can change in double precision, as a share of the norms for each component.
SLACK = 1e-15


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, list[int]]:
    """(id, vector array<double>) of the vectors that take part, and their dimensions, the most frequent first.

    Null, empty and zero vectors and those with null or non-finite components take no part, nor do null ids.
    """
    v = F.col(vector_col).cast("array<double>")
    fine = ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    found = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("vector")).where("id is not null and vector is not null and size(vector) > 0")
    found = found.where(fine & F.exists("vector", lambda x: x != 0))
    return found, [r["d"] for r in found.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").collect()]


def halves(x: np.ndarray) -> np.ndarray:
    """(n, d) -> (subspaces, n, SUB_DIM); an odd dimension gets a zero component."""
    n, d = x.shape
    pad = -d % SUB_DIM
    x = np.pad(x, ((0, 0), (0, pad))) if pad else x
    return np.ascontiguousarray(x.reshape(n, -1, SUB_DIM).transpose(1, 0, 2))


def encode(x: np.ndarray, books: np.ndarray, eta: float, sweeps: int = 2) -> np.ndarray:
    """(n, subspaces) codes by coordinate descent on the anisotropic loss."""
    unit = halves(x / np.linalg.norm(x, axis=1, keepdims=True))
    sub = halves(x)
    m = len(books)
    codes = np.empty((len(x), m), np.uint8)
    along = np.zeros(len(x))
    rows = np.arange(len(x))
    parts = np.zeros((m, len(x)))
    for s in range(sweeps + 1):
        for j in range(m):
            away = sub[j][:, None, :] - books[j][None]
            square = (away**2).sum(-1)
            if s == 0:  # the start: nearest centres
                best = square.argmin(1)
            else:
                along -= parts[j]
                best = (square + (eta - 1) * (along[:, None] + (away * unit[j][:, None, :]).sum(-1)) ** 2).argmin(1)
            codes[:, j] = best
            parts[j] = ((sub[j] - books[j][best]) * unit[j]).sum(-1)
            along += parts[j]
    return codes


def train(x: np.ndarray, eta: float, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """(subspaces, CENTRES, SUB_DIM) codebooks: codes and centres in turn, each lowering the loss."""
    rng = np.random.default_rng(seed)
    sub, unit = halves(x), halves(x / np.linalg.norm(x, axis=1, keepdims=True))
    books = np.stack([s[rng.choice(len(s), CENTRES, replace=len(s) < CENTRES)] for s in sub])
    eye = np.eye(SUB_DIM)
    for _ in range(rounds):
        codes = encode(x, books, eta, 1)
        part = np.stack([((sub[j] - books[j][codes[:, j]]) * unit[j]).sum(-1) for j in range(len(sub))])
        for j in range(len(sub)):
            along = part.sum(0) - part[j]
            u = unit[j]
            a = eye + (eta - 1) * u[:, :, None] * u[:, None, :]
            b = sub[j] + (eta - 1) * u * (along + (u * sub[j]).sum(-1))[:, None]
            for c in range(CENTRES):
                own = codes[:, j] == c
                books[j, c] = np.linalg.solve(a[own].sum(0), b[own].sum(0)) if own.any() else sub[j][rng.integers(len(x))]
            part[j] = ((sub[j] - books[j][codes[:, j]]) * u).sum(-1)
    return books


def anisotropy(d: int, threshold: float = 0.2) -> float:
    """eta for inner products above threshold times the norm."""
    return max(1.0, (d - 1) * threshold**2 / (1 - threshold**2))


def pairs(codes: np.ndarray) -> np.ndarray:
    """Two four-bit codes a byte, (bytes, n)."""
    if codes.shape[1] % 2:
        codes = np.pad(codes, ((0, 0), (0, 1)))
    return np.ascontiguousarray((codes[:, 0::2] | codes[:, 1::2] << 4).T)


def tables(queries: np.ndarray, books: np.ndarray) -> np.ndarray:
    """(bytes, 256, queries) float32: the inner product that each byte of codes adds."""
    sub = halves(queries)
    one = np.einsum("jcd,jqd->jcq", books, sub)
    if len(one) % 2:
        one = np.concatenate([one, np.zeros_like(one[:1])])
    return (one[1::2][:, :, None, :] + one[0::2][:, None, :, :]).reshape(len(one) // 2, 256, -1).astype(np.float32)


def reach(x: np.ndarray, codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    """What a row's inner product with a query of norm 1 can exceed its table sum by: the residual norm and rounding."""
    lost = np.sqrt(((halves(x) - books[np.arange(len(books))[:, None], codes.T]) ** 2).sum((0, 2)))
    return lost + ROUNDING * max(1.0, len(books) / 64) * (np.linalg.norm(x, axis=1) + lost)


def exact(x: np.ndarray, q: np.ndarray, row: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Inner products of pairs, each summed from the first component to the last, so that copies tie and any engine agrees."""
    out = np.zeros(len(row))
    for a in range(0, len(row), EXACT_PAIRS):
        part = slice(a, a + EXACT_PAIRS)
        out[part] = np.add.accumulate(x[row[part]] * q[number[part]], axis=1)[:, -1]
    return out


def near(x: np.ndarray, q: np.ndarray, row: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Inner products of pairs in any order of summing: SLACK of the norms from exact() at most."""
    out = np.empty(len(row))
    for a in range(0, len(row), EXACT_PAIRS):
        part = slice(a, a + EXACT_PAIRS)
        out[part] = np.einsum("pd,pd->p", x[row[part]], q[number[part]])
    return out


def scan(
    ids: np.ndarray, x: np.ndarray, packed: np.ndarray, reaches: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, books: np.ndarray, k: int, rerank: int, floors: np.ndarray
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query number, row number, score) of the k best of these rows for each query, a block of queries at a time.

    Rows below a query's floor, a score that k rows are known to reach, may be left out.
    """
    keep = min(len(ids), max(rerank, k + 1))
    norms = np.linalg.norm(queries, axis=1)
    slack = SLACK * x.shape[1] * norms * np.linalg.norm(x, axis=1).max(initial=0.0)
    for a in range(0, len(queries), SCAN_QUERIES):
        q = queries[a : a + SCAN_QUERIES]
        t = tables(q, books)
        total = np.zeros((len(ids), len(q)), np.float32)
        for byte, column in zip(t, packed, strict=True):
            total += byte[column]
        approx = np.ascontiguousarray(total.T)
        own = ids[None, :] == query_ids[a : a + SCAN_QUERIES, None]
        approx[own] = -np.inf
        top = np.argpartition(approx, len(ids) - keep, axis=1)[:, len(ids) - keep :] if keep < len(ids) else np.broadcast_to(np.arange(len(ids)), approx.shape)
        first = near(x, q, top.ravel(), np.repeat(np.arange(len(q)), keep)).reshape(top.shape)
        first[np.take_along_axis(own, top, 1)] = -np.inf
        floor = floors[a : a + SCAN_QUERIES]
        if keep >= k:
            floor = np.maximum(floor, np.partition(first, keep - k, axis=1)[:, keep - k] - slack[a : a + SCAN_QUERIES])
        number, row = [], []
        for i in range(len(q)):
            below = approx[i] + norms[a + i] * reaches < floor[i]
            below &= np.isfinite(approx[i])
            r = np.flatnonzero(~(below | own[i]))
            number.append(np.full(len(r), i))
            row.append(r)
        number, row = np.concatenate(number), np.concatenate(row)
        fine = near(x, q, row, number) >= (floor - slack[a : a + SCAN_QUERIES])[number]
        number, row = number[fine], row[fine]
        score = exact(x, q, row, number)
        order = np.lexsort((ids[row], -score, number))
        order = order[np.arange(len(order)) - np.searchsorted(number[order], number[order]) < k]
        yield number[order] + a, row[order], score[order]


def build(vectors: DataFrame, dim: int, *, sample: int = SAMPLE, threshold: float = 0.2) -> tuple[np.ndarray, float]:
    """Codebooks from at most sample rows, and eta."""
    order = F.xxhash64("id", F.lit(7))
    rows = vectors.select("id", "vector").orderBy(order, "id").limit(sample).toArrow()
    flat = rows.column("vector").combine_chunks()
    x = (flat.flatten() if len(rows) else pa.array([], pa.float64())).to_numpy().reshape(-1, max(dim, 1))
    eta = anisotropy(dim, threshold)
    return (train(x, eta) if len(x) else np.zeros((1, CENTRES, SUB_DIM))), eta


def index(vectors: DataFrame, books: np.ndarray, eta: float) -> DataFrame:
    """(id, vector, codes, reach): every row coded, two four-bit codes a byte, with the bound on the error of its sums."""
    shared = vectors.sparkSession.sparkContext.broadcast(books)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("vector").flatten().to_numpy().reshape(batch.num_rows, -1)
            found = encode(x, shared.value, eta)
            codes = pa.array([c.tobytes() for c in pairs(found).T], pa.binary())
            yield pa.record_batch([batch.column("id"), batch.column("vector"), codes, pa.array(reach(x, found, shared.value))], names=["id", "vector", "codes", "reach"])

    return vectors.mapInArrow(run, "id long, vector array<double>, codes binary, reach double")


def search(indexed: DataFrame, queries: DataFrame, books: np.ndarray, *, k: int = 20, rerank: int = RERANK, block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row (id, vector) of queries its k nearest of indexed.

    Equal to brute force in double precision, ties by smaller id; rerank only decides cost. A candidate
    with the query's id is the query's own and left out. Repeated candidate ids count as rows of their own,
    repeated queries as one. Fewer than k candidates give all of them; no queries or no candidates give no rows.

    Queries that fit in one block are broadcast and meet every row where it lies. More are dealt into
    blocks and rows into stretches, and a task takes a cell of that grid: a row is sent once for each
    block, and no broadcast grows with the queries.
    """
    spark = indexed.sparkSession
    held = stage(queries.select("id", "vector").dropDuplicates(["id"]), "queries")
    blocks = -(-held.count() // block)
    schema = "query_id long, vec_id long, score double"
    if blocks <= 1:
        got = held.orderBy("id").toArrow()
        shared = spark.sparkContext.broadcast((*_arrays(got), books))
        found = indexed.mapInArrow(lambda batches: _scanned(batches, *shared.value, k, rerank), schema)
    else:
        shared = spark.sparkContext.broadcast(books)
        stretches = max(1, -(-indexed.count() // GRID_ROWS))
        upto = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        left = held.withColumn("_block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("_stretch", upto(stretches))
        right = indexed.withColumn("_stretch", F.pmod(F.xxhash64("id", F.lit(3)), F.lit(stretches)).cast("int")).withColumn("_block", upto(blocks))

        def cell(asked: pa.Table, rows: pa.Table) -> pa.Table:
            ids, q = _arrays(asked)
            out = list(_scanned(iter(rows.to_batches()), ids, q, shared.value, k, rerank)) if len(ids) else []
            return pa.Table.from_batches(out) if out else pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})

        by = ("_block", "_stretch")
        found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(cell, schema)
    best = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("int")
    return found.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _arrays(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids, and vectors as one matrix."""
    ids = rows.column("id").to_numpy()
    flat = rows.column("vector").combine_chunks()
    return ids, (flat.flatten() if len(ids) else pa.array([], pa.float64())).to_numpy().reshape(len(ids), -1 if len(ids) else 0)


def _scanned(batches: Iterator[pa.RecordBatch], query_ids: np.ndarray, q: np.ndarray, books: np.ndarray, k: int, rerank: int) -> Iterator[pa.RecordBatch]:
    """(query_id, vec_id, score) of the best k of these rows for each query."""
    if not len(query_ids):
        return
    best = None  # (number, id, score) of the best k so far for each query
    floors = np.full(len(q), -np.inf)
    for a in _stretches(batches):
        ids = a.column("id").to_numpy()
        x = a.column("vector").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        packed = np.ascontiguousarray(np.frombuffer(b"".join(a.column("codes").to_pylist()), np.uint8).reshape(len(ids), -1).T)
        new = [np.concatenate(c) for c in zip(*((n, ids[r], s) for n, r, s in scan(ids, x, packed, a.column("reach").to_numpy(), query_ids, q, books, k, rerank, floors)), strict=True)]
        if best is not None:
            new = [np.concatenate(c) for c in zip(best, new, strict=True)]
            order = np.lexsort((new[1], -new[2], new[0]))
            number = new[0][order]
            nth = np.arange(len(order)) - np.searchsorted(number, number)
            new = [c[order[nth < k]] for c in new]
        best = new
        number, at, count = np.unique(best[0], return_index=True, return_counts=True)
        full = count >= k
        floors[number[full]] = best[2][at[full] + k - 1]
    if best is not None:
        yield pa.record_batch([pa.array(query_ids[best[0]]), pa.array(best[1]), pa.array(best[2])], names=["query_id", "vec_id", "score"])


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, n = [], 0
    for batch in batches:
        for a in range(0, batch.num_rows, SCAN_ROWS):
            part = batch.slice(a, SCAN_ROWS)
            held.append(part)
            n += part.num_rows
            if n >= SCAN_ROWS:
                yield pa.Table.from_batches(held)
                held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def nearest(vectors: DataFrame, asked: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of each usable vector for which asked, a condition on id, holds.

    A vector is compared with those of its dimension, as no others have an inner product with it; each dimension has codebooks and an index of its own.
    """
    found, dims = usable(vectors, id_col, vector_col)
    parts = []
    for dim in dims or [0]:
        own = found.where(F.size("vector") == dim)
        books, eta = build(own, dim)
        parts.append(search(stage(index(own, books, eta), "index"), own.where(asked), books, k=k))
    return reduce(DataFrame.unionAll, parts)


def query(spark, sf_dir: str) -> DataFrame:
    """op7: the 20 nearest by inner product of every vector whose id 20 divides."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


#: All inner products of the queries.
SQL = r"""
WITH v AS (
  SELECT vec_id::BIGINT AS id, embedding::DOUBLE[] AS e FROM embeddings
), u AS (
  SELECT id, e FROM v WHERE id IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), s AS (
  SELECT q.id AS query_id, c.id AS vec_id, list_inner_product(q.e, c.e) AS score FROM u q JOIN u c ON q.id % 20 = 0 AND c.id <> q.id AND len(c.e) = len(q.e)
)
SELECT query_id, rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s) WHERE rank <= 20
"""
