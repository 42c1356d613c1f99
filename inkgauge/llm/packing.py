"""Packing token sequences: shortest-pack-first over the length histogram.

Texts become ids, ids are cut into pieces of at most seq_len, and only the histogram of piece
lengths (at most seq_len rows) reaches the driver. There lengths are placed longest first, each
into the packs with the least in them that still have room. Packs that are alike are one
interval of sequence numbers, so placing a length many times costs no more than placing it
once; a placement reads "pieces of length L with ranks a.. go to sequences b.. at offset o". The
placements (their number depends on seq_len, not on the documents) are broadcast, and each piece finds its place by its
rank among the pieces of its length. Ranks come from windows over (length, part) with parts that
grow with the length's count, so that a hot length is many tasks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from inkgauge.llm.common import lean, stage, table
from inkgauge.llm.tokens import word_bpe

SEQ_LEN = 4096
END_ID = 2
#: Texts that go to the tokenizer at once, in characters; a longer text goes alone.
BATCH_CHARS = 1 << 20
PART_ROWS = 256
PARTS = 4096

PIECES = "doc_id {id}, doc_part long, start long, length long, ids_crc32 long, doc_tokens long"


def batches(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Stretches of texts of about BATCH_CHARS."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    first, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > BATCH_CHARS:
            yield first, i
            first, total = i, 0
        total += int(n)
    if len(sizes):
        yield first, len(sizes)


def tokenised(found: pa.RecordBatch, text_col: str, path: str, end_id: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, its ids with the end id) for each row of a batch."""
    model = word_bpe(path)
    texts = found.column(text_col)
    for a, b in batches(texts):
        flat, cut = model.batch(texts.slice(a, b - a))
        for i in range(b - a):
            yield a + i, np.append(flat[cut[i] : cut[i + 1]], np.uint32(end_id))
        pa.default_memory_pool().release_unused()


def pieces(docs: DataFrame, *, path: str, id_col: str = "doc_id", text_col: str = "text", seq_len: int = SEQ_LEN, end_id: int = END_ID) -> DataFrame:
    """A row for each piece of at most seq_len ids; a document is its text's ids and end_id."""

    def cut(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            rows, start, length, crc, whole = [], [], [], [], []
            for row, ids in tokenised(batch, "text", path, end_id):
                for a in range(0, len(ids), seq_len):
                    part = ids[a : a + seq_len]
                    rows.append(row)
                    start.append(a)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.astype("<u4").tobytes()))
                    whole.append(len(ids))
            at = pa.array(rows, pa.int64())
            long = lambda x: pa.array(x, pa.int64())
            yield pa.record_batch([batch.column("id").take(at), batch.column("doc_part").take(at), *map(long, (start, length, crc, whole))], names=["doc_id", "doc_part", "start", "length", "ids_crc32", "doc_tokens"])

    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(id_col, text_col).alias("doc_part"))
    return chosen.mapInArrow(lean(cut, keep=True), PIECES.format(id=chosen.schema["id"].dataType.simpleString()))


def place(histogram: dict[int, int], seq_len: int) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, count, first sequence, offset) of each placement.

    Longest length first, into the shortest packs that have room: a heap of intervals of alike
    packs by what they hold. Intervals that one length has filled up stay where they are.
    """
    packs: list[tuple[int, int, int]] = []  # (filled, first sequence, count)
    out, sequences = [], 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            if packs and packs[0][0] + length <= seq_len:
                filled, first, count = heappop(packs)
                n = min(left, count)
                if n < count:
                    heappush(packs, (filled, first + n, count - n))
            else:
                filled, first, n = 0, sequences, left
                sequences += n
            out.append((length, rank, n, first, filled))
            heappush(packs, (filled + length, first, n))
            left, rank = left - n, rank + n
    return out


def pack(docs: DataFrame, *, path: str, id_col: str = "doc_id", text_col: str = "text", seq_len: int = SEQ_LEN, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row for each piece.

    Null and empty texts are the end id alone; repeated rows and ids are packed each on their own;
    other columns of docs are ignored; an empty table gives no rows. Reruns agree: ranks follow
    a hash of id and text, then start; pieces alike in these are interchangeable.
    """
    found = stage(pieces(docs, path=path, id_col=id_col, text_col=text_col, seq_len=seq_len, end_id=end_id), "pieces")
    lengths = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = sorted(place(lengths, seq_len))
    columns = [np.array([p[i] for p in plan], np.int64) for i in range(5)]
    parts = np.ones(seq_len + 1, np.int64)
    for length, n in lengths.items():
        parts[length] = min(PARTS, -(-n // PART_ROWS))
    spread = F.element_at(F.array(*[F.lit(int(p)) for p in parts]), (F.col("length") + 1).cast("int")) if len(lengths) and parts.max() > 1 else F.lit(1)
    dealt = found.withColumn("part", F.pmod("doc_part", spread))
    within = F.row_number().over(W.partitionBy("length", "part").orderBy("doc_part", "doc_id", "start")) - 1
    counts = dealt.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = counts.select("length", "part", (F.sum("n").over(W.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    ranked = dealt.withColumn("within", within).join(before, ["length", "part"]).withColumn("rank", F.col("within") + F.col("before"))
    shared = docs.sparkSession.sparkContext.broadcast(columns)
    span = int(max(lengths.values(), default=0)) + 1

    @F.arrow_udf("sequence_id long, offset long")
    def placed(length: pa.Array, rank: pa.Array) -> pa.Array:
        size, first, _, sequence, offset = shared.value
        length, rank = length.to_numpy(), rank.to_numpy()
        at = np.searchsorted(size * span + first, length * span + rank, side="right") - 1
        return pa.StructArray.from_arrays([pa.array(sequence[at] + rank - first[at]), pa.array(offset[at])], names=["sequence_id", "offset"])

    done = ranked.withColumn("at", placed(F.col("length"), F.col("rank")))
    return done.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", F.col("at.sequence_id").alias("sequence_id"), F.col("at.offset").alias("offset"))


def sequences(docs: DataFrame, plan: DataFrame, *, path: str, id_col: str = "doc_id", text_col: str = "text", seq_len: int = SEQ_LEN, end_id: int = END_ID) -> DataFrame:
    """(sequence_id, ids array<int>) of a plan that pack() made, for docs with unique ids: what a trainer reads.

    Texts are tokenised again where they lie; only ids are shuffled, each once.
    """

    def cut(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            rows, start, ids_ = [], [], []
            for row, ids in tokenised(batch, "text", path, end_id):
                for a in range(0, len(ids), seq_len):
                    rows.append(row)
                    start.append(a)
                    ids_.append(ids[a : a + seq_len].astype(np.int32))
            yield pa.record_batch([batch.column("id").take(pa.array(rows, pa.int64())), pa.array(start, pa.int64()), pa.array(ids_, pa.list_(pa.int32()))], names=["_id", "_start", "ids"])

    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    made = chosen.mapInArrow(lean(cut, keep=True), f"_id {chosen.schema['id'].dataType.simpleString()}, _start long, ids array<int>")
    on = plan["doc_id"].eqNullSafe(made["_id"]) & (plan["start"] == made["_start"])
    joined = plan.join(made, on).groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return joined.select("sequence_id", F.flatten("parts.ids").alias("ids"))


def query(spark, sf_dir: str) -> DataFrame:
    """op1: all documents in sequences of at most 4096 ids of the word_bpe_49k vocabulary."""
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), path=public_tokenizers.path("word_bpe_49k.json"))
