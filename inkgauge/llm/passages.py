"""Substring dedup by repeated-phrase automata.

A window is `size` consecutive words. A word goes when a window that covers it also starts in a
document with a smaller id.

1. Anchors. Each window is represented by the least hash of its ANCHOR-word grams; equal windows have
   equal anchors, and neighbouring windows mostly share one. Anchors found under two ids at least
   are recurring; a Bloom filter of them, bounded, goes to all tasks.
2. Confirm. Windows with a recurring anchor are aggregated by hash to their least and greatest
   id; those with two ids recur, and the least id owns them.
3. Phrases. Each owner's text gives its runs of owned windows: every recurring window lies whole in
   exactly one phrase of its owner.
4. Automata. Phrases are cut into tiles of half a window, any window holds a whole tile, and
   compiled into sharded Aho-Corasick automata over word numbers (pyahocorasick). Documents and phrases
   meet in the shard of their anchors' first document; shards are split by the words of their
   phrases and of their documents, so neither a hot passage nor a large dictionary meets in one task.
   Documents without a recurring anchor can't match and aren't sent.
5. Occurrences. A tile found in a document is extended both ways along its phrase; an occurrence of a
   window or more, owned by a smaller id, is a span to remove.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkgauge.llm import bloom
from inkgauge.llm.common import stage, table
from inkgauge.llm.shingles import Chunk, chunks, hashed, long_windows, sliding_min, windows

WINDOW = 50
ANCHOR = 10
#: Words of phrases in one automaton, and words of documents streamed through it by one task, about.
PHRASE_WORDS = 100_000
STREAM_WORDS = 300_000
BATCH = 1 << 18
ANCHOR_BITS = 26
#: log2 of the edges that a node of an automaton has at most.
SYMBOL_BITS = 5


def anchors(c: Chunk, size: int) -> np.ndarray:
    """The anchor of the window that starts at each word of a chunk (windows over texts included)."""
    k = min(ANCHOR, size)
    return sliding_min(windows(c.hashes, k), size - k + 1)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").split()


def digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _profiles(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            found, n = [], []
            for c in chunks(texts):
                a = anchors(c, size)
                for b, e in zip(c.cut[:-1].tolist(), c.cut[1:].tolist(), strict=True):
                    n.append(e - b)
                    found.append(np.unique(a[b : e - size + 1]).view(np.int64) if e - b >= size else a[:0].view(np.int64))
            kept = [digest(words_of(t)) for t in texts]
            yield pa.record_batch([batch.column("id"), batch.column("row_key"), pa.array(n, pa.int64()), pa.array(kept), pa.array(found, pa.list_(pa.int64()))], names=["id", "row_key", "n_words", "sha256", "anchors"])

    return run


def _windows(shared, size: int):
    """(window, id) of the windows with a recurring anchor, once for a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, who, n = [], [], 0
        for batch in batches:
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            for c in chunks(batch.column("text").to_pylist()):
                a = anchors(c, size)
                if not len(a):
                    continue
                start = np.arange(len(a))
                text = np.searchsorted(c.cut, start, side="right") - 1
                fine = start + size <= c.cut[np.minimum(text + 1, len(c.cut) - 1)]
                at = np.flatnonzero(fine & bloom.among(shared.value, a.view(np.int64)))
                if not len(at):
                    continue
                w, t = long_windows(c.hashes, size)[at], text[at]
                order = np.lexsort((w, t))
                w, t = w[order], t[order]
                new = np.concatenate(([True], (w[1:] != w[:-1]) | (t[1:] != t[:-1])))
                found.append(w[new].view(np.int64))
                who.append(ids[c.first + t[new]])
                n += len(found[-1])
                if n >= BATCH:
                    yield pa.record_batch({"window": pa.array(np.concatenate(found)), "id": pa.array(np.concatenate(who), pa.int64())})
                    found, who, n = [], [], 0
        if n:
            yield pa.record_batch({"window": pa.array(np.concatenate(found)), "id": pa.array(np.concatenate(who), pa.int64())})

    return run


def _phrases(size: int):
    """(owner, phrase, words, anchors) of each run of owned windows in the owners' texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for owner, text, own in zip(*(batch.column(c).to_pylist() for c in ("id", "text", "owned")), strict=True):
                words = words_of(text)
                c = hashed(0, [b" ".join(words)])
                a, w = anchors(c, size).view(np.int64), long_windows(c.hashes, size).view(np.int64)
                _, first = np.unique(w, return_index=True)
                once = np.zeros(len(w), bool)
                once[first] = True
                held = np.concatenate(([False], once & np.isin(w, np.array(own, np.int64)), [False]))
                edge = np.flatnonzero(held[1:] != held[:-1])
                for b, e in zip(edge[0::2].tolist(), edge[1::2].tolist(), strict=True):
                    rows.append((owner, b" ".join(words[b : e + size - 1]).decode("utf-8", "replace"), e - b + size - 1, np.unique(a[b:e]).tolist()))
            kinds = {"owner": pa.int64(), "phrase": pa.string(), "words": pa.int64(), "anchors": pa.list_(pa.int64())}
            yield pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds.values())], names=list(kinds))

    return run


class Dictionary:
    """The automaton of some phrases' tiles, over numbers of the words in them."""

    def __init__(self, owners: list[int], phrases: list[str], size: int):
        self.size = size
        c = hashed(0, [p.encode() for p in phrases])
        self.known, number = np.unique(c.hashes, return_inverse=True)
        self.numbers, self.cut = number.astype(np.int32) + 1, c.cut
        self.raw, self.begin = self.numbers.tobytes(), self.cut.tolist()
        tile = max(1, size // 2)
        self.tile = tile
        self.places: list[list[tuple[int, int, int, int]]] = []
        at: dict[str, int] = {}
        self.symbols = max(1, -(-len(self.known).bit_length() // SYMBOL_BITS))
        text = self.spelled(self.numbers)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for p in range(len(phrases)):
            first, length = int(self.cut[p]), int(self.cut[p + 1] - self.cut[p])
            for o in range(0, length - tile + 1, tile):
                key = text[(first + o) * self.symbols : (first + o + tile) * self.symbols]
                if key not in at:
                    at[key] = len(self.places)
                    self.places.append([])
                    self.automaton.add_word(key, at[key])
                self.places[at[key]].append((p, o, length, owners[p]))
        for found in self.places:
            found.sort(key=lambda x: -x[2])
        self.automaton.make_automaton()

    def spelled(self, number: np.ndarray) -> str:
        """Word numbers as characters, as many for each, those at each place from an alphabet of their own.

        The automaton looks through a node's edges one by one: few edges a node keep that short, and
        separate alphabets keep matches at word boundaries.
        """
        places = range(self.symbols)
        parts = [(number >> SYMBOL_BITS * j & (1 << SYMBOL_BITS) - 1) + (256 + (j << SYMBOL_BITS)) for j in places]
        return np.stack(parts, 1).astype("<u4").tobytes().decode("utf-32-le")

    def spans(self, doc: int, hashes: np.ndarray) -> list[tuple[int, int]]:
        """[start, end) of the occurrences of at least a window of phrases that a smaller id owns.

        A phrase that couldn't reach a word not covered yet is passed over; places are longest
        phrase first, so that in near copies few are compared. Comparisons are of bytes where the
        whole reach is equal, else of numbers.
        """
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        number = np.where(self.known[at] == hashes, at + 1, 0).astype(np.int32)
        n, raw, covered = len(number), number.tobytes(), bytearray(len(number))
        words, begin = self.raw, self.begin
        out, compared = [], {}  # how far each phrase was compared, by how it lies
        for end, key in self.automaton.iter(self.spelled(number)):
            start = (end + 1) // self.symbols - self.tile
            for p, o, length, owner in self.places[key]:
                if owner >= doc:
                    continue
                low, high = max(0, start - o), min(n, start - o + length)
                if high - low < self.size or not covered.count(0, low, high):
                    continue
                if compared.get((p, start - o), 0) >= start + self.tile:
                    continue
                base = begin[p] + o - start
                if raw[4 * low : 4 * high] != words[4 * (base + low) : 4 * (base + high)]:
                    differ = np.flatnonzero(number[low:high] != self.numbers[base + low : base + high])
                    k = int(differ.searchsorted(start - low))
                    low, high = low + (int(differ[k - 1]) + 1 if k else 0), low + int(differ[k]) if k < len(differ) else high
                compared[p, start - o] = high
                if high - low >= self.size:
                    out.append((low, high))
                    covered[low:high] = b"\1" * (high - low)
        return out


def _located(size: int):
    def run(phrases: pa.Table, docs: pa.Table) -> pa.Table:
        key, start, end = [], [], []
        if len(phrases) and len(docs):
            d = Dictionary(phrases.column("owner").to_pylist(), phrases.column("phrase").to_pylist(), size)
            ids, keys = docs.column("id").to_pylist(), docs.column("row_key").to_pylist()
            for c in chunks(docs.column("text").to_pylist()):
                for i in range(len(c.cut) - 1):
                    for a, b in merged(d.spans(ids[c.first + i], c.hashes[c.cut[i] : c.cut[i + 1]])):
                        key.append(keys[c.first + i])
                        start.append(a)
                        end.append(b)
        return pa.table({"row_key": pa.array(key, pa.int64()), "start": pa.array(start, pa.int64()), "end": pa.array(end, pa.int64())})

    return run


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        gone, kept = [], []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            words, left, at = words_of(text), [], 0
            for a, b in merged([(s["start"], s["end"]) for s in spans]):
                left += words[at:a]
                at = b
            left += words[at:]
            gone.append(len(words) - len(left))
            kept.append(b" ".join(left).decode("utf-8", "replace"))
        yield pa.record_batch([batch.column("row_key"), pa.array(gone, pa.int64()), pa.array(kept)], names=["row_key", "n_removed", "kept"])


class Passages:
    """Recurring passages of docs; see dedup_passages()."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, size: int):
        self.size = size
        self.docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(id_col, text_col).alias("row_key"))
        self.rows = stage(self.docs.mapInArrow(_profiles(size), "id long, row_key long, n_words long, sha256 string, anchors array<long>"), "profiles")
        found = self.rows.where("id is not null").select("id", "row_key", F.explode("anchors").alias("anchor"))
        by = found.groupBy("anchor").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high")
        self.recurring = stage(by.select("anchor", F.col("low").alias("first")), "anchors")
        routes = found.join(self.recurring, "anchor").select("id", "row_key", "first").distinct()
        self.routes = stage(routes, "routes")

    def phrases(self) -> DataFrame:
        """(owner, phrase, words, anchors): every recurring window, in its owner's runs."""
        asked = bloom.build(self.recurring.select("anchor"), ANCHOR_BITS)
        found = self.docs.where("id is not null").select("id", "text").mapInArrow(_windows(asked, self.size), "window long, id long")
        owned = found.groupBy("window").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high")
        owned = stage(owned.groupBy(F.col("low").alias("id")).agg(F.collect_list("window").alias("owned")), "owned")
        owners = bloom.build(owned.select("id"))
        texts = self.docs.where("id is not null").where(bloom.may_contain(owners, F.col("id"))).select("id", "text")
        return stage(texts.join(owned, "id").mapInArrow(_phrases(self.size), "owner long, phrase string, words long, anchors array<long>"), "phrases")

    def spans(self) -> DataFrame:
        """(row_key, start, end) in words, staged; spans of a row may overlap."""
        phrases = self.phrases().withColumn("phrase_key", F.xxhash64("owner", "phrase"))
        total = phrases.agg(F.sum("words")).first()[0] or 0
        shards = max(1, -(-total // PHRASE_WORDS))
        shard = F.pmod(F.xxhash64("first"), F.lit(shards))
        dealt = phrases.select("phrase_key", "words", F.explode("anchors").alias("anchor")).join(self.recurring, "anchor").select("phrase_key", "words", shard.alias("shard")).distinct()
        dealt = stage(dealt, "dealt")
        to_docs = stage(self.routes.select("row_key", shard.alias("shard")).distinct().join(self.rows.select("row_key", "n_words").distinct(), "row_key"), "to-docs")
        parts = dealt.groupBy("shard").agg(F.ceil(F.sum("words") / (2 * PHRASE_WORDS)).alias("parts"))
        salts = to_docs.groupBy("shard").agg(F.ceil(F.sum("n_words") / STREAM_WORDS).alias("salts"))
        grid = stage(parts.join(salts, "shard"), "grid")
        upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        left = dealt.join(grid, "shard").select("phrase_key", "shard", F.pmod("phrase_key", "parts").alias("part"), upto("salts").alias("salt"))
        right = to_docs.join(grid, "shard").select("row_key", "shard", F.pmod(F.xxhash64("row_key", F.lit(1)), "salts").alias("salt"), upto("parts").alias("part"))
        asked = bloom.build(right.select("row_key").distinct())
        texts = self.docs.where("id is not null").where(bloom.may_contain(asked, F.col("row_key")))
        left = left.join(phrases.select("phrase_key", "owner", "phrase"), "phrase_key").select("shard", "part", "salt", "owner", "phrase")
        right = right.join(texts, "row_key").select("shard", "part", "salt", "id", "row_key", "text")
        cell = ("shard", "part", "salt")
        got = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(_located(self.size), "row_key long, start long, end long")
        return stage(got, "spans")

    def cleaned(self) -> DataFrame:
        """(row_key, n_removed, kept) of the rows that lose words, one a key."""
        by_row = self.spans().distinct().groupBy("row_key").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
        by_row = stage(by_row, "by-row")
        asked = bloom.build(by_row.select("row_key"))
        texts = self.docs.where(bloom.may_contain(asked, F.col("row_key"))).select("row_key", "text")
        return texts.join(by_row, "row_key").mapInArrow(_cleaned, "row_key long, n_removed long, kept string").dropDuplicates(["row_key"])


def dedup_passages(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """One row for each row of docs: id_col, n_words, n_removed, kept (the kept words, or null where all stay), kept_sha256.

    Null and empty texts have no words. Rows with a null id neither remove nor lose words; rows
    of one id don't remove each other's; a passage repeated only within one id stays. Repeated rows are rows of
    their own with equal results. Ids must cast to long. An empty table gives no rows; other columns are ignored.
    """
    run = Passages(docs, id_col, text_col, size)
    less = run.cleaned()
    joined = run.rows.select("id", "row_key", "n_words", "sha256").join(less, "row_key", "left")
    return joined.select(
        F.col("id").alias(id_col), "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), "kept",
        F.when(F.col("n_removed").isNull(), F.col("sha256")).otherwise(F.sha2("kept", 256)).alias("kept_sha256"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    """op8: documents, windows of 50 words."""
    return dedup_passages(table(spark, sf_dir, "documents")).drop("kept")


#: All windows by their digest.
SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), x AS (
  SELECT r, doc_id, unnest(generate_series(1, len(w) - 49)) AS i, w FROM d WHERE doc_id IS NOT NULL
), y AS (
  SELECT r, doc_id, i, sha256(array_to_string(w[i:i + 49], ' ')) AS k FROM x
), z AS (
  SELECT r, i, doc_id > min(doc_id) OVER (PARTITION BY k) AS gone FROM y
), o AS (
  SELECT DISTINCT r, unnest(generate_series(i, i + 49)) AS j FROM z WHERE gone
), e AS (
  SELECT r, unnest(w) AS v, generate_subscripts(w, 1) AS j FROM d
), m AS (
  SELECT r, count(*) FILTER (o.j IS NOT NULL) AS n_removed, string_agg(v, ' ' ORDER BY e.j) FILTER (o.j IS NULL) AS kept
  FROM e LEFT JOIN o USING (r, j) GROUP BY r
)
SELECT doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN m USING (r)
"""
