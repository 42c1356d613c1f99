"""N-gram Jaccard join by prefix filtering under several global token orders.

Texts with equal shingle sets are one class (a 64-bit signature of the set). Under any global
order of shingles two sets that reach the threshold share one among their first
n - ceil(t n) + 1; this holds for each order, so a candidate must share prefix tokens under
all of them, and the place of the first shared one bounds the overlap under each. The first order,
rarest first, makes posting lists. Tokens that stand in one prefix only are dropped before lists are
made. Pairs that pass the place bound of the first order are filtered by both later orders, hash
permutations of which the upper 16 bits of each hash are kept (which may only let more pairs through).
What is left is compared, first by parity sketches, which bound the difference from below, then by whole sets.

Only components are asked for, so a posting list isn't expanded into all pairs. In a first round
each list links its members to one leader, the member whose prefix has the token earliest (the
centre of a group of near copies). In the second only members of different components meet, which
makes the result exact; a list of more than LONG members is split there by the prefix tokens of the
second order, and then of the third, so that members meet that share a token under every order.

Orders may be any as long as they are fixed; frequencies only decide cost. They come from one
pass over all texts that counts, in stretches of bounded size, tokens found more than once; the
most frequent HEAVY tokens are broadcast, all others count as rare.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkgauge.llm import bloom
from inkgauge.llm.common import fresh, lean, stage, table
from inkgauge.llm.components import components
from inkgauge.llm.shingles import mixed, shingle_sets

#: Tokens whose frequencies are broadcast (12 bytes each).
HEAVY = 1 << 19
#: Tokens that a task counts together.
STRETCH = 1 << 20
#: Signatures that a task remembers so as to work on equal sets once.
SEEN = 1 << 18
#: Prefix tokens in an output batch.
BATCH = 1 << 17
#: Members of a list that meet without splitting it by the next order.
LONG = 4096


def signature(tokens: np.ndarray) -> int:
    """64 bits of a non-empty set, signed."""
    total = mixed(mixed(tokens, 3).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(tokens)), 4)
    return int(total.view(np.int64)[0])


def sketch(tokens: np.ndarray) -> np.ndarray:
    """Parities of the tokens in each of a power of two of cells, as many as tokens or more, 64 a word.

    The cells in which two sketches differ are no more than the tokens in which the sets differ; a
    sketch is folded to half its cells by xor of its halves.
    """
    log = max(6, (len(tokens) - 1).bit_length())
    cell = mixed(tokens, 20) & np.uint64((1 << log) - 1)
    odd = np.bincount(cell.astype(np.int64), minlength=1 << log) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def prefix_size(n: int, num: int, den: int) -> int:
    return n + (-num * n // den) + 1


def _profiles(k: int):
    """Rows of kind 0: (row columns, n, cls); of kind 1: (token, docs that have it in this stretch), two at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held, size = [], 0

        def counted():
            token, count = np.unique(np.concatenate(held), return_counts=True)
            more = count > 1
            token, count = token[more].view(np.int64), count[more]
            n = len(token)
            null = pa.nulls(n, pa.int64())
            return pa.record_batch([pa.nulls(n, kind), null, null, pa.array(count), pa.array(token)], names=names)

        names = ["id", "row_key", "cls", "n", "token"]
        kind = pa.int64()
        for batch in batches:
            kind = batch.column("id").type
            n, cls = [], []
            for tokens in shingle_sets(batch.column("text").to_pylist(), k):
                n.append(len(tokens))
                cls.append(signature(tokens) if len(tokens) else None)
                if len(tokens) and cls[-1] not in seen:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(cls[-1])
                    held.append(tokens)
                    size += len(tokens)
                    if size >= STRETCH:
                        yield counted()
                        held, size = [], 0
            yield pa.record_batch([batch.column("id"), batch.column("row_key"), pa.array(cls, pa.int64()), pa.array(n, pa.int64()), pa.nulls(len(n), pa.int64())], names=names)
        if size:
            yield counted()

    return run


def heavy_tokens(counts: DataFrame, most: int = HEAVY) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, frequencies), sorted by token, of at most `most` tokens: all from some power of two of the frequency on."""
    total = stage(counts.groupBy("token").agg(F.sum("n").alias("n")), "frequencies")
    by = {r["p"]: r["c"] for r in total.groupBy(F.floor(F.log2("n")).alias("p")).agg(F.count("*").alias("c")).collect()}
    least, room = 62, most
    for p in sorted(by, reverse=True):
        if by[p] > room:
            break
        least, room = p, room - by[p]
    got = total.where(F.col("n") >= 2**least).toArrow()
    token, n = got.column("token").to_numpy().view(np.uint64), got.column("n").to_numpy()
    order = np.argsort(token)
    return token[order], np.minimum(n[order], 0xFFFF).astype(np.uint16)


class Orders:
    """Three global orders: rank(tokens, o) sorts tokens under order o."""

    def __init__(self, token: np.ndarray, n: np.ndarray):
        self.token, self.n = token, n
        self.sieve = np.zeros(1 << 22, bool)
        self.sieve[token >> np.uint64(42)] = True

    def rank(self, tokens: np.ndarray, o: int) -> np.ndarray:
        if o:
            return mixed(tokens, 10 + o)
        often = np.zeros(len(tokens), np.uint64)
        at = np.flatnonzero(self.sieve[tokens >> np.uint64(42)])
        if len(at):
            found = np.minimum(np.searchsorted(self.token, tokens[at]), len(self.token) - 1)
            often[at] = np.where(self.token[found] == tokens[at], self.n[found], 0)
        return often << np.uint64(48) | mixed(tokens, 10) >> np.uint64(16)

    def prefix(self, tokens: np.ndarray, o: int, size: int) -> np.ndarray:
        rank = self.rank(tokens, o)
        if size < len(tokens) // 2:
            near = np.argpartition(rank, size - 1)[:size]
            return tokens[near[np.argsort(rank[near])]]
        return tokens[np.argsort(rank)[:size]]


def _texts(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(signature, tokens) of the non-empty sets, equal ones once while they are remembered."""
    seen: set[int] = set()
    for batch in batches:
        for tokens in shingle_sets(batch.column("text").to_pylist(), k):
            if not len(tokens) or (own := signature(tokens)) in seen:
                continue
            if len(seen) >= SEEN:
                seen.clear()
            seen.add(own)
            yield own, tokens


def _prefixes(shared, k: int, num: int, den: int):
    """The tokens of all prefixes under the first order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, size = [], 0
        for _, tokens in _texts(batches, k):
            token.append(shared.value.prefix(tokens, 0, prefix_size(len(tokens), num, den)))
            size += len(token[-1])
            if size >= BATCH:
                yield pa.record_batch({"token": pa.array(np.concatenate(token).view(np.int64))})
                token, size = [], 0
        if size:
            yield pa.record_batch({"token": pa.array(np.concatenate(token).view(np.int64))})

    return run


def _records(shared, recurring, k: int, num: int, den: int):
    """(cls, n, first array<struct<token, pos>>, second, third, sketch) of the sets with prefix tokens that may stand in other prefixes too.

    first are those tokens under the first order; second and third the prefixes under the others, in
    their order, the upper 16 bits of each hash.
    """
    first = pa.list_(pa.struct([("token", pa.int64()), ("pos", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0

        def sent(rows):
            own, n, token, pos, second, third, parity = zip(*rows, strict=True)
            listed = lambda parts, kind: pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), kind)
            pairs = pa.StructArray.from_arrays([pa.array(np.concatenate(token).view(np.int64)), pa.array(np.concatenate(pos), pa.int32())], fields=list(first.value_type))
            return pa.record_batch([pa.array(own, pa.int64()), pa.array(n, pa.int32()), listed(token, pairs), listed(second, pa.array(np.concatenate(second))), listed(third, pa.array(np.concatenate(third))), listed(parity, pa.array(np.concatenate(parity)))], names=["cls", "n", "first", "second", "third", "sketch"])

        for own, tokens in _texts(batches, k):
            p = prefix_size(len(tokens), num, den)
            token = shared.value.prefix(tokens, 0, p)
            at = np.flatnonzero(bloom.among(recurring.value, token.view(np.int64)))
            if len(at):
                later = [(shared.value.rank(shared.value.prefix(tokens, o, p), o) >> np.uint64(48)).astype(np.uint16).view(np.int16) for o in (1, 2)]
                rows.append((own, len(tokens), token[at], at, *later, sketch(tokens)))
                size += len(at) + 2 * p
                if size >= BATCH:
                    yield sent(rows)
                    rows, size = [], 0
        if rows:
            yield sent(rows)

    return run


def _sets(wanted, k: int):
    """(cls, tokens) of the rows whose row_key may be wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent(own, sets):
            return pa.record_batch({"cls": pa.array(own, pa.int64()), "tokens": pa.array(sets, pa.list_(pa.int64()))})

        def chosen():
            for batch in batches:
                asked = bloom.among(wanted.value, batch.column("row_key").to_numpy())
                yield batch if asked.all() else batch.filter(pa.array(asked))

        own, sets, size = [], [], 0
        for key, tokens in _texts(chosen(), k):
            own.append(key)
            sets.append(tokens.view(np.int64))
            size += len(tokens)
            if size >= BATCH:
                yield sent(own, sets)
                own, sets, size = [], [], 0
        if own:
            yield sent(own, sets)

    return run


def _possible(n1: Column, p1: Column, n2: Column, p2: Column, num: int, den: int) -> Column:
    """The bound on the overlap of two sets whose first common token lies at these places reaches the threshold."""
    return F.least(n1 - p1, n2 - p2) * (num + den) >= (n1 + n2) * num


class Join:
    """One run of the join over docs; see near_duplicates()."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, k: int, num: int, den: int):
        self.rule = (k, num, den)
        self.num, self.den = num, den
        self.docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(id_col, text_col).alias("row_key"))
        kind = self.docs.schema["id"].dataType.simpleString()
        found = stage(self.docs.mapInArrow(lean(_profiles(k)), f"id {kind}, row_key long, cls long, n long, token long"), "profiles")
        self.rows = found.where("token is null").select("id", "row_key", "cls", "n")
        heavy = heavy_tokens(found.where("token is not null").select("token", "n"))
        self.orders = docs.sparkSession.sparkContext.broadcast(Orders(*heavy))
        self.classes = stage(
            self.rows.where("cls is not null").groupBy("cls").agg(F.min(F.struct("id", "row_key")).alias("rep"), F.min("id").alias("least")).select("cls", F.col("rep.row_key").alias("row_key"), "least"),
            "classes",
        )

    def fits(self, n1, p1, n2, p2) -> Column:
        return _possible(F.col(n1), F.col(p1), F.col(n2), F.col(p2), self.num, self.den)

    def prepare(self) -> None:
        """self.records, one a class, and self.lists: (token, pos, n, cls, lpos, ln, lcls, size) of the posting lists that hold two classes at least, with their leaders."""
        texts = self.docs.select("text")
        again = texts.mapInArrow(lean(_prefixes(self.orders, *self.rule)), "token long").groupBy("token").agg(F.count("*").alias("n")).where("n > 1").select("token")
        recurring = bloom.build(again)
        kinds = "cls long, n int, first array<struct<token:long,pos:int>>, second array<short>, third array<short>, sketch array<long>"
        self.records = stage(texts.mapInArrow(lean(_records(self.orders, recurring, *self.rule)), kinds).dropDuplicates(["cls"]), "records")
        for shared in (recurring, self.orders):  # else the driver keeps them to the end
            shared.destroy()
        postings = self.records.select("n", "cls", F.explode("first").alias("p")).select("p.token", "p.pos", "n", "cls").repartition("token")
        lead = postings.groupBy("token").agg(F.min(F.struct("pos", "n", "cls")).alias("lead"), F.count("*").alias("size")).where("size > 1")
        lead = lead.select("token", F.col("lead.pos").alias("lpos"), F.col("lead.n").alias("ln"), F.col("lead.cls").alias("lcls"), "size")
        self.lists = stage(postings.join(lead, "token"), "lists")
        self.longest = self.lists.agg(F.max("size")).first()[0] or 0

    def links(self, pairs: DataFrame) -> DataFrame:
        """Those of the staged pairs (a, b) that reach the threshold, staged: filtered by the later orders and the sketches, then compared."""

        def beside(df, of, *columns):
            for side in ("a", "b"):
                df = df.join(of.select(F.col("cls").alias(side), *[F.col(c).alias(c + side) for c in columns]), side)
            return df

        def nodes(df):
            return df.select(F.col("a").alias("cls")).unionAll(df.select("b")).distinct()

        def place(order, side, common):
            return F.array_position(order + side, common) - 1

        def folded(x, y):
            n = F.size(y)
            return F.when(F.size(x) > n, F.zip_with(F.slice(x, 1, n), F.slice(x, n + 1, n), lambda v, w: v.bitwiseXOR(w))).otherwise(x)

        def differ():
            """Cells in which two sketches differ; of unlike sizes the larger one is folded, and beyond twice the size 0 counts."""
            x, y = F.col("sketcha"), F.col("sketchb")
            far = F.greatest(F.size(x), F.size(y)) > 2 * F.least(F.size(x), F.size(y))
            words = F.zip_with(folded(x, y), folded(y, x), lambda v, w: F.bit_count(v.bitwiseXOR(w)))
            return F.when(far, 0).otherwise(F.aggregate(words, F.lit(0), lambda t, w: t + w))

        met = bloom.build(nodes(pairs))
        near, records = pairs, self.records.where(bloom.may_contain(met, F.col("cls")))
        close = differ() * (self.num + self.den) <= (F.col("na") + F.col("nb")) * (self.den - self.num)
        for order, more, exact in (("second", [], F.lit(True)), ("third", ["sketch"], close)):
            common = F.get(F.array_intersect(order + "a", order + "b"), F.lit(0))  # equal bits of different hashes only let more through, as both prefixes are in order
            fits = _possible(F.col("na"), place(order, "a", common), F.col("nb"), place(order, "b", common), self.num, self.den)
            near = stage(beside(near, records, "n", order, *more).where(common.isNotNull() & fits & exact).select("a", "b"), "candidates")
        met.destroy()
        wanted = bloom.build(nodes(near).join(self.classes, "cls").select("row_key"))
        sets = stage(self.docs.select("row_key", "text").mapInArrow(lean(_sets(wanted, self.rule[0])), "cls long, tokens array<long>"), "sets")
        wanted.destroy()
        both = F.size(F.array_intersect("tokensa", "tokensb"))
        either = F.size("tokensa") + F.size("tokensb") - both
        return stage(beside(near, sets, "tokens").where(both * self.den >= either * self.num).select("a", "b").distinct(), "links")

    def led(self) -> DataFrame:
        """(a, b), staged: the members of each list with its leader, the member whose prefix has the token earliest, if they can reach the threshold."""
        met = self.lists.where((F.col("cls") != F.col("lcls")) & self.fits("n", "pos", "ln", "lpos"))
        return stage(met.select(F.least("cls", "lcls").alias("a"), F.greatest("cls", "lcls").alias("b")).distinct(), "pairs")

    def across(self, links: DataFrame) -> DataFrame:
        """(a, b), staged: all pairs of the lists that can reach the threshold and lie in different components of links.

        A list of more than LONG members is split by the prefix tokens of the second order, and where such a
        part is still long, by those of the third: only members that share a token under each order meet.
        """
        roots = components(links).withColumnRenamed("node", "cls")
        known = stage(self.lists.select("token", "pos", "n", "cls").join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls")), "known")
        keys, places, found = ["token"], ["pos"], []

        def met(lists):
            x, y = lists.alias("x"), lists.alias("y")
            on = (F.col("x.cls") < F.col("y.cls")) & (F.col("x.root") != F.col("y.root"))
            for key in keys:
                on &= F.col("x." + key) == F.col("y." + key)
            for p in places:
                on &= self.fits("x.n", "x." + p, "y.n", "y." + p)
            return x.join(y, on).select(F.col("x.cls").alias("a"), F.col("y.cls").alias("b"))

        def sized(lists):
            dealt = lists.repartition(*keys)
            size = dealt.groupBy(*keys).agg(F.count("*").alias("size"), F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
            return dealt.join(size.drop("low", "high"), keys)

        lists = known
        for order in ("second", "third"):
            found.append(met(sized(lists).where(F.col("size") <= LONG).drop("size")))
            if self.longest <= LONG:
                break
            lists = stage(sized(lists).where(F.col("size") > LONG).drop("size"), "long")
            later = self.records.select("cls", F.posexplode(order).alias("p_" + order, order))
            lists = stage(lists.join(later, "cls"), "long")
            keys, places = [*keys, order], [*places, "p_" + order]
        else:
            found.append(met(lists))
        return stage(reduce(DataFrame.unionAll, found).distinct(), "pairs")

    def components(self) -> DataFrame:
        """(cls, root) of the classes that have links."""
        self.prepare()
        links = self.links(self.led())
        more = self.links(self.across(links))
        return stage(components(links.unionAll(more)), "roots")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row for each row of docs: id_col, n_shingles, component_id.

    Two texts link when den * |intersection| >= num * |union| of their distinct word shingles
    (A-Z lower-cased; fewer words are one shingle). component_id is the least non-null id that
    links reach. Null, empty and wordless texts have no shingles, link with nothing and are their own
    component; a null id is null in its row but its text links others. Repeated rows and ids are
    rows of their own. An empty table gives no rows; other columns are ignored.
    """
    found = with_components(Join(docs, id_col, text_col, words, num, den))
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("cls").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


def with_components(run: Join) -> DataFrame:
    """(id, row_key, cls, n, root, component_id) for each row; no component without shingles."""
    roots = run.components().withColumnRenamed("node", "cls")
    named = run.classes.join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return run.rows.join(named.join(least, "root").select("cls", "root", "component_id"), "cls", "left")


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs with one row of each group of near duplicates, that with the least id; same columns.

    Rows without words are in no group and all stay. Only rows that go, or that are repeated whole, are
    met by key; a Bloom filter lets all others pass without a shuffle.
    """
    found = stage(with_components(Join(docs, id_col, text_col, words, num, den)).where("cls is not null").select("id", "row_key", "root"), "groups")
    kept = found.groupBy("root").agg(F.min(F.struct(F.col("id").isNull(), "id", "row_key")).alias("kept")).select("root", F.col("kept.row_key").alias("kept"))
    by_key = found.join(kept, "root").groupBy("row_key").agg(F.min((F.col("row_key") != F.col("kept")).cast("int")).alias("gone"), F.count("*").alias("times"))
    asked = stage(by_key.where("gone = 1 or times > 1"), "asked")
    may = bloom.build(asked.select("row_key"))
    (key,) = fresh(docs, "_row_key")
    keyed = docs.withColumn(key, F.xxhash64(id_col, text_col))
    gone, twice = (asked.where(w).select(F.col("row_key").alias(key)) for w in ("gone = 1", "gone = 0"))
    some = keyed.where(bloom.may_contain(may, F.col(key))).join(gone, key, "left_anti")
    once = some.join(twice, key, "left_anti").unionByName(some.join(twice, key, "left_semi").dropDuplicates([key]))
    return keyed.where(~bloom.may_contain(may, F.col(key))).unionByName(once).select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    """op3: documents by 3-word shingles at 0.9."""
    return near_duplicates(table(spark, sf_dir, "documents"), words=3, num=90)


#: All pairs that share a shingle, and the rows their links reach.
SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT r, doc_id, list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(generate_series(1, len(w) - 2), lambda i: array_to_string(w[i:i + 2], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d
), x AS (
  SELECT r, len(g) AS n, unnest(g) AS g FROM s
), p AS (
  SELECT a.r AS a, b.r AS b FROM x a JOIN x b ON a.g = b.g AND a.r <> b.r AND 10 * a.n >= 9 * b.n AND 10 * b.n >= 9 * a.n
  GROUP BY a.r, b.r, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), reach AS (
  SELECT r AS a, r AS b FROM s UNION SELECT reach.a, p.b FROM reach JOIN p ON reach.b = p.a
)
SELECT s.doc_id, len(s.g) AS n_shingles, min(t.doc_id) AS component_id FROM s JOIN reach ON s.r = reach.a JOIN s t ON t.r = reach.b GROUP BY s.r, s.doc_id, s.g
"""
