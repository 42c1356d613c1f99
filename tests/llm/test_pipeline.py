"""The corpus pipeline: each stage on what its predecessor kept, against plain Python; odd and empty tables."""

import collections
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from inkgauge.llm import toxicity
from tests.llm.test_corpus import PATH, WORDS, corpus, split

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, host string, line string, size long"
NAMES = [n.split()[0] for n in SCHEMA.split(", ")]


def rows():
    rng = random.Random(11)
    fresh = lambda n: " ".join(rng.choice(WORDS) + rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))
    odd = [(None, fresh(60) + "\nall rights kept\t\r", "s0"), (None, None, None)]
    toxic = [(i, fresh(40) + " grubworm vilescum" * 3, f"s{i % 3}") for i in range(300, 360)]
    plain = [(i, "all rights kept\n" + fresh(rng.choice([30, 80])), f"s{i % 3}") for i in range(400, 520)]
    very_long = [(600, " ".join(rng.choice(WORDS) + str(rng.randrange(10**6)) for _ in range(60_000)), "s1")]
    every = [r for r in corpus() if r[0] is not None] + odd + toxic + plain + very_long
    return [(i, t, "en", s, len(t) if t is not None else None, 0.5, "h", "l", 7) for i, t, s in every]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    given = rows()
    spark.createDataFrame(given, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, int("grubworm" in (t or ""))) for i, t, *_ in given if i is not None] + [(None, 1), (7, None)]
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), [collections.Counter(given)]
    for name, function in corpus_pipeline.STAGES:
        function(spark, docs, folder).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        out.append(collections.Counter(map(tuple, docs.collect())) if name != "packing" else docs.collect())
        if name != "packing":
            assert docs.columns == NAMES
    return folder, out


def test_toxic_documents_go_and_others_stay(spark, stages):
    folder, out = stages
    model = toxicity.train(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    want = collections.Counter({r: n for r, n in out[0].items() if toxicity.score_texts([r[1]], model)[0] < toxicity.THRESHOLD})
    assert out[1] == want
    assert {r[0] for r in out[0] - out[1]} == set(range(300, 360))


def test_boilerplate_lines_go(stages):
    _, out = stages
    pages, having = collections.Counter(), collections.Counter()
    for r, n in out[1].items():
        pages[r[3]] += n
        for line in {x.strip(" \t\r") for x in (r[1] or "").split("\n")} - {""}:
            having[r[3], line] += n
    bad = {k for k, n in having.items() if n > 0.05 * pages[k[0]] and n >= 3}
    want = collections.Counter()
    for r, n in out[1].items():
        t = r[1]
        if t is not None:
            t = "\n".join(x for x in t.split("\n") if (r[3], x.strip(" \t\r")) not in bad)
        want[(r[0], t, r[2], r[3], len(t) if t is not None else None, *r[5:])] += n
    assert out[2] == want and ("s1", "all rights kept") in bad


def test_one_of_each_group_stays(stages):
    _, out = stages
    given = [r for r, n in out[2].items() for _ in range(n)]

    def shingles(text):
        w = split("".join(c.lower() if c.isascii() else c for c in text or ""))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets, group = [shingles(r[1]) for r in given], list(range(len(given)))
    find = lambda i: i if group[i] == i else find(group[i])
    for i in range(len(given)):
        for j in range(i):
            both = len(sets[i] & sets[j]) if sets[i] and sets[j] else 0
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                group[find(i)] = find(j)
    least = {}
    for i, r in enumerate(given):
        if sets[i]:
            g = find(i)
            least[g] = min(least.get(g, (True, 0)), (r[0] is None, r[0] or 0))
    want = sorted([(r[0] is None, r[0] or 0) for i, r in enumerate(given) if not sets[i]] + list(least.values()))
    assert sorted((r[0] is None, r[0] or 0) for r, n in out[3].items() for _ in range(n)) == want
    assert not out[3] - out[2] and len(want) < len(given)


def test_mix_meets_targets(stages):
    _, out = stages
    size, taken = collections.Counter(), collections.Counter()
    for r, n in out[3].items():
        size[r[3]] += n * len(split(r[1]))
    for r, n in out[4].items():
        taken[r[3]] += n * len(split(r[1]))
        assert r in out[3] and n <= 3 * out[3][r]
    order = sorted((s for s in size if s is not None)) + [None] * (None in size)
    held, weight = {}, {s: i % 3 + 1 for i, s in enumerate(order)}
    while True:
        rest = [s for s in order if s not in held]
        level = (sum(size.values()) - sum(held.values())) / max(1, sum(weight[s] for s in rest))
        new = {s: 3 * size[s] for s in rest if level * weight[s] > 3 * size[s]}
        if not new:
            break
        held |= new
    for s in order:
        target = held.get(s, level * weight[s])
        mine = [len(split(r[1])) for r in out[3] if r[3] == s and split(r[1])]
        assert abs(taken[s] - target) <= max(mine), s


def test_pieces_hold_every_id_once(stages):
    _, out = stages
    tokenizer = Tokenizer.from_file(PATH)
    fill, got, want = collections.defaultdict(list), collections.Counter(), collections.Counter()
    for p in out[5]:
        fill[p["sequence_id"]].append((p["offset"], p["length"]))
        got[p["doc_id"], p["doc_tokens"], p["start"], p["length"], p["ids_crc32"]] += 1
    for spans in fill.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 4096
    cuts = collections.defaultdict(set)
    for i, total, start, length, _ in got:
        cuts[i, total].add((start, length))
    for r, n in out[4].items():
        ids = [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 2]
        for start, length in cuts[r[0], len(ids)]:
            want[r[0], len(ids), start, length, zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())] += n
        assert sum(length for _, length in cuts[r[0], len(ids)]) == len(ids)
    assert got == want


def test_run_gives_the_last_stage(spark, stages):
    folder, out = stages
    pick = lambda found: collections.Counter((p["doc_id"], p["start"], p["length"], p["ids_crc32"], p["doc_tokens"]) for p in found)
    assert pick(corpus_pipeline.run(spark, folder).collect()) == pick(out[5])


@pytest.mark.parametrize("labels", [[], [(1, 1), (2, 0)]])
def test_empty_tables(spark, tmp_path, labels):
    folder = str(tmp_path)
    spark.createDataFrame([], SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0
    for name, function in corpus_pipeline.STAGES[:-1]:
        assert function(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder).columns == NAMES, name


def test_stage_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "n-gram Jaccard join", "mixing sources", "packing"]
