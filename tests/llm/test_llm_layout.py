"""Sharding, manifest and periodic runs against plain restatements."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomset.llm import manifest, repeats, sharding
from loomset.llm.base import Scratch

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, source string, lang string, n_chars bigint, text string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# ---- sharding

def plain_ring(shards, replicas):
    nodes = []
    for s in range(shards):
        for r in range(replicas):
            h = hashlib.md5(f"ring:{s}:{r}".encode()).hexdigest()
            nodes.append((int(h[:4], 16) // 4, h, s))
    return sorted(nodes)


def plain_shards(keys, weights, shards, replicas, caps):
    """One key after the other, in the order of their hashes."""
    nodes, load, out = plain_ring(shards, replicas), [0] * shards, {}
    hashes = [hashlib.md5(f"key:{'' if k is None else k}".encode()).hexdigest() for k in keys]
    for i in sorted(range(len(keys)), key=lambda i: (hashes[i][4:], i)):
        cell = int(hashes[i][:4], 16) // 4
        at = next((j for j, n in enumerate(nodes) if n[0] >= cell), 0)
        shard = next(nodes[(at + j) % len(nodes)][2] for j in range(len(nodes)) if load[nodes[(at + j) % len(nodes)][2]] < caps[nodes[(at + j) % len(nodes)][2]])
        load[shard] += weights[i]
        out[i] = shard
    return out


@pytest.mark.parametrize(("shards", "slack", "weighed"), [(8, 0.0, False), (3, 0.1, True)])
def test_ring_equals_one_key_after_the_other(spark, shards, slack, weighed):
    rng = random.Random(shards)
    ids = list(range(400)) + [None]
    rows = [(i, rng.randrange(1, 50)) for i in ids]
    df = spark.createDataFrame(rows, "doc_id bigint, w int").coalesce(1)
    placed, names = sharding.ring_shards(df, weight=F.col("w") if weighed else None, shards=shards, slack=slack, replicas=20)
    got = {r.doc_id: r[names["shard"]] for r in placed.collect()}
    weights = [w if weighed else 1 for _, w in rows]
    want = plain_shards(ids, weights, shards, 20, sharding._caps(sum(weights), shards, slack))
    assert got == {ids[i]: s for i, s in want.items()}


def test_shard_digests(spark):
    rng = random.Random(3)
    texts = [None, "", "é𝒳", "x" * 100_000, *("w" * rng.randrange(90) for _ in range(60))]
    rows = [(i, t, 1, "s", 2) for i, t in enumerate(texts)] + [(7, "many", 1, "s", 2)] * 40 + [(None, "none", 1, "s", 2)]
    got = sharding.shard_digests(spark.createDataFrame(rows, "doc_id bigint, text string, shard int, at string, weight int")).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    sizes = [len(slots[s]) for s in range(8)]
    assert max(sizes) - min(sizes) <= 1 and {r.law for r in got} == {"rows"} and {r.grown_shard for r in got} == {None}
    assert sharding.shard_digests(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_a_further_shard_moves_few_keys(spark):
    df = spark.range(4000).withColumnRenamed("id", "doc_id")
    a, b = (dict(sharding.ring_shards(df, shards=n, slack=0.25)[0].select("doc_id", "shard").collect()) for n in (8, 9))
    assert sum(a[k] != b[k] for k in a) / len(a) < 0.16  # a ninth is the least that can move


def test_written_shards(spark, tmp_path):
    rows = [(i, "t" * (i % 7), "s") for i in range(50)] + [(3, None, "s")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    told = sharding.write_shards(docs, str(tmp_path / "out"), 4).collect()
    assert sorted(r.rows for r in told) == [12, 13, 13, 13] and sum(r.bytes for r in told) == sum(len(t or "") + 1 for _, t, _ in rows)
    back = spark.read.parquet(str(tmp_path / "out")).select("doc_id", "text", "source").collect()
    assert sorted(map(tuple, back), key=repr) == sorted(rows, key=repr)
    with pytest.raises(ValueError):
        sharding.ring(spark, 1000)


# ---- manifest

def plain_leaf(row):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def plain_levels(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i:i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def plain_path(levels, at):
    return [(levels[k][(at >> k) ^ 1] if (at >> k) ^ 1 < len(levels[k]) else None, (at >> k) & 1) for k in range(len(levels) - 1)]


def plain_manifest(rows):
    trees = defaultdict(list)
    for r in rows:
        trees["" if r[2] is None else "+" + r[2]].append((r[0] is not None, r[0] or 0, plain_leaf(r), r))
    names = sorted(trees, key=str.encode)
    built = {n: plain_levels([x[2] for x in sorted(trees[n], key=lambda x: x[:3])]) for n in names}
    top = plain_levels([built[n][-1][0] for n in names])
    out = []
    for n in names:
        for i, (_, _, leaf, r) in enumerate(sorted(trees[n], key=lambda x: x[:3])):
            path = plain_path(built[n], i) + plain_path(top, names.index(n))
            h = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None:
                h = plain_leaf((*r[:3], r[3] + 1, r[4]))
            for s, right in path:
                h = sha(*([h] if s is None else [s, h] if right else [h, s]))
            out.append((r[0], leaf, built[n][-1][0], top[-1][0], sha(*(s for s, _ in path if s)), h, h == top[-1][0]))
    return sorted(out, key=repr)


def manifest_rows(n, langs, seed=0):
    rng = random.Random(seed)
    return [(i, rng.choice(["a", None, "é"]), rng.choice(langs), rng.choice([None, 5, 17]), rng.choice([None, "", "text é𝒳", "y" * 3000])) for i in range(n)]


@pytest.mark.parametrize("rows", [
    manifest_rows(1, ["en"]), manifest_rows(2, [None]), manifest_rows(300, ["en"] * 20 + ["de", None, "é", "z", "Z"]),
    manifest_rows(67, ["en"]) + [(5, "a", "en", 1, "x")] * 3 + [(None, "a", "en", 1, "x"), (None, "a", None, 1, None)],
    manifest_rows(90, [f"l{i}" for i in range(80)]), manifest_rows(4200, ["en"] * 60 + ["fr"])])
def test_manifest_equals_plain_trees(spark, rows):
    df = spark.createDataFrame([(*r, 1, "c") for r in rows], DOCS + ", tree int, level string")
    got = sorted((tuple(r) for r in manifest.manifest_digests(df).select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=repr)
    assert got == plain_manifest(rows)


def test_manifest_of_nothing(spark):
    assert manifest.manifest_digests(spark.createDataFrame([], DOCS)).count() == 0


def test_intervals_cover_and_nest(spark):
    scratch = Scratch(spark)
    rows = spark.createDataFrame([("+a", i, f"{i:04}") for i in range(131)] + [("", 1, "x")], "tree string, k int, digest string")
    nodes = manifest.build(manifest.in_trees(rows, scratch, ["k"]), scratch).collect()
    for level in range(9):
        spans = sorted((r.lo, r.hi) for r in nodes if r.tree == "+a" and r.level == level)
        assert spans[0][0] == 0 and spans[-1][1] == 131 and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
    assert {(r.level, r.lo, r.hi) for r in nodes if r.tree == ""} == {(0, 0, 1)}


def test_written_manifest_finds_changed_rows(spark, tmp_path):
    rows = manifest_rows(150, ["en", "de", None], 4)
    docs = spark.createDataFrame(rows, DOCS)
    manifest.write_manifest(docs, str(tmp_path / "m"))
    changed = docs.withColumn("text", F.when(F.col("doc_id") % 10 == 3, F.concat(F.coalesce("text", F.lit("")), F.lit("!"))).otherwise(F.col("text")))
    told = {r.doc_id: r.verified for r in manifest.verified_rows(changed, str(tmp_path / "m")).collect()}
    assert told == {i: i % 10 != 3 for i in range(150)}


# ---- periodic runs

def plain_runs(words):
    out = {}
    for p in range(1, len(words) // 4 + 1):
        i = 0
        while i < len(words) - p:
            j = i
            while j < len(words) - p and words[j] == words[j + p]:
                j += 1
            if j > i and j + p - i >= max(6, 4 * p):
                out.setdefault((i, j + p), p)
            i = max(j, i + 1)
    return sorted((s, e - s, p) for (s, e), p in out.items())


def made_words(rng, kinds):
    out = []
    for _ in range(rng.randrange(6)):
        out += [rng.randrange(kinds) for _ in range(rng.randrange(1, 12))] * rng.randrange(1, 9) + [rng.randrange(kinds) for _ in range(rng.randrange(5))]
    return out


@pytest.mark.parametrize("seed", range(40))
def test_runs_equal_brute_force(seed):
    rng = random.Random(seed)
    texts = [made_words(rng, rng.choice([1, 2, 3, 5])) for _ in range(8)]
    length = np.array([len(t) for t in texts], np.int64)
    found = [[] for _ in texts]
    for t, *run in zip(*(x.tolist() for x in repeats.runs(np.array(sum(texts, []), np.int64), np.cumsum(length) - length, length)), strict=True):
        found[t].append(tuple(run))
    assert found == [plain_runs(t) for t in texts]


def test_grammar_agreement():
    rng = random.Random(5)
    for _ in range(30):
        s = np.array([*([rng.randrange(2) for _ in range(rng.randrange(1, 9))] * rng.randrange(1, 30)), rng.randrange(2), -1])
        forwards, backwards = repeats.grammar(s)
        n = len(s) - 1
        pairs = [(i, j) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.2]
        if not pairs:
            continue
        a, b = (np.array(x) for x in zip(*pairs, strict=True))
        want = [next((k for k in range(n) if s[i + k] != s[j + k]), 0) for i, j in pairs]
        assert repeats.agreement(forwards, a, b).tolist() == want
        assert all(w <= len(s) - j for w, j in zip(want, b, strict=True))


def test_small_grids_give_the_same_runs(monkeypatch):
    rng = random.Random(9)
    words = np.array(made_words(rng, 2) + [0, 1] * 300, np.int64)
    whole = [x.tolist() for x in repeats.runs(words, np.array([0]), np.array([len(words)]))]
    monkeypatch.setattr(repeats, "GRID", 50)
    assert [x.tolist() for x in repeats.runs(words, np.array([0]), np.array([len(words)]))] == whole


def plain_run_row(i, text):
    words = (text or "").encode().split()
    n, h = len(words), None if i is None else zlib.crc32(str(i).encode())
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (k - a) % p] for k in range(a, n)]
    found = plain_runs(words)
    gone = {k for s, m, p in found for k in range(s + p, s + m)}
    best = min(found, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=None)
    return (i, len(found), *(best or (None, None, None)), best and 1000 * best[1] // best[2],
            sha("".join(f"{s},{m},{p}\n" for s, m, p in found)), hashlib.sha256(b" ".join(w for k, w in enumerate(words) if k not in gone)).hexdigest())


def run_rows(df):
    return sorted((tuple(r) for r in repeats.run_digests(df).select(
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect()), key=repr)


def test_run_digests_of_odd_texts(spark):
    texts = [None, "", " \t\n", "a", "a a a a a a", "a a a a a", "é é é é é é x", "x " * 1500, "a b " * 5 + "a c " * 5, "A a A a A a A a", "w\x0bw\x0cw w w w",
             " ".join(map(str, range(1500)))]
    rows = [(i, t, 1, "r") for i, t in enumerate(texts * 3)] + [(None, "a a a a a a", 1, "r"), (4, texts[4], 1, "r"), (4, texts[4], 1, "r")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, runs int, words string")
    assert run_rows(df) == sorted((plain_run_row(i, t) for i, t, *_ in rows), key=repr)
    assert run_rows(spark.createDataFrame([], "doc_id bigint, text string")) == []


def test_run_digests_of_the_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert run_rows(docs) == sorted((plain_run_row(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()), key=repr)
