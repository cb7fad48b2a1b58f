"""Exact and near duplicates, decontamination and the stage filters against brute force."""

import hashlib
import random
import re
import string
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from loomset.llm import contamination, exact, similar

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
SCHEMA = "doc_id bigint, text string"


def normal(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


TEXTS = [None, "", " ", "a  b", "a\tb", "a b", "x" * 5000, "x" * 4999 + "y", "x" * 5000, "é" * 2048 + "z", "é" * 2048 + "z", "𝒳" * 1024, "𝒳" * 1025]


def check_exact(spark, rows, **options):
    docs = spark.createDataFrame(rows, SCHEMA + ", name string, blocks int")
    got = exact.exact_duplicates(docs, **options).collect()
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[normal(t)].append(i)
    big = 1 << 62
    want = sorted((big if i is None else i, len(groups[normal(t)]), hashlib.sha256(normal(t).encode()).hexdigest(),
                   min((j for j in groups[normal(t)] if j is not None), default=None) or 0) for i, t, *_ in rows)
    assert sorted((big if r.doc_id is None else r.doc_id, r.group_size, r.text_sha256, r.keep_id or 0) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)


def test_exact_duplicates(spark):
    rows = [(i, t, "n", 1) for i, t in enumerate(TEXTS)] + [(None, "only null", "n", 1), (5, "a b", "n", 1), (None, "a b", "n", 1)]
    check_exact(spark, rows)


def test_exact_duplicates_with_colliding_fingerprints(spark):
    rows = [(i, t, "n", 1) for i, t in enumerate(TEXTS)] + [(20 + i, "".join(random.Random(i % 7).choices("ab ", k=300)), "n", 1) for i in range(30)]
    check_exact(spark, rows, block=16, fingerprint=lambda b: F.xxhash64(b) % 5)


def test_exact_duplicates_of_nothing(spark):
    assert exact.exact_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
    return {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def near_groups(rows):
    sets, up = [shingles(t) for _, t in rows], list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                up[top(i)] = top(j)
    ids = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        ids[top(i)].append(d)
    return [(d, len(sets[i]), min((x for x in ids[top(i)] if x is not None), default=None)) for i, (d, _) in enumerate(rows)]


def edited(rng, base, vocabulary):
    out = list(rng.choice(base))
    for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
        k = rng.randrange(len(out))
        if rng.random() < 0.5:
            out[k] = rng.choice(vocabulary)
        elif rng.random() < 0.5:
            out.insert(k, rng.choice(vocabulary))
        elif len(out) > 3:
            del out[k]
    return " ".join(out)


def key(r):
    return tuple((x is None, x or 0) for x in r)


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(11)
    vocabulary = [f"v{i}" for i in range(300)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(4, 80))] for _ in range(9)]
    rows = [(i, edited(rng, base, vocabulary)) for i in range(240)]
    rows += [(300, None), (301, ""), (302, " \n"), (303, "One"), (304, "one"), (305, "one two"), (306, "two one"), (None, rows[3][1]), (7, rows[7][1]),
             (307, "to to to to to of of of of of"), (308, "É é É é É é")]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("row", F.lit("x")).withColumn("digest", F.lit(1)).repartition(3)
    got = sorted((tuple(r) for r in similar.near_duplicates(docs).collect()), key=key)
    assert got == sorted(near_groups(rows), key=key)
    stay = similar.one_of_each(docs).collect()
    groups = defaultdict(set)
    for (d, t), (_, n, c) in zip(rows, near_groups(rows)):
        groups[("alone", d, t) if n == 0 else c].add(d)
    assert len(stay) == len(groups) and set(stay[0].asDict()) == {"doc_id", "text", "row", "digest"}


def test_near_duplicates_of_nothing(spark):
    assert similar.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    assert [tuple(r) for r in similar.near_duplicates(spark.createDataFrame([(None, None)], SCHEMA)).collect()] == [(None, 0, None)]


def test_signatures_keep_every_link():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    sets = []
    for _ in range(150):
        x = base[:rng.integers(1, 3000)].copy()
        new = rng.random(len(x)) < rng.choice([0.01, 0.06, 0.1, 0.15])
        x[new] = rng.integers(0, 2**63, new.sum(), dtype=np.uint64)
        sets.append(np.unique(x))
    sets.sort(key=len)
    sizes = np.array([len(x) for x in sets])
    signs = similar._Signs(sizes, [None if i == 70 else similar.signature(x).tobytes() for i, x in enumerate(sets)])
    linked = kept = total = 0
    for i in range(len(sets)):
        others = np.flatnonzero((np.arange(len(sets)) > i) & (3 * sizes <= 4 * sizes[i]))
        if not len(others):
            continue
        for j, may in zip(others, signs.may_link(i, others)):
            both = len(np.intersect1d(sets[i], sets[j]))
            total += 1
            kept += may
            if 7 * both >= 3 * (sizes[i] + sizes[j]):
                linked += 1
                assert may
    assert linked > 100 and kept < total


def test_prefix_tree_equals_intersection():
    rng = np.random.default_rng(5)
    universe = rng.integers(1, 1 << 62, 400).astype(np.uint64)
    base = universe[:120]
    sets = [rng.permutation(np.union1d(rng.choice(base, rng.integers(80, 121), replace=False), rng.choice(universe, rng.integers(0, 30)))) for _ in range(60)]
    rank = {int(x): i for i, x in enumerate(universe)}
    sets = [np.array(sorted(s, key=lambda x: rank[int(x)]), np.uint64) for s in sets]
    named = [(str(i).encode(), s) for i, s in enumerate(sets)]
    for probe in sets[:15]:
        want = {n for n, s in named if 100 * len(np.intersect1d(s, probe)) >= 75 * len(np.union1d(s, probe))}
        assert set(similar.tree_matches(probe, named, step=7)) == want


def plain_contamination(rows, items):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))

    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        for s in range(max(len(w) - 10, 0) + 1) if w else []:
            windows[tuple(w[s:s + 10])].add("" if i is None else str(i))
    out = []
    for d, t in rows:
        w, hit, found = words(t), set(), set()
        for win, ids in windows.items():
            for s in range(len(w) - len(win) + 1):
                if tuple(w[s:s + len(win)]) == win:
                    hit.update(range(s, s + len(win)))
                    found |= ids
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def test_contamination_equals_brute_force(spark):
    rng = random.Random(2)
    vocabulary = ["a", "b", "c", "d"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.randint(11, 25))) for i in range(12)] + [(20, "Solo"), (21, "two words"), (None, text(14)), (22, None), (23, " . "), (20, "a b c d a b c")]
    rows = [(i, text(rng.randint(0, 60))) for i in range(60)]
    rows += [(100 + i, f"x {t} y, {t}") for i, (_, t) in enumerate(items) if t] + [(200, None), (201, ""), (None, "solo SOLO"), (None, "solo SOLO"), (202, "solo"), (202, "b")]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("h", F.lit(1)).withColumn("w", F.lit(2))
    want = sorted(plain_contamination(rows, items), key=key)
    for block in (contamination.BLOCK_BYTES, 600):
        got = contamination.contamination(docs, spark.createDataFrame(items, "item_id bigint, text string"), block_bytes=block)
        assert sorted((tuple(r) for r in got.collect()), key=key) == want
    left = contamination.without_benchmarks(docs, spark.createDataFrame(items, "item_id bigint, text string"))
    assert left.columns == docs.columns and left.count() == sum(not r[-1] for r in want)


def test_contamination_without_items_or_documents(spark):
    none = spark.createDataFrame([], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, "a b"), (2, None)], SCHEMA)
    assert sorted(tuple(r)[:4] for r in contamination.contamination(docs, none).collect()) == [(1, 2, 0, 0), (2, 0, 0, 0)]
    assert contamination.contamination(spark.createDataFrame([], SCHEMA), spark.createDataFrame([(1, "a")], "item_id bigint, text string")).count() == 0
