"""The pipeline's stages against plain restatements of what each may keep."""

import re
import string

import corpus_pipeline
import pytest

from loomset.llm.base import Scratch

SF = "/root/testdata/sf0.01"
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


@pytest.fixture(scope="module")
def stages(spark):
    scratch, out = Scratch(spark), [spark.read.parquet(f"{SF}/documents.parquet")]
    for _, stage in corpus_pipeline.STAGES:
        out.append(scratch.cut(stage(spark, out[-1], SF)))
    return out


def test_filters_keep_whole_rows_of_their_input(stages):
    for before, after in zip(stages[:4], stages[1:4]):
        assert after.columns == before.columns
        assert after.exceptAll(before).count() == 0


def test_quality_keeps_clean_documents(spark, stages):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in stages[1].select("doc_id").collect()}
    good = [i for i, q in labels.items() if q == 1]
    bad = [i for i, q in labels.items() if q == 0]
    assert sum(i in kept for i in good) >= 0.97 * len(good) and sum(i in kept for i in bad) <= 0.1 * len(bad)


def test_one_of_each_group_stays(stages):
    from test_llm_sets import near_groups

    rows = [(r.doc_id, r.text) for r in stages[1].select("doc_id", "text").collect()]
    want = sorted(d for d, n, c in near_groups(rows) if n == 0 or d == c)
    assert sorted(r.doc_id for r in stages[2].select("doc_id").collect()) == want


def test_benchmark_windows_are_gone(spark, stages):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))

    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = words(r.text)
        windows |= {tuple(w[s:s + 10]) for s in range(max(len(w) - 10, 0) + 1)}
    clean = []
    for r in stages[2].collect():
        w = words(r.text)
        if not any(tuple(w[s:s + 10]) in windows for s in range(max(len(w) - 10, 0) + 1)):
            clean.append(r.doc_id)
    assert sorted(r.doc_id for r in stages[3].collect()) == sorted(clean)


def test_mix_and_tokens(stages):
    mix = stages[4]
    assert mix.columns == stages[3].columns and mix.select("doc_id").distinct().join(stages[3], "doc_id").count() == mix.select("doc_id").distinct().count()
    ids = sorted(r.doc_id for r in stages[5].collect())
    assert ids == sorted(r.doc_id for r in mix.collect())
