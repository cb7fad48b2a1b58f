"""Language, quality, mixing, tokens and the pipeline: held-out accuracy, shares, exact round trips."""

import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomset.llm import language, mixing, quality, tokens
from loomset.llm.base import Scratch

SF = "/root/testdata/sf0.01"
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_language_held_out_accuracy(spark, documents):
    got = language.predict(documents, language.fit(documents))
    both = got.join(documents.select("doc_id", "lang", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("c")), "doc_id").collect()
    assert all(r.held_out == (r.c % 5 == 0) for r in both) and all(0 <= r.score <= 1 for r in both)
    held = [r for r in both if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held) and len(both) == documents.count()


def test_language_odd_rows(spark):
    rows = [(1, "the one and the other thing", "en", 0), (2, "der eine und der andere", "de", 0), (3, None, "en", 0), (4, "123 !!", None, 0),
            (None, "the", None, 0), (7, "the" * 700_000, None, 0), (4, "123 !!", None, 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score int")
    got = sorted((r.doc_id or 0, r.lang_pred) for r in language.predict(docs, language.fit(docs)).collect())
    assert Counter(i for i, _ in got) == Counter(r[0] or 0 for r in rows)
    assert [p for i, p in got if i in (3, 4)] == ["und"] * 3
    assert language.predict(docs.limit(0), language.fit(docs.limit(0))).count() == 0


def test_language_profile_is_the_same_in_chunks(monkeypatch):
    seen = np.zeros(language.VOCABULARY, bool)
    text = "Ab  c-def é. ghi 1 2 jk" * 20
    whole = language.profile(text, seen)
    monkeypatch.setattr(language, "CHUNK", 5)
    assert language.profile(text, seen).tolist() == whole.tolist() and not seen.any()


def test_kernel_regression_equals_plain_nystroem():
    rng = np.random.default_rng(0)
    profiles = [np.unique(rng.integers(0, 50, 12)) + (100 if i % 2 else 0) for i in range(40)]
    labels = ["b" if i % 2 else "a" for i in range(40)]
    model = language.solve(profiles, labels, landmarks=40, ridge=0.5)
    k = np.array([[len(np.intersect1d(x, y)) / math.sqrt(len(x) * len(y)) for y in profiles] for x in profiles])
    y = np.array([[1.0, -1.0] if x == "a" else [-1.0, 1.0] for x in labels])
    want = k @ np.linalg.solve(k + 0.5 * np.eye(40), y)
    got = model.scores(language._presence(profiles, model.ids), np.array([len(p) for p in profiles]))
    assert np.abs(got - want).max() < 1e-2


def test_quality_held_out(spark, documents):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    train, held = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    got = quality.quality_scores(documents, train).join(held, "doc_id").collect()
    assert sum(r.keep == (r.quality == 1) for r in got) >= 0.95 * len(got)
    good = [r for r in got if r.quality == 1]
    assert sum(r.keep for r in good) >= 0.97 * len(good)


def test_quality_odd_rows(spark):
    rows = [(1, "plain words here", "s", "en", 1), (None, None, None, None, 2), (2, "", "s", "en", 3), (1, "plain words here", "s", "en", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string, score int")
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 0), (None, 0, 0)], "doc_id bigint, quality int, toxic int")
    assert quality.quality_scores(docs, labels).count() == 4
    kept = quality.good_documents(docs, labels)
    assert kept.columns == docs.columns and kept.count() >= 2
    assert quality.quality_scores(docs.limit(0), labels.limit(0)).count() == 0


def test_sparse_sites_are_shrunk(spark):
    rows = [(i, "same text", f"s{i % 2}", "en") for i in range(400)] + [(1000, "same text", "tiny", "en")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string")
    labels = spark.createDataFrame([(i, 1 if i % 2 or i % 8 == 0 else 0) for i in range(400)] + [(1000, 0)], "doc_id bigint, quality int")
    got = {r.host: r.path_posterior for r in quality.quality_scores(docs, labels).collect()}
    assert got["s0"] < got["tiny"] < got["s1"]


def test_mixing_draws_and_shares(spark, documents):
    big = documents
    for _ in range(3):
        big = big.union(big.withColumn("doc_id", F.col("doc_id") + big.agg(F.max("doc_id")).first()[0] + 1))
    weights = {f"src{i}": 1.0 + (i == 0) * 5 for i in range(20)}
    rows, names = mixing.replicated(big, weights=weights)
    got = rows.groupBy("source").agg(F.sum(F.length("text") + 1).alias("n")).collect()
    total = sum(r.n for r in got)
    share = {r.source: r.n / total for r in got}
    assert abs(share["src0"] - 6 / 25) < 0.05 and mixing.mixed(documents).columns == documents.columns
    again = mixing.mix_digests(documents.repartition(7))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, mixing.mix_digests(documents).collect()))


def test_mixing_counts_follow_the_inverse_distribution(spark):
    rows = [(i, "x" * 9, "a" if i % 3 else None, 1) for i in range(3000)] + [(None, "y", "a", 1), (5, None, "a", 1), (5, None, "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, copy int")
    rates = {r.source: r.rate for r in mixing.source_rates(docs).collect()}
    copies = Counter()
    import hashlib

    for i, _, s, _ in rows:
        u = int(hashlib.md5(f"{mixing.SEED}:{'' if i is None else i}".encode()).hexdigest()[:13], 16) / 2**52
        n, p = 0, math.exp(-rates[s])
        total = p
        while u >= total:
            n += 1
            p *= rates[s] / n
            total += p
        copies[i] += n
    out, names = mixing.replicated(docs)
    assert names["copy"] != "copy" and "copy" in out.columns
    assert Counter({r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}) == +copies
    assert mixing.mixed(docs.limit(0)).count() == 0


def test_large_rates_do_not_underflow(spark):
    docs = spark.createDataFrame([(1, "x", "tiny")] + [(i, "y" * 5000, "big") for i in range(2, 4)], "doc_id bigint, text string, source string")
    n = mixing.replicated(docs, weights={"tiny": 1.0, "big": 1.0})[0].where("source = 'tiny'").count()
    assert 2000 < n < 3000


def plain_tokens(rows):
    t = Tokenizer.from_file(TOKENIZER)
    t.encode_special_tokens = True
    at, out = 0, []
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        out.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_token_round_trip(spark, documents):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    rows += [(-5, None), (10_000, ""), (10_001, "a   b \n\n c  "), (10_002, "<|endoftext|>"), (10_003, "ab " * 200_000), (None, "null id")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("h", F.lit(1)).repartition(5)
    got = tokens.token_digests(docs, TOKENIZER)
    assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == plain_tokens(rows)


def test_tokens_of_repeated_ids_fill_the_file(spark):
    rows = [(3, f"text number {i % 4}") for i in range(60)] + [(i, "other") for i in range(10)]
    got = sorted(map(tuple, tokens.token_digests(spark.createDataFrame(rows, "doc_id bigint, text string"), TOKENIZER).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == sorted(r[0] for r in rows)
    assert all(a[1] + a[2] == b[1] for a, b in zip(got, got[1:])) and got[0][1] == 0
    assert tokens.token_digests(spark.createDataFrame([], "doc_id bigint, text string"), TOKENIZER).count() == 0


def test_tokens_reject_another_dictionary(spark, documents):
    path = Scratch(spark).folder()
    tokens.write_tokens(documents.limit(50), path, TOKENIZER)
    other = Scratch(spark).folder()
    spark.read.parquet(f"{path}/blocks").withColumn("dictionary_hash", F.lit("x")).write.parquet(f"{other}/blocks")
    spark.read.parquet(f"{path}/head").write.parquet(f"{other}/head")
    with pytest.raises(Exception, match="another dictionary"):
        tokens.read_tokens(spark, other).collect()


def test_piecewise_encoding_equals_whole():
    import random

    rng = random.Random(4)
    enc = tokens.Encoder(TOKENIZER)
    parts = [" ", "  ", "\n", "a", "B", "1", "é", "'s", ".", " \n", "\t", "<|endoftext|>", "字", "\x1c", "　"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(5000)]
    whole = [np.array(e.ids, enc.kind).tobytes() for e in enc.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert enc.encode(texts) == whole


def test_tokens_of_the_query_are_the_plain_tokenizer_s(spark, tmp_path):
    import corpus_pipeline

    from loomset.llm import queries

    rows = [(1, "a<|endoftext|>b"), (2, "<|endoftext|>"), (3, "one <|endoftext|> two\n\nthree"), (4, "<|endoftext|"), (5, "plain words"), (6, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    plain, want, at = Tokenizer.from_file(TOKENIZER), [], 0
    for i, text in rows:
        ids = np.array(plain.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert plain.encode("<|endoftext|>", add_special_tokens=False).ids == [50256]
    for got in (queries.op9_token_ids(spark, str(tmp_path)), corpus_pipeline.token_ids(spark, docs, "")):
        assert sorted(map(tuple, got.collect())) == want


def test_piecewise_encoding_equals_whole_with_added_tokens():
    import random

    rng = random.Random(5)
    enc = tokens.Encoder(TOKENIZER, literal=False)
    parts = [" ", "  ", "\n", "a", "B", "1", "é", "'s", ".", " \n", "\t", "<|endoftext|>", "<|endof", "text|>", "字"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(5000)]
    whole = [np.array(e.ids, enc.kind).tobytes() for e in Tokenizer.from_file(TOKENIZER).encode_batch(texts, add_special_tokens=False)]
    assert enc.encode(texts) == whole
