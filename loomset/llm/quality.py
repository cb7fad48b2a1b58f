"""Quality by hierarchical empirical Bayes: text evidence with site and path posteriors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .base import Scratch, fresh, only

SAMPLE_PER_CLASS = 3000
THRESHOLD = 0.5
CLASSES = 12
FEATURES = CLASSES**2 + 6

# Kinds of bytes: space, line end, other control, vowel, consonant, capital, digit, sentence mark, separator, symbol,
# other ASCII, beyond ASCII.
_KIND = np.full(256, 10, np.uint8)
_KIND[:32], _KIND[128:] = 2, 11
for _i, _set in enumerate((" ", "\n", "", "aeiou", "bcdfghjklmnpqrstvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".,;:", "|", "#$%&*+<=>@^_~!?")):
    for _c in _set:
        _KIND[ord(_c)] = _i


def features(text: str | None) -> np.ndarray:
    """Shape of a whole text: pairs of kinds of bytes, repetition of words and lines, lengths. Empty: all zero."""
    out = np.zeros(FEATURES)
    if not text:
        return out
    data = text.encode("utf-8", "surrogatepass")
    pairs = np.zeros(CLASSES**2, np.int64)
    for i in range(0, len(data), 1 << 20):
        k = _KIND[np.frombuffer(data[max(i - 1, 0):i + (1 << 20)], np.uint8)].astype(np.int32)
        pairs += np.bincount(k[:-1] * CLASSES + k[1:], minlength=CLASSES**2)
    out[:CLASSES**2] = np.sqrt(pairs / max(1, pairs.sum()))
    words = text.split()
    lines = text.split("\n")
    n = max(1, len(words))
    out[-6:] = (len(set(words)) / n, sum(a == b for a, b in zip(words, words[1:])) / n, len(set(lines)) / len(lines),
                np.log1p(len(words)), len(data) / n / 10, np.log1p(len(lines) / n))
    return out


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    shift: float

    def evidence(self, rows: np.ndarray) -> np.ndarray:
        """Log-likelihood ratio of good to bad; what a site says is not in it."""
        return np.clip((rows - self.mean) / self.scale @ self.weights + self.shift, -30, 30)


def solve(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> Model:
    """Ridge logistic regression by Newton steps; the sample's own share of good rows is taken out of the offset."""
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(FEATURES), np.ones(FEATURES), np.zeros(FEATURES), 0.0)
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-3)
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    penalty = np.diag(np.r_[np.full(FEATURES, ridge), 0.0])
    w = np.zeros(FEATURES + 1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty + 1e-9 * np.eye(len(w)), z.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    share = y.mean()
    return Model(mean, scale, w[:-1], float(w[-1] - np.log(share / (1 - share))))


def _shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("quality"), pa.array([features(t) for t in batch.column("text").to_pylist()],
                                                                            pa.list_(pa.float64()))], ["quality", "x"])


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> Model:
    """Learn from at most ``per_class`` labelled rows of either class, the first by a hash of the id.

    Only the bounded table of sampled ids is broadcast and only shape vectors come to the driver. Ids with contradictory
    labels count as bad; null ids and labels are left out; of an id with many rows the text of the smallest hash is taken.
    """
    given = only(labels, doc_id="bigint", quality="int").where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sizes = given.groupBy("quality").count()  # two rows at most
    # A hash keeps about twice as many ids of a class as are wanted, wherever they are; then they are numbered.
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    near = given.join(F.broadcast(sizes), "quality").withColumn("place", place).where(F.col("place") <= (2.0 * per_class + 20) / F.col("count"))
    order = Window.partitionBy("quality").orderBy("place", "doc_id")
    taken = near.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= per_class).select("doc_id", "quality")
    rows = only(docs, doc_id="bigint", text="string").join(F.broadcast(taken), "doc_id").groupBy("doc_id", "quality").agg(
        F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    found = rows.select("quality", "text").mapInArrow(_shapes, "quality int, x array<double>").toArrow()
    x = np.array(found["x"].to_pylist(), float).reshape(-1, FEATURES)
    y = np.array(found["quality"].to_pylist(), float)
    # One order whatever the partitioning, so that a rerun sums alike.
    order = np.lexsort((*x.T[::-1], y))
    return solve(x[order], y[order])


def _sigmoid(x):
    return 1 / (1 + F.exp(-x))


def _logit(p):
    return F.log(p / (1 - p))


def site_posteriors(docs: DataFrame, labels: DataFrame, model: Model) -> DataFrame:
    """(source, lang, host_posterior, path_posterior): share of good rows of each site and of each path in it.

    The site of a document is its source, the path its language section. A path's evidence is its labelled rows and, for
    the rest, the mean text evidence, over all documents. Sites are shrunk towards the global share and paths towards
    their site; how much, the spread between sites (paths) beyond sampling says. All by partial sums: a site with a
    third of the rows is one row a task before the shuffle.
    """
    scratch = Scratch(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, list[float]] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                llr = model.evidence(np.array([features(t) for t in batch.column("text").to_pylist()]).reshape(-1, FEATURES))
                for s, g, p in zip(batch.column("source").to_pylist(), batch.column("lang").to_pylist(), 1 / (1 + np.exp(-llr))):
                    got = sums.setdefault((s, g), [0, 0.0])
                    got[0] += 1
                    got[1] += p
            if len(sums) > 50_000:
                yield batch_of(sums)
                sums = {}
        if sums:
            yield batch_of(sums)

    def batch_of(sums):
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in sums], pa.string()), pa.array([k[1] for k in sums], pa.string()),
                                           pa.array([v[0] for v in sums.values()], pa.int64()), pa.array([v[1] for v in sums.values()], pa.float64())],
                                          ["source", "lang", "n", "soft"])

    base = only(docs, doc_id="bigint", text="string", source="string", lang="string")
    soft = base.select("text", "source", "lang").mapInArrow(run, "source string, lang string, n bigint, soft double").groupBy(
        "source", "lang").agg(F.sum("n").alias("n"), F.sum("soft").alias("soft"))
    given = only(labels, doc_id="bigint", quality="int").where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = base.select("doc_id", "source", "lang").join(given, "doc_id").groupBy("source", "lang").agg(
        F.count(F.lit(1)).alias("n_known"), F.sum("quality").alias("n_good"))
    both = soft.alias("s").join(known.alias("k"), F.expr("s.source <=> k.source AND s.lang <=> k.lang"), "left")
    good = F.expr("coalesce(n_good, 0) + soft * (n - coalesce(n_known, 0)) / n")
    paths = scratch.cut(both.select("s.source", "s.lang", "n", good.alias("good")))
    hosts = scratch.cut(paths.groupBy("source").agg(F.sum("n").alias("host_n"), F.sum("good").alias("host_good")))
    whole = hosts.agg(F.sum("host_n").alias("n"), F.sum("host_good").alias("good")).first()
    prior = min(max(((whole["good"] or 0.0) + 1) / ((whole["n"] or 0) + 2), 1e-4), 1 - 1e-4)

    def strength(spread: float | None, noise: float | None) -> float:
        """Pseudo-count of a Beta prior with the spread that is left once sampling is taken out."""
        real = max((spread or 0.0) - (noise or 0.0), 1e-6)
        return min(max(prior * (1 - prior) / real - 1, 1.0), 1e6)

    between = hosts.agg(F.sum(F.expr(f"host_n * pow(host_good / host_n - {prior!r}D, 2)")) / F.sum("host_n"),
                        F.lit(prior * (1 - prior)) * F.count(F.lit(1)) / F.sum("host_n")).first()
    of_hosts = strength(between[0], between[1])
    hosts = hosts.withColumn("host_posterior", (F.col("host_good") + of_hosts * prior) / (F.col("host_n") + of_hosts))
    joined = scratch.cut(paths.alias("p").join(hosts.alias("h"), F.expr("p.source <=> h.source")).select("p.source", "p.lang", "n", "good", "host_posterior"))
    within = joined.agg(F.sum(F.expr("n * pow(good / n - host_posterior, 2)")) / F.sum("n"),
                        F.sum(F.expr("host_posterior * (1 - host_posterior)")) / F.sum("n")).first()
    of_paths = strength(within[0], within[1])
    path = (F.col("good") + of_paths * F.col("host_posterior")) / (F.col("n") + of_paths)
    return scratch.cut(joined.select("source", "lang", "host_posterior", F.least(F.greatest(path, F.lit(1e-6)), F.lit(1 - 1e-6)).alias("path_posterior")))


def scored(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, dict[str, str]]:
    """The input's columns with evidence, host_posterior, path_posterior, score and keep, under free names given beside.

    score is the posterior of good: logit(path posterior) plus the text's log-likelihood ratio; kept from ``threshold``
    on. An empty or null text has the shape vector zero and is judged like any other. Null sources and languages are
    groups of their own; repeated rows are scored each; without labels of both classes the sites decide alone. The
    posterior table (a row a path) is joined by Spark: broadcast if small, else split where one site is large.
    """
    names = {n: fresh(docs, n) for n in ("evidence", "host_posterior", "path_posterior", "score", "keep", "site_source", "site_lang")}
    model = fit(docs, labels)
    sites = site_posteriors(docs, labels, model).withColumnsRenamed({
        "source": names["site_source"], "lang": names["site_lang"], "host_posterior": names["host_posterior"], "path_posterior": names["path_posterior"]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                text = batch.column(batch.schema.get_field_index("text")).cast(pa.string())
                llr = model.evidence(np.array([features(t) for t in text.to_pylist()]).reshape(-1, FEATURES))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(llr)], [*batch.schema.names, names["evidence"]])

    schema = StructType([*docs.schema.fields]).add(names["evidence"], "double")
    rows = docs.mapInArrow(run, schema)
    joined = rows.join(sites, rows["source"].cast("string").eqNullSafe(sites[names["site_source"]])
                       & rows["lang"].cast("string").eqNullSafe(sites[names["site_lang"]]))
    score = _sigmoid(F.col(names["evidence"]) + _logit(F.col(names["path_posterior"])))
    return joined.withColumn(names["score"], score).withColumn(names["keep"], F.col(names["score"]) >= threshold).drop(
        names["site_source"], names["site_lang"]), names


def good_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The input rows that are kept, with the input's columns."""
    rows, names = scored(docs, labels, threshold)
    return rows.where(F.col(names["keep"])).select(*[f"`{c}`" for c in docs.columns])


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, host, path, evidence, host_posterior, path_posterior, score, keep of every row."""
    rows, _ = scored(only(docs, doc_id="bigint", text="string", source="string", lang="string"), labels, threshold)
    return rows.select("doc_id", F.col("source").alias("host"), F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit(""))).alias("path"),
                       "evidence", "host_posterior", "path_posterior", "score", "keep")
