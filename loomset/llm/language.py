"""Language identification with a string kernel: Nystroem landmarks and one-versus-rest kernel ridge regression."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import Scratch, only

SYMBOLS = 64
VOCABULARY = SYMBOLS + SYMBOLS**2 + SYMBOLS**3
CHUNK = 1 << 20
ROWS = 256
BROADCAST_LANGUAGES = 2000

_table: np.ndarray | None = None


def symbol_table() -> np.ndarray:
    """Symbol of every code point: a-z are 1 to 26 in either case, other letters share 27 to 63, the rest is 0."""
    global _table
    if _table is None:
        out = np.zeros(0x110000, np.uint8)
        for cp in range(0x110000):
            c = chr(cp)
            if c.isalpha():
                low = ord(c.lower()[0])
                out[cp] = low - 96 if 97 <= low <= 122 else 27 + low % 37
        _table = out
    return _table


def profile(text: str, seen: np.ndarray) -> np.ndarray:
    """Sorted ids of the n-grams (n = 1, 2, 3) that a text holds; runs of non-letters count as one blank.

    ``seen`` is a cleared presence vector of the whole vocabulary and is cleared again. Texts are read in chunks with
    the last two symbols carried over, so memory stays bounded for any length. A text without letters has no ids.
    """
    table = symbol_table()
    last = np.zeros(1, np.uint8)
    for i in range(0, len(text), CHUNK):
        c = table[np.frombuffer(text[i:i + CHUNK].encode("utf-32-le", "surrogatepass"), np.uint32)]
        c = np.concatenate([last, c])
        c = c[np.concatenate([[True], (c[1:] != 0) | (c[:-1] != 0)])].astype(np.int32)
        seen[c] = True
        two = c[:-1] * SYMBOLS + c[1:]
        seen[SYMBOLS + two] = True
        seen[SYMBOLS + SYMBOLS**2 + two[:-1] * SYMBOLS + c[2:]] = True
        last = c[-2:].astype(np.uint8)
    seen[[0, SYMBOLS, SYMBOLS + SYMBOLS**2]] = False
    ids = np.flatnonzero(seen).astype(np.int32)
    seen[ids] = False
    return ids


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = np.zeros(VOCABULARY, bool)
    for batch in batches:
        ids = [profile(t or "", seen) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(ids, pa.list_(pa.int32()))], ["lang", "ids"])


@dataclass(frozen=True)
class Model:
    """``weights`` (n-gram of ``ids`` x language): landmark columns times kernel ridge solution, scale of landmarks in it."""
    ids: np.ndarray
    weights: np.ndarray
    languages: tuple[str, ...]

    def scores(self, presence: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return presence @ self.weights / np.sqrt(np.maximum(sizes, 1))[:, None]


def _presence(profiles: list[np.ndarray], ids: np.ndarray) -> np.ndarray:
    column = np.full(VOCABULARY, -1, np.int32)
    column[ids] = np.arange(len(ids))
    out = np.zeros((len(profiles), len(ids)), np.float32)
    for i, p in enumerate(profiles):
        c = column[p]
        out[i, c[c >= 0]] = 1
    return out


def solve(profiles: list[np.ndarray], labels: list[str], landmarks: int, ridge: float) -> Model:
    """Kernel ridge regression on Nystroem features of k(x, z) = |X & Z| / sqrt(|X| |Z|).

    With K the kernel of landmarks, features are k(x, Z) K^(-1/2). A prediction k(x, Z) a is linear in the presence
    vector of x, so Z' a is multiplied out once and texts are scored by one matrix product a batch.
    """
    languages = tuple(sorted(set(labels)))
    if not languages:
        return Model(np.zeros(0, np.int32), np.zeros((0, 0), np.float32), ())
    by = {x: [i for i, y in enumerate(labels) if y == x] for x in languages}
    each = max(1, landmarks // len(languages))
    chosen = [profiles[i] for x in languages for i in by[x][:each]]
    ids = np.unique(np.concatenate(chosen))
    z = _presence(chosen, ids)
    z /= np.sqrt(np.maximum([len(p) for p in chosen], 1))[:, None]
    values, vectors = np.linalg.eigh((z @ z.T).astype(np.float64))
    sure = values > 1e-6 * values.max()
    root = vectors[:, sure] / np.sqrt(values[sure])
    gram, right = np.zeros((root.shape[1],) * 2), np.zeros((root.shape[1], len(languages)))
    for i in range(0, len(profiles), ROWS):
        part = profiles[i:i + ROWS]
        phi = (_presence(part, ids) @ z.T / np.sqrt([len(p) for p in part])[:, None]) @ root
        y = np.where(np.array(labels[i:i + ROWS])[:, None] == np.array(languages), 1.0, -1.0)
        gram += phi.T @ phi
        right += phi.T @ y
    a = root @ np.linalg.solve(gram + ridge * np.eye(len(gram)), right)
    return Model(ids, (z.T @ a).astype(np.float32), languages)


def fit(docs: DataFrame, per_language: int = 300, total: int = 6000, landmarks: int = 256, ridge: float = 1.0) -> Model:
    """Learn from a bounded sample of the labelled rows that are not held out.

    At most ``per_language`` different rows of a language and about ``total`` rows in all are taken, the first in the
    order of a hash of id and text; rows that repeat id, text and language count once. Only hashes are shuffled to choose
    them, only chosen texts to learn from, and only their n-gram ids (at most 266,304 each) reach the driver.
    """
    rows = only(docs, doc_id="bigint", text="string", lang="string").where(
        "lang IS NOT NULL AND crc32(cast(coalesce(cast(doc_id AS string), '') AS binary)) % 5 <> 0").withColumn(
        "key", F.xxhash64("doc_id", "text"))
    sizes = Scratch(docs.sparkSession).cut(rows.groupBy("lang").count())
    n = max(1, sizes.count())
    each = min(per_language, max(8, total // n))

    def small(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if n <= BROADCAST_LANGUAGES else df  # at most ``each`` short rows a language

    # A hash keeps about twice as many rows of a language as are wanted, wherever they are; then they are numbered.
    place = F.pmod("key", F.lit(1 << 30)) / float(1 << 30)
    near = rows.select("lang", "key").join(small(sizes), "lang").where(place <= (2.0 * each + 20) / F.col("count"))
    order = Window.partitionBy("lang").orderBy(place, "key")
    taken = near.select("lang", "key").distinct().withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= each).drop("nth")
    chosen = rows.join(small(taken), ["lang", "key"], "left_semi").groupBy("lang", "key").agg(F.min("text").alias("text"))
    found = chosen.select("lang", "text").mapInArrow(_profiles, "lang string, ids array<int>").toArrow()
    found = sorted((r for r in zip(found["lang"].to_pylist(), (np.asarray(x, np.int32) for x in found["ids"].to_pylist())) if len(r[1])),
                   key=lambda r: (r[0], r[1].tobytes()))
    return solve([p for _, p in found], [x for x, _ in found], landmarks, ridge)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row, from the text alone.

    ``und`` with score 0 where the text is null or has no letter (or nothing was learned); otherwise the language of the
    largest regression value, ties to the first by name, and as score half of one plus its lead, at most 1. Null and
    repeated ids keep their own rows; other columns are ignored.
    """
    known = bool(model.languages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(VOCABULARY, bool)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                profiles = [profile(t or "", seen) for t in batch.column("text").to_pylist()]
                sizes = np.array([len(p) for p in profiles])
                names, lead = np.full(len(profiles), "und", object), np.zeros(len(profiles))
                if known:
                    s = model.scores(_presence(profiles, model.ids), sizes)
                    best = s.argmax(1)
                    ranked = np.sort(s, 1)
                    gap = ranked[:, -1] - ranked[:, -2] if s.shape[1] > 1 else np.ones(len(s))
                    some = sizes > 0
                    names[some] = np.array(model.languages, object)[best[some]]
                    lead[some] = np.clip((1 + gap[some]) / 2, 0, 1)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names.tolist(), pa.string()),
                                                  pa.array(lead, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = only(docs, doc_id="bigint", text="string").select("doc_id", "text", F.expr(
        "crc32(cast(coalesce(cast(doc_id AS string), '') AS binary)) % 5 = 0").alias("held_out"))
    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double")
