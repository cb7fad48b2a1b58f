"""Periodic runs of words by recompression: a run-length grammar answers how far two places of a text agree."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import TOKEN, only

LEAST, TIMES = 6, 4
# Words whose texts share a grammar, and grid places looked at together; a longer text is on its own.
TOGETHER, GRID = 200_000, 2_000_000
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


class Side(NamedTuple):
    """One level of the grammar, read in one direction: symbol, words under it, copies of it up to the end of its block,
    its parent, whether it is the parent's first child, and the first child of each parent."""
    symbol: np.ndarray
    words: np.ndarray
    left: np.ndarray
    parent: np.ndarray
    first: np.ndarray
    child: np.ndarray


def _level(symbol: np.ndarray, words: np.ndarray, starts: np.ndarray) -> tuple[Side, Side]:
    """The level read forwards and backwards, given where its parents start."""
    n, m = len(symbol), len(starts)
    size = np.diff(np.append(starts, n))
    parent = np.repeat(np.arange(m), size)
    last = starts + size - 1
    edge = np.append(np.flatnonzero(symbol[1:] != symbol[:-1]) + 1, n)
    begin = np.concatenate(([0], edge[:-1]))
    block = np.repeat(np.arange(len(edge)), edge - begin)
    at = np.arange(n)
    first, ends = np.zeros(n, bool), np.zeros(n, bool)
    first[starts], ends[last] = True, True
    forwards = Side(symbol, words, edge[block] - at, parent, first, starts)
    backwards = Side(symbol[::-1], words[::-1], (at - begin[block] + 1)[::-1], (m - 1 - parent)[::-1], ends[::-1], (n - 1 - last)[::-1])
    return forwards, backwards


def _named(codes: np.ndarray, after: int) -> tuple[np.ndarray, int]:
    """Names from ``after`` on, equal where the rows of codes are."""
    _, names = np.unique(codes, return_inverse=True)
    return names.reshape(-1) + after, after + (int(names.max()) + 1 if len(names) else 0)


def grammar(symbol: np.ndarray) -> tuple[list[Side], list[Side]]:
    """Levels of the run-length grammar of a sequence, forwards and backwards.

    Negative symbols are walls: each occurs once and is never merged. Blocks of one symbol and pairs (a, b) are merged
    by turns; which symbols may stand first in a pair is told by a bit that a hash of (symbol, round) gives, and the
    side with more pairs is taken, so that about a quarter of all neighbours or more merge in a round. Equal symbols
    always stand for equal words.
    """
    symbol = np.asarray(symbol, np.int64)
    words, names, levels, turn = np.ones(len(symbol), np.int64), int(symbol.max(initial=0)) + 1, [], 0
    while True:
        same = (symbol[1:] == symbol[:-1])
        if same.any():
            starts = np.flatnonzero(np.concatenate(([True], ~same)))
            size = np.diff(np.append(starts, len(symbol)))
            levels.append(_level(symbol, words, starts))
            merged, above = symbol[starts].copy(), np.add.reduceat(words, starts)
            many = size > 1
            _, kind = np.unique(merged[many], return_inverse=True)
            merged[many], names = _named(kind.reshape(-1) * np.int64(len(symbol) + 1) + size[many], names)
            symbol, words = merged, above
        inside = (symbol[1:] >= 0) & (symbol[:-1] >= 0)
        if not inside.any() or turn > 200:
            break
        mixed = (symbol.astype(np.uint64) + np.uint64(turn * 0x9E3779B97F4A7C15 % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
        bit = ((mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)) >> np.uint64(63) == 1
        turn += 1
        rising, falling = inside & ~bit[:-1] & bit[1:], inside & bit[:-1] & ~bit[1:]
        pair = rising if rising.sum() >= falling.sum() else falling
        if not pair.any():
            continue
        starts = np.flatnonzero(np.concatenate(([True], ~pair)))
        levels.append(_level(symbol, words, starts))
        merged, above = symbol[starts].copy(), np.add.reduceat(words, starts)
        two = np.diff(np.append(starts, len(symbol))) == 2
        at = starts[two]
        _, low = np.unique(symbol[at], return_inverse=True)
        _, high = np.unique(symbol[at + 1], return_inverse=True)
        merged[two], names = _named(low.reshape(-1) * np.int64(len(symbol) + 1) + high.reshape(-1), names)
        symbol, words = merged, above
    levels.append(_level(symbol, words, np.arange(len(symbol))))
    return [x for x, _ in levels], [x for _, x in levels]


def _agreeing(level: Side, a: np.ndarray, b: np.ndarray, out: np.ndarray, who: np.ndarray, climb: bool) -> np.ndarray:
    """Moves the pairs ``who`` forward over equal symbols of a level. Climbing ones stop where both places begin a
    parent; the others stop at the first difference. Returns the stopped at a parent (none unless climbing)."""
    risen = []
    while len(who):
        if climb:
            up = level.first[a[who]] & level.first[b[who]]
            risen.append(who[up])
            who = who[~up]
        who = who[(a[who] < len(level.symbol)) & (b[who] < len(level.symbol))]
        x, y = a[who], b[who]
        equal = level.symbol[x] == level.symbol[y]
        who, x, y = who[equal], x[equal], y[equal]
        step = np.minimum(level.left[x], level.left[y])
        out[who] += step * level.words[x]
        a[who] += step
        b[who] += step
    return np.concatenate(risen) if risen else who


def agreement(levels: list[Side], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many words agree from each place a[i] and b[i] on (a < b; a wall stands behind the last word)."""
    a, b = a.astype(np.int64), b.astype(np.int64)
    out, top = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
    who = np.arange(len(a))
    for i, level in enumerate(levels):
        if not len(who):
            break
        top[who] = i
        who = _agreeing(level, a, b, out, who, climb=i + 1 < len(levels))
        a[who], b[who] = level.parent[a[who]], level.parent[b[who]]
    for i in range(len(levels) - 2, -1, -1):
        who = np.flatnonzero(top > i)
        a[who], b[who] = levels[i].child[a[who]], levels[i].child[b[who]]
        _agreeing(levels[i], a, b, out, who, climb=False)
    return out


def _grid(start: np.ndarray, length: np.ndarray, text: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner (row of text and period) and place of every multiple of the period that has another one behind it."""
    times = (length[text] - 1) // period
    owner = np.repeat(np.arange(len(period)), times)
    k = np.arange(len(owner)) - np.repeat(np.cumsum(times) - times, times)
    return owner, start[text[owner]] + k * period[owner]


def _candidates(words: np.ndarray, start: np.ndarray, length: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of every text and period: places on the grid of the period's multiples where three neighbouring steps agree. A run
    of four periods has such places. Yields text, period and place, in parts of bounded size."""
    most = np.where(length >= LEAST, length // TIMES, 0)
    whole = np.cumsum(most)
    low, total = 0, int(whole[-1]) if len(whole) else 0
    while low < total:
        # Rows (text, period) from low on, numbered through all texts; about GRID places at a time.
        high = min(total, low + max(1, GRID // 8))
        row = np.arange(low, high)
        text = np.searchsorted(whole, row, side="right")
        period = row - (whole - most)[text] + 1
        room = np.cumsum(length[text] // period)
        high = low + max(1, int(np.searchsorted(room, GRID, side="right")))
        text, period = text[:high - low], period[:high - low]
        owner, at = _grid(start, length, text, period)
        equal = words[at] == words[at + period[owner]]
        three = np.flatnonzero(equal[:-2] & equal[1:-1] & equal[2:] & (owner[:-2] == owner[2:]))
        yield text[owner[three]], period[owner[three]], at[three]
        low = high


def runs(words: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All runs of the texts words[start:start + length]: text, start within it, length and smallest period, in this order.

    Only texts with candidates get a grammar. Of candidates in one run only the first is asked for; the others lie
    within its extension. An interval found with several periods (multiples of the smallest) keeps the smallest.
    """
    found = list(_candidates(words, start, length))
    text, period, at = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(3))
    none = np.zeros(0, np.int64)
    if not len(text):
        return none, none, none, none
    with_runs = np.unique(text)
    size = length[with_runs]
    new_start = np.cumsum(size + 1) - size
    sequence = np.full(int(size.sum()) + len(size) + 1, -1, np.int64)
    inner = np.repeat(new_start - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
    sequence[inner] = words[np.repeat(start[with_runs] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))]
    walls = np.flatnonzero(sequence < 0)
    sequence[walls] = -1 - np.arange(len(walls))
    forwards, backwards = grammar(sequence)
    at = new_start[np.searchsorted(with_runs, text)] + at - start[text]
    order = np.lexsort((at, period, text))
    text, period, at = text[order], period[order], at[order]
    # Neighbours on one grid are a stretch; all candidates of a run lie in one.
    stretch = np.cumsum(np.concatenate(([True], (text[1:] != text[:-1]) | (period[1:] != period[:-1]) | (at[1:] != at[:-1] + period[1:]))))
    out = []
    while len(text):
        ahead = np.concatenate(([True], stretch[1:] != stretch[:-1]))
        t, p, a = text[ahead], period[ahead], at[ahead]
        end = a + p + agreement(forwards, a, a + p)
        begin = a - agreement(backwards, len(sequence) - a, len(sequence) - a - p)
        out.append((t, begin, end, p))
        rest = ~ahead & (at + period >= end[np.cumsum(ahead) - 1])
        text, period, at, stretch = text[rest], period[rest], at[rest], stretch[rest]
    t, begin, end, p = (np.concatenate([o[i] for o in out]) for i in range(4))
    long = end - begin >= np.maximum(LEAST, TIMES * p)
    t, begin, end, p = t[long], begin[long], end[long], p[long]
    order = np.lexsort((p, end, begin, t))
    t, begin, end, p = t[order], begin[order], end[order], p[order]
    new = np.concatenate(([True], (t[1:] != t[:-1]) | (begin[1:] != begin[:-1]) | (end[1:] != end[:-1])))[:len(t)]
    t, begin, end, p = t[new], begin[new], end[new], p[new]
    begin, end = begin - new_start[np.searchsorted(with_runs, t)], end - new_start[np.searchsorted(with_runs, t)]
    order = np.lexsort((p, begin, t))
    return t[order], begin[order], (end - begin)[order], p[order]


def _told(texts: list[list[bytes]]) -> tuple[list[list[dict]], list[str]]:
    """Runs and collapsed text of each list of words."""
    names: defaultdict[bytes, int] = defaultdict(count().__next__)
    length = np.array([len(t) for t in texts], np.int64)
    words = np.fromiter(map(names.__getitem__, chain.from_iterable(texts)), np.int64, int(length.sum()))
    start = np.cumsum(length) - length
    found: list[list[dict]] = [[] for _ in texts]
    drop = np.zeros(len(words) + 1, np.int64)
    for t, s, n, p in zip(*(x.tolist() for x in runs(words, start, length)), strict=True):
        found[t].append({"start": s, "length": n, "period": p})
        drop[start[t] + s + p] += 1
        drop[start[t] + s + n] -= 1
    keep = np.cumsum(drop)[:-1] == 0
    kept = [b" ".join([w for w, k in zip(t, keep[s:s + len(t)].tolist(), strict=True) if k] if f else t).decode()
            for t, s, f in zip(texts, start.tolist(), found, strict=True)]
    return found, kept


_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(pa.struct(
    [("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))), ("collapsed", pa.string())])


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, held, size = [], [], 0
        for i, text in zip(batch["doc_id"], batch["text"], strict=True):
            # bytes.split() cuts at exactly the blanks of the contract: \\x20 and \\x09 to \\x0D.
            words = text.as_buffer().to_pybytes().split() if text.is_valid else []
            if held and size + len(words) > TOGETHER:
                yield _written(ids, held)
                ids, held, size = [], [], 0
            ids.append(i.as_py())
            held.append(words)
            size += len(words)
        if held:
            yield _written(ids, held)


def _written(ids: list[int | None], held: list[list[bytes]]) -> pa.RecordBatch:
    found, kept = _told(held)
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(h) for h in held], pa.int64()),
                                       pa.array(found, _OUT.field("runs").type), pa.array(kept, pa.string())], schema=_OUT)


def repeated_runs(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, n_words, runs (start, length, period; by start, then period) and collapsed.

    Words are what stands between blanks. A run is a stretch of words with smallest period q, at least ``TIMES`` times q
    and ``LEAST`` words long, that no neighbouring word extends. ``collapsed`` is the text without the words that any
    run contains after its first q words, joined by single spaces.

    A null or blank text has no words and no runs. A text is one row and is read whole; texts are taken together up to
    ``TOGETHER`` words, so memory is bounded by that and by the longest text (about 100 bytes a word). A text of n words
    costs n log n: the grid of all periods has so many places. Other columns are ignored; repeated rows stay.
    """
    return only(docs, doc_id="bigint", text="string").mapInArrow(
        _batches, f"doc_id bigint, n_words bigint, runs {RUNS}, collapsed string")


def with_planted_period(docs: DataFrame) -> DataFrame:
    """doc_id and text, where the end of the texts of every tenth document (by crc32 of its id) repeats with a period."""
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(TOKEN), F.lit(0))
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = only(docs, doc_id="bigint", text="string").withColumn("g", F.when(h % 10 == 0, F.floor(h / 10)))
    rows = rows.withColumn("words", F.when(F.col("g").isNotNull(), words)).withColumn("n", F.size("words").cast("bigint"))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    rows = rows.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("bigint"))
    again = F.transform(F.sequence(F.col("a"), F.col("n") - 1), lambda i: F.get("words", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")))
    planted = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a").cast("int")), again), " ")
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), planted).otherwise(F.col("text")).alias("text"))


def _line(run: Column) -> Column:
    return F.concat(F.concat_ws(",", run["start"].cast("string"), run["length"].cast("string"), run["period"].cast("string")), F.lit("\n"))


def run_digests(docs: DataFrame) -> DataFrame:
    """One row per document, of its text with the planted period: doc_id, n_runs, start, length, period and
    exponent_milli of the run with the greatest length/period (compared exactly by cross products), runs_sha256 and
    collapsed_sha256."""
    found = repeated_runs(with_planted_period(docs))
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda b, x: F.when(
        x["length"] * b["period"] > b["length"] * x["period"], x).otherwise(b))
    return found.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), best.alias("b"), "runs", "collapsed").select(
        "doc_id", "n_runs", "b.start", "b.length", "b.period", F.floor(F.expr("1000 * b.length div b.period")).cast("bigint").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", _line), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
