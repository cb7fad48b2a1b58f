"""N-gram Jaccard join: shared elements and prefixes for candidates, a prefix tree to verify them, components as result.

Free style (Arrow batches and numpy inside tasks); Spark partitions, shuffles and joins.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from .base import Scratch, fresh, only

WORDS = 5
# Similarity 0.75 as integers: linked when 7 * both >= 3 * (size + size).
PIECE = 1 << 20
SKETCH_BITS, SKETCH_CHUNKS = 22, 64
FLUSH = 1_000_000
PARTNERS = 256
BLOOM_BITS = 1 << 26
MOST_SIGN_WORDS = 32

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


with np.errstate(over="ignore"):
    # Independent odd factors, one a place in a shingle.
    _PLACE = _mixed(np.arange(1, WORDS + 2, dtype=np.uint64) * _BASE) | np.uint64(1)


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out, dtype=np.uint64)


def _words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and 64-bit hash of every word of UTF-8 bytes, A-Z lower-cased, words parted by blanks."""
    b = np.frombuffer(data, np.uint8)
    b = b + (((b >= 65) & (b <= 90)) << 5).astype(np.uint8)
    blank = np.concatenate([[True], (b == 32) | ((b >= 9) & (b <= 13)), [True]])
    starts = np.flatnonzero(blank[:-1] & ~blank[1:])
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    ends = np.flatnonzero(~blank[:-1] & blank[1:])
    lengths = ends - starts
    at = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    held = (b[~blank[1:-1]].astype(np.uint64) + np.uint64(1)) * _powers(int(lengths.max()))[at]
    return starts, _mixed(np.add.reduceat(held, np.cumsum(lengths) - lengths))


def _long_words(data: bytes) -> np.ndarray:
    """Word hashes of a long text, in pieces cut at blanks."""
    out, at = [], 0
    while at < len(data):
        end = min(at + PIECE, len(data))
        while end < len(data) and data[end] not in b" \t\n\v\f\r":
            end += 1
        out.append(_words(data[at:end])[1])
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _set(words: np.ndarray) -> np.ndarray:
    """Sorted distinct shingle hashes; a shorter text is one shingle, none without words."""
    n = len(words)
    with np.errstate(over="ignore"):
        if n == 0:
            return words
        if n < WORDS:
            one = np.add.reduce(words * _PLACE[:n], dtype=np.uint64) + np.uint64(n) * _PLACE[WORDS]
            return _mixed(np.array([one], np.uint64))
        s = words[:n - WORDS + 1] * _PLACE[0]
        for i in range(1, WORDS):
            s = s + words[i:n - WORDS + 1 + i] * _PLACE[i]
        return np.unique(_mixed(s))


def shingle_sets(texts: list[str | None]) -> Iterator[np.ndarray]:
    """The shingle set of each text; short texts are hashed together."""
    with np.errstate(over="ignore"):
        data = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        i = 0
        while i < len(data):
            if len(data[i]) > PIECE:
                yield _set(_long_words(data[i]))
                i += 1
                continue
            j, size = i, 0
            while j < len(data) and size + len(data[j]) + 1 <= 2 * PIECE:
                size += len(data[j]) + 1
                j += 1
            starts, hashes = _words(b" ".join(data[i:j]) + b" ")
            cuts = np.searchsorted(starts, np.cumsum([len(x) + 1 for x in data[i:j]]))
            for part in np.split(hashes, cuts[:-1]):
                yield _set(part)
            i = j


def digest(shingles: np.ndarray) -> bytes:
    """128-bit name of a set; equal sets are one class."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _short(name: bytes) -> int:
    return int.from_bytes(name[:8], "little", signed=True)


def _rows(batches: Iterator[pa.RecordBatch], size: int = 512) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for whole in batches:
        for at in range(0, whole.num_rows, size):
            batch = whole.slice(at, size)
            yield batch, list(shingle_sets(batch.column("text").to_pylist()))


def _squeeze(x: np.ndarray) -> bytes:
    """Bytes of an integer array, transposed by significance and compressed."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes())


def _expand(data: bytes, kind: str) -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(width, -1).T).view(kind).ravel()


def _name_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, sets in _rows(batches):
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), batch.column("doc_id"), batch.column("h"), pa.array([len(s) for s in sets], pa.int32()),
             pa.array([digest(s) if len(s) else None for s in sets], pa.binary())], ["row", "doc_id", "h", "size", "digest"])


class _Fresh:
    """Names not met before in this task; forgets when full, so a name may pass again."""

    def __init__(self):
        self.seen: set = set()

    def __call__(self, name) -> bool:
        if name in self.seen:
            return False
        if len(self.seen) >= FLUSH:
            self.seen.clear()
        self.seen.add(name)
        return True


def _elements(buckets: int):
    """All elements of all sets, 40 bits each, packed by bucket; copies within a task are sent once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh, held, size, part, nth = _Fresh(), [], 0, TaskContext.get().partitionId(), 0
        fields = ["bucket", "flush", "token", "local", "names", "sizes"]
        kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 4]

        def flush():
            number = (part << 24) + nth
            lengths = np.array([len(h[0]) for h in held])
            token = np.concatenate([h[0] for h in held]) >> np.uint64(24)
            local = np.repeat(np.arange(len(held), dtype=np.uint32), lengths)
            bucket = (token % np.uint64(buckets)).astype(np.int32)
            order = np.lexsort((token, bucket))
            rows = [(number % buckets, number, None, None, _squeeze(np.array([h[1] for h in held], np.int64)), _squeeze(lengths.astype(np.int64)))]
            for cut in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
                rows.append((int(bucket[cut[0]]), number, _squeeze(np.diff(token[cut], prepend=np.uint64(0))), _squeeze(local[cut]), None, None))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], fields)

        for _, sets in _rows(batches):
            for s in sets:
                if len(s) and fresh(name := _short(digest(s))):
                    held.append((s, name))
                    size += len(s)
            if size >= 2 * FLUSH:
                yield flush()
                held, size, nth = [], 0, nth + 1
        if held:
            yield flush()
    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For every pack of sets, how many elements of each are also in another set (of the buckets that are here)."""
    flushes, tokens, places = [], [], []
    fields, kinds = ["flush", "names", "sizes", "counts"], [pa.int64(), *[pa.binary()] * 3]

    def out(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], fields)

    for batch in batches:
        for row in batch.to_pylist():
            if row["names"] is not None:
                yield out([(row["flush"], row["names"], row["sizes"], None)])
            else:
                flushes.append(row["flush"])
                tokens.append(np.cumsum(_expand(row["token"], "<u8"), dtype=np.uint64))
                places.append(_expand(row["local"], "<u4"))
    if not tokens:
        return
    token = np.concatenate(tokens)
    order = np.argsort(token)
    same = token[order][1:] == token[order][:-1]
    shared = np.zeros(len(token), bool)
    shared[order] = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    at = 0
    for number, place in zip(flushes, places):
        counts = np.bincount(place[shared[at:at + len(place)]])
        at += len(place)
        if len(counts):
            yield out([(number, None, None, _squeeze(counts.astype(np.int64)))])


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Names of sets with three quarters of their elements in other sets; no other set can be linked."""
    sums: dict[int, np.ndarray] = {}
    known: dict[int, tuple[bytes, bytes]] = {}
    for batch in batches:
        for row in batch.to_pylist():
            if row["names"] is not None:
                known[row["flush"]] = row["names"], row["sizes"]
                continue
            counts = _expand(row["counts"], "<i8")
            old = sums.get(row["flush"], np.zeros(0, np.int64))
            if len(old) < len(counts):
                old, counts = counts.copy(), old
            old[:len(counts)] += counts
            sums[row["flush"]] = old
    for number, counts in sums.items():
        names, sizes = _expand(known[number][0], "<i8"), _expand(known[number][1], "<i8")
        enough = np.flatnonzero(4 * counts >= 3 * sizes[:len(counts)])
        yield pa.RecordBatch.from_arrays([pa.array(names[enough])], ["name"])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Element counts of a task's sets in chunks of the sketch."""
    counts = np.zeros(1 << SKETCH_BITS, np.int64)
    mask, width = np.uint64((1 << SKETCH_BITS) - 1), (1 << SKETCH_BITS) // SKETCH_CHUNKS
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            data = b"".join(batch.column("elements").slice(at, 512).to_pylist())
            counts += np.bincount(np.frombuffer(data, np.uint64) & mask, minlength=len(counts))
    used = [c for c in range(SKETCH_CHUNKS) if counts[c * width:(c + 1) * width].any()]
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([_squeeze(counts[c * width:(c + 1) * width]) for c in used], pa.binary())],
                                     ["chunk", "counts"])


def _add_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for c, x in zip(batch.column("chunk").to_pylist(), batch.column("counts")):
            x = _expand(x.as_py(), "<i8")
            total[c] = total[c] + x if c in total else x
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([_squeeze(x) for x in total.values()], pa.binary())],
                                     ["chunk", "counts"])


def _levels(chunks: list[tuple[int, bytes]]) -> np.ndarray:
    """Frequency level of each sketch cell: 0 up to what chance explains, then one more for every doubling."""
    width = (1 << SKETCH_BITS) // SKETCH_CHUNKS
    counts = np.zeros(1 << SKETCH_BITS, np.int64)
    for c, x in chunks:
        counts[c * width:(c + 1) * width] = _expand(x, "<i8")
    mean = counts.mean()
    over = counts / (mean + 4 * np.sqrt(mean) + 2)
    return np.where(over > 1, np.ceil(np.log2(np.maximum(over, 1))), 0).astype(np.uint8)


def _order(shingles: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """The set in the global order: rare levels first, hashes within."""
    return shingles[np.argsort(levels[shingles & np.uint64(len(levels) - 1)], kind="stable")]


def prefix_length(n: int) -> int:
    """A set of this size shares one of so many first elements with every set linked with it."""
    return n - (3 * n + 3) // 4 + 1


def _close(n: np.ndarray, i: np.ndarray, m: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether sets of sizes n and m that share elements at positions i and j can have enough in common."""
    most = np.minimum(i, j) + 1 + np.minimum(n - i - 1, m - j - 1)
    return 7 * most >= 3 * (n + m)


def _prefixes(levels, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, int, int]] = []
        size = 0

        def flush():
            token = np.concatenate([h[0] >> np.uint64(16) for h in held])
            lengths = np.array([len(h[0]) for h in held])
            local = np.repeat(np.arange(len(held), dtype=np.uint32), lengths)
            pos = (np.arange(len(token)) - np.repeat(np.cumsum(lengths) - lengths, lengths)).astype(np.uint32)
            names, sizes = np.array([h[1] for h in held], np.int64), np.array([h[2] for h in held], np.int32)
            bucket = (token % np.uint64(buckets)).astype(np.int32)
            order = np.lexsort((token, bucket))
            edge = np.flatnonzero(np.diff(bucket[order])) + 1
            for part in np.split(order, edge):
                mine, place = np.unique(local[part], return_inverse=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(bucket[part[0]])], pa.int32()), *[pa.array([_squeeze(x)], pa.binary()) for x in (
                        np.diff(token[part], prepend=np.uint64(0)), place.astype(np.uint32), pos[part], names[mine], sizes[mine])]],
                    ["bucket", "token", "local", "pos", "name", "size"])

        for batch in batches:
            for name, data in zip(batch.column("name").to_pylist(), batch.column("elements")):
                p = np.frombuffer(data.as_py(), np.uint64)
                n = len(p)
                p = _order(p, levels.value)[:prefix_length(n)]
                held.append((p, name, n))
                size += len(p)
                if size >= FLUSH:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()
    return run


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries of prefix elements that several classes share, each with a centre that it may be linked with, or none."""
    parts = []
    for batch in batches:
        for row in batch.to_pylist():
            local = _expand(row["local"], "<u4")
            parts.append((np.cumsum(_expand(row["token"], "<u8"), dtype=np.uint64), _expand(row["name"], "<i8")[local],
                          _expand(row["size"], "<i4")[local], _expand(row["pos"], "<u4").astype(np.int64)))
    if not parts:
        return
    token, name, size, pos = (np.concatenate(x) for x in zip(*parts))
    parts.clear()
    order = np.lexsort((name, token))
    token, name, size, pos = token[order], name[order], size[order].astype(np.int64), pos[order]
    fresh = np.concatenate([[True], (token[1:] != token[:-1]) | (name[1:] != name[:-1])])
    token, name, size, pos = token[fresh], name[fresh], size[fresh], pos[fresh]
    same = token[1:] == token[:-1]
    shared = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    token, name, size, pos = token[shared], name[shared], size[shared], pos[shared]
    centre = np.zeros(len(token), np.int64)
    paired = np.zeros(len(token), bool)
    left = np.arange(len(token))
    while len(left):
        # The first entry left of each element is a centre; entries too far from it wait for the next one.
        first = np.concatenate([[True], token[left[1:]] != token[left[:-1]]])
        mid = left[np.maximum.accumulate(np.where(first, np.arange(len(left)), 0))]
        fits = ~first & _close(size[mid], pos[mid], size[left], pos[left])
        centre[left[fits]], paired[left[fits]] = name[mid[fits]], True
        left = left[~first & ~fits]
    for at in range(0, len(token), 1 << 16):
        cut = slice(at, at + (1 << 16))
        yield pa.RecordBatch.from_arrays(
            [pa.array(token[cut].astype(np.int64)), pa.array(name[cut]), pa.array(size[cut].astype(np.int32)), pa.array(pos[cut].astype(np.int32)),
             pa.array(centre[cut], mask=~paired[cut])], ["token", "name", "size", "pos", "centre"])


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of classes that share a prefix element, may be linked and lie in different components; sorted by token.

    ``shared`` is how many prefix elements of a class are met by classes of other components; ``sign`` the signature of a
    class, null where it must not decide. Pairs that these rule out are never rows.
    """
    names = ("token", "name", "size", "pos", "component", "shared")
    carry: pa.Table | None = None

    def pairs(t: pa.Table) -> Iterator[pa.RecordBatch]:
        token, name, size, pos, comp, shared = (t.column(c).to_numpy() for c in names)
        sign = t.column("sign")
        edges = np.concatenate([[0], np.flatnonzero(token[1:] != token[:-1]) + 1, [len(token)]]) if len(token) else np.array([0])
        seen: list[np.ndarray] = []
        count = 0
        for a, b in zip(edges[:-1], edges[1:]):
            c = comp[a:b]
            if b - a < 2 or (c == c[0]).all():
                continue
            order = np.argsort(size[a:b], kind="stable") + a
            n, p, c, w = size[order].astype(np.int64), pos[order].astype(np.int64), comp[order], name[order]
            m, behind = shared[order], n - prefix_length(n)
            signs = _Signs(n, sign.take(pa.array(order)).to_pylist())
            last = np.searchsorted(n, n * 4 // 3, "right")
            for i in range(len(order) - 1):
                j = slice(i + 1, last[i])
                # What both must share in their prefixes, as no more than the rest of one of them can lie behind.
                need = -(-3 * (n[i] + n[j]) // 7) - np.maximum(behind[i], behind[j])
                ok = (c[j] != c[i]) & _close(n[i], p[i], n[j], p[j]) & (np.minimum(m[i], m[j]) >= need)
                ok = np.flatnonzero(ok) + i + 1
                if len(ok):
                    ok = ok[signs.may_link(i, ok)]
                if len(ok):
                    other = w[ok]
                    seen.append(np.stack([np.minimum(other, w[i]), np.maximum(other, w[i])], 1))
                    count += len(other)
                    if count > FLUSH:
                        yield _pair_batch(seen)
                        seen, count = [], 0
        if seen:
            yield _pair_batch(seen)

    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = pa.concat_tables([carry, t]) if carry is not None else t
        token = t.column("token").to_numpy()
        if not len(token):
            continue
        # The last element may go on in the next batch.
        cut = int(np.searchsorted(token, token[-1], "left"))
        if cut:
            yield from pairs(t.slice(0, cut).combine_chunks())
        carry = t.slice(cut)
    if carry is not None:
        yield from pairs(carry.combine_chunks())


def _pair_batch(seen: list[np.ndarray]) -> pa.RecordBatch:
    both = np.unique(np.concatenate(seen), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])


def _bits(names: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    u = names.astype(np.int64).view(np.uint64)
    return u % np.uint64(size), _mixed(u) % np.uint64(size)


def _bloom_part(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size, bool)
        for batch in batches:
            for at in _bits(batch.column("name").to_numpy(), size):
                bits[at] = True
        yield pa.RecordBatch.from_arrays([pa.array([_squeeze(np.packbits(bits))], pa.binary())], ["bits"])
    return run


def sign_words(n: int) -> int:
    """64-bit words of the signature of a set of this size: about two bits an element, at most 2,048 bits."""
    return min(MOST_SIGN_WORDS, 1 << max(0, (max(1, n) - 1).bit_length() - 5))


def signature(shingles: np.ndarray) -> np.ndarray:
    """Parity of the number of elements that fall on each bit.

    Every differing bit needs an element that only one of two sets has, so sets of sizes n and m with d differing bits
    share at most (n + m - d) / 2 elements.
    """
    width = 64 * sign_words(len(shingles))
    odd = np.bincount((shingles >> np.uint64(40)).astype(np.int64) % width, minlength=width) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def _folded(signs: np.ndarray) -> np.ndarray:
    """Signatures at half their width: the parity of both halves together."""
    half = signs.shape[1] // 2
    return signs[:, :half] ^ signs[:, half:]


class _Signs:
    """Signatures of entries sorted by size; compares one entry with later ones that are at most a third larger."""

    def __init__(self, sizes: np.ndarray, signs: list[bytes | None]):
        self.sizes = sizes
        self.width = np.array([sign_words(int(n)) for n in sizes])
        self.known = np.array([x is not None for x in signs])
        self.own, self.half, self.first = {}, {}, {}
        for w in np.unique(self.width).tolist():
            at = np.flatnonzero(self.width == w)
            m = np.frombuffer(b"".join(signs[i] if self.known[i] else bytes(8 * w) for i in at), np.uint64).reshape(len(at), w)
            self.own[w], self.first[w] = m, int(at[0])
            if w > 1:
                self.half[w] = _folded(m)

    def may_link(self, i: int, others: np.ndarray) -> np.ndarray:
        """Whether the bound on shared elements allows links of entry i with the (later) others."""
        out = np.ones(len(others), bool)
        if not self.known[i]:
            return out
        w = int(self.width[i])
        mine = self.own[w][i - self.first[w]]
        for wide, table in ((w, self.own.get(w)), (2 * w, self.half.get(2 * w))):
            at = np.flatnonzero(self.width[others] == wide)
            if table is not None and len(at):
                differ = np.bitwise_count(table[others[at] - self.first[wide]] ^ mine).sum(1, dtype=np.int64)
                out[at] = 7 * differ <= self.sizes[i] + self.sizes[others[at]]
        return out | ~self.known[others]


def _wanted_sets(bloom):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, fresh = np.unpackbits(bloom.value).view(bool), _Fresh()
        for _, sets in _rows(batches):
            out = []
            for s in sets:
                if not len(s):
                    continue
                d = digest(s)
                one, two = _bits(np.array([_short(d)], np.int64), len(bits))
                if (bits[one] & bits[two])[0] and fresh(d):
                    out.append((_short(d), d, s.tobytes(), signature(s).tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), *[pa.binary()] * 3))],
                                                 ["name", "digest", "elements", "sign"])
    return run


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each set once; copies of a class have come to one task."""
    seen: set[bytes] = set()
    for batch in batches:
        new = []
        for d in batch.column("digest").to_pylist():
            new.append(d not in seen)
            seen.add(d)
        yield batch.filter(pa.array(new))


def tree_matches(probe: np.ndarray, partners: list[tuple[bytes, np.ndarray]], step: int = 64) -> Iterator[bytes]:
    """Partners linked with ``probe``. Sets are sequences in one global order.

    The partners, sorted, are the leaves of a prefix tree in depth-first order: what a leaf shares with the one before
    it is a path of the tree, and the overlap counted along that path is kept, not counted again. A branch is left as
    soon as the overlap so far plus the shorter remaining length cannot reach what the sizes ask for.
    """
    ordered = np.sort(probe)
    n = len(probe)
    path, before = np.zeros(1, np.int64), np.zeros(0, np.uint64)
    for name, leaf in sorted(partners, key=lambda x: x[1].tobytes()):
        m = len(leaf)
        need = -(-3 * (n + m) // 7)
        most = min(len(before), m, len(path) - 1)
        differ = np.flatnonzero(before[:most] != leaf[:most])
        depth = int(differ[0]) if len(differ) else most
        parts, both = [path[:depth + 1]], int(path[depth])
        while depth < m and both + min(n - both, m - depth) >= need:
            segment = leaf[depth:depth + step]
            at = np.searchsorted(ordered, segment)
            at[at == n] = n - 1
            run = both + np.cumsum(ordered[at] == segment)
            parts.append(run)
            both, depth = int(run[-1]), depth + len(segment)
        path, before = np.concatenate(parts), leaf
        if depth == m and both >= need:
            yield name


def _verify(levels):
    """Rows sorted by (a, part, probe first): a group's probes against the tree of its partners.

    Frequent elements come first in the tree: near copies then share long paths.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _verified(batches, levels.value)
    return run


def _verified(batches: Iterator[pa.RecordBatch], levels: np.ndarray) -> Iterator[pa.RecordBatch]:
    key, probes, partners = None, [], []

    def flush():
        left, right = [], []
        for d, probe in probes:
            found = list(tree_matches(probe, [p for p in partners if p[0] != d]))
            left += [d] * len(found)
            right += found
        return pa.RecordBatch.from_arrays([pa.array(left, pa.binary()), pa.array(right, pa.binary())], ["a", "b"])

    for batch in batches:
        for a, part, is_probe, d, x in zip(*(batch.column(c).to_pylist() for c in ("a", "part", "probe", "digest", "elements"))):
            if (a, part) != key:
                if partners and probes:
                    yield flush()
                key, probes, partners = (a, part), [], []
            (probes if is_probe else partners).append((d, _order(np.frombuffer(x, np.uint64), levels)[::-1]))
    if partners and probes:
        yield flush()


def _links(pairs: DataFrame, sets: DataFrame, levels) -> DataFrame:
    """Verified links (digest a, digest b) of proposed pairs of short names; a much-paired class is split over tasks."""
    busy = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    parts = pairs.join(busy, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / PARTNERS)).cast("int").alias("part"))
    right = parts.join(sets.withColumnRenamed("name", "b"), "b").select("a", "part", F.lit(False).alias("probe"), "digest", "elements")
    left = parts.select("a", "part").distinct().join(sets.withColumnRenamed("name", "a"), "a").select(
        "a", "part", F.lit(True).alias("probe"), "digest", "elements")
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = left.unionByName(right).repartition(n, "a", "part").sortWithinPartitions("a", "part", F.desc("probe"))
    return laid.mapInArrow(_verify(levels), "a binary, b binary").distinct()


def _text_key(text):
    return F.unhex(F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256))


def near_components(docs: DataFrame) -> DataFrame:
    """One row per input row: row, doc_id, h (SHA-256 of the text), n_shingles, component, component_id.

    Sets are distinct five-word shingles as 64-bit hashes; two link when 100 both >= 75 either. Equal sets are one class
    (128-bit name).

    1. One pass names the sets. A second sends every element once, packed (40 bits), to where equal elements meet; what
       goes back is how many elements of each set other sets hold too. A set with less than three quarters shared is
       linked with nothing. This leaves out most documents, exactly.
    2. The sets of the rest are fetched (a bit map of fixed size says which) and stored once. Their elements are counted in
       a sketch of fixed size, which orders them, rare first; any order gives the same result.
    3. Each set sends the prefix that a linked set must share. Classes that meet in an element are paired with a centre
       each, not with each other, and the pairs are verified in prefix trees.
    4. Classes that share an element but are still in different components are paired and verified as well, if their
       positions, the number of prefix elements that others share and their signatures allow a link. So every link between different
       components that could exist has been looked at: components are exact.

    Documents without words have an empty set, n_shingles 0 and themselves as component. component_id is the smallest
    doc_id reached, null ids aside. A null text has no words; repeated rows are linked like copies; other columns are
    ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = only(docs, doc_id="bigint", text="string")
    keyed = text.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", _text_key(F.col("text")).alias("h"))
    rows = scratch.cut(keyed.mapInArrow(_name_sets, "row bigint, doc_id bigint, h binary, size int, digest binary"))
    packs = text.select("text").mapInArrow(_elements(4 * n), "bucket int, flush bigint, token binary, local binary, names binary, sizes binary")
    shared = packs.repartition(n, "bucket").mapInArrow(_shared, "flush bigint, names binary, sizes binary, counts binary")
    wanted = scratch.cut(shared.repartition(n, "flush").mapInArrow(_candidates, "name bigint").distinct())
    bits = min(BLOOM_BITS, 1 << max(13, (16 * max(1, wanted.count())).bit_length()))
    parts = wanted.coalesce(8).mapInArrow(_bloom_part(bits), "bits binary").collect()  # at most 8 maps of fixed size
    bloom = np.zeros(bits // 8, np.uint8)
    for p in parts:
        bloom |= _expand(bytes(p["bits"]), "<u1")
    bloom = spark.sparkContext.broadcast(bloom)
    stored = "name bigint, digest binary, elements binary, sign binary"
    fetched = text.select("text").mapInArrow(_wanted_sets(bloom), stored).repartition(n, "name").mapInArrow(_once, stored)
    sets = scratch.cut(fetched, compression="none")
    bloom.destroy()
    chunks = sets.select("elements").mapInArrow(_counts, "chunk int, counts binary").repartition(SKETCH_CHUNKS, "chunk").mapInArrow(
        _add_chunks, "chunk int, counts binary").collect()  # a table of fixed size, whatever the input
    levels = spark.sparkContext.broadcast(_levels([(r["chunk"], bytes(r["counts"])) for r in chunks]))
    packed = sets.select("name", "elements").mapInArrow(_prefixes(levels, 4 * n), "bucket int, token binary, local binary, pos binary, name binary, size binary")
    met = scratch.cut(packed.repartition(n, "bucket").mapInArrow(_stars, "token bigint, name bigint, size int, pos int, centre bigint"))
    classes = scratch.cut(rows.where("digest IS NOT NULL").groupBy("digest").agg(F.min("row").alias("class"), F.min("doc_id").alias("low")))
    named = scratch.cut(sets.select("name", "digest").join(classes.select("digest", "class"), "digest"))

    def by_class(links: DataFrame) -> DataFrame:
        ids = named.select("digest", "class")
        return links.join(ids.toDF("a", "u"), "a").join(ids.toDF("b", "v"), "b").select("u", "v")

    # One centre for each class, the one met most often: as many pairs as classes, whatever the size of a group.
    paired = met.where("centre IS NOT NULL").groupBy("name", "centre").agg(F.count(F.lit(1)).alias("n"))
    stars = paired.groupBy("name").agg(F.max(F.struct("n", "centre")).alias("m")).select(
        F.least("m.centre", "name").alias("a"), F.greatest("m.centre", "name").alias("b")).distinct()
    stars = scratch.cut(stars)
    links = scratch.cut(by_class(_links(stars, sets, levels)))
    found = scratch.cut(connected_components(links, "u", "v"))
    label = named.join(found.withColumnRenamed("node", "class"), "class", "left").groupBy("name").agg(
        F.min(F.coalesce("component", "class")).alias("component"), F.count(F.lit(1)).alias("n"))
    # Classes of one short name are told apart by their sets only: pair them with everything.
    label = label.select("name", F.when(F.col("n") == 1, F.col("component")).otherwise(-F.abs(F.col("name")) - 1).alias("component"))
    mixed = scratch.cut(met.select("token", "name", "size", "pos").join(label, "name"))
    between = mixed.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("token")
    mixed = scratch.cut(mixed.join(between, "token", "left_semi"))
    # A signature stands for its name only where no other set has that name.
    signs = sets.groupBy("name").agg(F.when(F.count(F.lit(1)) == 1, F.min("sign")).alias("sign"))
    mixed = mixed.join(mixed.groupBy("name").agg(F.count(F.lit(1)).alias("shared")).join(signs, "name"), "name")
    pairs = mixed.repartition(n, "token").sortWithinPartitions("token").mapInArrow(_across, "a bigint, b bigint").distinct()
    pairs = scratch.cut(pairs.join(stars, ["a", "b"], "left_anti"))
    scratch.drop(met)
    if not pairs.isEmpty():
        links = scratch.cut(links.unionByName(by_class(_links(pairs, sets, levels))))
        found = scratch.cut(connected_components(links, "u", "v"))
    levels.destroy()
    scratch.drop(sets)
    member = classes.join(found.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    low = member.groupBy("component").agg(F.min("low").alias("component_id"))
    member = scratch.cut(member.select("digest", "component").join(low, "component"))
    return rows.join(member, "digest", "left").select(
        "row", "doc_id", "h", F.col("size").cast("bigint").alias("n_shingles"), F.coalesce("component", "row").alias("component"),
        F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    return near_components(docs).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of every component, with all the input's columns: that of the smallest doc_id (null last, then by text).

    Decisions are matched by id and text; of repeated rows one stays. Rows without words are linked with nothing and
    stay, one of each id.
    """
    found = near_components(docs)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("first")
    id_, h, copies = (fresh(docs, n) for n in ("_stay_id", "_stay_text", "_stay_copies"))
    chosen = found.groupBy("component").agg(first).select(F.col("first.doc_id").alias(id_), F.col("first.h").alias(h)).distinct()
    times = found.groupBy(F.col("doc_id").alias("i"), F.col("h").alias("t")).agg(F.count(F.lit(1)).alias(copies))
    stay = chosen.join(times, F.col(id_).eqNullSafe(F.col("i")) & (F.col(h) == F.col("t"))).select(id_, h, copies)
    stay = Scratch(docs.sparkSession).cut(stay)
    rows = docs.join(stay, docs["doc_id"].cast("bigint").eqNullSafe(stay[id_]) & (_text_key(docs["text"]) == stay[h]))
    columns = [f"`{c}`" for c in docs.columns]
    single = rows.where(F.col(copies) == 1).select(*columns)
    repeated = rows.where(F.col(copies) > 1).dropDuplicates([id_, h]).select(*columns)
    return single.unionByName(repeated)
