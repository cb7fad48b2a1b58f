"""Token ids as compressed binary frames with a shared dictionary, in blocks with an offset index.

File format, version 1: a folder of two Parquet tables.

``head``: one row: version, tokenizer (file name), end_id, id_bytes (2 or 4), dictionary (the zstandard dictionary,
empty if none) and dictionary_hash (sha256 of it).

``blocks``: one row a block: shard, block, dictionary_hash, doc_ids, n_tokens, offsets, payload. A document is one
zstandard frame of its ids, little-endian unsigned integers of id_bytes each, the end id last. Frame i of a block is
payload[offsets[i]:offsets[i + 1]]. Shards and the blocks in them follow ascending doc_id (nulls first; rows of one id
by a hash of the text), so min/max statistics of doc_ids and the offsets lead to one short document without reading
others.
"""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import Scratch, only

END_ID = 0
SAMPLE_DOCS, SAMPLE_CHARS, DICTIONARY_BYTES = 2000, 20_000, 64 << 10
CACHE_ENTRIES = 500_000
BLOCK_DOCS, BLOCK_BYTES = 1024, 1 << 22
LOWEST = -(1 << 63)

# Blanks for which the rules at spaces below are not stated.
_UNUSUAL = re.compile(r"[^\S \n\t\r]")
# Letters for which the pre-tokenizer's classes are stated here; pieces with others go to it.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f\u0391-\u03a1\u03a3-\u03a9\u03b1-\u03c9\u0400-\u045f\u3041-\u3096\u4e00-\u9fa5"
_PLAIN = re.compile(f"[ \\n\\t\\r!-~{_LETTERS}]*\\Z")
# Fixed value: the tokenizer's own pattern for its pieces, over these letters.
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[^\\s0-9{_LETTERS}]+|\\s+(?!\\S)|\\s+")

_encoders: dict[tuple[str, bool], Encoder] = {}


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it prints, else one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in shown}
    for b in range(256):
        out.setdefault(b, chr(256 + len(out) - len(shown)))
    return [out[b] for b in range(256)]


class _Pieces(dict):
    """Serialized ids of the pieces the tokenizer cuts a text into, asked from its model once each."""

    def __init__(self, model, width: int):
        super().__init__()
        self.model, self.width, self.letters = model, width, dict(enumerate(_byte_letters()))

    def __missing__(self, piece: str) -> bytes:
        spelled = (piece if piece.isascii() else piece.encode().decode("latin-1")).translate(self.letters)
        out = self[piece] = b"".join([t.id.to_bytes(self.width, "little") for t in self.model.tokenize(spelled)])
        return out


class _Chunks(dict):
    """Serialized ids of a space and what follows it up to the next space; None where the cut would not be sure."""

    def __init__(self, pieces: _Pieces, whole):
        super().__init__()
        self.pieces, self.whole = pieces, whole

    def __missing__(self, chunk: str) -> bytes | None:
        if chunk.isascii() and chunk.isalpha():
            out = self.pieces[" " + chunk]
        elif chunk and (chunk[0] in "\n\t\r" or chunk[-1] in "\n\t\r"):
            out = None
        elif _PLAIN.match(chunk):
            out = b"".join([self.pieces[p] for p in _PIECES.findall(" " + chunk)])
        else:
            out = None if _UNUSUAL.search(chunk) else self.whole(" " + chunk)
        self[chunk] = out
        return out


class Encoder:
    """The tokenizer with a bounded memory of what it has met; one per Python worker.

    The tokenizer's pattern begins a new piece at a space that stands between two characters that are no blanks, and at
    the second of two such spaces. So a text is cut at spaces and each chunk looked up; a new one is cut with the pattern
    and new pieces are given to the tokenizer's model. Texts with three spaces in a row, two at the end, or a line end
    or an unusual blank beside a space are encoded whole. The ids are those of the whole text. ``literal``: added tokens are
    cut as ordinary text; else they have their own ids, as the tokenizer does unless told otherwise, and texts that hold
    one are encoded whole.
    """

    def __init__(self, path: str, literal: bool = True):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = literal
        self.added = [] if literal else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.pieces = _Pieces(self.tokenizer.model, self.kind.itemsize)
        self.chunks = _Chunks(self.pieces, self._whole)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def _one(self, text: str) -> bytes:
        if any(x in text for x in self.added):
            return self._whole(text)
        first, *rest = text.split(" ")
        if "   " in text or text.endswith("  ") or first[-1:] in ("\n", "\t", "\r") or not _PLAIN.match(first):
            return self._whole(text)
        try:
            return b"".join([*map(self.pieces.__getitem__, _PIECES.findall(first)), *map(self.chunks.__getitem__, rest)])
        except TypeError:  # a chunk that is None
            return self._whole(text)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Serialized ids of each text, without the end id."""
        if len(self.chunks) > CACHE_ENTRIES:
            self.chunks.clear()
        if len(self.pieces) > 2 * CACHE_ENTRIES:
            self.pieces.clear()
        return [self._one(t) for t in texts]


def encoder(path: str, literal: bool = True) -> Encoder:
    if (path, literal) not in _encoders:
        _encoders[path, literal] = Encoder(path, literal)
    return _encoders[path, literal]


def train_dictionary(docs: DataFrame, tokenizer: str, literal: bool = True) -> bytes:
    """A dictionary from the id arrays of a bounded sample; empty if there are too few texts to train on.

    The sample is the first 2,000 texts, in the order of a hash, of those with 1 to 20,000 characters.
    """
    import zstandard

    rows = only(docs, text="string").where(f"length(text) BETWEEN 1 AND {SAMPLE_CHARS}")
    n = max(1, rows.count())
    # A hash keeps about twice as many texts as are wanted, wherever they are; then the first of them are taken.
    place = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / float(1 << 30)
    near = rows.select("text", place.alias("place")).where(F.col("place") <= (2.0 * SAMPLE_DOCS + 100) / n)
    texts = [r["text"] for r in near.orderBy("place", "text").limit(SAMPLE_DOCS).collect()]
    samples = encoder(tokenizer, literal).encode(texts)
    size = min(DICTIONARY_BYTES, sum(map(len, samples)) // 8)
    if len(samples) < 16 or size < 512:
        return b""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:  # too little variety to train on
        return b""


def _compressors(dictionary: bytes):
    import zstandard

    shared = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
    return zstandard.ZstdCompressor(level=1, **shared), zstandard.ZstdDecompressor(**shared)


def _bounds(docs: DataFrame, shards: int) -> list[int]:
    """Quantiles of doc_id (null lowest) that cut the table into ``shards`` ranges; from one pass over the ids."""
    if shards < 2:
        return []
    ids = only(docs, doc_id="bigint").select(F.coalesce("doc_id", F.lit(LOWEST)).alias("doc_id"))
    fractions = [i / shards for i in range(1, shards)]
    return ids.agg(F.percentile_approx("doc_id", fractions, 100 * shards)).first()[0] or []


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, shards: int | None = None, literal: bool = True) -> None:
    """Encode every text (null as empty) and write the format above to ``path``; ``literal`` as in Encoder.

    Encoding and compression happen where the texts are read; only compressed frames are shuffled, by ranges of doc_id
    that one pass over the ids fixes, and each task packs its sorted frames into bounded blocks. Rows of one id that
    fill several ranges are spread over them by a hash of the text, so an id with a third of the rows does not end in
    one task.
    """
    spark = docs.sparkSession
    dictionary = train_dictionary(docs, tokenizer, literal)
    digest = hashlib.sha256(dictionary).hexdigest()
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = np.array(_bounds(docs, shards), np.int64)

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, (compress, _) = encoder(tokenizer, literal), _compressors(dictionary)
        end = np.array([end_id], enc.kind).tobytes()
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                ids = [x + end for x in enc.encode([t or "" for t in batch.column("text").to_pylist()])]
                key = batch.column("doc_id").fill_null(LOWEST).to_numpy()
                h = batch.column("h").to_numpy()
                low, high = np.searchsorted(bounds, key, "left"), np.searchsorted(bounds, key, "right")
                share = (h.astype(np.float64) + 2.0**63) / 2.0**64
                shard = np.minimum(low + (share * (high - low + 1)).astype(np.int64), high)
                shard = np.where(high > low + 1, shard, high)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("h"), pa.array(shard.astype(np.int32)),
                     pa.array([len(x) // enc.kind.itemsize for x in ids], pa.int32()),
                     pa.array([compress.compress(x) for x in ids], pa.binary())], ["doc_id", "h", "shard", "n_tokens", "frame"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        shard, block, size = None, 0, 0

        def flush():
            offsets = np.concatenate([[0], np.cumsum([len(r[2]) for r in held])]).astype(np.int64).tolist()
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([block], pa.int64()), pa.array([digest]),
                 pa.array([[r[0] for r in held]], pa.list_(pa.int64())), pa.array([[r[1] for r in held]], pa.list_(pa.int32())),
                 pa.array([offsets], pa.list_(pa.int64())), pa.array([b"".join(r[2] for r in held)], pa.binary())],
                ["shard", "block", "dictionary_hash", "doc_ids", "n_tokens", "offsets", "payload"])

        for batch in batches:
            for s, d, n, f in zip(*(batch.column(c).to_pylist() for c in ("shard", "doc_id", "n_tokens", "frame"))):
                if held and (s != shard or len(held) == BLOCK_DOCS or size + len(f) > BLOCK_BYTES):
                    yield flush()
                    block = block + 1 if s == shard else 0
                    held, size = [], 0
                shard = s
                held.append((d, n, f))
                size += len(f)
        if held:
            yield flush()

    rows = only(docs, doc_id="bigint", text="string").select("doc_id", "text", F.xxhash64("text").alias("h"))
    made = rows.mapInArrow(frames, "doc_id bigint, h bigint, shard int, n_tokens int, frame binary")
    laid = made.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "h")
    laid.mapInArrow(pack, "shard int, block bigint, dictionary_hash string, doc_ids array<bigint>, n_tokens array<int>, "
                          "offsets array<bigint>, payload binary").write.option("compression", "none").parquet(f"{path}/blocks")
    head = spark.createDataFrame([(1, os.path.basename(tokenizer), end_id, encoder(tokenizer).kind.itemsize, bytearray(dictionary), digest)],
                                 "version int, tokenizer string, end_id int, id_bytes int, dictionary binary, dictionary_hash string")
    head.coalesce(1).write.parquet(f"{path}/head")


def read_tokens(spark: SparkSession, path: str, ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, on request, the ids of every document.

    A block made with another dictionary than the head names is an error. Starts come from the index alone: block totals
    are summed within shards, shard totals over shards (at most one row a shard); payloads are decoded in place and
    never shuffled.
    """
    head = spark.read.parquet(f"{path}/head").first()
    dictionary, digest, width = bytes(head["dictionary"]), head["dictionary_hash"], head["id_bytes"]
    if hashlib.sha256(dictionary).hexdigest() != digest:
        raise ValueError("the dictionary does not match its hash")
    blocks = spark.read.parquet(f"{path}/blocks")
    per_block = blocks.select("shard", "block", F.aggregate("n_tokens", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n"))
    totals = dict(per_block.groupBy("shard").agg(F.sum("n")).collect())  # one row a shard
    before, at = {}, 0
    for shard in sorted(totals):
        before[shard], at = at, at + totals[shard]
    shard_start = spark.createDataFrame(sorted(before.items()), "shard int, shard_start bigint")
    run = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_block.join(shard_start, "shard").select("shard", "block", (F.col("shard_start") + F.coalesce(F.sum("n").over(run), F.lit(0))).alias("block_start"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, plain = _compressors(dictionary)
        kind = np.dtype(f"<u{width}")
        for batch in batches:
            for row in batch.to_pylist():
                if row["dictionary_hash"] != digest:
                    raise ValueError("block of another dictionary")
                offsets, n = row["offsets"], row["n_tokens"]
                at = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
                found = [np.frombuffer(plain.decompress(row["payload"][a:b], max_output_size=k * width), kind).astype("<u4")
                         for a, b, k in zip(offsets, offsets[1:], n)]
                if [len(x) for x in found] != n:
                    raise ValueError("frame of another length than the index says")
                size = len(n)
                columns = [pa.array([row["shard"]] * size, pa.int32()), pa.array([row["block"]] * size, pa.int64()),
                           pa.array(row["doc_ids"], pa.int64()), pa.array(at[:-1], pa.int64()), pa.array(n, pa.int64()),
                           pa.array([zlib.crc32(x.tobytes()) for x in found], pa.int64())]
                names = ["shard", "block", "doc_id", "within", "n_tokens", "ids_crc32"]
                if ids:
                    columns.append(pa.array([x.tolist() for x in found], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = "shard int, block bigint, doc_id bigint, within bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * ids
    return blocks.mapInArrow(decode, schema).join(starts, ["shard", "block"]).select(
        "doc_id", (F.col("block_start") + F.col("within")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * ids)


def token_digests(docs: DataFrame, tokenizer: str, literal: bool = True) -> DataFrame:
    """Write the format to a fresh table of the shared folder and return what reading it back gives; ``literal`` as in Encoder.

    One row per input row, repeated and null ids included; an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession)
    path = scratch.folder()
    write_tokens(docs, path, tokenizer, literal=literal)
    return read_tokens(docs.sparkSession, path)
