"""Shared helpers: words, spans of patterns, row keys, and tables in the shared checkpoint folder."""

from __future__ import annotations

import string
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpoint_folder

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
TOKEN = r"[^\x20\x09-\x0D]+"
BLANKS = r"[\x20\x09-\x0D]+"

SPAN = "array<struct<start:bigint,end:bigint,kind:string>>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def only(df: DataFrame, **types: str) -> DataFrame:
    """The named columns and no others, cast; whatever else the input carries cannot clash with working columns."""
    return df.select(*[F.col(f"`{name}`").cast(kind).alias(name) for name, kind in types.items()])


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the input does not use."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def ascii_lower(text: Column) -> Column:
    """A-Z to lower case, everything else unchanged; pure ASCII takes the quick built-in."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def words(text: Column, pattern: str = WORD) -> Column:
    """All words of a lower-cased text; null counts as empty."""
    return F.regexp_extract_all(F.coalesce(ascii_lower(text), F.lit("")), F.lit(pattern), F.lit(0))


def spans(text: Column, kind: str, pattern: str, keep: Callable[[Column], Column] | None = None) -> Column:
    """Leftmost non-overlapping matches of ``pattern`` as (start, end, kind) in code points; failing matches are
    dropped without a retry. Positions come from the lengths of the pieces between the matches."""
    pieces = F.transform(F.split(text, pattern, -1), lambda x: F.length(x).cast("bigint"))
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    empty = F.array().cast("array<struct<start:bigint,end:bigint,hit:string>>")

    def step(acc, x):
        start = acc["at"] + x["gap"]
        end = start + F.length(x["hit"])
        row = F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("hit"))
        return F.struct(end.alias("at"), F.array_append(acc["out"], row).alias("out"))

    zipped = F.zip_with(F.slice(pieces, F.lit(1), F.size(found)), found,
                        lambda g, m: F.struct(g.alias("gap"), m.alias("hit")))
    out = F.aggregate(zipped, F.struct(F.lit(0).cast("bigint").alias("at"), empty.alias("out")), step)["out"]
    if keep is not None:
        out = F.filter(out, lambda x: keep(x["hit"]))
    return F.transform(out, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(kind).alias("kind")))


def no_spans() -> Column:
    return F.array().cast(SPAN)


def ordered(found: Column, kinds: list[str]) -> Column:
    """Spans sorted by start, then by the listed order of the kinds, then by end."""
    rank = F.create_map(*[x for i, k in enumerate(kinds) for x in (F.lit(k), F.lit(i))])
    keyed = F.transform(found, lambda x: F.struct(x["start"].alias("start"), rank[x["kind"]].alias("rank"),
                                                  x["end"].alias("end"), x["kind"].alias("kind")))
    return F.array_sort(keyed)


def listed(sorted_spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(sorted_spans, lambda x: F.concat_ws(
        ":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


class Scratch:
    """Intermediate tables in the shared folder of ``spark.checkpoint.dir``, dropped when no longer read.

    Tables survive lost executors. What a caller's lazy result still reads is kept and removed when the JVM ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = checkpoint_folder(spark).rstrip("/")

    def _path(self, where: str):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(where)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def folder(self) -> str:
        """A fresh path, removed when the JVM ends."""
        where = f"{self.root}/llm-{uuid.uuid4().hex}"
        path, fs = self._path(where)
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        return where

    def cut(self, df: DataFrame, **options) -> DataFrame:
        """Write ``df`` and read it back: cuts lineage and gives the planner a size."""
        where = f"{self.folder()}/t"
        df.write.options(**options).parquet(where)
        out = self.spark.read.schema(T.StructType.fromJson(df.schema.jsonValue())).parquet(where)
        out._scratch = where
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        for df in frames:
            where = getattr(df, "_scratch", None)
            if where:
                path, fs = self._path(where)
                fs.delete(path, True)
