"""Release tables: parquet for analysis, tab-separated and GMT text for exchange."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import clean_name
from ..schema import RELEASE
from . import delimited as D

# tables written so that a lookup by this column prunes row groups
_SORT = {"set_gene": ["set_id"], "set_pair": ["set_id"], "set_member": ["set_id"], "set_link": ["set_a"],
         "ppi": ["gene_a"], "string_ppi": ["gene_a"], "alias": ["alias"], "msigdb_equivalent": ["set_id"], "diagram": ["source_set_id"], "name_gram": ["gram"],
         "diagram_of": ["source_set_id"]}


def conform(df: DataFrame, table: str) -> DataFrame:
    """``df`` with exactly the columns and types of a release table; missing columns are NULL."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                       for f in RELEASE[table].fields])


def write(tables: dict[str, DataFrame], folder: str, organism: str) -> None:
    """One parquet folder per table, partitioned by organism.

    Only the organism's own partition is replaced, by the file committer, so a failed job leaves the old one.
    Every release table is written, without rows if there are none. Rows are clustered over files and ordered inside
    each by the column that lookups use, so a lookup opens few files.
    """
    spark = next(iter(tables.values())).sparkSession
    for name, layout in RELEASE.items():
        rows = conform(tables[name], name) if name in tables else spark.createDataFrame([], layout)
        if name in _SORT:
            rows = rows.repartitionByRange(*_SORT[name]).sortWithinPartitions(*_SORT[name])
        rows.withColumn("organism", F.lit(organism)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic") \
            .partitionBy("organism").parquet(f"{folder}/{name}")


def read(spark: SparkSession, folder: str, organism: str, table: str) -> DataFrame:
    layout = T.StructType([*RELEASE[table].fields, T.StructField("organism", T.StringType())])
    return spark.read.schema(layout).parquet(f"{folder}/{table}").where(F.col("organism") == organism).drop("organism")


def _write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("header", True).option("quote", "").option("escape", "").option("emptyValue", "").csv(path)


def _text(c: str, sep: str = ",") -> Column:
    return F.array_join(F.array_sort(c), sep).alias(c)


def gmt_lines(gset: DataFrame, set_gene: DataFrame) -> DataFrame:
    """(set_id, line): id, name and sorted genes, tab-separated; one line per set is the format itself."""
    genes = set_gene.groupBy("set_id").agg(F.array_join(F.array_sort(F.collect_set(F.col("gene").cast("string"))), "\t").alias("g"))
    return gset.join(genes, "set_id", "left").select("set_id", F.concat_ws("\t", F.col("set_id").cast("string"), "name", "g").alias("line"))


def write_text(gset: DataFrame, set_member: DataFrame, set_gene: DataFrame, set_pair: DataFrame, set_link: DataFrame | None,
               folder: str) -> None:
    """Text exports: genesets, set_genes, set_genepairs, set_members and gmt (one folder of part files each)."""
    head = gset
    if set_link is not None:
        links = set_link.groupBy(F.col("set_a").alias("set_id")).agg(F.array_join(F.array_sort(F.collect_set("set_b")), ",").alias("links"))
        head = gset.join(links, "set_id", "left")
    else:
        head = gset.withColumn("links", F.lit(""))
    _write_tsv(head.select("set_id", "name", "collection", _text("sources"), "n_genes", "n_pairs", F.coalesce("links", F.lit("")).alias("links")),
               f"{folder}/genesets")
    _write_tsv(set_gene.select("set_id", "gene", _text("sources")).orderBy("set_id", "gene"), f"{folder}/set_genes")
    _write_tsv(set_pair.select("set_id", "gene_a", "gene_b", _text("relations"), _text("sources")).orderBy("set_id", "gene_a", "gene_b"),
               f"{folder}/set_genepairs")
    _write_tsv(set_member.select("set_id", "source", F.col("source_set_id").alias("source_pathway")).orderBy("set_id", "source", "source_pathway"),
               f"{folder}/set_members")
    gmt_lines(gset, set_gene).select("line").write.mode("overwrite").text(f"{folder}/gmt")


def read_text(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Tables of a text release; list cells become arrays again."""
    many = lambda c, sep=",": F.filter(F.split(F.coalesce(F.col(c), F.lit("")), sep), lambda x: x != "").alias(c)
    sets = D.tsv(spark, f"{folder}/genesets")
    return {
        "gset": sets.select("set_id", "name", "collection", many("sources"), F.col("n_genes").cast("long"), F.col("n_pairs").cast("long")),
        "set_link": sets.select(F.col("set_id").alias("set_a"), F.explode(many("links")).alias("set_b")),
        "set_gene": D.tsv(spark, f"{folder}/set_genes").select("set_id", "gene", many("sources")),
        "set_pair": D.tsv(spark, f"{folder}/set_genepairs").select("set_id", "gene_a", "gene_b", many("relations"), many("sources")),
        "set_member": D.tsv(spark, f"{folder}/set_members").select("set_id", "source", F.col("source_pathway").alias("source_set_id")),
    }


def write_edges(edges: DataFrame, supported: DataFrame, path: str) -> None:
    """Interaction table as text; the sets that hold a pair are joined into its last cell."""
    sets = supported.groupBy("gene_a", "gene_b").agg(F.array_join(F.array_sort(F.collect_set("set_id")), ",").alias("pathway_sets"))
    _write_tsv(edges.join(sets, ["gene_a", "gene_b"], "left").select(
        "gene_a", "gene_b", _text("sources"), "n_sources", "n_pmids", _text("methods", "|"), "string_score", "tier",
        F.coalesce("pathway_sets", F.lit("")).alias("pathway_sets")).orderBy("gene_a", "gene_b"), path)


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    many = lambda c, sep: F.filter(F.split(F.coalesce(F.col(c), F.lit("")), sep), lambda x: x != "").alias(c)
    n = lambda c, t: F.coalesce(F.col(c).cast(t), F.lit(0).cast(t)).alias(c)
    return D.tsv(spark, path).select("gene_a", "gene_b", many("sources", ","), n("n_sources", "long"), n("n_pmids", "long"),
                                     many("methods", r"\|"), n("string_score", "int"), "tier", many("pathway_sets", ","))


def match_log_text(matches: DataFrame) -> DataFrame:
    """Review log rows in report order: decision, sources, cleaned names, ratio to three places, reason."""
    return matches.select(
        "decision", "source_a", clean_name(F.col("name_a")).alias("pathway_a"), "source_b", clean_name(F.col("name_b")).alias("pathway_b"),
        F.format_string("%.3f", F.col("ratio").cast("double")).alias("align_ratio"), "reason").orderBy("decision", F.lower("pathway_a"))


def related_text(matches: DataFrame) -> DataFrame:
    """Accepted matches with the ratio to four and the overlap to three places."""
    return matches.where("decision = 'accept'").select(
        "source_a", F.col("name_a").alias("pathway_a"), "source_b", F.col("name_b").alias("pathway_b"), F.col("score").alias("align_score"),
        F.format_string("%.4f", F.col("ratio").cast("double")).alias("align_ratio"),
        F.when(F.col("overlap").isNull(), "").otherwise(F.format_string("%.3f", F.col("overlap").cast("double"))).alias("jaccard"))


def write_table(df: DataFrame, path: str) -> None:
    _write_tsv(df, path)


def report_text(result: DataFrame) -> DataFrame:
    """A result as text: numbers with four significant digits, list columns last and comma-joined."""
    types = dict(result.dtypes)
    plain = [c for c in result.columns if not types[c].startswith("array")]
    lists = [c for c in result.columns if types[c].startswith("array")]
    cell = lambda c: F.format_string("%.4g", F.col(c)).alias(c) if types[c] == "double" else F.col(c).cast("string").alias(c)
    return result.select(*[cell(c) for c in plain], *[F.array_join(c, ",").alias(c) for c in lists])
