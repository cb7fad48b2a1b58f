"""Readers of tab-separated and line-oriented source files.

Files are read as declared columns (never inferred); columns of files with a header are taken by name.
Identifiers stay as the source wrote them, resolving them is a join (operators.identifiers).
"""

from __future__ import annotations

import io
import re
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import CURATION


def tsv(spark: SparkSession, path: str, header: bool = True, comment: str | None = None) -> DataFrame:
    reader = spark.read.option("sep", "\t").option("quote", "").option("header", header).option("mode", "PERMISSIVE")
    if comment:
        reader = reader.option("comment", comment)
    return reader.csv(path)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, pos): plain or .gz text in file order."""
    return spark.read.text(path).select(F.col("value").alias("line"), F.monotonically_increasing_id().alias("pos"))


def fields(df: DataFrame, *names: str, line: str = "line", sep: str = "\t") -> DataFrame:
    """Fields of a line by position; absent trailing fields are NULL."""
    parts = F.split(line, re.escape(sep), -1)
    return df.select("*", *[F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(names)], F.size(parts).alias("n_fields"))


def zip_lines(spark: SparkSession, path: str, member: str = ".*", first_only: bool = True) -> DataFrame:
    """(file, member, line, pos) of the text members of zip archives whose name matches ``member``."""
    def unpack(batches):
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    found = [m for m in archive.namelist() if re.search(member, m)]
                    for m in found[:1] if first_only else found:
                        with archive.open(m) as raw:
                            text = io.TextIOWrapper(raw, encoding="utf-8", errors="replace")
                            pos = 0
                            while chunk := text.readlines(1 << 22):
                                yield pd.DataFrame({"file": name, "member": m, "line": [x.rstrip("\r\n") for x in chunk],
                                                    "pos": range(pos, pos + len(chunk))})
                                pos += len(chunk)
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(
        unpack, "file string, member string, line string, pos long")


def _alias(df: DataFrame, key: Column, kind: str, prio: int, last_wins: bool = False, symbol: str = "symbol") -> DataFrame:
    place = -F.col("pos") if last_wins else F.col("pos")
    return df.select(F.upper(F.trim(key)).alias("key"), F.col(symbol).alias("symbol"), F.lit(kind).alias("kind"),
                     F.lit(prio).alias("prio"), place.alias("pos")).where("key <> ''")


def _items(c: str, sep: str) -> Column:
    return F.filter(F.transform(F.split(c, sep), lambda x: F.trim(F.regexp_replace(x, '^"|"$', ""))), lambda x: x != "")


# Cross-reference databases whose bare accession is the key, and those known by both forms.
BARE_XREFS = ("Ensembl", "FLYBASE", "WormBase", "TAIR", "ZFIN")
DOUBLE_XREFS = ("MGI", "HGNC", "RGD", "SGD")


def _gene_rows(spark: SparkSession, path: str) -> DataFrame:
    raw = tsv(spark, path)
    return raw.withColumnRenamed(raw.columns[0], "tax_id").withColumn("pos", F.monotonically_increasing_id())


def gene_info(spark: SparkSession, path: str, taxid: str | None = None, split: bool = False) -> tuple[DataFrame, DataFrame]:
    """(alias rows, symbol -> gene_id) from a gene_info table, optionally one taxon of a shared file or of a folder that
    ``split_gene_info`` wrote, of which only that taxon's files are read."""
    raw = of_taxa(spark, path, "tax_id", taxid) if split else _gene_rows(spark, path)
    if taxid and not split:
        raw = raw.where(F.col("tax_id") == taxid)
    g = raw.withColumn("symbol", F.col("Symbol"))
    real = lambda c: F.coalesce(F.col(c), F.lit("-")).isin("-", "") == F.lit(False)
    xref = g.select("symbol", "pos", F.explode(_items("dbXrefs", r"\|")).alias("x")).where(F.contains("x", F.lit(":"))) \
        .withColumn("db", F.split("x", ":")[0]).withColumn("val", F.regexp_replace("x", "^[^:]*:", ""))
    rows = _alias(g, F.col("symbol"), "exact", 1, last_wins=True) \
        .union(_alias(g, F.col("GeneID"), "exact", 2)).union(_alias(g.where(real("LocusTag")), F.col("LocusTag"), "exact", 2)) \
        .union(_alias(xref, F.when(F.col("db").isin(*BARE_XREFS), F.col("val")).otherwise(F.col("x")), "exact", 2)) \
        .union(_alias(xref.where(F.col("db").isin(*DOUBLE_XREFS)), F.col("val"), "exact", 2)) \
        .union(_alias(g.where(real("Synonyms")).select("symbol", "pos", F.explode(_items("Synonyms", r"\|")).alias("s")).where("s <> '-'"),
                      F.col("s"), "alias", 0))
    nom = "Symbol_from_nomenclature_authority"
    if nom in g.columns:
        rows = rows.union(_alias(g.where(real(nom) & (F.col(nom) != F.col("symbol"))), F.col(nom), "alias", 0))
    ids = g.groupBy("symbol").agg(F.max_by("GeneID", "pos").alias("gene_id"))
    return rows, ids


def kegg_gene_list(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(alias rows, empty gene ids) from a KEGG gene list: locus, ..., "names; description"."""
    raw = lines(spark, path).withColumn("f", F.split("line", "\t")).where(F.contains(F.col("f")[0], F.lit(":")))
    desc = F.when(F.size("f") > 1, F.element_at("f", -1)).otherwise(F.lit(""))
    g = raw.withColumn("locus", F.regexp_replace(F.col("f")[0], "^[^:]*:", "")).withColumn("desc", desc).withColumn(
        "names", F.when(F.contains("desc", F.lit(";")), F.transform(F.split(F.split("desc", ";")[0], ","), lambda x: F.trim(x)))
        .otherwise(F.array().cast("array<string>")))
    first = F.get("names", F.lit(0))
    g = g.withColumn("symbol", F.when((F.coalesce(first, F.lit("")) != "") & ~F.contains(first, F.lit(" ")), first).otherwise(F.col("locus")))
    rest = F.filter(F.slice("names", 2, 1 << 20), lambda x: (x != "") & ~F.contains(x, F.lit(" ")))
    rows = _alias(g, F.col("symbol"), "exact", 2).union(_alias(g, F.col("locus"), "exact", 1, last_wins=True)) \
        .union(_alias(g.select("symbol", "pos", F.explode(rest).alias("s")), F.col("s"), "alias", 0))
    return rows, g.select("symbol", F.lit("").alias("gene_id")).where("false")


def hgnc(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(alias rows, symbol -> gene_id): approved entries; they override every other exact layer."""
    g = tsv(spark, path).withColumn("pos", F.monotonically_increasing_id()).where("status = 'Approved' OR status IS NULL")
    rows = _alias(g, F.col("symbol"), "exact", 0, last_wins=True)
    many = lambda c: g.select("symbol", "pos", F.explode(_items(c, r"\|")).alias("v"))
    for c, kind in (("hgnc_id", "exact"), ("entrez_id", "exact"), ("ensembl_gene_id", "exact"), ("uniprot_ids", "exact"),
                    ("prev_symbol", "previous"), ("alias_symbol", "alias")):
        if c in g.columns:
            rows = rows.union(_alias(many(c), F.col("v"), kind, 0, last_wins=kind == "exact"))
    ids = many("entrez_id").groupBy("symbol").agg(F.max_by("v", "pos").alias("gene_id")) if "entrez_id" in g.columns \
        else g.select("symbol", F.lit("").alias("gene_id")).where("false")
    return rows, ids


def uniprot_idmapping(spark: SparkSession, path: str, gene_ids: DataFrame) -> DataFrame:
    """alias rows: accession and entry name -> symbol through the first gene id."""
    u = fields(lines(spark, path), "acc", "entry", "ids").withColumn("gene_id", F.trim(F.split("ids", ";")[0]))
    hit = u.where("gene_id <> ''").join(gene_ids, "gene_id")
    return _alias(hit, F.col("acc"), "exact", 3).union(_alias(hit, F.col("entry"), "exact", 3))


def uniprot_rest(spark: SparkSession, path: str, gene_ids: DataFrame, lookup: DataFrame) -> DataFrame:
    """alias rows: accession and entry name -> symbol by the first known gene id, else by an ordered locus tag."""
    u = tsv(spark, path).withColumn("pos", F.monotonically_increasing_id())
    by_id = u.select("Entry", "pos", F.posexplode(_items("GeneID", ";")).alias("i", "gene_id")).join(gene_ids, "gene_id") \
        .groupBy("Entry").agg(F.min_by("symbol", "i").alias("by_id"))
    locus = "Gene Names (ordered locus)"
    out = u.join(by_id, "Entry", "left")
    if locus in u.columns:
        tags = u.select("Entry", F.posexplode(_items_words(locus)).alias("i", "tag")).withColumn("key", F.upper("tag")) \
            .join(lookup.where("exact IS NOT NULL").select("key", "exact"), "key") \
            .groupBy("Entry").agg(F.min_by("exact", "i").alias("by_tag"))
        out = out.join(tags, "Entry", "left")
    else:
        out = out.withColumn("by_tag", F.lit(None).cast("string"))
    out = out.withColumn("symbol", F.coalesce("by_id", "by_tag")).where("symbol IS NOT NULL")
    return _alias(out, F.col("Entry"), "exact", 4).union(_alias(out, F.col("Entry Name"), "exact", 4))


def _items_words(c: str) -> Column:
    return F.filter(F.split(F.regexp_replace(F.col(c), "/", " "), r"\s+"), lambda x: x != "")


def uniprot_annotations(spark: SparkSession, path: str, taxid: str) -> DataFrame:
    """Annotation rows from the GO cross-references of a UniProt table (evidence ``UniProt``)."""
    u = tsv(spark, path)
    go = "Gene Ontology IDs" if "Gene Ontology IDs" in u.columns else u.columns[-1]
    return u.select(F.col("Entry").alias("object_id"), F.col("Entry").alias("object_symbol"), F.lit("").alias("qualifier"),
                    F.explode(_items(go, ";")).alias("term"), F.lit("UniProt").alias("evidence"),
                    F.lit(f"taxon:{taxid}").alias("taxon")).where(F.col("term").startswith("GO:"))


def gmt(spark: SparkSession, path: str) -> DataFrame:
    """(set_id, description, gene, pos): lines with at least three fields, empty genes dropped."""
    f = lines(spark, path).withColumn("f", F.split("line", "\t")).where(F.size("f") >= 3)
    return f.select(F.col("f")[0].alias("set_id"), F.col("f")[1].alias("description"), "pos",
                    F.explode(F.slice("f", 3, 1 << 30)).alias("gene")).where("gene <> ''")


def legacy_source(spark: SparkSession, gen: str, gpr: str | None, source: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pathway, gene, pair) rows of one archived source."""
    g = fields(lines(spark, gen), "name", "gene").where("n_fields >= 2 AND name <> ''")
    gene = g.select(F.lit(source).alias("source"), "name", "gene").distinct()
    seen = g.select("name", "pos")
    pair = gene.select("source", "name", F.lit("").alias("gene_a"), F.lit("").alias("gene_b"), F.lit("").alias("relation")).where("false")
    if gpr:
        p = fields(lines(spark, gpr), "gene_a", "gene_b", "rel", "name").where("n_fields >= 4")
        pair = p.select(F.lit(source).alias("source"), "name", "gene_a", "gene_b", F.explode(F.split(F.trim("rel"), r"\s+")).alias("relation")).distinct()
        seen = seen.union(p.select("name", F.col("pos") + F.lit(1 << 55)))
    pathway = seen.groupBy("name").agg(F.min("pos").alias("pos")).select(F.lit(source).alias("source"), "name", F.lit("").alias("source_id"), "pos")
    return pathway, gene, pair


def biocyc_columns(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(pathway, gene) rows of a pathways.col table; genes are in the GENE-NAME columns."""
    t = tsv(spark, path, comment="#").withColumn("pos", F.monotonically_increasing_id())
    names = [c for c in t.columns if c.startswith("GENE-NAME")]
    base = t.select(F.lit("BioCyc").alias("source"), F.regexp_replace(F.coalesce("NAME", F.lit("")), "<[^>]+>", "").alias("name"),
                    F.coalesce(F.col("UNIQUE-ID"), F.lit("")).alias("source_id"), "pos", F.array(*[F.col(f"`{c}`") for c in names]).alias("g"))
    gene = base.select("source", "name", F.explode("g").alias("gene")).where("gene <> ''").distinct()
    return base.drop("g"), gene


def obo(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(term, edge, alternative id) rows of an OBO ontology; each stanza is one record of the text reader."""
    stanza = spark.read.option("lineSep", "\n\n").text(path).where(F.col("value").rlike(r"^\s*\[Term\]"))
    tag = lambda t: F.regexp_extract_all("value", F.lit(rf"(?m)^{t}:\s*(.*?)\s*$"), F.lit(1))
    last = lambda t: F.coalesce(F.try_element_at(tag(t), F.lit(-1)), F.lit(""))
    rows = stanza.select(F.get(tag("id"), F.lit(0)).alias("term"), last("name").alias("name"), last("namespace").alias("namespace"),
                         F.array_contains(tag("is_obsolete"), "true").alias("obsolete"), last("replaced_by").alias("replaced_by"),
                         F.regexp_extract(last("def"), r'^"(.*)"', 1).alias("definition"), tag("alt_id").alias("alt"),
                         F.transform(tag("is_a"), lambda x: F.split(x, r"\s+")[0]).alias("isa"),
                         F.transform(F.filter(tag("relationship"), lambda x: x.startswith("part_of ")),
                                     lambda x: F.split(x, r"\s+")[1]).alias("part")).where("term IS NOT NULL")
    edge = rows.select(F.col("term").alias("child"), F.explode(F.array_union("isa", "part")).alias("parent"))
    alt = rows.select(F.explode("alt").alias("alt_id"), "term")
    return rows.select("term", "name", "namespace", "obsolete", "replaced_by", "definition"), edge, alt


def gaf(spark: SparkSession, path: str, taxid: str | None = None) -> DataFrame:
    """Annotation rows (object_id, object_symbol, qualifier, term, evidence, taxon); at least 15 columns."""
    f = F.split("value", "\t", -1)
    rows = spark.read.text(path).where(~F.col("value").startswith("!") & (F.size(f) >= 15)).select(
        f[1].alias("object_id"), f[2].alias("object_symbol"), f[3].alias("qualifier"), f[4].alias("term"),
        f[6].alias("evidence"), f[12].alias("taxon"))
    return rows.where(F.array_contains(F.split("taxon", r"\|"), f"taxon:{taxid}")) if taxid else rows


def annotations(raw: DataFrame, term: DataFrame, alt: DataFrame, lookup: DataFrame | None = None,
                exclude: tuple[str, ...] = ("ND",)) -> DataFrame:
    """(term, gene, evidence): negated and excluded evidence dropped, alternative and replaced ids rewritten,
    genes resolved by symbol, else by object id."""
    from ..operators.identifiers import map_column

    kept = raw.where(~F.contains("qualifier", F.lit("NOT")) & ~F.col("evidence").isin(*exclude))
    kept = kept.join(alt.select(F.col("alt_id").alias("term"), F.col("term").alias("main")), "term", "left") \
        .withColumn("term", F.coalesce("main", "term")).drop("main")
    known = term.select("term", "obsolete", "replaced_by")
    kept = kept.join(known, "term").where("NOT obsolete OR replaced_by <> ''").withColumn(
        "term", F.when(F.col("obsolete"), F.col("replaced_by")).otherwise(F.col("term")))
    if lookup is None:
        return kept.select("term", F.col("object_symbol").alias("gene"), "evidence").where("gene <> ''").distinct()
    mapped = map_column(map_column(kept, "object_symbol", lookup, "by_symbol"), "object_id", lookup, "by_id")
    return mapped.select("term", F.coalesce("by_symbol", "by_id").alias("gene"), "evidence").where("gene IS NOT NULL").distinct()


# ---------------------------------------------------------------- interaction feeds: feed, id_a, id_b, source, pmid, method, score
def _feed(df: DataFrame, feed: str, a: Column, b: Column, pmid=None, method=None, score=None, source=None) -> DataFrame:
    blank = F.lit("")
    return df.select(F.lit(feed).alias("feed"), a.alias("id_a"), b.alias("id_b"),
                     (F.lit(feed) if source is None else source).alias("source"), (blank if pmid is None else pmid).alias("pmid"),
                     (blank if method is None else method).alias("method"),
                     (F.lit(0) if score is None else score).cast("int").alias("score"))


def string_links(spark: SparkSession, links: str, info: str, min_score: int = 700, feed: str = "STRING") -> DataFrame:
    """STRING links at or above the score, both proteins named through the info table."""
    raw = spark.read.option("sep", " ").option("header", True).csv(links).withColumn("s", F.col("combined_score").cast("int"))
    name = fields(lines(spark, info), "protein", "symbol").select("protein", "symbol")
    side = lambda c, s: name.select(F.col("protein").alias(c), F.col("symbol").alias(s))
    hit = raw.where(F.col("s") >= min_score).join(side("protein1", "a"), "protein1").join(side("protein2", "b"), "protein2")
    return _feed(hit, feed, F.col("a"), F.col("b"), score=F.col("s"))


def biogrid(spark: SparkSession, path: str, taxid: str = "9606", organism: str = "", physical_only: bool = True,
            feed: str = "BioGRID") -> DataFrame:
    """BioGRID tab3 rows of one organism (a text file, or the member of an archive named after the organism)."""
    want = ("Organism ID Interactor A", "Organism ID Interactor B", "Experimental System Type", "Entrez Gene Interactor A",
            "Entrez Gene Interactor B", "Publication Source", "Experimental System")
    if path.endswith(".zip"):
        text = zip_lines(spark, path, re.escape("-" + "_".join(organism.split()[:2])))
        head = text.where("pos = 0").select("line").first()
        columns = head["line"].split("\t") if head else list(want)
        raw = fields(text.where("pos > 0"), *columns)
    else:
        raw = tsv(spark, path)
    keep = (F.col("`Organism ID Interactor A`") == taxid) & (F.col("`Organism ID Interactor B`") == taxid)
    if physical_only:
        keep = keep & (F.col("`Experimental System Type`") == "physical")
    return _feed(raw.where(keep), feed, F.col("`Entrez Gene Interactor A`"), F.col("`Entrez Gene Interactor B`"),
                 F.col("`Publication Source`"), F.col("`Experimental System`"))


# Identifier, taxon, publication and method patterns of PSI-MITAB.
MITAB_ID = r"(?i)(?:uniprotkb|entrez gene/locuslink|ensembl):([^|()\s]+)"
MITAB_TAXON = r"taxid:(-?\d+)"


def mitab(df: DataFrame, taxid: str = "9606", split_source: bool = True, feed: str = "IntAct") -> DataFrame:
    """PSI-MITAB lines (column line): same-species rows; evidence curated by MINT keeps that source name."""
    f = F.split("line", "\t", -1)
    at = lambda i: F.coalesce(F.get(f, F.lit(i)), F.lit(""))
    rows = df.where(~F.col("line").startswith("#") & (F.size(f) >= 11)).select(
        F.regexp_extract(at(9), MITAB_TAXON, 1).alias("ta"), F.regexp_extract(at(10), MITAB_TAXON, 1).alias("tb"),
        F.regexp_extract(F.concat_ws("|", at(0), at(2)), MITAB_ID, 1).alias("a"),
        F.regexp_extract(F.concat_ws("|", at(1), at(3)), MITAB_ID, 1).alias("b"),
        F.regexp_extract(at(8), r"pubmed:(\d+)", 1).alias("pmid"), F.regexp_extract(at(6), r'"MI:\d+"\(([^)]*)\)', 1).alias("method"),
        F.lower(F.array_join(F.regexp_extract_all(at(12), F.lit(r"\(([^)]*)\)"), F.lit(1)), " ")).alias("db"))
    kept = rows.where((F.col("ta") == taxid) & (F.col("tb") == taxid) & (F.col("a") != "") & (F.col("b") != ""))
    source = F.when(F.contains("db", F.lit("mint")), "MINT").otherwise("IntAct") if split_source else F.lit(feed)
    return _feed(kept, feed, F.col("a"), F.col("b"), F.col("pmid"), F.col("method"), source=source)


def _write_split(rows: DataFrame, key: str, folder: str) -> None:
    """One folder a key. Rows are dealt by ranges of (key, pos): a large key is written by many tasks, and a small one has
    one file however many tasks read the source."""
    rows.repartitionByRange(key, "pos").sortWithinPartitions(key, "pos").write.mode("overwrite").partitionBy(key).parquet(folder)


def split_by_taxon(df: DataFrame, folder: str) -> None:
    """Same-species MITAB lines (line, pos) written once, one folder per taxon, for pruned reads later."""
    f = F.split("line", "\t", -1)
    taxon = lambda i: F.regexp_extract(F.coalesce(F.get(f, F.lit(i)), F.lit("")), MITAB_TAXON, 1)
    rows = df.where(~F.col("line").startswith("#")).select("line", "pos", taxon(9).alias("taxid"), taxon(10).alias("_b"))
    _write_split(rows.where("taxid <> '' AND taxid = _b").drop("_b"), "taxid", folder)


def split_gene_info(spark: SparkSession, path: str, folder: str) -> None:
    """A shared gene_info file written once, one folder per taxon, with the place of each row in the file."""
    _write_split(_gene_rows(spark, path).where("tax_id <> ''"), "tax_id", folder)


def of_taxa(spark: SparkSession, folder: str, key: str, taxa: str | DataFrame) -> DataFrame:
    """Rows of a split folder for one taxon, or for all of a table with the column ``key``; only their folders are read
    (for a table Spark prunes at run time, once it knows the table's rows). A table's further columns are kept."""
    layout = spark.read.parquet(folder).schema
    fields_ = [T.StructField(f.name, T.StringType() if f.name == key else f.dataType) for f in layout.fields]
    rows = spark.read.schema(T.StructType(fields_)).parquet(folder)
    return rows.where(F.col(key) == taxa) if isinstance(taxa, str) else rows.join(taxa, key)


def pair_table(spark: SparkSession, path: str, feed: str) -> DataFrame:
    """Two- or three-column pair tables; the third column counts as a score when it is all digits."""
    p = fields(lines(spark, path), "a", "b", "s").where(~F.col("line").startswith("#") & (F.col("n_fields") >= 2))
    score = F.when(F.col("s").rlike(r"^\d+$"), F.col("s").try_cast("int")).otherwise(F.lit(0))
    return _feed(p, feed, F.col("a"), F.col("b"), score=F.coalesce(score, F.lit(0)))


def msigdb(spark: SparkSession, path: str) -> DataFrame:
    """(set_name, exact_source, systematic_name, collection, gene) of MSigDB JSON collections; a record without a
    collection belongs to that of its file name, in upper case."""
    record = ("map<string,struct<geneSymbols:array<string>,exactSource:string,systematicName:string,collection:string>>")
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", record)).alias("set_name", "r"))
    return rows.select("set_name", F.coalesce("r.exactSource", F.lit("")).alias("exact_source"),
                       F.coalesce("r.systematicName", F.lit("")).alias("systematic_name"),
                       F.coalesce(F.nullif("r.collection", F.lit("")), F.upper(F.regexp_extract(F.input_file_name(), r"([^/]+?)\.[^./]*$", 1))).alias("collection"), F.explode_outer("r.geneSymbols").alias("gene"))


def curation(spark: SparkSession, path: str) -> DataFrame:
    """Reviewed decisions on name pairs; comment lines and the header are skipped."""
    rows = spark.read.option("sep", "\t").option("quote", "").option("comment", "#").schema(CURATION).csv(path)
    return rows.where("name_a <> 'name_a' AND decision IS NOT NULL").select(
        "name_a", "name_b", F.trim("decision").alias("decision"), F.coalesce(F.trim("reason"), F.lit("")).alias("reason"))


def gene_list(spark: SparkSession, path: str) -> DataFrame:
    """(ident, pos) from a list separated by commas or white space."""
    words = F.filter(F.split(F.regexp_replace("line", ",", " "), r"\s+"), lambda x: x != "")
    return lines(spark, path).select("pos", F.posexplode(words).alias("i", "ident")).select(
        "ident", F.struct("pos", "i").alias("pos"))


def ranking(spark: SparkSession, path: str) -> DataFrame:
    """(gene, score, input_pos) of a two-column ranking; rows without a number are skipped."""
    f = F.split(F.regexp_replace("line", ",", "\t"), "\t", -1)
    return lines(spark, path).where(F.size(f) >= 2).select(
        F.trim(f[0]).alias("gene"), F.trim(f[1]).try_cast("double").alias("score"), F.col("pos").alias("input_pos")).where("score IS NOT NULL")
