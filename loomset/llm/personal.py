"""Personal data: patterns, and terms near them that give the person away (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import Scratch, ascii_lower, listed, no_spans, only, ordered, spans, words

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "general", "remove")

# The same matches as the plain patterns, written so that long runs cost linear time and no recursion: a run starts
# where the one before cannot be extended (or where the last match ended), and repeats give nothing back.
_LOCAL = "A-Za-z0-9._%+-"
EMAIL = rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9]){11}(?:[\x20-]?+[0-9])*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Words before lower-casing.
WORD_ANY = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_PART = "0*([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the check digit holds: every second digit from the right doubled, nines cast out."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(
        c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(values, F.lit(0), lambda a, v: a + F.coalesce(v, F.lit(0))) % 10 == 0


def base_spans(text: Column) -> Column:
    """Emails, addresses, cards and phones of a text, unsorted."""
    email = F.when(F.contains(text, F.lit("@")), spans(text, "email", EMAIL))
    ip = F.when(F.regexp_like(text, F.lit(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]")),
                spans(text, "ip", IP, lambda m: F.regexp_like(m, F.lit(rf"^{_PART}(\.{_PART}){{3}}$"))))
    card = F.when(F.regexp_like(text, F.lit(r"[0-9](?:[\x20-]?[0-9]){11}")),
                  spans(text, "card", CARD, lambda m: F.when(F.length(_digits(m)) <= 19, luhn(_digits(m))).otherwise(False)))
    phone = F.when(F.contains(text, F.lit("+")),
                   spans(text, "phone", PHONE, lambda m: F.length(_digits(m)).between(9, 15)))
    return F.concat(*[F.coalesce(x, no_spans()) for x in (email, ip, card, phone)])


def _entity(text: Column, x: Column) -> Column:
    """The kind of a protected span with the lower-cased match."""
    return F.concat_ws(":", x["kind"], F.lower(F.substring(text, x["start"].cast("int") + 1, (x["end"] - x["start"]).cast("int"))))


def _contexts(text: Column, found: Column, window: int) -> Column:
    """(entity, term, start, end) of every word within ``window`` code points of a protected span.

    A word that the window cuts, a word without a letter beyond one character, and a word that touches a protected span
    are left out.
    """
    def near(x):
        entity = _entity(text, x)
        low = F.greatest(F.lit(0).cast("bigint"), x["start"] - window)
        before = F.filter(spans(F.substring(text, low.cast("int") + 1, (x["start"] - low).cast("int")), "", WORD_ANY),
                          lambda w: (w["start"] > 0) | (low == 0))
        after = F.filter(spans(F.substring(text, x["end"].cast("int") + 1, F.lit(window)), "", WORD_ANY),
                         lambda w: w["end"] < window)
        moved = F.concat(F.transform(before, lambda w: F.struct((w["start"] + low).alias("start"), (w["end"] + low).alias("end"))),
                         F.transform(after, lambda w: F.struct((w["start"] + x["end"]).alias("start"), (w["end"] + x["end"]).alias("end"))))
        free = F.filter(moved, lambda w: (w["end"] - w["start"] > 1) & ~F.exists(found, lambda p: (p["start"] < w["end"]) & (w["start"] < p["end"])))
        return F.transform(free, lambda w: F.struct(
            entity.alias("entity"), ascii_lower(F.substring(text, w["start"].cast("int") + 1, (w["end"] - w["start"]).cast("int"))).alias("term"),
            w["start"].alias("start"), w["end"].alias("end")))
    return F.flatten(F.transform(found, near))


def find_personal(docs: DataFrame, window: int = 80, general: float = 0.85, remove: float = 0.95, keep_text: bool = False) -> DataFrame:
    """One row per input row: doc_id and ``found``, the spans (start, rank, end, kind) sorted; ``text`` on request.

    Protected entities are the matches of the base patterns. For an entity e and a term t within ``window`` code points
    of it, over documents: PMI(e; t) = log(N df(e, t) / (df(e) df(t))) is what t reveals of e, log(N / df(e)) is all
    there is to reveal. A term whose share of it reaches ``general`` is generalised, from ``remove`` on it is
    removed; the spans of kind ``general`` and ``remove`` mark these occurrences. Document frequencies cover every word
    and every entity of every text, also where an entity has no term near it.

    Frequent terms and entities are counted with map-side partial sums; only occurrences near protected spans are kept
    as rows. A null text counts as empty; null or repeated ids keep their own results; other columns are ignored; an
    empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession)
    base = only(docs, doc_id="bigint", text="string").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    held = base.withColumn("base", base_spans(F.col("text")))
    rows = scratch.cut(held.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "base",
        F.when(F.size("base") > 0, _contexts(F.col("text"), F.col("base"), window)).alias("near"),
        F.when(F.size("base") > 0, F.array_distinct(F.transform("base", lambda x: _entity(F.col("text"), x)))).alias("entities"),
        (F.col("text") if keep_text else F.lit(None).cast("string")).alias("text")))
    near = rows.where("near IS NOT NULL").select("row", F.inline("near"))
    n_docs = rows.count()
    pairs = near.select("row", "entity", "term").distinct().groupBy("entity", "term").agg(F.count(F.lit(1)).alias("df_both"))
    entities = rows.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("df_entity"))
    terms = base.select(F.explode(F.array_distinct(words(F.col("text")))).alias("term")).groupBy("term").agg(
        F.count(F.lit(1)).alias("df_term"))
    log_n = F.log(F.lit(float(max(n_docs, 1))))
    share = (log_n + F.log("df_both") - F.log("df_entity") - F.log("df_term")) / F.nullif(log_n - F.log("df_entity"), F.lit(0.0))
    telling = scratch.cut(pairs.join(terms, "term").join(entities, "entity").select("entity", "term", share.alias("share"))
                          .where(F.col("share") >= general))
    marks = near.join(telling, ["entity", "term"]).groupBy("row", "start", "end").agg(F.max("share").alias("share"))
    marks = marks.groupBy("row").agg(F.collect_list(F.struct(
        "start", "end", F.when(F.col("share") >= remove, "remove").otherwise("general").alias("kind"))).alias("marks"))
    out = rows.join(marks, "row", "left")
    found = ordered(F.concat("base", F.coalesce("marks", no_spans())), list(KINDS))
    return out.select("doc_id", found.alias("found"), *(["text"] if keep_text else []))


def sanitise(docs: DataFrame, **options) -> DataFrame:
    """doc_id and the text with protected spans replaced by their kind, general terms by a mark, removed terms gone.

    Of overlapping spans the one that starts first is applied.
    """
    found = find_personal(docs, keep_text=True, **options)
    text = F.col("text")

    def put(acc, x):
        gap = F.substring(text, acc["at"].cast("int") + 1, (x["start"] - acc["at"]).cast("int"))
        mark = F.when(x["kind"] == "remove", "").otherwise(F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]")))
        return F.when(x["start"] < acc["at"], acc).otherwise(
            F.struct(x["end"].alias("at"), F.concat(acc["out"], gap, mark).alias("out")))

    done = F.aggregate("found", F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out")), put)
    return found.select("doc_id", done.alias("done"), "text").select(
        "doc_id", F.concat("done.out", F.expr("substring(text, cast(done.at AS int) + 1)")).alias("text"))


def personal_digests(docs: DataFrame, **options) -> DataFrame:
    """doc_id, counts of the base kinds, the digest of the base spans, and all spans as text."""
    found = find_personal(docs, **options)
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    base = F.filter("found", lambda x: x["kind"].isin(*BASE))
    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(listed(base), 256).alias("base_sha256"),
                        listed(F.col("found")).alias("spans"))
