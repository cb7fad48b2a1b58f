"""Licence scan over a positional index of licence words (DataFrame functions only)."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import Scratch, only, words


@dataclass(frozen=True)
class Template:
    """Consecutive words; ``key`` is the part that must stand whole, without one all of it."""
    name: str
    label: str
    words: tuple[str, ...]
    key: tuple[str, ...] = ()


def _template(name: str, label: str, text: str, key: str = "") -> Template:
    return Template(name, label, tuple(text.split()), tuple(key.split()))


# The three base phrases, then longer notices recognised from ``AT_LEAST`` of their words on.
BASE = (_template("cc-by", "cc-by", "cc by"), _template("gpl", "gpl", "general public license"),
        _template("reserved", "reserved", "all rights reserved"))
MORE = (
    _template("apache", "apache-2.0", "licensed under the apache license version 2 0", "apache license"),
    _template("mit", "mit", "permission is hereby granted free of charge to any person obtaining a copy", "hereby granted"),
    _template("bsd", "bsd", "redistribution and use in source and binary forms with or without modification are permitted",
              "binary forms"),
    _template("mpl", "mpl", "subject to the terms of the mozilla public license", "mozilla public license"),
    _template("as-is", "no-warranty", "the software is provided as is without warranty of any kind", "without warranty"),
)
AT_LEAST = 0.7
SPDX = (_template("spdx", "spdx", "spdx license identifier"),)


def _is(x: Column, pos: Column, word: str) -> Column:
    return F.coalesce((x["pos"] == pos) & (x["word"] == word), F.lit(False))


def _matcher(pos: Column, word: str):
    return lambda y: _is(y, pos, word)


def _stands(x: Column, j: Column, anchor: int, phrase: tuple[str, ...]) -> Column:
    """Whether the phrase stands around hit ``x``, number ``j`` of the index, which is its word number ``anchor``.

    Words of a phrase are neighbours in the text, so their postings are neighbours in the index.
    """
    return reduce(lambda a, b: a & b, [_is(F.get("hits", j + (i - anchor)), x["pos"] + (i - anchor), w)
                                       for i, w in enumerate(phrase)])


def word_index(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """doc_id, n_words, and ``hits``: (pos, word) of every word of the vocabulary."""
    base = only(docs, doc_id="bigint", text="string").select("doc_id", words(F.col("text")).alias("w"))

    def hit(x, i):
        return F.when(x.isin(*vocabulary), F.struct(i.cast("bigint").alias("pos"), x.alias("word")))

    return base.select("doc_id", F.size("w").cast("bigint").alias("n_words"),
                       F.filter(F.transform("w", hit), lambda x: x.isNotNull()).alias("hits"))


def scan_licences(docs: DataFrame, templates: tuple[Template, ...] = BASE + MORE + SPDX) -> DataFrame:
    """One row per input row: doc_id, n_words, ``places`` of exact phrases (start, name, label), ``labels``, ``score``.

    One pass over the texts leaves a positional index: the licence words of each text with their positions. Document
    frequencies of these words over all texts give their rarity. Each template is looked up by the
    rarest word that it must have (of its key phrase, or of all): every
    occurrence proposes a start by relative position, the other words' postings are intersected at their offsets. A base
    phrase counts where all its words stand; a longer notice counts where its key phrase stands and at least 70 % of
    its words are at their places. ``score`` is the best share of words in place, 1 for a whole phrase, 0 for none.

    The vocabulary is a few dozen fixed words, so nothing here grows but the index, and no texts are shuffled. Word
    positions start at 0. A null text has no words; null or repeated ids and repeated rows keep their own results; other
    columns are ignored; an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession)
    vocabulary = sorted({w for t in templates for w in t.words})
    index = scratch.cut(word_index(docs, vocabulary))
    held = index.select(F.explode(F.array_distinct(F.transform("hits", lambda x: x["word"]))).alias("word"))
    df = {r["word"]: r["count"] for r in held.groupBy("word").count().collect()}  # at most one row per licence word
    exact, partial = [], []
    for t in templates:
        must = t.key or t.words
        at = next(i for i in range(len(t.words)) if t.words[i:i + len(must)] == must)
        rarest = min(range(len(must)), key=lambda i: (df.get(must[i], 0), i))

        def place(x, j):
            start, n = x["pos"] - (at + rarest), len(t.words)
            around = F.slice("hits", F.greatest(j - n + 2, F.lit(1)), F.lit(2 * n))
            share = reduce(lambda a, b: a + b, [F.exists(around, _matcher(start + i, w)).cast("int")
                                                for i, w in enumerate(t.words)]) / len(t.words)
            proposed = (x["word"] == must[rarest]) & _stands(x, j, rarest, must)
            return F.when(proposed, F.struct(start.alias("start"), share.alias("share")))

        found = F.filter(F.transform("hits", place), lambda x: x.isNotNull())
        if not t.key:
            whole = F.filter(found, lambda x: x["share"] == 1.0)
            exact.append(F.transform(whole, lambda x: F.struct(
                x["start"].alias("start"), F.lit(t.name).alias("name"), F.lit(t.label).alias("label"))))
        best = F.coalesce(F.array_max(F.transform(found, lambda x: x["share"])), F.lit(0.0))
        partial.append(F.struct(best.alias("score"), F.lit(t.label).alias("label")))
    places = F.array_sort(F.concat(F.array().cast("array<struct<start:bigint,name:string,label:string>>"), *exact))
    partial = F.array(*partial) if partial else F.array().cast("array<struct<score:double,label:string>>")
    enough = F.transform(F.filter("best", lambda x: x["score"] >= AT_LEAST), lambda x: x["label"])
    none = F.size("hits") == 0
    shaped = index.select("doc_id", "n_words",
                          F.when(none, F.array().cast("array<struct<start:bigint,name:string,label:string>>")).otherwise(places).alias("places"),
                          F.when(none, F.array().cast("array<struct<score:double,label:string>>")).otherwise(partial).alias("best"))
    return shaped.select("doc_id", "n_words", "places", F.array_sort(F.array_distinct(enough)).alias("labels"),
                         F.coalesce(F.array_max(F.transform("best", lambda x: x["score"])), F.lit(0.0)).alias("score"))


def licence_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    found = scan_licences(docs)
    names = [t.name for t in BASE]
    base = F.filter("places", lambda x: x["name"].isin(*names))
    labels = F.array_sort(F.array_distinct(F.transform(base, lambda x: x["label"])))
    return found.select("doc_id", "n_words", F.size(base).cast("bigint").alias("n_base"),
                        F.array_min(F.transform(base, lambda x: x["start"])).alias("first_word"),
                        F.array_max(F.transform(base, lambda x: x["start"])).alias("last_word"),
                        F.array_join(labels, ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score")
