"""One query per operator over the whole intended table, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import contamination, exact, language, licences, manifest, mixing, personal, quality, repeats, secrets, sharding, similar, sqltext, tokens
from .base import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return add


@query("op10_exact_dedup", r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept,
       sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)""")
def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(table(spark, sf_dir, "documents"))


# The letters of the keywords in either case, spelled out.
_ASSIGN = (r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|"""
           r"""[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_SECRETS = [("assign", _ASSIGN, "length(regexp_extract({m}, '" + _ASSIGN.replace("'", "''") + "', 2)) >= 6"),
            ("access", "AKIA[A-Z0-9]+", "length({m}) >= 20"), ("hex", "[0-9a-f]{24,}", "true"),
            *[(r.kind, r.pattern, "true") for r in secrets.RULES[3:]]]
_SECRET_PIECES = ", ".join(sqltext.pieces(k, p) for k, p, _ in _SECRETS)
_SECRET_LISTS = ", ".join(f"{sqltext.span_list(k, i, keep)} AS {k}_list" for i, (k, _, keep) in enumerate(_SECRETS))


@query("op2_secret_scan", f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), p AS (SELECT doc_id, {_SECRET_PIECES} FROM d),
f AS (SELECT doc_id, {_SECRET_LISTS} FROM p)
SELECT doc_id, len(assign_list) AS n_assign, len(access_list) AS n_access, len(hex_list) AS n_hex,
       sha256({sqltext.joined("list_concat(assign_list, list_concat(access_list, hex_list))")}) AS base_sha256,
       {sqltext.joined("flatten([" + ", ".join(f"{k}_list" for k, _, _ in _SECRETS) + "])")} AS spans
FROM f""")
def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digests(table(spark, sf_dir, "documents"))


_PERSONAL = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
             ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
              r"regexp_matches({m}, '^0*([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(\.0*([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])){3}$')"),
             ("card", r"[0-9]([\x20-]?[0-9])+", "length(regexp_replace({m}, '[^0-9]', '', 'g')) BETWEEN 12 AND 19 AND "
              "list_sum(list_transform(range(1, length(regexp_replace({m}, '[^0-9]', '', 'g')) + 1), lambda j: "
              "CASE WHEN j % 2 = 1 THEN reverse(regexp_replace({m}, '[^0-9]', '', 'g'))[j]::INT "
              "ELSE [0, 2, 4, 6, 8, 1, 3, 5, 7, 9][reverse(regexp_replace({m}, '[^0-9]', '', 'g'))[j]::INT + 1] END)) % 10 = 0"),
             ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "length(regexp_replace({m}, '[^0-9]', '', 'g')) BETWEEN 9 AND 15")]
_PERSONAL_PIECES = ", ".join(sqltext.pieces(k, p) for k, p, _ in _PERSONAL)
_PERSONAL_LISTS = ", ".join(f"{sqltext.span_list(k, i, keep)} AS {k}_list" for i, (k, _, keep) in enumerate(_PERSONAL))
_AROUND = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("op7_personal_data", f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), p AS (SELECT doc_id, t, {_PERSONAL_PIECES} FROM d),
f AS MATERIALIZED (SELECT doc_id, t, {_PERSONAL_LISTS} FROM p),
b AS MATERIALIZED (SELECT doc_id, t, list_concat(list_concat(email_list, ip_list), list_concat(card_list, phone_list)) AS base FROM f),
x AS (SELECT doc_id, t, base, unnest(base) AS q FROM b),
y AS (SELECT doc_id, base, q.k || ':' || lower(substr(t, q.s + 1, q.e - q.s)) AS entity, q.s AS s, q.e AS e,
      greatest(0, q.s - 80) AS low, substr(t, greatest(0, q.s - 80) + 1, q.s - greatest(0, q.s - 80)) AS before_text,
      substr(t, q.e + 1, 80) AS after_text FROM x),
z AS (SELECT *, {sqltext.pieces("bw", _AROUND, "before_text")}, {sqltext.pieces("aw", _AROUND, "after_text")} FROM y),
v AS (SELECT *, {sqltext.span_list("bw", 0)} AS bl, {sqltext.span_list("aw", 0)} AS al FROM z),
n AS (SELECT doc_id, base, entity, unnest(list_concat(
        list_transform(list_filter(bl, lambda w: w.s > 0 OR low = 0), lambda w: {{'s': w.s + low, 'e': w.e + low, 'w': substr(before_text, w.s + 1, w.e - w.s)}}),
        list_transform(list_filter(al, lambda w: w.e < 80), lambda w: {{'s': w.s + v.e, 'e': w.e + v.e, 'w': substr(after_text, w.s + 1, w.e - w.s)}}))) AS m
      FROM v),
near AS MATERIALIZED (SELECT doc_id, entity, {_LOWER.format("m.w")} AS term, m.s AS s, m.e AS e FROM n
      WHERE m.e - m.s > 1 AND len(list_filter(base, lambda p: p.s < m.e AND m.s < p.e)) = 0),
total AS (SELECT count(*)::DOUBLE AS n FROM d),
pairs AS (SELECT entity, term, count(DISTINCT doc_id) AS df_both FROM near GROUP BY ALL),
entities AS (SELECT entity, count(DISTINCT doc_id) AS df_entity FROM y GROUP BY ALL),
terms AS (SELECT term, count(*) AS df_term FROM (SELECT DISTINCT doc_id,
          unnest(regexp_extract_all({_LOWER.format("t")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term FROM d) GROUP BY ALL),
telling AS (SELECT entity, term, (ln(n) + ln(df_both) - ln(df_entity) - ln(df_term)) / nullif(ln(n) - ln(df_entity), 0) AS share
            FROM pairs JOIN terms USING (term) JOIN entities USING (entity), total),
marks AS (SELECT doc_id, s, e, max(share) AS share FROM near JOIN telling USING (entity, term) WHERE share >= 0.85 GROUP BY ALL),
lists AS (SELECT doc_id, list(CASE WHEN share >= 0.95 THEN {{'s': s, 'r': 5, 'e': e, 'k': 'remove'}}
          ELSE {{'s': s, 'r': 4, 'e': e, 'k': 'general'}} END) AS marks FROM marks GROUP BY ALL)
SELECT f.doc_id, len(email_list) AS n_email, len(ip_list) AS n_ip, len(card_list) AS n_card, len(phone_list) AS n_phone,
       sha256({sqltext.joined("b.base")}) AS base_sha256,
       {sqltext.joined("list_concat(b.base, coalesce(marks, []))")} AS spans
FROM f JOIN b USING (doc_id) LEFT JOIN lists ON lists.doc_id = f.doc_id""")
def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.personal_digests(table(spark, sf_dir, "documents"))




_TEMPLATES = licences.BASE + licences.MORE + licences.SPDX
_LICENCE_WORDS = ", ".join(f"'{x}'" for x in sorted({x for t in _TEMPLATES for x in t.words}))
_PAD = max(len(t.words) for t in _TEMPLATES)


def _stands_sql(phrase: tuple[str, ...], offset: int) -> str:
    return " AND ".join(f"coalesce(w[s + {_PAD + 1 + offset + i}] = '{x}', false)" for i, x in enumerate(phrase))


def _shares_sql(t: licences.Template) -> str:
    """List of {s, share} for the starts (from 0) where what must stand does."""
    must = t.key or t.words
    at = next(i for i in range(len(t.words)) if t.words[i:i + len(must)] == must)
    share = " + ".join(f"coalesce(w[s + {_PAD + 1 + i}] = '{x}', false)::INT" for i, x in enumerate(t.words))
    return (f"list_transform(list_filter(range({-at}, n), lambda s: {_stands_sql(must, at)}), "
            f"lambda s: {{'s': s, 'share': ({share}) / {len(t.words)}}})")


def _t(i: int) -> str:
    return f"t{i}"


_BASE_PLACES = "flatten([" + ", ".join(f"list_transform({_t(i)}, lambda x: x.s)" for i in range(len(licences.BASE))) + "])"
_BASE_LABELS = ", ".join(f"CASE WHEN len({_t(i)}) > 0 THEN '{t.label}' END" for i, t in enumerate(licences.BASE))
_ALL_LABELS = ", ".join(f"CASE WHEN coalesce(list_max(list_transform({_t(i)}, lambda x: x.share)), 0) >= {licences.AT_LEAST} "
                        f"THEN '{t.label}' END" for i, t in enumerate(_TEMPLATES))
_SCORE = ", ".join(f"coalesce(list_max(list_transform({_t(i)}, lambda x: x.share)), 0.0::DOUBLE)" for i in range(len(_TEMPLATES)))


def _labels_sql(items: str) -> str:
    return f"array_to_string(list_sort(list_distinct(list_filter([{items}], lambda x: x IS NOT NULL))), ',')"


@query("op3_licence_scan", f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
           FROM documents),
m AS (SELECT doc_id, len(w) AS n, list_concat(list_transform(range({_PAD}), lambda i: NULL::VARCHAR),
        list_transform(w, lambda x: CASE WHEN list_contains([{_LICENCE_WORDS}], x) THEN x END)) AS w FROM d),
s AS (SELECT doc_id, n, {", ".join(f"{_shares_sql(t)} AS {_t(i)}" for i, t in enumerate(_TEMPLATES))} FROM m)
SELECT doc_id, n AS n_words, len({_BASE_PLACES}) AS n_base, list_min({_BASE_PLACES}) AS first_word,
       list_max({_BASE_PLACES}) AS last_word, {_labels_sql(_BASE_LABELS)} AS base_labels, {_labels_sql(_ALL_LABELS)} AS labels,
       greatest({_SCORE}) AS score
FROM s""")
def op3_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.licence_digests(table(spark, sf_dir, "documents"))


_LOW_WORDS = "regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + ", '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


@query("op5_decontamination", f"""
WITH d AS MATERIALIZED (SELECT doc_id, {_LOW_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_LOW_WORDS} AS w FROM benchmark),
win AS MATERIALIZED (SELECT DISTINCT item_id, least(10, len(w)) AS n,
        array_to_string(list_slice(w, s, s + least(10, len(w)) - 1), ' ') AS win
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS s FROM i WHERE len(w) > 0)),
p AS (SELECT doc_id, n, s, array_to_string(list_slice(w, s, s + n - 1), ' ') AS win
      FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM win))),
h AS MATERIALIZED (SELECT doc_id, s, n, item_id FROM p JOIN win USING (n, win)),
c AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS q FROM h) GROUP BY ALL),
t AS (SELECT doc_id, list_sort(list(DISTINCT item_id::VARCHAR)) AS items FROM h GROUP BY ALL)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, len(coalesce(items, [])) AS n_items,
       sha256(array_to_string(coalesce(items, []), ',')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)""")
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op1_language_id")
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.predict(docs, language.fit(docs))


@query("op9_token_ids")
def op9_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), literal=False)


@query("op6_near_duplicates")
def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar.near_duplicates(table(spark, sf_dir, "documents"))


@query("op4_source_mixing", f"""
WITH s AS (SELECT source, sum(length(coalesce(text, '')) + 1)::BIGINT AS size FROM documents GROUP BY ALL),
w AS (SELECT source, size, pow(size, {mixing.TEMPERATURE}) AS weight FROM s),
r AS (SELECT source, round((SELECT sum(size) FROM w) * weight / ((SELECT sum(weight) FROM w) * size), 9) AS rate FROM w),
k AS (SELECT source, rate, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 20)::BIGINT + 1)) AS k FROM r),
c AS (SELECT source, rate, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS below FROM k),
l AS (SELECT source, rate, list(below) AS cdf FROM c GROUP BY ALL),
d AS (SELECT doc_id, source, rate, len(list_filter(cdf, lambda x:
        ('0x' || substr(md5('{mixing.SEED}:' || doc_id::VARCHAR), 1, 13))::BIGINT / {float(1 << 52)} >= x)) AS n
      FROM documents JOIN l USING (source))
SELECT doc_id, source, copy, rate, md5('order:{mixing.SEED}:' || doc_id::VARCHAR || ':' || copy::VARCHAR) AS shuffle_key
FROM (SELECT doc_id, source, rate, unnest(range(1, n + 1)) AS copy FROM d)""")
def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_digests(table(spark, sf_dir, "documents"))


@query("op8_quality")
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


_RING = sharding.SHARDS * sharding.REPLICAS
_CUT = "9223372036854775807"


def _filled_sql(i: int) -> str:
    """One shard after the other: who fills the next one, when all before are full."""
    return f"""
p{i} AS MATERIALIZED (SELECT place, list_filter(walk, lambda s: place <= cuts[s + 1])[1] AS shard, cuts FROM k, c{i}),
f{i} AS MATERIALIZED (SELECT min(place) AS place, arg_min(shard, place) AS shard FROM
       (SELECT place, shard, cuts, count(*) OVER (PARTITION BY shard ORDER BY place) AS load FROM p{i}), total
       WHERE cuts[shard + 1] = {_CUT} AND load = n // {sharding.SHARDS} + (shard < n % {sharding.SHARDS})::INT),
c{i + 1} AS MATERIALIZED (SELECT list_transform(range(1, {sharding.SHARDS + 1}), lambda j: CASE WHEN j = shard + 1 THEN place ELSE cuts[j] END) AS cuts
       FROM c{i}, f{i}),"""


@query("op11_sharding", f"""
WITH {sqltext.CRC_TABLE},
v AS (SELECT i // {_RING // sharding.SHARDS} AS shard, md5('ring:' || (i // {_RING // sharding.SHARDS}) || ':' || (i % {_RING // sharding.SHARDS})) AS h
      FROM (SELECT unnest(range({_RING})) AS i)),
nodes AS MATERIALIZED (SELECT shard, ('0x' || substr(h, 1, 4))::INT // 4 AS cell, row_number() OVER (ORDER BY ('0x' || substr(h, 1, 4))::INT // 4, h) AS i FROM v),
circle AS MATERIALIZED (SELECT list(shard ORDER BY i) AS s, list(cell ORDER BY i) AS cells FROM nodes),
k AS MATERIALIZED (SELECT doc_id, t, row_number() OVER (ORDER BY substr(h, 5), doc_id) AS place, ahead,
        list_transform(range({sharding.SHARDS}), lambda x: x) AS none, ('0x' || substr(h, 1, 4))::INT // 4 AS cell,
        list_transform(list_sort(list_transform(range({sharding.SHARDS}), lambda x:
          list_position(list_concat(s[ahead + 1:], s[:ahead]), x) * {sharding.SHARDS} + x)), lambda y: y % {sharding.SHARDS}) AS walk
      FROM (SELECT doc_id, coalesce(text, '') AS t, md5('key:' || coalesce(doc_id::VARCHAR, '')) AS h, s,
              len(list_filter(cells, lambda c: c < ('0x' || substr(md5('key:' || coalesce(doc_id::VARCHAR, '')), 1, 4))::INT // 4)) AS ahead
            FROM documents, circle)),
total AS (SELECT count(*) AS n FROM k),
c0 AS (SELECT list_transform(range({sharding.SHARDS}), lambda j: {_CUT}) AS cuts), {"".join(_filled_sql(i) for i in range(sharding.SHARDS))}
out AS (SELECT doc_id, t, place, walk[1] AS home, list_filter(walk, lambda s: place <= cuts[s + 1])[1] AS shard FROM k, c{sharding.SHARDS})
SELECT doc_id, strlen(t) + 1 AS size, {sqltext.crc32("t")} AS text_crc32, 'rows' AS law, shard::INT AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY place) - 1 AS slot, NULL::INT AS grown_shard, home::INT AS home
FROM out, crc_table""")
def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_digests(table(spark, sf_dir, "documents"))


def _leaf_sql(n_chars: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(strlen({c}) || ':' || {c}, '-')" for c in
                                   ("doc_id::VARCHAR", "source", "lang", f"({n_chars})::VARCHAR", "text")) + ")"


def _tree_sql(name: str, leaves: str) -> str:
    return f"""{name}(tree, level, pos, n, h) AS (SELECT tree, 0, pos, n, h FROM {leaves} UNION ALL
    SELECT tree, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM {name} WHERE n > 1 GROUP BY tree, level, pos // 2, n)"""


def _steps_sql(leaves: str, key: str, nodes: str) -> str:
    """The sibling of each level, L or R before it, and N where there is none."""
    return f"""(SELECT a.{key}, list(CASE WHEN b.h IS NULL THEN 'N' WHEN b.pos % 2 = 0 THEN 'L' || b.h ELSE 'R' || b.h END ORDER BY x.level) AS steps
    FROM {leaves} a JOIN (SELECT DISTINCT tree, level FROM {nodes} WHERE n > 1) x USING (tree)
    LEFT JOIN {nodes} b ON b.tree = a.tree AND b.level = x.level AND b.pos = xor(a.pos >> x.level, 1) GROUP BY a.{key})"""


@query("op12_manifest", f"""
WITH RECURSIVE {sqltext.CRC_TABLE},
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce('+' || lang, '') AS tree, {_leaf_sql("n_chars")} AS h,
        CASE WHEN {sqltext.crc32("doc_id::VARCHAR")} % 7 = 0 THEN {_leaf_sql("n_chars + 1")} END AS claim FROM documents, crc_table),
l AS MATERIALIZED (SELECT r, doc_id, tree, h, claim, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS pos,
        count(*) OVER (PARTITION BY tree) AS n FROM d),
{_tree_sql("t", "l")}, nodes AS MATERIALIZED (SELECT * FROM t),
s AS MATERIALIZED (SELECT tree AS name, '' AS tree, h, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
{_tree_sql("u", "s")}, tops AS MATERIALIZED (SELECT * FROM u),
p AS {_steps_sql("l", "r", "nodes")}, q AS {_steps_sql("s", "name", "tops")},
w AS (SELECT doc_id, l.h AS leaf, s.h AS subroot, (SELECT h FROM tops WHERE n = 1) AS root, coalesce(claim, l.h) AS claim,
        list_concat(coalesce(p.steps, []), coalesce(q.steps, [])) AS steps
      FROM l JOIN s ON s.name = l.tree LEFT JOIN p ON p.r = l.r LEFT JOIN q ON q.name = l.tree),
f AS (SELECT *, list_reduce(list_concat([claim], steps), lambda a, x: sha256(CASE x[1] WHEN 'L' THEN x[2:] || a WHEN 'R' THEN a || x[2:] ELSE a END)) AS folded_root FROM w)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(list_filter(steps, lambda x: x <> 'N'), lambda x: x[2:]), '')) AS proof_sha256,
       folded_root, folded_root = root AS verified FROM f""")
def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.manifest_digests(table(spark, sf_dir, "documents"))


@query("op13_periodic_runs")
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.run_digests(table(spark, sf_dir, "documents"))
