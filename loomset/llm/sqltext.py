"""Pieces of DuckDB SQL that several oracles share."""


def pieces(kind: str, pattern: str, text: str = "t") -> str:
    """Select items: the matches of a pattern and the lengths of the pieces between them."""
    p = pattern.replace("'", "''")
    return (f"regexp_extract_all({text}, '{p}') AS {kind}_m, "
            f"list_transform(string_split_regex({text}, '{p}'), lambda x: length(x)) AS {kind}_p")


def span_list(kind: str, rank: int, keep: str = "true") -> str:
    """List of {s, r, e, k} from the columns of ``pieces``; ``keep`` is a condition on the match ``{m}``."""
    start = (f"(list_sum(list_slice({kind}_p, 1, i))"
             f" + coalesce(list_sum(list_transform(list_slice({kind}_m, 1, i - 1), lambda x: length(x))), 0))::BIGINT")
    return (f"list_transform(list_filter(list_transform(range(1, len({kind}_m) + 1), lambda i: "
            f"{{'s': {start}, 'm': {kind}_m[i]}}), lambda q: {keep.replace('{m}', 'q.m')}), lambda q: "
            f"{{'s': q.s, 'r': {rank}, 'e': q.s + length(q.m), 'k': '{kind}'}})")


def joined(spans: str) -> str:
    return (f"array_to_string(list_transform(list_sort({spans}), "
            f"lambda x: x.k || ':' || x.s::VARCHAR || ':' || x.e::VARCHAR), ',')")


# The reflected CRC-32 table, from its polynomial.
CRC_TABLE = """crc_table AS MATERIALIZED (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
       lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS crc)"""


def crc32(text: str) -> str:
    """Unsigned CRC-32 of the UTF-8 bytes; needs ``crc_table`` in the FROM clause."""
    return (f"xor(4294967295, list_reduce(list_concat([4294967295], list_transform(regexp_extract_all(hex(encode({text})), '..'), "
            "lambda b: ('0x' || b)::BIGINT)), lambda c, b: xor(c // 256, crc[xor(c, b) % 256 + 1])))")
