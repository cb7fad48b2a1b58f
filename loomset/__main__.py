"""Command line: python -m loomset ora|pairs|gsea|search|collections|stats|organisms RELEASE ORGANISM ...

``build RELEASE PLAN.json`` builds organisms; the plan maps each to its landed files (the fields of plans.build.Landed).
``legacy RELEASE ORGANISM PLAN.json`` replays the 2012 merge; the plan lists [source, gene file, pair file or null].
"""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from pyspark.sql import SparkSession

from .operators.ranked import read_order
from .plans import build
from .plans.service import Library
from .sources import delimited as D
from .sources import organisms, release


def landed(fields: dict) -> build.Landed:
    """Landed files from a plan; lists stand for tuples."""
    tuples = {k: tuple(map(tuple, v)) if k == "feeds" else tuple(v) for k, v in fields.items() if isinstance(v, list)}
    return build.Landed(**{**fields, **tuples})


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(prog="loomset")
    ap.add_argument("command", choices=["ora", "pairs", "gsea", "search", "collections", "stats", "organisms", "build", "legacy"])
    ap.add_argument("release", nargs="?", help="release folder")
    ap.add_argument("organism", nargs="?", help="key, name, taxon or KEGG code (build: the plan)")
    ap.add_argument("input", nargs="?", help="gene list, ranking file, search term or plan")
    ap.add_argument("--public", action="store_true", help="build: leave restricted sources out")
    ap.add_argument("--mode", choices=["guarded", "reviewed", "legacy"], default="guarded", help="build: how names are merged")
    ap.add_argument("--collections")
    ap.add_argument("--background")
    ap.add_argument("--tier", choices=["high", "medium", "low", "string"])
    ap.add_argument("--nperm", type=int, default=1000)
    ap.add_argument("--seed", type=int, default=0)
    ap.add_argument("--alpha", type=float, default=0.05)
    ap.add_argument("--top", type=int)
    ap.add_argument("--out", help="folder for the result table (default: print)")
    a = ap.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if a.command == "organisms":
        organisms.curated(spark).select("key", "name", "taxid", "kegg").show(1000, False)
        return
    if a.command == "build":
        plan = {k: landed(v) for k, v in json.loads(Path(a.organism).read_text()).items()}
        for key, status in build.build_many(spark, plan, a.release, mode=a.mode, public=a.public).items():
            print(key, status, sep="\t")
        return
    if a.command == "legacy":
        merged = build.rebuild_archive(spark, [tuple(x) for x in json.loads(Path(a.input).read_text())], a.organism)
        pair = merged.set_pair if merged.set_pair is not None else spark.createDataFrame([], release.RELEASE["set_pair"])
        release.write_text(merged.gset, merged.set_member, merged.set_gene, pair, None, a.release)
        return
    lib = Library(spark, a.release, organisms.get(spark, a.organism).key)
    cols = a.collections.split(",") if a.collections else None
    # one more than a request may hold, so that a longer list is refused
    names = lambda path: [r["ident"] for r in D.gene_list(spark, path).orderBy("pos").limit(60_001).collect()]
    if a.command == "ora":
        out = lib.ora(names(a.input), names(a.background) if a.background else None, cols, alpha=a.alpha)["results"]
    elif a.command == "pairs":
        out = lib.pairs(names(a.input), tuple(cols or ("pathway",)), a.tier)["results"]
    elif a.command == "gsea":
        rows = read_order(D.ranking(spark, a.input), keep="last").orderBy("input_pos").limit(60_001).collect()
        out = lib.gsea([(r["gene"], r["score"]) for r in rows], cols, nperm=a.nperm, seed=a.seed, alpha=a.alpha)["results"]
    elif a.command == "search":
        out = lib.search(a.input)
    elif a.command == "stats":
        out = lib.stats()
    else:
        out = lib.collections()
    text = release.report_text(out if not a.top else out.limit(a.top))
    if a.out:
        release.write_table(text, a.out)
    elif text.isEmpty():
        print("# no results")
    else:
        print("\t".join(text.columns))
        for row in text.toLocalIterator():
            print("\t".join("" if v is None else v for v in row))


if __name__ == "__main__":
    main()
