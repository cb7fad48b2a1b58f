"""Time the headline queries: one JSON line with seconds per query (result fully computed, rows discarded)."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))
from loomset.plans.queries import QUERIES  # noqa: E402

HEADLINE = (
    "ora_basic", "ora_background", "ora_collection_prefix", "pair_ora", "pair_ora_with_edges", "edges_within_sets",
    "edge_evidence", "edge_overlay", "edge_summary", "gsea_observed_es", "gsea_full", "ranking_positions", "bh_adjust",
    "dag_ancestors", "true_path_propagation", "identical_set_merge", "set_similarity_links", "name_best_hit",
    "integrated_sets", "related_components", "alias_resolve", "subgraph_nodes", "set_distances", "hierarchy_links",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus)
             .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g")).config("spark.ui.enabled", "false")
             .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/lineitem.parquet").count()
    only = sys.argv[1:]
    times = {}
    for name in HEADLINE:
        if only and name not in only:
            continue
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total seconds over headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": Path(folder).name.removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
