"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from netspark import queries
from netspark.session import local_session

HEADLINE = (
    "transition_network", "transition_windows_sliding", "cooccurrence", "edge_list", "strength_all", "diffusion", "constraint", "transitivity_local",
    "select_mutual", "cluster_between_mean", "cluster_quality", "modularity_directed", "layer_similarity", "aggregate_layers_mean", "disparity_filter",
    "compare_partitions", "components", "distances_hops", "betweenness", "pagerank", "components_copurchase", "bootstrap_edges",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), "8g")
    spark.sparkContext.setLogLevel("ERROR")
    queries.QUERIES["transition_network"](spark, sf_dir).collect()  # starts the JVM's compilers
    took = {}
    for name in HEADLINE:
        began = time.time()
        queries.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
