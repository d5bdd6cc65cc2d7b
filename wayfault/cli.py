"""Command line: run a registered query over a folder of tables, or a flow over a folder of network tables.

    python -m wayfault.cli query a2_outage_hours /data/sf1 --out /data/hours
    python -m wayfault.cli flow redundancy /data/network --out /data/redundancy
"""

from __future__ import annotations

import argparse
import time
from contextlib import contextmanager

from pyspark.sql import SparkSession

from wayfault.operators.scratch import scope
from wayfault.plans import catalogue, pipelines, registry  # noqa: F401
from wayfault.session import session
from wayfault.sources.sinks import write_layers

FLOWS = ("network", "redundancy", "flood", "centrality")


@contextmanager
def timer(what: str):
    began = time.perf_counter()
    yield
    print(f"{what}: {time.perf_counter() - began:.2f} s")


def layers(spark: SparkSession, flow: str, folder: str) -> dict:
    """Output layers of a flow over ``ways``, ``nodes`` and, for floods, ``floodplains``."""
    net = pipelines.base_network(spark.read.parquet(f"{folder}/ways"), spark.read.parquet(f"{folder}/nodes"))
    if flow == "network":
        return {"nodes": net.nodes, "base_edges": net.base, "edges": net.edges}
    if flow == "redundancy":
        return {"roadways": net.edges, "detours_info": pipelines.redundancy(net)}
    if flow == "flood":
        from wayfault.sources.readers import floodplains

        return {"flood_impact": pipelines.flood_impact(net, floodplains(spark.read.parquet(f"{folder}/floodplains")))}
    nodes, edges = pipelines.network_centrality(net)
    return {"node_centrality": nodes, "edge_centrality": edges}


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="wayfault")
    kinds = parser.add_subparsers(dest="kind", required=True)
    for kind, choices in (("query", sorted(registry.QUERIES)), ("flow", FLOWS)):
        p = kinds.add_parser(kind)
        p.add_argument("name", choices=choices)
        p.add_argument("folder")
        p.add_argument("--out", help="folder for Parquet; without it the first rows are shown")
    args = parser.parse_args(argv)
    spark = session("wayfault")
    with timer(args.name), scope(spark):
        made = {args.name: registry.QUERIES[args.name](spark, args.folder)} if args.kind == "query" else layers(spark, args.name, args.folder)
        if args.out:
            write_layers(made, args.out)
        else:
            for df in made.values():
                df.show()


if __name__ == "__main__":
    main()
