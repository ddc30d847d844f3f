"""Command line: ``python -m weftline generate|sssp|pagerank|isomorphism|sort ...``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from weftline.operators import generators, graph, isomorphism, ordering, pagerank, paths
from weftline.sources import text


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="weftline")
    commands = parser.add_subparsers(dest="command", required=True)
    p = commands.add_parser("generate", help="a random connected undirected graph as an adjacency file")
    p.add_argument("vertices", type=int)
    p.add_argument("edges", type=int, nargs="?")
    p.add_argument("--source", type=int, default=1)
    p.add_argument("--out", required=True)
    p = commands.add_parser("sssp", help="distances from the source of an adjacency file, or from a vertex of an edge list")
    p.add_argument("path")
    p.add_argument("--source", type=int)
    p.add_argument("--edge-list", action="store_true")
    p.add_argument("--out", required=True)
    p = commands.add_parser("pagerank", help="ranks of a random directed graph, or of an edge list")
    p.add_argument("--vertices", type=int)
    p.add_argument("--edges", type=int)
    p.add_argument("--path")
    p.add_argument("--out", required=True)
    p = commands.add_parser("isomorphism", help="whether the complete pair, or the skewed pair, of n vertices is isomorphic")
    p.add_argument("n", type=int)
    p.add_argument("--skew", action="store_true")
    p = commands.add_parser("sort", help="n random integers in order")
    p.add_argument("n", type=int)
    p.add_argument("--out", required=True)
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("weftline").getOrCreate()
    if args.command == "generate":
        edges = generators.undirected(spark, args.vertices, args.edges)
        text.write_adjacency(edges, args.vertices, args.source, args.out)
    elif args.command == "sssp":
        if args.edge_list:
            edges, source = text.read_edge_list(spark, args.path).edges, args.source
            every = None
        else:
            found = text.read_adjacency(spark, args.path)
            edges, source = found.edges, args.source or found.source
            every = spark.range(1, found.vertices + 1).toDF("v")
        text.write_distances(paths.sssp(graph.dedup_edges(edges), source, within=every), args.out)
    elif args.command == "pagerank":
        edges = text.read_edge_list(spark, args.path).edges if args.path else generators.directed(spark, args.vertices, args.edges)
        run = pagerank.pagerank(edges)
        text.write_ranks(run.ranks, run.steps, args.out)
    elif args.command == "isomorphism":
        made = generators.skew_pair(spark, args.n) if args.skew else generators.complete_pair(spark, args.n)
        found = isomorphism.is_isomorphic(made.withColumn("pair", F.lit("pair"))).first()
        print("Isomorphic" if found.isomorphic else "Not Isomorphic")
    else:
        text.write_array(ordering.sort_global(generators.array(spark, args.n), "value", "pos"), "value", args.out)


if __name__ == "__main__":
    main()
