"""python -m arcfold import ... | predict ..."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from arcfold.operators.factorization import svdpp_predict
from arcfold.sources import text


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="arcfold")
    sub = p.add_subparsers(dest="command", required=True)
    i = sub.add_parser("import", help="text files to Parquet tables")
    i.add_argument("-vf", "--vertices-file")
    i.add_argument("-ef", "--edges-file")
    i.add_argument("-rf", "--ratings-file", help="lines of user, item and rating in place of edges")
    i.add_argument("-vt", "--vertices-table")
    i.add_argument("-et", "--edges-table", required=True)
    i.add_argument("-p", "--preset", choices=sorted(text.PRESETS), help="the types of ids and values")
    i.add_argument("-k", "--id-parser", default="long")
    i.add_argument("-vp", "-vs", "--vertex-parser", default="long")
    i.add_argument("-ep", "-es", "--edge-parser", default="long")
    i.add_argument("-np", "--partitions", type=int, default=50)
    s = sub.add_parser("predict", help="a rating by SVD++ tables")
    for name in ("--users", "--items"):
        s.add_argument(name, required=True)
    s.add_argument("--user", type=int, required=True)
    s.add_argument("--item", type=int, required=True)
    s.add_argument("--mean", type=float, required=True)
    a = p.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    if a.command == "import":
        if bool(a.edges_file) == bool(a.ratings_file):
            p.error("either --edges-file or --ratings-file is needed")
        ids, own = text.preset(a.preset) if a.preset else (a.id_parser, None)
        if a.vertices_file:
            vertices = text.read_vertices(spark, a.vertices_file, ids, own or a.vertex_parser)
            vertices.repartition(a.partitions, "id").write.parquet(a.vertices_table)
        edges = text.read_ratings(spark, a.ratings_file) if a.ratings_file else text.read_edges(spark, a.edges_file, ids, own or a.edge_parser)
        edges.repartition(a.partitions, "src").write.parquet(a.edges_table)
    else:
        pair = spark.createDataFrame([(a.user, a.item)], "user long, item long")
        row = svdpp_predict(pair, spark.read.parquet(a.users), spark.read.parquet(a.items), a.mean).first()
        print(row["prediction"] if row else "unknown user or item")


if __name__ == "__main__":
    main()
