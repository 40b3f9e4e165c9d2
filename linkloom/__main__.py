"""python -m linkloom GRAPH START TARGET: the shortest path in a graph stored as GRAPH/nodes and GRAPH/edges."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from linkloom.operators.search import show_path, shortest_paths


def main(argv: list[str]) -> int:
    if len(argv) != 3:
        print(__doc__, file=sys.stderr)
        return 2
    folder, start, target = argv
    spark = SparkSession.builder.appName("linkloom").getOrCreate()
    asked = spark.createDataFrame([(0, start, target)], "query_id long, start string, target string")
    paths = shortest_paths(spark.read.parquet(f"{folder}/nodes"), spark.read.parquet(f"{folder}/edges"), asked)
    print(show_path(paths).first()["line"])
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
