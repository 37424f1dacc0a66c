"""Small graphs with known answers."""

from arcfold.graph import Graph

# The graphs that goldens are stated for.
E7 = [(1, 2, 12), (1, 3, 13), (2, 3, 23), (3, 4, 34), (3, 5, 35), (4, 5, 45), (5, 1, 51)]
CHAIN = [(i, i + 1, 1.0) for i in range(9)]
TWO_CHAINS = [(i, i + 1, 1) for i in [*range(9), *range(10, 20)]]
LCC7 = [(0, 1), (0, 2), (2, 1), (2, 3), (3, 1), (3, 4), (5, 3)]
RATINGS20_HEAD = [(1, 1, 1.0), (1, 2, 2.0), (2, 1, 3.0), (2, 2, 4.0)]


def edges(spark, rows, value="long"):
    return spark.createDataFrame([(a, b, *(r or [0])) for a, b, *r in rows], f"src long, dst long, value {value}")


def ll5(spark):
    return Graph(spark.createDataFrame([(i, i) for i in range(1, 6)], "id long, value long"), edges(spark, E7))


def graph(spark, rows, value="double"):
    return Graph.from_edges(edges(spark, [(a, b, *map(float if value == "double" else int, r)) for a, b, *r in rows], value))


def both(rows):
    return [*rows, *((b, a, *r) for a, b, *r in rows)]


def pairs(df, *names):
    return {r[names[0] if names else "id"]: r[names[1] if names else "value"] for r in df.collect()}
