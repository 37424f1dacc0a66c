"""Counts, reversed edges, triangles, clustering coefficients and similarities: closed forms over joins of edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcfold.graph import Graph

#: What a distance is where a similarity of 0 has none.
FARTHEST = 1.7976931348623157e308


def vertex_count(graph: Graph) -> DataFrame:
    return graph.vertices.agg(F.count("*").alias("count"))


def edge_count(graph: Graph) -> DataFrame:
    return graph.edges.agg(F.count("*").alias("count"))


def reverse_edges(graph: Graph) -> Graph:
    """Every edge in both directions; an edge that is there keeps its value."""
    back = graph.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "value")
    new = back.join(graph.edges.select("src", "dst"), ["src", "dst"], "left_anti")
    return Graph(graph.vertices, graph.edges.select("src", "dst", "value").unionByName(new.select("src", "dst", "value")))


def _oriented(u: DataFrame) -> DataFrame:
    """(p, q, nq, ...): undirected edges (a, b, ...) from the end of lower degree to the other."""
    deg = u.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    x = u.join(deg.toDF("a", "na"), "a").join(deg.toDF("b", "nb"), "b")
    up = F.struct("na", "a") < F.struct("nb", "b")
    pick = lambda c, d: F.when(up, F.col(c)).otherwise(F.col(d))
    rest = [c for c in u.columns if c not in ("a", "b")]
    return x.select(pick("a", "b").alias("p"), pick("b", "a").alias("q"), pick("nb", "na").alias("nq"), *rest)


def _corners(u: DataFrame) -> DataFrame:
    """(i, p, q, pq, iq, ip): each triangle of undirected edges (a, b, k) once, with the k of the edge that lies
    opposite to each corner. Wedges start at the corner of lowest degree, so they stay few around hubs."""
    d = _oriented(u)
    w = d.alias("x").join(d.alias("y"), (F.col("x.p") == F.col("y.p")) & (F.struct("x.nq", "x.q") < F.struct("y.nq", "y.q")))
    w = w.select(F.col("x.p").alias("i"), F.col("x.q").alias("p"), F.col("y.q").alias("q"), F.col("x.k").alias("ip"), F.col("y.k").alias("iq"))
    return w.join(d.select("p", "q", F.col("k").alias("pq")), ["p", "q"])


def _ways(e: DataFrame) -> DataFrame:
    """(a, b, k) of edges (src, dst), a < b: k is 1 where a leads to b, 2 where b leads to a, 3 where both do."""
    way = F.when(F.col("src") < F.col("dst"), F.lit(1)).otherwise(F.lit(2))
    return e.where("src <> dst").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.bit_or(way).alias("k"))


def _leads(x: str, y: str, k: str) -> Column:
    """Whether x leads to y, by the k of their edge."""
    return F.col(k).bitwiseAND(F.when(F.col(x) < F.col(y), F.lit(1)).otherwise(F.lit(2))) > 0


def _thirds(e: DataFrame) -> DataFrame:
    """(a, b, z, ab, za, zb): every corner z of every triangle of edges (src, dst) beside the pair a < b of the other two,
    with the k of their edges. An edge's ends share what closes a triangle with it, so wedges start at low degrees and
    each triangle is found once, not once for each of its edges."""
    t = _corners(_ways(e))
    third = lambda x, y, z, xy, zx, zy: F.struct(*(F.col(c).alias(n) for c, n in zip((x, y, z, xy, zx, zy), ("x", "y", "z", "ab", "zx", "zy"), strict=True)))
    rows = t.select(F.explode(F.array(
        third("p", "q", "i", "pq", "ip", "iq"), third("i", "q", "p", "iq", "ip", "pq"), third("i", "p", "q", "ip", "iq", "pq"),
    )).alias("t")).select("t.*")
    up = F.col("x") < F.col("y")
    pick = lambda c, d: F.when(up, F.col(c)).otherwise(F.col(d))
    return rows.select(pick("x", "y").alias("a"), pick("y", "x").alias("b"), "z", "ab", pick("zx", "zy").alias("za"), pick("zy", "zx").alias("zb"))


def clustering_coefficient(graph: Graph) -> DataFrame:
    """(id, value): of the ordered pairs of a vertex's neighbours (either way), the share that an edge joins; 0 with
    fewer than two. A self-loop makes a vertex its own neighbour."""
    e = graph.edges.select("src", "dst").distinct()
    loops = e.where("src = dst").select(F.col("src").alias("id"))
    u = e.where("src <> dst").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.count("*").alias("k"))
    ends = u.select(F.explode(F.array(
        F.struct(F.col("a").alias("id"), F.col("b").alias("nbr"), "k"),
        F.struct(F.col("b").alias("id"), F.col("a").alias("nbr"), "k"),
    )).alias("e")).select("e.*")
    n = ends.select("id").unionByName(loops).groupBy("id").agg(F.count("*").alias("n"))
    share = lambda i, k: F.struct(F.col(i).alias("id"), F.col(k).alias("m"))
    m = _corners(u).select(F.explode(F.array(share("i", "pq"), share("p", "iq"), share("q", "ip"))).alias("s")).select("s.*")
    # A neighbour's self-loop joins it to itself; with one of its own, a vertex is an end of all its edges' pairs.
    m = m.unionByName(ends.join(loops.toDF("nbr"), "nbr", "left_semi").select("id", F.lit(1).cast("long").alias("m")))
    m = m.unionByName(ends.join(loops, "id", "left_semi").select("id", F.col("k").alias("m"))).unionByName(loops.withColumn("m", F.lit(1).cast("long")))
    m = m.groupBy("id").agg(F.sum("m").alias("m"))
    out = graph.vertices.select("id").join(n, "id", "left").join(m, "id", "left")
    value = F.coalesce("m", F.lit(0)) / F.col("n") / (F.col("n") - 1)
    return out.select("id", F.when(F.coalesce("n", F.lit(0)) < 2, F.lit(0.0)).otherwise(value).alias("value"))


def jaccard(graph: Graph, *, distance: bool = False) -> DataFrame:
    """(src, dst, value) of every edge: the Jaccard index of both ends' out-neighbours where the edge exists both ways,
    else its own value; as a distance 1 / index - 1."""
    e = graph.edges.select("src", "dst")
    n = e.groupBy("src").agg(F.count("*").alias("n"), F.max((F.col("src") == F.col("dst")).cast("int")).alias("loop"))
    shared = _thirds(e).where((F.col("ab") == 3) & _leads("a", "z", "za") & _leads("b", "z", "zb"))
    shared = shared.groupBy("a", "b").agg(F.count("*").alias("i"))
    own = F.struct("value")
    pairs = graph.edges.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(
        F.first(F.when(F.col("src") <= F.col("dst"), own), True).alias("there"), F.first(F.when(F.col("src") >= F.col("dst"), own), True).alias("back"),
    )
    pairs = pairs.join(shared, ["a", "b"], "left").join(n.toDF("a", "n1", "loop1"), "a", "left").join(n.toDF("b", "n2", "loop2"), "b", "left")
    # A self-loop makes an end of the pair a neighbour of both; a vertex shares all it has with itself.
    i = F.when(F.col("a") == F.col("b"), F.col("n1")).otherwise(F.coalesce("i", F.lit(0)) + F.col("loop1") + F.col("loop2")).cast("double")
    index = i / (F.col("n1") + F.col("n2") - i)
    if distance:
        index = F.when(index == 0, F.lit(FARTHEST)).otherwise(F.lit(1.0) / index - 1)
    pairs = pairs.select("a", "b", "there", "back", F.when(F.col("there").isNotNull() & F.col("back").isNotNull(), index).alias("index"))
    out = lambda s, d, v: F.struct(F.col(s).alias("src"), F.col(d).alias("dst"), F.coalesce("index", F.col(f"{v}.value").cast("double")).alias("value"))
    ways = F.array(F.when(F.col("there").isNotNull(), out("a", "b", "there")), F.when(F.col("back").isNotNull() & (F.col("a") < F.col("b")), out("b", "a", "back")))
    return pairs.select(F.explode(ways).alias("e")).where("e is not null").select("e.*")


def adamic_adar(graph: Graph, *, distance: bool = False) -> tuple[DataFrame, DataFrame]:
    """(id, value) and (src, dst, value): vertices get ln(1 / out-degree), 0 without edges; each edge adds up that of
    all vertices that lead to both its ends, on top of its own value; a distance is the negative."""
    n = graph.edges.groupBy(F.col("src").alias("id")).agg(F.log(F.lit(1.0) / F.count("*")).alias("w"))
    v = graph.vertices.select("id").join(n, "id", "left").select("id", F.coalesce("w", F.lit(0.0)).alias("value"))
    e = graph.edges.select("src", "dst")
    loops = e.where("src = dst").select("src")
    shared = _thirds(e).where(_leads("z", "a", "za") & _leads("z", "b", "zb")).select("a", "b", "z")
    # A vertex with a self-loop leads to both ends of its out-edges; all that lead to it do so to both ends of the loop.
    around = e.where("src <> dst").join(loops, "src", "left_semi")
    shared = shared.unionByName(around.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), F.col("src").alias("z")))
    shared = shared.unionByName(e.join(loops.toDF("dst"), "dst", "left_semi").select(F.col("dst").alias("a"), F.col("dst").alias("b"), F.col("src").alias("z")))
    sums = _both_ways(shared.join(v.toDF("z", "w"), "z").groupBy("a", "b").agg(F.sum("w").alias("s")))
    total = F.col("value") + F.coalesce("s", F.lit(0.0))
    rows = graph.edges.join(sums, ["src", "dst"], "left").select("src", "dst", (total if not distance else -total).alias("value"))
    return v, rows


def _both_ways(pairs: DataFrame) -> DataFrame:
    """Rows of pairs (a, b, x), a <= b, as (src, dst, x) in both orders."""
    x = pairs.columns[-1]
    back = pairs.where("a <> b").select(F.col("b").alias("src"), F.col("a").alias("dst"), x)
    return pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"), x).unionByName(back)


def triangles(edges: DataFrame) -> DataFrame:
    """(id, count): triangles of each vertex that has one, edges taken as undirected, and all triangles under -1."""
    u = edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    t = _corners(u.withColumn("k", F.lit(1).cast("long")))
    rows = t.select(F.explode(F.array(F.col("i"), F.col("p"), F.col("q"), F.lit(-1).cast("long"))).alias("id"))
    return rows.groupBy("id").agg(F.count("*").alias("count"))
