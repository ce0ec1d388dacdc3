"""Pairwise matches consolidated into groups.

Method: vertices of degree one are stripped and chains of degree two compressed, round by round; the core that
is left is solved by itself; then the removed vertices get the labels of those they were attached to.

A round removes every leaf and, from the chains, an independent set chosen by a fresh hash (list ranking by
random splicing: a chain vertex goes where its hash beats its chain neighbours', and its two neighbours are
linked). A chain or tree of n vertices is gone after some multiple of log n rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinsift.functions.ids import ref_id
from kinsift.session import cut, drop

#: Stripping ends when a round removes less than this share of the vertices; the core solver takes any graph.
LEAST_SHARE = 0.02


def undirected(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """Distinct (u, v), u < v, of the pairs whose ids differ; null and empty ids link nothing."""
    a, b = ref_id(left), ref_id(right)
    return pairs.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v"), a.alias("_a"), b.alias("_b")).where("_a <> _b").select("u", "v").distinct()


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct(F.col("u").alias("s"), F.col("v").alias("d")), F.struct(F.col("v").alias("s"), F.col("u").alias("d")))).alias("x")).select("x.*")


def _removable(edges: DataFrame, number: int) -> DataFrame:
    """(v, p, q): vertices to remove, what they are attached to, and, for a spliced one, its other neighbour."""
    degree = both_ways(edges).groupBy("s").agg(F.count("*").alias("deg"), F.min("d").alias("lo"), F.max("d").alias("hi"))
    thin = cut(degree.where("deg <= 2"))
    rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(number)), F.col(c))
    asked = thin.select("s", "deg", "lo", "hi", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("d"))
    near = asked.join(thin.select(F.col("s").alias("d"), F.col("deg").alias("ddeg")), "d", "left")
    leaf = F.col("ddeg").isNull() | (F.col("ddeg") == 2) | (F.col("d") < F.col("s"))
    chain = F.col("ddeg").isNull() | ((F.col("ddeg") == 2) & (rank("s") > rank("d")))
    goes = F.when(F.col("deg") == 1, leaf).otherwise(chain)
    judged = near.groupBy("s", "deg", "lo", "hi").agg(F.min(goes.cast("int")).alias("ok")).where("ok = 1")
    return judged.select(F.col("s").alias("v"), F.col("lo").alias("p"), F.when(F.col("deg") == 2, F.col("hi")).alias("q"))


def star_components(edges: DataFrame) -> DataFrame:
    """(node, root) of a graph of distinct (u, v), u < v: alternating large-star and small-star rounds, in which
    every vertex links its larger, then its smaller neighbours to the least of them, until only stars are left.
    Minima combine on the map side; hub joins are between plain exchanges, which AQE splits."""
    now = cut(edges.select("u", "v"))
    before = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            break
        before = mark
        arcs = both_ways(now)
        least = arcs.groupBy("s").agg(F.least(F.col("s"), F.min("d")).alias("m"))
        large = arcs.where("d > s").join(least, "s").select(F.col("m").alias("u"), F.col("d").alias("v")).where("u < v").distinct()
        large = cut(large)
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        moved = large.join(low, "v").select(F.explode(F.array(F.struct(F.col("m").alias("u"), F.col("u").alias("v")), F.struct(F.col("m").alias("u"), F.col("v").alias("v")))).alias("x")).select("x.*")
        after = cut(moved.where("u < v").distinct())
        drop(now)
        drop(large)
        now = after
    return now.select(F.col("v").alias("node"), F.col("u").alias("root"))


def _chase(links: DataFrame) -> DataFrame:
    """Pointer doubling over a forest (v, p): every v with its root."""
    while True:
        over = links.select(F.col("v").alias("p"), F.col("p").alias("pp"))
        after = cut(links.join(over, "p", "left").select("v", F.coalesce("pp", "p").alias("p"), F.col("pp").isNotNull().alias("moved")))
        moved = after.where("moved").limit(1).count()
        links = after.select("v", "p")
        if not moved:
            return links


def group_matches(edges: DataFrame) -> DataFrame:
    """(node, group_id): every vertex of the graph `edges` (distinct u < v, see undirected()) with the smallest
    vertex, in code point order, of those linked to it directly or through others. No edges give no rows;
    vertices without an edge don't come out.

    Scale: edges stay distributed throughout; rounds read and write shrinking tables in the checkpoint folder.
    Degrees combine on the map side, so a hub costs its task one row a map task. A group of a third of all
    vertices only appears as a join key between written tables (split by AQE) and as one running minimum."""
    vertices_before, number, removed = None, 0, []
    now = cut(edges.select("u", "v"))
    while True:
        if not now.limit(1).count():
            core = None
            break
        gone = cut(_removable(now, number))
        count = gone.count()
        if vertices_before is None:
            vertices_before = both_ways(now).select("s").distinct().count()
        if count <= LEAST_SHARE * vertices_before:
            drop(gone)
            core = now
            break
        vertices_before -= count
        removed.append(gone)
        number += 1
        key = gone.select("v")
        kept = now.join(key, "v", "left_anti").join(key.withColumnRenamed("v", "u"), "u", "left_anti").select("u", "v")
        linked = gone.where("q is not null").select(F.least("p", "q").alias("u"), F.greatest("p", "q").alias("v"))
        after = cut(kept.unionByName(linked).distinct())
        drop(now)
        now = after
    links = None
    for part in removed:
        links = part.select("v", "p") if links is None else links.unionByName(part.select("v", "p"))
    solved = star_components(core).select(F.col("node").alias("v"), F.col("root").alias("p")) if core is not None else None
    if solved is not None:
        links = solved if links is None else links.unionByName(solved)
    if links is None:
        return now.select(F.col("u").alias("node"), F.col("v").alias("group_id"))
    rooted = _chase(cut(links))
    least = cut(rooted.groupBy("p").agg(F.least(F.col("p"), F.min("v")).alias("group_id")))
    members = rooted.join(least, "p").select(F.col("v").alias("node"), "group_id")
    return members.unionByName(least.select(F.col("p").alias("node"), "group_id"))
