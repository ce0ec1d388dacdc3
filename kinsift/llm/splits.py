"""Train, validation and test roles that keep related records together.

Method: frontier breadth-first components. Adjacency lists are hash-partitioned; many seeds (every vertex whose
hash is below all its neighbours') expand at the same time; where the regions of two seeds meet, the seeds are
linked in a much smaller graph, which is solved by itself; components then fill the splits in the order of
their hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinsift.functions.ids import ref_id
from kinsift.llm.groups import both_ways, star_components
from kinsift.plans.skew import running_totals
from kinsift.session import cut, drop

ROLES = ("train", "validation", "test")
_SEP = "\x1f"


def file_entities(files: DataFrame) -> DataFrame:
    """(file_id, entity_id): the stripped, lower-cased author of a file, else its own stripped id."""
    author = F.nullif(F.lower(ref_id("author_id")), F.lit(""))
    known = files.select(ref_id("file_id").alias("file_id"), author.alias("author")).where("file_id is not null")
    return known.groupBy("file_id").agg(F.coalesce(F.min("author"), F.col("file_id")).alias("entity_id"))


def pair_entities(pairs: DataFrame, files: DataFrame) -> DataFrame:
    """(dataset_name, row_index, left, right): the entity of each side of a pair; the file's id where it isn't
    in files, null where the side has no id."""
    known = cut(file_entities(files))
    rows = pairs.select("dataset_name", "row_index", ref_id("left_id").alias("l"), ref_id("right_id").alias("r"))
    left = known.select(F.col("file_id").alias("l"), F.col("entity_id").alias("le"))
    right = known.select(F.col("file_id").alias("r"), F.col("entity_id").alias("re"))
    both = rows.join(left, "l", "left").join(right, "r", "left")
    return both.select("dataset_name", "row_index", F.coalesce("le", "l").alias("left"), F.coalesce("re", "r").alias("right"))


def frontier_components(edges: DataFrame) -> DataFrame:
    """(node, root) of the graph of distinct (u, v), u < v. Vertices of one component have one root, the least
    of its seeds' ids. No edges give no rows.

    Scale: a round costs a join of the frontier with the adjacency list and an anti-join with what has been
    reached; a hub's neighbours combine on the map side. Every vertex has a seed downhill of it by hash, so the
    rounds number a few, whatever the size; components of any diameter are joined through their seeds."""
    arcs = cut(both_ways(edges))
    rank = lambda c: F.struct(F.xxhash64(c), F.col(c))
    low = arcs.groupBy("s").agg(F.min(rank("d")).alias("least"))
    seeds = low.where(rank("s") < F.struct(F.col("least.col1"), F.col("least.d"))).select(F.col("s").alias("node"), F.col("s").alias("seed"))
    frontier = cut(seeds)
    reached = frontier
    while frontier.limit(1).count():
        met = arcs.join(frontier.withColumnRenamed("node", "s"), "s").groupBy("d").agg(F.min("seed").alias("seed"))
        frontier = cut(met.withColumnRenamed("d", "node").join(reached.select("node"), "node", "left_anti"))
        reached = reached.unionByName(frontier)
    labels = cut(reached)
    left, right = (labels.select(F.col("node").alias(c), F.col("seed").alias(f"{c}_seed")) for c in ("u", "v"))
    meets = edges.join(left, "u").join(right, "v").where("u_seed <> v_seed")
    small = meets.select(F.least("u_seed", "v_seed").alias("u"), F.greatest("u_seed", "v_seed").alias("v")).distinct()
    merged = cut(star_components(small)).select(F.col("node").alias("seed"), "root")
    drop(arcs)
    return labels.join(merged, "seed", "left").select("node", F.coalesce("root", "seed").alias("root"))


def pair_components(entities: DataFrame) -> DataFrame:
    """entities (see pair_entities) with `component`: one name for all pairs of a data set that are linked by
    entities. A pair without entities is a component of its own."""
    name = lambda c: F.concat_ws(_SEP, F.coalesce("dataset_name", F.lit("")), F.col(c))
    one = F.coalesce("left", "right")
    rows = cut(entities.withColumn("own", F.when(one.isNotNull(), F.concat_ws(_SEP, F.coalesce("dataset_name", F.lit("")), one))))
    edges = rows.where("left <> right").select(F.least(name("left"), name("right")).alias("u"), F.greatest(name("left"), name("right")).alias("v")).distinct()
    roots = cut(frontier_components(cut(edges)))
    alone = F.concat_ws(_SEP, F.coalesce("dataset_name", F.lit("")), F.lit(""), F.coalesce(F.col("row_index").cast("string"), F.lit("")))
    return rows.join(roots.withColumnRenamed("node", "own"), "own", "left").withColumn("component", F.coalesce("root", "own", alone)).drop("root", "own")


def assign_roles(components: DataFrame, shares: tuple[float, float, float] = (0.8, 0.1, 0.1)) -> DataFrame:
    """(dataset_name, row_index, component, role) for rows with a component. In every data set, components line up
    in the order of their hashes; train takes the first of them up to its share, validation the next, test the rest:
    a component has the role in whose range its middle falls. So no component has two roles, a role misses its
    share by less than the largest component, and a component that is a data set by itself leaves nothing to the
    other roles (share_report() says what was reached). Null data set names are one data set.

    Scale: sums by component combine on the map side; totals run over ordered buckets of the hash (running_totals),
    so that no data set is sorted in one task."""
    if abs(sum(shares) - 1) > 1e-9 or min(shares) < 0:
        raise ValueError("shares must be at least 0 and sum to 1")
    rows = components.withColumn("ds", F.coalesce("dataset_name", F.lit("")))
    sizes = cut(rows.groupBy("ds", "component").agg(F.count("*").alias("size")).withColumn("h", F.xxhash64("component")))
    totals = sizes.groupBy("ds").agg(F.sum("size").alias("total"))
    middle = (F.col("before") + F.col("size") / 2) / F.col("total")
    role = F.when(middle < shares[0], ROLES[0]).when(middle < shares[0] + shares[1], ROLES[1]).otherwise(ROLES[2] if shares[2] else ROLES[1] if shares[1] else ROLES[0])
    roles = running_totals(sizes, ["ds"], "h", "size", "before").join(totals, "ds").select("ds", "component", role.alias("role"))
    return rows.join(cut(roles), ["ds", "component"]).select("dataset_name", "row_index", "component", "role")


def split_lists(splits: DataFrame) -> DataFrame:
    """(name, dataset_name, row_index, role bit 1, 2 or 4): every distinct entry of the three lists."""
    lists = [splits.select("name", "dataset_name", F.explode(f"{role}_indices").alias("row_index"), F.lit(1 << i).alias("bit")) for i, role in enumerate(ROLES)]
    return lists[0].unionByName(lists[1]).unionByName(lists[2]).where("row_index is not null").distinct()


def leaking_entities(splits: DataFrame, components: DataFrame) -> DataFrame:
    """(name, entity_id): entities with pairs in more than one list of the split. components: see
    pair_components(). Lists may be null or empty, indices repeated or unknown (then they are ignored).

    An entity lies within one component, so only components that a split gives several roles can hold one; the
    entities of those are then checked one by one. Both steps combine role bits on the map side."""
    placed = cut(split_lists(splits).join(components, ["dataset_name", "row_index"]))
    mixed = placed.groupBy("name", "component").agg(F.bit_or("bit").alias("bits")).where("bit_count(bits) > 1")
    inside = placed.join(mixed.select("name", "component"), ["name", "component"], "left_semi")
    entity = inside.select("name", "bit", F.explode(F.array_distinct(F.array("left", "right"))).alias("entity_id")).where("entity_id is not null")
    found = entity.groupBy("name", "entity_id").agg(F.bit_or("bit").alias("bits")).where("bit_count(bits) > 1")
    return found.select("name", "entity_id")


def share_report(roles: DataFrame) -> DataFrame:
    """(dataset_name, role, pairs, components, largest, share): what the assignment came to; largest is the size of
    the role's largest component."""
    own = Window.partitionBy("dataset_name")
    sizes = roles.groupBy("dataset_name", "role", "component").agg(F.count("*").alias("size"))
    counts = sizes.groupBy("dataset_name", "role").agg(F.sum("size").alias("pairs"), F.count("*").alias("components"), F.max("size").alias("largest"))
    return counts.withColumn("share", F.round(F.col("pairs") / F.sum("pairs").over(own), 6))


def check_roles(roles: DataFrame, entities: DataFrame, shares: tuple[float, float, float] = (0.8, 0.1, 0.1)) -> DataFrame:
    """(dataset_name, pairs, divided, off): the rows of each data set, how many of its entities (see pair_entities())
    have more than one role, and how many roles miss their share by the largest component or more."""
    role_no = F.array_position(F.array(*map(F.lit, ROLES)), F.col("role")).cast("int")
    both = entities.join(roles.select("dataset_name", "row_index", role_no.alias("no")), ["dataset_name", "row_index"])
    entity = both.select("dataset_name", "no", F.explode(F.array_distinct(F.array("left", "right"))).alias("e")).where("e is not null")
    divided = entity.groupBy("dataset_name", "e").agg(F.min("no").alias("lo"), F.max("no").alias("hi")).groupBy("dataset_name").agg(F.sum((F.col("lo") < F.col("hi")).cast("int")).alias("divided"))
    report = share_report(roles)
    whole = report.groupBy("dataset_name").agg(F.sum("pairs").alias("pairs"), F.max("largest").alias("largest"), F.map_from_entries(F.collect_list(F.struct("role", "pairs"))).alias("got"))  # three roles
    miss = lambda role, share: (F.abs(F.coalesce(F.element_at("got", role), F.lit(0)) - F.col("pairs") * share) >= F.col("largest") + 1e-6).cast("int")
    off = sum((miss(r, s) for r, s in zip(ROLES[1:], shares[1:])), miss(ROLES[0], shares[0]))
    return whole.select("dataset_name", "pairs", off.alias("off")).join(divided, "dataset_name", "left").select("dataset_name", "pairs", F.coalesce("divided", F.lit(0)).alias("divided"), "off")
