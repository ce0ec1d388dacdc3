"""Winnowed fingerprints and the similarity join over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinsift.functions.tokens import let
from kinsift.session import cut


def fingerprints(tokens: Column, k: int = 5, w: int = 4) -> Column:
    """Sorted distinct minima of every window of w hashed k-grams, k and w cut to what there is. md5 in hex: its
    order as text is its order as a number."""

    def grams(t: Column) -> Column:
        kk = F.least(F.lit(max(1, k)), F.size(t))
        return F.transform(F.sequence(F.lit(1), F.size(t) - kk + 1), lambda i: F.md5(F.array_join(F.slice(t, i, kk), "\x1f")))

    def minima(h: Column) -> Column:
        ww = F.least(F.lit(max(1, w)), F.size(h))
        return F.transform(F.sequence(F.lit(1), F.size(h) - ww + 1), lambda i: F.array_min(F.slice(h, i, ww)))

    none = F.array().cast("array<string>")
    return let(tokens, lambda t: F.when(F.size(t) > 0, let(grams(t), lambda h: F.array_sort(F.array_distinct(minima(h))))).otherwise(none))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct values: both empty 1, one empty 0."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(both / F.greatest(F.size(a) + F.size(b) - both, F.lit(1)))


def classes(docs: DataFrame, key: str, prints: str) -> tuple[DataFrame, DataFrame]:
    """(members, representatives): documents with equal sets of fingerprints are one class, named after its
    smallest key, so that copies are never joined with each other. members: key, class_id; representatives:
    class_id, fps, size. A class of a third of all documents is only a running minimum."""
    named = docs.select(F.col(key).alias("id"), F.col(prints).alias("fps"), F.sha2(F.array_join(prints, ""), 256).alias("sig"))
    named = cut(named)
    heads = cut(named.groupBy("sig").agg(F.min("id").alias("class_id"), F.count("*").alias("n")))
    members = named.select("id", "sig").join(heads, "sig").select(F.col("id").alias(key), "class_id")
    reps = named.join(heads, (named.sig == heads.sig) & (named.id == heads.class_id)).select("class_id", "fps", F.size("fps").alias("size"))
    return members, reps


def similar_classes(reps: DataFrame, least: float, longest_list: int = 2000) -> DataFrame:
    """(left_id, right_id, similarity) of all pairs of representatives whose Jaccard is at least `least` (> 0).

    Lossless prefix filter: values are ordered from rare to common; two sets that similar share a value among the
    first size - ceil(least * size) + 1 of each, and the larger set is at most size / least. Rare values make the
    join's groups small; what is common to very many documents is hardly ever in a prefix. Should a value still
    be in the prefix of more than `longest_list` sets, these are joined on two prefix values at once (a set pair
    that similar shares two values among one more of each, unless it shares one value in all; sets of one value
    that are equal are one class already, and a set of two that shares one has at most 1/2: see `single`)."""
    if least <= 0:
        raise ValueError("least must be above 0; every pair has a similarity of at least 0")
    reps = cut(reps.where("size > 0"))
    values = reps.select("class_id", "size", F.explode("fps").alias("v"))
    df = values.groupBy("v").agg(F.count("*").alias("df"))
    ordered = values.join(df, "v").groupBy("class_id", "size").agg(F.array_sort(F.collect_list(F.struct("df", "v"))).alias("o"))
    ordered = cut(ordered)
    must = F.ceil(F.col("size") * least - 1e-9)
    width = (F.col("size") - must + 1).cast("int")
    prefix = ordered.select("class_id", "size", F.posexplode(F.slice("o", F.lit(1), width)).alias("at", "x")).select("class_id", "size", "at", "x.v")
    heavy = prefix.groupBy("v").agg(F.count("*").alias("n")).where(F.col("n") > longest_list).select("v")
    heavy = cut(heavy)
    light = prefix.join(heavy, "v", "left_anti").select("class_id", "size", F.col("v").alias("key"))
    twice = ordered.select("class_id", "size", F.slice("o", F.lit(1), width + 1).alias("p"))
    keyed = twice.select("class_id", "size", "p", F.posexplode(F.transform("p", lambda x: x["v"])).alias("at", "v")).join(heavy, "v")
    pairs2 = keyed.select("class_id", "size", F.explode(F.transform(F.filter("p", lambda x: x["v"] != F.col("v")), lambda x: F.concat_ws("|", F.least(x["v"], F.col("v")), F.greatest(x["v"], F.col("v"))))).alias("key"))
    # Pairs with one common value in all: Jaccard is at most 1/2, so only wanted for a low `least`, and then both sets are small.
    single = prefix.join(heavy, "v").where(F.col("size") * least <= 1 + 1e-9).select("class_id", "size", F.col("v").alias("key"))
    keys = light.unionByName(pairs2).unionByName(single)
    a, b = keys.alias("a"), keys.alias("b")
    close = (F.col("a.class_id") < F.col("b.class_id")) & (F.least("a.size", "b.size") >= F.greatest("a.size", "b.size") * least - 1e-9)
    met = a.join(b, (F.col("a.key") == F.col("b.key")) & close).select(F.col("a.class_id").alias("left_id"), F.col("b.class_id").alias("right_id")).distinct()
    sets = reps.select("class_id", "fps")
    both = met.join(sets.toDF("left_id", "lf"), "left_id").join(sets.toDF("right_id", "rf"), "right_id")
    return both.select("left_id", "right_id", jaccard(F.col("lf"), F.col("rf")).alias("similarity")).where(F.col("similarity") >= least - 1e-12)


def most_similar(reps: DataFrame, n: int, start: float = 0.5, lowest: float = 0.1) -> DataFrame:
    """(left_id, right_id, similarity) of pairs of representatives, among them the n most similar of those that share
    a value: similar_classes() at a similarity that n pairs reach, halved from `start` on; below `lowest` every
    pair that shares a value."""
    reps, least = cut(reps), start
    while least >= lowest:
        found = cut(similar_classes(reps, least))
        if found.limit(n).count() == n:
            return found
        least /= 2
    sets = reps.select(F.col("class_id").alias("id"), "fps").where(F.size("fps") > 0)
    return shared_counts(sets, sets).where("left_id < right_id")


def best_members(members: DataFrame, similar: DataFrame, n: int) -> DataFrame:
    """(left_id, right_id, similarity) of pairs of documents, left_id < right_id, among them the n best by
    similarity, then by the later left_id, then by the later right_id. members (id, class_id); similar: pairs of
    classes (left_id, right_id, similarity). Documents of one class have similarity 1.

    Only class pairs that are no worse than the n-th best one count, as each has a pair to offer, and of a class
    its n + 1 last ids: with a member come n better pairs, if n larger ids of its class are there to replace it
    (n + 1, where both are of one class)."""
    order = Window.partitionBy("class_id").orderBy(F.desc("id"))
    last = cut(members.withColumn("at", F.row_number().over(order)).where(F.col("at") <= n + 1).drop("at"))
    own = last.groupBy("class_id").agg(F.count("*").alias("m")).where("m > 1").select(F.col("class_id").alias("left_id"), F.col("class_id").alias("right_id"), F.lit(1.0).alias("similarity"))
    offers = cut(similar.select("left_id", "right_id", "similarity").unionByName(own))
    least = offers.orderBy(F.desc("similarity")).limit(n).agg(F.min("similarity")).first()[0]
    offers = offers.where(F.col("similarity") >= (0.0 if least is None else least)).toDF("c", "d", "similarity")
    both = offers.join(last.toDF("a", "c"), "c").join(last.toDF("b", "d"), "d").where("c <> d or a < b")
    return both.select(F.least("a", "b").alias("left_id"), F.greatest("a", "b").alias("right_id"), "similarity")


def shared_counts(left: DataFrame, right: DataFrame, longest_list: int = 2000) -> DataFrame:
    """(left_id, right_id, similarity) of every pair of sets (id, fps) of two tables that share a value. Pairs that
    share none have similarity 0 and don't come out, but two empty sets, which are 1.

    An inverted index: common values are counted where the lists of a value meet. Equal sets are one entry first, so
    copies don't lengthen lists. A value with a list above longest_list is dealt out: each side's entry goes to a part
    by its hash, that of the right to all parts of the left, so that no task forms the product of two long lists."""
    sides = []
    for df in (left, right):
        named = cut(df.select("id", "fps", F.sha2(F.array_join("fps", ""), 256).alias("sig")))
        sets = cut(named.where(F.size("fps") > 0).groupBy("sig").agg(F.first("fps").alias("fps")).withColumn("n", F.monotonically_increasing_id()))
        sides.append((cut(named.select("id", "sig").join(sets.select("sig", "n"), "sig").select("id", "n")), sets))  # numbers make short keys
    (lm, ls), (rm, rs) = sides
    l = ls.select(F.col("n").alias("ls"), F.explode("fps").alias("v"))
    r = rs.select(F.col("n").alias("rs"), F.explode("fps").alias("v"))
    parts = cut(l.groupBy("v").agg(F.ceil(F.count("*") / longest_list).cast("int").alias("parts")).where("parts > 1"))  # a row for longest_list entries at least
    l = l.join(parts, "v", "left").withColumn("part", F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("ls"), F.col("parts"))).otherwise(0)).drop("parts")
    r = r.join(parts, "v", "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)).cast("long") - 1))).drop("parts")
    both = l.select("ls", "v", "part").join(r.select("rs", "v", "part"), ["v", "part"]).groupBy("ls", "rs").agg(F.count("*").alias("c"))
    sized = both.join(ls.select(F.col("n").alias("ls"), F.size("fps").alias("ln")), "ls").join(rs.select(F.col("n").alias("rs"), F.size("fps").alias("rn")), "rs")
    scored = sized.select("ls", "rs", (F.col("c") / (F.col("ln") + F.col("rn") - F.col("c"))).alias("similarity"))
    met = scored.join(lm.toDF("left_id", "ls"), "ls").join(rm.toDF("right_id", "rs"), "rs").select("left_id", "right_id", "similarity")
    empty = left.where(F.size("fps") == 0).select(F.col("id").alias("left_id")).join(right.where(F.size("fps") == 0).select(F.col("id").alias("right_id")), F.lit(True))
    return met.unionByName(empty.withColumn("similarity", F.lit(1.0)))


def with_zeros(met: DataFrame, left: DataFrame, right: DataFrame, block: int = 4096) -> DataFrame:
    """shared_counts() of left and right (id, unique) with the pairs it leaves out, at similarity 0: every pair once.

    The right ids go in blocks of about `block` to every left id, which takes away those it met; pairs are never
    shuffled, but for those met, and a task holds one block's ids at a time."""
    n = max(1, right.count() // block)
    at = lambda c: F.pmod(F.xxhash64(c), F.lit(n)).alias("b")
    blocks = right.select("id", at("id")).groupBy("b").agg(F.collect_list("id").alias("ids"))
    seen = met.groupBy("left_id", at("right_id")).agg(F.collect_list("right_id").alias("seen"))
    wanted = left.select(F.col("id").alias("left_id")).crossJoin(blocks.select("b")).join(seen, ["left_id", "b"], "left")
    wanted = wanted.repartition(max(n, left.sparkSession.sparkContext.defaultParallelism), "left_id", "b")
    none = F.array().cast("array<string>")
    rest = wanted.join(F.broadcast(blocks), "b").select("left_id", F.explode(F.array_except("ids", F.coalesce("seen", none))).alias("right_id"))
    return met.unionByName(rest.withColumn("similarity", F.lit(0.0)))


def best_pairs(pairs: DataFrame, n: int) -> DataFrame:
    """The n most similar pairs; ties by ids."""
    if n < 1:
        raise ValueError("number_results must be at least 1")
    return pairs.orderBy(F.desc("similarity"), "left_id", "right_id").limit(n)


def rank_within(pairs: DataFrame, group: str, n: int) -> DataFrame:
    order = Window.partitionBy(group).orderBy(F.desc("similarity"), "right_id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
