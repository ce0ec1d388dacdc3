from __future__ import annotations

import random

import pytest

from kinsift.llm.groups import group_matches, star_components, undirected
from kinsift.llm.splits import assign_roles, frontier_components, leaking_entities, pair_components, pair_entities, share_report


def _roots(edges):
    up: dict = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        up[y] = x
    return {x: find(x) for x in up}


def _graphs():
    rng = random.Random(4)
    chain = [(f"c{i:03}", f"c{i + 1:03}") for i in range(60)]
    ring = [(f"r{i:02}", f"r{(i + 1) % 17:02}") for i in range(17)]
    star = [("hub", f"s{i:03}") for i in range(80)]
    clique = [(f"k{i}", f"k{j}") for i in range(7) for j in range(i)]
    mixed = [(f"m{rng.randrange(60):02}", f"m{rng.randrange(60):02}") for _ in range(45)]
    tree = [(f"t{i:03}", f"t{(i - 1) // 2:03}") for i in range(1, 64)]
    return {"chain": chain, "ring": ring, "star": star, "clique": clique, "all": chain + ring + star + clique + mixed + tree, "one": [("b", "a")]}


@pytest.mark.parametrize("name", ["ring", "clique", "one", "all"])
def test_groups_equal_union_find(spark, name):
    edges = [(a, b) for a, b in _graphs()[name] if a != b]
    df = undirected(spark.createDataFrame([(a, b, "u") for a, b in edges + edges], "l string, r string, u string"), "l", "r")
    assert {r.node: r.group_id for r in group_matches(df).collect()} == _roots(edges)


def test_components_of_other_solvers(spark):
    edges = [(a, b) for a, b in _graphs()["all"] if a != b]
    df = undirected(spark.createDataFrame(edges, "l string, r string"), "l", "r")
    want = _roots(edges)
    stars = {r.node: r.root for r in star_components(df).collect()}
    assert all(stars.get(n, n) == root for n, root in want.items())
    found = {r.node: r.root for r in frontier_components(df).collect()}
    assert set(found) == set(want)
    assert len(set(found.values())) == len(set(want.values()))
    assert len({(found[n], want[n]) for n in want}) == len(set(want.values()))


def test_undirected_ids_and_empty(spark):
    df = spark.createDataFrame([(" a ", "b"), ("b", "a"), ("a", "a "), (None, "x"), ("  ", "y"), ("A", "a")], "l string, r string")
    assert sorted(map(tuple, undirected(df, "l", "r").collect())) == [("A", "a"), ("a", "b")]
    assert group_matches(undirected(df.limit(0), "l", "r")).count() == 0
    assert frontier_components(undirected(df.limit(0), "l", "r")).count() == 0


def _data(spark):
    rng = random.Random(9)
    files = [(f"f{i:03}", rng.choice([None, " A1 ", "a1", "a2", "", f"b{i}", f"B{i // 2}"]), "x") for i in range(60)]
    pairs = []
    for n in range(120):
        pairs.append(("ds" if n % 3 else "other", n, rng.choice([f"f{rng.randrange(60):03}", f" f{rng.randrange(60):03}", "gone", None, ""]), f"f{rng.randrange(60):03}", "c"))
    return spark.createDataFrame(files, "file_id string, author_id string, component string"), spark.createDataFrame(pairs, "dataset_name string, row_index long, left_id string, right_id string, component string"), files, pairs


def test_roles_keep_entities_together(spark):
    files, pairs, _, _ = _data(spark)
    parts = pair_components(pair_entities(pairs, files))
    roles = assign_roles(parts)
    assert roles.count() == 120
    assert roles.groupBy("dataset_name", "component").agg({"role": "min"}).count() == roles.select("dataset_name", "component", "role").distinct().count()
    joined = parts.join(roles.select("dataset_name", "row_index", "role"), ["dataset_name", "row_index"]).collect()
    seen: dict = {}
    for r in joined:
        for e in (r.left, r.right):
            if e is not None:
                assert seen.setdefault((r.dataset_name, e), r.role) == r.role
    assert share_report(roles).agg({"pairs": "sum"}).first()[0] == 120


def test_shares_are_met_by_small_components(spark):
    parts = spark.range(0, 2000).selectExpr("'d' as dataset_name", "id as row_index", "concat('c', id % 700) as component")
    got = {r.role: r.share for r in share_report(assign_roles(parts)).collect()}
    assert abs(got["train"] - 0.8) < 0.01 and abs(got["validation"] - 0.1) < 0.01
    with pytest.raises(ValueError):
        assign_roles(parts, (0.5, 0.1, 0.1))


def test_leaks_equal_brute_force(spark):
    files, pairs, file_rows, pair_rows = _data(spark)
    rng = random.Random(1)
    splits = []
    for n in range(5):
        idx = list(range(130))
        rng.shuffle(idx)
        splits.append((f"s{n}", rng.choice(["ds", "other", None]), idx[:70] + idx[:5], None if n == 2 else idx[60:90], [] if n == 3 else idx[90:]))
    df = spark.createDataFrame(splits, "name string, dataset_name string, train_indices array<long>, validation_indices array<long>, test_indices array<long>")
    author = {}
    for f, a, _ in file_rows:
        a = (a or "").strip().lower()
        author[f] = a or f
    want = set()
    for name, ds, *lists in splits:
        where: dict = {}
        for role, indices in enumerate(lists):
            for d, n, left, right, _ in pair_rows:
                if d == ds and n in (indices or ()):
                    for x in (left, right):
                        x = (x or "").strip()
                        if x:
                            where.setdefault(author.get(x, x), set()).add(role)
        want |= {(name, e) for e, roles in where.items() if len(roles) > 1}
    assert want
    assert {tuple(r) for r in leaking_entities(df, pair_components(pair_entities(pairs, files))).collect()} == want
    assert leaking_entities(df.limit(0), pair_components(pair_entities(pairs.limit(0), files.limit(0)))).count() == 0


@pytest.mark.parametrize("share", [0.0, 1.0])
def test_where_stripping_ends_changes_nothing(spark, monkeypatch, share):
    """All by stripping and the core, or all by the core solver."""
    from kinsift.llm import groups

    monkeypatch.setattr(groups, "LEAST_SHARE", share)
    edges = [(a, b) for a, b in _graphs()["all"] if a != b]
    df = undirected(spark.createDataFrame(edges, "l string, r string"), "l", "r")
    assert {r.node: r.group_id for r in group_matches(df).collect()} == _roots(edges)


def test_roles_follow_the_hash_order_alone(spark):
    """A component of most rows may have any role; the others still line up by hash, and no entity is divided."""
    from kinsift.llm.splits import check_roles

    rows = [("d", i, "big", f"b{i}") for i in range(60)] + [("d", 60 + i, f"x{i}", f"y{i}") for i in range(60)] + [("e", i, None, None) for i in range(10)] + [(None, 0, "a", "b")]
    entities = spark.createDataFrame(rows, "dataset_name string, row_index long, left string, right string")
    roles = assign_roles(pair_components(entities), (0.5, 0.25, 0.25))
    got = {(r.dataset_name, r.row_index): r.role for r in roles.collect()}
    assert len(got) == len(rows) and len({got["d", i] for i in range(60)}) == 1
    report = {r.dataset_name: (r.pairs, r.divided, r.off) for r in check_roles(roles, entities, (0.5, 0.25, 0.25)).collect()}
    assert report["d"] == (120, 0, 0) and report["e"] == (10, 0, 0)
    import pyspark.sql.functions as F

    broken = roles.withColumn("role", F.when(F.col("row_index") == 3, "test").when(F.col("row_index") == 4, "train").otherwise(F.col("role")))
    assert {r.dataset_name: r.divided for r in check_roles(broken, entities).collect()}["d"] >= 1


def test_shortfalls_are_counted_from_the_draw(spark):
    from kinsift.llm.mixing import check_mix, draw_mix, reached_shares

    records = spark.createDataFrame([(i, "a" if i < 40 else "B ", 10, 1.0) for i in range(50)], "id long, source string, tokens long, weight double")
    targets = spark.createDataFrame([("a", 50, 2), ("b", 40, 1), ("none", 10, 3)], "source string, target_pct int, max_repeats int")
    draws, plan = draw_mix(records, targets, "id")
    rows = {r.source: r for r in reached_shares(draws, plan).collect()}
    assert {s: r.short for s, r in rows.items()} == {"a": False, "b": True, "none": True}
    assert rows["b"].drawn == 100 and rows["a"].drawn == 250 and rows["a"].largest_mix == 250
    assert all((r.over, r.far, r.beyond) == (0, 0, 0) for r in check_mix(draws, plan).collect())
    assert {r.source: r.short for r in reached_shares(draws.where("source <> 'b'"), plan).collect()}["b"] is False
    assert {r.source: r.far for r in check_mix(draws.where("source <> 'a'"), plan).collect()}["a"] == 1
