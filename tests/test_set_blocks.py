"""Sets of two sides compared in cells, against brute force."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinsift.operators import retrieval, set_blocks

_KIND = "item string, fps array<string>"
_JUDGED = "query_id string, document_id string, relevance double"


def _sides(spark, q, d):
    """Index of two sides {id: values}."""
    hashed = lambda s: sorted(hashlib.md5(v.encode()).hexdigest() for v in s)
    items = spark.createDataFrame([(f"f{i}", hashed(s)) for x in (q, d) for i, s in x.items()], _KIND)
    left, right = (spark.createDataFrame([(i, f"f{i}") for i in x], "id string, item string") for x in (q, d))
    return set_blocks.index(items, left, right)


def _similarity(s, t):
    return round(len(s & t) / len(s | t), 6) if s | t else 1.0


def _random_sides(rng):
    q = {f"q{i:02}": frozenset(rng.choices("abcdefgh", k=i % 3)) for i in range(9)}
    d = {f"d{i:02}": frozenset(rng.choices("abcdefgh", k=i % 4)) for i in range(30)}
    q["q99"], d["d98"] = frozenset("x"), frozenset(f"n{i}" for i in range(70)) | {"a"}
    return q, d


@pytest.mark.parametrize(("left", "right", "dense"), [(1000, 1000, 1 << 21), (3, 7, 40), (1, 1, 1)])
def test_ranks_equal_sorting(spark, monkeypatch, left, right, dense):
    monkeypatch.setattr(set_blocks, "DENSE", dense)
    rng = random.Random(5)
    q, d = _random_sides(rng)
    judged = [(a, b, float(rng.randint(1, 3))) for a, b in rng.sample([(a, b) for a in q for b in d], 150)] + [("q01", "gone", 2.0), ("other", "d01", 1.0)]
    want = set()
    for a, b, relevance in judged:
        if a in q and b in d:
            order = sorted(d, key=lambda x: (-_similarity(q[a], d[x]), x))
            want.add((a, order.index(b) + 1, relevance))
    got = set_blocks.ranks(_sides(spark, q, d), spark.createDataFrame(judged, _JUDGED), left, right).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_set_metrics_equal_metrics_of_all_pairs(spark):
    rng = random.Random(7)
    q, d = _random_sides(rng)
    judged = spark.createDataFrame([(a, b, float(rng.randint(0, 3))) for a, b in rng.sample([(a, b) for a in q for b in d], 90)] + [("q01", "gone", 2.0), ("other", "d01", 1.0)], _JUDGED)
    whole = spark.createDataFrame([(a, b, _similarity(s, t)) for a, s in q.items() for b, t in d.items()], "query_id string, document_id string, similarity_score double")
    key = lambda df: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())
    assert key(retrieval.set_metrics(_sides(spark, q, d), judged, 5)) == key(retrieval.query_metrics(whole, judged, 5))


def test_cells_return_wanted_pairs_only(spark, monkeypatch):
    """300 x 400 pairs share a value; 40 are judged, and no table that is written has a row a pair."""
    rows, real = [], set_blocks.cut
    monkeypatch.setattr(set_blocks, "cut", lambda df: (rows.append((out := real(df)).count()), out)[1])
    q, d = ({f"{side}{i}": {"common", f"{side}{i % 90}"} for i in range(n)} for side, n in (("q", 300), ("d", 400)))
    judged = spark.createDataFrame([(f"q{i}", f"d{i}", 1.0) for i in range(40)], _JUDGED)
    for right in (1000, 50):
        assert set_blocks.ranks(_sides(spark, q, d), judged, 100, right).count() == 40
    assert max(rows) == 700


def test_scores_are_rounded_half_up(spark):
    pairs = [(c, u) for u in (3, 7, 64, 128, 640, 999, 1280, 2048) for c in range(0, u + 1, max(1, u // 50))]
    cell = set_blocks._Cell.__new__(set_blocks._Cell)
    c, u = (np.array(x, np.int64) for x in zip(*pairs))
    cell.lsize, cell.rsize = u, c  # of all of the right set, so that the union is the left one
    want = [r[0] for r in spark.createDataFrame(pairs, "c long, u long").select(F.round(F.col("c") / F.col("u"), 6)).collect()]
    assert (cell.scores(c, np.arange(len(c)), np.arange(len(c))) / 1e6).tolist() == want


def test_retrieval_metrics_form_no_pairs(monkeypatch, spark, tmp_path):
    """The query works on files that all share a value without the inverted index that lists every pair."""
    from kinsift import queries
    from kinsift.operators import winnowing

    _tables(spark, tmp_path)
    for name in ("shared_counts", "with_zeros"):
        monkeypatch.setattr(winnowing, name, None)
    row = queries.QUERIES["retrieval_metrics"][0](spark, str(tmp_path)).first()
    assert (row.query_count, row.result_count, row.relevant_count, row.mrr, row.precision_at_k) == (3, 12, 2, round(2 / 3, 6), round(0.2 / 3, 6))


def test_retrieval_resamples_form_no_pairs(monkeypatch, spark):
    """Folds of the metrics of sets are those of the table of all pairs."""
    from kinsift import queries
    from kinsift.operators import resample, winnowing

    q, d = _random_sides(random.Random(3))
    judged = spark.createDataFrame([(a, b, 1.0) for a in q for b in list(d)[:3]] + [("other", "d01", 1.0)], _JUDGED)
    whole = spark.createDataFrame([(a, b, _similarity(s, t)) for a, s in q.items() for b, t in d.items()], "query_id string, document_id string, similarity_score double")
    key = lambda df: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())
    folds = resample.as_table(spark, resample.kfold_splits(len(q), 5, shuffle=False))
    assert key(resample.evaluate_query_folds(retrieval.set_metrics(_sides(spark, q, d), judged), 5)) == key(resample.evaluate_retrieval_resamples(whole, judged, folds))
    monkeypatch.setattr(winnowing, "with_zeros", None)
    monkeypatch.setattr(queries, "_index", lambda *_: _sides(spark, q, d))
    monkeypatch.setattr(queries, "_qrels", lambda *_: judged)
    assert queries.QUERIES["retrieval_resamples"][0](spark, "").count() == 5


@pytest.mark.parametrize(("left", "right", "dense"), [(1000, 1000, 1 << 21), (3, 7, 20)])
def test_scores_of_all_pairs_without_a_shuffle_of_them(spark, monkeypatch, left, right, dense):
    monkeypatch.setattr(set_blocks, "DENSE", dense)
    q, d = _random_sides(random.Random(4))
    df = set_blocks.scores(_sides(spark, q, d), left, right)
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(q) * len(d) and {(a, b): s for a, b, s in got} == {(a, b): _similarity(s, t) for a, s in q.items() for b, t in d.items()}
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition" not in plan.split("FlatMapGroups")[0] and "Aggregate" not in plan.split("FlatMapGroups")[0]


def _tables(spark, tmp_path):
    """Three queries, two of them judged to match a document of the same text; four documents."""
    texts = [" ".join(f"w{i}" for i in range(at, at + 12)) for at in (0, 40, 80, 120)]
    spark.createDataFrame([(f"f{i}", t) for i, t in enumerate(texts)], "file_id string, text string").write.parquet(f"{tmp_path}/files.parquet")
    spark.createDataFrame([(f"q{i}", f"f{i}") for i in range(3)], "query_id string, file_id string").write.parquet(f"{tmp_path}/queries.parquet")
    spark.createDataFrame([(f"d{i}", f"f{i}") for i in range(4)], "document_id string, file_id string").write.parquet(f"{tmp_path}/corpus.parquet")
    spark.createDataFrame([("q0", "d0", 1.0), ("q1", "d1", 2.0), ("q2", "d2", 0.0)], "query_id string, document_id string, relevance double").write.parquet(f"{tmp_path}/qrels.parquet")
