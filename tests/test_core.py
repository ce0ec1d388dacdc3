from __future__ import annotations

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinsift.functions import strings, text, tokens, vectors, weights
from kinsift.functions.labels import binary_label
from kinsift.operators import classify, code_metrics, leaderboard, resample, retrieval, winnowing
from kinsift.operators.orphans import find_orphans, parents, references
from kinsift.operators.parse_rows import parse_rows
from kinsift.plans.skew import join_counted, running_totals


def one(spark, column, *values):
    names = [f"c{i}" for i in range(len(values))]
    df = spark.createDataFrame([values], ", ".join(f"{n} {'string' if isinstance(v, (str, type(None))) else 'array<string>'}" for n, v in zip(names, values)))
    return df.select(column(*[F.col(n) for n in names])).first()[0]


# ---------------------------------------------------------------- rows that fail to parse
def test_parse_rows(spark, rows):
    lines = [
        (1, "pairs", "a,b,1,ok", "x"), (2, "pairs", 'a,b,"p","say ""hi"", twice\nand more"\r', "x"), (3, "pairs", "a,b,1", "x"), (4, "pairs", 'a,b,1,"open', "x"), (5, "pairs", 'a,b"c,1,ok', "x"),
        (6, "pairs", 'a,"b"x,1,ok', "x"), (7, "pairs", "a/1,b,1,ok", "x"), (8, "pairs", " ,b,1,ok", "x"), (9, "pairs", "a,b,2,ok", "x"), (10, "pairs", "a,b,0e0,", "x"), (11, "pairs", None, "x"),
        (12, "pairs", ",a,b,1,ok", "x"), (13, "pairs", "a\\,b,1,ok", "x"), (14, "pairs", " Not Cheating ,b,nan,ok", "x"), (15, "qrels", "q,d,1e999,", "x"), (16, "qrels", "q,d,+.5e1,c", "x"), (17, "qrels", "q,d,-0,c", "x"),
        (18, "qrels", "q,d,-1,c", "x"), (19, "qrels", "q,d,1_0,c", "x"), (20, None, "q,d", "x"), (None, "qrels", "q", "x"), (21, "pairs", "a,b,1,ok", "x"), (21, "pairs", "a,b,1,ok", "x"), (22, "pairs", "a,b,1," + "z" * 300_000, "x"), (23, "pairs", '"' + '""' * 100_000 + '",b,1,k', "x"),
    ]
    df = spark.createDataFrame(lines, "raw_id long, target string, line string, reason string")
    good, bad = parse_rows(df, "pairs")
    assert {r.raw_id: r.reason for r in bad.collect()} == {3: "column_count", 4: "bad_quoting", 5: "bad_quoting", 6: "bad_quoting", 7: "bad_value", 8: "bad_value", 9: "bad_value", 11: "column_count", 12: "column_count", 13: "bad_value", 14: "bad_value"}
    kept = {r.raw_id: (r.left_id, r.label, r.problem) for r in good.collect()}
    assert kept[2] == ("a", 1, 'say "hi", twice\nand more') and kept[10] == ("a", 0, "") and set(kept) == {1, 2, 10, 21, 22, 23}
    assert good.where("raw_id = 21").count() == 2
    good, bad = parse_rows(df, "qrels")
    assert {r.raw_id for r in good.collect()} == {16, 17}
    assert {r.raw_id: r.reason for r in bad.collect()} == {15: "bad_value", 18: "bad_value", 19: "bad_value", None: "column_count"}
    assert [x.count() for x in parse_rows(df.limit(0), "pairs")] == [0, 0]


# ---------------------------------------------------------------- references
def test_orphans(spark, rows):
    ref = [("k1", "2024-03-05 10:00:00"), (" k1 ", "2024-01-01 00:00:00"), ("k2", "2024-03-01 00:00:00"), ("k2", "2024-05-01 00:00:00"), ("k2", None), ("no", None), ("no", "2024-03-01 00:00:00"), ("no", "2024-03-09 00:00:00"), ("", None), (None, None), ("k3", "2020-01-01 00:00:00"), ("K1", "2024-03-05 10:00:00")]
    refs = spark.createDataFrame([(*r, "x") for r in ref], "fk string, at string, period string").withColumn("at", F.to_timestamp("at"))
    par = [("k1", "2024-02-01 00:00:00", None), ("k2", None, "2024-04-01 00:00:00"), (" k3", None, None), (None, None, None)]
    known = spark.createDataFrame([(*p, "x") for p in par], "id string, b string, g string, target string").withColumns({"b": F.to_timestamp("b"), "g": F.to_timestamp("g")})
    r = references(refs, "t", "fk", "at", "p")
    got = {tuple(x)[2:] for x in find_orphans(r, parents(known, "id", "b", "g", "p")).collect()}
    assert got == {("2024-01", "k1", "early"), ("2024-05", "k2", "deleted"), ("unknown", "no", "missing"), ("2024-03", "no", "missing"), ("2024-03", "K1", "missing")}
    assert {x.reason for x in find_orphans(r, parents(known.limit(0), "id", "b", "g", "p")).collect()} == {"missing"}
    assert find_orphans(references(refs.limit(0), "t", "fk", "at", "p"), parents(known, "id", "b", "g", "p")).count() == 0


def test_orphans_over_many_ranges(spark, monkeypatch):
    from kinsift.operators import orphans

    monkeypatch.setattr(orphans, "KEYS_PER_RANGE", 7)
    known = spark.range(0, 100, 2).selectExpr("concat('k', id) as id", "timestamp '2020-01-01' as b", "cast(null as timestamp) as g")
    refs = spark.range(0, 120).selectExpr("concat('k', id) as fk", "timestamp '2021-01-01' as at")
    got = {r.ref_id for r in find_orphans(references(refs, "t", "fk", "at", "p"), parents(known, "id", "b", "g", "p")).collect()}
    assert got == {f"k{i}" for i in range(120) if i % 2 or i >= 100}
    # Targets whose names begin alike, each with its own keys, few and many references a range.
    other = known.selectExpr("concat('k', cast(substr(id, 2) as int) + 1) as id", "b", "g")
    both = parents(known, "id", "b", "g", "p").unionByName(parents(other, "id", "b", "g", "pp"))
    for least in (3, 1000):
        monkeypatch.setattr(orphans, "LEAST_KEYS", least)
        two = references(refs.withColumnRenamed("fk", "one"), "t", "one", "at", "p").unionByName(references(refs, "t", "fk", "at", "pp"))
        got = {(r.field_name, r.ref_id) for r in find_orphans(two, both).collect()}
        assert got == {("one", f"k{i}") for i in range(120) if i % 2 or i >= 100} | {("fk", f"k{i}") for i in range(120) if not i % 2 or i > 100}


# ---------------------------------------------------------------- plans
def test_join_counted_splits_hot_keys(spark, monkeypatch):
    from kinsift.plans import skew

    left = spark.range(0, 1000).selectExpr("if(id < 600, 1, id) as k", "id")
    right = left.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("m"))
    want = sorted(map(tuple, left.join(right.drop("n"), "k").collect()))
    for floor in (10, 10_000):
        monkeypatch.setattr(skew, "HOT_ROWS", floor)
        assert sorted(map(tuple, join_counted(left, right, ["k"], "n").collect())) == want


def test_running_totals(spark):
    df = spark.range(0, 500).selectExpr("id % 2 as g", "xxhash64(id) as h", "id % 7 as s")
    got = [r.asDict() for r in running_totals(df, ["g"], "h", "s", "before", buckets=16).collect()]
    for g in (0, 1):
        total = 0
        for r in sorted((r for r in got if r["g"] == g), key=lambda r: r["h"]):
            assert r["before"] == total
            total += r["s"]


# ---------------------------------------------------------------- text
def test_preprocess(spark):
    run = lambda t, mode, lang=None: one(spark, lambda c: text.preprocess(c, mode, lang), t)
    assert run("int value = 1; // one\n/* two\nlines */ int second = 2; # three\n", "basic") == "int value = 1; int second = 2;"
    assert run("#include <stdio.h>\nint value = 1;", "basic") == "#include <stdio.h> int value = 1;"
    assert run("line_a  \n\n\nline_b\n", "normalize") == "line_a\nline_b"
    assert run("value = total // count  # average", "basic", "python") == "value = total // count"
    assert run("import os\nx = 'a # b'\nreturn x + 12\n", "advanced", "python") == "id1 = <STR> return id1 + <NUM>"
    assert run(None, "none") == ""
    with pytest.raises(ValueError):
        text.preprocess("t", "other")


def test_comments_respect_quotes():
    assert text.strip_block_comments_text('a "/* no */" /* yes */ b', "c") == 'a "/* no */"    b'
    assert text.strip_block_comments_text("a /* open\nrest", "c") == "a  \n"
    assert text.strip_line_comments_text("x = '// no' // yes\n-- kept", "c") == "x = '// no'\n-- kept"
    assert text.strip_line_comments_text("a -- b", "lua") == "a"
    assert text.strip_imports_text('import (\n"a"\n)\nfrom a import b\nx') == "x"


def test_tokens(spark):
    assert one(spark, tokens.code_tokens, "items[i] += value // 2") == ["items", "[", "i", "]", "+", "=", "value", "/", "/", "2"]
    assert one(spark, tokens.tranx_tokens, "AddValue(totalCount, item2)") == ["Add", "Value", "(", "total", "Count", ",", "item2", ")"]
    assert one(spark, tokens.whitespace_tokens, "") == []
    assert one(spark, lambda t: tokens.ngrams(t, 2), ["a", "b", "c"]) == ["a b", "b c"]
    assert one(spark, lambda t: tokens.ngrams(t, 4), ["a", "b", "c"]) == []


def test_labels(spark):
    for value, want in (("P", (1, None, 1)), ("0.3", (None, 1, None)), ("not cheating", (0, 0, None)), ("np", (0, 0, 0)), ("-2", (None, 0, None)), ("", (None,) * 3), ("nan", (None,) * 3)):
        assert tuple(one(spark, lambda c, v=v: binary_label(c, v), value) for v in ("strict", "adapter", "validator")) == want


# ---------------------------------------------------------------- strings
def test_levenshtein(spark):
    for a, b, want in (("", "", 1), ("", "abc", 0), ("abc", "axc", 2 / 3), ("kitten", "sitting", 4 / 7), ("é", "e", 0)):
        assert one(spark, strings.levenshtein_similarity, a, b) == pytest.approx(want)
    assert one(spark, lambda a, b: strings.levenshtein_at_least(a, b, 0.5), "kitten", "sitting") == pytest.approx(4 / 7)
    assert one(spark, lambda a, b: strings.levenshtein_at_least(a, b, 0.6), "kitten", "sitting") is None
    assert strings.weighted_similarity_of("abcd", "abxcd", 3, 1, 1) < strings.weighted_similarity_of("abcd", "abxcd")


def test_weighted_distance_by_brute_force():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 8))) for _ in "ab")
        i, d, r = (rng.randint(1, 4) for _ in range(3))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for x in range(len(a) + 1):
            for y in range(len(b) + 1):
                options = [0] if not x and not y else []
                if x:
                    options.append(table[x - 1][y] + d)
                if y:
                    options.append(table[x][y - 1] + i)
                if x and y:
                    options.append(table[x - 1][y - 1] + (0 if a[x - 1] == b[y - 1] else r))
                table[x][y] = min(options)
        assert strings.weighted_distance(a, b, i, d, r) == table[-1][-1]


def test_jaro_winkler():
    assert strings.jaro_winkler_of("MARTHA", "MARHTA") == pytest.approx(0.9611111)
    assert strings.jaro_winkler_of("DIXON", "DICKSONX") == pytest.approx(0.8133333)
    assert strings.jaro_winkler_of("", "") == 1 and strings.jaro_winkler_of("abc", "xyz") == 0
    assert strings.jaro_winkler_of("prefixAlpha", "prefixBeta", 0.25) > strings.jaro_winkler_of("prefixAlpha", "prefixBeta")


def test_tiles():
    assert strings.gst_of([], []) == 1 and strings.gst_of([], ["x"]) == 0
    assert strings.gst_of(list("abc"), list("abc")) == 1
    assert strings.gst_of(list("abcxy"), list("abcuv"), 2) == pytest.approx(0.6)
    assert strings.gst_of(list("abxcd"), list("cdyab"), 2) == pytest.approx(0.8)
    assert strings.gst_of(list("abxcd"), list("cdyab"), 3) == 0
    assert strings.ruby_string_of(["a", "b", "c"], ["a", "b"]) == pytest.approx(2 / 3)
    assert strings.ruby_string_of(["a", "b", "c"], ["a", "b"], "mean") == pytest.approx(0.6)


# ---------------------------------------------------------------- winnowing
def test_fingerprints_and_jaccard(spark):
    fp = lambda k, w: (lambda a, b: winnowing.jaccard(winnowing.fingerprints(a, k, w), winnowing.fingerprints(b, k, w)))
    assert one(spark, fp(1, 1), ["a", "b", "g"], ["a", "b", "d"]) == 0.5
    assert one(spark, fp(1, 1), list("abc"), list("bac")) == 1.0
    assert one(spark, fp(2, 1), list("abc"), list("bac")) == 0.0
    assert one(spark, fp(5, 4), ["a"], ["a"]) == 1.0
    blake = strings.blake_fingerprints_of(list("abcdefgh"), 3, 2)
    assert blake == sorted(set(blake)) and len(blake) >= 3


@pytest.mark.parametrize("longest", [2, 2000])
@pytest.mark.parametrize("least", [0.3, 0.5, 0.8])
def test_similarity_join_equals_brute_force(spark, longest, least):
    rng = random.Random(8)
    sets = {i: frozenset(rng.choices([f"v{j}" for j in range(12)], k=rng.randint(0, 7))) for i in range(70)}
    df = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "id long, fps array<string>")
    members, reps = winnowing.classes(df, "id", "fps")
    named = {}
    for i, s in sets.items():
        named.setdefault(s, i)
    assert {r.id: r.class_id for r in members.collect()} == {i: named[s] for i, s in sets.items()}
    want = {(a, b) for s, a in named.items() for t, b in named.items() if a < b and s and t and len(s & t) / len(s | t) >= least - 1e-12}
    assert {(r.left_id, r.right_id) for r in winnowing.similar_classes(reps, least, longest).collect()} == want


@pytest.mark.parametrize("n", [1, 4, 30])
def test_most_similar_goes_below_one_half(spark, n):
    sets = {1: "abcd", 2: "abce", 3: "aefghijk", 4: "kxyz", 5: "", 6: "lmnopqrstu", 7: "uvw12345", 8: "!"}
    reps = spark.createDataFrame([(i, sorted(s), len(s)) for i, s in sets.items()], "class_id long, fps array<string>, size int")
    want = sorted(((a, b, len(set(s) & set(t)) / len(set(s) | set(t))) for a, s in sets.items() for b, t in sets.items() if a < b and set(s) & set(t)), key=lambda r: (-r[2], r[:2]))
    assert [tuple(r) for r in winnowing.best_pairs(winnowing.most_similar(reps, n), n).collect()] == want[:n]


@pytest.mark.parametrize("n", [1, 3, 12, 500])
def test_collection_by_classes_equals_all_pairs(spark, n):
    from kinsift.operators import compare

    rng = random.Random(11)
    codes = ["", "a = b + c * d - e / f", "a = b + c * d - e / g", "for i in range ( 9 ) : print ( i )", "for i in range ( 9 ) : print ( j )"]
    files = spark.createDataFrame([(f"s{i:02}", codes[rng.randrange(5)] + " " * (i % 3)) for i in range(40)], "file_name string, code string")
    o = compare.Options(feature_weights={"winnowing": 1.0})
    whole = [tuple(r) for r in compare.compare_collection(files, o, 0.0, 2000).collect()]
    got = [tuple(r) for r in compare.compare_collection(files, o, 0.3, n).collect()]
    assert got == [r for r in whole if r[2] >= 0.3][:n]


# ---------------------------------------------------------------- vectors and weights
def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0], [0.0, 0.0])], "a array<double>, b array<double>, z array<double>")
    got = {f: df.select(vectors.similarity("a", "b", f), vectors.similarity("a", "b", f, True)).first() for f in vectors.FUNCTIONS}
    assert [tuple(got[f]) for f in vectors.FUNCTIONS] == [(0, 0), (0, 0), pytest.approx((-(2**0.5), 1 / (1 + 2**0.5))), pytest.approx((-2, 1 / 3))]
    assert df.select(vectors.similarity("a", "z")).first()[0] == 0
    same = spark.createDataFrame([("b a b", "a b b")], "x string, y string")
    assert same.select(vectors.dot(vectors.hash_vector("x", 64), vectors.hash_vector("y", 64))).first()[0] == pytest.approx(1)
    multi = spark.createDataFrame([([[1.0, 0.0], [0.0, 2.0]],)], "m array<array<double>>")
    assert multi.select(vectors.max_sim("m", "m", True)).first()[0] == pytest.approx(1)
    assert multi.select(vectors.aggregate_chunks("m", "odd name")).first()[0] == [0.5, 1.0]


def test_weights():
    assert weights.parse_weights({"semantic": 3, "code_metric": 1}) == {"semantic": 0.75, "code_metric": 0.25}
    assert weights.parse_weights("semantic=2,code_metric=2") == {"semantic": 0.5, "code_metric": 0.5}
    for bad in ({"x": 1}, {"gst": -1}, {"gst": float("nan")}, "gst"):
        with pytest.raises(ValueError):
            weights.parse_weights(bad)
    with pytest.raises(ValueError):
        weights.check_scales({"semantic": 0.5, "gst": 0.5}, "dot", False)


# ---------------------------------------------------------------- code metrics
def test_code_metrics():
    assert code_metrics.crystal_of([], [], {}) == 0 and code_metrics.crystal_of([], ["a"], {}) == 0
    assert code_metrics.crystal_of(list("abc"), list("abc"), {}, 2) == 1
    assert code_metrics.crystal_of(list("abc"), list("cba"), {}, 1) == 1 and code_metrics.crystal_of(list("abc"), list("cba"), {}, 2) == 0
    assert code_metrics.ruby_of(list("abc"), list("cba"), 1) == 1 and code_metrics.ruby_of(list("abc"), list("cba"), 2) == 0.5
    line = "int value = 1;".split()
    assert code_metrics.bleu_of(line, line) == pytest.approx(1) and code_metrics.bleu_of(line, line, frozenset(["int"])) == pytest.approx(1)
    assert code_metrics.bleu_of(line, ["x"]) == 0
    for metric in ("tsed", "codebertscore"):
        if not code_metrics.available(metric):
            with pytest.raises(ImportError):
                code_metrics.require(metric)


# ---------------------------------------------------------------- evaluation
def _pairs(spark, rows):
    return classify.checked(spark.createDataFrame(rows, "score double, label int"))


def test_classification(spark):
    c = classify.confusion(_pairs(spark, [(0.9, 1), (0.8, 0), (0.4, 1), (0.2, 0)]), 0.5).first()
    assert (c.tp, c.fp, c.tn, c.fn, c.precision, c.recall, c.f1, c.accuracy) == (1, 1, 1, 1, 0.5, 0.5, 0.5, 0.5)
    best = classify.best_threshold(_pairs(spark, [(0.95, 1), (0.82, 1), (0.61, 0), (0.40, 0)])).first()
    assert best.threshold == 0.82 and best.f1 == 1 and best.candidate_count == 9
    perfect = _pairs(spark, [(0.95, 1), (0.82, 1), (0.3, 0), (0.1, 0)])
    assert classify.auroc(perfect).first()[0] == 1 and classify.average_precision(perfect).first()[0] == 1
    report = classify.tuning_report(_pairs(spark, [(0.5, 1)])).first()
    assert report.auroc is None and report.average_precision is None
    for bad in ([(float("nan"), 1)], [(0.5, 2)]):
        with pytest.raises(Exception, match="finite|0 or 1"):
            classify.confusion(_pairs(spark, bad)).collect()


def test_sweep_equals_counting(spark):
    rng = random.Random(6)
    data = [(rng.choice([0.1, 0.25, 0.4, 0.4, 0.9]), rng.randint(0, 1)) for _ in range(40)]
    for greater in (True, False):
        for r in classify.threshold_sweep(_pairs(spark, data), greater=greater).collect():
            hit = [y for s, y in data if (s >= r.threshold if greater else s <= r.threshold)]
            assert (r.tp, r.fp) == (sum(hit), len(hit) - sum(hit))


def test_retrieval(spark):
    results = spark.createDataFrame([("q1", "d1", 0.9), ("q1", "d2", 0.8), ("q1", "d3", 0.8), ("q3", "d1", 0.1)], "query_id string, document_id string, similarity_score double")
    qrels = spark.createDataFrame([("q1", "d2", 1.0), ("q1", "d2", 2.0), ("q1", "d9", 1.0), ("q2", "d1", 1.0), ("q1", "d3", None)], "query_id string, document_id string, relevance double")
    got = {r.query_id: r for r in retrieval.query_metrics(results, qrels, 2).collect()}
    assert (got["q1"].average_precision, got["q1"].reciprocal_rank, got["q1"].precision_at_k, got["q1"].recall_at_k) == (0.25, 0.5, 0.5, 0.5)
    assert got["q1"].ndcg_at_k == pytest.approx((2 / np.log2(3)) / (2 + 1 / np.log2(3)))
    assert got["q2"].average_precision == got["q3"].ndcg_at_k == 0
    assert retrieval.retrieval_metrics(results, qrels, 2).first().query_count == 3
    with pytest.raises(ValueError):
        retrieval.reject_duplicates(results.union(results))


def test_retrieval_over_all_pairs(spark):
    rng = random.Random(5)
    q = {f"q{i}": frozenset(rng.choices("abcdefgh", k=i % 3)) for i in range(9)}
    d = {f"d{i:02}": frozenset(rng.choices("abcdefgh", k=i % 4)) for i in range(30)}
    left, right = (spark.createDataFrame([(i, sorted(s)) for i, s in x.items()], "id string, fps array<string>") for x in (q, d))
    met = winnowing.shared_counts(left, right)
    want = {(a, b): len(s & t) / len(s | t) if s | t else 1.0 for a, s in q.items() for b, t in d.items()}
    whole = winnowing.with_zeros(met, left, right, block=7)
    got = [tuple(r) for r in whole.collect()]
    assert len(got) == len(want) and {(a, b): s for a, b, s in got} == want
    judged = [(a, b, float(rng.randint(0, 3))) for a, b in rng.sample(sorted(want), 120)] + [("q1", "gone", 2.0), ("other", "d01", 1.0)]
    qrels = spark.createDataFrame(judged, "query_id string, document_id string, relevance double")
    named = lambda x: x.toDF("query_id", "document_id", "similarity_score")
    over = left.select(F.col("id").alias("query_id")), right.select(F.col("id").alias("document_id"))
    a, b = (sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in x.collect()) for x in (retrieval.query_metrics(named(whole), qrels, 5), retrieval.query_metrics(named(met), qrels, 5, over=over)))
    assert a == b and all(r[1] == len(d) for r in a if r[0] in q)


def test_resampling(spark):
    folds = resample.kfold_splits(12, 3, shuffle=False)
    assert sorted(i for _, _, role, i in folds if role == "test") == list(range(12))
    split = resample.single_split(10, 0.6, 0.2, seed=1)
    assert [sum(r[2] == role for r in split) for role in resample.ROLES] == [6, 2, 2]
    assert split == resample.single_split(10, 0.6, 0.2, seed=1)
    grouped = resample.single_split(9, 0.5, 0.0, 0.5, groups=list("aaabbbccc"), seed=2)
    assert {("aaabbbccc"[i], r) for _, _, r, i in grouped if r == "train"}.isdisjoint({("aaabbbccc"[i], "train") for _, _, r, i in grouped if r == "test"})
    s = resample.metric_summary(spark.createDataFrame([(0.2,), (0.4,), (0.8,)], "m double"), ["m"], 0.5).first()
    assert s["mean"] == pytest.approx(0.4666667) and (s.ci_lower, s.ci_upper) == pytest.approx((0.3, 0.6))
    c = resample.compare_samples(spark.createDataFrame([(0.5, 0.6), (0.6, 0.8), (0.7, 0.7)], "a double, b double"), "a", "b").first()
    assert (c.win_count, c.loss_count, c.tie_count, c.sign_test_p_value, c.conclusion) == (2, 0, 1, 0.5, "candidate_better")


def test_bootstrap_leaves_out_rows(spark):
    items = spark.range(0, 2000).selectExpr("concat('d', id % 3) as dataset_name", "id as row_index")
    left = resample.bootstrap_left_out(items, ["dataset_name", "row_index"], 6, seed=7)
    n = {r.split: r["count"] for r in left.groupBy("split").count().collect()}
    assert sorted(n) == [f"bootstrap_{i}" for i in range(1, 7)] and all(abs(x / 2000 - math.exp(-1)) < 0.05 for x in n.values())
    assert left.groupBy("split", "dataset_name").count().count() == 18
    assert sorted(map(tuple, left.collect())) == sorted(map(tuple, resample.bootstrap_left_out(items.repartition(3), ["dataset_name", "row_index"], 6, seed=7).collect()))


def test_bootstrap_query_evaluates_pairs_of_every_data_set(spark, tmp_path):
    from kinsift.queries import QUERIES

    rows = [("a", "b", i % 2, f"x = {i}", f"y = {i}", d, i) for d in ("named", "other") for i in range(300)]
    spark.createDataFrame(rows, "left_id string, right_id string, label int, left_text string, right_text string, dataset_name string, row_index long").write.parquet(f"{tmp_path}/pairs.parquet")
    got = QUERIES["bootstrap_eval"][0](spark, str(tmp_path)).collect()
    assert len(got) == 20 and all(150 < r.pair_count < 300 for r in got)


def test_leaderboard(spark):
    rows = spark.createDataFrame([("pair", "d", "exact", "f1", 1.0, 2), ("pair", "d", "same", "f1", 1.0, 2), ("pair", "d", "none", "f1", float("nan"), 2), ("pair", "d", "inverse", "f1", 0.0, 2)], "task_family string, dataset_name string, algorithm_name string, metric string, score double, sample_count int")
    assert {r.algorithm_name: r["rank"] for r in leaderboard.ranked(rows).collect()} == {"exact": 1, "same": 1, "inverse": 3, "none": 4}


# ---------------------------------------------------------------- sources
def test_round_trip_and_readers(spark, tmp_path):
    from kinsift.sources import readers, registry, sinks

    files = spark.createDataFrame([("007", "x = 1\r\n"), ("b", None)], "file_id string, text string")
    pairs = spark.createDataFrame([("007", "b", "1")], "left_id string, right_id string, label string")
    sinks.write_pair_dataset(files, pairs, {"name": "n", "task_type": "plagiarism"}, str(tmp_path / "d"))
    got_files, got_pairs, meta = readers.read_pair_dataset(spark, str(tmp_path / "d"))
    assert {(r.file_id, r.text) for r in got_files.collect()} == {("007", "x = 1\r\n"), ("b", "")}
    assert [tuple(r)[:3] for r in got_pairs.collect()] == [("007", "b", "1")] and meta["name"] == "n"
    import zipfile

    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("a/b.py", b"ok\xff")
        z.writestr(".hidden/c.py", "no")
    assert [tuple(r) for r in readers.read_collection(spark, str(tmp_path / "z.zip")).collect()] == [("a/b.py", "ok")]
    with zipfile.ZipFile(tmp_path / "bad.zip", "w") as z:
        z.writestr("../out.py", "no")
    with pytest.raises(ValueError):
        readers.extract_zip(str(tmp_path / "bad.zip"), str(tmp_path / "out"))
    with pytest.raises(ValueError):
        readers.contained(str(tmp_path), "../x")
    (tmp_path / "m.json").write_text('{"dataset": {"path": "d", "options": {"api_key": "1"}}}')
    with pytest.raises(ValueError):
        registry.load_manifest(str(tmp_path / "m.json"))
    assert "&lt;b&gt;" in sinks.html_table(spark.createDataFrame([("<b>",)], "v string"), "t")


def test_explanations_need_no_label(spark, tmp_path):
    from kinsift.queries import QUERIES

    rows = [("d", i, label, "x = 1", "x = 1", "k") for i, label in enumerate((1, 0, None, 7))] + [("d", 9, 0, None, "x = 1", "k")]
    spark.createDataFrame(rows, "dataset_name string, row_index long, label int, left_text string, right_text string, problem string").write.parquet(f"{tmp_path}/pairs.parquet")
    assert {r.pair_id for r in QUERIES["pair_explanation"][0](spark, str(tmp_path)).collect()} == {"d/0", "d/1", "d/2", "d/3"}


def test_no_import_of_the_optional_subpackage():
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent / "kinsift"
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert not re.search(r"^\s*(?:from|import)\s+kinsift\.llm", path.read_text(), re.M), path
