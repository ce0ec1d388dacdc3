from __future__ import annotations

import random

import pytest

from kinsift.llm import spans
from kinsift.llm.mixing import draw_mix, reached_shares
from kinsift.llm.packing import fillings, pack
from kinsift.llm.pieces import pieces_of, split_long
from kinsift.llm.tokens import token_count
from kinsift.llm.top_n import top_n


# ---------------------------------------------------------------- top n
def test_top_n_ties_repeats_and_bad_rows(spark, rows):
    data = [("a", f"d{i:03}", 1.0, "x") for i in range(50)] + [("a", "d010", 2.0, "x"), ("a", "d011", 0.5, "x"), ("b", "z", 0.0, None), (None, "q", 9.0, None), ("b", None, 9.0, None), ("b", "n", float("nan"), None), ("b", "i", float("inf"), None), ("b", "y", None, None)]
    df = spark.createDataFrame(data, "q string, d string, rel double, g string")  # g clashes with an inner name
    got = rows(top_n(df, "q", "d", "rel", 3))
    assert got == [("a", "d000", 1.0, 2), ("a", "d001", 1.0, 3), ("a", "d010", 2.0, 1), ("b", "z", 0.0, 1)]


def test_top_n_equals_brute_force(spark, rows):
    rng = random.Random(3)
    data = [(rng.choice("abc"), f"d{rng.randrange(400)}", rng.choice([0.0, 0.1, 0.25, 1.0, 3.5, 1e-9, 1e12, -2.0])) for _ in range(3000)]
    best = {}
    for g, i, s in data:
        best[g, i] = max(s, best.get((g, i), -9e9))
    want = []
    for g in "abc":
        own = sorted(((s, i) for (h, i), s in best.items() if h == g), key=lambda x: (-x[0], x[1]))[:7]
        want += [(g, i, s, r) for r, (s, i) in enumerate(own, 1)]
    assert rows(top_n(spark.createDataFrame(data, "g string, i string, s double"), "g", "i", "s", 7)) == sorted(want, key=repr)


def test_top_n_empty(spark):
    assert top_n(spark.createDataFrame([], "q string, d string, s double"), "q", "d", "s", 3).count() == 0


# ---------------------------------------------------------------- packing
def test_fillings_use_every_item_and_stay_within_capacity():
    rng = random.Random(5)
    for _ in range(30):
        counts = {rng.randint(1, 40): rng.randint(1, 30) for _ in range(rng.randint(1, 12))}
        used = dict.fromkeys(counts, 0)
        for own, times in fillings(counts, 40):
            assert 0 < sum(k * c for k, c in own.items()) <= 40
            for k, c in own.items():
                used[k] += c * times
        assert used == counts


def test_fillings_are_tight():
    assert sum(t for _, t in fillings({6: 10, 4: 10}, 10)) == 10
    assert sum(t for _, t in fillings({7: 2, 5: 2, 3: 2, 2: 2, 1: 2}, 9)) == 4  # 36 in containers of 9


def test_pack_divides_only_oversized_items(spark):
    sizes = [(i, s) for i, s in enumerate([10, 10, 10, 25, 0, None, 3, 3, 4, -1, 1])]
    df = spark.createDataFrame([(k, s, 1) for k, s in sizes], "doc_id long, tokens int, part_no int")
    got = pack(df, "doc_id", "tokens", 10).collect()
    load: dict = {}
    for r in got:
        if r.container_id is not None:
            load[r.container_id] = load.get(r.container_id, 0) + r.tokens
    assert max(load.values()) <= 10
    assert sorted(load) == list(range(len(load)))
    assert len(load) == 7  # 30 + 25 + 11 tokens, no less is possible
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.part_no, r.tokens))
    assert sorted(by[3]) == [(0, 10), (1, 10), (2, 5)]
    assert all(len(v) == 1 for k, v in by.items() if k != 3)
    assert [r.container_id for r in got if r.doc_id in (4, 5, 9)] == [None] * 3


def test_pack_many_equal_and_empty(spark):
    got = pack(spark.range(0, 1000).selectExpr("id as doc_id", "3 as tokens"), "doc_id", "tokens", 10)
    assert got.select("container_id").distinct().count() == 334
    assert got.groupBy("container_id").count().agg({"count": "max"}).first()[0] == 3
    assert pack(spark.createDataFrame([], "doc_id long, tokens int"), "doc_id", "tokens", 10).count() == 0


def test_token_rule(spark):
    texts = ["a_b 12!? x", "", None, "日本語 é—x", " ", "x" * 100_000]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(token_count(df.t)).collect()] == [4, 0, 0, 4, 0, 1]


# ---------------------------------------------------------------- mixing
def _mix(spark):
    docs = [(i, "big" if i % 3 else " Small ", 10 + i % 7, 1.0 + (i % 5) / 5) for i in range(600)] + [(1000, None, 5, None), (1001, "other", 5, None)]
    targets = [("big", 30, 1, "x"), ("small", 60, 2, "x"), ("absent", 10, 3, "x")]
    return spark.createDataFrame(docs, "doc_id long, source string, tokens int, weight double"), spark.createDataFrame(targets, "source string, target_pct int, max_repeats int, key string")


def test_mix_meets_budgets(spark):
    docs, targets = _mix(spark)
    draws, plan = draw_mix(docs, targets, "doc_id")
    report = {r.source: r for r in reached_shares(draws, plan).collect()}
    total = sum(10 + i % 7 for i in range(600))
    assert report["absent"].short and report["absent"].drawn == 0
    assert not report["big"].short
    assert 0 <= total * 30 // 100 - report["big"].drawn < 20
    assert 0 <= report["small"].goal - report["small"].drawn < 20
    assert max(r.repeats for r in draws.collect()) <= 2
    assert {r.source for r in draws.collect()} == {"big", "small"}
    first = sorted(map(tuple, draws.collect()))
    assert first == sorted(map(tuple, draw_mix(docs.repartition(7), targets, "doc_id")[0].collect()))


def test_mix_prefers_weight(spark):
    docs = spark.range(0, 4000).selectExpr("id as doc_id", "'s' as source", "1 as tokens", "if(id % 2 = 0, 4.0D, 1.0D) as weight")
    extra = spark.createDataFrame([(9999, "t", 12000, 1.0)], docs.schema)
    targets = spark.createDataFrame([("s", 5, 1), ("t", 95, 1)], "source string, target_pct int, max_repeats int")
    drawn = [r.doc_id for r in draw_mix(docs.union(extra), targets, "doc_id")[0].where("source = 's'").collect()]
    assert len(drawn) == 800
    assert sum(d % 2 == 0 for d in drawn) > 500


def test_mix_empty(spark):
    docs, targets = _mix(spark)
    assert draw_mix(docs.limit(0), targets, "doc_id")[0].count() == 0
    assert reached_shares(*draw_mix(docs, targets.limit(0), "doc_id")).count() == 0


# ---------------------------------------------------------------- pieces
def test_pieces_cover_overlap_and_fit():
    rng = random.Random(2)
    bits = ["a", "b ", "\n", "\r\n", "  ", "}\n", "  x = 1\n", "\t", "z" * 17, "é", "\n\n", "def f():\n"]
    for _ in range(500):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(1, 90)))
        limit, overlap = rng.randint(12, 70), rng.randint(0, 5)
        got = pieces_of(text, limit, overlap)
        assert got[0][0] == 0 and got[-1][1] == len(text)
        assert all(0 < e - b <= limit for b, e in got)
        assert all(b == max(0, before - overlap) for (_, before), (b, _) in zip(got, got[1:]))


def test_pieces_end_at_functions():
    function = "int f() {\n    a();\n    b();\n}\n\n"
    text = function * 10
    assert all(text[:e].endswith("}\n\n") for _, e in pieces_of(text, 100, 10))


def test_split_long_cases(spark, rows):
    data = [("a", "x" * 50, 1), ("a", "x" * 50, 1), ("b", "y" * 20, 2), ("c", None, 3), ("d", "", 4), (None, "w " * 30, 5)]
    got = split_long(spark.createDataFrame(data, "file_id string, text string, piece_no int"), 20, 4).collect()
    assert {r.file_id for r in got} == {"a", None}
    assert [r.piece for r in got if r.file_id == "a"].count("x" * 20) >= 2
    assert all(len(r.piece) <= 20 for r in got)
    assert split_long(spark.createDataFrame([], "file_id string, text string")).count() == 0
    with pytest.raises(ValueError):
        split_long(spark.createDataFrame([], "file_id string, text string"), 20, 10)


def test_very_long_lines():
    assert len(pieces_of("x" * 1_000_000, 2000, 200)) == 556
    assert pieces_of("", 2000, 200) == []


# ---------------------------------------------------------------- shared spans
def _brute(records, span):
    owners: dict = {}
    for name, text in records:
        for p in range(len(text or "") - span + 1):
            owners.setdefault(text[p : p + span], set()).add(name)
    out = []
    for name, text in dict(records).items():
        start = end = None
        for p in range(len(text or "") - span + 1):
            if len(owners[text[p : p + span]]) > 1:
                if end is not None and p <= end:
                    end = p + span
                else:
                    if end is not None:
                        out.append((name, start, end - start))
                    start, end = p, p + span
        if end is not None:
            out.append((name, start, end - start))
    return sorted(out)


@pytest.mark.parametrize("stream", [0, 1, 2000])
def test_shared_runs_equal_brute_force(spark, stream, monkeypatch):
    monkeypatch.setattr(spans, "STREAM_SEGMENTS", stream)
    rng = random.Random(11)
    base = ["".join(rng.choice("abcé\r\n ") for _ in range(90)) for _ in range(6)]
    records = []
    for i in range(14):
        parts = [rng.choice(base)[rng.randint(0, 40) :][: rng.randint(20, 70)] for _ in range(rng.randint(0, 5))]
        records.append((f"r{i:02}", "".join(parts)))
    records += [("same1", base[0]), ("same2", base[0]), ("rep", base[1][:25] * 4), ("aaa", "a" * 200), ("aab", "a" * 150 + "b"), ("null", None), ("empty", "")]
    df = spark.createDataFrame([(*r, "x") for r in records], "file_id string, text string, a string")
    got = sorted(tuple(r) for r in spans.shared_runs(df, 24, 12).collect())
    assert got == _brute(records, 24)


def test_shared_share_and_submissions(spark, rows):
    text = "".join(chr(97 + i % 23) + str(i) for i in range(60))
    pairs = spark.createDataFrame([(" a ", text, "b", text + "!" * 30), ("a", text, "", "zzz"), (None, text, "c", None)], "left_id string, left_text string, right_id string, right_text string")
    records = spans.submissions(pairs)
    assert {r.file_id for r in records.collect()} == {"a", "b"}
    got = {r.file_id: (r.shared_chars, r.share) for r in spans.shared_share(records, spans.shared_runs(records)).collect()}
    assert got["a"] == (len(text), 1.0)
    assert got["b"][0] == len(text)
    none = spark.createDataFrame([], "file_id string, text string")
    assert spans.shared_runs(none).count() == 0


def test_span_clusters_lose_no_link(spark):
    """Against components of all pairs that share a window, for both ways of comparing windows."""
    import random

    from kinsift.llm import spans

    draw = random.Random(5)
    base = ["".join(draw.choice("abcdefgh \n") for _ in range(90)) for _ in range(6)]
    texts = {f"r{i:02}": "".join(draw.choice(base)[draw.randrange(40) :] for _ in range(draw.randrange(1, 4))) for i in range(24)}
    texts |= {"x": texts["r00"], "empty": "", "short": "abc"}
    span, owner = 30, {}
    root = {k: k for k in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    linked = set()
    for k, t in texts.items():
        for i in range(len(t) - span + 1):
            other = owner.setdefault(t[i : i + span], k)
            if other != k:
                a, b = sorted((find(other), find(k)))
                root[b] = a
                linked |= {other, k}
    want = {k: find(k) for k in linked}
    df = spark.createDataFrame([(k, v) for k, v in texts.items()] + [("null", None)], "file_id string, text string")
    for stream in (0, 2000):
        old, spans.STREAM_SEGMENTS = spans.STREAM_SEGMENTS, stream
        try:
            got = {r.file_id: (r.cluster_id, r.size) for r in spans.span_clusters(df, span, 12).collect()}
        finally:
            spans.STREAM_SEGMENTS = old
        assert {k: c for k, (c, _) in got.items()} == want
        assert all(n == sum(c == o for o, _ in got.values()) for c, n in got.values())
    assert spans.span_clusters(df.limit(0), span, 12).count() == 0


def test_pieces_and_packing_are_checked(spark):
    from kinsift.llm.packing import check_packing, pack
    from kinsift.llm.pieces import check_pieces, split_long

    records = spark.createDataFrame([("a", "def f():\n    return 1\n" * 30), ("b", "x" * 260), ("c", "short")], "file_id string, text string")
    pieces = split_long(records, 100, 10)
    assert sorted(tuple(r)[2:] for r in check_pieces(pieces, records, 100, 10).collect()) == [(0, 0, True)] * 2
    broken = pieces.where("piece_no <> 1")
    assert all(not r.whole for r in check_pieces(broken, records, 100, 10).collect())
    items = spark.createDataFrame([(i, n) for i, n in enumerate([5, 5, 3, 2, 12, 0])], "id int, n int")
    packed = pack(items, "id", "n", 10)
    assert tuple(check_packing(packed, items, "id", "n", 10).first()) == (27, 0, 0, 0, 0)
    assert check_packing(packed.where("tokens <> 3"), items, "id", "n", 10).first().lost == -3
