"""Directories in, artifacts out: readers, adapters, checks, suites, leaderboards, algorithms and the command line."""

from __future__ import annotations

import csv
import json
import zipfile

import pytest

import cli
from kinsift.functions import strings, text
from kinsift.operators import algorithms, classify, compare, datasets, explain, resample, runs
from kinsift.sources import adapters, checks, readers, registry, reports, sinks

CODES = {"a": "def f(x):\n    return x + 1\n", "b": "def f(x):\n    return x + 1\n", "c": "class Z:\n    pass\n", "d": "print('hello')\n"}


def _write(path, content):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(content, encoding="utf-8")


def _table(path, columns, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    with path.open("w", newline="", encoding="utf-8") as f:
        csv.writer(f).writerows([columns, *rows])


@pytest.fixture()
def pair_root(tmp_path):
    root = tmp_path / "pairs"
    for k, v in CODES.items():
        _write(root / "files" / f"{k}.py", v)
    _table(root / "files.csv", ["file_id", "file_path"], [[k, f"files/{k}.py"] for k in CODES])
    _table(root / "pairs.csv", ["left_id", "right_id", "label"], [["a", "b", "1"], ["a", "c", "0"], ["c", "d", "0"], ["b", "d", "no"]])
    _write(root / "metadata.json", json.dumps({"name": "toy", "task_type": "plagiarism", "dataset_kind": "pair_classification", "api_key": "x"}))
    return str(root)


@pytest.fixture()
def retrieval_root(tmp_path):
    root = tmp_path / "retrieval"
    for k, v in CODES.items():
        _write(root / "files" / f"{k}.py", v)
    _table(root / "files.csv", ["file_id", "file_path"], [[k, f"files/{k}.py"] for k in CODES])
    _table(root / "queries.csv", ["query_id", "file_id"], [["q1", "a"], ["q2", "c"]])
    _table(root / "corpus.csv", ["document_id", "file_id"], [["d1", "b"], ["d2", "c"], ["d3", "d"]])
    _table(root / "qrels.csv", ["query_id", "document_id", "relevance"], [["q1", "d1", "1"], ["q2", "d2", "1"]])
    _write(root / "metadata.json", json.dumps({"name": "toy", "task_type": "plagiarism", "dataset_kind": "retrieval"}))
    return str(root)


EXACT = '"""Exact."""\n\n\ndef prepare_dataset(dataset, **options):\n    return {"bonus": options.get("bonus", 0)}\n\n\ndef score_pair(code_a, code_b, dataset_context=None, **options):\n    return (1.0 if code_a == code_b else 0.0) + dataset_context["bonus"]\n'


# ---------------------------------------------------------------- command line
def run(spark, capsys, *args):
    code = cli.main([str(a) for a in args], spark)
    return code, [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]


def test_compare_and_suite(spark, capsys, tmp_path):
    root = tmp_path / "code"
    for k, v in CODES.items():
        _write(root / f"{k}.py", v)
    _, rows = run(spark, capsys, "compare", root, "--weights", "levenshtein=1", "--threshold", 0.9, "--reproducibility-out", tmp_path / "again.json")
    assert rows == [{"file_name_1": "a.py", "file_name_2": "b.py", "similarity_score": 1.0}]
    assert json.loads((tmp_path / "again.json").read_text())["source"]["file_count"] == 4
    _write(tmp_path / "alg.py", EXACT)
    _, rows = run(spark, capsys, "compare", root, "--algorithm", tmp_path / "alg.py", "--num", 2, "--algorithm-options", '{"bonus": 1}')
    assert [(r["file_name_1"], r["similarity_score"]) for r in rows] == [("a.py", 2.0), ("a.py", 1.0)]
    _write(tmp_path / "suite.json", json.dumps({"runs": [{"run_name": "lev", "feature_weights": {"levenshtein": 1}}, {"run_name": "own one", "algorithm_path": "./alg.py", "num": 3}]}))
    args = ("compare-suite", root, tmp_path / "suite.json", "--summary-out", tmp_path / "s.csv", "--details-dir", tmp_path / "d", "--cache-dir", tmp_path / "cache")
    _, rows = run(spark, capsys, *args)
    assert {r["run_name"]: (r["pair_count"], r["cache_status"]) for r in rows} == {"lev": (6, "miss"), "own one": (3, "miss")}
    assert (tmp_path / "d" / "own_one.csv").exists() and "1.0000" in (tmp_path / "s.csv").read_text()
    assert {r["cache_status"] for r in run(spark, capsys, *args)[1]} == {"hit"}
    code, rows = run(spark, capsys, "similarity", root / "a.py", root / "b.py", "--weights", "levenshtein=1")
    assert rows == [{"similarity_score": 1.0}]
    for bad in ({"runs": [{"ws": 1}]}, {"runs": [{"odd_option": 1}]}, {"runs": 3}, {"runs": [{"algorithm_path": "x.py", "code_metric": "ruby"}]}):
        with pytest.raises(ValueError):
            runs.parse_runs(bad)


def test_pairs_tuning_and_calibration(spark, capsys, pair_root, tmp_path):
    _, rows = run(spark, capsys, "evaluate-pairs", pair_root, "--threshold", 0.9, "--scores-out", tmp_path / "s.csv", "--metrics-out", tmp_path / "m.json")
    assert (rows[0]["tp"], rows[0]["fp"], rows[0]["tn"], rows[0]["fn"]) == (1, 0, 3, 0)
    assert len((tmp_path / "s.csv").read_text().splitlines()) == 5 and json.loads((tmp_path / "m.json").read_text())["f1"] == 1
    for command in ("tune-threshold", "calibration-report"):
        _, rows = run(spark, capsys, command, pair_root, "--output", tmp_path / command)
        assert rows[0]["auroc"] == 1 and rows[0]["average_precision"] == 1 and rows[0]["threshold"] == 1
        assert len(list((tmp_path / command).iterdir())) == 6
    one = spark.createDataFrame([(0.2, 1), (0.9, 1)], "score double, label int")
    assert classify.calibration_report(classify.checked(one), one_class=True)["summary"].first().auroc is None
    with pytest.raises(ValueError):
        classify.calibration_report(classify.checked(one))


def test_retrieval_leaderboard_and_registry(spark, capsys, pair_root, retrieval_root, tmp_path):
    _, rows = run(spark, capsys, "evaluate-retrieval", retrieval_root, "--num", 1, "--scores-out", tmp_path / "s.csv", "--metrics-out", tmp_path / "m.json")
    assert [rows[0][c] for c in ("query_count", "result_count", "relevant_count", "map", "mrr", "ndcg_at_k")] == [2, 6, 2, 1, 1, 1]
    _write(tmp_path / "exact.py", EXACT)
    _write(tmp_path / "inverse.py", "def score_pair(code_a, code_b):\n    return 0.0 if code_a == code_b else 1.0\n")
    manifest = {"name": "board", "pair_metrics": ["f1", "auroc"], "datasets": [{"name": "p", "task": "pair", "path": "pairs", "threshold": 0.9}, {"name": "r", "task": "retrieval", "path": "retrieval", "k": 1}], "algorithms": [{"name": "exact", "algorithm_path": "./exact.py"}, {"name": "inverse", "algorithm_path": "./inverse.py"}, "Winnowing"]}
    _write(tmp_path / "board.json", json.dumps(manifest))
    _, rows = run(spark, capsys, "leaderboard", tmp_path / "board.json", "--output", tmp_path / "out", "--registry", tmp_path / "reg.json", "--run-id", "one")
    by = {(r["task_family"], r["algorithm_name"], r["metric"]): (r["rank"], r["mean_score"]) for r in rows}
    assert by["pair", "exact", "f1"] == (1, 1) and by["pair", "inverse", "f1"] == (3, 0) and by["retrieval", "exact", "mean_average_precision"] == (1, 1)
    assert len(list((tmp_path / "out").iterdir())) == 6
    cards = json.loads((tmp_path / "out" / "leaderboard.json").read_text())["cards"]
    assert cards["datasets"][0]["metadata"]["api_key"] == "<redacted>" and cards["datasets"][0]["counts"]["positive_pairs"] == 1
    run(spark, capsys, "benchmark-registry", "add", tmp_path / "reg.json", "--report", tmp_path / "out" / "leaderboard.json", "--run-id", "two")
    _, rows = run(spark, capsys, "benchmark-registry", "list", tmp_path / "reg.json")
    assert sorted(r["run_id"] for r in rows) == ["one", "two"] and all(r["algorithm_count"] == 3 for r in rows)
    _, rows = run(spark, capsys, "benchmark-registry", "compare", tmp_path / "reg.json")
    assert rows and all(r["delta"] == 0 for r in rows)
    for bad in ({}, {"datasets": [{"task": "odd", "path": "x"}], "algorithms": ["GST"]}, {"datasets": [{"task": "pair", "path": "x"}], "algorithms": ["none"]}, {**manifest, "pair_metrics": ["odd"]}):
        with pytest.raises(ValueError):
            runs.parse_leaderboard(bad)
    assert len(runs.PRESETS.names()) == 8


def test_datasets_maps_and_explanations(spark, capsys, pair_root, retrieval_root, tmp_path):
    _, rows = run(spark, capsys, "datasets", "list")
    assert [r["name"] for r in rows] == ["conplag", "criminal_minds", "ipca", "irplag", "soco14", "student_code_similarity"]
    code, rows = run(spark, capsys, "datasets", "validate", pair_root, "--output", tmp_path / "v")
    assert code == 0 and len(list((tmp_path / "v").iterdir())) == 4
    _, rows = run(spark, capsys, "visualize-dataset", pair_root, "--dim", 32)
    assert {r["document_id"]: (r["role"], r["pair_count"]) for r in rows} == {"a": ("submission", 2), "b": ("submission", 2), "c": ("submission", 2), "d": ("submission", 2)}
    run(spark, capsys, "visualize-dataset", retrieval_root, "--dim", 32, "--output", tmp_path / "map")
    assert "<svg" in (tmp_path / "map" / "dataset_map.html").read_text()
    assert {p["role"] for p in json.loads((tmp_path / "map" / "dataset_map.json").read_text())["points"]} == {"query", "document", "both"}
    _, rows = run(spark, capsys, "explain-pair", pair_root, "--left-id", "b", "--right-id", "a", "--output", tmp_path / "x")
    assert [(r["match_id"], r["left_line"], r["level"]) for r in rows] == [("m1", 1, "high"), ("m2", 2, "high")] and len(list((tmp_path / "x").iterdir())) == 3
    run(spark, capsys, "init-custom-algorithm", tmp_path / "new_one.py")
    assert algorithms.resolve(str(tmp_path / "new_one.py")).score("a b", "b c") == pytest.approx(1 / 3)
    with pytest.raises(FileExistsError):
        algorithms.write_template(str(tmp_path / "new_one.py"))
    for bad in (["datasets", "odd"], ["benchmark-registry", "odd", "x"]):
        with pytest.raises(SystemExit):
            cli.main(bad, spark)


# ---------------------------------------------------------------- checks
def _codes(report):
    return {i["code"]: i["count"] for i in report["issues"]}


def test_every_kind_of_issue(spark, pair_root, retrieval_root, tmp_path):
    from pathlib import Path

    root = Path(pair_root)
    assert checks.validate_directory(spark, pair_root)["status"] == "pass"
    _write(root / "files" / "e.py", "  \n")
    (root / "files" / "folder").mkdir()
    _table(root / "files.csv", ["file_id", "file_path"], [["a", "files/a.py"], ["a", "files/b.py"], ["c", "files/e.py"], ["", "../x"], [" ", "files/none.py"], ["f", "files/folder"], ["g", ""]])
    _table(root / "pairs.csv", ["left_id", "right_id", "label"], [["a", "c", "1"], ["c", "a", "1"], ["a", "zz", "odd"], ["a", "f", ""]])
    _write(root / "metadata.json", json.dumps({"dataset_kind": "pair_classification"}))
    got = _codes(checks.validate_directory(spark, pair_root))
    want = {"missing_dataset_name": 1, "missing_task_type": 1, "missing_file_paths": 1, "unsafe_file_paths": 1, "missing_files": 1, "non_file_paths": 1, "empty_files": 1, "missing_ids": 1, "blank_ids": 1, "duplicate_ids": 2, "duplicate_pairs": 2, "missing_pair_labels": 1, "invalid_pair_labels": 1, "single_class_labels": 1, "unknown_pair_file_ids": 1}
    assert got == want
    _write(root / "pairs.csv", "")
    _write(root / "metadata.json", "[]")
    got = _codes(checks.validate_directory(spark, pair_root, "pair"))
    assert got["empty_csv"] == 1 and got["invalid_metadata"] == 1
    _write(root / "metadata.json", "{")
    _table(root / "pairs.csv", ["left_id", "label"], [["a", "1"]])
    got = _codes(checks.validate_directory(spark, pair_root, "pair"))
    assert got["invalid_metadata_json"] == 1 and got["missing_columns"] == 1
    (root / "metadata.json").unlink()
    _table(root / "pairs.csv", ["left_id", "right_id", "label"], [])
    got = _codes(checks.validate_directory(spark, pair_root, "pair"))
    assert got["missing_metadata"] == 1 and got["empty_manifest"] == 1
    assert "invalid_requested_kind" in _codes(checks.validate_directory(spark, pair_root, "odd"))
    other = Path(retrieval_root)
    _table(other / "qrels.csv", ["query_id", "document_id", "relevance"], [["q1", "d1", "0"], ["q1", "d1", "0"], ["q9", "d9", "-1"], ["q1", "d2", "x"]])
    _table(other / "queries.csv", ["query_id", "file_id"], [["q1", "zz"]])
    _table(other / "corpus.csv", ["document_id", "file_id"], [["d1", "yy"], ["d2", "a"]])
    got = _codes(checks.validate_directory(spark, retrieval_root))
    assert got == {"duplicate_qrels": 2, "unknown_query_file_ids": 1, "unknown_corpus_file_ids": 1, "unknown_qrel_query_ids": 1, "unknown_qrel_document_ids": 1, "invalid_qrel_relevance": 2, "no_positive_qrels": 1}
    _write(other / "metadata.json", json.dumps({"name": "x", "task_type": "y", "dataset_kind": "pair_classification"}))
    got = _codes(checks.validate_directory(spark, retrieval_root, "retrieval"))
    assert got["metadata_kind_mismatch"] == 1
    (other / "metadata.json").unlink()
    _table(other / "pairs.csv", ["left_id", "right_id", "label"], [])
    assert "ambiguous_dataset_kind" in _codes(checks.validate_directory(spark, retrieval_root))
    (tmp_path / "none").mkdir()
    assert "unknown_dataset_kind" in _codes(checks.validate_directory(spark, str(tmp_path / "none")))
    assert "missing_manifest" in _codes(checks.validate_directory(spark, str(tmp_path / "none"), "pair"))
    assert len(checks.MESSAGES) == 34


# ---------------------------------------------------------------- adapters
def test_layouts_of_folders(spark, tmp_path):
    ir = tmp_path / "ir"
    for p in ("case-01/original/o.java", "case-01/plagiarized/p1.java", "case-01/non-plagiarized/n1.java", "case-02/original/o.java", "case-02/plagiarized/p.java"):
        _write(ir / "IR-Plag-Dataset" / p, p)
    adapters.adapt(spark, "irplag_pair", str(ir), str(tmp_path / "ir_out"))
    files, pairs, meta = readers.read_pair_dataset(spark, str(tmp_path / "ir_out"))
    assert sorted(r.label for r in pairs.collect()) == ["0", "1", "1"] and meta["adapter"] == "irplag_pair" and files.where("text is null").count() == 0
    adapters.adapt(spark, "irplag_retrieval", str(ir), str(tmp_path / "ir_ret"))
    _, queries, corpus, qrels, _ = readers.read_retrieval_dataset(spark, str(tmp_path / "ir_ret"))
    assert (queries.count(), corpus.count(), sorted(r.relevance for r in qrels.collect())) == (3, 2, [0, 1, 1])
    cp = tmp_path / "cp" / "versions"
    for v, n in (("1", "s1"), ("1", "s2"), ("2", "s1"), ("2", "s3")):
        _write(cp / f"version_{v}" / f"{n}.java", f"{v}{n}")
    _table(tmp_path / "cp" / "labels.csv", ["sub1", "sub2", "problem", "verdict"], [["s1", "s2", "1", "1"], ["s1", "s3", "2", "0"], ["s1", "zz", "1", "1"]])
    adapters.adapt(spark, "conplag_pair", str(tmp_path / "cp"), str(tmp_path / "cp_out"))
    files, pairs, _ = readers.read_pair_dataset(spark, str(tmp_path / "cp_out"))
    texts = {r.file_id: r.text for r in files.collect()}
    assert sorted((texts[r.left_id], texts[r.right_id], r.label) for r in pairs.collect()) == [("1s1", "1s2", "1"), ("2s1", "2s3", "0")]
    for n in ("A1-P-Sol-1.txt", "A1-P-Sol-1-v2.txt", "A1-NP-Sol-1.txt", "A1-P-Sol-2.txt", "A1-P-Sol-1.ast"):
        _write(tmp_path / "ipca" / "IPC" / "c1" / n, n)
    adapters.adapt(spark, "ipca_pair", str(tmp_path / "ipca"), str(tmp_path / "ipca_out"))
    assert sorted(r.label for r in readers.read_pair_dataset(spark, str(tmp_path / "ipca_out"))[1].collect()) == ["0"] * 5 + ["1"]
    cm = tmp_path / "cm" / "code"
    for p in ("orig/uni1-A-o1/Main.java", "orig/uni1-A-o1/lib/Util.java", "orig/uni2-B-o2/Main.java", "plag/uni1-A-o1-p1/Main.java", "plag/uni3-A-o2-p1/Main.java"):
        _write(cm / p, p)
    adapters.adapt(spark, "criminal_minds_pair", str(tmp_path / "cm"), str(tmp_path / "cm_out"))
    files, pairs, _ = readers.read_pair_dataset(spark, str(tmp_path / "cm_out"))
    assert sorted(r.label for r in pairs.collect()) == ["0", "0", "1", "1"]
    assert any(r.text == "// Main.java\norig/uni1-A-o1/Main.java\n\n// lib/Util.java\norig/uni1-A-o1/lib/Util.java" for r in files.collect())
    so = tmp_path / "so"
    for n in ("001.java", "002", "003.java"):
        _write(so / "src" / n, n)
    _write(so / "x.qrel", "001 002\n003.java 0 001.java 1\n001 zz\nodd\n")
    adapters.adapt(spark, "soco14_retrieval", str(so), str(tmp_path / "so_out"))
    _, queries, corpus, qrels, meta = readers.read_retrieval_dataset(spark, str(tmp_path / "so_out"))
    assert sorted((r.query_id, r.document_id, r.relevance) for r in qrels.collect()) == [("001", "002", 1), ("003.java", "001.java", 1)] and meta["qrel_rows_skipped_missing_files"] == 1
    assert adapters.adapt(spark, "ipca_pair", str(tmp_path / "so_out"), str(tmp_path / "copy")) == str(tmp_path / "copy")


def test_tables_of_pairs_and_judgements(spark, tmp_path):
    import hashlib

    digest = lambda x: hashlib.sha1(x.encode()).hexdigest()[:16]
    _table(tmp_path / "t" / "train.csv", ["student1_code", "student2_code", "cheating"], [["x = 1", "y = 2", "cheating"], ["z", "x = 1", "0"], ["z", "z", "odd"]])
    adapters.adapt(spark, "student_code_similarity_pair", str(tmp_path / "t"), str(tmp_path / "out"))
    _, pairs, _ = readers.read_pair_dataset(spark, str(tmp_path / "out"))
    assert sorted((r.left_id, r.right_id, r.label) for r in pairs.collect()) == sorted([("left_" + digest("x = 1"), "right_" + digest("y = 2"), "1"), ("left_" + digest("z"), "left_" + digest("x = 1"), "0")])
    _write(tmp_path / "p" / "src" / "a.c", "A")
    _write(tmp_path / "p" / "src" / "b.c", "B")
    _table(tmp_path / "p" / "pairs.tsv", ["x"], [])
    (tmp_path / "p" / "pairs.tsv").unlink()
    _table(tmp_path / "p" / "pairs.csv", ["submission_1", "submission_2", "label"], [["src\\a.c", " src/b.c ", "true"], ["./src/b.c", "src/a.c", "0.3"]])
    adapters.adapt(spark, "auto_pair_tabular", str(tmp_path / "p"), str(tmp_path / "p_out"))
    files, pairs, _ = readers.read_pair_dataset(spark, str(tmp_path / "p_out"))
    texts = {r.file_id: r.text for r in files.collect()}
    assert sorted((texts[r.left_id], texts[r.right_id], r.label) for r in pairs.collect()) == [("A", "B", "1"), ("B", "A", "1")]
    rows = spark.createDataFrame([(0, "q1", "d1", "a", "b", "1"), (1, "q1", "d1", "other", "b", "3"), (2, None, None, "t", "u", "no"), (3, "q2", "d1", "c", "b", "odd")], "n int, qid string, did string, query_text string, document_text string, relevance string")
    out = datasets.adapt_retrieval(rows, order=["n"])
    assert sorted((r.query_id, r.document_id, r.relevance) for r in out["qrels"].collect()) == sorted([("q1", "d1", 3.0), ("query_" + digest("query_" + digest("t")), "document_" + digest("document_" + digest("u")), 0.0)])
    assert {r.query_id: r.file_id for r in out["queries"].collect()}["q1"] == "query_" + digest("q1")
    assert {r.file_id: r.text for r in out["files"].collect()}["query_" + digest("q1")] == "a"
    with pytest.raises(ValueError):
        datasets.adapt_retrieval(rows.select("qid", "did"))


def test_archives_manifests_and_sources(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "archive.bin", "w") as z:
        z.writestr("a.py", "x")
        z.writestr(".hidden/b.py", "y")
    assert [tuple(r) for r in readers.read_collection(spark, str(tmp_path / "archive.bin")).collect()] == [("a.py", "x")]
    import tarfile

    with tarfile.open(tmp_path / "bad.tar", "w") as t:
        info = tarfile.TarInfo("../evil")
        t.addfile(info)
    with pytest.raises(ValueError):
        readers.extract_archive(str(tmp_path / "bad.tar"), str(tmp_path / "out"))
    readers.extract_archive(str(tmp_path / "archive.bin"), str(tmp_path / "out"))
    assert (tmp_path / "out" / "a.py").read_text() == "x"
    for n in ("train-set.csv", "test_set.csv", "z.csv"):
        _write(tmp_path / "tables" / n, "a\n1\n")
    found = [p.rpartition("/")[2] for p in readers.discover_tables(str(tmp_path / "tables"), split="test-set")]
    assert found == ["test_set.csv", "train-set.csv", "z.csv"]
    _write(tmp_path / "m.json", json.dumps({"version": 2, "dataset": {"path": "x"}}))
    with pytest.raises(ValueError):
        registry.load_manifest(str(tmp_path / "m.json"))
    _write(tmp_path / "m.json", json.dumps({"version": 1, "datasets": [{"name": "x"}]}))
    with pytest.raises(ValueError):
        registry.load_manifest(str(tmp_path / "m.json"))
    with pytest.raises(ConnectionError):
        registry.resolve_source("github", "a/b")
    assert registry.resolve_source("local", str(tmp_path), odd=1) == str(tmp_path)
    a, b = (reports.directory_fingerprint(spark, str(tmp_path / "tables")) for _ in range(2))
    assert a == b and a["file_count"] == 3
    assert reports.redacted({"a": [{"Token": 1, "path": "/x/y"}], "n": float("nan")}) == {"a": [{"Token": "<redacted>", "path": "y"}], "n": None}
    page = sinks.html_table(spark.createDataFrame([(1,), (2,)], "a int"), "<t>", limit=1)
    assert "The first 1 rows" in page and "&lt;t&gt;" in page


# ---------------------------------------------------------------- smaller pieces
def test_segments_keep_their_places():
    got = explain.segments("a\r\n\n  b", "line")
    assert got == [("a", 0, 3, 1, 1), ("", 3, 4, 2, 2), ("  b", 4, 7, 3, 3)]
    assert explain.segments("a b\nc", "token") == [("a", 0, 1, 1, 1), ("b", 2, 3, 1, 1), ("c", 4, 5, 2, 2)]
    assert explain.segments("1\n2\n3", "chunk", 2) == [("1\n2", 0, 4, 1, 2), ("3", 4, 5, 3, 3)]
    assert explain.segments("", "token") == [("", 0, 0, 1, 1)] and explain.segments("") == [("", 0, 0, 1, 1)]


def test_explanation_levels_and_unmatched(spark):
    left = "same line here\n\nalmost the same line\nsomewhat alike words\nnothing"
    right = "zzzz qqqq\nsame line here\nalmost the sane line\nsomewhat other words yes"
    one = spark.createDataFrame([("p", left, right), ("n", None, "x")], "pair_id string, left_text string, right_text string")
    got = explain.explain_pairs(one, bands=(0.95, 0.7, 0.3)).where("pair_id = 'p'").orderBy("match_id").collect()
    assert [(r.match_id, r.left_index, r.right_index, r.level) for r in got][:3] == [("m1", 0, 1, "high"), ("m2", 2, 2, "high"), ("m3", 3, 3, "low")]
    sides = explain.explained_segments(one, bands=(0.95, 0.7, 0.3)).where("pair_id = 'p'").collect()
    assert len(sides) == 9 and {(r.side, r["index"]) for r in sides if r.level == "none"} >= {("left", 1)}


def test_one_pair_call_matches_the_pair_table(spark):
    for o in (compare.Options(feature_weights={"levenshtein": 1}), compare.Options(feature_weights={"winnowing": 1, "gst": 1, "code_metric": 1}, code_metric="crystalbleu"), compare.Options(feature_weights={"semantic": 1}, chunking="sentence", chunk_size=2), compare.Options(feature_weights={"semantic": 1}, chunking="token", chunk_size=2, multivector=True), compare.Options(feature_weights={"code_metric": 1}, code_metric="ruby", bidirectional=True)):
        files = spark.createDataFrame([("a", CODES["a"]), ("d", CODES["d"])], "file_id string, text string")
        pairs = spark.createDataFrame([("a", "d")], "left_id string, right_id string")
        assert compare.calculate_similarity(spark, CODES["a"], CODES["d"], o) == pytest.approx(compare.score_pairs(files, pairs, o).first().similarity_score)
    assert compare.calculate_similarity(spark, "x", "x", compare.Options(feature_weights={"semantic": 1})) == pytest.approx(1)
    assert compare.calculate_similarity(spark, "a b c", "a b", compare.Options(feature_weights={"code_metric": 1}, code_metric="ruby")) == pytest.approx(2 / 3)
    assert compare.calculate_similarity(spark, "a b c", "a b", compare.Options(feature_weights={"code_metric": 1}, code_metric="ruby", ruby_denominator="mean")) == pytest.approx(0.6)
    for bad in ({"vector_backend": "odd"}, {"chunking": "odd"}, {"feature_weights": {"code_metric": 1}, "code_metric": "odd"}, {"feature_weights": {"code_metric": 1}, "code_metric": "ruby", "ruby_mode": "odd"}):
        with pytest.raises(ValueError):
            compare.Options(**bad)
    for absent in ({"vector_backend": "model2vec"}, {"lexical_tokenizer": "parser"}, {"feature_weights": {"code_metric": 1}, "code_metric": "ruby", "ruby_mode": "graph"}):
        with pytest.raises((ImportError, NotImplementedError)):
            compare.Options(**absent)


def test_algorithms_get_what_they_ask_for(spark):
    files = spark.createDataFrame([("a", "x  "), ("b", None)], "file_id string, text string")
    pairs = spark.createDataFrame([("a", "b", 7)], "left_id string, right_id string, extra int")
    seen = algorithms.score_pairs(files, pairs, lambda code_a, code_b, row: len(code_a) + row["extra"]).first()
    assert seen.similarity_score == 8 and algorithms.score_pairs(files, pairs, lambda code_a, code_b: len(code_a), raw=True).first().similarity_score == 3
    with pytest.raises(Exception, match="finite"):
        algorithms.score_pairs(files, pairs, lambda code_a, code_b: float("nan")).collect()
    for bad in ({"row": 1}, {" ": 1}, {"a": object()}, 3):
        with pytest.raises(ValueError):
            algorithms.checked_options(bad)
    assert algorithms.resolve("difflib:get_close_matches").name == "get_close_matches"
    with pytest.raises(ValueError):
        algorithms.resolve("json")
    assert algorithms.safe_identifier("9 x!") == "algorithm_9_x"


def test_samples(spark):
    pairs = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(50)], "row_index int, label int")
    got = datasets.sample_pairs(pairs, 20, ["row_index"]).collect()
    assert len(got) == 20 and sum(r.label for r in got) == 10
    assert datasets.sample_pairs(pairs, 30, ["row_index"]).where("label = 1").count() == 10
    queries = spark.createDataFrame([(f"q{i}",) for i in range(6)], "query_id string")
    corpus = spark.createDataFrame([(f"d{i}",) for i in range(9)], "document_id string")
    qrels = spark.createDataFrame([(f"q{i}", f"d{i}", 1.0) for i in range(6)], "query_id string, document_id string, relevance double")
    out = datasets.sample_retrieval(queries, corpus, qrels, 2, 5)
    assert (out["queries"].count(), out["corpus"].count(), out["qrels"].join(out["queries"], "query_id").count()) == (2, 5, 2)
    picked = datasets.pick_pair(spark.createDataFrame([("b", "a", 1), ("x", "y", 0)], "left_id string, right_id string, label int"), "a", "b")
    assert picked.first().label == 1


def test_resampled_metrics(spark):
    scored = spark.createDataFrame([(i, 0.1 * i, int(i >= 5)) for i in range(10)], "item_idx long, similarity_score double, label int")
    splits = resample.as_table(spark, resample.kfold_splits(10, 5, seed=3))
    rows = resample.evaluate_pair_resamples(scored, splits, 0.45).collect()
    assert len(rows) == 5 and all(r.accuracy == 1 and r.pair_count == 2 for r in rows)
    results = spark.createDataFrame([(f"q{i}", f"d{j}", 1.0 if i == j else 0.0) for i in range(4) for j in range(4)], "query_id string, document_id string, similarity_score double")
    qrels = spark.createDataFrame([(f"q{i}", f"d{i}", 1.0) for i in range(4)] + [("q9", "d0", 1.0)], "query_id string, document_id string, relevance double")
    rows = resample.evaluate_retrieval_resamples(results, qrels, resample.as_table(spark, resample.kfold_splits(4, 2, seed=1))).collect()
    assert [(r.query_count, r.map, r.relevant_count) for r in rows] == [(2, 1, 2)] * 2
    assert resample.sign_test(2, 0) == 0.5 and resample.sign_test(0, 0) == 1 and resample.sign_test(3000, 2900) == pytest.approx(0.1975, abs=2e-3)
    boots = resample.bootstrap_resamples(10, 3, seed=1, sample_size=4, prefix="b")
    assert {r[0] for r in boots} == {"b_1", "b_2", "b_3"} and sum(r[2] == "train" for r in boots) == 12
    for bad in (lambda: resample.bootstrap_resamples(1), lambda: resample.kfold_splits(3, 5), lambda: resample.single_split(4, 0.9, 0.9), lambda: resample.kfold_splits(4, 2, labels=[1], groups=None)):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(Exception, match="finite"):
        resample.metric_summary(spark.createDataFrame([(float("nan"),)], "a double"), ["a"]).collect()


def test_comment_removal_and_rounding(spark):
    assert text.remove_comments_text('"""doc"""\nx = "# no"  # yes\n\ndef f():\n    "doc"\n    return 1\n', "python") == 'x = "# no"  \ndef f():\n    return 1'
    assert text.remove_comments_text("int a; // x\n/* b\n c */ int d = '//'; // y\n", "java") == "int a; \n  int d = '//'; "
    assert text.remove_comments_text("x = 1 -- y\n--[[ a\nb ]]z", "lua") == "x = 1 \n z"
    assert text.remove_comments_text("a # b\n'#' c", "ruby") == "a \n'#' c" and text.remove_comments_text("def (", "python") == "def ("
    df = spark.createDataFrame([(0.03125,), (0.00005,), (None,)], "x double")
    assert [r[0] for r in df.select(strings.py_round("x")).collect()] == [0.0312, 0.0001, None]


def test_sizes_rule_out_no_pair(spark):
    files = spark.createDataFrame([(f"f{i}", "a b c d " * (i % 4) + "x" * i) for i in range(14)], "file_name string, code string")
    for w in ({"levenshtein": 1}, {"levenshtein": 2, "gst": 1, "winnowing": 1}, {"jaro_winkler": 1, "levenshtein": 1}):
        o = compare.Options(feature_weights=w)
        whole = [tuple(r) for r in compare.compare_collection(files, o, 0.0, 500).collect()]
        assert [tuple(r) for r in compare.compare_collection(files, o, 0.6, 500).collect()] == [r for r in whole if r[2] >= 0.6]


def test_scratch_tables_go(spark):
    import os

    from kinsift import session

    df = session.cut(spark.range(3))
    root = session._SCRATCH[spark.sparkContext.applicationId]
    assert os.path.isdir(root.replace("file://", "")) and df.count() == 3
    session.clean(spark)
    assert not os.path.isdir(root.replace("file://", ""))
    assert session.cut(spark.range(3)).count() == 3
