"""Pair scorers of the user: a function, a module or a file with score_pair, and an optional prepare_dataset.

A scorer is called as score_pair(left, right, ...) with those of dataset_context, row and the options that its
signature takes, in Arrow batches on the executors."""

from __future__ import annotations

import hashlib
import importlib
import importlib.metadata
import importlib.util
import inspect
import json
import math
import sys
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path
from types import ModuleType

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinsift.functions import text
from kinsift.session import cut

#: What the library itself passes; options can't be called so.
RESERVED = frozenset({"code_a", "code_b", "dataset", "prepared_texts", "dataset_context", "row", "algorithm_options"})


@dataclass(frozen=True)
class Algorithm:
    name: str
    score: Callable
    prepare: Callable | None = None
    module: str = ""
    package: str = ""
    version: str = ""
    fingerprint: dict = field(default_factory=dict)

    def metadata(self, options: dict | None = None) -> dict:
        return {"algorithm_name": self.name, "algorithm_function": getattr(self.score, "__name__", ""), "algorithm_module": self.module, "algorithm_package": self.package, "algorithm_package_version": self.version, "algorithm_options": checked_options(options), "algorithm_source_fingerprint": dict(self.fingerprint)}


def checked_options(options: dict | None) -> dict:
    """Options in the order of their names; names are not empty and not the library's own, values fit into JSON."""
    if options is not None and not hasattr(options, "items"):
        raise ValueError("algorithm options map names to JSON values")
    out = {}
    for name, value in sorted((options or {}).items(), key=lambda x: str(x[0])):
        key = str(name).strip()
        if not key or key in RESERVED:
            raise ValueError(f"no option can be called {name!r}")
        try:
            json.dumps(value)
        except (TypeError, ValueError):
            raise ValueError(f"option {key} does not fit into JSON") from None
        out[key] = value
    return out


def file_fingerprint(path: str | Path) -> dict:
    content = Path(path).read_bytes()
    return {"source_type": "file", "file_name": Path(path).name, "total_bytes": len(content), "sha256": hashlib.sha256(content).hexdigest()}


def _load(path: Path) -> ModuleType:
    name = f"kinsift_user_{path.stem}_{file_fingerprint(path)['sha256'][:8]}"
    spec = importlib.util.spec_from_file_location(name, path)
    module = importlib.util.module_from_spec(spec)
    sys.modules[name] = module
    spec.loader.exec_module(module)
    cloudpickle.register_pickle_by_value(module)  # executors don't have the file
    return module


def resolve(algorithm: Algorithm | Callable | ModuleType | str) -> Algorithm:
    """An algorithm of a callable, a module with score_pair, the path of a .py file, or "package.module" with or
    without ":function"."""
    if isinstance(algorithm, Algorithm):
        return algorithm
    if isinstance(algorithm, str) and (algorithm.endswith(".py") or Path(algorithm).is_file()):
        if not Path(algorithm).is_file():
            raise FileNotFoundError(algorithm)
        return _of_module(_load(Path(algorithm).resolve()), Path(algorithm).stem, file_fingerprint(algorithm))
    if isinstance(algorithm, str):
        name, _, function = algorithm.partition(":")
        module = importlib.import_module(name)
        return _of_function(getattr(module, function)) if function else _of_module(module, name.rpartition(".")[2])
    if isinstance(algorithm, ModuleType):
        return _of_module(algorithm, algorithm.__name__.rpartition(".")[2])
    if callable(algorithm):
        return _of_function(algorithm)
    raise TypeError("an algorithm is a function, a module or the path or name of one")


def _of_module(module: ModuleType, name: str, fingerprint: dict | None = None) -> Algorithm:
    if not callable(getattr(module, "score_pair", None)):
        raise ValueError(f"{name} has no score_pair")
    source = getattr(module, "__file__", None)
    return Algorithm(name, module.score_pair, getattr(module, "prepare_dataset", None), module.__name__, *_package(module.__name__), fingerprint or (file_fingerprint(source) if source else {}))


def _of_function(function: Callable) -> Algorithm:
    try:
        source = inspect.getsourcefile(function)
    except TypeError:
        source = None
    print_ = file_fingerprint(source) if source and Path(source).is_file() else {"source_type": "callable", "sha256": None}
    module = getattr(function, "__module__", "") or ""
    return Algorithm(getattr(function, "__name__", "algorithm"), function, None, module, *_package(module), print_)


def _package(module: str) -> tuple[str, str]:
    name = module.partition(".")[0]
    try:
        return name, importlib.metadata.version(name)
    except (importlib.metadata.PackageNotFoundError, ValueError):
        return name, ""


def _accepted(function: Callable, given: dict) -> dict:
    """Of `given`, what the function's signature takes."""
    parameters = inspect.signature(function).parameters.values()
    if any(p.kind is p.VAR_KEYWORD for p in parameters):
        return given
    names = {p.name for p in parameters if p.kind in (p.POSITIONAL_OR_KEYWORD, p.KEYWORD_ONLY)}
    return {k: v for k, v in given.items() if k in names}


def prepared(algorithm: Algorithm, dataset: object, texts: dict[str, str] | None, options: dict) -> object:
    """The context of prepare_dataset, worked out once on the driver; it travels to every task."""
    if algorithm.prepare is None:
        return None
    return algorithm.prepare(**_accepted(algorithm.prepare, {"dataset": dataset, "prepared_texts": texts, "algorithm_options": options, **options}))


def score_column(algorithm: Algorithm, left: str, right: str, row: list[str] = (), context: object = None, options: dict | None = None) -> Column:
    """A column of the algorithm's scores; one that isn't finite fails the query. row: columns it gets as `row`."""
    own = checked_options(options)
    score, names = algorithm.score, list(row)

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series, rows: pd.DataFrame) -> pd.Series:
        out = []
        for x, y, values in zip(a, b, rows.to_dict(orient="records")):
            extra = _accepted(score, {"dataset_context": context, "row": {n: values[n] for n in names}, "algorithm_options": own, **own})
            value = float(score(x or "", y or "", **extra))
            if not math.isfinite(value):
                raise ValueError("scores must be finite")
            out.append(value)
        return pd.Series(out, dtype="float64")

    return run(left, right, F.struct(*names) if names else F.struct(F.lit(0).alias("_")))


def score_pairs(files: DataFrame, pairs: DataFrame, algorithm, options: dict | None = None, preprocess_mode: str = "none", language: str | None = None, raw: bool = False) -> DataFrame:
    """pairs (left_id, right_id, ...) with similarity_score of a user's algorithm. files: file_id, text. The scorer gets
    preprocessed texts, or with `raw` the texts as they are, and the pair's own columns as `row`."""
    own = resolve(algorithm)
    texts = files.select("file_id", F.coalesce("text", F.lit("")).alias("text") if raw else text.preprocess("text", preprocess_mode, language).alias("text"))
    context = prepared(own, files, {r.file_id: r.text for r in texts.toLocalIterator()} if _wants_texts(own) else None, checked_options(options))
    both = pairs.join(texts.toDF("left_id", "_l"), "left_id").join(texts.toDF("right_id", "_r"), "right_id")
    return both.select(*pairs.columns, score_column(own, "_l", "_r", pairs.columns, context, options).alias("similarity_score"))


def _wants_texts(algorithm: Algorithm) -> bool:
    """Whether the hook asks for all texts by name: then they come to the driver, as its contract says."""
    return algorithm.prepare is not None and "prepared_texts" in inspect.signature(algorithm.prepare).parameters


def compare_collection(files: DataFrame, algorithm, options: dict | None = None, threshold: float = 0.0, number_results: int = 10, preprocess_mode: str = "none", language: str | None = None) -> DataFrame:
    """(file_name_1, file_name_2, similarity_score) of all pairs of a collection (file_name, code) that reach the
    threshold, rounded to 4 decimals, the best first, ties by the earlier names; every pair is asked for by
    definition of a scorer that nothing is known of."""
    if number_results < 1:
        raise ValueError("number_results must be at least 1")
    own = resolve(algorithm)
    texts = cut(files.select("file_name", text.preprocess("code", preprocess_mode, language).alias("code")))
    context = prepared(own, files, {r.file_name: r.code for r in texts.toLocalIterator()} if _wants_texts(own) else None, checked_options(options))
    l, r = texts.toDF("file_name_1", "_l"), texts.toDF("file_name_2", "_r")
    both = l.join(r, F.col("file_name_1") < F.col("file_name_2"))
    scored = both.select("file_name_1", "file_name_2", score_column(own, "_l", "_r", ["file_name_1", "file_name_2"], context, options).alias("s"))
    kept = scored.where(F.col("s") >= threshold).select("file_name_1", "file_name_2", F.round("s", 4).alias("similarity_score"))
    return kept.orderBy(F.desc("similarity_score"), "file_name_1", "file_name_2").limit(number_results)


TEMPLATE = '''"""{name}: a similarity of two source texts. Larger means more similar; the score must be finite."""


{prepare}def score_pair(code_a, code_b, dataset_context=None, row=None, **options):
    left, right = (code_a or "").split(), (code_b or "").split()
    if not left and not right:
        return 1.0
    shared = len(set(left) & set(right))
    return shared / max(1, len(set(left) | set(right)))
'''
_PREPARE = '''def prepare_dataset(dataset, **options):
    """What every pair may use; called once before scoring."""
    return {}


'''


def safe_identifier(value: object) -> str:
    name = "".join(c if c.isalnum() or c == "_" else "_" for c in str(value)).strip("_")
    return name if name and not name[0].isdigit() else f"algorithm_{name}"


def write_template(path: str, name: str | None = None, overwrite: bool = False, prepare: bool = True) -> Path:
    """A file to start an algorithm from."""
    target = Path(path)
    if target.exists() and not overwrite:
        raise FileExistsError(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text(TEMPLATE.replace("{name}", safe_identifier(name or target.stem)).replace("{prepare}", _PREPARE if prepare else ""), encoding="utf-8")
    return target
