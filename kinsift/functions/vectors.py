"""Vectors as arrays of doubles: similarities, hashed token vectors, chunk aggregation, MaxSim."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinsift.functions.tokens import code_tokens, let

FUNCTIONS = ("cosine", "dot", "euclidean", "manhattan")
#: Least and greatest score by function and normalisation.
RANGES = {("cosine", False): (-1.0, 1.0), ("dot", False): (float("-inf"), float("inf")), ("euclidean", False): (float("-inf"), 0.0), ("manhattan", False): (float("-inf"), 0.0)}


def score_range(function: str, normalized: bool = False) -> tuple[float, float]:
    if function not in FUNCTIONS:
        raise ValueError(f"Unsupported similarity function: {function}")
    return (0.0, 1.0) if normalized else RANGES[function, False]


# Names of vector backends, and of the libraries that the others need.
BACKENDS = {"static_hash": None, "sentence_transformers": "sentence_transformers", "model2vec": "model2vec", "pylate": "pylate"}
_BACKEND_ALIASES = {"auto": "static_hash", "static": "static_hash", "hash": "static_hash", "sentence-transformers": "sentence_transformers", "colbert": "pylate"}


def backend(name: str) -> str:
    """The backend of a name; one whose library isn't installed is an error. auto is the one that needs none."""
    key = name.strip().lower()
    key = _BACKEND_ALIASES.get(key, key)
    if key not in BACKENDS:
        raise ValueError(f"there is no vector backend {name}; known: {', '.join(BACKENDS)}")
    if BACKENDS[key] is not None:
        try:
            __import__(BACKENDS[key])
        except ImportError:
            raise ImportError(f"vector backend {key} needs {BACKENDS[key]}, which isn't installed") from None
        raise NotImplementedError(f"vectors of {key} are given as a column, not made here")
    return key


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column | str, b: Column | str) -> Column:
    return _sum(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")))


def similarity(a: Column | str, b: Column | str, function: str = "cosine", normalized: bool = False) -> Column:
    """cosine within [-1, 1] and 0 for a zero vector; dot; minus the Euclidean or Manhattan distance. Normalised:
    cosine and dot cut to [0, 1], distances as 1 / (1 + d)."""
    score_range(function)
    x, y = _c(a), _c(b)
    if function == "dot":
        raw = dot(x, y)
    elif function == "cosine":
        norm = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
        raw = F.when(norm > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(x, y) / norm))).otherwise(0.0)
    elif function == "euclidean":
        raw = -F.sqrt(_sum(F.zip_with(x, y, lambda p, q: F.pow(p.cast("double") - q.cast("double"), 2))))
    else:
        raw = -_sum(F.zip_with(x, y, lambda p, q: F.abs(p.cast("double") - q.cast("double"))))
    if not normalized:
        return raw
    if function in ("cosine", "dot"):
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))
    return F.lit(1.0) / (F.lit(1.0) - raw)


def hash_vector(text: Column | str, dim: int = 256, lower: bool = True) -> Column:
    """Counts of tokens by crc32 bucket, scaled to length 1; zeros for a text without tokens."""
    dim = max(8, int(dim))
    empty = F.array_repeat(F.lit(0), dim)
    buckets = F.array_sort(F.transform(code_tokens(text, lower), lambda t: (F.crc32(F.encode(t, "UTF-8")) % dim).cast("int")))

    def count(b: Column) -> Column:
        """Where each bucket's run begins in the sorted list, and so how long it is: one pass and a merge."""
        starts = F.filter(F.transform(b, lambda x, i: F.struct(x.alias("b"), i.alias("i"))), lambda s: (s["i"] == 0) | (F.get(b, s["i"] - 1) != s["b"]))
        sizes = let(starts, lambda st: F.transform(st, lambda s, k: F.struct(s["b"].alias("b"), (F.coalesce(F.get(st, k + 1)["i"], F.size(b)) - s["i"]).alias("n"))))
        return let(F.map_from_entries(sizes), lambda m: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.element_at(m, i), F.lit(0)).cast("double")))

    return F.when(F.size(buckets) > 0, let(let(buckets, count), unit)).otherwise(F.transform(empty, lambda x: x.cast("double")))


def unit(v: Column) -> Column:
    scaled = lambda norm: F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm)).otherwise(F.transform(v, lambda x: x.cast("double")))
    return let(F.sqrt(dot(v, v)), scaled)


def max_sim(a: Column | str, b: Column | str, both_ways: bool = False) -> Column:
    """Multivectors: the mean over a's rows of the greatest cosine with b's; or the mean of both directions."""
    def one(p: Column, q: Column) -> Column:
        best = F.transform(p, lambda r: F.array_max(F.transform(q, lambda s: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(r, s))))))
        return F.when((F.size(p) > 0) & (F.size(q) > 0), _sum(best) / F.size(p)).otherwise(0.0)

    score = lambda x, y: (one(x, y) + one(y, x)) / 2 if both_ways else one(x, y)
    return let(F.transform(_c(a), unit), lambda x: let(F.transform(_c(b), unit), lambda y: score(x, y)))


def aggregate_chunks(chunks: Column | str, how: str = "mean") -> Column:
    """One vector of an array of vectors: mean, max or first; any other name means mean; no chunk gives [0.0]."""
    c = _c(chunks)
    at = lambda i: F.transform(c, lambda v: F.element_at(v, i + 1).cast("double"))
    places = F.sequence(F.lit(0), F.size(c[0]) - 1)
    if how == "max":
        some = F.transform(places, lambda i: F.array_max(at(i)))
    elif how == "first":
        some = F.transform(c[0], lambda x: x.cast("double"))
    else:
        some = F.transform(places, lambda i: _sum(at(i)) / F.size(c))
    return F.when(F.size(c) > 0, some).otherwise(F.array(F.lit(0.0)))
