"""Why two texts are similar: their lines or tokens matched one to one; and documents on a map."""

from __future__ import annotations

import bisect
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinsift.functions.ids import WHITE
from kinsift.functions.strings import distances
from kinsift.functions.vectors import hash_vector
from kinsift.operators import datasets
from kinsift.session import cut, spread

_TOKEN = re.compile(r"\w+|[^\w\s]")
MODES = ("line", "token", "chunk")
#: Pairs of segments that are compared at once.
COMPARED = 1 << 15
_SEGMENT = "struct<text:string,start:int,end:int,line:int,last:int>"


def segments(code: str, mode: str = "line", chunk_size: int = 5) -> list[tuple[str, int, int, int, int]]:
    """(text, start, end, first line, last line; lines from 1) of every line, blank ones too, of every token, or of
    chunks of lines. Offsets are those of the text as it is, line ends included; a text without any is one empty
    segment."""
    if mode not in MODES:
        raise ValueError(f"segments are {', '.join(MODES)}")
    if mode == "token":
        starts = [m.end() for m in re.finditer("\n", code)]
        line = lambda at: bisect.bisect_right(starts, at) + 1
        return [(m.group(), *m.span(), line(m.start()), line(m.end() - 1)) for m in _TOKEN.finditer(code)] or [("", 0, 0, 1, 1)]
    out, at = [], 0
    for number, raw in enumerate(code.splitlines(keepends=True) or [""], 1):
        out.append((raw.rstrip("\r\n"), at, at + len(raw), number, number))
        at += len(raw)
    if mode == "chunk":
        size = max(1, chunk_size)
        groups = [out[i : i + size] for i in range(0, len(out), size)]
        out = [("\n".join(x[0] for x in g), g[0][1], g[-1][2], g[0][3], g[-1][4]) for g in groups]
    return out


def greedy(scores: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int, float]]:
    """One-to-one matches (i, j, score) of candidates, best score first, then by i, then by j."""
    order = np.lexsort((right, left, -scores))
    used_left, used_right, out = set(), set(), []
    for i, j, s in zip(left[order].tolist(), right[order].tolist(), scores[order].tolist()):
        if i not in used_left and j not in used_right:
            used_left.add(i)
            used_right.add(j)
            out.append((i, j, s))
    return out


def _equal_lines(a: list[str], b: list[str]) -> tuple[list[tuple[int, int, float]], list[int], list[int]]:
    """Matches of equal texts that aren't empty, which greedy() takes before all others (the first of one side with the
    first of the other, and so on), and the places on both sides that are left."""
    at: dict[str, list[int]] = {}
    for j in range(len(b) - 1, -1, -1):
        if b[j]:
            at.setdefault(b[j], []).append(j)
    out, left = [], []
    for i, x in enumerate(a):
        if x and at.get(x):
            out.append((i, at[x].pop(), 1.0))
        elif x:
            left.append(i)
    return out, left, sorted(j for places in at.values() for j in places)


def match_texts(sides: list[tuple[list[str], list[str]]], low: float) -> list[list[tuple[int, int, float]]]:
    """For every pair of lists of texts the greedy() matches (i, j, similarity) of at least low, by i. The texts that
    are left after equal ones are compared for many pairs at once, COMPARED at a time."""
    found, open_, candidates = [], [], {}
    for at, (a, b) in enumerate(sides):
        out, left, right = _equal_lines(a, b)
        found.append(out)
        step = max(1, COMPARED // max(1, len(right)))
        open_ += [(at, left[i : i + step], right) for i in range(0, len(left) if right else 0, step)]
    while open_:
        part, size = [], 0
        while open_ and (not part or size + len(open_[-1][1]) * len(open_[-1][2]) <= COMPARED):
            part.append(open_.pop())
            size += len(part[-1][1]) * len(part[-1][2])
        texts, lefts, rights, firsts = [], [], [], []
        for at, left, right in part:
            first, second = len(texts), len(texts) + len(left)
            texts += [sides[at][0][i] for i in left] + [sides[at][1][j] for j in right]
            lefts.append(np.repeat(np.arange(first, second), len(right)))
            rights.append(np.tile(np.arange(second, len(texts)), len(left)))
            firsts.append(first)
        x, y = np.concatenate(lefts), np.concatenate(rights)
        lengths = np.array([len(t) for t in texts])
        longer = np.maximum(lengths[x], lengths[y])
        near = np.flatnonzero(np.minimum(lengths[x], lengths[y]) >= low * longer - 1e-9)
        x, y = x[near], y[near]
        scores = 1.0 - distances(texts, x, y) / longer[near]
        kept = np.flatnonzero(scores >= low)
        x, y, scores = x[kept], y[kept], scores[kept]
        places = np.concatenate([np.array(v) for _, left, right in part for v in (left, right)])
        bounds = np.searchsorted(x, [*firsts, len(texts)])
        for (at, _, _), begin, end in zip(part, bounds, bounds[1:]):
            candidates.setdefault(at, []).append((scores[begin:end], places[x[begin:end]], places[y[begin:end]]))
    for at, parts in candidates.items():
        found[at] += greedy(*map(np.concatenate, zip(*parts)))
    return [sorted(rows) for rows in found]


def explain_pairs(pairs: DataFrame, mode: str = "line", bands: tuple[float, float, float] = (0.85, 0.6, 0.3), chunk_size: int = 5) -> DataFrame:
    """pairs (pair_id, unique; left_text, right_text): a row a match, with both sides' index, text, start and first
    line, score to 6 decimals and level (high, medium, low by `bands`, the lowest above 0). Matches are one to one,
    best first, and numbered from the left text's beginning. Null texts match nothing.

    Equal texts are matched first, the others compared (Levenshtein similarity of the stripped texts) for many pairs at
    once in Python workers, where the greedy choice runs as well; a pair's rows are made from its own row, no join."""
    rows = _matched(pairs, mode, bands, chunk_size).select("l", "r", *_MATCH)
    a, b = F.element_at("l", F.col("m.i") + 1), F.element_at("r", F.col("m.j") + 1)
    return rows.select(
        "pair_id", "match_id", F.col("m.i").alias("left_index"), F.col("m.j").alias("right_index"), a["text"].alias("left_text"), b["text"].alias("right_text"),
        a["start"].alias("left_start"), b["start"].alias("right_start"), a["line"].alias("left_line"), b["line"].alias("right_line"), "score", "level",
    )


def explained_segments(pairs: DataFrame, mode: str = "line", bands: tuple[float, float, float] = (0.85, 0.6, 0.3), chunk_size: int = 5) -> DataFrame:
    """A row a segment of either side (left, right), matched or not: index, text, start_char, end_char, start_line,
    end_line, match_id, matched_index, score and level; without a match null, null, 0 and none."""
    parts = cut(_parts(pairs, mode, bands, chunk_size))
    matches = cut(_named(parts, bands).select(*_MATCH))
    out = None
    for side, column, own, other in (("left", "l", "i", "j"), ("right", "r", "j", "i")):
        rows = parts.select("pair_id", F.posexplode(column).alias("index", "x"))
        hits = matches.select("pair_id", F.col(f"m.{own}").alias("index"), "match_id", F.col(f"m.{other}").alias("matched_index"), "score", "level")
        both = rows.join(hits, ["pair_id", "index"], "left").select(
            "pair_id", F.lit(side).alias("side"), "index", "x.text", F.col("x.start").alias("start_char"), F.col("x.end").alias("end_char"), F.col("x.line").alias("start_line"), F.col("x.last").alias("end_line"),
            "match_id", "matched_index", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("level", F.lit("none")).alias("level"),
        )
        out = both if out is None else out.unionByName(both)
    return out


_MATCH = ("pair_id", "match_id", "m", "score", "level")


def _matched(pairs: DataFrame, mode: str, bands: tuple[float, float, float], chunk_size: int) -> DataFrame:
    return _named(_parts(pairs, mode, bands, chunk_size), bands)


def _named(parts: DataFrame, bands: tuple[float, float, float]) -> DataFrame:
    """A row a match: pair_id, l, r, match_id, m: i, j, score, then score (rounded) and level."""
    high, medium, _ = bands
    level = F.when(F.col("m.score") >= high, "high").when(F.col("m.score") >= medium, "medium").otherwise("low")
    rows = parts.select("pair_id", "l", "r", F.posexplode("m").alias("n", "m"))
    return rows.select("pair_id", "l", "r", F.concat(F.lit("m"), (F.col("n") + 1).cast("string")).alias("match_id"), "m", F.round("m.score", 6).alias("score"), level.alias("level"))


def _parts(pairs: DataFrame, mode: str, bands: tuple[float, float, float], chunk_size: int) -> DataFrame:
    """pair_id, l, r: the segments, m: the matches (i, j, score)."""
    high, medium, low = bands
    if not 0 < low <= medium <= high <= 1:
        raise ValueError("bands fall from at most 1 to above 0")
    segments("", mode)
    kinds = {"text": pa.string(), "start": pa.int32(), "end": pa.int32(), "line": pa.int32(), "last": pa.int32()}, {"i": pa.int32(), "j": pa.int32(), "score": pa.float64()}

    def column(rows: list[list[tuple]], kind: dict) -> pa.Array:
        flat = list(zip(*(x for row in rows for x in row))) or [()] * len(kind)
        values = pa.StructArray.from_arrays([pa.array(v, t) for v, t in zip(flat, kind.values())], list(kind))
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), values)

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                l, r = ([segments(t or "", mode, chunk_size) for t in part.column(c).to_pylist()] for c in ("left_text", "right_text"))
                m = match_texts([([x[0].strip(WHITE) for x in a], [x[0].strip(WHITE) for x in b]) for a, b in zip(l, r)], low)
                yield pa.RecordBatch.from_arrays([part.column("pair_id"), column(l, kinds[0]), column(r, kinds[0]), column(m, kinds[1])], ["pair_id", "l", "r", "m"])

    schema = f"pair_id {pairs.schema['pair_id'].dataType.simpleString()}, l array<{_SEGMENT}>, r array<{_SEGMENT}>, m array<struct<i:int,j:int,score:double>>"
    return spread(pairs.select("pair_id", "left_text", "right_text")).mapInArrow(run, schema)


def project(vectors: DataFrame, dims: int = 2) -> DataFrame:
    """(id, x, y) of vectors (id, embedding) on their first two principal axes.

    The covariance (dim x dim, a fixed size) is summed on the executors; axes are its leading eigenvectors with
    the largest component positive; documents are projected where they are."""
    rows = vectors.where("embedding is not null").select("id", F.col("embedding").cast("array<double>").alias("e"))

    def part(batches):
        n, total, outer = 0, None, None
        for pdf in batches:
            if len(pdf):
                m = np.stack(pdf["e"].to_numpy())
                n += len(m)
                total = m.sum(0) if total is None else total + m.sum(0)
                outer = m.T @ m if outer is None else outer + m.T @ m
        if n:
            yield pd.DataFrame([(n, total.tolist(), outer.ravel().tolist())], columns=["n", "s", "o"])

    parts = rows.select("e").mapInPandas(part, "n long, s array<double>, o array<double>").collect()  # a row a partition
    if not parts:
        return rows.select("id", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    n = sum(p.n for p in parts)
    mean = np.sum([p.s for p in parts], axis=0) / n
    cov = np.sum([p.o for p in parts], axis=0).reshape(len(mean), -1) / n - np.outer(mean, mean)
    _, axes = np.linalg.eigh(cov)
    axes = axes[:, ::-1][:, :dims]
    axes = axes * np.sign(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])])
    x, y = (F.array(*[F.lit(float(v)) for v in axes[:, i]]) for i in (0, 1))
    centred = F.zip_with("e", F.array(*[F.lit(float(v)) for v in mean]), lambda a, b: a - b)
    dot = lambda axis: F.aggregate(F.zip_with(centred, axis, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return rows.select("id", dot(x).alias("x"), dot(y).alias("y"))


def embedding_map(files: DataFrame, pairs: DataFrame | None = None, queries: DataFrame | None = None, corpus: DataFrame | None = None, dim: int = 256, metadata: DataFrame | None = None, method: str = "auto") -> DataFrame:
    """(document_id, x, y, role, pair_count and the files' other columns) of a data set's files (file_id, text): hashed
    token vectors on their first two principal axes. role is submission, or query, document, both or other in a
    retrieval data set; columns of metadata (document_id, ...) replace those of the same name."""
    if method not in ("auto", "pca"):
        raise ImportError(f"projection by {method} needs a library that isn't installed; auto and pca are here")
    vectors_ = cut(files.select(F.col("file_id").alias("id"), hash_vector("text", dim).alias("embedding")))
    points = project(vectors_).withColumnRenamed("id", "document_id")
    own = files.drop("text").withColumnRenamed("file_id", "document_id")
    out = points.join(own, "document_id", "left")
    if queries is not None and corpus is not None:
        roles = datasets.file_roles(queries, corpus).withColumnRenamed("file_id", "document_id")
        out = out.join(roles, "document_id", "left").withColumn("role", F.coalesce("role", F.lit("other")))
    else:
        out = out.withColumn("role", F.lit("submission"))
        if pairs is not None:
            counts = datasets.pair_file_counts(pairs).withColumnRenamed("file_id", "document_id")
            out = out.join(counts, "document_id", "left").fillna(0, ["pair_count"])
    return out if metadata is None else datasets.with_metadata(out, metadata)
