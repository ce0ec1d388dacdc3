"""Vector search: a stated query set against all vectors, in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinsift.functions.vectors import score_range
from kinsift.session import spread

#: Queries of one block: their matrix is what a task holds besides its group of vectors.
BLOCK = 4096
#: Vectors of one meeting with a block.
GROUP = 2048
_GROUP = pa.schema([("vi", pa.list_(pa.int64())), ("ve", pa.list_(pa.list_(pa.float64())))])


def vector_search(vectors: DataFrame, queries: DataFrame, k: int = 10, function: str = "cosine", normalized: bool = False) -> DataFrame:
    """(query_id, vec_id, score, rank): for every row of queries (id, embedding) the k best rows of vectors (id,
    embedding), itself among them if it is there; scores to 6 decimals, ties by the smaller id. Null vectors are
    left out.

    The stated queries form blocks of about BLOCK by the hash of their id, each one row with its matrix; the vectors
    form groups of about GROUP, packed as they are read. Every block meets every group once, in one job, as products
    of two matrices; of each meeting only the k best by query are left for the ranking."""
    score_range(function)
    asked = queries.where("embedding is not null").select("id", F.col("embedding").cast("array<double>").alias("e"))
    n = max(1, -(-asked.count() // BLOCK))
    blocks = asked.groupBy(F.pmod(F.xxhash64("id"), F.lit(n)).alias("b")).agg(F.collect_list("id").alias("qi"), F.collect_list("e").alias("qe"))  # BLOCK rows each

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, GROUP):
                part = batch.slice(at, GROUP)
                yield pa.RecordBatch.from_pylist([{"vi": part.column("id").to_pylist(), "ve": part.column("e").to_pylist()}], schema=_GROUP)

    groups = spread(vectors.where("embedding is not null").select("id", F.col("embedding").cast("array<double>").alias("e"))).mapInArrow(pack, "vi array<long>, ve array<array<double>>")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, names = np.array(row["qi"]), np.array(row["vi"])
                scores = np.round(_scores(np.array(row["qe"]), np.array(row["ve"]), function, normalized), 6) + 0.0
                best = np.lexsort((np.broadcast_to(names, scores.shape), -scores), axis=1)[:, :k]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, best.shape[1])), pa.array(names[best].ravel()), pa.array(np.take_along_axis(scores, best, 1).ravel())], names=["query_id", "vec_id", "score"])

    found = groups.crossJoin(blocks).mapInArrow(meet, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _scores(q: np.ndarray, v: np.ndarray, function: str, normalized: bool) -> np.ndarray:
    if function in ("cosine", "dot"):
        out = q @ v.T
        if function == "cosine":
            norm = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(v, axis=1)[None, :]
            out = np.clip(np.divide(out, norm, out=np.zeros_like(out), where=norm > 0), -1, 1)
        return np.clip(out, 0, 1) if normalized else out
    far = np.empty((len(q), len(v)))
    for i, row in enumerate(q):
        d = v - row
        far[i] = np.sqrt((d * d).sum(1)) if function == "euclidean" else np.abs(d).sum(1)
    return 1 / (1 + far) if normalized else -far
