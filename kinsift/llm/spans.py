"""Long exact spans shared between records.

Method: MinHash banding, verification, clusters. What is banded are not paragraphs between blank lines, which begin
and end elsewhere than the shared stretches do (the README gives their measured recall), but all windows of `span`
characters, the shortest stretches asked for:
1. A window is the set of its k-grams (ANCHOR characters), its signature one MinHash: one band of one row. Two
   windows collide with the probability of their Jaccard similarity, equal ones always: the recall is 1. Neighbouring
   windows mostly have the same minimum; a run of them with one signature is a segment, about one for 30 characters,
   and all that is stored.
2. Segments that collide are verified: equal texts (a 128-bit BLAKE2 digest of the whole segment) share all their
   windows; where records meet in the signature but not in the segment (near an edit), windows are compared by text.
3. Shared windows are merged to maximal runs; records that share any are clustered by connected components.
No pairs of records are formed anywhere: a group only keeps its smallest and largest record id."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinsift.functions.ids import ref_id
from kinsift.llm.groups import group_matches, undirected
from kinsift.plans.skew import join_counted
from kinsift.session import cut

#: Length of the k-grams that anchors are chosen from.
ANCHOR = 60
#: Anchors with at most so many different segments have their windows compared in a sorted stream, larger ones
#: by an aggregation over exploded windows, which needs no group in one place.
STREAM_SEGMENTS = 2_000
#: Characters that are hashed at once in a Python worker.
CHUNK = 200_000
_B = 0x5851F42D4C957F2D


def submissions(pairs: DataFrame) -> DataFrame:
    """(file_id, text): one row a trimmed id on either side of `pairs` that has a text. Null and empty ids and
    null texts are left out; should an id come with different texts, the smallest counts."""
    sides = [pairs.select(ref_id(f"{s}_id").alias("file_id"), F.col(f"{s}_text").alias("text")) for s in ("left", "right")]
    return sides[0].unionByName(sides[1]).where("file_id is not null and text is not null").groupBy("file_id").agg(F.min("text").alias("text"))


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that scatters them."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
    x = (x ^ (x >> np.uint64(28))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(29))


def _gram_hash(codes: np.ndarray, length: int) -> np.ndarray:
    """Polynomial hashes of all substrings of the length, put together from lengths that are powers of 2."""
    power, size, out, done = codes, 1, None, 0
    while size <= length:
        if length & size:
            out = power if out is None else _join(power, out, size, done)
            done += size
        power, size = _join(power, power, size, size), size * 2
    return out


def _join(left: np.ndarray, right: np.ndarray, left_size: int, right_size: int) -> np.ndarray:
    factor = np.uint64(pow(_B, right_size, 1 << 64))
    n = max(0, len(right) - left_size)
    return left[:n] * factor + right[left_size : left_size + n]


def _window_min(x: np.ndarray, width: int) -> np.ndarray:
    size, level = 1, x
    while size * 2 <= width:
        level = np.minimum(level[:-size], level[size:])
        size *= 2
    n = len(x) - width + 1
    return np.minimum(level[:n], level[width - size : width - size + n])


def _segments_of(texts: list[str], span: int, anchor: int) -> tuple:
    """text number, first window, end of windows, signature, digest. All texts have at least `span` characters."""
    raw = memoryview("".join(texts).encode("utf-32-le", "surrogatepass"))
    codes = np.frombuffer(raw, dtype="<u4").astype(np.uint64)
    sizes = np.array([len(t) for t in texts])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    grams = _gram_hash(_mix(codes + np.uint64(0x632BE59BD9B4E019)), anchor)
    width = span - anchor + 1
    least = _window_min(_mix(grams), width)
    windows = sizes - span + 1
    doc = np.repeat(np.arange(len(texts)), windows)
    inside = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    at = starts[doc] + inside
    low = least[at]
    new = np.ones(len(at), bool)
    new[1:] = (low[1:] != low[:-1]) | (inside[1:] == 0)
    first = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
    new |= (np.arange(len(at)) - first) % width == 0  # a repeated k-gram can't make a segment longer than this
    s = np.flatnonzero(new)
    e = np.append(s[1:], len(at))
    first_char, last_char = at[s] * 4, (at[e - 1] + span) * 4
    seg = [hashlib.blake2b(raw[b:z], digest_size=16).digest() for b, z in zip(first_char.tolist(), last_char.tolist())]
    return doc[s], inside[s], inside[s] + (e - s), low[s], seg


_SEGMENT = pa.schema([("file_id", pa.string()), ("s", pa.int32()), ("e", pa.int32()), ("a", pa.int64()), ("g", pa.binary())])


def _segmenter(span: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("file_id"), batch.column("text").to_pylist()
            begin, chars = 0, 0
            for i, text in enumerate(texts):
                chars += len(text)
                if chars >= CHUNK or i == len(texts) - 1:
                    doc, s, e, a, g = _segments_of(texts[begin : i + 1], span, anchor)
                    names = ids.slice(begin, i + 1 - begin).take(pa.array(doc))
                    yield pa.RecordBatch.from_arrays([names, *(pa.array(x.astype(np.int32)) for x in (s, e)), pa.array(a.view(np.int64)), pa.array(g, pa.binary())], schema=_SEGMENT)
                    begin, chars = i + 1, 0

    return run


_VERDICT = pa.schema([("a", pa.int64()), ("g", pa.binary()), ("runs", pa.list_(pa.struct([("o", pa.int32()), ("n", pa.int32())]))), ("others", pa.list_(pa.string()))])


def _runs(hits: list[int]) -> list[dict[str, int]]:
    """Offsets in ascending order as runs of (first, number)."""
    out: list[dict[str, int]] = []
    for h in hits:
        if out and out[-1]["o"] + out[-1]["n"] == h:
            out[-1]["n"] += 1
        else:
            out.append({"o": h, "n": 1})
    return out


def _comparer(span: int, links: bool):
    """Rows (a, g, lo, hi, t) come sorted by a. For segments of one record: which of their windows others have, and
    the smallest and largest of those records for each of these windows. With `links`, for all segments."""

    def one(rows: list[tuple]) -> Iterator[tuple]:
        seen: dict[str, tuple[str, str]] = {}
        for _, _, lo, hi, t in rows:
            for i in range(len(t) - span + 1):
                w = t[i : i + span]
                old = seen.get(w)
                seen[w] = (lo, hi) if old is None else (min(lo, old[0]), max(hi, old[1]))
        for a, g, lo, hi, t in rows:
            if (links or lo == hi) and (hits := [i for i in range(len(t) - span + 1) if (x := seen[t[i : i + span]])[0] != x[1]]):
                yield a, g, _runs(hits), sorted({x for i in hits for x in seen[t[i : i + span]]} - {lo})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(batch.column(c).to_pylist() for c in ("a", "g", "lo", "hi", "t"))):
                if rows and rows[0][0] != row[0]:
                    out.extend(one(rows))
                    rows = []
                rows.append(row)
            yield pa.RecordBatch.from_pylist([dict(zip(_VERDICT.names, x)) for x in out], schema=_VERDICT)
        yield pa.RecordBatch.from_pylist([dict(zip(_VERDICT.names, x)) for x in (one(rows) if rows else ())], schema=_VERDICT)

    return run


def shared_runs(records: DataFrame, span: int = 120, anchor: int = ANCHOR) -> DataFrame:
    """(file_id, start_pos, span_chars): the maximal runs of positions of each record that lie in a stretch of at
    least `span` characters standing verbatim in another record. records: file_id (unique, not null), text.

    Characters are code points, texts count as they are and whole. Null texts and texts shorter than `span`
    share nothing. Equal texts under two ids are shared whole. Repetitions within one record don't count.
    Extra columns are not read.

    Scale: one pass over the texts, then about one row of 40 bytes for 30 characters through two shuffles. Groups
    combine on the map side to smallest and largest id; the join back splits hot segments (join_counted), and an
    anchor with more than STREAM_SEGMENTS segments goes the exploded way. Texts travel a second time only for
    segments near an edit."""
    return merge_stretches(_shared_windows(records, span, anchor, links=False)[0])


def span_clusters(records: DataFrame, span: int = 120, anchor: int = ANCHOR) -> DataFrame:
    """(file_id, cluster_id, size, links) of the records that share a stretch of `span` characters with another one:
    the smallest id of their connected component, its number of records, and with how many groups of equal or
    overlapping windows the record is linked. All but the record cluster_id names may go, if a cluster should be
    represented once; links between different records all count, through the smallest id of each group."""
    links = _shared_windows(records, span, anchor, links=True)[1]
    star = cut(links.groupBy("file_id", "other").agg(F.count("*").alias("n")))
    groups = cut(group_matches(undirected(star, "file_id", "other")))
    sizes = groups.groupBy("group_id").agg(F.count("*").alias("size"))
    own = star.groupBy("file_id").agg(F.sum("n").alias("links"))
    return groups.join(sizes, "group_id").join(own, groups.node == own.file_id, "left").select(F.col("node").alias("file_id"), F.col("group_id").alias("cluster_id"), "size", F.coalesce("links", F.lit(0)).alias("links"))


def _shared_windows(records: DataFrame, span: int, anchor: int, links: bool) -> tuple[DataFrame, DataFrame]:
    """(file_id, b, z: stretches of shared windows; file_id, other: a record and the smallest of those it shares a
    segment or, with `links`, a window with). Stretches need windows compared only where a segment has one record;
    links need them wherever an anchor has several segments."""
    docs = cut(records.where((F.char_length("text") >= span) & F.col("file_id").isNotNull()).select("file_id", "text"))
    schema = "file_id string, s int, e int, a long, g binary"
    segs = cut(docs.mapInArrow(_segmenter(span, anchor), schema))
    place = F.struct("file_id", "s", "e")
    groups = cut(segs.groupBy("a", "g").agg(F.min(place).alias("rep"), F.max("file_id").alias("hi"), F.count("*").alias("n")))
    lone = F.col("rep.file_id") == F.col("hi")
    anchors = (
        groups.groupBy("a")
        .agg(F.min("rep.file_id").alias("alo"), F.max("hi").alias("ahi"), F.count("*").alias("ng"), F.max(lone.cast("int")).alias("open"))
        .where(F.expr("alo <> ahi and (open = 1 or ng > 1)" if links else "alo <> ahi and open = 1"))
        .select("a", "ng")
    )
    unsure = groups.join(cut(anchors), "a").select("a", "g", "hi", "ng", "rep.*")
    known = unsure.join(docs, "file_id").select(
        "a", "g", F.col("file_id").alias("lo"), "hi", "ng", F.col("text").substr(F.col("s") + 1, F.col("e") - F.col("s") + (span - 1)).alias("t")
    )
    known = cut(known)
    stream = known.where(F.col("ng") <= STREAM_SEGMENTS).select("a", "g", "lo", "hi", "t")
    by_text = stream.repartition("a").sortWithinPartitions("a", "g").mapInArrow(_comparer(span, links), "a long, g binary, runs array<struct<o:int,n:int>>, others array<string>")
    offsets = F.sequence(F.lit(0), F.length("t") - span)
    many = known.where(F.col("ng") > STREAM_SEGMENTS).select("a", "g", "lo", "hi", "t", F.explode(offsets).alias("o"))
    many = many.select("a", "g", "lo", "hi", "o", F.col("t").substr(F.col("o") + 1, F.lit(span)).alias("w"))
    common = many.groupBy("a", "w").agg(F.min("lo").alias("l"), F.max("hi").alias("h")).where("l <> h")
    lone_windows = many.where(F.lit(links) | (F.col("lo") == F.col("hi"))).join(common, ["a", "w"]).groupBy("a", "g")  # the windows of one segment, bounded by its length
    by_rows = lone_windows.agg(F.sort_array(F.collect_list(F.struct("o", F.lit(1).alias("n")))).alias("runs"), F.array_union(F.collect_set("l"), F.collect_set("h")).alias("others"))
    sure = groups.where(~lone).select("a", "g", F.array(F.struct(F.lit(0).alias("o"), (F.col("rep.e") - F.col("rep.s")).alias("n"))).alias("runs"), F.lit(None).cast("array<string>").alias("others"))
    verdicts = sure.unionByName(by_text).unionByName(by_rows)
    counted = cut(verdicts.join(groups.select("a", "g", "n", F.col("rep.file_id").alias("own")), ["a", "g"]))
    hits = join_counted(segs, counted.select("a", "g", "n", "runs"), ["a", "g"], "n").select("file_id", "s", F.inline("runs"))
    stretches = hits.select("file_id", (F.col("s") + F.col("o")).alias("b"), (F.col("s") + F.col("o") + F.col("n") + (span - 1)).alias("z"))
    alike = segs.join(groups.where(~lone).select("a", "g", F.col("rep.file_id").alias("other")), ["a", "g"]).select("file_id", "other").where("file_id <> other")
    near = counted.select(F.col("own").alias("file_id"), F.explode("others").alias("other")).where("file_id <> other")
    return stretches, alike.unionByName(near)


def merge_stretches(stretches: DataFrame) -> DataFrame:
    """Overlapping or touching [b, z) of a record as one; a record's stretches are bounded by its length."""
    own = Window.partitionBy("file_id").orderBy("b", "z")
    reach = F.max("z").over(own.rowsBetween(Window.unboundedPreceding, -1))
    runs = stretches.withColumn("new", F.coalesce((F.col("b") > reach).cast("int"), F.lit(1)))
    runs = runs.withColumn("run", F.sum("new").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    merged = runs.groupBy("file_id", "run").agg(F.min("b").cast("long").alias("start_pos"), (F.max("z") - F.min("b")).cast("long").alias("span_chars"))
    return merged.select("file_id", "start_pos", "span_chars")


def shared_share(records: DataFrame, runs: DataFrame) -> DataFrame:
    """(file_id, n_chars, shared_chars, share) of every record; share is 0 for an empty text."""
    sums = runs.groupBy("file_id").agg(F.sum("span_chars").alias("shared_chars"))
    both = records.select("file_id", F.length("text").cast("long").alias("n_chars")).join(sums, "file_id", "left").fillna(0, ["shared_chars"])
    return both.withColumn("share", F.round(F.coalesce(F.try_divide("shared_chars", "n_chars"), F.lit(0.0)), 6))
