"""Sets of fingerprints of two sides compared block by block: ranks or scores of pairs, no pair in a shuffle.

The values that both sides hold become lists of set numbers. A cell is a block of left sets against a block of right
sets; it gets the parts of the lists that meet there and counts common values in memory, a few left sets at a time.
What leaves a cell is what was asked for: a row a wanted pair, or the scores of a left id as one array."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinsift.plans.skew import numbered
from kinsift.session import cut, drop

#: Scores are whole millionths, rounded half up: what F.round(similarity, 6) gives.
MILLION = 1_000_000
#: Counts that a cell holds at once, and list entries it adds up at once.
DENSE, ENTRIES = 1 << 21, 1 << 22
#: Left sets and right sets of a cell.
LEFT_BLOCK, RIGHT_BLOCK = 2048, 1 << 18
#: Right sets of a cell whose scores all leave it.
SCORED_BLOCK = 4096
_CELL = "lb int, rb int, kind int, xs array<int>, ys array<int>, n int, k long, s long, id string, relevance double"


@dataclass(frozen=True)
class Index:
    """left: id, n (number of its set), size; right: also place (of the id among all right ids); lists: ls, rs."""

    left: DataFrame
    right: DataFrame
    lists: DataFrame
    left_sets: int
    right_sets: int
    places: int


def index(items: DataFrame, left: DataFrame, right: DataFrame) -> Index:
    """items (item, fps as fingerprints() gives them); left, right (id, item), ids unique. Equal sets have one number.
    Empty sets hold one value that no other set holds, so two of them have similarity 1."""
    named = cut(items.select("item", F.unhex(F.sha2(F.array_join("fps", "\x1f"), 256)).alias("sig"), F.greatest(F.size("fps"), F.lit(1)).alias("size"), "fps"))
    sides = [cut(df.join(named.select("item", "sig", "size"), "item").select("id", "sig", "size")) for df in (left, right)]
    marks = [df.select("sig", F.lit(not at).alias("on_left"), F.lit(bool(at)).alias("on_right")) for at, df in enumerate(sides)]
    used = numbered(marks[0].unionByName(marks[1]).groupBy("sig").agg(F.max("on_left").alias("on_left"), F.max("on_right").alias("on_right")), ["sig"], "n")[0]
    used = used.withColumn("n", F.col("n").cast("int"))
    values = named.groupBy("sig").agg(F.first("fps").alias("fps")).join(used, "sig").select("n", "on_left", "on_right", F.explode_outer("fps").alias("v"))
    both = values.select("n", "on_left", "on_right", F.unhex("v").alias("v")).repartition("v").groupBy("v")
    lists = cut(both.agg(F.collect_list(F.when(F.col("on_left"), F.col("n"))).alias("ls"), F.collect_list(F.when(F.col("on_right"), F.col("n"))).alias("rs")).where("size(ls) > 0 and size(rs) > 0").select("ls", "rs"))
    l, r = (df.join(used.select("sig", "n"), "sig").select("id", "n", "size") for df in sides)
    r, places = numbered(r, ["id"], "place")
    counts = used.agg(F.count_if("on_left"), F.count_if("on_right")).first()
    drop(named)
    return Index(cut(l), r, lists, *counts, places)


def _blocks(c: str, n: int) -> Column:
    if n == 1:
        return F.array(F.struct(F.lit(0).alias("b"), F.col(c).alias("x")))
    own = F.array_distinct(F.transform(c, lambda i: F.pmod(i, F.lit(n))))
    return F.transform(own, lambda b: F.struct(b.alias("b"), F.filter(c, lambda i: F.pmod(i, F.lit(n)) == b).alias("x")))


def _rows(df: DataFrame, kind: int, **columns: Column) -> DataFrame:
    """df as rows of cells. Columns that a kind doesn't have are empty or -1: with many nulls in sequence, Spark's
    Arrow writer goes over all of them again for every row (43 s of tasks for 1.7 million rows)."""
    empty = {"kind": F.lit(kind), "xs": F.array(), "ys": F.array(), "id": F.lit("")}
    named = [x.split(" ") for x in _CELL.split(", ")]
    return df.select([columns.get(name, empty.get(name, F.lit(-1))).cast(type_).alias(name) for name, type_ in named])


def _cells(x: Index, lefts: int, rights: int, wanted: DataFrame | None) -> DataFrame:
    """Rows of all cells: 0 parts of lists, 1 left sets (or ids, if nothing is wanted), 2 right ids, 3 wanted pairs."""
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    at = lambda c, n: F.pmod(F.col(c), F.lit(n))
    parts = x.lists.select(F.explode(_blocks("ls", lefts)).alias("l"), "rs").select("l", F.explode(_blocks("rs", rights)).alias("r"))
    out = _rows(parts, 0, lb=F.col("l.b"), rb=F.col("r.b"), xs=F.col("l.x"), ys=F.col("r.x"))
    own = x.left.withColumn("rb", every(rights)) if wanted is None else x.left.groupBy("n").agg(F.max("size").alias("size")).withColumn("rb", every(rights))
    out = out.unionByName(_rows(own, 1, lb=at("n", lefts), rb=F.col("rb"), n=F.col("n"), s=F.col("size"), **({"id": F.col("id")} if wanted is None else {})))
    out = out.unionByName(_rows(x.right.withColumn("lb", every(lefts)), 2, lb=F.col("lb"), rb=at("n", rights), n=F.col("n"), k=F.col("place"), s=F.col("size")))
    return out if wanted is None else out.unionByName(_rows(wanted, 3, lb=at("ln", lefts), rb=F.col("rb"), n=F.col("ln"), k=F.col("place"), s=F.col("score"), id=F.col("id"), relevance=F.col("relevance")))


class _Cell:
    """Left sets by number, right ids by place, and the common values of any of them."""

    def __init__(self, table: pa.Table) -> None:
        kinds = table["kind"].to_numpy()
        lists, left, right, self.wanted = (table.filter(pa.array(kinds == k)) for k in range(4))
        self.ln, first = np.unique(left["n"].to_numpy(), return_index=True)
        self.lsize = left["s"].to_numpy()[first]
        self.members = left.select(["n", "id"])
        order = np.argsort(right["k"].to_numpy())
        self.place, self.rsize = right["k"].to_numpy()[order], right["s"].to_numpy()[order]
        numbers = right["n"].to_numpy()[order]
        rn, self.set_of = np.unique(numbers, return_inverse=True)
        self.copies, self.rights = len(rn) < len(numbers), len(rn)
        (fl, ll), (fr, rl) = (self._flat(lists[c]) for c in ("xs", "ys"))
        fr = np.searchsorted(rn, fr)
        if not self.copies:  # a right id a set: sets in the order of places
            fr = np.argsort(self.set_of)[fr]
        self.entries, self.lens, self.starts = fr, rl, np.cumsum(rl) - rl
        fl = np.searchsorted(self.ln, fl)
        order = np.argsort(fl, kind="stable")
        self.lists_of = np.repeat(np.arange(len(ll)), ll)[order]
        self.begin = np.searchsorted(fl[order], np.arange(len(self.ln) + 1))
        self.work = np.concatenate([[0], np.cumsum(rl[self.lists_of])])[self.begin]

    @staticmethod
    def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
        a = column.combine_chunks()
        a = a if isinstance(a, pa.ListArray) else pa.concat_arrays(a.chunks) if a.num_chunks else pa.array([], column.type)
        return a.flatten().to_numpy(zero_copy_only=False).astype(np.int64), a.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)

    def groups(self, most: int = 1024) -> Iterator[tuple[int, int]]:
        """Ranges of left sets whose counts and list entries fit in memory (one set at least)."""
        width, at = min(most, max(1, DENSE // max(1, len(self.place), self.rights))), 0
        while at < len(self.ln):
            end = max(at + 1, min(at + width, int(np.searchsorted(self.work, self.work[at] + ENTRIES, "right")) - 1))
            end = min(end, len(self.ln))
            yield at, end
            at = end

    def counts(self, at: int, end: int) -> np.ndarray:
        """Common values of the left sets at..end with every right id: a row a left set, flat."""
        own = self.lists_of[self.begin[at] : self.begin[end]]
        rows = np.repeat(np.arange(end - at), np.diff(self.begin[at : end + 1])) * self.rights
        lens = self.lens[own]
        to = np.cumsum(lens)
        entry = np.arange(to[-1] if len(to) else 0) + np.repeat(self.starts[own] - (to - lens), lens)
        flat = np.bincount(self.entries[entry] + np.repeat(rows, lens), minlength=(end - at) * self.rights)
        return flat.reshape(end - at, self.rights)[:, self.set_of].ravel() if self.copies else flat

    def scores(self, c: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
        """In millionths, of counts of left sets (row) and right ids (col)."""
        union = self.lsize[row] + self.rsize[col] - c
        return (2 * MILLION * c + union) // (2 * union)


def _ahead(cell: _Cell, places: int, count: bool) -> pa.Table:
    """A row a wanted pair of the cell: its score and, if count, the right ids of the cell that are ahead of it."""
    w = cell.wanted
    left, place = np.searchsorted(cell.ln, w["n"].to_numpy()), w["k"].to_numpy()
    order = np.lexsort((place, left))
    w, left, place = w.take(pa.array(order)), left[order], place[order]
    score, ahead, width = w["s"].to_numpy().copy(), np.zeros(len(place), np.int64), len(cell.place)
    known = not len(score) or score.min() >= 0
    for at, end in cell.groups() if len(place) else ():
        a, b = np.searchsorted(left, [at, end])
        if a == b:
            continue
        counts, row, p = cell.counts(at, end), left[a:b] - at, place[a:b]
        if not known:
            col = np.searchsorted(cell.place, p)
            score[a:b] = cell.scores(counts[row * width + col], left[a:b], col)
        if not count:
            continue
        met = np.flatnonzero(counts)
        mrow = met // width
        mcol = met - mrow * width
        s = cell.scores(counts[met], mrow + at, mcol)
        if not s.all():  # rounded to 0, as if nothing were shared
            mrow, mcol, s = mrow[s > 0], mcol[s > 0], s[s > 0]
        mplace, own = cell.place[mcol], score[a:b]
        by_place = mrow * places + mplace
        later = np.searchsorted(by_place, (row + 1) * places) - np.searchsorted(by_place, row * places + p)
        by_score = np.sort((mrow * (MILLION + 1) + MILLION - s) * places + mplace)
        better = np.searchsorted(by_score, (row * (MILLION + 1) + MILLION - own) * places + p) - np.searchsorted(by_score, row * (MILLION + 1) * places)
        ahead[a:b] = np.where(own > 0, better, later)
    return pa.table({"id": w["id"], "ln": w["n"], "place": pa.array(place), "relevance": w["relevance"], "score": pa.array(score), "ahead": pa.array(ahead)})


def ranks(x: Index, judged: DataFrame, left_block: int = LEFT_BLOCK, right_block: int = RIGHT_BLOCK) -> DataFrame:
    """(query_id, rank, relevance) of judged (query_id, document_id, relevance), where every left id is ranked against
    every right id by similarity to 6 decimals, ties by the smaller id. Pairs of unknown ids don't come out.

    A pair's rank is one more than the ids ahead of it in every cell of its left set; if it scores 0, these are all
    ids with a score, and the smaller ids without."""
    lefts, rights, places = max(1, -(-x.left_sets // left_block)), max(1, -(-x.right_sets // right_block)), x.places + 1
    known = judged.join(x.left.select(F.col("id").alias("query_id"), F.col("n").alias("ln")), "query_id").join(x.right.select(F.col("id").alias("document_id"), "n", "place"), "document_id")
    wanted = known.select(F.col("query_id").alias("id"), "ln", "place", "relevance", F.pmod("n", F.lit(rights)).alias("rb"), F.lit(-1).cast("long").alias("score"))

    def run(rows: DataFrame, count: bool) -> DataFrame:
        def cell(table: pa.Table) -> pa.Table:
            return _ahead(_Cell(table), places, count)

        return _cells(x, lefts, rights, rows).groupBy("lb", "rb").applyInArrow(cell, "id string, ln int, place long, relevance double, score long, ahead long")

    if rights > 1:  # a pair's score is known in one cell and counts in all of its left set
        scored = cut(run(wanted, False)).withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(rights - 1))))
        out = run(scored, True).groupBy("id", "place").agg(F.sum("ahead").alias("ahead"), F.first("relevance").alias("relevance"), F.first("score").alias("score"))
    else:
        out = run(wanted, True)
    rank = F.col("ahead") + 1 + F.when(F.col("score") > 0, 0).otherwise(F.col("place"))
    return out.select(F.col("id").alias("query_id"), rank.alias("rank"), "relevance")


def scores(x: Index, left_block: int = LEFT_BLOCK, right_block: int = SCORED_BLOCK) -> DataFrame:
    """(query_id, document_id, similarity_score to 6 decimals) of every left id and every right id.

    A cell gives an array of scores a left id; a block's right ids, in the order of their places, are broadcast to
    where the arrays become rows. No pair is shuffled or in a table of its own."""
    lefts, rights = max(1, -(-x.left_sets // left_block)), max(1, -(-x.right_sets // right_block))

    def cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        c, rb = _Cell(table), table["rb"][0].as_py()
        number, ids = c.members["n"].to_numpy(), c.members["id"].combine_chunks()
        order = np.argsort(number, kind="stable")
        number, width = np.searchsorted(c.ln, number[order]), len(c.place)
        for at, end in c.groups() if width else ():
            counts = c.counts(at, end)
            met = np.flatnonzero(counts)
            row = met // width
            out = np.zeros(len(counts), np.int32)
            out[met] = c.scores(counts[met], row + at, met - row * width)
            a, b = np.searchsorted(number, [at, end])
            for i in range(a, b, max(1, DENSE // width)):  # ids of one set may be many
                own = slice(i, min(b, i + max(1, DENSE // width)))
                values = out.reshape(-1, width)[number[own] - at].ravel()
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(values) + 1, width), pa.int32()), pa.array(values))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(own.stop - i, rb, np.int32)), ids.take(pa.array(order[own])), lists], ["rb", "id", "scores"])

    rows = _cells(x, lefts, rights, None)
    rows = rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, min(lefts * rights, 10_000)), "lb", "rb")
    out = rows.groupBy("lb", "rb").applyInArrow(cell, "rb int, id string, scores array<int>")
    blocks = x.right.groupBy(F.pmod("n", F.lit(rights)).alias("rb")).agg(F.array_sort(F.collect_list(F.struct("place", "id")))["id"].alias("ids"))
    pairs = out.join(F.broadcast(blocks), "rb").select("id", "ids", F.posexplode("scores").alias("at", "score"))
    return pairs.select(F.col("id").alias("query_id"), F.get("ids", "at").alias("document_id"), (F.col("score") / MILLION).alias("similarity_score"))
