"""Oversized texts cut at natural boundaries.

Method: structure-tree packing. Lines and their indentation make a tree: functions, the blocks in them, lines,
words. Siblings are merged from the left as long as they fit a piece; only a node that is larger than a piece
is descended into."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_LINE = re.compile(r"[^\r\n]*(?:\r\n|\r|\n|\Z)")
_WORD = re.compile(r"\S*\s*")
_CLOSING = re.compile(r"\s*(?:[}\])]|end\b|fi\b|done\b)")
#: Indentations deeper than this count as one level.
DEEPEST = 24


def _lines(text: str) -> list[tuple[int, int, int]]:
    """(end, rank, blank) of each line: the lower its rank, the better a cut after it. An even rank 2d is the end
    of a block or a blank line at depth d, an odd one 2d + 1 any other line end there."""
    spans, at = [], 0
    while at < len(text):
        end = _LINE.match(text, at).end()
        spans.append((at, end))
        at = end
    if not spans:
        return []
    # Depth of a line by the stack of smaller indentations around it; blank lines belong to what comes before.
    widths, stack, depths = [], [0], []
    for b, e in spans:
        body = text[b:e]
        widths.append(None if not body.strip() else len(body) - len(body.lstrip(" \t")))
    for w in widths:
        if w is None:
            depths.append(None)
            continue
        while len(stack) > 1 and stack[-1] > w:
            stack.pop()
        if w > stack[-1]:
            stack.append(w)
        depths.append(min(len(stack) - 1, DEEPEST))
    out, following = [None] * len(spans), None  # depth of the next line that isn't blank
    for i in range(len(spans) - 1, -1, -1):
        own = depths[i] if depths[i] is not None else following
        near = following if following is not None else 0
        depth = max(near, 0) if own is None else min(own, near)
        nxt = text[spans[i + 1][0] : spans[i + 1][1]] if i + 1 < len(spans) else ""
        closes = depths[i] is None or bool(_CLOSING.match(text, spans[i][0], spans[i][1]))
        natural = closes and not (nxt and (not nxt.strip() or _CLOSING.match(nxt)))
        if following is not None and own is not None and near < own and not _CLOSING.match(nxt) and nxt.strip():
            natural = True  # a block ends by indentation alone
        out[i] = (spans[i][1], 2 * depth + (0 if natural else 1))
        if depths[i] is not None:
            following = depths[i]
    return out


def cut_points(text: str, limit: int, overlap: int) -> list[int]:
    """Ends of the pieces' own parts, ascending, the last one len(text)."""
    if len(text) <= limit:
        return [len(text)] if text else []
    lines = _lines(text)
    ends = [e for e, _ in lines]
    ranks = [r for _, r in lines]
    points: list[int] = []
    start = 0  # of the piece that is being filled
    reached = 0  # end of what is known to fit into it

    def room() -> int:
        return limit if start == 0 else limit - overlap

    def close() -> None:
        nonlocal start
        if reached > start:
            points.append(reached)
            start = reached

    def take(end: int) -> bool:
        """Adds the node from `reached` to `end`, if it fits the piece or a new one. What fits neither is left
        for its children, and the piece stays open for them."""
        nonlocal reached
        if end - start <= room():
            reached = end
            return True
        if end - reached > limit - (overlap if reached else 0):
            return False
        close()
        if end - start <= room():
            reached = end
            return True
        return False

    def small(begin: int, end: int) -> None:
        """Words of a line that is too long, and hard cuts of words that are."""
        nonlocal reached
        at = begin
        while at < end:
            stop = min(_WORD.match(text, at, end).end(), end)
            if stop == at:
                stop = end
            if not take(stop):
                while stop - start > room():
                    edge = start + room()
                    if text[edge - 1] == "\r" and text[edge : edge + 1] == "\n":
                        edge -= 1
                    reached = edge
                    close()
                reached = stop
            at = stop

    todo = [(0, len(lines))]  # nodes as ranges of lines, the next one last
    while todo:
        lo, hi = todo.pop()
        begin = ends[lo - 1] if lo else 0
        if take(ends[hi - 1]):
            continue
        if hi - lo == 1:
            small(begin, ends[lo])
            continue
        best = min(ranks[lo : hi - 1])
        children, first = [], lo
        for i in range(lo, hi - 1):
            if ranks[i] == best:
                children.append((first, i + 1))
                first = i + 1
        children.append((first, hi))
        todo.extend(reversed(children))
    reached = len(text)
    close()
    return points


def pieces_of(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """[start, end) of each piece with the repeated part in front."""
    begin, out = 0, []
    for end in cut_points(text, limit, overlap):
        out.append((max(0, begin - overlap), end))
        begin = end
    return out


_PIECE = pa.schema([("file_id", pa.string()), ("piece_no", pa.int32()), ("start_pos", pa.int64()), ("own_start", pa.int64()), ("piece", pa.string())])


def split_long(records: DataFrame, limit: int = 2000, overlap: int = 200) -> DataFrame:
    """(file_id, piece_no from 0, start_pos, own_start, piece) of the records with more than `limit` characters.

    Pieces have at most `limit` characters, are in order, cover the text whole, and each but the first starts
    with the last `overlap` characters of the piece before: piece = text[start_pos:...], its own part begins at
    own_start. Cuts fall, best first, after a function, a block, a line, a word, and inside a word only where
    one is longer than a piece; a carriage return stays with its line feed unless even the limit is smaller.
    Records within the limit and null texts need no cut and don't come out. Repeated rows give repeated pieces.
    overlap must be less than half the limit.

    Scale: a record at a time in Arrow batches, no shuffle; the filter on the length runs in the scan's stage."""
    if not 0 <= overlap * 2 < limit:
        raise ValueError("overlap must be at least 0 and less than half the limit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("file_id").to_pylist()
            rows: list[tuple] = []
            for name, text in zip(ids, batch.column("text").to_pylist()):
                for no, (b, e) in enumerate(pieces_of(text, limit, overlap)):
                    rows.append((name, no, b, b + overlap if no else 0, text[b:e]))
                if len(rows) > 500:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _PIECE.types)], schema=_PIECE)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _PIECE.types)], schema=_PIECE)

    long = records.where(F.char_length("text") > limit).select("file_id", "text")
    return long.mapInArrow(run, "file_id string, piece_no int, start_pos long, own_start long, piece string")


def check_pieces(pieces: DataFrame, records: DataFrame, limit: int = 2000, overlap: int = 200) -> DataFrame:
    """(file_id, n_chars, too_long, apart, whole): pieces above the limit, pieces that don't begin with the end of the
    one before, and whether the pieces without what they repeat are the record's text. records: unique file_id."""
    length = F.length("piece")
    end = F.col("start_pos") + length
    before = Window.partitionBy("file_id").orderBy("piece_no")
    apart = F.coalesce((F.col("start_pos") != F.lag(end).over(before) - overlap).cast("int"), F.col("start_pos").cast("int"))
    own = pieces.select("file_id", "piece_no", apart.alias("apart"), (length > limit).cast("int").alias("long"), F.expr("substring(piece, int(own_start - start_pos) + 1)").alias("own"))
    joined = own.groupBy("file_id").agg(F.sum("long").alias("too_long"), F.sum("apart").alias("apart"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece_no", "own"))), lambda x: x["own"]), "").alias("text"))  # one text's pieces
    return joined.join(records.select("file_id", F.col("text").alias("t")), "file_id").select("file_id", F.length("t").cast("long").alias("n_chars"), "too_long", "apart", (F.col("text") == F.col("t")).alias("whole"))
