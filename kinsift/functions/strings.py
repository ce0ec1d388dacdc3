"""Similarities of two strings or token lists. Levenshtein is the JVM's; what Spark lacks are Arrow-batched UDFs."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def levenshtein_similarity(a: Column | str, b: Column | str) -> Column:
    """1 - distance / longer length, by characters; two empty (or null) texts are 1."""
    x, y = (F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in (a, b))
    longer = F.greatest(F.length(x), F.length(y))
    return F.when(longer == 0, F.lit(1.0)).otherwise(1.0 - F.levenshtein(x, y) / F.greatest(longer, F.lit(1)))


def levenshtein_at_least(a: Column | str, b: Column | str, least: float) -> Column:
    """The similarity where it is at least `least`, otherwise null; stops counting once that can't be reached."""
    x, y = (F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in (a, b))
    longer, shorter = F.greatest(F.length(x), F.length(y)), F.least(F.length(x), F.length(y))
    bound = F.ceil((1.0 - least) * longer).cast("int") + 1
    near = shorter >= least * longer - 1e-9
    distance = F.when(near, F.call_function("levenshtein", x, y, bound))
    score = F.when(longer == 0, F.lit(1.0)).when(distance >= 0, 1.0 - distance / F.greatest(longer, F.lit(1)))
    return F.when(score >= least, score)


def weighted_distance(a: str, b: str, insert: int, delete: int, replace: int) -> int:
    """Least cost of turning a into b; a row at a time in numpy (insertions by a running minimum)."""
    codes = np.frombuffer(b.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    steps = np.arange(len(b) + 1) * insert
    row = steps.copy()
    for i, c in enumerate(a, 1):
        new = np.empty_like(row)
        new[0] = i * delete
        new[1:] = np.minimum(row[1:] + delete, row[:-1] + np.where(codes == ord(c), 0, replace))
        row = np.minimum.accumulate(new - steps) + steps
    return int(row[-1])


#: Bit masks that are held at once, by text and symbol.
MASKS = 1 << 22


def distances(texts: list[str], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Levenshtein distance of texts[left] and texts[right], element by element, all at once.

    Myers' bit vectors: a column of the table is a bit a character of the shorter text, in words of 64, and a step of
    all pairs takes one character of each longer text. Pairs whose shorter text has over 128 go through
    weighted_distance()."""
    lengths = np.array([len(t) for t in texts], np.int64)
    swap = lengths[left] > lengths[right]
    short, long = np.where(swap, right, left), np.where(swap, left, right)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    symbols, codes = np.unique(codes, return_inverse=True)
    starts = np.cumsum(lengths) - lengths
    out, words = lengths[long].copy(), (lengths[short] + 63) // 64
    for i in np.flatnonzero(words > 2):
        out[i] = weighted_distance(texts[short[i]], texts[long[i]], 1, 1, 1)
    for n in (1, 2):
        own = np.flatnonzero(words == n)
        if len(own):
            own = own[np.argsort(-lengths[long[own]], kind="stable")]
            out[own] = _bit_distances(codes, len(symbols), starts, lengths, short[own], long[own], n)
    return out


def _bit_distances(codes: np.ndarray, symbols: int, starts: np.ndarray, lengths: np.ndarray, short: np.ndarray, long: np.ndarray, words: int) -> np.ndarray:
    """Of pairs by falling length of the long text; the short ones have 1 to 64 * words characters."""
    used, row = np.unique(short, return_inverse=True)
    if len(used) * symbols * words > MASKS and len(used) > 1:
        half = len(short) // 2
        return np.concatenate([_bit_distances(codes, symbols, starts, lengths, short[own], long[own], words) for own in (slice(half), slice(half, None))])
    m = lengths[used]
    of = np.repeat(np.arange(len(used)), m)
    at = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
    masks = np.zeros((words, len(used) * symbols), np.uint64)  # bit: the text has the symbol at this place
    np.bitwise_or.at(masks, (at // 64, of * symbols + codes[starts[used][of] + at]), np.uint64(1) << (at % 64).astype(np.uint64))
    one, top = np.uint64(1), np.uint64(63)
    row, begin = row * symbols, starts[long]
    last = ((lengths[short] - 1) % 64).astype(np.uint64)
    plus, minus = np.full((words, len(short)), ~np.uint64(0)), np.zeros((words, len(short)), np.uint64)
    out, active = lengths[short].copy(), len(short)
    falling = -lengths[long]
    for step in range(int(lengths[long[0]])):
        active = int(np.searchsorted(falling, -step, "left"))
        key = row[:active] + codes[begin[:active] + step]
        up, down = one, np.uint64(0)  # the row above the table grows by one a step
        for w in range(words):
            eq, p, q = masks[w][key], plus[w, :active], minus[w, :active]
            v = eq | q
            eq |= down
            h = (((eq & p) + p) ^ p) | eq
            more, less = q | ~(h | p), p & h
            if w == words - 1:
                shift = last[:active]
                out[:active] += ((more >> shift) & one).astype(np.int64) - ((less >> shift) & one).astype(np.int64)
            next_up, next_down = more >> top, less >> top
            more, less = (more << one) | up, (less << one) | down
            plus[w, :active], minus[w, :active] = less | ~(v | more), more & v
            up, down = next_up, next_down
    return out


def _largest_cost(m: int, n: int, insert: int, delete: int, replace: int) -> int:
    both = m * delete + n * insert
    other = n * replace + (m - n) * delete if m >= n else m * replace + (n - m) * insert
    return min(both, other)


def weighted_similarity_of(a: str | None, b: str | None, insert: float = 1, delete: float = 1, replace: float = 1) -> float:
    i, d, r = (max(1, int(float(w))) for w in (insert, delete, replace))
    a, b = a or "", b or ""
    most = _largest_cost(len(a), len(b), i, d, r)
    return 1.0 if not most else 1.0 - weighted_distance(a, b, i, d, r) / most


def jaro_winkler_of(a: str | None, b: str | None, weight: float = 0.1) -> float:
    a, b = a or "", b or ""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used, left = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                left.append(c)
                break
    m = len(left)
    if not m:
        return 0.0
    right = [b[j] for j in range(len(b)) if used[j]]
    half = sum(x != y for x, y in zip(left, right)) // 2
    jaro = (m / len(a) + m / len(b) + (m - half) / m) / 3
    prefix = 0
    while prefix < min(4, len(a), len(b)) and a[prefix] == b[prefix]:
        prefix += 1
    return jaro + prefix * weight * (1 - jaro) if jaro > 0.7 else jaro


def token_distance(a: list[str], b: list[str]) -> int:
    ids: dict[str, int] = {}
    x, y = ([ids.setdefault(t, len(ids)) for t in side] for side in (a, b))
    right = np.array(y, dtype=np.int64)
    steps = np.arange(len(y) + 1)
    row = steps.copy()
    for i, t in enumerate(x, 1):
        new = np.empty_like(row)
        new[0] = i
        new[1:] = np.minimum(row[1:] + 1, row[:-1] + (right != t))
        row = np.minimum.accumulate(new - steps) + steps
    return int(row[-1])


def ruby_string_of(a: list[str] | None, b: list[str] | None, denominator: str = "max") -> float:
    """Token-level similarity; by the longer or the mean length."""
    x, y = list(a if a is not None else []), list(b if b is not None else [])
    if not x and not y:
        return 1.0
    by = max((len(x) + len(y)) / 2, 1.0) if denominator == "mean" else float(max(len(x), len(y), 1))
    return min(1.0, max(0.0, 1.0 - token_distance(x, y) / by))


def greedy_tiles(a: list[str], b: list[str], least: int = 5) -> list[tuple[int, int, int]]:
    """Tiles (i, j, length) in the order greedy string tiling accepts them: longest first, then by i, then by j.

    Common runs come from one table of match lengths a round, kept by diagonals in numpy."""
    if not a or not b:
        return []
    least = min(max(1, int(least)), len(a), len(b))
    ids: dict[str, int] = {}
    x = np.array([ids.setdefault(t, len(ids)) for t in a])
    y = np.array([ids.setdefault(t, len(ids)) for t in b])
    free_x, free_y = np.ones(len(x), bool), np.ones(len(y), bool)
    tiles: list[tuple[int, int, int]] = []
    while True:
        below = np.zeros(len(y) + 1, np.int32)
        best, spots = least - 1, []
        for i in range(len(x) - 1, -1, -1):
            run = np.zeros(len(y) + 1, np.int32)
            if free_x[i]:
                run[:-1] = np.where((y == x[i]) & free_y, below[1:] + 1, 0)
                top = int(run.max())
                if top > best:
                    best, spots = top, []
                if top == best >= least:
                    spots += [(i, int(j)) for j in np.flatnonzero(run == best)]
            below = run
        if best < least or not spots:
            return tiles
        for i, j in sorted(spots):
            if free_x[i : i + best].all() and free_y[j : j + best].all():
                free_x[i : i + best] = False
                free_y[j : j + best] = False
                tiles.append((i, j, best))


def gst_of(a: list[str] | None, b: list[str] | None, least: int = 5) -> float:
    x, y = list(a if a is not None else []), list(b if b is not None else [])
    if not x and not y:
        return 1.0
    if not x or not y:
        return 0.0
    return 2.0 * sum(n for _, _, n in greedy_tiles(x, y, least)) / (len(x) + len(y))


def pair_udf(one: Callable[..., float], **options) -> Callable[[Column | str, Column | str], Column]:
    """A column of one(left, right), Arrow batches in and out."""

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([one(x, y, **options) for x, y in zip(a, b)], dtype="float64")

    return run


def jaro_winkler(a: Column | str, b: Column | str, weight: float = 0.1) -> Column:
    if not 0 <= weight <= 0.25:
        raise ValueError("the prefix weight lies within 0 and 0.25")
    return pair_udf(jaro_winkler_of, weight=weight)(a, b)


def weighted_levenshtein(a: Column | str, b: Column | str, insert: float = 1, delete: float = 1, replace: float = 1) -> Column:
    return pair_udf(weighted_similarity_of, insert=insert, delete=delete, replace=replace)(a, b)


def gst(a: Column | str, b: Column | str, least: int = 5) -> Column:
    return pair_udf(gst_of, least=least)(a, b)


def ruby_string(a: Column | str, b: Column | str, denominator: str = "max") -> Column:
    if denominator not in ("max", "mean"):
        raise ValueError(f"Unsupported ruby_denominator: {denominator}")
    return pair_udf(ruby_string_of, denominator=denominator)(a, b)


def stable_hash(tokens: list[str]) -> int:
    return int.from_bytes(hashlib.blake2b("\x1f".join(tokens).encode("utf-8", "ignore"), digest_size=8).digest(), "big")


def blake_fingerprints_of(tokens: list[str], k: int = 5, w: int = 4) -> list[str]:
    """Values of winnowed blake2b hashes, as 16 hex digits in order (what a set of unsigned 64-bit numbers is)."""
    if not len(tokens):
        return []
    k = min(max(1, int(k)), len(tokens))
    hashes = [stable_hash(list(tokens[i : i + k])) for i in range(len(tokens) - k + 1)]
    w = min(max(1, int(w)), len(hashes))
    return sorted({f"{min(hashes[i : i + w]):016x}" for i in range(len(hashes) - w + 1)})


def blake_fingerprints(tokens: Column | str, k: int = 5, w: int = 4) -> Column:
    @F.pandas_udf("array<string>")
    def run(rows: pd.Series) -> pd.Series:
        return rows.map(lambda t: blake_fingerprints_of(list(t) if t is not None else [], k, w))

    return run(tokens)


def py_round(value: Column | str, digits: int = 4) -> Column:
    """Rounded as Python does: half to even on the exact binary value. Spark's own round takes halves up."""

    @F.pandas_udf("double")
    def run(v: pd.Series) -> pd.Series:
        return v.map(lambda x: None if x is None or x != x else round(float(x), digits))

    return run(value)
