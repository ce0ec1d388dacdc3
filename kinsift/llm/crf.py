"""A semi-Markov conditional random field over candidate segments.

A text's lattice is its candidate segments (start, end, kind, features); a segmentation is a set of them without
overlap, its score the sum of its segments' scores, and text outside segments scores 0. As nothing links segments
that don't overlap, the field falls apart into clusters of overlapping candidates, each with its own partition
function: sums over all segmentations by the forward recursion, marginals by the backward one, the best by the
same recursion with a maximum. Clusters of one size go through the recursions together as arrays."""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterable, Sequence

import numpy as np

Segment = tuple[int, int, str, tuple[str, ...]]
Weights = dict[str, dict[str, float]]

#: What a candidate is known to be before training.
WRONG, OPEN, RIGHT = -1, 0, 1
_FORCE = 40.0


def score(segment: Segment, weights: Weights) -> float:
    own = weights.get(segment[2], {})
    return sum([own.get(f, 0.0) for f in segment[3]])


def decode(segments: list[Segment], weights: Weights) -> list[tuple[float, Segment]]:
    """The segmentation with the highest score: (score, segment) in the order of the text."""
    rated = sorted(((c[1], c[0], score(c, weights), c) for c in segments), key=lambda x: x[:2])
    ends = [x[0] for x in rated]
    best, back = [0.0], []
    for i, (_, b, s, _) in enumerate(rated):
        before = bisect.bisect_right(ends, b, 0, i)
        take = best[before] + s
        back.append((take > best[-1] + 1e-9, before))
        best.append(max(best[-1], take))
    out, i = [], len(rated)
    while i:
        taken, before = back[i - 1]
        if taken:
            out.append(rated[i - 1][2:])
        i = before if taken else i - 1
    return out[::-1]


def marginals(segments: list[Segment], weights: Weights) -> list[float]:
    """Every candidate's probability of being in the segmentation."""
    lattice = Lattices([(segments, list(range(len(segments))))])
    if not len(lattice.marks):
        return []
    w = np.array([weights.get(k, {}).get(f, 0.0) for k, f in lattice.names])
    p = lattice.sums(lattice.scores(w))[1]
    out = np.empty(len(segments))
    out[lattice.marks] = p
    return out.tolist()


def clusters(segments: Sequence[Segment]) -> list[list[int]]:
    """Numbers of the segments by cluster, those of a cluster in the order of their ends."""
    order = sorted(range(len(segments)), key=lambda i: segments[i][0])
    out: list[list[int]] = []
    reach = -1
    for i in order:
        b, e = segments[i][:2]
        if b >= reach:
            out.append([])
        out[-1].append(i)
        reach = max(reach, e)
    return [sorted(c, key=lambda i: (segments[i][1], segments[i][0])) for c in out]


class Lattices:
    """All clusters of the training rows as arrays: those of up to 1, 2, 4, 8, ... candidates side by side."""

    def __init__(self, rows: Iterable[tuple[list[Segment], list[int]]]) -> None:
        self.names: dict[tuple[str, str], int] = {}
        feature, owner, marks = [], [], []
        shaped: dict[int, list[tuple[list[int], list[int]]]] = {}
        for segments, known in rows:
            for cluster in clusters(segments):
                ends = [segments[i][1] for i in cluster]
                numbers = []
                for i in cluster:
                    kind, own = segments[i][2:]
                    feature += [self.names.setdefault((kind, f), len(self.names)) for f in own]
                    owner += [len(marks)] * len(own)
                    numbers.append(len(marks))
                    marks.append(known[i])
                before = [bisect.bisect_right(ends, segments[i][0], 0, at) for at, i in enumerate(cluster)]
                shaped.setdefault(1 << (len(cluster) - 1).bit_length(), []).append((numbers, before))
        self.feature, self.owner = np.array(feature, np.int64), np.array(owner, np.int64)
        self.marks = np.array(marks, np.int64)
        self.blocks = []
        for width, own in sorted(shaped.items()):
            numbers = np.full((len(own), width), -1)
            before = np.zeros((len(own), width), np.int64)
            for i, (n, b) in enumerate(own):
                numbers[i, : len(n)], before[i, : len(b)] = n, b
            self.blocks.append((numbers, before))

    def scores(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.owner, w[self.feature], len(self.marks))

    def sums(self, scores: np.ndarray) -> tuple[float, np.ndarray]:
        """Log of the partition function over all clusters, and every candidate's marginal probability."""
        total, marginal = 0.0, np.zeros(len(scores))
        for numbers, before in self.blocks:
            rows, width = np.arange(len(numbers)), numbers.shape[1]
            own = np.where(numbers >= 0, scores[numbers], -np.inf)
            forward = np.zeros((len(numbers), width + 1))
            taken = np.zeros((len(numbers), width))
            for k in range(width):
                take = forward[rows, before[:, k]] + own[:, k]
                forward[:, k + 1] = np.logaddexp(forward[:, k], take)
                taken[:, k] = np.exp(take - forward[:, k + 1])
            total += float(forward[:, width].sum())
            mass = np.zeros((len(numbers), width + 1))
            mass[:, width] = 1.0
            for k in range(width - 1, -1, -1):
                p = mass[:, k + 1] * taken[:, k]
                mass[:, k] += mass[:, k + 1] - p
                mass[rows, before[:, k]] += p
                marginal[numbers[:, k][numbers[:, k] >= 0]] = p[numbers[:, k] >= 0]
        return total, marginal

    def likelihood(self, w: np.ndarray) -> tuple[float, np.ndarray]:
        """Log-likelihood of what is known, and its gradient: the segmentations that hold every right and no
        wrong candidate against all segmentations. Open candidates are summed over on both sides."""
        free = self.scores(w)
        whole, p_all = self.sums(free)
        right = self.marks == RIGHT
        held = np.where(self.marks < OPEN, -np.inf, free + _FORCE * right)
        part, p_known = self.sums(held)
        gradient = np.bincount(self.feature, (p_known - p_all)[self.owner], len(self.names))
        return part - _FORCE * int(right.sum()) - whole, gradient


def fit(rows: Iterable[tuple[list[Segment], list[int]]], prior: Weights, spread: Callable[[str], float] = lambda f: 2.0, steps: int = 50) -> tuple[Weights, list[float]]:
    """(weights, objective by step): the most probable weights under the rows' likelihood and independent normal
    priors with the means in `prior` (0 for other features) and the standard deviations spread(feature). rows:
    segments and, for each, RIGHT, OPEN or wrong (below OPEN); right ones don't overlap. Gradient ascent with steps scaled by
    running moments; deterministic. No rows leave the prior."""
    lattices = Lattices(rows)
    names = list(lattices.names)
    if not names:
        return {k: dict(v) for k, v in prior.items()}, []
    mean = np.array([prior.get(k, {}).get(f, 0.0) for k, f in names])
    precision = np.array([1.0 / spread(f) ** 2 for _, f in names])
    w, first, second, course = mean.copy(), np.zeros(len(names)), np.zeros(len(names)), []
    for step in range(1, steps + 1):
        value, gradient = lattices.likelihood(w)
        course.append(value - float((precision * (w - mean) ** 2).sum()) / 2)
        gradient -= precision * (w - mean)
        first = 0.9 * first + 0.1 * gradient
        second = 0.98 * second + 0.02 * gradient**2
        rate = 0.2 * (1 - step / (steps + 1)) + 0.005
        w = w + rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.98**step)) + 1e-6)
    out = {k: dict(v) for k, v in prior.items()}
    for (k, f), x in zip(names, w):
        if abs(x) >= 1e-4:
            out.setdefault(k, {})[f] = round(float(x), 6)
        else:
            out.setdefault(k, {}).pop(f, None)
    return out, course
