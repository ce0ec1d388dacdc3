from __future__ import annotations

import itertools
import math
import random

import numpy as np
import pytest

from kinsift.llm.crf import OPEN, RIGHT, WRONG, Lattices, decode, fit, marginals


def _every(segments):
    """All segmentations without overlap."""
    for n in range(len(segments) + 1):
        for c in itertools.combinations(range(len(segments)), n):
            if all(segments[a][1] <= segments[b][0] or segments[b][1] <= segments[a][0] for a, b in itertools.combinations(c, 2)):
                yield c


@pytest.mark.parametrize("seed", range(30))
def test_sums_gradient_and_best_against_enumeration(seed):
    draw = random.Random(seed)
    segments = [(b := draw.randint(0, 12), b + draw.randint(1, 5), draw.choice("xy"), tuple(draw.sample("abcd", 2))) for _ in range(draw.randint(1, 6))]
    known = [draw.choice([WRONG, OPEN, OPEN]) for _ in segments]
    right = draw.randrange(len(segments))
    known[right] = RIGHT
    lattices = Lattices([(segments, known)])
    w = np.random.default_rng(seed).normal(size=len(lattices.names))
    score = lambda s: sum(w[lattices.names[s[2], f]] for f in s[3])
    weight = {c: math.exp(sum(score(segments[i]) for i in c)) for c in _every(segments)}
    held = sum(v for c, v in weight.items() if right in c and all(known[i] != WRONG for i in c))
    value, gradient = lattices.likelihood(w)
    assert value == pytest.approx(math.log(held / sum(weight.values())), abs=1e-6)
    for j in range(len(w)):
        up, down = w.copy(), w.copy()
        up[j], down[j] = w[j] + 1e-5, w[j] - 1e-5
        assert gradient[j] == pytest.approx((lattices.likelihood(up)[0] - lattices.likelihood(down)[0]) / 2e-5, abs=1e-4)
    table: dict = {}
    for (kind, f), j in lattices.names.items():
        table.setdefault(kind, {})[f] = float(w[j])
    best = max(weight.values())
    assert math.exp(sum(s for s, _ in decode(segments, table))) == pytest.approx(best)
    p = marginals(segments, table)
    for i in range(len(segments)):
        assert p[i] == pytest.approx(sum(v for c, v in weight.items() if i in c) / sum(weight.values()))


def test_fit_raises_the_likelihood_and_separates():
    rows = [([(0, 3, "a", ("bias", "good"))], [RIGHT]), ([(0, 3, "a", ("bias", "bad"))], [WRONG])] * 20
    weights, course = fit(rows, {"a": {"bias": 0.5}})
    assert course[-1] > course[0]
    assert weights["a"]["good"] > 1 > -1 > weights["a"]["bad"]
    assert fit([], {"a": {"bias": 0.5}}) == ({"a": {"bias": 0.5}}, [])
    assert decode([], {}) == [] and marginals([], {}) == []
