"""Lines of many pairs compared at once."""

from __future__ import annotations

import random

import numpy as np
import pytest

from kinsift.functions import strings
from kinsift.operators import explain


@pytest.mark.parametrize("masks", [1 << 22, 64])
def test_distances_equal_the_table(monkeypatch, masks):
    monkeypatch.setattr(strings, "MASKS", masks)
    rng = random.Random(1)
    texts = ["".join(rng.choices("abé漢😀 ", k=n)) for n in (1, 1, 2, 5, 8, 20, 63, 64, 65, 66, 127, 128, 129, 150)]
    x, y = (v.ravel() for v in np.meshgrid(np.arange(len(texts)), np.arange(len(texts))))
    assert strings.distances(texts, x, y).tolist() == [strings.weighted_distance(texts[i], texts[j], 1, 1, 1) for i, j in zip(x, y)]


@pytest.mark.parametrize("compared", [1 << 15, 50])
def test_matches_equal_greedy_over_all_lines(monkeypatch, compared):
    monkeypatch.setattr(explain, "COMPARED", compared)
    rng = random.Random(2)
    line = lambda: "".join(rng.choices("ab=", k=rng.choice([0, 1, 1, 2, 6, 70])))
    sides = [([line() for _ in range(rng.randint(0, 25))], [line() for _ in range(rng.randint(0, 25))]) for _ in range(30)]
    for (a, b), got in zip(sides, explain.match_texts(sides, 0.3)):
        scored = [(1.0 - strings.weighted_distance(x, y, 1, 1, 1) / max(len(x), len(y)), i, j) for i, x in enumerate(a) for j, y in enumerate(b) if x and y]
        left, right, want = set(), set(), []
        for s, i, j in sorted(scored, key=lambda x: (-x[0], x[1], x[2])):
            if s >= 0.3 and i not in left and j not in right:
                left.add(i), right.add(j), want.append((i, j, s))
        assert got == sorted(want)


def test_explanation_shuffles_nothing(spark):
    """A pair's rows come from its own row; there is no table of line pairs."""
    pairs = spark.createDataFrame([("p", "x = 1\ny = 2\n", "y = 2\nx = 10\n"), ("q", None, "a")], "pair_id string, left_text string, right_text string").coalesce(1)
    df = explain.explain_pairs(pairs)
    assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r)[:4] + (r.score,) for r in df.orderBy("match_id").collect()] == [("p", "m1", 0, 1, 0.833333), ("p", "m2", 1, 0, 1.0)]
