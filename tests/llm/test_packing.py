"""The linear program of op5: plans meet their demand, and duals that a plain knapsack checks prove how few sequences there can be."""

import time

import numpy as np
import pytest

from tessella.llm.packing import PackParams, solve

R = np.random.default_rng(4)
SHAPES = {
    "even": dict.fromkeys(range(1, 257), 1000),
    "random": {c: int(R.integers(1, 10**6)) for c in range(1, 257)},
    "random small": {c: int(R.integers(1, 10**6)) for c in range(1, 129)},
    "harmonic": {c: 10**6 // c for c in range(1, 257)},
    "large pieces": {c: 1 + 10**6 // (257 - c) ** 2 for c in range(1, 257)},
    "around a third": {c: int(1 + 1000 * np.exp(-(((c - 88) / 14) ** 2))) for c in range(50, 130)},
    "one of each": dict.fromkeys(range(1, 257), 1),
    "over half": dict.fromkeys(range(129, 257), 7),
    "few": {129: 1000, 100: 5, 3: 77},
    "one": {256: 5},
    "odd ones": {c: int(R.integers(1, 50)) for c in range(1, 257, 2)},
}


def worth(duals: list, classes: list, room: int) -> float:
    best = [0.0] * (room + 1)
    for w in range(1, room + 1):
        best[w] = max([best[w - 1], *(best[w - c] + d for c, d in zip(classes, duals) if c <= w)])
    return best[room]


@pytest.mark.parametrize("name", SHAPES)
def test_plans_are_proven(name):
    demand, p = SHAPES[name], PackParams()
    began = time.time()
    plans, duals = solve(demand, p)
    assert time.time() - began < 60
    made = dict.fromkeys(demand, 0.0)
    for pattern, x in plans:
        assert x > 0 and sum(c * n for c, n in pattern) <= 256
        for c, n in pattern:
            made[c] += n * x
    assert all(abs(made[c] - n) <= 1e-6 * n for c, n in demand.items())
    assert worth(duals.tolist(), sorted(demand), 256) <= 1 + 1e-9
    assert sum(x for _, x in plans) <= (1 + 1e-3) * sum(d * demand[c] for d, c in zip(duals, sorted(demand)))


def test_other_rooms():
    r = np.random.default_rng(9)
    for room in (1, 2, 7, 30, 100):
        for _ in range(6):
            demand = {int(c): int(r.integers(0, 40)) for c in r.choice(np.arange(1, room + 1), r.integers(1, room + 1), replace=False)}
            plans, duals = solve(demand, PackParams(sequence=room * 16))
            held = sorted(c for c, n in demand.items() if n)
            assert bool(plans) == bool(held)
            if held:
                assert worth(duals.tolist(), held, room) <= 1 + 1e-9 and sum(x for _, x in plans) <= (1 + 1e-3) * sum(d * demand[c] for d, c in zip(duals, held))
