"""Local search with random restarts, for the grouped kernels."""

from __future__ import annotations

import random
from collections.abc import Callable, Hashable, Iterable
from dataclasses import dataclass
from typing import Any

EPSILON = 1e-9


@dataclass
class Climb:
    state: Any
    cost: float
    start_cost: float
    iterations: int = 0
    evaluations: int = 1


def descend(state: Hashable, cost: Callable, moves: Callable[[Any], Iterable], most: int) -> Climb:
    """Take the cheapest move (the first of equals) until none helps or `most` steps are done."""
    run = Climb(state, cost(state), 0.0)
    run.start_cost = run.cost
    for _ in range(most):
        run.iterations += 1
        winner = None
        bar = run.cost
        for other in moves(run.state):
            run.evaluations += 1
            c = cost(other)
            if c < bar - EPSILON:
                winner, bar = other, c
        if winner is None:
            break
        run.state, run.cost = winner, bar
    return run


def restarts(draw: Callable[[random.Random], Any], cost: Callable, moves: Callable, times: int, most: int, seed: int = 0) -> Climb:
    """The best of several descents from drawn states; one seeded generator serves them all. Counts add up."""
    rng = random.Random(seed)
    runs = [descend(draw(rng), cost, moves, most) for _ in range(max(1, times))]
    best = runs[0]
    for r in runs[1:]:
        if r.cost < best.cost - EPSILON:
            best = r
    return Climb(best.state, best.cost, best.start_cost, sum(r.iterations for r in runs), sum(r.evaluations for r in runs))
