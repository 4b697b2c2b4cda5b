"""Plain-Python brute force of the operators, for small fixtures only."""

from __future__ import annotations

import random

WINDOWS = (12, 52, 104, 208)


def random_draws(n, pick=6, pool=90, seed=1):
    rng = random.Random(seed)
    return [sorted(rng.sample(range(1, pool + 1), pick)) for _ in range(n)]


def greedy_ticket(scores, pick, cap=3, decade=10):
    chosen, used = [], {}
    for number in sorted(range(1, len(scores) + 1), key=lambda n: (-scores[n - 1], n)):
        d = (number - 1) // decade
        if used.get(d, 0) < cap:
            chosen.append(number)
            used[d] = used.get(d, 0) + 1
        if len(chosen) == pick:
            break
    return sorted(chosen)


def horizon_ticket(history, pick=6, pool=90, windows=WINDOWS):
    p, scores = pick / pool, []
    for number in range(1, pool + 1):
        score = 0.0
        for w in windows:
            count = sum(number in draw for draw in history[-w:])
            score += (count - w * p) / (w * p * (1 - p)) ** 0.5 / len(windows)
        scores.append(score)
    return greedy_ticket(scores, pick)


def trailing_ticket(history, window, pick=6, pool=90):
    return greedy_ticket([sum(n in d for d in history[-window:]) for n in range(1, pool + 1)], pick)


def binned_ticket(draws, bins, i, features, window, prior, pick, pool=90):
    """Ticket for draw i from the ``window`` draws before it; ``bins[j][f]`` is already rotated."""
    span = range(max(0, i - window), i)
    overall = [sum(n in draws[j] for j in span) for n in range(1, pool + 1)]
    scores = []
    for n in range(1, pool + 1):
        total = 0.0
        for f in features:
            same = [j for j in span if bins[j][f] == bins[i][f]]
            total += (sum(n in draws[j] for j in same) + prior * overall[n - 1] / window) / (len(same) + prior)
        scores.append(total / len(features))
    return greedy_ticket(scores, pick)
