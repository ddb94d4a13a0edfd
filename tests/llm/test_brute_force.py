"""The packing, the risk and the shared passages against plain versions that go through everything."""

import math
import random

import numpy as np
import pytest

from spanloom.llm import chunks, toxicity
from spanloom.llm.packing import Capacity, best_fit


# ---------------------------------------------------------------- best fit


def plain_best_fit(lengths, capacity):
    full, left, bins, offsets = (capacity.tokens, capacity.documents, capacity.attention), [], [], []
    for length in lengths:
        need = (length, 1, length * length)
        able = [i for i, free in enumerate(left) if all(f >= n for f, n in zip(free, need))]

        def score(i):
            if capacity.score == "dot":
                return -sum(f / c * (n / c) * w for f, n, c, w in zip(left[i], need, full, capacity.weights))
            return sum(((f - n) / c) ** 2 * w for f, n, c, w in zip(left[i], need, full, capacity.weights))

        # Of equal scores the oldest sequence.
        at = min(able, key=lambda i: (round(score(i), 12), i), default=None)
        if at is None:
            at = len(left)
            left.append(list(full))
        bins.append(at)
        offsets.append(full[0] - left[at][0])
        left[at] = [f - n for f, n in zip(left[at], need)]
    return bins, offsets, len(left)


@pytest.mark.parametrize("score", ["norm", "dot"])
@pytest.mark.parametrize("capacity", [(100, 100, 10_000), (100, 4, 10_000), (100, 30, 2_500), (64, 3, 1_200)])
def test_best_fit_as_plain(score, capacity):
    rng = random.Random(sum(capacity))
    for size in (0, 1, 40, 200):
        most = min(capacity[0], math.isqrt(capacity[2]))
        lengths = sorted((min(most, rng.choice([1, 2, rng.randint(1, 20), rng.randint(1, 100)])) for _ in range(size)), reverse=True)
        how = Capacity(*capacity, score=score)
        got, want = best_fit(lengths, how), plain_best_fit(lengths, how)
        assert (list(got[0]), list(got[1]), got[2]) == want


# ---------------------------------------------------------------- risk


def plain_risk(x, plus, prior, weights, bias):
    """(toxic part, clean part) of the risk, as its definition says."""
    scores = x @ weights + bias
    toxic, clean = np.log1p(np.exp(-scores)), np.log1p(np.exp(scores))
    return prior * toxic[plus].mean(), clean[~plus].mean() - prior * clean[plus].mean()


def plain_fit(x, plus, prior):
    """The fit on a dense matrix, with slopes by differences of the risk."""
    point = np.append(np.zeros(x.shape[1]), math.log(prior / (1 - prior)))
    mean, square = np.zeros_like(point), np.zeros_like(point)

    def slope(part):
        found, step = np.zeros_like(point), 1e-5
        for i in range(len(point)):
            move = np.zeros_like(point)
            move[i] = step
            ends = [part(*np.split(point + s * move, [-1])) for s in (1, -1)]
            found[i] = (ends[0] - ends[1]) / (2 * step)
        return found

    turned = 0
    for step in range(1, toxicity.STEPS + 1):
        clean = plain_risk(x, plus, prior, point[:-1], point[-1])[1]
        if clean >= 0:
            grad = slope(lambda w, b: sum(plain_risk(x, plus, prior, w, b)))
        else:
            turned += 1
            grad = -slope(lambda w, b: plain_risk(x, plus, prior, w, b)[1])
        grad[:-1] += toxicity.DECAY * point[:-1]
        mean, square = 0.9 * mean + 0.1 * grad, 0.999 * square + 0.001 * grad**2
        point = point - toxicity.RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return point, turned


def test_fit_follows_the_risk(monkeypatch):
    monkeypatch.setattr(toxicity, "STEPS", 60)
    rng = np.random.default_rng(2)
    turned = 0
    for n_plus, n_mixed in ((12, 60), (4, 9)):
        rows = [sorted(rng.choice(6, rng.integers(0, 4), replace=False).tolist()) for _ in range(n_plus + n_mixed)]
        rows[:n_plus] = [sorted({0, *r}) for r in rows[:n_plus]]
        positive = [True] * n_plus + [False] * n_mixed
        x = np.zeros((len(rows), 6))
        for i, r in enumerate(rows):
            x[i, r] = 1
        want, turns = plain_fit(x, np.array(positive), 0.3)
        weights, bias = toxicity.fit(rows, positive, 6, 0.3)
        assert np.allclose(np.append(weights, bias), want, atol=2e-3)
        turned += turns
    # The estimate fell below zero at least once, so the step against it was taken too.
    assert turned > 0


# ---------------------------------------------------------------- shared passages


def common_spans(text, other):
    """The spans of a text that stand in the other and cannot be made longer, by the quadratic recurrence."""
    a, b = chunks.code_points(text), chunks.code_points(other)
    found, last = [], np.zeros(len(b) + 1, np.int64)
    longest = np.zeros(len(a) + 1, np.int64)
    for i, point in enumerate(a.tolist(), 1):
        now = np.zeros(len(b) + 1, np.int64)
        now[1:] = np.where(b == point, last[:-1] + 1, 0)
        longest[i], last = now.max(), now
    for i in range(1, len(a) + 1):
        if longest[i] and (i == len(a) or longest[i + 1] != longest[i] + 1):
            found.append((i - int(longest[i]), i))
    return found


def test_passages_as_brute_force(spark):
    """What is cut stands in an earlier document; every long shared passage is cut but for its ends."""
    rng = random.Random(14)
    prose = lambda n: " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(n))
    passages = [prose(n) for n in (10, 20, 30, 60, 60, 90)]
    rows = []
    for i in range(24):
        parts = [prose(rng.randint(5, 40))]
        for passage in rng.sample(passages, rng.randint(0, 2)):
            parts += [passage, prose(rng.randint(5, 40))]
        rows.append((i, " ".join(parts)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: [(s.start, s.end) for s in r.spans] for r in chunks.deduplicate(docs).collect()}
    long = missed = 0
    for number, (key, text) in enumerate(rows):
        shared = [s for _, other in rows[:number] for s in common_spans(text, other)]
        inside = np.zeros(len(text), bool)
        for start, end in shared:
            if chunks.word_count(text[start:end]) >= 3:
                inside[start:end] = True
        for start, end in got[key]:
            assert inside[start:end].all() and chunks.word_count(text[start:end]) >= chunks.LEAST_WORDS
        cut = np.zeros(len(text), bool)
        for start, end in got[key]:
            cut[start:end] = True
        for start, end in shared:
            if chunks.word_count(text[start:end]) >= 52:
                long += 1
                missed += not cut[start + 10 : end - 10].all()
        # Documents that share nothing of 25 words stay as they are.
        if all(chunks.word_count(text[s:e]) < chunks.LEAST_WORDS for s, e in shared):
            assert not got[key]
    assert long > 10 and missed == 0
