"""Runs of repeated words against brute force, and the small cases of the operator."""

import random

import pytest

from obsweave.llm.periodic_runs import _collapse, periodic_runs

OBS = "obs_id bigint, text string, runs int, id string, n_words string"


def brute(w):
    n, out = len(w), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                out.setdefault((i, j + q), q)
            i = max(j, i) + 1
    return sorted((s, e - s, q) for (s, e), q in out.items())


def kept(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def text(rnd):
    letters, out = rnd.choice([1, 2, 2, 3, 5, 50]), []
    for _ in range(rnd.randrange(0, 8)):
        unit = [rnd.randrange(letters) for _ in range(rnd.choice([1, 2, 3, 5, 9, 14, 20, 33, 40, 64, 70]))]
        out += [unit[i % len(unit)] for i in range(len(unit) * rnd.choice([1, 2, 3, 4, 5, 7]) + rnd.randrange(len(unit)))]
    if out and rnd.random() < 0.3:
        out += out[:rnd.randrange(1, 80)] * rnd.choice([3, 4, 5, 6])
    return [b"w%d" % x for x in out]


@pytest.mark.parametrize("seed", range(6))
def test_runs_equal_brute_force(seed):
    rnd = random.Random(seed)
    for _ in range(25):
        texts = [text(rnd) for _ in range(rnd.randrange(1, 6))]
        runs, left = _collapse(texts)
        for words, r, x in zip(texts, runs, left, strict=True):
            assert [tuple(a) for a in r.tolist()] == brute(words)
            assert x == kept([w.decode() for w in words], brute(words))


def test_small_cases(spark):
    unit = " ".join(f"u{i}" for i in range(100))
    rows = [(1, None), (2, ""), (3, " \t\x0b "), (4, "a a a a a"), (5, "a  a\ta a a a"), (6, "x " + "b c " * 5 + "y"), (7, " ".join([unit] * 4)), (7, " ".join([unit] * 4)),
            (None, "é é é é é é"), (8, "q" * 100000), (9, "z " * 200000), (10, "A a A a A a A a")]
    got = sorted(((r.obs_id or 0, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs(spark.createDataFrame([(i, t, 1, "x", "y") for i, t in rows], OBS)).collect()), key=repr)
    want = sorted([(1, 0, [], ""), (2, 0, [], ""), (3, 0, [], ""), (4, 5, [], "a a a a a"), (5, 6, [(0, 6, 1)], "a"), (6, 12, [(1, 10, 2)], "x b c y"), (7, 400, [(0, 400, 100)], unit),
                   (7, 400, [(0, 400, 100)], unit), (0, 6, [(0, 6, 1)], "é"), (8, 1, [], "q" * 100000), (9, 200000, [(0, 200000, 1)], "z"), (10, 8, [(0, 8, 2)], "A a")], key=repr)
    assert got == want
    assert periodic_runs(spark.createDataFrame([], OBS)).count() == 0
