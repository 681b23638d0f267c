"""Trigram scores against a plain version, the Elias-Fano trie against a dictionary, and the small cases."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from obsweave.llm.elias_fano import EliasFano, NgramTrie, U, log_probabilities, quantise
from obsweave.llm.language_model import model_scores

OBS = "obs_id bigint, text string, shard int, block string, at string"
M2, M3 = 20.0, 2.0


def words_of(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def plain(rows):
    learnt = [words_of(t) for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
    c1, c2, c3 = Counter(), Counter(), Counter()
    for w in learnt:
        p = [0, 0, *w]
        c1.update(w)
        c2.update(zip(p[1:], p[2:], strict=False))
        c3.update(list(zip(p, p[1:], p[2:], strict=False))[1:])
    n, v = sum(c1.values()), len(c1)
    mass = lambda c: c if c <= 128 else 128 * 2 ** (round(4 * math.log2(c / 128)) / 4)
    out = []
    for i, t in rows:
        w = words_of(t)
        base = score = 0.0
        for a, b, x in zip([0, 0, *w], [0, *w], w, strict=False):
            p1 = (c1[x] + 1) / (n + v + 1)
            cb = len(learnt) if b == 0 else c1[b]
            p2 = (min(mass(c2[b, x]), cb) + M2 * p1) / (cb + M2)
            cc = mass(c2[a, b]) if b != 0 and c1[x] else 0
            p3 = (min(mass(c3[a, b, x]), cc) + M3 * p2) / (cc + M3)
            base, score = base + math.log10(p1), score + math.log10(p3)
        out.append((i is None, i or 0, i is not None and zlib.crc32(str(i).encode()) % 7 == 2, len(w), sum(c1[x] > 0 for x in w), n, round(base, 6), round(score, 6)))
    return sorted(out)


@pytest.mark.parametrize("sizes", [{}, {"block_words": 200, "word_shard_bytes": 5000, "trie_shard_bytes": 3000, "slice_count": 5}])
def test_scores_equal_the_plain_model(spark, sizes):
    rnd = random.Random(4)
    rows = [(i, " ".join(rnd.choice(["the", "The", f"w{rnd.randrange(30)}", f"r{rnd.randrange(900)}"]) for _ in range(rnd.randrange(0, 40)))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, " \n "), (None, "the the w1"), (203, "same words here"), (203, "same words here"), (204, "often so " * 3000), (205, "x" * 50000)]
    df = spark.createDataFrame([(i, t, 1, "x", "y") for i, t in rows], OBS).repartition(3)
    got = sorted((r.obs_id is None, r.obs_id or 0, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6))
                 for r in model_scores(df, strength=(M2, M3), **sizes).collect())
    assert got == plain(rows)


def test_nothing_to_learn_from(spark):
    assert model_scores(spark.createDataFrame([], OBS)).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    one = model_scores(spark.createDataFrame([(held, "a b", 1, "", "")], OBS)).first()
    assert (one.held_out, one.n_tokens, one.n_known, one.train_tokens, one.base_score, one.score) == (True, 3, 0, 0, 0.0, 0.0)


@pytest.mark.parametrize("size", [1, 7, 400, 5000])
def test_sequence_reads_and_successors(size):
    rng = np.random.default_rng(size)
    for top in (size, size * 50, 1 << 40):
        values = np.sort(rng.integers(0, top, size)).astype(np.uint64)
        seq = EliasFano(EliasFano.build(values))
        assert (seq.at(np.arange(size)) == values).all()
        x = np.concatenate([values, rng.integers(0, top + 9, 50).astype(np.uint64)])
        at, hit = seq.successor(x, np.zeros(len(x), np.int64), np.full(len(x), size))
        assert (hit == np.isin(x, values)).all() and (at[hit] == np.searchsorted(values, x[hit])).all()


def test_trie_finds_what_it_was_built_of():
    rng = np.random.default_rng(2)
    t = np.unique(rng.integers(0, 40, (2000, 3)), axis=0)
    count = rng.integers(1, 400, len(t))
    pair, context = np.unique((t[:, 0].astype(np.uint64) << U(32)) | t[:, 1].astype(np.uint64), return_inverse=True)
    trie = NgramTrie.build(pair, np.ones(len(pair), np.int64), context, t[:, 2], count, 10**6)
    pairs, triples = trie.look_up(pair, np.repeat(np.arange(len(pair)), 42), np.tile(np.arange(42), len(pair)))
    have = {(int(c), int(w)): int(k) for c, w, k in zip(context, t[:, 2], quantise(count, 1), strict=True)}
    assert (pairs == 1).all()
    assert triples.tolist() == [have.get((c, w), 0) for c in range(len(pair)) for w in range(42)]


def test_codes_are_exact_for_small_counts_and_close_for_large_ones():
    count = np.array([1, 2, 100, 128, 129, 5000, 10**8])
    back = 10**9 * 10.0 ** log_probabilities(10**9)[quantise(count, 10**9)]
    assert np.allclose(back[:4], count[:4]) and (np.abs(np.log2(back / count)) <= 0.126).all()
