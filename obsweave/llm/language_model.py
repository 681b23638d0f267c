"""Scores of observation texts under a trigram model kept in Elias-Fano tries.

The model is as large as the corpus makes it, so no task and no driver ever holds it: it lies in shards,
and texts ask it by exchange. Texts are read once, in blocks of some million words:

1. Each block numbers its own words and asks the vocabulary's shards for each distinct word once.
   A shard adds up the blocks' counts, numbers its words by frequency and answers with numbers and counts.
2. Each block asks the trie's shards for each distinct pair and triple once, with its own count of them.
   A shard adds up the counts, builds its trie (``elias_fano.NgramTrie``: monotone pointers, numbers
   relative to the context, one byte for a probability) in a memory map, looks up what the blocks asked
   by successor search and answers with one byte each.
3. Each block puts the answers together and adds up its texts.

A word, pair or triple that is very frequent costs one entry a block. A context that many different
words follow is split: the number of its slices follows from the lesser count of its two words. This is
why the smoothing is Dirichlet's, whose weights depend on counts only: the smoothed probability

    p(w | u v) = (c(u v w) + m3 p(w | v)) / (c(u v) + m3),   p(w | v) = (c(v w) + m2 p(w)) / (c(v) + m2),
    p(w) = (c(w) + 1) / (N + V + 1)

follows from the n-gram's own entry and those of its shorter forms, in whichever shards they lie. The
levels keep probabilities c / N in quantised form; unigrams keep their exact smoothed counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from obsweave.llm.common import cut, fields, learnt, small_batches
from obsweave.llm.elias_fano import NgramTrie, log_probabilities
from obsweave.llm.textbytes import U, mix, slices

#: Words of a block; the answers of a shard and all steps of a task are arrays of about this length.
BLOCK_WORDS = 1 << 19
#: Bytes of text for each shard of the vocabulary and of the trie.
WORD_SHARD_BYTES, TRIE_SHARD_BYTES = 1 << 25, 1 << 22
#: Bytes of text for each partition of an exchange of blobs: a task sorts what its partition holds.
PART_BYTES = 1 << 25
#: Occurrences of the rarer word of a context for each slice of it.
SLICE_COUNT = 1 << 20
#: Prior weight of the next shorter context, for pairs and for triples.
STRENGTH = (1000.0, 1.0)
#: Stands for the end of a text among the hashes of words; 0 is the number of the start of a text.
END = np.uint64(0x2545F4914F6CDD1D)


def _pack(*arrays: np.ndarray) -> bytes:
    """Unsigned numbers below 2**32, the bytes of each weight together, compressed."""
    planes = [np.array([len(arrays), *[len(a) for a in arrays]], "<u4").tobytes()]
    planes += [np.ascontiguousarray(a.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes() for a in arrays]
    raw = b"".join(planes)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(blob: bytes) -> list[np.ndarray]:
    raw = np.frombuffer(pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True), np.uint8)
    k = int(raw[:4].view("<u4")[0])
    sizes, at, out = raw[4:4 + 4 * k].view("<u4").astype(np.int64).tolist(), 4 + 4 * k, []
    for n in sizes:
        out.append(np.ascontiguousarray(raw[at:at + 4 * n].reshape(4, n).T).view("<u4").reshape(n).astype(np.int64))
        at += 4 * n
    return out


def _fewer(a: np.ndarray) -> np.ndarray:
    """Ascending numbers as steps."""
    return np.diff(a, prepend=a.dtype.type(0))


# -- blocks of texts -----------------------------------------------------------------------------------


def _blocks(shards: int, block_words: int):
    """Rows (block, shard, blob, id, held): one per vocabulary shard asked, one for the texts, one per text."""
    def run(batches):
        number, held = 0, []

        def flush():
            nonlocal number, held
            block = (TaskContext.get().partitionId() << 28) + number
            number += 1
            size = np.concatenate([s for _, _, s, _ in held])
            out = np.concatenate([o for _, o, _, _ in held])
            words, back = np.unique(np.concatenate([h for _, _, _, h in held]), return_inverse=True)
            learn = np.repeat(~out, size)
            count = np.bincount(back[learn], minlength=len(words))
            # the place of a word: by shard, then by hash; its name inside the block: by frequency
            shard = (words % U(shards)).astype(np.int64)
            place = np.argsort(shard, kind="stable")
            rank = np.argsort(-np.bincount(back, minlength=len(words)), kind="stable")
            name = np.empty(len(words), np.int64)
            name[rank] = np.arange(len(words))
            edge = np.searchsorted(shard[place], np.arange(shards + 1))
            asks = [(s, place[edge[s]:edge[s + 1]]) for s in range(shards) if edge[s + 1] > edge[s]]
            blobs = [_pack(_fewer((words[p] >> U(32)).astype(np.int64)), words[p] & U(0xFFFFFFFF), count[p]) for _, p in asks]
            texts = _pack(size, out, name[back], name[place])
            k, ids = len(asks), [i for i, _, _, _ in held]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(k + 1, block)), pa.array([*[s for s, _ in asks], None], pa.int32()), pa.array([*blobs, texts], pa.binary()),
                                              pa.nulls(k + 1, ids[0].type), pa.nulls(k + 1, pa.bool_()), pa.nulls(k + 1, pa.int32())],
                                             names=["block", "shard", "blob", "id", "held_out", "at"])
            n = len(size)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, block)), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.concat_arrays(ids), pa.array(out),
                                              pa.array(np.arange(n, dtype=np.int32))], names=["block", "shard", "blob", "id", "held_out", "at"])
            held = []

        total = 0
        for batch in batches:
            for part, texts in slices(batch, "text"):
                start, end, before = texts.words()
                h = texts.hashes(texts.sums(), start, end) if len(start) else np.zeros(0, np.uint64)
                # an end after the last word of each text
                tokens = np.insert(h, before[1:], END)
                ids = part.column("id")
                held.append((ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids, part.column("held_out").to_numpy(zero_copy_only=False).astype(bool), np.diff(before) + 1, tokens))
                total += len(tokens)
                if total >= block_words:
                    yield from flush()
                    total = 0
        if held:
            yield from flush()
    return run


def _vocabulary(shards: int):
    """Answers (block, shard, blob of numbers and counts) of one shard; block null: its tokens and types."""
    def run(asked: pa.Table) -> pa.Table:
        blocks, shard = asked["block"].to_pylist(), asked["shard"][0].as_py()
        parts = [_unpack(b) for b in asked["blob"].to_pylist()]
        hashes = np.concatenate([(np.cumsum(p[0]).astype(np.uint64) << U(32)) | p[1].astype(np.uint64) for p in parts])
        words, back = np.unique(hashes, return_inverse=True)
        count = np.bincount(back, weights=np.concatenate([p[2] for p in parts])).astype(np.int64)
        known = int((count > 0).sum())
        number = np.zeros(len(words), np.int64)
        order = np.lexsort((words, -count))
        number[order] = np.arange(len(words)) * shards + shard + 1
        if known * shards >= 1 << 32:
            raise ValueError("more than 2**32 distinct words")
        number[count == 0] = 0
        edge, blobs = np.cumsum([0, *[len(p[0]) for p in parts]]), []
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            c = count[back[a:b]]
            blobs.append(_pack(number[back[a:b]], c & 0xFFFFFFFF, c >> 32))
        n = len(blocks)
        return pa.table({"block": pa.array([*blocks, None], pa.int64()), "shard": pa.array(np.full(n + 1, shard, np.int32)), "blob": pa.array([*blobs, None], pa.binary()),
                         "tokens": pa.array([None] * n + [int(count.sum())], pa.int64()), "types": pa.array([None] * n + [known], pa.int64())})
    return run


class _Block:
    """The texts of a block as numbers of words, and what they ask of the trie."""

    def __init__(self, texts: bytes, answers: list[tuple[int, bytes]], shards: int, slice_count: int):
        self.size, out, name, place = _unpack(texts)
        got = [_unpack(blob) for _, blob in sorted(answers)]
        number, count = np.empty(len(place), np.int64), np.empty(len(place), np.int64)
        number[place] = np.concatenate([g[0] for g in got])
        count[place] = np.concatenate([g[1] | (g[2] << 32) for g in got])
        self.count, w = count[name], number[name]
        ends = np.cumsum(self.size)
        first = np.zeros(len(w), bool)
        first[np.concatenate([[0], ends[:-1]])] = True
        # the end of a text comes once a text, as its start does, whose number is 0
        self.v_count = self._before(self.count, first, self.count[ends[0] - 1])
        v = self._before(w, first, 0)
        known = self.count > 0
        self.has_pair = known & (self._before(known, first, True))
        learn = np.repeat(out == 0, self.size)
        self.pairs, self.pair_of = np.unique(((v << 32) | w)[self.has_pair].astype(np.uint64), return_inverse=True)
        self.pair_count = np.bincount(self.pair_of[learn[self.has_pair]], minlength=len(self.pairs))
        # the context of a word is the pair that ends before it
        place = np.full(len(w), -1, np.int64)
        place[self.has_pair] = self.pair_of
        context = self._before(place, first, -1)
        self.has_triple = known & (context >= 0)
        self.context_of = context[self.has_triple]
        triples, self.triple_of = np.unique(((self.context_of << 32) | w[self.has_triple]).astype(np.uint64), return_inverse=True)
        self.triple_count = np.bincount(self.triple_of[learn[self.has_triple]], minlength=len(triples))
        self.context, self.word = (triples >> U(32)).astype(np.int64), (triples & U(0xFFFFFFFF)).astype(np.int64)
        # a context of two frequent words is cut by the words that follow it
        rarer = np.zeros(len(self.pairs), np.int64)
        rarer[self.pair_of] = np.minimum(self.v_count, self.count)[self.has_pair]
        home = mix(mix(self.pairs >> U(32)) + self.pairs)
        self.pair_shard = (home % U(shards)).astype(np.int32)
        self.triple_shard = self.pair_shard[self.context]
        cuts = 1 + rarer[self.context] // slice_count
        many = np.flatnonzero(cuts > 1)
        part = mix(self.word[many].astype(np.uint64)) % cuts[many].astype(np.uint64)
        away = mix(home[self.context[many]] + part * U(0x9E3779B97F4A7C15)) % U(shards)
        self.triple_shard[many[part > 0]] = away[part > 0]

    @staticmethod
    def _before(a: np.ndarray, first: np.ndarray, fill) -> np.ndarray:
        """For each word what holds for the word before it in its text."""
        out = np.empty_like(a)
        out[1:] = a[:-1]
        out[first] = fill
        return out

    def asked(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(shard, pairs asked there, triples asked there), both ascending."""
        by_pair, by_triple = np.argsort(self.pair_shard, kind="stable"), np.argsort(self.triple_shard, kind="stable")
        p_edge, t_edge = self.pair_shard[by_pair], self.triple_shard[by_triple]
        for shard in np.union1d(p_edge, t_edge).tolist():
            yield (shard, by_pair[np.searchsorted(p_edge, shard):np.searchsorted(p_edge, shard, "right")],
                   by_triple[np.searchsorted(t_edge, shard):np.searchsorted(t_edge, shard, "right")])


def _answers_of(table: pa.Table) -> list[tuple[int, bytes]]:
    return list(zip(table["shard"].to_pylist(), table["blob"].to_pylist(), strict=True))


def _ask_trie(shards: int, slice_count: int):
    """Rows (shard, block, blob) of one block's questions to the trie."""
    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return pa.table({"shard": pa.array([], pa.int32()), "block": pa.array([], pa.int64()), "blob": pa.array([], pa.binary())})
        b = _Block(texts["blob"][0].as_py(), _answers_of(answers), shards, slice_count)
        rows = []
        for shard, own, triples in b.asked():
            # contexts of triples that a slice keeps away from their pair go along unasked
            over = b.context[triples]
            over = over[b.pair_shard[over] != shard]
            pairs = np.union1d(own, over) if len(over) else own
            asked, context = b.pair_shard[pairs] == shard, np.searchsorted(pairs, b.context[triples])
            key = b.pairs[pairs]
            rows.append((shard, _pack(_fewer((key >> U(32)).astype(np.int64)), key & U(0xFFFFFFFF), np.where(asked, b.pair_count[pairs], 0), asked,
                                      np.bincount(context, minlength=len(pairs)), b.word[triples], b.triple_count[triples])))
        return pa.table({"shard": pa.array([s for s, _ in rows], pa.int32()), "block": pa.array(np.full(len(rows), texts["block"][0].as_py(), np.int64)),
                         "blob": pa.array([x for _, x in rows], pa.binary())})
    return run


def _sum_of(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    found, back = np.unique(keys, return_inverse=True)
    return found, back, np.bincount(back, weights=counts, minlength=len(found)).astype(np.int64)


def _answer(total: int):
    """Build the trie of one shard from all blocks' counts and answer each block: codes of its pairs and triples."""
    def run(asked: pa.Table) -> pa.Table:
        parts = [_unpack(x) for x in asked["blob"].to_pylist()]
        key = np.concatenate([(np.cumsum(p[0]).astype(np.uint64) << U(32)) | p[1].astype(np.uint64) for p in parts])
        at = np.cumsum([0, *[len(p[0]) for p in parts]])
        pairs, back, pair_count = _sum_of(key, np.concatenate([p[2] for p in parts]))
        context = back[np.concatenate([np.repeat(np.arange(len(p[0])) + a, p[4]) for p, a in zip(parts, at, strict=False)])]
        triples, which, count = _sum_of((context.astype(np.uint64) << U(32)) | np.concatenate([p[5] for p in parts]).astype(np.uint64), np.concatenate([p[6] for p in parts]))
        context, word = (triples >> U(32)).astype(np.int64), (triples & U(0xFFFFFFFF)).astype(np.int64)
        learnt_pair = pair_count > 0
        learnt_pair[context[count > 0]] = True
        number = np.cumsum(learnt_pair) - 1
        trie = NgramTrie.build(pairs[learnt_pair], pair_count[learnt_pair], number[context[count > 0]], word[count > 0], count[count > 0], total)
        pair_code, triple_code = trie.look_up(pairs, context, word)
        blobs, t = [], 0
        for p, a in zip(parts, at, strict=False):
            mine = back[a:a + len(p[0])][p[3] > 0]
            blobs.append(_pack(pair_code[mine], triple_code[which[t:t + len(p[5])]]))
            t += len(p[5])
        return pa.table({"block": asked["block"], "shard": asked["shard"], "blob": pa.array(blobs, pa.binary())})
    return run


def _score(shards: int, slice_count: int, tokens: int, types: int, strength: tuple[float, float]):
    """Sums (block, at, n_tokens, n_known, base_score, score) of one block's texts."""
    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return pa.table({"block": pa.array([], pa.int64()), "at": pa.array([], pa.int32()), "n_tokens": pa.array([], pa.int64()), "n_known": pa.array([], pa.int64()),
                             "base_score": pa.array([], pa.float64()), "score": pa.array([], pa.float64())})
        word = answers.filter(pc.invert(answers["trie"]))
        gram = dict(_answers_of(answers.filter(answers["trie"])))
        b = _Block(texts["blob"][0].as_py(), _answers_of(word), shards, slice_count)
        pair_code, triple_code = np.zeros(len(b.pairs), np.uint8), np.zeros(len(b.word), np.uint8)
        for shard, pairs, triples in b.asked():
            pair_code[pairs], triple_code[triples] = _unpack(gram[shard])
        mass = tokens * 10.0 ** log_probabilities(tokens)
        m2, m3 = strength
        p1 = (b.count + 1) / (tokens + types + 1)
        c2, c3, c_context = (np.zeros(len(p1)) for _ in range(3))
        c2[b.has_pair] = mass[pair_code[b.pair_of]]
        c3[b.has_triple] = mass[triple_code[b.triple_of]]
        c_context[b.has_triple] = mass[pair_code[b.context_of]]
        p2 = (np.minimum(c2, b.v_count) + m2 * p1) / (b.v_count + m2)
        # a first word has no longer context: no count, so the pair's probability stays
        p3 = (np.minimum(c3, c_context) + m3 * p2) / (c_context + m3)
        owner = np.repeat(np.arange(len(b.size)), b.size)
        n = len(b.size)
        add = lambda x: pa.array(np.bincount(owner, weights=x, minlength=n))
        return pa.table({"block": pa.array(np.full(n, texts["block"][0].as_py(), np.int64)), "at": pa.array(np.arange(n, dtype=np.int32)), "n_tokens": pa.array(b.size),
                         "n_known": pa.array(np.bincount(owner, weights=b.count > 0, minlength=n).astype(np.int64)), "base_score": add(np.log10(p1)), "score": add(np.log10(p3))})
    return run


def model_scores(observations: DataFrame, obs_id: str = "obs_id", text: str = "text", folds: int = 7, out: int = 2,
                 strength: tuple[float, float] = STRENGTH, block_words: int = BLOCK_WORDS,
                 word_shard_bytes: int = WORD_SHARD_BYTES, trie_shard_bytes: int = TRIE_SHARD_BYTES, slice_count: int = SLICE_COUNT,
                 part_bytes: int = PART_BYTES) -> DataFrame:
    """Log-probability of each observation text under a trigram model of the corpus.

    Learns from the texts whose crc32(obs_id) modulo ``folds`` is not ``out``. Tokens are the words (runs
    of anything but blank and 0x09-0x0D, A-Z in lower case) and one end. Returns obs_id, held_out, n_tokens,
    n_known (tokens that were learned), train_tokens, base_score (unigrams with one added) and score, both
    log10 over the whole text; one row per row.

    Null texts are empty: an end alone. Null obs_id: learned from, not held out. Repeated rows are each
    learned from and scored alike. Other columns are ignored; an empty table gives an empty result; with
    nothing to learn from every word is unknown. Long texts are whole, in one block. All n-grams of the
    corpus are kept, single ones too. Words are told apart by 64-bit hashes. Memory: one block, or one
    shard (its questions from all blocks, about TRIE_SHARD_BYTES of text). The number of partitions follows the bytes of
    text, so that tasks stay as large on more text. The blocks are written once to
    the shared folder, so a lost executor re-reads them.
    """
    spark = observations.sparkSession
    small_batches(spark)
    rows = fields(observations, id=obs_id, text=text).select("id", F.coalesce(~learnt("id", folds, out), F.lit(False)).alias("held_out"), "text")
    volume = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    word_shards, trie_shards = 1 + volume // word_shard_bytes, 1 + volume // trie_shard_bytes
    shape = T.StructType([T.StructField("block", T.LongType()), T.StructField("shard", T.IntegerType()), T.StructField("blob", T.BinaryType()), rows.schema["id"],
                          T.StructField("held_out", T.BooleanType()), T.StructField("at", T.IntegerType())])
    blocks = cut(rows.mapInArrow(_blocks(word_shards, block_words), shape))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + volume // part_bytes)
    by = lambda df, key: df.repartition(parts, key).groupBy(key)
    texts = blocks.where("blob is not null and shard is null").select("block", "blob")
    asks = blocks.where("shard is not null").select("block", "shard", "blob")
    words = cut(by(asks, "shard").applyInArrow(_vocabulary(word_shards), "block bigint, shard int, blob binary, tokens bigint, types bigint"))
    # one row of sums per vocabulary shard
    sums = words.where("block is null").agg(F.sum("tokens").alias("tokens"), F.sum("types").alias("types")).first()
    tokens, types = sums["tokens"] or 0, sums["types"] or 0
    answers = words.where("block is not null").select("block", "shard", "blob")
    asked = by(texts, "block").cogroup(by(answers, "block")).applyInArrow(_ask_trie(trie_shards, slice_count), "shard int, block bigint, blob binary")
    told = by(asked, "shard").applyInArrow(_answer(tokens), "block bigint, shard int, blob binary")
    both = answers.withColumn("trie", F.lit(False)).unionByName(told.withColumn("trie", F.lit(True)))
    done = by(texts, "block").cogroup(by(both, "block")).applyInArrow(
        _score(trie_shards, slice_count, tokens, types, strength), "block bigint, at int, n_tokens bigint, n_known bigint, base_score double, score double")
    ids = blocks.where("at is not null").select("block", "at", "id", "held_out")
    return ids.join(done, ["block", "at"]).select(F.col("id").alias(obs_id), "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
