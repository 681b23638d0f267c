"""Toxic observation texts by weak supervision.

Many voters look at each text: fixed lexicons, lexicons of word stems induced from annotated texts
and patterns of writing. A generative label model explains all ballots by a hidden label: expectation
maximisation gives each voter's rates of speaking up on toxic and on other texts, and what two voters
still have in common within one label is their correlation, for which they share their weight. The
posterior of the votes then labels a sample, on which a linear classifier over hashed words and word
stems is trained; it scores every text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from obsweave.llm.common import cut, fields, learnt, small_batches
from obsweave.llm.language import clean_texts
from obsweave.llm.textbytes import U, Texts, mix, slices

#: Insults by language, as seed lexicons.
LEXICONS = {
    "en": ["idiot", "idiots", "moron", "morons", "stupid", "dumb", "loser", "losers", "scum", "trash", "pathetic", "worthless", "disgusting", "clown", "clowns", "garbage"],
    "fr": ["connard", "abruti", "imbécile", "crétin", "débile", "ordure", "minable"],
    "de": ["idiotisch", "trottel", "dummkopf", "abschaum", "versager", "widerlich", "erbärmlich"],
    "es": ["idiota", "imbécil", "estúpido", "basura", "escoria", "patético", "asqueroso", "payaso"],
}
STEMS = (4, 5, 6)
#: Lexicons go by words of up to so many bytes and by the stems of longer ones.
VOTE_STEM = 5
INDUCED = 24
#: Stems that each toxic text of the sample puts forward for the induced lexicons.
NOMINATED = 3
#: Share of toxic texts that a stem must have with 95 % to be put forward.
LEAST_SURE = 0.5
#: Standard deviations between the mean label of a dimension's texts and that of all, for it to enter the classifier.
LEAST_DEVIATIONS = 4.0
#: Dimensions of the classifier, those farthest from chance.
MOST_DIMENSIONS = 20_000
PATTERNS = ("shouting", "exclaiming", "short", "silent")
#: Where the rates of the voter that speaks up when no lexicon does begin: other and toxic texts.
SILENT = (0.95, 0.2)


def stem_features(texts: Texts, bits: int, stems: tuple[int, ...] = STEMS, longer_words: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(text, dimension) of every word and of every stem of a longer word, once per text.

    Without ``longer_words`` a word that has a stem is that stem alone, so one word is one dimension.
    """
    clean = clean_texts(texts)
    start, end, before = clean.words()
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    sums = clean.sums()
    owner = np.repeat(np.arange(texts.n), np.diff(before))
    whole = slice(None) if longer_words else end - start <= min(stems)
    rows, dims = [owner[whole]], [clean.hashes(sums, start[whole], end[whole]) >> U(64 - bits)]
    for n in stems:
        longer = end - start > n
        rows.append(owner[longer])
        dims.append(mix(clean.hashes(sums, start[longer], start[longer] + n) + U(n)) >> U(64 - bits))
    key = np.unique((np.concatenate(rows) << bits) | np.concatenate(dims).astype(np.int64))
    return key >> bits, key & ((1 << bits) - 1)


def _word_dims(words: list[str], bits: int) -> np.ndarray:
    return stem_features(Texts.of(pa.array(words, pa.string())), bits, (VOTE_STEM,), False)[1]


def fires(texts: Texts, voter_of: np.ndarray, voters: int, bits: int) -> np.ndarray:
    """Which voters speak up on each text (texts x voters)."""
    rows, dims = stem_features(texts, bits, (VOTE_STEM,))
    hit = np.zeros((texts.n, voters), bool)
    for table in voter_of:  # seed lexicons and induced ones may share a word
        v = table[dims].astype(np.int64)
        hit[rows[v >= 0], v[v >= 0]] = True
    size = np.maximum(np.diff(texts.off), 1)
    count = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[texts.off])
    upper, letter = (texts.data >= 65) & (texts.data <= 90), ((texts.data | 32) >= 97) & ((texts.data | 32) <= 122)
    k = voters - len(PATTERNS)
    hit[:, k] = count(upper) > 0.5 * np.maximum(count(letter), 1)
    hit[:, k + 1] = count(texts.data == 33) > 0.02 * size
    hit[:, k + 2] = size < 100
    hit[:, k + 3] = ~hit[:, :k].any(axis=1)
    return hit


def _stem_labels(bits: int):
    """Per task: in how many toxic and other annotated texts each dimension occurs (dimension -1: the texts)."""
    def run(batches):
        total, n = ([], []), [0, 0]
        for batch in batches:
            for part, texts in slices(batch, "text"):
                y = part.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64)
                rows, dims = stem_features(texts, bits, (VOTE_STEM,))
                for k in (0, 1):
                    total[k].append(dims[y[rows] == k])
                    n[k] += int((y == k).sum())
        # the annotated sample is bounded, and so is what one task holds of it
        found = [np.unique(np.concatenate([np.full(n[k], -1), *total[k]]), return_counts=True) for k in (0, 1)]
        for k, (dim, count) in enumerate(found):
            none = np.zeros(len(dim), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(dim.astype(np.int64)), pa.array(count if k else none), pa.array(none if k else count)], names=["dim", "pos", "neg"])
    return run


def _stems_of(bits: int):
    """Rows (mark, dim): the stems of each text."""
    def run(batches):
        for batch in batches:
            for part, texts in slices(batch, "text"):
                rows, dims = stem_features(texts, bits, (VOTE_STEM,))
                yield pa.RecordBatch.from_arrays([part.column("mark").take(pa.array(rows)), pa.array(dims)], names=["mark", "dim"])
    return run


def surely_toxic() -> Column:
    """Share of toxic texts among those with a stem (``pos`` and ``neg`` of them) that holds with 95 % (Wilson's bound): few texts say little."""
    n, z = F.col("pos") + F.col("neg"), 1.64
    p = F.col("pos") / n
    return (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def _ballots(bits: int, voter_of, voters: int):
    """Per text its votes as the bits of one number."""
    def run(batches):
        place = np.int64(1) << np.arange(voters, dtype=np.int64)
        for batch in batches:
            for _, texts in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([pa.array(fires(texts, voter_of.value, voters, bits) @ place)], names=["votes"])
    return run


def posterior(f: np.ndarray, m: dict) -> np.ndarray:
    """Probability of the toxic label given the votes; not to speak up is to abstain, correlated voters share their weight."""
    on = np.log(m["toxic"] / m["other"])
    z = np.log(m["prior"] / (1 - m["prior"])) + (f * on / (1 + f @ m["linked"])).sum(axis=1)
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _expected(voters: int, model: dict):
    """Per task, over the ballots weighted by their number: sums by label of the votes and of their products."""
    def run(batches):
        second, n = np.zeros((2, voters, voters)), np.zeros(2)
        for batch in batches:
            votes, c = batch.column("votes").to_numpy(), batch.column("c").to_numpy().astype(float)
            f = ((votes[:, None] >> np.arange(voters)) & 1).astype(float)
            q = posterior(f, model)
            for k, w in enumerate((c * (1 - q), c * q)):
                second[k] += (f * w[:, None]).T @ f
                n[k] += w.sum()
        k, i, j = np.nonzero(second)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([k, [0, 1]])), pa.array(np.concatenate([i, [-1, -1]])), pa.array(np.concatenate([j, [-1, -1]])),
                                          pa.array(np.concatenate([second[k, i, j], n]))], names=["k", "i", "j", "v"])
    return run


def label_model(ballots: DataFrame, start: np.ndarray, patterns: int, prior: float, rounds: int = 5) -> dict:
    """Rates at which each voter speaks up on toxic and other texts, and the correlations of voters.

    Expectation maximisation over all ballots (distinct votes and their number), each round one sum in
    Spark; only sums by voter and by pair of voters come back. It starts from the rates in annotated
    texts (``start``: other, toxic; patterns from their share of all texts), which also stay four
    fifths of every estimate, so the hidden label remains this one and not, say, the language. The covariance of two voters within one label, which independent voters would not have, is
    their correlation, by which they share their weight where both vote alike.
    """
    model, voters = None, start.shape[1]
    for step in range(rounds + 1):
        if model is None:
            mean = np.zeros(voters)
            total = ballots.agg(F.sum("c").alias("n"), *[F.sum(F.getbit("votes", F.lit(j)).cast("long") * F.col("c")).alias(f"v{j}") for j in range(voters)]).first()
            n = float(total["n"] or 0)
            mean[:] = [float(total[f"v{j}"] or 0) / max(n, 1) for j in range(voters)]
            start = np.clip(start, 0, 0.9)
            start[:, voters - patterns:] = mean[voters - patterns:]
            start[:, -1] = SILENT
            other, toxic = start
            linked = np.zeros((voters, voters))
        else:
            second, size = np.zeros((2, voters, voters)), np.zeros(2)
            for r in ballots.mapInArrow(_expected(voters, model), "k bigint, i bigint, j bigint, v double").groupBy("k", "i", "j").agg(F.sum("v").alias("v")).collect():
                if r["i"] < 0:
                    size[r["k"]] = r["v"]
                else:
                    second[r["k"], r["i"], r["j"]] = r["v"]
            rate = [(np.diag(second[k]) + 0.01) / (size[k] + 1) for k in (0, 1)]
            other, toxic = (0.2 * rate[k] + 0.8 * start[k] for k in (0, 1))
            if step == rounds:
                linked = np.zeros((voters, voters))
                for k in (0, 1):
                    sd = np.sqrt(np.maximum(rate[k] * (1 - rate[k]), 1e-9))
                    linked = np.maximum(linked, (second[k] / max(size[k], 1) - np.outer(rate[k], rate[k])) / np.outer(sd, sd) * (size[k] > 0))
                np.fill_diagonal(linked, 0)
                linked = np.where(linked > 0.3, linked, 0)
        floor = 0.1 / max(n, 10)
        model = {"toxic": np.clip(toxic, floor, 1 - floor), "other": np.clip(other, floor, 1 - floor), "linked": linked, "prior": prior}
    return model


def _sampled(bits: int, voter_of, voters: int, model: dict):
    """Per text its features and the posterior of its votes."""
    def run(batches):
        for batch in batches:
            for part, texts in slices(batch, "text"):
                rows, dims = stem_features(texts, bits)
                y = posterior(fires(texts, voter_of.value, voters, bits).astype(float), model)
                edge = np.searchsorted(rows, np.arange(texts.n + 1))
                x = [dims[a:b].astype(np.int32).tobytes() for a, b in zip(edge, edge[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([part.column("mark"), pa.array(y), pa.array(x, pa.binary())], names=["mark", "y", "x"])
    return run


def _label_sums():
    """Per task: in how many texts of the sample each dimension occurs, and the sum of their labels."""
    def run(batches):
        for batch in batches:
            x = [np.frombuffer(v.as_py(), np.int32) for v in batch.column("x")]
            y = np.repeat(batch.column("y").to_numpy(), [len(v) for v in x])
            dims, at, n = np.unique(np.concatenate(x), return_inverse=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(dims.astype(np.int64)), pa.array(n), pa.array(np.bincount(at, y, minlength=len(dims)))], names=["dim", "n", "y"])
    return run


def _only(dims: np.ndarray):
    """The sample with nothing but these (sorted) dimensions, by their place."""
    def run(batches):
        for batch in batches:
            kept = []
            for v in batch.column("x"):
                x = np.frombuffer(v.as_py(), np.int32)
                kept.append(np.flatnonzero(np.isin(dims, x, assume_unique=True)).astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("mark"), batch.column("y"), pa.array(kept, pa.binary())], names=["mark", "y", "x"])
    return run


def logistic(x: list[np.ndarray], y: np.ndarray, dims: int, rounds: int = 200, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on sets of dimensions with soft labels (Adagrad, full passes)."""
    w, gw = np.zeros(dims), np.full(dims, 1e-8)
    if not len(y):
        return w, 0.0
    row, col = np.repeat(np.arange(len(x)), [len(v) for v in x]), np.concatenate(x)
    p = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    b, gb = float(np.log(p / (1 - p))), 1e-8
    for _ in range(rounds):
        z = b + np.bincount(row, w[col], minlength=len(y))
        e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
        g = np.bincount(col, e[row], minlength=dims) + ridge * w
        gw, gb = gw + g * g, gb + e.sum() ** 2
        w, b = w - 0.5 * g / np.sqrt(gw), b - 0.2 * e.sum() / np.sqrt(gb)
    return w, b


def fit_linear(sample: DataFrame, bits: int) -> tuple[np.ndarray, float]:
    """The classifier on a labelled sample, over the dimensions whose mean label is far from chance.

    The rest would add up to noise in long texts; it is left out before anything reaches the driver.
    """
    whole = sample.agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("p")).first()
    weights = np.zeros(1 << bits, np.float32)
    if not whole["n"]:
        return weights, 0.0
    p = float(np.clip(whole["p"], 1e-3, 1 - 1e-3))
    sums = sample.mapInArrow(_label_sums(), "dim bigint, n bigint, y double").groupBy("dim").agg(F.sum("n").alias("n"), F.sum("y").alias("y"))
    far = F.abs(F.col("y") - F.col("n") * p) / F.sqrt(F.col("n") * (p * (1 - p)))
    best = sums.where((F.col("n") > 1) & (far >= LEAST_DEVIATIONS)).orderBy(F.desc(far), "dim").limit(MOST_DIMENSIONS).select("dim").collect()
    dims = np.sort(np.array([r["dim"] for r in best], np.int32))
    rows = sample.mapInArrow(_only(dims), "mark bigint, y double, x binary").toPandas().sort_values("mark")
    w, b = logistic([np.frombuffer(v, np.int32) for v in rows["x"]], rows["y"].to_numpy(), len(dims))
    weights[dims] = w
    return weights, b


def train(observations: DataFrame, annotations: DataFrame, obs_id: str = "obs_id", text: str = "text", toxic: str = "toxic", folds: int = 5, out: int = 0,
          bits: int = 22, fit_rows: int = 20000) -> dict:
    """Learn from annotated texts whose crc32(obs_id) modulo ``folds`` is not ``out``.

    Where an id has several annotations, one toxic one makes it toxic; rows of one id and several texts all have
    its label. Stems come from about ``fit_rows`` annotated texts and the classifier from about as many texts of
    the same folds, both chosen by hash; the label model takes the ballots of all texts.
    """
    spark = observations.sparkSession
    small_batches(spark)
    rows = fields(observations, id=obs_id, text=text)
    ours = rows.where("id is not null").where(learnt("id", folds, out))
    marks = fields(annotations, id=obs_id, toxic=toxic).where("id is not null and toxic in (0, 1)").where(learnt("id", folds, out)).groupBy("id").agg(F.max("toxic").alias("toxic"))
    dice = lambda salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    some = marks.where(dice(1) < fit_rows / max(marks.count(), 1)).select("id", F.col("toxic").cast("int").alias("toxic"))
    # about fit_rows rows of two numbers, whatever the tables hold
    seen = (rows.join(F.broadcast(some), "id").select("text", "toxic").mapInArrow(_stem_labels(bits), "dim bigint, pos bigint, neg bigint")
            .groupBy("dim").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")))
    both = seen.where("dim < 0").first()
    pos, neg = (float(both["pos"]), float(both["neg"])) if both else (0.0, 0.0)
    prior = float(np.clip((pos + 1) / (pos + neg + 2), 0.01, 0.99))
    # every toxic text puts its best stems forward, so a language with few annotated texts has its own
    weighed = seen.where("dim >= 0 and pos > 0").withColumn("sure", surely_toxic()).where(F.col("sure") > LEAST_SURE)
    own = rows.join(F.broadcast(some.where("toxic = 1")), "id").select("text", F.xxhash64("id", "text").alias("mark")).mapInArrow(_stems_of(bits), "mark bigint, dim bigint")
    turn = Window.partitionBy("mark").orderBy(F.desc("sure"), "dim")
    picked = own.join(weighed, "dim").withColumn("turn", F.row_number().over(turn)).where(F.col("turn") <= NOMINATED)
    # at most NOMINATED rows for each toxic text of the sample
    best = picked.select("dim", "pos", "neg", "sure").distinct().orderBy(F.desc("sure"), "dim").collect()

    seeds = {int(d): k for k, words in enumerate(LEXICONS.values()) for d in _word_dims(words, bits)}
    voters = len(LEXICONS) + INDUCED + len(PATTERNS)
    voter_of, start = np.full((2, 1 << bits), -1, np.int8), np.zeros((2, voters))
    counted = [(seeds[r["dim"]], 0, r) for r in seen.where(F.col("dim").isin(list(seeds))).collect()]
    counted += [(len(LEXICONS) + k * INDUCED // len(best), 1, r) for k, r in enumerate(best)]
    for dim, k in seeds.items():
        voter_of[0, dim] = k
    for k, table, r in counted:
        voter_of[table, r["dim"]] = k
        start[:, k] += r["neg"] / max(neg, 1), r["pos"] / max(pos, 1)
    shared = spark.sparkContext.broadcast(voter_of)
    ballots = cut(rows.select("text").mapInArrow(_ballots(bits, shared, voters), "votes bigint").groupBy("votes").agg(F.count(F.lit(1)).alias("c")))
    model = label_model(ballots, start, len(PATTERNS), prior)
    sample = cut(ours.where(dice(2) < fit_rows / max(ours.count(), 1)).select("text", F.xxhash64("id", "text").alias("mark"))
                 .mapInArrow(_sampled(bits, shared, voters, model), "mark bigint, y double, x binary"))
    w, b = fit_linear(sample, bits)
    return {"weights": w, "bias": b, "bits": bits, "labels": model, "voters": voter_of}


def _score(model):
    def run(batches):
        m = model.value
        for batch in batches:
            for part, texts in slices(batch, "text"):
                rows, dims = stem_features(texts, m["bits"])
                z = m["bias"] + np.bincount(rows, m["weights"][dims], minlength=texts.n)
                p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("held_out"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))],
                                                 names=["id", "held_out", "score", "predicted"])
    return run


def score(observations: DataFrame, model: dict, obs_id: str = "obs_id", text: str = "text", folds: int = 5, out: int = 0) -> DataFrame:
    """Toxicity of each observation text: obs_id, held_out, score (0 to 1), predicted (1 from 0.5 on), one row per input row.

    Null and empty texts and texts without words get the score of a text of which nothing is known.
    Without annotations only the fixed lexicons and patterns vote. Repeated rows get equal results.
    Null obs_id: kept, not held out, not learned from. Other columns are ignored. An empty table
    gives an empty result. Long texts are read whole; memory is a slice of texts or one text.
    """
    spark = observations.sparkSession
    small_batches(spark)
    rows = fields(observations, id=obs_id, text=text).select("id", F.coalesce(~learnt("id", folds, out), F.lit(False)).alias("held_out"), "text")
    kind = rows.schema["id"].dataType.simpleString()
    keep = {k: model[k] for k in ("weights", "bias", "bits")}
    return rows.mapInArrow(_score(spark.sparkContext.broadcast(keep)), f"id {kind}, held_out boolean, score double, predicted int").withColumnRenamed("id", obs_id)
