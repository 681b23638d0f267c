"""Language of observation texts by the nearest of several centroids per language.

A text is a vector of its character n-grams (one to three bytes of lower-cased letters and single
blanks, hashed to 2**bits dimensions), weighted by TF-IDF and normalised. The inverse document
frequencies come from all texts that may be learned from. Spherical k-means over a bounded sample of
labelled vectors gives several centroids per language; a text gets the language of the centroid of
greatest cosine, and is rejected when even that one is farther than texts of its length are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from obsweave.llm.common import fields, learnt, small_batches
from obsweave.llm.textbytes import LOWER, Texts, slices

GRAMS = (1, 2, 3)
#: Lengths of texts are told apart by powers of two of their number of letters, up to 2**16.
LENGTHS = 17
#: Sampled texts from which a length class has a limit of its own.
CLASS_TEXTS = 20

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_FACTOR = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))


def only_letters(text) -> Column:
    """A text with a blank for each run of anything but letters, by Unicode category."""
    return F.regexp_replace(text, r"[^\p{L}]+", " ")


def _letters(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letters with one blank for each run of anything else, and the text of each byte."""
    data = LOWER[texts.data]
    if len(data):
        # capitals of the Latin-1 letters: second byte 0x80-0x9E after 0xC3
        cap = np.zeros(len(data), bool)
        cap[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        data = np.where(cap, data + 32, data).astype(np.uint8)
    ink = _LETTER[data]
    owner = np.repeat(np.arange(texts.n), np.diff(texts.off))
    keep = ink.copy()
    keep[1:] |= ink[:-1] & (owner[1:] == owner[:-1])
    return np.where(ink, data, 0x20).astype(np.uint8)[keep], owner[keep]


def clean_texts(texts: Texts) -> Texts:
    """The same texts as lower-case words of letters, one blank after each."""
    data, owner = _letters(texts)
    return Texts(data, np.searchsorted(owner, np.arange(texts.n + 1)))


def gram_counts(texts: Texts, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the n-grams, one row per text and one column per dimension, and the number of letters of each text."""
    data, owner = _letters(texts)
    wide, total = data.astype(np.uint32), np.zeros(texts.n << bits, np.int64)
    for n in GRAMS:
        if len(data) >= n:
            h = np.full(len(data) - n + 1, n, np.uint32)
            for k in range(n):
                h = (h ^ wide[k:k + len(h)]) * _FACTOR[k]
                h ^= h >> np.uint32(15)
            same = owner[:len(h)] == owner[n - 1:]
            total += np.bincount((owner[:len(h)][same] << bits) | (h[same] & np.uint32((1 << bits) - 1)), minlength=len(total))
    return total.reshape(texts.n, 1 << bits), np.bincount(owner[data != 0x20], minlength=texts.n)


def _weighted(texts: Texts, bits: int, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Normalised TF-IDF vectors, one row per text, and the number of letters of each text."""
    count, letters = gram_counts(texts, bits)
    x = np.where(count > 0, (1 + np.log(np.maximum(count, 1))), 0).astype(np.float32) * idf
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=x, where=norm > 0), letters


def _frequencies(bits: int):
    """Per task: in how many texts each dimension occurs, and how many texts there are (dimension -1)."""
    def run(batches):
        df, n = np.zeros(1 << bits, np.int64), 0
        for batch in batches:
            for _, texts in slices(batch, "text"):
                df += (gram_counts(texts, bits)[0] > 0).sum(axis=0)
                n += texts.n
        dim = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(dim, -1)), pa.array(np.append(df[dim], n))], names=["dim", "df"])
    return run


def _vectors(bits: int, idf: np.ndarray):
    def run(batches):
        for batch in batches:
            for part, texts in slices(batch, "text"):
                x, letters = _weighted(texts, bits, idf)
                yield pa.RecordBatch.from_arrays([part.column("lang"), part.column("mark"), pa.array(letters), pa.array([v.tobytes() for v in x], pa.binary())],
                                                 names=["lang", "mark", "letters", "x"])
    return run


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Unit centroids of unit rows; starts from rows spread by greatest distance, so it is repeatable."""
    k = min(k, len(x))
    picked = [int(np.argmax(x @ x.mean(axis=0)))]
    near = x @ x[picked[0]]
    while len(picked) < k:
        # a quantile rather than the extreme, which would be an outlier
        picked.append(int(np.argsort(near, kind="stable")[len(x) // 50]))
        near = np.maximum(near, x @ x[picked[-1]])
    c = x[picked].copy()
    for _ in range(rounds):
        at = np.argmax(x @ c.T, axis=1)
        for j in range(k):
            if (at == j).any():
                m = x[at == j].mean(axis=0)
                c[j] = m / max(np.linalg.norm(m), 1e-12)
    return c


def _length(letters: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(letters, 1)).astype(int), LENGTHS - 1)


def fit(x: np.ndarray, letters: np.ndarray, langs: np.ndarray, idf: np.ndarray, bits: int, per_lang: int, slack: float) -> dict:
    """Centroids with their languages, and for each length class the least cosine that is still accepted."""
    names, centroids = [], []
    for lang in sorted(set(langs)):
        c = spherical_kmeans(x[(langs == lang) & (letters > 0)], per_lang) if ((langs == lang) & (letters > 0)).any() else np.zeros((0, 1 << bits), np.float32)
        names += [str(lang)] * len(c)
        centroids.append(c)
    c = np.concatenate(centroids) if centroids else np.zeros((0, 1 << bits), np.float32)
    floor = np.zeros(LENGTHS, np.float32)
    if len(c):
        best, size = (x @ c.T).max(axis=1), _length(letters)
        own = [np.quantile(best[(size == k) & (letters > 0)], 0.01) * slack if ((size == k) & (letters > 0)).sum() >= CLASS_TEXTS else np.inf for k in range(LENGTHS)]
        # longer texts lie nearer: a class never asks for more than a longer one, and one with few texts goes with its neighbours
        known = [k for k in range(LENGTHS) if np.isfinite(own[k])]
        if known:
            for k in range(LENGTHS):
                floor[k] = min(own[k:known[-1] + 1]) if known[0] <= k <= known[-1] else own[known[-1]] if k > known[-1] else 0.0
    return {"langs": names, "centroids": c, "floor": floor, "idf": idf, "bits": bits}


def _predict(model, kept: int = 0):
    def run(batches):
        m = model.value
        c, langs = m["centroids"], np.array([*m["langs"], "und"], object)
        extra = [f"keep_{i}" for i in range(kept)]
        for batch in batches:
            for part, texts in slices(batch, "text"):
                x, letters = _weighted(texts, m["bits"], m["idf"])
                if len(c):
                    cos = x @ c.T
                    at, best = cos.argmax(axis=1), np.clip(cos.max(axis=1), 0, 1).astype(float)
                else:
                    at, best = np.full(texts.n, -1), np.zeros(texts.n)
                at, best = np.where(letters > 0, at, -1), np.where(letters > 0, best, 0.0)
                out = (at < 0) | (best < m["floor"][_length(letters)])
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("held_out"), pa.array(langs[at], pa.string()), pa.array(best), pa.array(out),
                                                  *[part.column(k) for k in extra]], names=["id", "held_out", "lang_pred", "score", "rejected", *extra])
    return run


def train(observations: DataFrame, obs_id: str = "obs_id", text: str = "text", lang: str = "lang", folds: int = 4, out: int = 2, bits: int = 11,
          fit_rows: int = 1500, per_lang: int = 6, slack: float = 0.8) -> dict:
    """Learn from the texts with a language whose crc32(obs_id) modulo ``folds`` is not ``out``.

    Document frequencies come from all of them; the centroids from about ``fit_rows`` texts of each
    language, chosen by a hash of id and text.
    """
    small_batches(observations.sparkSession)
    rows = fields(observations, id=obs_id, text=text, lang=lang).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.coalesce(learnt("id", folds, out), F.lit(True)))
    rows = rows.select("id", "lang", only_letters(F.col("text")).alias("text"))
    got = rows.select("text").mapInArrow(_frequencies(bits), "dim bigint, df bigint").groupBy("dim").agg(F.sum("df").alias("df")).toPandas()
    df = np.zeros(1 << bits)
    seen = got[got["dim"] >= 0]
    df[seen["dim"]] = seen["df"]
    n = float(got.loc[got["dim"] < 0, "df"].sum())
    idf = (np.log((n + 1) / (df + 1)) + 1).astype(np.float32)
    # one number a language, of which the model holds several centroids each; the dice fall before a text moves
    share = {r["lang"]: min(1.0, fit_rows / r["n"]) for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    dice = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    taken = F.try_element_at(F.create_map(*[F.lit(x) for pair in share.items() for x in pair]), F.col("lang")) if share else F.lit(0.0)
    chosen = rows.where(dice < taken).select("lang", F.xxhash64("id", "text").alias("mark"), "text")
    # the sample's vectors are of one size whatever the texts, so fit_rows bounds what the driver holds
    sample = chosen.mapInArrow(_vectors(bits, idf), "lang string, mark bigint, letters bigint, x binary").toPandas().sort_values(["lang", "mark"])
    x = np.frombuffer(b"".join(sample["x"]), np.float32).reshape(len(sample), 1 << bits)
    return fit(x, sample["letters"].to_numpy(), sample["lang"].to_numpy(), idf, bits, per_lang, slack)


def identify(observations: DataFrame, model: dict, obs_id: str = "obs_id", text: str = "text", folds: int = 4, out: int = 2,
             keep: tuple[str, ...] = ()) -> DataFrame:
    """Language of each observation text: obs_id, held_out, lang_pred, score (cosine), rejected, kept columns; one row per input row.

    Letters are those of Unicode; everything else parts words. A text is rejected when its cosine is below
    what nearly all texts of its length have, shorter ones being allowed less. Null texts and texts without letters get ``und``, score 0 and are rejected; so does everything
    when nothing could be learned. Repeated rows get equal results. Null obs_id: kept, not held out.
    Other columns are ignored. An empty table gives an empty result. Ties go to the first language by
    name. Long texts are read whole; memory is a slice of texts or one text.
    """
    spark = observations.sparkSession
    small_batches(spark)
    rows = fields(observations, id=obs_id, text=text, **{f"keep_{i}": c for i, c in enumerate(keep)})
    rows = rows.select("id", F.coalesce(~learnt("id", folds, out), F.lit(False)).alias("held_out"), only_letters(F.col("text")).alias("text"), *[f"keep_{i}" for i in range(len(keep))])
    shape = T.StructType([rows.schema["id"], T.StructField("held_out", T.BooleanType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
                          T.StructField("rejected", T.BooleanType()), *[rows.schema[f"keep_{i}"] for i in range(len(keep))]])
    got = rows.mapInArrow(_predict(spark.sparkContext.broadcast(model), len(keep)), shape)
    return got.withColumnsRenamed({"id": obs_id} if not keep else {f"keep_{i}": c for i, c in enumerate(keep)}).drop(*(["id"] if keep else []))
