"""Quality scores: hashed word n-grams, logistic regression with FTRL updates."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import quoted
from plumbline.llm.common import CACHE_ENTRIES, by_bytes, fold, labelled_sample, words_of

#: Number of weights; n-grams are hashed into them.
BUCKETS = 1 << 18
#: A feature's value is SCALE times its share of the document's n-grams.
SCALE = 20.0
#: Bounds of the training sample: rows of either class, and bytes of a training text.
ROWS_PER_CLASS, TRAIN_BYTES = 1500, 16_384
_LOWER, _UPPER = re.compile(r"[^\W\d_A-ZÀ-ÖØ-Þ]+"), re.compile(r"[A-ZÀ-ÖØ-Þ]+")


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1


class NGrams:
    """Documents -> hashed 1- and 2-grams of their words and of the words' shapes.

    A shape keeps punctuation and replaces runs of letters by their case; a word that repeats
    the one before it is written as a mark, so that repetition itself is a bigram.
    """

    def __init__(self) -> None:
        self.words: dict[str, tuple[int, int]] = {}

    def _of(self, word: str) -> tuple[int, int]:
        found = self.words.get(word)
        if found is None:
            if len(self.words) > CACHE_ENTRIES:
                self.words.clear()
            shape = _UPPER.sub("A", _LOWER.sub("a", word))
            found = self.words[word] = (_hash("w" + word), _hash("s" + shape[:24]))
        return found

    def buckets(self, text: str | None) -> np.ndarray:
        words = words_of(text)
        if not words:
            return np.empty(0, np.int64)
        pairs = np.array([self._of(w) for w in words], np.int64)
        word, shape = pairs[:, 0], pairs[:, 1]
        parts = [word, shape]
        if len(words) > 1:
            follow = np.where(word[1:] == word[:-1], np.int64(12345), word[:-1] * np.int64(31) + word[1:])
            parts += [follow, shape[:-1] * np.int64(17) + shape[1:]]
        return (np.concatenate(parts).view(np.uint64) % np.uint64(BUCKETS)).astype(np.int64)


def _sparse(buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    index, count = np.unique(buckets, return_counts=True)
    return index, (SCALE / max(1, len(buckets))) * count


def train_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = 4, alpha: float = 0.3,
               beta: float = 1.0, l1: float = 0.002, l2: float = 0.01, seed: int = 7) -> tuple[np.ndarray, float]:
    """(weights, bias) after follow-the-regularised-leader updates, one document at a time.

    A weight is read off its accumulated gradients only when its feature occurs; coordinates
    whose accumulated gradient stays within ``l1`` are exactly 0. Without rows all weights are 0.
    """
    z, n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)

    def weights(i: np.ndarray) -> np.ndarray:
        excess = np.maximum(np.abs(z[i]) - l1, 0.0)
        return -np.sign(z[i]) * excess / ((beta + np.sqrt(n[i])) / alpha + l2)

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for at in rng.permutation(len(rows)):
            index, value, y = rows[at]
            index, value = np.append(index, BUCKETS), np.append(value, 1.0)
            w = weights(index)
            p = 1.0 / (1.0 + np.exp(-np.clip(w @ value, -35, 35)))
            g = (p - y) * value
            sigma = (np.sqrt(n[index] + g * g) - np.sqrt(n[index])) / alpha
            z[index] += g - sigma * w
            n[index] += g * g
    final = weights(np.arange(BUCKETS + 1)).astype(np.float32)
    return final[:-1], float(final[-1])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id",
        text: str = "text") -> tuple[np.ndarray, float]:
    """Train on a bounded sample of labelled rows outside the held-out fold.

    The sample is at most 2 * ROWS_PER_CLASS rows of at most TRAIN_BYTES bytes. Only texts
    and labels are looked at. Without labels the model has no weights and scores 0.5.
    """
    ngrams = NGrams()
    sample = labelled_sample(docs, labels, label, key, text, ROWS_PER_CLASS, TRAIN_BYTES)
    rows = sorted(sample.collect(), key=lambda r: str(r.k))
    return train_ftrl([(*_sparse(ngrams.buckets(r.t)), int(r.y)) for r in rows])


def score(df: DataFrame, model: tuple[np.ndarray, float], key: str = "doc_id", text: str = "text",
          threshold: float = 0.3) -> DataFrame:
    """``key``, held_out, score, predicted: one row per input row, whole texts.

    The score is the logistic function of the sparse dot product. Null and empty texts
    are scored by the bias alone. Extra columns are ignored, an empty table gives none.
    The model, a fixed number of weights, goes with the function to the tasks.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        ngrams, (weights, bias) = NGrams(), shared.value
        for column in columns:
            out = []
            for batch in by_bytes(column.to_pylist(), len, 4 << 20):
                for t in batch:
                    b = ngrams.buckets(t)
                    total = float(weights[b].sum(dtype=np.float64)) * SCALE / max(1, len(b)) + bias
                    out.append(1.0 / (1.0 + np.exp(-min(35.0, max(-35.0, total)))))
            yield pa.array(out, pa.float64())

    run.__annotations__ = {"columns": Iterator[pa.Array], "return": Iterator[pa.Array]}
    scored = df.select(quoted(key).alias("k"), F.arrow_udf(run, "double")(
        F.coalesce(quoted(text), F.lit(""))).alias("score"))
    return scored.select(F.col("k").alias(key), (F.coalesce(fold("k"), F.lit(0)) == 0).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))
