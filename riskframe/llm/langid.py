"""Language identification with hyperdimensional n-gram profiles.

Every letter has a random +1/-1 vector.  A letter trigram is *bound* by
multiplying its three letter vectors after permuting them by position (cyclic
shifts of 2, 1 and 0); a text is *bundled* by adding its trigram vectors.  A
language prototype is the bundle of all learning texts of that language and a
text goes to the prototype with the largest cosine.

Cases: a null text or a text without a letter is ``und`` with score 0; with
nothing to learn from, every text is ``und``.  Equal cosines go to the label
first in alphabetical order.  Rows are judged one by one, so repeated rows get
equal answers; an empty table gives an empty result.  Any number of further
columns passes through; one named like a result (``pred``, ``score``) is replaced
by it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.llm.common import col, fresh_name, map_arrow, slices

UNDETERMINED = "und"
DIMENSIONS = 512
SEED = 20_240_601
#: Cosine below which a text resembles none of the languages it could be.
MIN_SCORE = 0.08
#: Letters from which a low cosine counts as evidence: in shorter pieces of texts of
#: known languages it gets likelier with every letter less, from here on it does not.
MIN_LETTERS = 32
#: Letter classes; Latin letters have one each, the other scripts share the rest.
LETTERS = 255
#: Trigram vectors kept by a worker (int8); others are bound again when met.
CACHED_GRAMS = 100_000


@lru_cache(maxsize=1)
def letter_classes() -> np.ndarray:
    """Class of every code point: 0 for no letter, else that of its lower case."""
    out = np.zeros(0x110000, dtype=np.uint8)
    own: dict[int, int] = {}
    for cp in range(0x180):
        low = chr(cp).lower()
        if chr(cp).isalpha() and ord(low[0]) < 0x180:
            out[cp] = own.setdefault(ord(low[0]), len(own) + 1)
    first, spare = len(own) + 1, LETTERS - len(own)
    for cp in range(0x180, 0x110000):
        c = chr(cp)
        if c.isalpha():
            low = ord(c.lower()[0])
            out[cp] = own.get(low) or first + (low * 2_654_435_761 >> 7) % spare
    return out


class Binder:
    """Trigram ids of texts and the vectors they are bound to."""

    def __init__(self, dimensions: int, seed: int):
        rng = np.random.default_rng(seed)
        base = rng.integers(0, 2, (LETTERS + 1, dimensions), dtype=np.int8) * 2 - 1
        self.parts = [np.roll(base, shift, axis=1) for shift in (2, 1, 0)]
        self.classes = letter_classes()
        self.dense = np.zeros((LETTERS + 1) ** 3, dtype=np.int32)   # dense id + 1; pages come with use
        self.grams = np.empty(0, dtype=np.int64)          # dense id -> gram
        self.cache = np.empty((0, dimensions), dtype=np.int8)

    def ids(self, text: str) -> tuple[np.ndarray, bool]:
        """Dense trigram ids of a text in order; whether it has a letter.

        Runs of other characters count as one space; the text is padded, so a
        word of one letter still makes a trigram."""
        points = np.frombuffer(text.encode("utf-32-le", "replace"), dtype="<u4")
        x = self.classes[points]
        if not x.any():
            return np.empty(0, dtype=np.int64), False
        x = np.concatenate(([0], x, [0])).astype(np.int32)
        x = x[np.concatenate(([True], (x[1:] != 0) | (x[:-1] != 0)))]
        n = LETTERS + 1
        grams = (x[:-2] * n + x[1:-1]) * n + x[2:]
        grams = grams[x[1:-1] != 0]                       # a space only at an edge
        found = self.dense[grams]
        if found.min() == 0:
            new = np.unique(grams[found == 0])
            self.dense[new] = np.arange(len(self.grams), len(self.grams) + len(new)) + 1
            self.grams = np.concatenate((self.grams, new))
            room = max(0, CACHED_GRAMS - len(self.cache))
            if room:
                self.cache = np.concatenate((self.cache, self.bind(new[:room])))
            found = self.dense[grams]
        return found - 1, True

    def bind(self, grams: np.ndarray) -> np.ndarray:
        n = LETTERS + 1
        a, b, c = self.parts
        return a[grams // (n * n)] * b[grams // n % n] * c[grams % n]

    def bundle(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Sum of the vectors of ``ids``, each ``counts`` times."""
        out = np.zeros(self.parts[0].shape[1])
        for at in range(0, len(ids), 8192):
            i, n = ids[at:at + 8192], counts[at:at + 8192].astype(np.float32)
            kept = i < len(self.cache)
            vectors = self.cache[i[kept]].astype(np.float32)
            out += n[kept] @ vectors
            if not kept.all():
                out += n[~kept] @ self.bind(self.grams[i[~kept]]).astype(np.float32)
        return out


def prototypes(docs: DataFrame, text: str = "text", lang: str = "lang",
               dimensions: int = DIMENSIONS, seed: int = SEED) -> dict[str, np.ndarray]:
    """Unit prototype of every label in ``docs`` (rows with null text or label
    teach nothing).  Tasks bundle their rows per label; the task sums are added
    per label and dimension in Spark, so the driver gets labels x dimensions
    numbers."""
    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        binder, sums = Binder(dimensions, seed), {}
        for batch in batches:
            for t, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids, found = binder.ids(t)
                if found:
                    have = sums.get(label)
                    got = np.bincount(ids, minlength=0 if have is None else len(have))
                    if have is not None:
                        got[:len(have)] += have
                    sums[label] = got
        labels = sorted(sums)
        vectors = [binder.bundle(np.nonzero(sums[k])[0], sums[k][sums[k] > 0]) for k in labels]
        if labels:
            yield pa.RecordBatch.from_arrays(
                [pa.array(labels), pa.array([v.tolist() for v in vectors],
                                            pa.list_(pa.float64()))], ["label", "vector"])

    rows = docs.select(col(text).alias("text"), col(lang).cast("string").alias("label")).where(
        "text is not null and label is not null")
    parts = map_arrow(rows, learn, "label string, vector array<double>")
    sums = (parts.select("label", F.posexplode("vector").alias("d", "x"))
            .groupBy("label", "d").agg(F.sum("x").alias("x")).collect())
    out: dict[str, np.ndarray] = {}
    for r in sums:
        out.setdefault(r["label"], np.zeros(dimensions))[r["d"]] = r["x"]
    return {k: v / n for k, v in sorted(out.items()) if (n := np.linalg.norm(v)) > 0}


def identify(docs: DataFrame, protos: dict[str, np.ndarray], text: str = "text",
             pred: str = "lang_pred", score: str = "score",
             dimensions: int = DIMENSIONS, seed: int = SEED) -> DataFrame:
    """``docs`` plus the predicted label and its cosine (0 to 1).

    Only the text goes to Python; the rows keep all their columns."""
    labels = list(protos)
    matrix = np.array([protos[k] for k in labels]).reshape(len(labels), dimensions)
    names = [c for c in docs.columns if c.lower() not in (pred.lower(), score.lower())]
    out = fresh_name(docs, "judged")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        binder = Binder(dimensions, seed)
        for whole in batches:
            for batch in slices(whole, 512):
                preds, scores = [], []
                for t in batch.column(len(names)).to_pylist():
                    ids, found = binder.ids(t) if t and labels else (None, False)
                    if not found:
                        preds.append(UNDETERMINED)
                        scores.append(0.0)
                        continue
                    n = np.bincount(ids)
                    at = np.nonzero(n)[0]
                    v = binder.bundle(at, n[at])
                    norm = np.linalg.norm(v)
                    cosines = matrix @ v / norm if norm > 0 else np.zeros(len(labels))
                    best = int(np.argmax(cosines))
                    preds.append(labels[best])
                    scores.append(float(min(1.0, max(0.0, cosines[best]))))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:len(names)], pa.array(preds, pa.string()),
                     pa.array(scores, pa.float64())], [f"c{i}" for i in range(len(names) + 2)])

    types = [docs.schema[c].dataType for c in names] + [T.StringType(), T.DoubleType()]
    schema = T.StructType([T.StructField(f"c{i}", t) for i, t in enumerate(types)])
    given = docs.select(*[col(c).alias(f"c{i}") for i, c in enumerate(names)],
                        col(text).alias(out))
    return map_arrow(given, judge, schema).toDF(*names, pred, score)


def accepted(text: str = "text", pred: str = "lang_pred", score: str = "score") -> Column:
    """Whether a language was found: a letter, and no evidence against it, that
    is, some resemblance or too few letters to tell."""
    letters = F.length(F.regexp_replace(col(text), r"\P{L}+", ""))
    return (F.col(pred) != UNDETERMINED) & ((F.col(score) >= MIN_SCORE) | (letters < MIN_LETTERS))
