"""Language identification with a string kernel.

The kernel is the blended spectrum in its presence form: the number of character n-grams (n = 1..3, over the
lower-cased text with runs of other characters as one space) that two texts share, divided by the root of the
product of their numbers of n-grams, so that k(x, x) = 1.  All n-grams of a text count (told apart by hashes of 32
bits).  Nystrom features come from m landmark texts, phi(x) = k(x, Z) k(Z, Z)^(-1/2), and one ridge regression per
language against the rest is solved on them; at scoring a batch of texts is one presence matrix over the landmarks'
n-grams, multiplied by theirs and then by the weights.

The classifier is fitted on a bounded sample: of each language the ``per_language`` labelled rows with the smallest
hash of their doc_id; ``landmarks`` of these, or ``LEAST_EACH`` of each language if that is more, serve as landmarks,
the languages taking turns.  Every row is scored on its whole text.

Defined results: null text or text without a letter is ``und`` with score 0; rows of null doc_id or lang teach
nothing; with no row to learn from, all are ``und``; an empty table gives no rows; of languages that tie the first by
name is given; rows that repeat are scored one by one; other columns are ignored; very long texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import prepare, written

SIZES = (1, 2, 3)
PER_LANGUAGE = 200
LANDMARKS, LEAST_EACH = 96, 4
RIDGE = 1e-3
_FACTORS = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))


def _codes(text: str) -> np.ndarray:
    """Code points of the lower-cased text, with all that are no letters as 32."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    low = codes < 0x250
    out = np.where(low, _LATIN[np.minimum(codes, 0x24F)], codes)
    if not low.all():
        kinds, back = np.unique(codes[~low], return_inverse=True)
        out[~low] = np.array([c if chr(c).isalpha() else 32 for c in kinds.tolist()], dtype=np.uint32)[back]
    out = out[(out != 32) | np.append(True, out[:-1] != 32)] if len(out) else out
    return out


_LATIN = np.array([c if chr(c).isalpha() else 32 for c in range(0x250)], dtype=np.uint32)


def has_letter(codes: np.ndarray) -> bool:
    return bool((codes != 32).any())


def grams_of(codes: np.ndarray) -> np.ndarray:
    """Sorted different hashes of all n-grams of a text."""
    out = []
    for n in SIZES:
        if len(codes) >= n:
            h = np.zeros(len(codes) - n + 1, dtype=np.uint32)
            for i in range(n):
                h = (h ^ codes[i : len(codes) - n + 1 + i]) * _FACTORS[i] + np.uint32(n)
                h ^= h >> np.uint32(15)
            out.append(h)
    found = np.concatenate(out) if out else np.zeros(0, dtype=np.uint32)
    found.sort()
    return found[np.append(True, found[1:] != found[:-1])] if len(found) else found


class SpectrumClassifier:
    """Nystrom kernel ridge regression, one against the rest, over presence spectra."""

    def __init__(self, languages: list[str], landmarks: list[np.ndarray], weights: np.ndarray):
        self.languages, self.landmarks, self.weights = languages, landmarks, weights
        self._matrix: tuple[np.ndarray, np.ndarray] | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_matrix": None}  # workers build it themselves

    def matrix(self) -> tuple[np.ndarray, np.ndarray]:
        """All n-grams of the landmarks, sorted, and which landmark has which (n-grams x landmarks), over the roots of their numbers."""
        if self._matrix is None:
            grams = np.unique(np.concatenate(self.landmarks))
            there = np.zeros((len(grams), len(self.landmarks)), dtype=np.float32)
            for i, z in enumerate(self.landmarks):
                there[np.searchsorted(grams, z), i] = 1 / np.sqrt(len(z))
            self._matrix = grams, there
        return self._matrix

    def kernel(self, texts: list[np.ndarray], block: int = 64) -> np.ndarray:
        """k(x, Z) of texts given by their n-grams: a matrix product for each block."""
        grams, there = self.matrix()
        out = np.zeros((len(texts), len(self.landmarks)), dtype=np.float32)
        for a in range(0, len(texts), block):
            part = texts[a : a + block]
            owner, all_grams = np.repeat(np.arange(len(part)), [len(g) for g in part]), np.concatenate(part)
            at = np.minimum(np.searchsorted(grams, all_grams), len(grams) - 1)
            known = grams[at] == all_grams
            used, column = np.unique(at[known], return_inverse=True)
            presence = np.zeros((len(part), len(used)), dtype=np.float32)
            presence[owner[known], column] = 1
            size = np.sqrt(np.maximum([len(g) for g in part], 1)).astype(np.float32)
            out[a : a + block] = presence @ there[used] / size[:, None]
        return out

    @classmethod
    def fit(cls, texts: list[str], langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> SpectrumClassifier | None:
        kept = [(c, y) for c, y in ((_codes(t), y) for t, y in zip(texts, langs, strict=True)) if has_letter(c)]
        if not kept:
            return None
        grams = [grams_of(c) for c, _ in kept]
        y = [y for _, y in kept]
        languages = sorted(set(y))
        turn: dict[str, int] = {}
        order = []
        for i, lang in enumerate(y):  # round robin over languages
            turn[lang] = turn.get(lang, 0) + 1
            order.append((turn[lang], i))
        model = cls(languages, [grams[i] for _, i in sorted(order)[: max(landmarks, LEAST_EACH * len(languages))]], np.zeros(0))
        kzz = model.kernel(model.landmarks).astype(np.float64)
        values, vectors = np.linalg.eigh((kzz + kzz.T) / 2)
        good = values > 1e-6 * values.max()
        root = vectors[:, good] / np.sqrt(values[good])
        phi = np.hstack([model.kernel(grams) @ root, np.ones((len(grams), 1))])
        goal = np.where(np.array(y)[:, None] == np.array(languages)[None, :], 1.0, -1.0)
        solved = np.linalg.solve(phi.T @ phi + ridge * len(phi) * np.eye(phi.shape[1]), phi.T @ goal)
        model.weights = np.vstack([root @ solved[:-1], solved[-1:]]).astype(np.float32)
        return model

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        codes = [_codes(t or "") for t in texts]
        known = [has_letter(c) for c in codes]
        value = self.kernel([grams_of(c) for c in codes]) @ self.weights[:-1] + self.weights[-1]
        level = np.clip((value.max(1) + 1) / 2, 0, 1) if len(texts) else []
        names = [self.languages[b] if k else "und" for b, k in zip(value.argmax(1).tolist(), known, strict=True)]
        return names, [float(s) if k else 0.0 for s, k in zip(level, known, strict=True)]


def learning_sample(docs: DataFrame, learn: Column, per_language: int = PER_LANGUAGE) -> tuple[list[str], list[str]]:
    """Texts and languages: of each language the rows with the smallest hash, ``per_language`` at most."""
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "text")
    rows = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    # about four times as many of each language by another hash, so that tasks pass on few texts, however many tasks there are
    share = rows.groupBy("lang").agg((F.lit(4.0 * per_language * (1 << 30)) / F.count("*")).alias("share"))
    share, _ = written(share, "shares")  # a few rows, known to be few when the join is planned
    rows = rows.join(share, "lang").where(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 30)) < F.col("share")).drop("share")
    rows = rows.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= per_language).collect()
    rows = sorted(rows, key=lambda r: (r["lang"], r["rank"]))
    return [r["text"] for r in rows], [r["lang"] for r in rows]


def identify(docs: DataFrame, learn: Column, per_language: int = PER_LANGUAGE) -> DataFrame:
    """``doc_id, lang_pred, score`` of each row; ``learn`` tells which rows may teach."""
    spark = docs.sparkSession
    prepare(spark)
    model = SpectrumClassifier.fit(*learning_sample(docs, learn, per_language))
    sent = spark.sparkContext.broadcast(model)  # bounded by the landmarks' n-grams

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = sent.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            names, scores = fitted.predict(texts) if fitted else (["und"] * len(texts), [0.0] * len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(score, "doc_id long, lang_pred string, score double")
