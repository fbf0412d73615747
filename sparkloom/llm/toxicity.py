"""Toxicity by classifier chains.

Categories are predicted one after the other by linear (logistic) models over word features; each model also sees
the probabilities of the categories before it.  In training those earlier probabilities are out-of-fold: the model
of a category is fitted ``folds`` times without a fold, and each row gets the probability of the model that did not
see it.  The table has one label, so the categories are learned too: rows labelled toxic are clustered by their words
(spherical k-means, the largest cluster first), a row is of a category if it is toxic and in its cluster, and the last
link of the chain is the label ``toxic`` itself.

The models are fitted on a bounded sample of labelled rows (``most_rows``, the smallest hashes of doc_id, toxic
rows first up to half).  Features are words (letter runs, lower case) and beginnings of words (``PREFIXES`` letters,
for inflected forms) that occur in at least ``least`` sample rows and whose rows are toxic more often than chance lets
any of all candidates be (Chernoff bound), ``vocabulary`` at most: words of clean texts are no features, so that no
length of clean text hides toxic words.  A feature's value is the logarithm of one plus the number of different words
that have it.  Every row is scored on its whole text.

Defined results: null text counts as empty and is not toxic; very long texts are read whole; of labels that tie in the
hash the smaller doc_id is fitted first; an empty table gives no rows; with no labelled row, or with labels of one class
only, nothing is toxic and all probabilities are 0; labels of null doc_id or toxic teach nothing; if a doc_id has
several labels the largest counts; rows that repeat a doc_id are scored one by one; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import prepare, thinned

#: Categories of toxic rows; fewer are used if there are fewer toxic rows.
KINDS = 4
CHAIN = (*(f"kind_{i + 1}" for i in range(KINDS)), "toxic")
MOST_ROWS = 1800
VOCABULARY = 3000
LEAST = 4
FOLDS = 4
PREFIXES = (4, 5, 6)
#: No document is called toxic below this probability.
LEAST_PROBABILITY = 0.2
#: Words whose features a worker remembers.
MOST_KNOWN = 100_000
_WORD = re.compile(r"[^\W\d_]+")


def words_in(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


def features_of(word: str) -> list[str]:
    return [word, *(word[:n] + "*" for n in PREFIXES if len(word) > n)]



def _logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0, steps: int = 8) -> np.ndarray:
    """Weights (bias last) of L2-regularised logistic regression: Newton steps in the smaller of row and feature space.

    Rows of either class count alike in sum, so that rare categories are not swamped.
    """
    n, d = x.shape
    positive = max(1, int(y.sum()))
    weight = np.where(y > 0, n / (2 * positive), n / (2 * max(1, n - positive)))
    solve = np.linalg.solve
    if d < n:
        xb, w = np.hstack([x, np.ones((n, 1))]), np.zeros(d + 1)
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(xb @ w, -30, 30)))
            h = np.maximum(weight * p * (1 - p), 1e-6)
            step = solve((xb.T * h) @ xb + l2 * np.eye(d + 1), xb.T @ (weight * (y - p)) - l2 * w)
            w = w + step
            if np.abs(step).max() < 1e-3:
                break
        return w
    gram, alpha = x @ x.T + 1, np.zeros(n)  # with the bias
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(gram @ alpha, -30, 30)))
        h = np.maximum(weight * p * (1 - p), 1e-6)
        new = solve(gram + l2 * np.diag(1 / h), gram @ alpha + weight * (y - p) / h)
        done = np.abs(new - alpha).max() < 1e-3
        alpha = new
        if done:
            break
    return np.append(x.T @ alpha, alpha.sum())


def clusters(x: np.ndarray, k: int, steps: int = 12) -> np.ndarray:
    """The cluster of each row, 0 for the largest: spherical k-means from rows that are far from each other."""
    unit = x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)
    centres = unit.mean(0, keepdims=True)
    closest = unit @ centres[0]
    picked = []
    for _ in range(min(k, len(x))):
        at = int(closest.argmin()) if picked else int(closest.argmax())
        if picked and closest[at] > 1 - 1e-9:
            break  # no row is left that differs from those picked
        picked.append(at)
        closest = np.maximum(closest, unit @ unit[at]) if len(picked) > 1 else unit @ unit[at]
    centres = unit[picked]
    for _ in range(steps):
        own = (unit @ centres.T).argmax(1)
        sums = np.stack([unit[own == i].sum(0) for i in range(len(picked))])
        norms = np.sqrt((sums * sums).sum(1, keepdims=True))
        centres = np.where(norms > 0, sums / np.maximum(norms, 1e-12), centres)
    own = (unit @ centres.T).argmax(1)
    sizes = np.bincount(own, minlength=len(picked))
    return np.argsort(np.argsort(-sizes, kind="stable"), kind="stable")[own]


def _surprise(hits: int, seen: int, base: float) -> float:
    """Minus the logarithm of (a bound on) the chance of so many toxic rows, 0 if they are no more than expected."""
    h = hits / seen
    if h <= base:
        return 0.0
    return seen * (h * np.log(h / base) + ((1 - h) * np.log((1 - h) / (1 - base)) if h < 1 else 0.0))


def _prob(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


class ToxicityChain:
    def __init__(self, vocabulary: dict[str, int], links: list[tuple[str, np.ndarray]], threshold: float):
        self.vocabulary, self.links, self.threshold = vocabulary, links, threshold
        self.known: dict[str, tuple[int, ...]] = {}  # features of words met

    @classmethod
    def fit(cls, texts: list[str], toxic: list[int], vocabulary: int = VOCABULARY, least: int = LEAST, folds: int = FOLDS) -> ToxicityChain | None:
        y = np.array(toxic, dtype=float)
        if not len(y) or y.min() == y.max():
            return None
        sets = [words_in(t) for t in texts]
        seen, hits = Counter(), Counter()
        for s, t in zip(sets, toxic, strict=True):  # a row's features are counted again below rather than held
            found = {f for w in s for f in features_of(w)}
            seen.update(found)
            if t:
                hits.update(found)
        base = y.mean()
        strength = {w: _surprise(hits[w], seen[w], base) for w in hits if seen[w] >= least}
        ranked = sorted((w for w, z in strength.items() if z >= np.log(len(seen))), key=lambda w: (-strength[w], w))
        words = {w: i for i, w in enumerate(ranked[:vocabulary])}
        d = len(words)
        x = np.zeros((len(sets), d + len(CHAIN)))
        del seen, hits, ranked, strength
        for row, s in zip(x, sets, strict=True):
            for f, n in Counter(f for w in s for f in features_of(w) if f in words).items():
                row[words[f]] = np.log2(1 + n)
        kind = np.full(len(y), -1)
        kind[y > 0] = clusters(x[y > 0, :d], KINDS)
        labels = {name: (kind == i).astype(float) for i, name in enumerate(CHAIN[:-1])} | {"toxic": y}
        fold = np.arange(len(y)) % folds
        links = []
        for at, name in enumerate(CHAIN):
            goal, own = labels[name], x[:, : d + at]
            out_of_fold = x[:, d + at]  # what later models see
            if goal.sum() < folds:
                links.append((name, np.append(np.zeros(d + at), -30.0)))
                continue
            for k in range(folds):
                out_of_fold[fold == k] = _prob(own[fold == k], _logistic(own[fold != k], goal[fold != k]))
            links.append((name, _logistic(own, goal)))
        threshold = best_threshold(out_of_fold, y)
        return cls(words, links, threshold)

    def predict(self, texts: list[str | None], block: int = 512) -> np.ndarray:
        """Probabilities, a row for each text and a column for each link."""
        out = np.zeros((len(texts), len(self.links)))
        d, known, vocabulary = len(self.vocabulary), self.known, self.vocabulary
        for a in range(0, len(texts), block):
            part = texts[a : a + block]
            x = np.zeros((len(part), d + len(self.links)))
            for row, text in zip(x, part, strict=True):
                found: list[int] = []
                for w in words_in(text):
                    at = known.get(w)
                    if at is None:
                        if len(known) >= MOST_KNOWN:
                            known.clear()
                        at = known[w] = tuple(vocabulary[f] for f in features_of(w) if f in vocabulary)
                    if at:
                        found += at
                if found:
                    at, n = np.unique(found, return_counts=True)
                    row[at] = np.log2(1 + n)
            for k, (_, w) in enumerate(self.links):
                x[:, d + k] = out[a : a + block, k] = _prob(x[:, : d + k], w)
        return out


def best_threshold(prob: np.ndarray, y: np.ndarray) -> float:
    """Of out-of-fold probabilities, a point high in the range that errs least (a clean row lost counts double)."""
    grid = np.linspace(0.05, 0.95, 91)
    cost = np.array([2 * ((prob >= t) & (y == 0)).sum() + ((prob < t) & (y == 1)).sum() for t in grid])
    good = grid[cost == cost.min()]
    return max(LEAST_PROBABILITY, float(0.25 * good.min() + 0.75 * good.max()))


def labelled_sample(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> tuple[list[str], list[int]]:
    marks = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = dict(marks.groupBy("toxic").count().collect())
    first = lambda n, y: thinned(marks.where(F.col("toxic") == y), "doc_id", n, rows.get(y, 0)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    chosen = first(most_rows // 2, 1).unionByName(first(most_rows // 2, 0))
    rows = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id")  # most_rows rows at most
    # one row of each doc_id
    one = Window.partitionBy("doc_id").orderBy("text")
    rows = rows.withColumn("n", F.row_number().over(one)).where("n = 1").orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    return [r["text"] for r in rows], [int(r["toxic"]) for r in rows]


def score_toxicity(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> DataFrame:
    """``doc_id, toxic, p_<category>...`` of each row of ``docs``."""
    spark = docs.sparkSession
    prepare(spark)
    sent = spark.sparkContext.broadcast(ToxicityChain.fit(*labelled_sample(docs, labels, most_rows)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            p = model.predict(batch.column(1).to_pylist()) if model else np.zeros((batch.num_rows, len(CHAIN)))
            bad = p[:, -1] >= model.threshold if model else np.zeros(batch.num_rows, dtype=bool)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bad), *(pa.array(np.ascontiguousarray(c)) for c in p.T)], names=["doc_id", "toxic", *(f"p_{c}" for c in CHAIN)])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(score, "doc_id long, toxic boolean, " + ", ".join(f"p_{c} double" for c in CHAIN))


def clean_documents(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> DataFrame:
    """The rows of ``docs``, all columns, that are not toxic.  The text is scored in place: no shuffle."""
    spark = docs.sparkSession
    prepare(spark)
    sent = spark.sparkContext.broadcast(ToxicityChain.fit(*labelled_sample(docs, labels, most_rows)))
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            if model:
                batch = batch.filter(pa.array(model.predict(batch.column(at).to_pylist())[:, -1] < model.threshold))
            yield batch

    return docs.mapInArrow(keep, docs.schema)
