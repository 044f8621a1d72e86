"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

A lexicon is learned first: words and word prefixes whose share of toxic documents is far above that of others. The
features of a whole text are its lexicon densities (plain, and for words that match only with their disguise taken
off), how near lexicon words stand to second-person words, and rates of capitals, punctuation and
disguised or stretched words. Boosted trees on their histograms give margins, and an isotonic regression on rows
that the trees have not seen turns margins into chances. The score is that chance plus 1e-4 times the hyperbolic tangent of a quarter of
the margin, so that rows within a step of the calibration are ranked, and is kept within 0 and 1.

For the rows that the trees learn from, lexicon weights are counted without the row's own fold, so that a row does not
vouch for its own words.

The model is fit on at most ``sample_rows`` labelled rows, those with the least hash of their doc_id, and the lexicon has at most
``lexicon_terms`` terms. Rows whose label is null are not used, and of several labels of a doc_id the least is taken.
With labels of one class only, or none, every score is that class' smoothed share.

Null and empty texts have features of zero words and are scored like others. Repeated rows are scored each; a null
doc_id counts as held in. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.llm.common import arrow_filter, arrow_map, written
from skarn.llm.encoding import batches
from skarn.llm.quality import fold, labelled_sample
from skarn.llm.textstats import AT, COLUMNS, EDGES, WordTable, sums, word_terms

FOLDS = 4
NEAR = 4  # words between a lexicon word and a second-person word
FEATURES = 17


def features(texts: list[str | None], words: WordTable) -> np.ndarray:
    """Features of whole texts, for each column of lexicon weights: (weights, texts, FEATURES)."""
    at, counts = words.numbers(texts)
    rows = words.rows[at]
    base = len(COLUMNS)
    total = sums(rows[:, :base], counts)
    n = np.maximum(counts, 1).astype(float)
    letters, chars = np.maximum(total[:, AT["letters"]], 1), np.maximum(total[:, AT["chars"]], 1)
    begins = np.cumsum(counts) - counts
    second = np.concatenate([[0], np.cumsum(rows[:, AT["second_person"]] > 0)])
    first, end = np.repeat(begins, counts), np.repeat(begins + counts, counts)
    place = np.arange(len(at))
    near_you = second[np.minimum(place + NEAR + 1, end)] > second[np.maximum(place - NEAR, first)]
    out = np.zeros((words.weights, len(texts), FEATURES))
    out[:, :, 0] = np.log1p(counts)
    out[:, :, 1] = total[:, AT["second_person"]] / n
    out[:, :, 2] = total[:, AT["upper"]] / letters
    out[:, :, 3] = total[:, AT["all_caps"]] / n
    out[:, :, 4] = total[:, AT["exclaim"]] / n
    out[:, :, 5] = total[:, AT["question"]] / n
    out[:, :, 6] = total[:, AT["marks"]] / chars
    out[:, :, 7] = total[:, AT["mixed"]] / n
    out[:, :, 8] = total[:, AT["stretched"]] / n
    out[:, :, 9] = total[:, AT["chars"]] / n
    for k in range(words.weights):
        plain, hidden = rows[:, base + k], rows[:, base + words.weights + k]
        weight = np.maximum(plain, hidden)
        some = np.flatnonzero(weight)
        owner = np.searchsorted(begins + counts, some, side="right")
        hits = np.bincount(owner, minlength=len(texts))
        out[k, :, 10] = hits / n
        out[k, :, 11] = np.log1p(hits)
        out[k, :, 12] = np.bincount(owner, weights=weight[some], minlength=len(texts)) / n
        np.maximum.at(out[k, :, 13], owner, weight[some])
        out[k, :, 14] = np.bincount(owner, weights=hidden[some] > 0, minlength=len(texts)) / n
        out[k, :, 15] = np.bincount(owner, weights=near_you[some], minlength=len(texts)) / np.maximum(hits, 1)
        distinct = np.unique(np.stack([owner, at[some]]), axis=1)[0] if len(some) else owner
        out[k, :, 16] = np.log1p(np.bincount(distinct, minlength=len(texts)))
    return out


class Trees:
    """Boosted complete trees for the logistic loss, grown on histograms of binned features."""

    def __init__(self, rounds: int = 80, depth: int = 3, rate: float = 0.15, l2: float = 1.0, bins: int = 64):
        self.rounds, self.depth, self.rate, self.l2, self.bins = rounds, depth, rate, l2, bins

    def fit(self, rows: np.ndarray, labels: np.ndarray) -> Trees:
        n, p = rows.shape
        cuts = [np.unique(np.quantile(rows[:, k], np.linspace(0, 1, self.bins + 1)[1:-1])) for k in range(p)]
        binned = np.stack([np.searchsorted(cuts[k], rows[:, k], side="left") for k in range(p)])
        self.base = float(np.log((labels.sum() + 0.5) / (n - labels.sum() + 0.5)))
        margin = np.full(n, self.base)
        inner = (1 << self.depth) - 1
        self.feature = np.zeros((self.rounds, inner), np.int64)
        self.cut = np.full((self.rounds, inner), np.inf)
        self.leaf = np.zeros((self.rounds, inner + 1))
        for t in range(self.rounds):
            chance = 1 / (1 + np.exp(-margin))
            slope, bend = chance - labels, np.maximum(chance * (1 - chance), 1e-6)
            node = np.zeros(n, np.int64)
            for level in range(self.depth):
                first, width = (1 << level) - 1, 1 << level
                best = np.full(width, 1e-6)
                for k in range(p):
                    place = (node - first) * self.bins + binned[k]
                    g = np.bincount(place, slope, width * self.bins).reshape(width, -1).cumsum(1)
                    h = np.bincount(place, bend, width * self.bins).reshape(width, -1).cumsum(1)
                    all_g, all_h = g[:, -1:], h[:, -1:]
                    gain = (
                        g**2 / (h + self.l2) + (all_g - g) ** 2 / (all_h - h + self.l2) - all_g**2 / (all_h + self.l2)
                    )[:, : len(cuts[k])]
                    if gain.shape[1]:
                        at = gain.argmax(1)
                        for j in np.flatnonzero(gain[np.arange(width), at] > best):
                            best[j] = gain[j, at[j]]
                            self.feature[t, first + j], self.cut[t, first + j] = k, cuts[k][at[j]]
                node = 2 * node + 1 + (rows[np.arange(n), self.feature[t, node]] > self.cut[t, node])
            leaf = node - inner
            g, h = np.bincount(leaf, slope, inner + 1), np.bincount(leaf, bend, inner + 1)
            self.leaf[t] = -self.rate * g / (h + self.l2)
            margin += self.leaf[t, leaf]
        return self

    def margin(self, rows: np.ndarray) -> np.ndarray:
        total, every = np.full(len(rows), self.base), np.arange(len(rows))
        for t in range(self.rounds):
            node = np.zeros(len(rows), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (rows[every, self.feature[t, node]] > self.cut[t, node])
            total += self.leaf[t, node - self.feature.shape[1]]
        return total


def isotonic(margins: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the best non-decreasing fit (pool adjacent violators), joined by lines."""
    order = np.argsort(margins, kind="stable")
    pools: list[list[float]] = []  # sum of labels, rows, sum of margins
    for x, y in zip(margins[order], labels[order], strict=True):
        pools.append([float(y), 1.0, float(x)])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    y, n, x = np.array(pools).T
    return x / n, (y + 0.02) / (n + 0.04)


class Toxicity:
    """Lexicon, trees and calibration."""

    def __init__(self, lexicon: dict[str, tuple[float, ...]], share: float):
        self.lexicon, self.share, self.trees = lexicon, share, None

    def fit(self, rows: np.ndarray, labels: np.ndarray, held: np.ndarray) -> Toxicity:
        self.trees = Trees().fit(rows[~held], labels[~held])
        margins = self.trees.margin(rows[held])
        self.knots, self.chances = isotonic(margins, labels[held])
        self.chances = np.maximum.accumulate(self.chances)
        return self

    def score(self, rows: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(rows), self.share)
        margins = self.trees.margin(rows)
        score = np.interp(margins, self.knots, self.chances)
        # margins rank rows within a step of the calibration, ever so slightly
        return np.clip(score + 1e-4 * (np.tanh(margins / 4) - np.tanh(0)), 0.0, 1.0)


def with_copy_key(sample: DataFrame) -> DataFrame:
    """Adds the least hash of the text's word triples, which near copies mostly share."""

    def make():
        from xxhash import xxh3_64_intdigest

        def key(text: str | None) -> int:
            words = (text or "").encode().split()
            triples = range(max(1, len(words) - 2))
            return min(xxh3_64_intdigest(b" ".join(words[k : k + 3])) for k in triples) >> 1

        def step(batch: pa.RecordBatch):
            keys = [key(t) for t in batch.column(1).to_pylist()]
            yield pa.record_batch([*batch.columns, pa.array(keys, pa.int64())], names=["doc_id", "text", "label", "copy_key"])

        return step

    return arrow_map(
        sample.select("doc_id", "text", "label"), make, "doc_id long, text string, label int, copy_key long"
    )


def term_counts(sample: DataFrame) -> DataFrame:
    """Documents of each label and fold that hold each term; a batch sends one row a term."""

    def make():
        def step(batch: pa.RecordBatch):
            texts, labels, folds = (batch.column(k).to_pylist() for k in (1, 2, 3))
            for lo, hi in batches(texts):
                counts: Counter = Counter()
                for text, label, part in zip(texts[lo:hi], labels[lo:hi], folds[lo:hi], strict=True):
                    bare = {w.strip(EDGES).lower() for w in set((text or "").split())}
                    counts.update((t, label, part) for t in {t for w in bare if w for t in word_terms(w)})
                term, label, part = zip(*counts, strict=True) if counts else ((), (), ())
                yield pa.record_batch(
                    [pa.array(term, pa.string()), pa.array(label, pa.int32()), pa.array(part, pa.int32()), pa.array(list(counts.values()), pa.int64())],
                    names=["term", "label", "fold", "n"],
                )

        return step

    return (
        arrow_map(sample.select("doc_id", "text", "label", "fold"), make, "term string, label int, fold int, n long")
        .groupBy("term").agg(
            *[
                F.sum(F.when((F.col("label") == y) & (F.col("fold") == f), F.col("n")).otherwise(0)).alias(f"n{y}{f}")
                for y in (0, 1) for f in range(FOLDS)
            ]
        )
    )


def learn_lexicon(sample: DataFrame, sizes: np.ndarray, lexicon_terms: int) -> dict[str, tuple[float, ...]]:
    """Weights of the terms that tell toxic documents: without each fold, then of all."""
    toxic = sum(F.col(f"n1{f}") for f in range(FOLDS))
    other = sum(F.col(f"n0{f}") for f in range(FOLDS))
    odds = F.log((toxic + 0.5) / (float(sizes[1].sum()) + 1)) - F.log((other + 0.5) / (float(sizes[0].sum()) + 1))
    least = max(4, int(0.01 * sizes[1].sum()))
    rows = (
        term_counts(sample).where((toxic >= least) & (odds > 2.0))
        .orderBy((odds * F.sqrt(toxic)).desc(), "term").limit(lexicon_terms).collect()  # so many rows at most
    )
    lexicon = {}
    for r in rows:
        n = np.array([[r[f"n{y}{f}"] for f in range(FOLDS)] for y in (0, 1)], float)
        weights = []
        for f in range(FOLDS + 1):
            keep = np.arange(FOLDS) != f
            (a, b), (all_a, all_b) = n[:, keep].sum(1), sizes[:, keep].sum(1)
            weight = np.log((b + 0.5) / (all_b + 1)) - np.log((a + 0.5) / (all_a + 1))
            weights.append(float(weight) if weight > 2.0 and b >= 0.7 * least else 0.0)
        lexicon[r["term"]] = tuple(weights)
    return lexicon


def fit(sample: DataFrame, lexicon_terms: int = 2000) -> Toxicity:
    """``sample``: doc_id, text, label. Of near copies with the same label one teaches."""
    sample = written(
        with_copy_key(sample).groupBy("copy_key", "label")
        .agg(F.min_by("text", "doc_id").alias("text"), F.min("doc_id").alias("doc_id"))
        .select(
            "doc_id", "text", "label", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(FOLDS)).cast("int").alias("fold")
        ),
        "sample",
    )
    sizes = np.zeros((2, FOLDS))
    for r in sample.groupBy("label", "fold").count().collect():  # eight rows at most
        sizes[int(r["label"] > 0), r["fold"]] += r["count"]
    share = float((sizes[1].sum() + 0.5) / (sizes.sum() + 2))  # without labels a document counts as clean
    if min(sizes.sum(1)) < 4:
        return Toxicity({}, share)
    lexicon = learn_lexicon(sample, sizes, lexicon_terms)

    def make():
        words = WordTable(lexicon, FOLDS + 1)

        def step(batch: pa.RecordBatch):
            texts = batch.column(1).to_pylist()
            for lo, hi in batches(texts):
                part = batch.column(3).slice(lo, hi - lo).to_numpy()
                rows = features(texts[lo:hi], words)[part, np.arange(hi - lo)]
                yield pa.record_batch(
                    [*(batch.column(k).slice(lo, hi - lo) for k in (0, 2)), pa.array(rows.tolist(), pa.list_(pa.float64()))],
                    names=["doc_id", "label", "row"],
                )

        return step

    # one row of features for each of the sample's rows
    found = arrow_map(
        sample.select("doc_id", "text", "label", "fold"), make, "doc_id long, label int, row array<double>"
    ).toPandas().sort_values("doc_id", kind="stable")
    rows, labels = np.stack(found["row"].to_numpy()), (found["label"].to_numpy() > 0).astype(float)
    held = np.zeros(len(rows), bool)
    for y in (0, 1):  # every fourth row of each class calibrates
        held[np.flatnonzero(labels == y)[::4]] = True
    final = {t: w[-1:] for t, w in lexicon.items() if w[-1]}
    return Toxicity(final, share).fit(rows, labels, held)


def toxicity_scores(
    docs: DataFrame, model: Toxicity, threshold: float = 0.5, keep: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """The ``keep`` columns, score and predicted (1 if the score is ``threshold`` or more)."""
    kinds = dict(docs.dtypes)

    def make():
        words = WordTable(model.lexicon, 1)

        def step(batch: pa.RecordBatch):
            texts = batch.column(0).to_pylist()
            for lo, hi in batches(texts):
                score = model.score(features(texts[lo:hi], words)[0])
                yield pa.record_batch(
                    [
                        *(batch.column(k + 1).slice(lo, hi - lo) for k in range(len(keep))),
                        pa.array(score), pa.array((score >= threshold).astype(np.int32)),
                    ],
                    names=[*keep, "score", "predicted"],
                )

        return step

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", score double, predicted int"
    return arrow_map(docs.select(F.col("text").alias("_text"), *keep), make, schema)


def accepted(docs: DataFrame, model: Toxicity, threshold: float = 0.5) -> DataFrame:
    """The documents, with all their columns, that score below ``threshold``."""

    def make():
        words = WordTable(model.lexicon, 1)

        def accept(texts: list[str | None]) -> np.ndarray:
            parts = [model.score(features(texts[lo:hi], words)[0]) < threshold for lo, hi in batches(texts)]
            return np.concatenate(parts) if parts else np.empty(0, bool)

        return accept

    return arrow_filter(docs, "text", make)


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000) -> Toxicity:
    """The model on rows whose fold modulo 5 is not 0."""
    use = fold(F.col("doc_id"), 5) != 0
    return fit(labelled_sample(docs, labels, "toxic", use, sample_rows))


def classify(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000) -> DataFrame:
    """doc_id, held_out, score, predicted for each document."""
    model = train(docs, labels, sample_rows)
    held_out = F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False))
    return toxicity_scores(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")
