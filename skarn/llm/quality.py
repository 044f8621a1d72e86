"""Quality classifier: a regularised quadratic discriminant over document statistics.

Statistics of the whole text (length, repetition, capitals, marks, line and word shapes) are
transformed so that they are closer to normal, and standardised; deviations of short texts are shrunk. Each class has its mean and a covariance that is shrunk
towards a multiple of the identity (Ledoit-Wolf intensity). The score is the logistic function of the
difference of log densities, from Mahalanobis distances by Cholesky factors that are computed once, plus
the log odds of the classes.

The model is fit on at most ``sample_rows`` labelled rows, those with the least hash of their doc_id; the statistics of
these few rows reach the driver, texts do not. Rows whose label is null are not used, and of several labels
of a doc_id the least is taken, and of several texts that of least hash. With labels of one class only, or none, every score is that class' smoothed share.

Null and empty texts have statistics of zero words and are scored like others. Repeated rows are scored
each; a null doc_id counts as held in. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skarn.llm.common import arrow_filter, arrow_map
from skarn.llm.encoding import batches
from skarn.llm.textstats import AT, WordTable, sums

STATISTICS = (
    "words", "word_length", "word_spread", "upper", "all_caps", "capital", "marks", "digits", "exclaim",
    "only_marks", "mixed", "ends", "short", "distinct", "top_word", "same_next", "line_length", "same_lines", "same_pairs",
)

SHORT = 25  # words at which deviations count half


def statistics(texts: list[str | None], words: WordTable) -> np.ndarray:
    """One row of transformed statistics for each whole text."""
    at, counts = words.numbers(texts)
    rows = words.rows[at]
    total = sums(rows, counts)
    square = sums(rows[:, :1] ** 2, counts)[:, 0]
    n = np.maximum(counts, 1).astype(float)
    chars, letters = np.maximum(total[:, AT["chars"]], 1), np.maximum(total[:, AT["letters"]], 1)
    mean = total[:, AT["chars"]] / n
    out = np.zeros((len(texts), len(STATISTICS)))
    shares = [
        (3, "upper", letters), (4, "all_caps", n), (5, "capital", n), (6, "marks", chars), (7, "digits", chars),
        (8, "exclaim", n), (9, "only_marks", n), (10, "mixed", n), (11, "ends", n), (12, "short", n),
    ]
    out[:, 0] = np.log1p(counts)
    out[:, 1] = np.log(mean + 1)
    out[:, 2] = np.log(np.sqrt(np.maximum(square / n - mean**2, 0)) + 1)
    for k, name, whole in shares:
        out[:, k] = np.sqrt(total[:, AT[name]] / whole)
    begins = np.cumsum(counts) - counts
    for k, text in enumerate(texts):
        own = at[begins[k] : begins[k] + counts[k]]
        if len(own):
            times = np.unique(own, return_counts=True)[1]
            out[k, 13] = len(times) / len(own) ** 0.85
            out[k, 14] = np.sqrt(times.max() / len(own))
        if len(own) > 1:
            out[k, 15] = np.sqrt((own[1:] == own[:-1]).mean())
            pairs = own[1:] * (len(words) + 1) + own[:-1]
            out[k, 18] = np.sqrt(1 - len(np.unique(pairs)) / len(pairs))
        if text:
            lines = text.split("\n")
            out[k, 16] = np.log1p(len(text) / len(lines))
            out[k, 17] = np.sqrt((len(lines) - len(set(lines))) / (len(lines) + 3))
    return out


def shrunk_covariance(rows: np.ndarray, center: np.ndarray) -> np.ndarray:
    """Covariance, shrunk towards a multiple of the identity by Ledoit and Wolf's estimate."""
    x = rows - center
    n, p = x.shape
    sample = x.T @ x / n
    scale = np.trace(sample) / p
    distance = ((sample - scale * np.eye(p)) ** 2).sum()
    noise = ((x**2).sum(1) ** 2).sum() / n**2 - (sample**2).sum() / n
    share = min(1.0, max(0.02, noise / distance if distance > 0 else 1.0))
    return (1 - share) * sample + share * max(scale, 1e-6) * np.eye(p)


class Discriminant:
    """Class means and cached factors; ``score`` gives the chance of class 1."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray):
        # without labels of either class a document counts as good
        self.odds = float(np.log((labels.sum() + 2.0) / (len(labels) - labels.sum() + 0.5)))
        self.classes = []
        if 2 <= labels.sum() <= len(labels) - 2:
            self.center, self.scale = np.median(rows, axis=0), np.maximum(rows.std(0), 1e-3)
            z = self.standard(rows)
            for own in (z[labels == 0], z[labels == 1]):
                factor = np.linalg.cholesky(shrunk_covariance(own, own.mean(0)))
                half_log = np.log(np.diag(factor)).sum()
                self.classes.append((own.mean(0), np.linalg.inv(factor), half_log))

    def standard(self, rows: np.ndarray) -> np.ndarray:
        """Deviations from the median; those of short texts, which come by chance, are shrunk."""
        words = np.expm1(rows[:, :1])
        return np.clip((rows - self.center) / self.scale, -8, 8) * (words / (words + SHORT))

    def score(self, rows: np.ndarray) -> np.ndarray:
        value = np.full(len(rows), self.odds)
        if self.classes:
            z = self.standard(rows)
            density = [
                -half_log - 0.5 * (((z - mean) @ inverse.T) ** 2).sum(1) for mean, inverse, half_log in self.classes
            ]
            value = value + density[1] - density[0]
        return 1 / (1 + np.exp(-np.clip(value, -60, 60)))


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the doc_id as text, modulo ``parts``."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(parts))


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, use: Column, sample_rows: int
) -> DataFrame:
    """doc_id, text, label of at most ``sample_rows`` labelled documents: those of least hash."""
    chosen = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & use)
        .groupBy("doc_id").agg(F.min(label).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    )
    # sample_rows rows of a long and an int at most; of rows that share a doc_id the text of least hash teaches
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    least = F.min(F.struct(F.xxhash64("text").alias("hash"), "text"))
    return found.groupBy("doc_id", "label").agg(least.alias("_least")).select("doc_id", F.col("_least.text").alias("text"), "label")


def fit(sample: DataFrame) -> Discriminant:
    def make():
        words = WordTable()

        def step(batch: pa.RecordBatch):
            texts = batch.column(1).to_pylist()
            for lo, hi in batches(texts):
                rows = statistics(texts[lo:hi], words)
                yield pa.record_batch(
                    [batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array(rows.tolist(), pa.list_(pa.float64()))],
                    names=["doc_id", "label", "row"],
                )

        return step

    found = arrow_map(sample.select("doc_id", "text", "label"), make, "doc_id long, label int, row array<double>").toPandas()
    found = found.sort_values("doc_id", kind="stable")
    if not len(found):
        return Discriminant(np.zeros((0, len(STATISTICS))), np.zeros(0))
    return Discriminant(np.stack(found["row"].to_numpy()), found["label"].to_numpy())


def quality_scores(
    docs: DataFrame, model: Discriminant, threshold: float = 0.7, keep: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """The ``keep`` columns, score and predicted (1 if the score is ``threshold`` or more)."""
    kinds = dict(docs.dtypes)

    def make():
        words = WordTable()

        def step(batch: pa.RecordBatch):
            texts = batch.column(0).to_pylist()
            for lo, hi in batches(texts):
                score = model.score(statistics(texts[lo:hi], words))
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


def accepted(docs: DataFrame, model: Discriminant, threshold: float = 0.7) -> DataFrame:
    """The documents, with all their columns, that score ``threshold`` or more."""

    def make():
        words = WordTable()

        def accept(texts: list[str | None]) -> np.ndarray:
            parts = [model.score(statistics(texts[lo:hi], words)) >= threshold for lo, hi in batches(texts)]
            return np.concatenate(parts) if parts else np.empty(0, bool)

        return accept

    return arrow_filter(docs, "text", make)


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000) -> Discriminant:
    """The model on rows whose fold modulo 4 is not 2."""
    use = fold(F.col("doc_id"), 4) != 2
    return fit(labelled_sample(docs, labels, "quality", use, sample_rows))


def classify(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000) -> DataFrame:
    """doc_id, held_out, score, predicted for each document."""
    model = train(docs, labels, sample_rows)
    held_out = F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False))
    return quality_scores(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")
