"""Toxicity by cumulative-link ordinal regression on sparse text features.

P(grade <= j | x) = sigmoid(threshold_j - w.x): one weight vector for all thresholds, which are kept in
order. The expected severity is the sum over thresholds of P(grade > j). Grades come from the labels
alone: 0 not toxic, 1 toxic, 2 toxic and of low quality.

Features are the words of a text, each with a fixed value: words that stand far more often in toxic
rows than by chance weigh more (the fourth root of their chi-square), so that the L2 term holds back
words met by accident. The vocabulary is chosen by the same chi-square on counts that Spark
aggregates over the training rows; training itself runs on the driver over at most ``MAX_TRAIN``
labelled rows, each reduced to its few chosen words. Scoring is one scan.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visitloom.llm.common import materialize, only, slices, table

#: Labelled rows used for fitting, toxic and other rows each at most half of it: those with the smallest hash of doc_id.
MAX_TRAIN = 20_000
#: Words kept, and rows a word must stand in.
VOCABULARY, LEAST_ROWS = 4096, 2
#: Rows with P(toxic) from here on are rejected; classes weigh the same in the fit.
REJECT_AT = 0.35
WORD = re.compile(r"[^\W\d_]+")


def features(text: str) -> set[str]:
    """The words of a text in lower case."""
    return set(WORD.findall(text.lower()))


@dataclass
class OrdinalModel:
    """Vocabulary, shared weights (the features' values included) and ordered thresholds."""

    vocabulary: dict[str, int]
    weights: np.ndarray
    thresholds: np.ndarray

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        return np.array([self.weights[r].sum() for r in rows]) if rows else np.empty(0)

    def exceed(self, score: np.ndarray) -> np.ndarray:
        """P(grade > j) for each row and threshold."""
        return 1.0 / (1.0 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -40, 40)))

    def expected(self, score: np.ndarray) -> np.ndarray:
        return self.exceed(score).sum(1)


def fit_cumulative_link(
    rows: list[np.ndarray], grade: np.ndarray, value: np.ndarray, grades: int, row_weight: np.ndarray | None = None, l2: float = 1e-3, steps: int = 400
) -> tuple[np.ndarray, np.ndarray]:
    """Weights (times the features' values) and thresholds by accelerated gradient steps (Adam) on the weighted mean log likelihood with an L2 term."""
    n_features = len(value)
    size = np.array([len(r) for r in rows])
    col = np.concatenate(rows).astype(np.int64) if size.sum() else np.empty(0, np.int64)
    owner = np.repeat(np.arange(len(rows)), size)
    x_of = value[col]
    weight = np.ones(len(rows)) if row_weight is None else row_weight
    weight = weight / weight.sum()
    share = np.array([weight[grade <= j].sum() for j in range(grades - 1)]).clip(1e-3, 1 - 1e-3)
    t = np.log(share / (1 - share))
    x = np.concatenate([np.zeros(n_features), [t[0]], np.log(np.maximum(np.diff(t), 1e-2))])
    m, v = np.zeros_like(x), np.zeros_like(x)
    for step in range(1, steps + 1):
        w, raw = x[:n_features], x[n_features:]
        gaps = np.exp(raw[1:])
        t = np.concatenate([[raw[0]], raw[0] + np.cumsum(gaps)])
        s = np.bincount(owner, w[col] * x_of, len(rows))
        upper = np.append(t, np.inf)[grade]
        lower = np.append(-np.inf, t)[grade]
        a = 1 / (1 + np.exp(-np.clip(upper - s, -40, 40)))
        b = np.where(np.isinf(lower), 0.0, 1 / (1 + np.exp(-np.clip(lower - s, -40, 40))))
        a = np.where(np.isinf(upper), 1.0, a)
        p = np.maximum(a - b, 1e-12)
        da, db = a * (1 - a) / p, b * (1 - b) / p
        gs = (da - db) * weight  # derivative of the mean loss by the score
        gw = np.bincount(col, gs[owner] * x_of, n_features) + l2 * w
        gt = np.array([(np.where(grade == j, -da, 0) + np.where(grade == j + 1, db, 0)) @ weight for j in range(grades - 1)])
        graw = np.concatenate([[gt.sum()], [gt[i + 1 :].sum() * gaps[i] for i in range(grades - 2)]])
        g = np.concatenate([gw, graw])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x = x - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    raw = x[n_features:]
    return x[:n_features] * value, np.concatenate([[raw[0]], raw[0] + np.cumsum(np.exp(raw[1:]))])


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        words = pa.array([sorted(features(t or "")) for t in batch.column(2).to_pylist()], pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), words], names=["doc_id", "grade", "words"])


def _to_rows(vocabulary: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [sorted(vocabulary[f] for f in words if f in vocabulary) for words in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.list_(pa.int32()))], names=["doc_id", "grade", "x"])

    return run


def training_rows(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN) -> DataFrame:
    """(doc_id, grade, text) of at most ``most`` labelled documents, half of them toxic where there are so many.

    Of several labels of one document the gravest counts; a missing quality is a good one.
    """
    grade = F.when(F.col("toxic") == 0, 0).when(F.coalesce("quality", F.lit(1)) == 0, 2).otherwise(1)
    known = labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max(grade).cast("int").alias("grade"))
    known = known.join(docs.select(F.col("doc_id").alias("d")).distinct(), F.col("doc_id") == F.col("d"), "left_semi")
    known = materialize(known, "labelled")
    chosen = [known.filter(kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most // 2) for kind in ("grade = 0", "grade > 0")]
    picked = materialize(chosen[0].union(chosen[1]).select(F.col("doc_id").alias("d"), "grade"), "train-ids")
    return only(docs, "doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("d")).select("doc_id", "grade", "text")  # bound: ``most`` ids


def fit_severity(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN) -> OrdinalModel:
    """The model of grades 0 to 2. Without toxic or without clean labels it has no features and gives everything grade 0."""
    coded = training_rows(docs, labels, most).mapInArrow(_words, "doc_id long, grade int, words array<string>")
    sample = materialize(coded, "train")
    totals = {r["toxic"]: r["count"] for r in sample.groupBy((F.col("grade") > 0).cast("int").alias("toxic")).count().collect()}
    n0, n1 = totals.get(0, 0), totals.get(1, 0)
    if not n0 or not n1:
        return OrdinalModel({}, np.zeros(0), np.array([5.0, 10.0]))
    words = sample.select((F.col("grade") > 0).alias("toxic"), F.explode("words").alias("feature"))
    counts = words.groupBy("feature").agg(F.count_if(~F.col("toxic")).alias("a"), F.count_if("toxic").alias("b"))
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    expected = (a + b) * F.lit(n1 / (n0 + n1))
    chi = (b - expected) * (b - expected) / (expected * (1 - (a + b) / F.lit(float(n0 + n1 + 1))))
    best = counts.filter((a + b >= LEAST_ROWS) & (b > expected)).select("feature", chi.alias("chi")).orderBy(F.desc("chi"), "feature").limit(VOCABULARY).collect()
    vocabulary = {r["feature"]: i for i, r in enumerate(best)}
    value = np.array([r["chi"] for r in best], np.float64) ** 0.25
    value = value / np.median(value[:50]) if len(value) else value
    rows = sample.mapInArrow(_to_rows(vocabulary), "doc_id long, grade int, x array<int>").orderBy("doc_id", "grade", "x").toPandas()
    grade = rows["grade"].to_numpy()
    balance = np.where(grade > 0, n0 / n1, 1.0)
    weights, thresholds = fit_cumulative_link([np.asarray(x, np.int64) for x in rows["x"]], grade, value, 3, balance)
    return OrdinalModel(vocabulary, weights, thresholds)


def exceedances(model: OrdinalModel, texts: list[str | None]) -> np.ndarray:
    """P(grade > 0) and P(grade > 1) of each text."""
    rows = [np.array([model.vocabulary[f] for f in features(t or "") if f in model.vocabulary], np.int64) for t in texts]
    return model.exceed(model.scores(rows)) if rows else np.empty((0, 2))


def score_severity(docs: DataFrame, model: OrdinalModel, reject_at: float = REJECT_AT) -> DataFrame:
    """One row per document: doc_id, severity (expected grade, 0 to 2), p_toxic, p_severe, rejected.

    A document is rejected when P(grade > 0) is at least ``reject_at``. Null and empty texts have no
    features and get the model's base rate; rows repeated whole repeat. Texts are read whole.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most VOCABULARY features

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            p = exceedances(shared.value, batch.column(1).to_pylist())
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "severity": p.sum(1), "p_toxic": p[:, 0], "p_severe": p[:, 1], "rejected": p[:, 0] >= reject_at})

    return only(docs, "doc_id", "text").mapInArrow(run, "doc_id long, severity double, p_toxic double, p_severe double, rejected boolean")


def keep_tolerable(docs: DataFrame, model: OrdinalModel, reject_at: float = REJECT_AT) -> DataFrame:
    """The rows that are not rejected, with all their columns, in the same single scan: every row is judged by its own text, whatever its id."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield batch.filter(pa.array(exceedances(shared.value, batch.column(at).to_pylist())[:, 0] < reject_at))

    return docs.mapInArrow(run, docs.schema)


def op5_toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score_severity(docs, fit_severity(docs, labels))


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are not rejected, with all their columns."""
    return keep_tolerable(docs, fit_severity(docs, table(spark, sf_dir, "labels")))
