"""Quality scores: random Fourier features over document statistics, ridge by summed normal equations, isotonic."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airloom.llm.common import remainder, stored, texts

FEATURES = 256
WIDTH = 2.0  # of the Gaussian kernel, in standard deviations of the statistics
RIDGE = 1e-3
CUT = 0.7
BINS = 1024
SLICES = 1_000
SEED = 11
# Shares are taken of so many bytes or words more: a telephone number in a text of five words says little about it.
FEW_BYTES, FEW_WORDS = 64, 8

_BYTES = np.arange(256)
_IS = {  # byte classes by ASCII range; bytes from 128 on belong to letters of other scripts
    "upper": (_BYTES >= 65) & (_BYTES <= 90),
    "digit": (_BYTES >= 48) & (_BYTES <= 57),
    "space": np.isin(_BYTES, [9, 10, 11, 12, 13, 32]),
    "stop": np.isin(_BYTES, [33, 46, 63]),
    "shout": _BYTES == 33,
    "bar": _BYTES == 124,
    "symbol": np.isin(_BYTES, list(b"#$%&*+/<=>@[]\\^_`{}~")),
    "high": _BYTES >= 128,
}
STATISTICS = [*_IS, "words", "word_length", "same_as_before", "distinct", "same_lines"]


def statistics(text: str) -> list[float]:
    """The statistics of one text, bounded or on a log scale; all zero for a text without words."""
    raw = text.encode()
    words = raw.split()
    if not words:
        return [0.0] * len(STATISTICS)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    shares = [float(np.sqrt(counts[mask].sum() / (len(raw) + FEW_BYTES))) for mask in _IS.values()]
    n = len(words)
    same = sum(map(bytes.__eq__, words, words[1:])) / (n + FEW_WORDS)
    lines = [line for line in raw.split(b"\n") if not line.isspace() and line]  # a blank line repeats nothing
    return shares + [float(np.log1p(n)), float(np.log1p((len(raw) - counts[_IS["space"]].sum()) / n)), float(same),
                     float(np.log1p(len(set(words))) / np.log1p(n)), 1 - len(set(lines)) / len(lines)]


def document_statistics(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``stats`` of every whole text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "stats": [statistics(t) for t in batch["text"]]})

    return texts(docs).mapInPandas(run, "doc_id long, stats array<double>")


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), float).reshape(-1, len(STATISTICS))


@dataclass
class QualityModel:
    """Scores for arrays of statistics; without labels of both kinds it is the constant ``prior``."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    edges: np.ndarray
    levels: np.ndarray
    prior: float
    fitted: bool

    def features(self, stats: np.ndarray) -> np.ndarray:
        """cos(wx + b): inner products of these approximate a Gaussian kernel."""
        draw = np.random.default_rng(SEED)
        w = draw.normal(0, 1 / WIDTH, (stats.shape[1], FEATURES))
        b = draw.uniform(0, 2 * np.pi, FEATURES)
        z = np.clip((stats - self.mean) / self.scale, -4, 4)
        return np.hstack([np.cos(z @ w + b) * np.sqrt(2 / FEATURES), np.ones((len(z), 1))])

    def ridge(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        if not self.fitted:
            return np.full(len(stats), self.prior)
        return np.interp(self.ridge(stats), self.edges, self.levels)


def isotonic(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Non-decreasing fit by pooling adjacent violators."""
    pools: list[list[float]] = []
    for value, weight in zip(values, weights):
        pools.append([value, weight, 1])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            v, w, n = pools.pop()
            last = pools[-1]
            last[0] = (last[0] * last[1] + v * w) / (last[1] + w)
            last[1] += w
            last[2] += n
    return np.repeat([p[0] for p in pools], [int(p[2]) for p in pools])


def _normal_equations(rows: DataFrame, model: QualityModel) -> tuple[np.ndarray, np.ndarray]:
    """Sums of features times features and times label: one matrix per partition, summed row by row."""
    size = FEATURES + 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((size, size + 1))
        for batch in batches:
            x = model.features(_matrix(batch["stats"]))
            total += x.T @ np.hstack([x, batch["quality"].to_numpy(float)[:, None]])
        yield pd.DataFrame({"i": np.arange(size), "line": list(total)})

    def add(lines: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": lines["i"].iloc[:1], "line": [np.sum(lines["line"].tolist(), axis=0)]})

    def add_slice(lines: pd.DataFrame) -> pd.DataFrame:
        return add(lines).assign(slice=lines["slice"].iloc[0])

    # Two levels: a group holds a line per partition of its slice, then one per slice.
    each = rows.mapInPandas(run, "i int, line array<double>").withColumn("slice", F.spark_partition_id() % SLICES)
    lines = each.groupBy("i", "slice").applyInPandas(add_slice, "i int, line array<double>, slice int").select("i", "line").groupBy(
        "i").applyInPandas(add, "i int, line array<double>")
    made = lines.toPandas().sort_values("i")  # FEATURES + 1 rows, whatever the input
    both = np.array(made["line"].tolist()).reshape(size, size + 1)
    return both[:, :-1], both[:, -1]


def fit_quality(stats: DataFrame, labels: DataFrame) -> QualityModel:
    """Fit on all rows of ``stats`` that have a label (``doc_id``, ``quality`` 0 or 1; nulls do not count).

    Two thirds of the labelled rows, by a hash of the id, fit the ridge; the last third calibrates it.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    rows = stored(stats.where("doc_id is not null").join(known.where("quality in (0, 1)"), "doc_id").withColumn(
        "part", F.pmod(F.xxhash64("doc_id"), F.lit(3))), "quality-rows")
    size = len(STATISTICS)
    stat = [F.col("stats")[i] for i in range(size)]
    sums = rows.agg(F.count("*").alias("n"), F.avg("quality").alias("prior"), F.min("quality").alias("low"),
                    F.max("quality").alias("high"), *[F.avg(s).alias(f"m{i}") for i, s in enumerate(stat)],
                    *[F.stddev_pop(s).alias(f"d{i}") for i, s in enumerate(stat)]).first()
    if not sums["n"] or sums["low"] == sums["high"]:
        prior = float(sums["prior"]) if sums["n"] else 0.5
        return QualityModel(np.zeros(size), np.ones(size), np.zeros(FEATURES + 1), np.zeros(1), np.zeros(1), prior, False)
    model = QualityModel(np.array([sums[f"m{i}"] for i in range(size)]),
                         np.maximum([sums[f"d{i}"] for i in range(size)], 1e-6), np.zeros(FEATURES + 1),
                         np.array([0.0, 1.0]), np.array([0.0, 1.0]), float(sums["prior"]), True)
    square, cross = _normal_equations(rows.where("part < 2"), model)
    model.weights = np.linalg.solve(square + RIDGE * max(square[-1, -1], 1) * np.eye(len(square)), cross)

    def bins(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at = np.clip(np.floor((model.ridge(_matrix(batch["stats"])) + 0.5) * BINS / 2), 0, BINS - 1)
            yield pd.DataFrame({"bin": at.astype(int), "quality": batch["quality"]})

    held = (rows.where("part = 2").mapInPandas(bins, "bin int, quality int").groupBy("bin")
            .agg(F.avg("quality").alias("rate"), F.count("*").alias("n")).toPandas().sort_values("bin"))  # BINS rows at most
    if len(held):
        model.edges = (held["bin"].to_numpy(float) + 0.5) * 2 / BINS - 0.5
        model.levels = np.clip(isotonic(held["rate"].to_numpy(float), held["n"].to_numpy(float)), 0, 1)
    return model


def score_quality(docs: DataFrame, labels: DataFrame, held_out_of: int = 4, held_out: int = 2) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``; also the raw ``stats``.

    Labels are learnt only from rows whose crc32(doc_id) modulo ``held_out_of`` is not ``held_out``; scores use
    the text alone. Null and empty texts have all statistics zero and are scored by these. A null id has no
    label and is not held out. Without labels of both kinds every score is the label's mean, or 0.5 without any.
    Repeated rows give repeated rows, repeated labels count repeatedly.
    """
    stats = stored(document_statistics(docs).withColumn("held_out", remainder(F.col("doc_id"), held_out_of) == held_out),
                   "quality-stats")
    model = fit_quality(stats.where("not held_out").select("doc_id", "stats"), labels)
    return _scored(stats, model)


def _scored(stats: DataFrame, model: QualityModel) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            score = model.score(_matrix(batch["stats"]))
            yield batch.assign(score=score, predicted=(score >= CUT).astype(np.int32))

    return stats.mapInPandas(run, "doc_id long, stats array<double>, held_out boolean, score double, predicted int")


def drop_low_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with all their columns; the model learns as above.

    The texts are scored where they lie, so no row is moved. Without labels of both kinds all rows stay.
    """
    stats = stored(document_statistics(docs.where(remainder(F.col("doc_id"), 4) != 2)
                                       .join(labels.select("doc_id").distinct(), "doc_id", "left_semi")), "quality-stats")
    model = fit_quality(stats, labels)
    if not model.fitted:
        return docs

    @F.pandas_udf("boolean")
    def accepted(column: pd.Series) -> pd.Series:
        return pd.Series(model.score(_matrix(column.fillna("").map(statistics))) >= CUT)

    return docs.where(accepted(F.col("text").cast("string")))
