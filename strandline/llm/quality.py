"""Quality classifier (operator 10): zstandard dictionaries of good and bad text.

Two dictionaries are built from labelled texts. A text is cut into pieces of ``piece_bytes`` (all of it, so that a long
text cannot teach the compressor its own vocabulary), each piece is compressed with either dictionary, and the summed
size difference over the bytes of the text is turned into a probability by a logistic curve fitted on labelled rows that the
dictionaries did not see, weighed to the share of good documents among all training labels.

Defined results: null and empty texts have difference 0 and get the curve's value there; with no labelled rows of one
class every score is 0.5; rows with a null label or null id never train; of several labels of one id the mean counts;
repeated rows are scored alike; only ``text`` is read for a score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from strandline.llm.common import crc_of_id, slices, text_buffer


@dataclass(frozen=True)
class QualityModel:
    good: bytes
    bad: bytes
    weights: tuple[float, float] | None
    piece_bytes: int = 512
    level: int = 3


def _one_label(labels: DataFrame, label: str, keep: Column) -> DataFrame:
    """doc_id and class ``_y`` of every labelled id of ``keep``."""
    one = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).where(keep)
    return one.groupBy("doc_id").agg((F.avg(label) >= 0.5).cast("int").alias("_y"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, keep: Column, rows_per_class: int, most_chars: int) -> list[tuple[str, int]]:
    """At most ``rows_per_class`` labelled texts of each class, picked by a hash of the id.

    A bounded fitting sample: texts over ``most_chars`` are left to scoring, which bounds what reaches the driver to
    ``2 * rows_per_class * most_chars`` characters however large the tables are.
    """
    one = _one_label(labels, label, keep)
    order = [F.xxhash64("doc_id", F.lit(label)), "doc_id"]
    picked = [one.where(F.col("_y") == y).orderBy(*order).limit(2 * rows_per_class) for y in (0, 1)]
    ids = [(r[0], r[1]) for part in picked for r in part.collect()]  # ids first: only the picked texts move
    chosen = F.broadcast(docs.sparkSession.createDataFrame(ids, "doc_id long, _y int"))  # at most 4 * rows_per_class rows
    rows = docs.select("doc_id", "text").where(F.length("text").between(1, most_chars)).join(chosen, "doc_id")
    # of these bounded rows the first of each class travel
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy("_y").orderBy(*order, "text"))).where(F.col("_n") <= rows_per_class)
    return [(t, y) for y, _, t in sorted((r[0], r[1], r[2]) for r in first.select("_y", "doc_id", "text").collect())]


def class_share(labels: DataFrame, label: str, keep: Column) -> float | None:
    """Share of class 1 among all labelled ids of ``keep`` (None: there are none)."""
    return _one_label(labels, label, keep).agg(F.avg("_y")).first()[0]


def fit_quality(docs: DataFrame, labels: DataFrame, *, rows_per_class: int = 1000, most_chars: int = 12_000, dict_bytes: int = 65_536, piece_bytes: int = 512, level: int = 3) -> QualityModel:
    """Dictionaries and curve from a bounded sample of labelled rows outside the held-out fold (crc32(id) mod 4 = 2)."""
    train = crc_of_id("doc_id") % 4 != 2
    sample = labelled_sample(docs, labels, "quality", train, rows_per_class, most_chars)
    share = class_share(labels, "quality", train)
    return fit_quality_rows(sample, dict_bytes=dict_bytes, piece_bytes=piece_bytes, level=level, share=share)


def fit_quality_rows(sample: list[tuple[str, int]], *, dict_bytes: int = 65_536, piece_bytes: int = 512, level: int = 3, share: float | None) -> QualityModel:
    parts = {y: [t.encode() for t, label in sample if label == y] for y in (0, 1)}
    if min(len(p) for p in parts.values()) < 4:
        return QualityModel(b"", b"", None, piece_bytes, level)
    # every third text calibrates, the others make the dictionary
    made = [_dictionary([t for i, t in enumerate(parts[y]) if i % 3], dict_bytes, piece_bytes) for y in (1, 0)]
    model = QualityModel(made[0], made[1], (0.0, 0.0), piece_bytes, level)
    held = [(t.decode(), y) for y in (0, 1) for t in parts[y][::3]]
    x = size_difference(pa.array([t for t, _ in held]), model)
    return QualityModel(made[0], made[1], _logistic(x, np.array([y for _, y in held], float), share), piece_bytes, level)


def _dictionary(texts: list[bytes], dict_bytes: int, piece_bytes: int) -> bytes:
    pieces = [t[i : i + piece_bytes] for t in texts for i in range(0, len(t), piece_bytes)]
    try:
        return zstd.train_dictionary(dict_bytes, pieces).as_bytes()
    except zstd.ZstdError:  # too few pieces to train on: their text itself serves as a raw dictionary
        return b"".join(pieces)[-dict_bytes:]


def _logistic(x: np.ndarray, y: np.ndarray, share: float, ridge: float = 1e-3, rounds: int = 60) -> tuple[float, float]:
    """Newton's method on the standardised difference; class 1 weighs ``share``, its share among all training labels."""
    mid, scale = float(x.mean()), float(x.std()) or 1.0
    design = np.stack([(x - mid) / scale, np.ones_like(x)], 1)
    weight = np.where(y > 0, share / max(y.sum(), 1), (1 - share) / max((1 - y).sum(), 1)) * len(y)
    beta = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        slope = design.T @ (weight * (p - y)) + ridge * len(y) * np.array([beta[0], 0])
        curve = (design * (weight * p * (1 - p))[:, None]).T @ design + ridge * len(y) * np.eye(2)
        step = np.linalg.solve(curve, slope)
        beta -= step
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0] / scale), float(beta[1] - beta[0] * mid / scale)


_ready: dict[tuple, list] = {}


def _compressors(model: QualityModel) -> list:
    key = (hash(model.good), hash(model.bad), model.level)
    if key not in _ready:
        _ready.clear()
        made = []
        for raw in (model.good, model.bad):
            d = zstd.ZstdCompressionDict(raw)
            d.precompute_compress(level=model.level)
            made.append(zstd.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
        _ready[key] = made
    return _ready[key]


def size_difference(texts: pa.Array, model: QualityModel) -> np.ndarray:
    """(bytes with the bad dictionary - bytes with the good one) / bytes of the text, for each text."""
    data, offsets = text_buffer(texts)
    out = np.zeros(len(offsets) - 1)
    good, bad = _compressors(model)
    view, step = memoryview(data), model.piece_bytes
    for lo, hi in slices(offsets):
        for i in range(lo, hi):
            a, b = int(offsets[i]), int(offsets[i + 1])
            if b > a:
                pieces = [view[j : min(j + step, b)] for j in range(a, b, step)]
                g, w = sum(len(good.compress(p)) for p in pieces), sum(len(bad.compress(p)) for p in pieces)
                out[i] = (w - g) / (b - a)
    return out


def quality_scores(texts: pa.Array, model: QualityModel) -> np.ndarray:
    if model.weights is None:
        return np.full(len(texts), 0.5)
    return 1 / (1 + np.exp(-np.clip(model.weights[0] * size_difference(texts, model) + model.weights[1], -30, 30)))


def score_quality(docs: DataFrame, model: QualityModel, column: str = "score") -> DataFrame:
    """``docs`` with a quality probability of its whole ``text`` in ``column``."""

    @arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        return pa.array(quality_scores(texts, model))

    return docs.withColumn(column, scored(F.col("text")))


def quality_report(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **fit) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    scored = score_quality(docs.select("doc_id", "text"), fit_quality(docs, labels, **fit))
    return scored.select("doc_id", (crc_of_id("doc_id") % 4 == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
