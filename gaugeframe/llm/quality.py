"""Quality scores from compression with trained dictionaries (operator 4).

Two zstandard dictionaries are trained, on texts labelled good and on texts labelled bad. A
text is compressed with each, chunk by chunk and whole; the difference of the two sizes per
byte of text is its evidence, and a logistic curve fitted on other labelled texts turns it
into a probability of label 1.

The fit uses a bounded sample: the ``SAMPLE_ROWS`` labelled rows of smallest hash, one
passage of ``PASSAGE`` characters of each for the dictionaries (whole texts for the curve).
Half of the sample trains the dictionaries, the other half the curve. Scores use the text
only.

Nulls and empty texts score as evidence 0. Labels other than 0 and 1 and rows without an id
teach nothing. Repeated rows are scored each; repeated labels count once, contradicting ones
both ways. Without labels of both kinds every text gets the share of label 1 (0.5 if there
is none), and ``good_documents`` keeps all documents, for nothing was learned that could reject
one. An input column that bears the name of an output column is replaced.
"""

from __future__ import annotations

import functools
import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeframe.llm.data import read

SAMPLE_ROWS = 12_000
PASSAGE = 8_000
DICTIONARY_BYTES = 112 << 10
CHUNK = 16 << 10
LEVEL = 3
ACCEPT = 0.7


class QualityModel(NamedTuple):
    """score = 1 / (1 + exp(-(offset + slope * evidence)))"""

    good: bytes
    bad: bytes
    offset: float
    slope: float

    @property
    def fitted(self) -> bool:
        """False if labels of one kind are missing from a half of the sample."""
        return bool(self.good or self.bad)


@functools.lru_cache(maxsize=8)
def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    if not dictionary:
        return zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
    data = zstandard.ZstdCompressionDict(dictionary)
    data.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=False)


def trained_dictionary(samples: list[bytes]) -> bytes:
    """A zstandard dictionary; of very few samples, their text itself serves as one."""
    samples = [s for s in samples if s]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:]


def evidence(text: str | None, good: bytes, bad: bytes) -> float:
    """(size with the bad dictionary - size with the good one) / bytes of text."""
    data = (text or "").encode()
    if not data:
        return 0.0
    chunks = [data[i : i + CHUNK] for i in range(0, len(data), CHUNK)]
    sizes = [sum(len(c.compress(chunk)) for chunk in chunks) for c in (_compressor(bad), _compressor(good))]
    return (sizes[0] - sizes[1]) / len(data)


def evidence_column(text, good: bytes, bad: bytes):
    @F.arrow_udf("double")
    def compared(texts: pa.Array) -> pa.Array:
        return pa.array([evidence(value.as_py(), good, bad) for value in texts], type=pa.float64())

    return compared(text)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Offset and slope of a logistic curve, by damped Newton steps on the standardised input."""
    scale = float(x.std()) or 1.0
    design = np.column_stack([np.ones(len(x)), x / scale])
    beta = np.zeros(2)

    def loss(b: np.ndarray) -> float:
        z = design @ b
        return float(np.logaddexp(0, z).sum() - (y * z).sum() + ridge * b[1] ** 2 / 2)

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -500, 500)))
        gradient = design.T @ (p - y) + ridge * np.array([0.0, beta[1]])
        hessian = (design * (p * (1 - p))[:, None]).T @ design + (ridge + 1e-9) * np.eye(2)
        step, rate = np.linalg.solve(hessian, gradient), 1.0
        while loss(beta - rate * step) > loss(beta) and rate > 1e-6:
            rate /= 2
        beta -= rate * step
        if np.abs(rate * step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1] / scale)


def fit_quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> QualityModel:
    """Learns from the bounded sample of the given labelled rows."""
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).distinct()
    sample = known.withColumn("h", F.xxhash64("k")).orderBy("h", "k", "y").limit(SAMPLE_ROWS)
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(sample), "k").where("t is not null")
    rows = rows.withColumn("curve", F.col("h") % 2 == 0)
    # A passage at a place drawn by the hash, so that the collected bytes are bounded.
    start = F.pmod(F.col("h"), F.greatest(F.length("t") - PASSAGE, F.lit(0)) + 1) + 1
    taught = rows.where("not curve").select("y", F.substring("t", start.cast("int"), F.lit(PASSAGE)).alias("t"), "k").toArrow().to_pydict()
    by = {y: [t.encode() for k, t, own in sorted(zip(taught["k"], taught["t"], taught["y"])) if own == y] for y in (0, 1)}
    share = (len(by[1]) + 1) / (len(by[0]) + len(by[1]) + 2)
    if not by[0] or not by[1]:
        return QualityModel(b"", b"", math.log(share / (1 - share)), 0.0)
    good, bad = trained_dictionary(by[1]), trained_dictionary(by[0])
    curve = rows.where("curve").select("y", evidence_column(F.col("t"), good, bad).alias("x")).toArrow()
    x, y = (curve.column(name).to_numpy().astype(np.float64) for name in ("x", "y"))
    if len(set(y)) < 2:
        return QualityModel(b"", b"", math.log(share / (1 - share)), 0.0)
    return QualityModel(good, bad, *logistic(x, y))


def with_quality(docs: DataFrame, model: QualityModel, text: str = "text") -> DataFrame:
    """Adds score and predicted (1 if score is at least ``ACCEPT``)."""
    z = F.lit(model.offset) + F.lit(model.slope) * evidence_column(F.col(text), model.good, model.bad)
    scored = docs.withColumn("score", 1 / (1 + F.exp(-z)))
    return scored.withColumn("predicted", (F.col("score") >= ACCEPT).cast("int"))


def held_out(key: str = "doc_id"):
    """A quarter of the ids, from which nothing is learned."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 4 == 2, F.lit(False))


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier accepts, with their own columns; all if none could be fitted."""
    model = fit_quality(docs, labels.where(~held_out()))
    if not model.fitted:
        return docs
    z = F.lit(model.offset) + F.lit(model.slope) * evidence_column(F.col("text"), model.good, model.bad)
    return docs.where(1 / (1 + F.exp(-z)) >= ACCEPT)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_quality(docs, read(spark, sf_dir, "labels").where(~held_out()))
    return with_quality(docs.withColumn("held_out", held_out()), model).select("doc_id", "held_out", "score", "predicted")


QUERIES = {"op4_quality": (op4_quality, None)}
