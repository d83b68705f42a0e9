"""Quality classifier by compression: which of two zstandard dictionaries shortens a text more.

One dictionary is built from blocks of good labelled texts, one from blocks of bad ones. A whole text is compressed block by
block with either; the difference of the sizes over their sum is the feature, and a logistic curve fitted to other labelled
documents turns it into a probability.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from showgrid.llm.common import documents
from showgrid.llm.queries import query

#: Bytes of a block. Blocks are compressed one by one, so that a long text cannot teach itself what the dictionary should.
BLOCK = 2048
#: Bounds of the fit: documents of a class for the dictionaries, blocks of a class that train one, documents of the curve.
FIT_DOCS, FIT_BLOCKS, CURVE_DOCS = 2000, 4000, 12000
DICTIONARY = 110 * 1024
LEVEL = 3


@dataclass
class Model:
    good: bytes
    bad: bytes
    slope: float
    shift: float


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned; a null id counts as not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def blocks(text: str | None) -> list[bytes]:
    raw = (text or "").encode("utf-8", "replace")
    return [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]


class Compressors:
    """Both compressors of a model, built once per task."""

    def __init__(self, good: bytes, bad: bytes):
        self.pair = []
        for data in (good, bad):
            kind = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_AUTO)
            kind.precompute_compress(level=LEVEL)
            self.pair.append(zstandard.ZstdCompressor(dict_data=kind, write_content_size=False, write_dict_id=False))

    def feature(self, text: str | None) -> float:
        """(bad size - good size) / (bad size + good size) over all blocks; 0 for an empty or null text."""
        good = bad = 0
        for b in blocks(text):
            good += len(self.pair[0].compress(b))
            bad += len(self.pair[1].compress(b))
        return (bad - good) / (bad + good) if good + bad else 0.0


def dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary; too few samples for training serve as raw content instead."""
    try:
        return zstandard.train_dictionary(DICTIONARY, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY:] or b"\n" * 8


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift by Newton steps with a light ridge on the standardized feature."""
    if not len(x) or y.min() == y.max():
        return 0.0, 0.0 if not len(x) else float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    mean, spread = x.mean(), x.std() or 1.0
    z = np.column_stack([(x - mean) / spread, np.ones(len(x))])
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p))[:, None]).T @ z + np.diag([0.1, 1e-6])
        step = np.linalg.solve(h, z.T @ (y - p) - np.array([0.1 * w[0], 1e-6 * w[1]]))
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0] / spread), float(w[1] - w[0] * mean / spread)


def fit(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS, fit_blocks: int = FIT_BLOCKS, curve_docs: int = CURVE_DOCS) -> Model:
    """Fit on a bounded sample of labelled documents that are not held out, the first by id hash.

    Documents labelled both 0 and 1, null labels and null ids teach nothing. With one class only, or none, the score is
    constant. The sampled ids, at most ``2 * fit_docs + curve_docs``, are broadcast; the driver gets ``fit_blocks`` blocks a class and
    one number a document of the curve.
    """
    known = (labels.where("doc_id is not null and quality in (0, 1)").where(~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("_m")).where("quality = _m").drop("_m")
             .withColumn("_h", F.xxhash64("doc_id")))
    order = [F.col("_h"), F.col("doc_id")]
    of_class = lambda k: known.where(F.col("quality") == k).orderBy(*order).limit(fit_docs)
    teach = of_class(0).union(of_class(1)).select("doc_id", "quality")
    texts = docs.select("doc_id", "text").join(F.broadcast(teach), "doc_id").where("text is not null")

    def cut(batches):
        for b in batches:
            rows = [(q, i, j, x) for d, t, q in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "quality"))) for j, x in enumerate(blocks(t)) for i in (d,)]
            yield pa.RecordBatch.from_pydict({"quality": pa.array([r[0] for r in rows], pa.int32()), "doc_id": pa.array([r[1] for r in rows], pa.int64()),
                                              "n": pa.array([r[2] for r in rows], pa.int32()), "block": pa.array([r[3] for r in rows], pa.binary())})

    cuts = texts.select("doc_id", "text", F.col("quality").cast("int").alias("quality")).mapInArrow(cut, "quality int, doc_id long, n int, block binary")
    sample = {k: [bytes(r["block"]) for r in cuts.where(F.col("quality") == k).orderBy(F.xxhash64("doc_id", "n"), "doc_id", "n", "block").limit(fit_blocks).collect()] for k in (0, 1)}
    good, bad = dictionary(sample[1]), dictionary(sample[0])

    curve = known.join(F.broadcast(teach.select("doc_id")), "doc_id", "left_anti").orderBy(*order).limit(curve_docs).select("doc_id", "quality")
    points = score_feature(docs.select("doc_id", "text").join(F.broadcast(curve), "doc_id"), good, bad).select("feature", "quality").toPandas()
    if len(points) < 100:  # too few other documents: those of the dictionaries have to do
        points = score_feature(texts, good, bad).select("feature", "quality").toPandas()
    slope, shift = logistic(points["feature"].to_numpy(float), points["quality"].to_numpy(float))
    return Model(good, bad, slope, shift)


def score_feature(docs: DataFrame, good: bytes, bad: bytes, keep: str | None = None) -> DataFrame:
    """``docs``, or its column ``keep``, with the double ``feature`` of ``text``."""
    rows = docs.select(keep, "text") if keep else docs
    names = [c for c in rows.columns if not keep or c == keep]
    schema = rows.select(*names, F.lit(0.0).alias("feature")).schema

    def run(batches):
        tools = Compressors(good, bad)
        for b in batches:
            feature = [tools.feature(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(feature, pa.float64())], names=[*names, "feature"])

    return rows.mapInArrow(run, schema)


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on). Only ``text`` is looked at.

    Empty and null texts get the score of the feature 0. Rows are scored one by one, so repeated rows agree. Columns of
    ``docs`` that are already named so are replaced.
    """
    scored = predictions(docs, model)
    rest = [c for c in docs.columns if c not in ("score", "predicted")]
    return scored.select(*[F.col("row").getField(c).alias(c) for c in rest], "score", "predicted")


def predictions(docs: DataFrame, model: Model) -> DataFrame:
    """(row, score, predicted) with the whole row of ``docs`` as a struct."""
    out = score_feature(docs.select(F.struct(*docs.columns).alias("row"), "text"), model.good, model.bad, "row")
    score = F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.col("feature") * F.lit(model.slope) + F.lit(model.shift))))
    return out.select("row", score.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def read_labels(spark, folder) -> DataFrame:
    return spark.read.parquet(f"{folder}/labels.parquet")


@query("op1_quality")
def op1(spark, folder):
    docs = documents(spark, folder).select("doc_id", "text")
    return classify(docs.select("doc_id", "text"), fit(docs, read_labels(spark, folder))).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
