"""A training-data pipeline of five stages over the documents.

Each stage gets what the stage before kept. ``run`` writes every stage as Parquet below ``spark.checkpoint.dir`` and reads it
again, so a lost executor costs one stage at most. There is no checking SQL, because zstandard dictionaries and the piece automaton have no
SQL form; ``tests/llm/test_pipeline.py`` holds the rows against a brute-force version.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from showgrid.llm import mixing, ngrams, pieces, quality, secrets

ORACLE_SQL = None


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier predicts as good; those it rejects go.

    Null and empty texts get the score of the feature 0 and follow it; very long texts are scored whole; repeated rows are decided alike and all stay or all go; an empty
    table stays empty; columns of any name are kept.
    """
    model = quality.fit(docs, quality.read_labels(spark, sf_dir))
    kept = quality.predictions(docs, model).where("predicted = 1")
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def one_per_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest doc_id.

    Texts without words, null and empty ones included, are in no group and stay; very long texts are compared whole; of equal rows one stays; an empty table stays empty.
    """
    return ngrams.one_of_each(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays.

    Null and empty texts stay as they are; very long texts are searched whole; repeated rows stay repeated; an empty table stays empty.
    """
    return secrets.redact(docs, secrets.train(docs))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by source weights, repeated where a target is above its source, cut at the exact budget.

    Null and empty texts have no words and are not taken; a null source is a source of its own; ties of the hash keys go by doc_id and size; repeated rows are rows of
    their own; an empty table gives an empty mix.
    """
    return mixing.mixed_documents(docs)


def encoded_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document of the mix, and whether decoding them gives the text again.

    A null text is empty and has no pieces; very long texts are encoded whole; equal best segmentations go to the one found first, so repeated rows agree; an empty
    table gives no rows.
    """
    return pieces.encode_decode(docs)


STAGES = [
    ("quality", good_documents),
    ("near_duplicates", one_per_group),
    ("secrets", without_secrets),
    ("mixing", mixed_sources),
    ("pieces", encoded_pieces),
]


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; only a local session without that setting gets one of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        base = tempfile.mkdtemp(prefix="corpus-pipeline-")
    return f"{base.rstrip('/')}/pipeline-{uuid.uuid4().hex}"


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``; the rows of the last one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = shared_folder(spark)
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
