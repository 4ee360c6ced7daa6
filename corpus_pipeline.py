"""The training-data pipeline: STAGES, run() and ORACLE_SQL.

language   texts that no language's dictionary explains well go
near_dups  one document of each group of near-duplicates stays
secrets    credentials are masked in the texts; every document stays
mixing     documents are emitted as often as their source's target asks
pieces     texts are encoded to pieces and decoded again; the last stage
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinframe.llm import language, mixing, neardup, pieces, secrets
from kinframe.llm.common import columns_or_null, stash, work_dir

DOCUMENTS = {"doc_id": "long", "text": "string", "lang": "string", "source": "string", "n_chars": "long"}


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is clear."""
    docs = columns_or_null(docs, DOCUMENTS)
    known = language.learn_dictionaries(docs.where(~language.held_out()))
    return language.identify(docs, known).where("not rejected").select(*DOCUMENTS)


def own_ids(docs: DataFrame, folder: str) -> DataFrame:
    """``docs`` with ``_digest`` of the text and ``_id``: doc_id, but a number above all of them for further texts of one id.

    So an id's texts are documents of their own, those after the first (by digest) as if they came last.
    """
    digested = docs.withColumn("_digest", F.coalesce(F.md5("text"), F.lit("")))  # no text is a text of its own
    per_id = digested.where("doc_id is not null").groupBy("doc_id").agg(F.min("_digest").alias("first"), F.max("_digest").alias("last"))
    several = stash(per_id.where("first <> last").select("doc_id", "first"), f"{folder}/several")
    if not several.take(1):
        return digested.withColumn("_id", F.col("doc_id"))
    top = docs.agg(F.max("doc_id")).first()[0]
    further = digested.join(several, "doc_id").where("_digest <> first").select("doc_id", "_digest").distinct()
    further = stash(further.withColumn("_fresh", F.monotonically_increasing_id() + (top + 1)), f"{folder}/further")
    return digested.join(further, ["doc_id", "_digest"], "left").withColumn("_id", F.coalesce("_fresh", "doc_id")).drop("_fresh")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of least id of each group; of equal rows one stays, unlike texts of one id are documents of their own, and rows without an id all stay."""
    docs = own_ids(columns_or_null(docs, DOCUMENTS), work_dir(spark, "ids"))
    dropped = neardup.near_duplicates(docs.select(F.col("_id").alias("doc_id"), "text")).where("not kept").select(F.col("doc_id").alias("_id")).distinct()
    left = docs.join(dropped, "_id", "left_anti")
    # rows of one id: exchanged with the text only here, where the join has dealt them by id already
    own = left.where("_id is not null").dropDuplicates(["_id", "_digest"]).select(*DOCUMENTS)
    return own.unionByName(docs.where("_id is null").select(*DOCUMENTS)).select(*DOCUMENTS)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask credentials; no document is dropped."""
    docs = columns_or_null(docs, DOCUMENTS)
    return secrets.redact(docs, secrets.learn_formats(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Emit each document as often as the mixture asks."""
    return mixing.mix(columns_or_null(docs, DOCUMENTS))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The piece ids of every row, the text decoded from them, counts, a digest and the round trip."""
    return pieces.encoded(columns_or_null(docs, DOCUMENTS))


STAGES = [
    ("language", identify_language),
    ("near_dups", drop_near_duplicates),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
    ("pieces", encode_pieces),
]

#: Compression, hashing and the lattice cannot be said in SQL; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = work_dir(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stash(docs, f"{folder}/{k}-{name}")
    return docs
