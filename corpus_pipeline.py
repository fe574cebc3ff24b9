"""A training corpus from raw documents, in five stages, each over all that the one before it kept.

quality   documents that the line field scores below one half go
exact     of texts that are equal without white space, one stays
near      of each class of near copies, the document with the least doc_id stays
secrets   spans that look like secrets are replaced by a mark; no document goes
packing   token ids of all documents, packed into sequences

Each stage but the last returns the columns of documents, whatever further
columns there are and whatever they are called. Tables between the stages are
Parquet in the folder that spark.checkpoint.dir names.

A null text counts as empty: it gets a score like any other, is one group with
the other texts of white space in exact, is a near copy of nothing, comes out
of secrets as the empty text and is packed as its end id alone. A row with a
null doc_id is no training row and no near copy; it goes only by its score or
as an exact copy. Of rows with the same doc_id and text one stays; rows with the same
doc_id and different texts are rows of their own, but one node of the near
copies. Texts of any length are worked through whole. Empty tables go through
all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.llm import bag_minhash, exact_dedup, line_crf, packing, secrets
from quirelake.llm.common import fresh, table, vocabulary, written

ROOM = 2048


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    field = line_crf.fitted(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    scored = line_crf.scored(docs, field)
    score = scored.columns[-1]
    return scored.where(F.col(score) >= 0.5).drop(score)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicated(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    (gone_id,) = fresh(docs, "gone_id")
    gone = written(bag_minhash.near_dedup(docs).where("doc_id <> class_id").select(F.col("doc_id").alias(gone_id)).distinct(), "gone")
    few = gone.count() <= bag_minhash.BROADCAST_IDS
    return docs.join(F.broadcast(gone) if few else gone, F.col("doc_id") == F.col(gone_id), "left_anti")


def secret(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redacted(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"), ROOM, 0, with_ids=True)


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("secrets", secret), ("packing", pack)]

#: Models and token ids are beyond SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"stage-{name}")
    return docs
