"""A corpus pipeline: five stages, each one of the llm operators, over ``documents``.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept.
Nothing is learned from ``docs`` but what the stage's own docstring says.  Every stage
but the last returns the columns of its ``docs``, whatever they are; ``docs`` must have
doc_id, text and source.  An empty table gives an empty table at each stage.

``run`` writes each stage as Parquet into the shared folder and reads it again, so the
order of the files carries the mix to the packing.  A stage's files are removed once the next stage is
written; those of the last written one stay, as the result is read from them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passbook.llm import minhash, mixing, packing, rankquality, toxicity
from passbook.llm.common import shared_dir


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.3; the model is learned from the labels' training fold in ``sf_dir``.

    A null or empty text has no words and stays (unless most of the labelled rows are toxic).
    Each row is judged by its text alone: null ids stay or go like others, repeated rows together.
    A score of exactly 0.3 goes.
    """
    return toxicity.keep(docs, toxicity.model_for(spark, sf_dir))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least 0.5; the model is learned from the labels' training fold in ``sf_dir``.

    A null text is scored as an empty one.  Each row is judged by its text alone: null ids stay or
    go like others, repeated rows together.  A score of exactly 0.5 stays.
    """
    return rankquality.keep(docs, rankquality.model_for(spark, sf_dir))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of least id, of each component at five-word shingle similarity of 0.8 or more.

    Null and empty texts and texts without a word are no copies of each other: all stay.  A
    row with a null id stays and stands for no other.  Rows that repeat the least id of a component all stay
    if they are part of it.
    """
    return minhash.keep_one_each(docs, size=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mix: weights by the integer square root of each source's documents.

    The rows are sorted by position, so the files written from them, in the order of
    their names, are the mixed stream.  A null source is a source of its own.  Equal and null ids take
    any order among each other; every row stays.
    """
    whole = docs.select("doc_id", "source", F.struct("*").alias("_whole"))
    return mixing.mix(whole).orderBy("position").select("_whole.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences of 2048 tokens window by window of the mix.

    Rows of ``packing.pack_stream``: sequence numbers rise with the order of ``docs`` in its files.  A null
    or empty text is one piece with the end id alone; null ids and repeated rows are packed each.
    """
    import public_tokenizers

    return packing.pack_stream(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_low_quality),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The stages learn models and pack by heuristics, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again but the last."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before is not None:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{before}")
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
