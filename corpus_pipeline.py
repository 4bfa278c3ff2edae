"""Corpus preparation: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept
and returns a DataFrame, which is written as Parquet and read again as the
next one's documents.

Rules for every stage: an empty table gives no rows; other columns, whatever their names, pass unchanged through all
stages but the last; a stage that hands whole texts to Python lowers the session's batch limits for the job that writes its
result, and ``run`` puts them back; what a stage does with nulls and repeated rows is said at the stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm.common import free, hand_small_batches, small_batches, stored, table, tokenizer_path
from pairloom.llm.langid import drop_unidentified, train_language_model
from pairloom.llm.mixing import mixed_documents
from pairloom.llm.packing import pack_documents
from pairloom.llm.partenum import keep_one
from pairloom.llm.pii import redact, train_spans


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model recognises.

    A document goes if its text is null or has no letter, or if no learned language reaches LEAST_SCORE, of 1 for all of
    them.  Rows without a language or text teach nothing; repeated rows are treated alike.
    """
    hand_small_batches(spark, BATCH)
    learn = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")
    return drop_unidentified(docs, train_language_model(learn), LEAST_SCORE)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group linked by a Jaccard similarity of 0.75 or more on five-word shingles.

    The one of the smallest id stays; of rows that repeat id and text one.  Null and wordless texts are linked with nothing and stay.
    """
    return keep_one(docs, threshold=0.75, width=5)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind, n_chars counted anew.  A null text stays null; no row goes."""
    hand_small_batches(spark, BATCH)
    out = docs.withColumn("text", redact(docs, train_spans(docs)))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mix_by_source(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources ask for.

    A null source is one of its own, last in order; null and wordless texts are never taken; repeated rows are taken one by one.
    """
    return mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens and their places in sequences.  A null text is packed as the end id alone; repeated rows one by one."""
    hand_small_batches(spark, BATCH)
    return pack_documents(docs, tokenizer_path(), room=ROOM)


#: Whole texts that a Python worker is handed at a time: ten thousand, Spark's default, fill too much of its memory.
BATCH = 1000
#: Parts of words that packing remembers a task: workers of all stages share an executor's memory.
ROOM = 20_000
#: A language is found if its share of the evidence, four languages having at least a quarter, is so large.
LEAST_SCORE = 0.4
STAGES = [
    ("language_id", identify_language),
    ("near_copies", drop_near_copies),
    ("personal_data", redact_personal_data),
    ("source_mix", mix_by_source),
    ("packing", pack),
]
#: Trained models and token ids are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    with small_batches(spark, BATCH):
        for _, stage in STAGES:
            before, docs = docs, stored(stage(spark, docs, sf_dir))
            free(before)
    return docs
