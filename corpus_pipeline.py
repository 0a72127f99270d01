"""Cleaning of a corpus: toxic texts, texts without a language, exact copies and near copies go; the rest is packed.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and all but the last return the
columns of documents.

Cases: each stage has those of its operator. Null and empty texts have no language and go in that stage; rows that
share an id are judged each on its own; an empty table gives no pieces; further columns are carried up to packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm import exact_dedup, language_id, ngram_join, packing, toxicity
from parley.llm.queries import fold
from parley.llm.tokens import public_path
from parley.session import stage


# Words whose ids a task keeps; fewer than by default, because the stages before leave memory with the executors.
# It costs time only: the library is asked again for words that were let go.
CACHE_WORDS = 100_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score below one half."""
    learn = docs.where(F.coalesce(fold(5) != 0, F.lit(True)))
    model = toxicity.train(learn, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model).where("_toxicity < 0.5").select(*docs.columns)


def drop_without_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; where no language could be learned, those with a letter."""
    model = language_id.train(docs.where(F.coalesce(fold(4) != 2, F.lit(True))))
    if not model.langs:
        return docs.where(F.coalesce(F.col("text"), F.lit("")).rlike(r"\p{L}"))
    return language_id.identify(docs, model).where("_language.lang_pred != 'und'").select(*docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents."""
    return ngram_join.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their place in a sequence."""
    return packing.pack_documents(docs, public_path(), cache_words=CACHE_WORDS)


STAGES = [
    ("toxicity", drop_toxic),
    ("language", drop_without_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("packing", pack),
]

# Models and token ids are out of reach of SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
