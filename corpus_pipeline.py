"""From raw documents to packed training sequences, one stored table per stage.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written as Parquet and
read again as the next stage's `docs`; all but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import stored, table
from barloom.llm.mixing import mixed_documents
from barloom.llm.near_copies import one_of_each_class
from barloom.llm.packing import pack_documents
from barloom.llm.quality import keep_good
from barloom.llm.surrogates import replace_private_data

#: The session setting that holds the key of the surrogates, and what stands in for it in tests.
KEY_SETTING = "spark.barloom.surrogateKey"
TEST_KEY = "pipeline"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return keep_good(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of copies and near copies stays."""
    return one_of_each_class(docs)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Private data in the texts is replaced by surrogates."""
    key = spark.conf.get(KEY_SETTING, TEST_KEY)
    out = replace_private_data(docs, key, count="_n")
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents appear as often as the mix of sources takes them."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    return pack_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", near_copies),
    ("surrogates", private_data),
    ("source_mix", source_mix),
    ("packing", packing),
]

#: Packing (a heuristic on lengths), tokens and surrogates aren't expressible in SQL; the
#: tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
