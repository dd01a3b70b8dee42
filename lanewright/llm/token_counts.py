"""Token counts kept in a digest cache.

A text is named by the SHA-256 of its normalised content (null becomes the empty text; nothing else may change, because the count is that of the text as it
stands) and a tokenizer by the SHA-256 of its file, so a count is stored once for each pair, whatever rows it came from.  A run brings its texts
down to one for each digest, joins these to the cache, encodes the digests that are missing, appends their counts, and joins the counts to
all rows.  No id takes part, so equal and null ids make no difference; a digest that a third of all rows share is reduced to one text on
the map side, and in the join of copies only digests travel.

Repeated rows each get their own result row.  Null ids are kept.  Empty texts have no tokens; a long text is encoded whole, in one call of the library.  An empty
table appends nothing.  Only the id column is kept, so other
columns cannot clash.  The cache is a Parquet folder that any later run may use again; an append that is
repeated after a failure only doubles equal rows, which the reader reduces.
"""

from __future__ import annotations

import hashlib
import uuid
from functools import lru_cache

import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanewright.llm.common import short_batches, text_of, with_arrow_column
from lanewright.session import materialize, shared_folder

CACHE_SCHEMA = "tokenizer string, content binary, n_tokens bigint"


@lru_cache(maxsize=4)
def processor(model_file: str) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_file=model_file)


def tokenizer_version(model_file: str) -> str:
    """Names the tokenizer by its file's content and the library's version, which both decide a count."""
    with open(model_file, "rb") as data:
        return f"{hashlib.sha256(data.read()).hexdigest()}-{sentencepiece.__version__}"


def new_cache(spark: SparkSession) -> str:
    """The path of an empty cache in the shared folder."""
    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/token-counts-{uuid.uuid4().hex}"


def read_cache(spark: SparkSession, cache: str) -> DataFrame:
    """The stored counts; a cache that nobody has written to yet is empty."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(cache)
    there = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    return spark.read.schema(CACHE_SCHEMA).parquet(cache) if there else spark.createDataFrame([], CACHE_SCHEMA)


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def count_tokens(docs: DataFrame, model_file: str, cache: str, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``id_column``, ``content`` (digest), ``n_bytes`` (UTF-8) and ``n_tokens`` of every row, no special tokens added."""
    spark = docs.sparkSession
    short_batches(spark)
    version = tokenizer_version(model_file)
    body = text_of(text)
    rows = docs.select(F.col(f"`{id_column}`").alias("_id"), body.alias("_text")).withColumn("_content", _digest(F.col("_text")))
    digests = materialize(rows.select("_id", "_content", F.octet_length("_text").cast("bigint").alias("n_bytes")), "digests")

    known = read_cache(spark, cache).filter(F.col("tokenizer") == version)
    different = rows.groupBy("_content").agg(F.first("_text").alias("_text"))
    chosen = different.join(known, different["_content"] == known["content"], "left_anti")

    def convert():
        library = processor(model_file)
        return lambda texts: [len(ids) for ids in library.encode(texts, num_threads=1)]

    counted = with_arrow_column(chosen.select("_content", "_text"), "_text", "n_tokens", T.LongType(), pa.int64(), convert)
    counted.select(F.lit(version).alias("tokenizer"), F.col("_content").alias("content"), "n_tokens").write.mode("append").parquet(cache)

    stored = read_cache(spark, cache).filter(F.col("tokenizer") == version).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))
    return digests.join(stored, digests["_content"] == stored["content"]).select(
        F.col("_id").alias(id_column), "content", "n_bytes", "n_tokens"
    )
