"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanewright.session import materialize

#: Rows in one Arrow batch.  Documents can be long, so batches are kept short.
BATCH_ROWS = 256
ROW = "_row"


def short_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound what a Python worker holds at once; the setting is read when a plan is built."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def text_of(name: str) -> Column:
    """The text column with null as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, every other character left alone."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def keyed(df: DataFrame, keys: list[str], **columns: Column) -> tuple[DataFrame, dict[str, str]]:
    """Only the keys (renamed so that they cannot clash) and the given columns; the names to turn back."""
    safe = {f"_k{i}": key for i, key in enumerate(keys)}
    picked = df.select(*[F.col(f"`{key}`").alias(name) for name, key in safe.items()], *[c.alias(n) for n, c in columns.items()])
    return picked, safe


def numbered(df: DataFrame, columns: list[str]) -> DataFrame:
    """``_place``, a number of the row, and ``_doc``, a struct of the columns; written once, so that the numbers stay the same."""
    picked = F.struct(*[F.col(f"`{c}`") for c in dict.fromkeys(columns)]).alias("_doc")
    return materialize(df.select(picked).withColumn("_place", F.monotonically_increasing_id()), "numbered")


def with_arrow_column(
    df: DataFrame, source: str, name: str, kind: T.DataType, arrow: pa.DataType, convert: Callable[[], Callable[[list], list]]
) -> DataFrame:
    """Replace column ``source`` by ``name``, made batch by batch in Python.

    ``convert()`` is called once a task and returns a function from a list of values to a list (or Arrow array) of results.
    """
    kept = [c for c in df.columns if c != source]
    schema = T.StructType([*[df.schema[c] for c in kept], T.StructField(name, kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = convert()
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            made = work(batch.column(batch.schema.get_field_index(source)).to_pylist())
            made = made if isinstance(made, pa.Array) else pa.array(made, type=arrow)
            yield pa.RecordBatch.from_arrays([*columns, made], names=[*kept, name])

    return df.select(*kept, source).mapInArrow(run, schema)
