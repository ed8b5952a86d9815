"""Rows to rows in Arrow batches: a Python step that Spark neither moves nor evaluates twice."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows of an Arrow batch that goes to Python: texts may be long, so a batch of the default 10,000 rows may be large.
BATCH_ROWS, BATCH_BYTES = 512, 16 << 20


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> None:
    """Bound what a Python worker holds at once, in rows and in bytes (one row may be longer).

    Spark reads both settings when a plan runs, so they can't be restored before that: they stay lowered for the session,
    and are never raised.
    """
    for key, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        key = f"spark.sql.execution.arrow.{key}"
        now = int(re.sub(r"\D", "", spark.conf.get(key)) or 0)
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))


def batch_udf(kind: str) -> Callable[[Callable], Callable]:
    """F.pandas_udf over batches that small_batches has bounded."""
    if spark := SparkSession.getActiveSession():
        small_batches(spark)
    return F.pandas_udf(kind)


def explode_rows(df: DataFrame, inputs: list[str], function: Callable[..., Iterable[tuple]], schema: str) -> DataFrame:
    """df's other columns with those of schema: a row for each tuple that function gives for a row's inputs. Row-local."""
    small_batches(df.sparkSession)
    kept = [c for c in df.columns if c not in inputs]
    added = StructType.fromDDL(schema)
    out = StructType([*(df.schema[c] for c in kept), *added.fields])
    ours = to_arrow_schema(added)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at: list[int] = []
            rows: list[tuple] = []
            for i, values in enumerate(zip(*(batch.column(len(kept) + k).to_pylist() for k in range(len(inputs))))):
                for made in function(*values):
                    at.append(i)
                    rows.append(made)
            if rows:
                others = [batch.column(k).take(pa.array(at, pa.int64())) for k in range(len(kept))]
                yield pa.RecordBatch.from_arrays([*others, *(pa.array(c, f.type) for c, f in zip(zip(*rows), ours))], names=out.names)

    return df.select(*kept, *inputs).mapInArrow(step, out)
