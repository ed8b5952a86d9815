"""Model help for formulas: rules first, a model only where the rules' result is doubtful; and a table of known models."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import chemistry, math_text
from ..functions.arrow import batch_udf
from ..functions.frames import union
from .study import Generator

#: Below these the rules' result counts as doubtful.
CHEMISTRY_DOUBT, MATH_DOUBT = 0.72, 0.7


def _assisted(df: DataFrame, rules: Callable[[str], str], sure: Callable[[str, str], float], doubt: float, extract: Callable[[str], str | None], prompt: str, generator: Callable[[], Generator] | None, skip: Callable[[str], bool]) -> DataFrame:
    @batch_udf("struct<normalized: string, confidence: double>")
    def by_rules(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(None, None) if x is None else (y := rules(x), sure(x, y)) for x in batch]
            yield pd.DataFrame(rows, columns=["normalized", "confidence"])

    ruled = df.withColumn("__r", by_rules("text")).select(*df.columns, "__r.normalized", "__r.confidence", F.lit(False).alias("assisted"))
    if generator is None:
        return ruled

    @batch_udf("string")
    def by_model(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = generator()
        for batch in batches:
            asked = [i for i, x in enumerate(batch) if not skip(x)]
            out: list[str | None] = [None] * len(batch)
            for i, said in zip(asked, model.complete([prompt.format(batch.iloc[i]) for i in asked], 0.1, 128) if asked else []):
                out[i] = extract(said)
            yield pd.Series(out, dtype=object)

    # The doubtful rows alone go to the model: a condition around a UDF wouldn't keep the others from it.
    doubtful = F.coalesce(F.col("confidence") < doubt, F.lit(False))
    helped = ruled.filter(doubtful).withColumn("__m", by_model("text"))
    helped = helped.select(*df.columns, F.coalesce("__m", "normalized").alias("normalized"), "confidence", F.col("__m").isNotNull().alias("assisted"))
    return union(ruled.filter(~doubtful), helped)


def chemistry_with_model(df: DataFrame, generator: Callable[[], Generator] | None = None) -> DataFrame:
    """df (text) with normalized, confidence and assisted. Prose is never given to the model."""
    return _assisted(df, chemistry.plain_to_mhchem, chemistry.confidence, CHEMISTRY_DOUBT, chemistry.extract_ce, "Write this as one \\ce{{...}} formula, nothing else: {}", generator, chemistry.is_mostly_prose)


def math_with_model(df: DataFrame, generator: Callable[[], Generator] | None = None) -> DataFrame:
    """df (text) with normalized, confidence and assisted."""
    return _assisted(df, math_text.plain_to_latex, math_text.confidence, MATH_DOUBT, math_text.extract_latex, "Write this as LaTeX between dollars, nothing else: {}", generator, lambda x: False)


def model_catalog(spark: SparkSession, models: list[dict]) -> DataFrame:
    """id, name, kind (chat or embedding), url, size_mb and dimensions of the models that a deployment offers."""
    names = ("id", "name", "kind", "url", "size_mb", "dimensions")
    return spark.createDataFrame([tuple(m.get(n) for n in names) for m in models], "id string, name string, kind string, url string, size_mb double, dimensions int")


def chat_capable(kind: Column) -> Column:
    return kind == "chat"
