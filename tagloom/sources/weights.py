"""Weight files."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.functions import text


def read_weights(spark: SparkSession, path: str) -> DataFrame:
    """``feature weight`` lines as a table; the last line of a feature wins."""
    items = text.words(F.col("value"))
    said = F.concat(F.lit("a weight line without a number: "), F.col("value"))
    missing = F.when(F.get(items, F.lit(0)).isNotNull(), F.raise_error(said).cast("double"))
    lines = spark.read.text(path).select(
        F.get(items, F.lit(0)).alias("feature"),
        F.coalesce(F.get(items, F.lit(1)).cast("double"), missing).alias("weight"),
        F.struct(
            "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row")
        ).alias("place"),
    )
    last = F.max_by("weight", "place")
    return lines.filter(F.col("feature").isNotNull()).groupBy("feature").agg(last.alias("weight"))


def weights_to_text(weights: DataFrame, decimals: int = 1) -> DataFrame:
    """``feature weight`` lines; rounding loses precision, Parquet does not.

    A weight that looks half-way, such as 0.35, is rounded by its exact binary value, which the
    JVM's formats do not do.
    """

    def fixed(values: pd.Series) -> pd.Series:
        return values.map(lambda w: f"{w:.{decimals}f}", na_action="ignore").astype(object)

    number = F.pandas_udf(fixed, "string")(F.col("weight").cast("double"))
    return weights.select(F.concat_ws(" ", "feature", number).alias("line"))


def write_weights(weights: DataFrame, path: str, fmt: str = "parquet", decimals: int = 1) -> None:
    """Write a weight vector: Parquet at full precision, or rounded text lines."""
    if fmt == "parquet":
        weights.select("feature", "weight").write.parquet(path)
    elif fmt == "text":
        weights_to_text(weights, decimals).write.text(path)
    else:
        raise ValueError("fmt is 'parquet' or 'text'")
