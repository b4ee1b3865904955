"""Aggregation per key by user functions, in two phases over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from tagloom.runtime import ship

# Keys a task combines before it hands them on.
MAX_KEYS = 100_000


def _tuples(column: pa.Array) -> list[Any]:
    """Combiners as the user functions know them: a struct is a tuple."""
    values = column.to_pylist()
    return [tuple(v.values()) if isinstance(v, dict) else v for v in values]


def _batch(pairs: dict, schema: pa.Schema) -> pa.RecordBatch:
    columns = [pa.array(list(c), f.type) for c, f in zip((pairs.keys(), pairs.values()), schema, strict=True)]
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def combine_by_key(
    df: DataFrame,
    key: str,
    value: str,
    create: Callable[[Any], Any],
    merge_value: Callable[[Any, Any], Any],
    merge_combiners: Callable[[Any, Any], Any],
    combiner: str,
) -> DataFrame:
    """``key, combined``: the values of every key folded by three user functions.

    ``create`` makes a combiner of a key's first value, ``merge_value`` adds a value to a combiner and
    ``merge_combiners`` joins two; the order of the values must not matter. ``combiner`` is the Spark
    type of a combiner, for instance ``struct<total: double, n: bigint>`` for the tuple ``(total, n)``.

    The first phase folds the values inside each task, so a hot key is one row per task (and per ``MAX_KEYS`` keys);
    these rows are shuffled by key and sorted, and the second phase holds one combiner at a time.
    """
    ship(df.sparkSession)
    rows = df.select(F.col(key).alias("key"), F.col(value).alias("value"))
    shape = StructType([rows.schema["key"], StructField("combined", _parse_datatype_string(combiner))])
    schema = to_arrow_schema(shape)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[Any, Any] = {}
        for batch in batches:
            for k, v in zip(batch.column("key").to_pylist(), batch.column("value").to_pylist(), strict=True):
                found[k] = merge_value(found[k], v) if k in found else create(v)
            if len(found) > MAX_KEYS:
                yield _batch(found, schema)
                found = {}
        yield _batch(found, schema)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[Any, Any] = {}
        for batch in batches:
            done: dict[Any, Any] = {}
            for k, c in zip(batch.column("key").to_pylist(), _tuples(batch.column("combined")), strict=True):
                if k in held:
                    held[k] = merge_combiners(held[k], c)
                else:
                    done.update(held)
                    held = {k: c}
            yield _batch(done, schema)
        yield _batch(held, schema)

    partial = rows.mapInArrow(fold, shape)
    return partial.repartition("key").sortWithinPartitions("key").mapInArrow(merge, shape).withColumnRenamed("key", key)
