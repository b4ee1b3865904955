"""Folds by user functions, and the SQL functions."""

import random

import pytest
from pyspark.sql import functions as F

from tagloom.functions import tags as tg
from tagloom.functions.sql import register
from tagloom.operators import combine
from tagloom.operators.combine import combine_by_key
from tagloom.operators.features import parse_feature
from tagloom.sources.tables import literal_pairs

MEAN = (lambda v: (v, 1), lambda c, v: (c[0] + v, c[1] + 1), lambda a, b: (a[0] + b[0], a[1] + b[1]))


def test_mean_of_pairs(spark):
    pairs = literal_pairs(spark, [("a", 1), ("b", 2), ("a", 3), ("b", 1), ("c", 2), ("d", 4), ("c", 8)]).repartition(3)
    found = combine_by_key(pairs, "k", "v", *MEAN, "struct<total: bigint, n: bigint>")
    assert found.columns == ["k", "combined"]
    assert {r.k: r.combined[0] / r.combined[1] for r in found.collect()} == {"a": 2, "b": 1.5, "c": 5, "d": 4}


@pytest.mark.parametrize("keys", [100_000, 3])
def test_hot_and_null_keys_in_small_batches(spark, monkeypatch, keys):
    """A key with most of the rows, null keys and values, tasks that hand on their keys early."""
    monkeypatch.setattr(combine, "MAX_KEYS", keys)
    rng = random.Random(1)
    rows = [(rng.choice([None, 1, 1, 1, 1, *range(9)]), rng.choice([None, *range(50)])) for _ in range(3000)]
    table = spark.createDataFrame([(k, v, "x") for k, v in rows], "k int, v int, combined string").repartition(7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        found = combine_by_key(
            table, "k", "v", lambda v: {v}, lambda c, v: {*c, v}, lambda a, b: {*a, *b}, "array<int>"
        ).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(found) == len({k for k, _ in rows})
    assert {r.k: set(r.combined) for r in found} == {k: {v for j, v in rows if j == k} for k, _ in rows}


def test_nothing_to_combine(spark):
    empty = literal_pairs(spark, [("a", 1)]).limit(0)
    assert combine_by_key(empty, "k", "v", *MEAN, "struct<total: bigint, n: bigint>").count() == 0


def test_partials_are_merged_before_the_shuffle(spark):
    table = spark.range(0, 20_000, 1, 4).select((F.col("id") % 2).alias("k"), F.col("id").alias("v"))
    plan = combine_by_key(table, "k", "v", *MEAN, "struct<total: bigint, n: bigint>")._jdf.queryExecution().toString()
    assert plan.count("MapInArrow") >= 2 and plan.count("Exchange hashpartitioning") <= 2


# SQL functions


def test_chunk_functions_equal_columns(spark):
    register(spark)
    tags = ["O", "B-A", "I-A", "E-A", "B-B", "I-B", "[-A", "]", ".", ".-A", "I", "I-0", "X-a-b", ""]
    pairs = spark.createDataFrame([(a, b) for a in tags for b in tags], "before string, tag string")
    around = [tg.prefix(F.col("before")), tg.prefix(F.col("tag")), tg.chunk_type(F.col("before")), tg.chunk_type(F.col("tag"))]
    both = pairs.select(
        (F.expr("chunk_starts(before, tag)") == tg.opens(*around)).alias("starts"),
        (F.expr("chunk_ended(before, tag)") == tg.closes(*around)).alias("ended"),
        (F.expr("tag_prefix(tag)") == tg.prefix(F.col("tag"))).alias("prefix"),
        (F.expr("tag_type(tag)") == tg.chunk_type(F.col("tag"))).alias("type"),
    )
    assert {tuple(r) for r in both.collect()} == {(True,) * 4}
    edges = spark.sql("SELECT chunk_starts(NULL, 'B-A'), chunk_ended('I-A', NULL), chunk_starts(NULL, 'O')").first()
    assert tuple(edges) == (True, True, False)


def test_feature_functions_equal_columns(spark, weights):
    register(spark)
    model = weights(dict.fromkeys(["TAG:::O", "TAG:a:b:B-X", "SUFF:::1:O", "SUFF::b:2:B-X", "TRIGRAM:*:*:O", "TAG:x\ny:O"], 0))
    model.createOrReplaceTempView("features")
    found = spark.sql(
        "SELECT feature, feature_family(feature), feature_context(feature), feature_length(feature), feature_tag(feature) FROM features"
    )
    assert {tuple(r) for r in found.collect()} == {tuple(r) for r in parse_feature(model).collect()}


def test_text_functions(spark):
    register(spark)
    row = spark.sql("SELECT strip_line('\t a  b \r\n'), line_words(' a \t b\n'), word_suffix('abc', 2), word_suffix('a', 2)").first()
    assert tuple(row) == ("a  b", ["a", "b"], "bc", None)


def test_functions_run_without_python(spark):
    register(spark)
    plan = spark.sql("SELECT chunk_starts(s, s), feature_context(s) FROM (SELECT string(id) AS s FROM range(9))")
    assert "Python" not in plan._jdf.queryExecution().toString()
