import random

import pytest
from pyspark.sql import functions as F

from tagloom.llm.graph import components
from tagloom.operators.features import feature_rows, histories, known_features, score_features
from tagloom.plans import corpora
from tagloom import runtime
from tagloom.operators.train import train
from tagloom.runtime import _CLEANUP, even_keys, lookup_join, pin, shared_dir, store_bucketed


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    for name, value in settings.items():
        spark.conf.set(name, value)
    yield
    for name in settings:
        spark.conf.unset(name)


@pytest.mark.parametrize("how", ["left", "inner", "left_semi"])
def test_salted_join_of_a_hot_key(spark, no_broadcast, how):
    """One key holds a third of the rows: its rows are spread, and the result is that of a plain join."""
    cold = F.concat(F.lit("k"), F.col("id") % 50)
    left = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(cold).alias("key"))
    right = spark.createDataFrame([("hot", 1)] + [(f"k{i}", i) for i in range(0, 50, 2)], "key string, v int")
    found, plain = lookup_join(left, right, "key", ["id"], how, bound=10**9), left.join(right, "key", how)
    small = lookup_join(left, right, "key", ["id"], how, bound=26)
    assert sorted(map(str, small.collect())) == sorted(map(str, plain.collect()))
    assert sorted(map(str, found.select(*sorted(found.columns)).collect())) == sorted(
        map(str, plain.select(*sorted(plain.columns)).collect())
    )
    if how != "left_semi":
        hot = found.filter("key = 'hot'").select(F.spark_partition_id().alias("p")).distinct()
        assert hot.count() > 1


@pytest.mark.parametrize("how", ["left", "inner", "left_semi"])
def test_salted_join_is_not_broadcast(spark, how):
    """Spark's guess of a size is that of compressed files; what was counted as too large stays off the driver."""
    left = spark.range(300).select("id", (F.col("id") % 50).alias("key"))
    right = pin(spark.range(40).select(F.col("id").alias("key"), (F.col("id") + 1).alias("v")))
    assert "BroadcastHashJoin" in plan(left.join(right, "key", how))
    found = lookup_join(left, right, "key", ["id"], how, bound=10**9)
    assert sorted(map(str, found.collect())) == sorted(map(str, left.join(right, "key", how).select(*found.columns).collect()))
    assert "Broadcast" not in plan(found) and "SortMergeJoin" in plan(found)


def test_callers_may_lower_the_bound_of_a_broadcast(spark, monkeypatch):
    left, right = spark.range(30).withColumnRenamed("id", "key"), spark.range(20).withColumnRenamed("id", "key")
    kept = lambda most: "BroadcastHashJoin" in plan(lookup_join(left, right, "key", ["key"], "inner", bound=20, most=most))
    assert kept(None) and kept(20) and not kept(19)
    monkeypatch.setattr(runtime, "MAX_LOOKUP_ROWS", 19)
    assert not kept(None) and not kept(20)


@pytest.mark.parametrize("limit", [0, 100])
def test_hot_word_keeps_all_rows(spark, no_broadcast, weights, monkeypatch, limit):
    monkeypatch.setattr(runtime, "MAX_LOOKUP_ROWS", limit)
    sentences = spark.range(200).select(
        F.col("id").alias("sent_id"),
        F.array(F.lit("the"), F.concat(F.lit("w"), F.col("id")), F.lit("the")).alias("words"),
        F.array(*[F.lit("O")] * 3).alias("tags"),
    )
    features = feature_rows(histories(sentences))
    model = weights({"TAG:the:O": 2, "TAG:w7:O": 1})
    scored = score_features(features, model)
    # Per sentence: four trigrams, three words, two suffixes of each word.
    assert scored.count() == features.count() == 200 * (4 + 3 + 6)
    assert scored.agg(F.sum("weight")).first()[0] == 200 * 2 * 2 + 1
    assert known_features(features, model).count() == 401


def test_pinned_rows_have_no_lineage(spark):
    df = pin(spark.range(10).withColumn("x", F.rand()))
    assert df.collect() == df.collect() and "Range" not in plan(df)


def test_pinning_leaves_no_shuffle_files(spark):
    """Those of steps that are done would add up until the driver collects its garbage."""

    def files():
        held = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {held.apply(i).getName() for i in range(held.size()) if held.apply(i).getName().startswith("shuffle_")}

    option = spark.conf.get(_CLEANUP, None)
    before = files()
    df = spark.range(1000).groupBy((F.col("id") % 10).alias("g")).count()
    pinned = pin(df.join(df.withColumnRenamed("count", "n"), "g"))
    assert files() <= before and spark.conf.get(_CLEANUP, None) == option
    assert pinned.count() == df.count() == 10 and files() - before


def test_components_of_repeated_and_hub_edges(spark):
    rng = random.Random(3)
    pairs = [(0, i) for i in range(1, 60)] + [(k, k + 1) for k in range(100, 140)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(35)]
    pairs = [p if rng.random() < 0.5 else p[::-1] for p in pairs] * 2
    root = {x: x for p in pairs for x in p}
    for a, b in pairs:
        low, high = sorted((root[a], root[b]))
        root = {x: low if r == high else r for x, r in root.items()}
    alone = {a for a, b in pairs if a == b} - {x for a, b in pairs if a != b for x in (a, b)}
    found = [(r.node, r.root) for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()]
    assert sorted(found) == sorted((x, r) for x, r in root.items() if x not in alone)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_bucketed_table_groups_without_a_shuffle(spark):
    stored = store_bucketed(spark.range(100).withColumn("shard", F.col("id") % 7), "shard", 4)
    counts = stored.groupBy("shard").count()
    assert "Exchange" not in plan(counts) and counts.count() == 7


def test_training_leaves_no_table(spark, sentences):
    before = {t.name for t in spark.catalog.listTables()}
    found = train(sentences((["a", "b"], ["O", "B-X"]), (["b"], ["O"])), n_shards=2, epochs=1, rounds=2)
    assert found.count() > 0 and {t.name for t in spark.catalog.listTables()} == before


def test_shared_folder_is_the_session_setting(spark):
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert shared_dir(spark) and (configured is None or shared_dir(spark) == configured)


def test_scans_read_only_the_needed_columns(spark):
    text = plan(corpora.conversations(spark, "/root/testdata/sf0.001"))
    assert "ReadSchema: struct<conv_id:bigint,turn:bigint,text:string>" in text


def test_features_need_no_shuffle(spark, sentences):
    table = sentences((["a", "b"], ["O", "B-X"]))
    assert "Exchange" not in plan(feature_rows(histories(table)))


@pytest.mark.parametrize("n", [1, 4, 37])
def test_few_groups_of_much_work_do_not_share_a_task(spark, n):
    keys = even_keys(spark, n)
    placed = spark.createDataFrame([(k,) for k in keys], "key long").repartition(n, "key").select("key", F.spark_partition_id().alias("at"))
    assert len(set(keys)) == n and len({r.at for r in placed.collect()}) == n
