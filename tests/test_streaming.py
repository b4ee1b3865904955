import pytest
from paths import TESTDATA

from tagloom.operators import decode as decoding
from tagloom.operators.decode import decode
from tagloom.operators.evaluate import COUNTS, chunk_counts
from tagloom.plans import corpora
from tagloom.plans.queries import REGISTRY
from tagloom.runtime import pin
from tagloom.sources.tables import tokenize
from tagloom.streaming import run_counts, run_to_files, stream_counts, stream_decode, stream_table


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("stream") / "conversations")
    spark.read.parquet(f"{TESTDATA}/conversations.parquet").repartition(4).write.parquet(path)
    return path


def stream(spark, files):
    return tokenize(stream_table(spark, files, files_per_batch=1), ["conv_id", "turn"], "text")


def test_counts_over_several_batches(spark, files):
    found = run_counts(stream_counts(corpora.label(stream(spark, files)))).select("type", *COUNTS)
    assert set(map(tuple, found.collect())) == set(map(tuple, chunk_counts(corpora.labelled(spark, TESTDATA)).collect()))


def test_decoding_over_several_batches(spark, files):
    batch = corpora.conversations(spark, TESTDATA)
    model = pin(corpora.model(corpora.labelled(spark, TESTDATA)))
    found = run_to_files(stream_decode(stream(spark, files), model))
    expected = decode(batch, model).select("sent_id", "tags").collect()
    assert sorted(found.select("sent_id", "tags").collect()) == sorted(expected)


def test_model_too_large_for_a_stream(spark, files, weights):
    model = weights({"TRIGRAM:*:*:O": 1, "TAG:a:O": 1})
    with pytest.raises(ValueError, match="foreachBatch"):
        decode(stream(spark, files), model, max_broadcast=0)


@pytest.mark.parametrize("name", ["stream_decode", "stream_lines_decode"])
def test_stream_queries_take_models_of_any_size(spark, tmp_path, monkeypatch, name):
    """The corpus model grows with the table, so the streams must not depend on its broadcast."""
    rows = [(c, t, "user", f"the Cat {c} saw Rome\n\nand Dog{t}") for c in range(3) for t in range(2)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    expected = sorted(REGISTRY[name](spark, str(tmp_path)).collect())
    monkeypatch.setattr(decoding, "MAX_BROADCAST_CELLS", 0)
    assert sorted(REGISTRY[name](spark, str(tmp_path)).collect()) == expected and len(expected) == 42
