"""Statistics merged from batches, published models, and streams that use what is current."""

import math

import pytest

from priceloom.operators.summary import training_stats
from priceloom.operators.training import fit_model, score
from priceloom.sources.models import load_published, publish_model
from priceloom.sources.stats import add_batch, merged_stats
from priceloom.sources.versions import current_version, publish
from priceloom.streaming.scoring import read_requests, score_published, stats_stream

SCHEMA = "x double, y double"


def table(df):
    return {row.feature: (row["mean"], row["std"]) for row in df.collect()}


def close(found, expected):
    assert found.keys() == expected.keys()
    for f, pair in expected.items():
        for a, b in zip(found[f], pair):
            assert (a is None) == (b is None) and (a is None or math.isclose(a, b, rel_tol=1e-9)), (f, found, expected)


def test_batches_merge_to_the_whole_and_a_replay_changes_nothing(spark, tmp_path):
    rows = [(1e9 + i % 7, float(i * i % 11) if i % 5 else None) for i in range(60)]
    path = str(tmp_path / "state")
    for name, part in (("a/b", rows[:10]), ("2", rows[10:]), ("none", []), ("a/b", rows[:10])):
        add_batch(spark.createDataFrame(part, SCHEMA), ["x", "y"], path, name)
    close(table(merged_stats(spark, path)), table(training_stats(spark.createDataFrame(rows, SCHEMA), ["x", "y"])))


def test_few_values(spark, tmp_path):
    path = str(tmp_path / "state")
    add_batch(spark.createDataFrame([(2.0, None)], SCHEMA), ["x", "y"], path, 0)
    assert table(merged_stats(spark, path)) == {"x": (2.0, None), "y": (None, None)}
    with pytest.raises(ValueError):
        add_batch(spark.createDataFrame([], SCHEMA), ["x"], path, "")


def test_a_failed_publication_leaves_the_old_version(spark, tmp_path):
    folder = str(tmp_path)
    with pytest.raises(FileNotFoundError):
        current_version(spark, folder, "table")
    old = publish(spark, folder, "table", lambda path: spark.range(3).write.parquet(path))

    def half(path):
        spark.range(5).write.parquet(path)
        raise RuntimeError("lost before it was published")

    with pytest.raises(RuntimeError):
        publish(spark, folder, "table", half)
    version, path = current_version(spark, folder, "table")
    assert version == old and spark.read.parquet(path).count() == 3
    new = publish(spark, folder, "table", lambda path: spark.range(7).write.parquet(path))
    version, path = current_version(spark, folder, "table")
    assert version == new != old and spark.read.parquet(path).count() == 7


def line(spark, slope):
    return fit_model(spark.createDataFrame([(float(i), slope * i) for i in range(20)], SCHEMA), "Linear Regression", ["x"], "y")


def test_the_last_model_is_loaded(spark, tmp_path):
    folder = str(tmp_path)
    publish_model(spark, line(spark, 1.0), folder, "m")
    version = publish_model(spark, line(spark, 3.0), folder, "m")
    model, found = load_published(spark, folder, "m")
    assert found == version
    assert score(model, spark.createDataFrame([(2.0,)], "x double")).first().prediction == pytest.approx(6.0)


def test_streams_use_what_is_current_and_replay_without_new_rows(spark, tmp_path):
    models, state, inbox, out = (str(tmp_path / n) for n in ("models", "state", "in", "out"))

    def arrive(first, count):
        spark.createDataFrame([(i, float(i)) for i in range(first, first + count)], "id long, x double").coalesce(1) \
            .write.mode("append").parquet(inbox)

    def run(checkpoint):
        stream = read_requests(spark, inbox, spark.read.parquet(inbox).schema)
        stats_stream(stream, ["x"], state, str(tmp_path / f"{checkpoint}-stats"), available_now=True).awaitTermination()
        score_published(stream, models, "m", state, out, str(tmp_path / checkpoint), ["x"],
                        available_now=True).awaitTermination()
        return {r.inputs.x: (r.predicted_discount_percentage, r.model_version) for r in spark.read.parquet(out).collect()}

    old = publish_model(spark, line(spark, 1.0), models, "m")
    arrive(0, 4)
    assert run("c") == {float(i): (float(i), old) for i in range(4)}
    new = publish_model(spark, line(spark, 2.0), models, "m")
    arrive(4, 3)
    rows = run("c")
    assert rows == {float(i): (float(i), old) if i < 4 else (2.0 * i, new) for i in range(7)}
    close(table(merged_stats(spark, state)), {"x": (3.0, math.sqrt(28 / 6))})
    add_batch(spark.read.parquet(inbox).where("id < 4"), ["x"], state, 0)  # the first batch once more
    close(table(merged_stats(spark, state)), {"x": (3.0, math.sqrt(28 / 6))})
    assert run("c") == rows and spark.read.parquet(out).count() == 7
