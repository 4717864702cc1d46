from datetime import datetime

import pytest
from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weir.functions import load, render
from weir.functions.text import fields, words
from weir.operators import means
from weir.sources import readers, sinks

WEATHER = """S1,18800101,TMAX,10,,,E
S1,18800102,TMAX,30
S1,18800102,TMIN,-5
S1,18810101,TMAX,20
S2,18800101,TMIN,4
S2,18820101,TMIN,8
S2,18810301,PRCP,7
S3,18800101,TMAX,,
S3,18800101,tmax,9
S4,18810101,TMAX,50
S4,18820101,TMIN,1"""
OF = {"mean_tmin": "TMIN", "mean_tmax": "TMAX"}


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def readings(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("weather") / "1880.csv"
    path.write_text(WEATHER)
    return readers.readings(readers.lines(spark, str(path)))


def test_mean_of_one_element(readings):
    found = means.group_mean(readers.elements(readings, "TMAX"), "station")
    assert rows(found) == [("S1", 20.0), ("S4", 50.0)]


def test_conditional_means(readings):
    found = means.conditional_means(readings, "station", of=OF)
    assert rows(found) == [("S1", -5.0, 20.0), ("S2", 6.0, None), ("S4", 1.0, 50.0)]


def test_merged_partials_equal_whole(readings):
    halves = [means.partial_means(readings.where(half), "station", of=OF) for half in ("value < 10", "value >= 10")]
    merged = means.merged_means(halves[0].unionByName(halves[1]), "station", columns=tuple(OF))
    assert rows(merged) == rows(means.conditional_means(readings, "station", of=OF))


def test_list_mean_equals_mean(readings):
    lists = means.group_values(readers.elements(readings, "TMAX"), "station")
    assert rows(lists.select("station", means.list_mean(F.col("values")))) == [("S1", 20.0), ("S4", 50.0)]


def test_series_and_its_line(readings):
    nested = means.series(means.yearly_means(readings, OF))
    assert {r.station: [tuple(x) for x in r.series] for r in nested.collect()} == {
        "S1": [("1880", -5.0, 20.0), ("1881", None, 20.0)],
        "S2": [("1880", 4.0, None), ("1882", 8.0, None)],
        "S4": [("1881", None, 50.0), ("1882", 1.0, None)],
    }
    lines = nested.select(render.series_line(F.col("station"), F.col("series")).alias("line"))
    assert sorted(r.line for r in lines.collect()) == ["S1, [(1880, -5.0, 20.0), (1881, null, 20.0)]", "S2, [(1880, 4.0, 0), (1882, 8.0, null)]", "S4, [(1881, 0, 50.0), (1882, 1.0, null)]"]


def test_zero_filled(readings):
    found = means.zero_filled(means.yearly_means(readings, OF), tuple(OF))
    assert ("S2", "1880", 4.0, 0.0) in rows(found) and ("S2", "1882", 8.0, None) in rows(found)


def test_means_line(readings):
    found = means.conditional_means(readings, "station", of=OF)
    lines = [r[0] for r in found.select(render.means_line(*map(F.col, ("station", "mean_tmin", "mean_tmax")))).collect()]
    assert "S2, 6.0, null" in lines


def test_partitions_hold_whole_stations(spark, readings):
    yearly = means.yearly_means(readings, OF)
    parts = means.partitioned_by_station(yearly, 3).withColumn("p", F.spark_partition_id())
    assert all(r.n == 1 for r in parts.groupBy("station").agg(F.countDistinct("p").alias("n")).collect())


def test_bad_number_fails_or_is_null(spark):
    lines = spark.createDataFrame([("S,18800101,TMAX,x",)], "value string")
    assert readers.readings(lines, strict=False).first().value is None
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        readers.readings(lines).collect()


def test_words(spark):
    text = spark.createDataFrame([("  a\tb\x0bc \f d  ",), ("",), (None,)], "t string")
    assert [r[0] for r in text.select(words(F.col("t"))).collect()] == [["a", "b\x0bc", "d"], [], None]
    assert rows(means.word_count(text, "t")) == [("a", 1), ("b\x0bc", 1), ("d", 1)]


@settings(max_examples=8, deadline=None, phases=[Phase.generate], suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="a,b", max_size=8), min_size=1, max_size=8))
def test_fields_drop_trailing_empty_ones(spark, lines):
    found = spark.createDataFrame([(x,) for x in lines], "v string").select(fields(F.col("v"))).collect()
    assert [r[0] for r in found] == [(x.rstrip(",")).split(",") for x in lines]


@settings(max_examples=4, deadline=None, phases=[Phase.generate], suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("ab"), st.sampled_from(["TMIN", "TMAX", "X"]), st.integers(-9, 9)), max_size=20), st.integers(1, 5))
def test_means_do_not_depend_on_partitions(spark, data, parts):
    df = spark.createDataFrame(data, "station string, element string, value int")
    whole = rows(means.conditional_means(df, "station", of=OF))
    assert rows(means.conditional_means(df.repartition(parts), "station", of=OF)) == whole


def test_partial_aggregation_and_pruned_scan(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    plan = means.conditional_means(df, "user_id", of={"a": "view", "b": "purchase"}, element="event_type")._jdf.queryExecution().toString()
    assert "partial_avg" in plan and "props" not in plan.split("Physical Plan")[1]


def test_sinks(spark, readings, tmp_path):
    found = means.group_mean(readers.elements(readings, "TMAX"), "station")
    sinks.keyed_text(found, F.col("station"), F.col("mean"), str(tmp_path / "keyed"))
    assert sorted(r.value for r in readers.lines(spark, str(tmp_path / "keyed")).collect()) == ["S1\t20.0", "S4\t50.0"]
    path = sinks.station_log(found, str(tmp_path), datetime(2020, 1, 2, 15, 4))
    assert path.endswith("2020_01_02_03_04") and sorted(r.value for r in readers.lines(spark, path).collect()) == ["S1|20.0", "S4|50.0"]
    sinks.single_text(found, F.col("station"), str(tmp_path / "single"))
    assert len(list((tmp_path / "single").glob("part-*"))) == 1
    sinks.value_text(found, F.col("station"), str(tmp_path / "bz"), "bzip2")
    assert sorted(r.value for r in readers.lines(spark, str(tmp_path / "bz" / "*.bz2")).collect()) == ["S1", "S4"]
    sinks.table(found, str(tmp_path / "t"))
    assert rows(readers.table(spark, str(tmp_path / "t"))) == rows(found)


def test_fibonacci(spark):
    assert load.fibonacci(17) == 1597
    assert spark.range(3).select(load.fib(spark, F.lit(10) + F.col("id")).alias("f")).collect()[2].f == 144


def test_word_count_of_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("x y x\ny x\n")
    stream = means.word_count(spark.readStream.text(str(tmp_path / "in")))
    query = stream.writeStream.outputMode("complete").format("memory").queryName("counted").start()
    query.processAllAvailable()
    query.stop()
    assert rows(spark.table("counted")) == [("x", 3), ("y", 2)]


def test_log_with_timing_lines(spark, tmp_path):
    from datetime import datetime

    from weir.sources import readers, sinks

    found = spark.createDataFrame([("S1", 20.0), ("S4", 50.5)], "station string, mean double")
    path = sinks.station_log(found, str(tmp_path), datetime(2020, 1, 2, 15, 4), [30, 10.5, 90])
    assert path.endswith("2020_01_02_03_04")
    assert sorted(r.value for r in readers.lines(spark, path).collect()) == ["Average Running Time:43.5 ms", "Maximum Running Time:90.0 ms", "Minimum Running Time:10.5 ms", "S1|20.0", "S4|50.5"]


def test_intermediate_tables_are_removed(spark):
    from weir import runtime

    kept = runtime.cut(spark.range(5))
    path = kept.inputFiles()[0].removeprefix("file:").rsplit("/", 1)[0]
    import os

    assert os.path.isdir(path) and runtime.work_dir(spark) in kept.inputFiles()[0].removeprefix("file:").replace("//", "/")
    runtime.remove(spark, path)
    assert not os.path.exists(path)
