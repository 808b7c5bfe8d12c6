"""Written tables, global orders without a global task, joins that spread hot keys."""

import os
import random
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from gridlark import storage
from gridlark.functions import streams
from gridlark.sources import recorded


class Session:
    """What of a session says where its shared folder is."""

    def __init__(self, spark, folder, master="local[4]"):
        self._jvm, self._jsc = spark._jvm, spark._jsc
        self.conf = SimpleNamespace(get=lambda name, default: folder or default)
        self.sparkContext = SimpleNamespace(master=master, applicationId=f"app-{master}")


def test_the_shared_folder_is_the_session_s(spark):
    assert storage.shared_dir(Session(spark, "/tmp/some/")) == "file:///tmp/some"
    assert storage.shared_dir(Session(spark, "viewfs://cluster/x/", "yarn")) == "viewfs://cluster/x"
    own = Session(spark, None)
    assert storage.shared_dir(own) == storage.shared_dir(own) and storage.shared_dir(own).startswith("file:///")


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "local-cluster[2,1,1024]"])
def test_a_cluster_without_a_shared_folder_is_refused(spark, master):
    with pytest.raises(RuntimeError):
        storage.shared_dir(Session(spark, None, master))


def test_written_tables_come_back_and_go(spark):
    df = storage.written(spark.range(10), "t")
    assert df.count() == 10
    files = df.inputFiles()
    storage.drop_written(df)
    assert files and not any(os.path.exists(f.removeprefix("file://")) for f in files)


@pytest.mark.parametrize("rows_each", [10, 1_000_000])
def test_ordinals_follow_a_total_order(spark, monkeypatch, rows_each):
    monkeypatch.setattr(storage, "RANGE_ROWS", rows_each)
    rng = random.Random(1)
    rows = [(rng.choice([None, 1, 1, 2, 3]), k) for k in rng.sample(range(500), 200)]
    got = storage.ordinal(spark.createDataFrame(rows, "a long, b long").repartition(3), "a", "b", to="n").collect()
    wanted = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert [(r.a, r.b) for r in sorted(got, key=lambda r: r.n)] == wanted and sorted(r.n for r in got) == list(range(200))
    assert storage.ordinal(spark.createDataFrame([], "a long, b long"), "a", to="n").count() == 0


@pytest.mark.parametrize("rows_each", [20, 1_000_000])
def test_gaps_and_slots_of_hot_groups(spark, monkeypatch, rows_each):
    monkeypatch.setattr(storage, "RANGE_ROWS", rows_each)
    rng = random.Random(2)
    rows = [(rng.choice([1, 1, 1, 2, None]), k, rng.randrange(1 << 32)) for k in range(300)]
    got = {r.sender: (r.packets, r.lost) for r in streams.seq_gaps(spark.createDataFrame(rows, "sender long, arrival long, seq long").repartition(3)).collect()}
    wanted, kept = {}, {}
    for sender, k, seq in rows:
        n, lost, last = wanted.get(sender, (0, 0, None))
        wanted[sender] = n + 1, (lost + (0 if last is None else (seq - last - 1) % streams.WRAP)) % streams.WRAP, seq
    assert got == {s: (n, lost) for s, (n, lost, _) in wanted.items()}
    points = spark.createDataFrame([(s, k, q % 3 == 0) for s, k, q in rows if s], "frame_id long, k long, good boolean").repartition(3)
    slots = {}
    for s, k, q in rows:
        if s:
            slots[k] = kept.get(s, 0)
            kept[s] = kept.get(s, 0) + (q % 3 == 0)
    assert {r.k: r.slot for r in streams.finite_before(points, F.col("good"), "k").collect()} == slots


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("least", [0, 40, 10_000])
def test_spread_joins_are_joins(spark, how, least):
    rng = random.Random(3)
    many = [(rng.choice([None, 1, 1, 2, 3, 4, 9]), rng.choice(["a", "b"]), k) for k in range(300)]
    one = [(i, s, (i or 5) * 10) for i in (1, 2, 3, 7, None) for s in "ab"] + [(1, "a", 11)]
    m, o = spark.createDataFrame(many, "i long, s string, k long"), spark.createDataFrame(one, "i long, s string, v long")
    hot = m.groupBy("i", "s").agg(F.count("*").alias("n")).where(F.col("n") > least)
    got = storage.spread_join(m, o, ["i", "s"], hot, how)
    assert sorted(map(str, got.select("i", "s", "k", "v").collect())) == sorted(map(str, m.join(o, ["i", "s"], how).select("i", "s", "k", "v").collect()))


def test_event_times_keep_every_microsecond(spark):
    stamps = [1705232584597200000, 1705232584597200999, 1706142270696784001, 0, -1, -1000, -1001]
    got = recorded.event_time(spark.createDataFrame([(t,) for t in stamps], "timestamp_ns long")).select("timestamp_ns", F.unix_micros("ts").alias("us")).collect()
    assert {r.timestamp_ns: r.us for r in got} == {t: t // 1000 for t in stamps}


def test_only_what_was_written_here_is_dropped(spark, tmp_path):
    source = str(tmp_path / "docs.parquet")
    spark.range(5).write.parquet(source)
    docs, made = spark.read.parquet(source), storage.written(spark.range(3), "t")
    for df in (docs, docs.join(made, "id"), docs.union(made)):
        with pytest.raises(ValueError):
            storage.drop_written(df)
    assert docs.count() == 5 and made.count() == 3
    storage.drop_written(made)
    storage.drop_written(made.limit(0).where("false"))  # reads nothing that is left


def test_a_scratch_folder_goes_with_all_in_it(spark):
    kept = storage.new_path(spark, "kept")
    with storage.scratch(spark) as outer:
        inner = storage.written(spark.range(4), "t")
        with storage.scratch(spark) as folder:
            assert folder.startswith(outer) and storage.written(spark.range(4), "t").count() == 4
        assert not os.path.exists(folder.removeprefix("file://")) and inner.count() == 4
        result = storage.written(inner.where("id > 1"), "kept", kept)
    assert not os.path.exists(outer.removeprefix("file://")) and result.count() == 2
    storage.drop_written(result)


def test_paths_are_known_in_any_spelling(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(storage, "shared_dir", lambda spark: f"file://{tmp_path}//odd name")
    df = storage.written(spark.range(3), "t")
    assert df.count() == 3
    storage.drop_written(df)
    assert not list((tmp_path / "odd name").iterdir())


def test_a_table_s_sums_come_from_the_pass_that_writes_it(spark):
    table, seen = storage.observed(spark.range(10).repartition(3), "t", rows=F.count("*"), most=F.max("id"), even=F.expr("count_if(id % 2 = 0)"))
    assert seen == {"rows": 10, "most": 9, "even": 5} and table.count() == 10
    grouped = spark.range(10).groupBy((F.col("id") % 3).alias("k")).agg(F.count("*").alias("n"))
    assert storage.observed(grouped, "t", total=F.sum("n"))[1] == {"total": 10}
    for none in (grouped.where("n > 99"), spark.range(0), spark.range(5).where("id > 9").groupBy("id").agg(F.count("*").alias("n")).join(grouped, "n")):
        assert storage.observed(none, "t", rows=F.count("*"), most=F.max(F.lit(3)))[1] == {"rows": 0, "most": 0}


@pytest.mark.parametrize("how", ["inner", "left"])
def test_keys_known_not_to_be_hot_are_joined_as_others(spark, how):
    many = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d"), (5, "e")], "k int, v string")
    one = spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "k int, w int")
    hot = one.where("k = 1")
    wanted = sorted(map(tuple, many.join(one, ["k"], how).select("v", "w").collect()))
    for keys in (None, hot, hot.limit(0)):
        assert sorted(map(tuple, storage.spread_join(many, one, ["k"], keys, how).select("v", "w").collect())) == wanted
