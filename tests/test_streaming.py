"""Streams give what batches give; sinks, sources and the runner."""

import math
import socket
import struct
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlark import runner, storage
from gridlark.config import DiskConfig, PipelineConfig, SourceConfig
from gridlark.functions import packets, streams
from gridlark.plans import pipeline
from gridlark.sinks import committed, files
from gridlark.sources import recorded, synthetic
from gridlark.streaming import live

SF = "/root/testdata/sf0.001"
C = PipelineConfig()


@pytest.fixture(scope="module")
def recording(spark, tmp_path_factory):
    """Three frames, one points file each: two of the derived cloud, and one without points that count."""
    path = tmp_path_factory.mktemp("recording")
    points = synthetic.points(spark, SF)
    for k in range(2):
        points.where(F.col("frame_id") == k).coalesce(1).write.mode("append").parquet(str(path / "points"))
        time.sleep(1.1)  # a stream takes files in order of their time, which file systems may round
    spark.createDataFrame([(2, 1, 0.5, 0.0, 0.0, 0.0)], recorded.POINTS).coalesce(1).write.mode("append").parquet(str(path / "points"))
    frames = synthetic.frames(spark, SF).select("frame_id", "timestamp_ns", "pose")
    last = frames.agg(F.max("timestamp_ns")).first()[0]
    frames = frames.unionByName(spark.createDataFrame([(2, last + 1, (0.0, 0.0, 0.0, 1.0))], recorded.FRAMES))
    frames.write.parquet(str(path / "frames"))
    return path


def batch(spark, path, ids=(0, 1, 2)):
    frames = spark.read.parquet(str(path / "frames")).where(F.col("frame_id").isin(*ids))
    return {r.frame_id: r for r in pipeline.results(recorded.read_points(spark, str(path / "points")), frames, C).collect()}


def same(a, b):
    return a.height_map == b.height_map and np.array_equal(a.trav_grid, b.trav_grid, equal_nan=True)


def test_stream_of_frames_equals_the_batch(spark, recording, tmp_path):
    frames = spark.read.parquet(str(recording / "frames")).cache()
    wanted = batch(spark, recording)
    assert any(not math.isnan(x) for x in wanted[0].trav_grid)
    got, seen = [], []
    stream = recorded.stream_points(spark, str(recording / "points"))
    live.grid_stream(stream, frames, C, lambda r, b: got.extend((b, x) for x in r.collect()), str(tmp_path / "a"), conflate=False, on_batch=lambda n, d: seen.append((n, d))).awaitTermination(120)
    assert [b for b, _ in got] == [0, 1, 2] and all(same(r, wanted[r.frame_id]) for _, r in got) and seen == [(1, 0)] * 3
    got.clear(), seen.clear()
    whole = recorded.stream_points(spark, str(recording / "points"), files_per_trigger=10)
    live.grid_stream(whole, frames, C, lambda r, b: got.extend(r.collect()), str(tmp_path / "b"), on_batch=lambda n, d: seen.append((n, d))).awaitTermination(120)
    assert [r.frame_id for r in got] == [2] and seen == [(3, 2)]


def test_a_paced_replay_goes_on_until_it_is_stopped(spark, recording, tmp_path):
    got = []
    frames = spark.read.parquet(str(recording / "frames"))
    query = live.grid_stream(recorded.stream_points(spark, str(recording / "points")), frames, C, lambda r, b: got.append(b), str(tmp_path / "c"), interval="100 milliseconds")
    deadline = time.time() + 120
    while len(got) < 3 and time.time() < deadline:
        time.sleep(0.2)
    assert query.isActive and got == [0, 1, 2]
    query.stop()
    assert not query.isActive


@pytest.mark.parametrize("images", [False, True])
def test_the_runner_writes_files_and_takes_up_its_count(spark, recording, tmp_path, images):
    c = PipelineConfig(zed=SourceConfig(svo_path=str(recording)), consumer="Disk", disk_writer=DiskConfig(str(tmp_path / "out"), images))
    m = runner.run(spark, c)
    kind = "png" if images else "csv"
    names = [f"frame_{k:06d}.{kind}" for k in range(3)]
    assert (m.frames_captured, m.frames_processed) == (3, 3) and m.elapsed_s > 0 and "3" in m.report()
    counted = pipeline.stage_counts(recorded.read_points(spark, str(recording / "points")), spark.read.parquet(str(recording / "frames")), C).agg(*[F.sum(x) for x in ("finite_count", "voxel_count", "polar_count")]).first()
    assert m.stages == {"points": spark.read.parquet(str(recording / "points")).count()} | dict(zip(("finite points", "voxels", "polar points"), counted, strict=True))
    assert "polar points" in m.report()
    whole = {n: (tmp_path / "out" / n).read_bytes() for n in names}
    wanted = batch(spark, recording)
    for k, n in enumerate(names):
        codes = np.array(wanted[k].trav_grid, np.float32)
        assert whole[n] == (files.png if images else files.csv_text)(17, 19, codes)
    if not images:  # the same frames as a stream, of which the second half comes after a restart
        again = PipelineConfig(zed=c.zed, consumer="disk", disk_writer=DiskConfig(str(tmp_path / "again"), False))
        part = tmp_path / "part"
        (part / "points").mkdir(parents=True)
        (part / "frames").symlink_to(recording / "frames")
        parquet = sorted((recording / "points").glob("*.parquet"), key=lambda p: p.stat().st_mtime)
        again = PipelineConfig(zed=SourceConfig(svo_path=str(part)), consumer="disk", disk_writer=DiskConfig(str(tmp_path / "again"), False))
        seen = []
        for some in (parquet[:1], parquet[1:]):
            for p in some:
                (part / "points" / p.name).write_bytes(p.read_bytes())
                time.sleep(1.1)
            seen.append(runner.replay(spark, again, f"file://{tmp_path}/checkpoint").frames_processed)
        assert seen == [1, 2]
        assert {p.name: p.read_bytes() for p in (tmp_path / "again").glob("*.csv")} == whole


def test_the_runner_skips_and_refuses(spark, recording, tmp_path):
    c = PipelineConfig(zed=SourceConfig(svo_path=str(recording), frame_skip=1), consumer="null")
    one = runner.run(spark, c)
    assert one.frames_processed == 1 and one.stages["points"] < spark.read.parquet(str(recording / "points")).count()
    assert runner.replay(spark, c).frames_captured == 1
    for bad in (SourceConfig(svo_path=str(recording), depth_mode="SHARP"), SourceConfig(svo_path=str(recording), coordinate_units="MILE"), SourceConfig(svo_path=str(recording), resolution="8K"), SourceConfig()):
        with pytest.raises(ValueError):
            runner.run(spark, PipelineConfig(zed=bad, consumer="null"))


@pytest.mark.parametrize("consumer", ["null", "disk", "network"])
def test_stages_of_recordings_without_points(spark, recording, tmp_path, consumer):
    recorded.write_recording(spark.createDataFrame([], recorded.POINTS), spark.read.parquet(str(recording / "frames")).where("frame_id < 2"), str(tmp_path / "r"))
    m = runner.run(spark, PipelineConfig(zed=SourceConfig(svo_path=str(tmp_path / "r")), consumer=consumer, disk_writer=DiskConfig(str(tmp_path / "out"))))
    assert m.frames_processed == 2 and m.stages == {"points": 0, "finite points": 0, "voxels": 0, "polar points": 0}


def test_a_repeated_batch_keeps_its_numbers(spark, tmp_path):
    counts = files.Counts(spark, f"file://{tmp_path}/state")
    assert counts.before(0) == 0
    counts.after(0, 3)
    assert counts.before(1) == 3
    counts.after(1, 5)
    again = files.Counts(spark, f"file://{tmp_path}/state")
    assert (again.before(1), again.before(2), again.before(0)) == (3, 5, 0)


def test_pictures_hold_the_cells(tmp_path):
    """The pixels of a PNG, read back by its chunks."""
    codes = np.array([[0, 1, np.nan], [np.nan, 0, 1]], np.float32)
    data = files.png(2, 3, codes.ravel())
    at, found = 8, {}
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        assert struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0] == zlib.crc32(kind + body)
        found[kind] = body
        at += 12 + n
    w, h, depth, colour = struct.unpack(">IIBB", found[b"IHDR"][:10])
    assert (w, h, depth, colour) == (24, 16, 8, 2)
    lines = np.frombuffer(zlib.decompress(found[b"IDAT"]), np.uint8).reshape(h, 1 + 3 * w)
    assert not lines[:, 0].any()
    pixels = lines[:, 1:].reshape(h, w, 3)
    for y in range(h):
        for x in range(w):
            c = codes[y // 8, x // 8]
            assert tuple(pixels[y, x]) == ((128, 128, 128) if math.isnan(c) else (0, 200, 0) if c == 0 else (220, 0, 0))


def test_results_go_out_as_datagrams(spark, recording):
    frames = spark.read.parquet(str(recording / "frames"))
    results = pipeline.results(recorded.read_points(spark, str(recording / "points")), frames, C).cache()
    wrong = results.withColumn("r_edges", F.slice("r_edges", 1, 3)).withColumn("timestamp_ns", F.col("timestamp_ns") - 10**15)
    with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
        s.bind(("127.0.0.1", 0))
        s.settimeout(10)
        port = s.getsockname()[1]
        assert files.send(wrong.unionByName(results), port=port, first_seq=(1 << 32) - 1) == (1 << 32) + 2
        got = [s.recv(70_000) for _ in range(3)]
    rows = packets.decoded(spark.createDataFrame([(bytearray(x),) for x in got], "payload binary")).orderBy("timestamp_ns").collect()
    wanted = sorted(results.collect(), key=lambda r: r.timestamp_ns)
    assert [r.seq for r in rows] == [(1 << 32) - 1, 0, 1]
    assert all(int(a.timestamp_ns) == b.timestamp_ns and same(a, b) for a, b in zip(rows, wanted))
    assert files.send(results, port=1, first_seq=0) in (0, 1, 2, 3)  # nobody listens: refused datagrams use up no number
    files.discard(results)
    results.unpersist()


def test_a_refused_datagram_uses_up_no_number(spark, recording, monkeypatch):
    frames = spark.read.parquet(str(recording / "frames")).where("frame_id = 2")
    results = pipeline.results(recorded.read_points(spark, str(recording / "points")), frames, C)

    class Refusing(socket.socket):
        def sendto(self, data, *where):
            raise BlockingIOError

    monkeypatch.setattr(files.socket, "socket", Refusing)
    assert files.send(results, first_seq=7) == 7


def test_gaps_are_kept_between_micro_batches(spark, tmp_path):
    seqs = [(0, 5), (1, 6), (2, 9), (3, 9), (4, 7), (5, (1 << 32) - 1), (6, 0)]
    for k, part in enumerate((seqs[:3], seqs[3:5], seqs[5:])):
        spark.createDataFrame([(1, a, s) for a, s in part], "sender long, arrival long, seq long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("sender long, arrival long, seq long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    last = {}
    live.gap_stream(stream).writeStream.outputMode("update").foreachBatch(lambda b, _: last.update({r.sender: (r.packets, r.lost) for r in b.collect()})).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
    batch_ = streams.seq_gaps(spark.createDataFrame([(1, a, s) for a, s in seqs], "sender long, arrival long, seq long")).first()
    assert last[1] == (batch_.packets, batch_.lost) == (7, sum((b - a - 1) for a, b in zip([5, 6, 9, 9, 7, (1 << 32) - 1], [6, 9, 9, 7, (1 << 32) - 1, 1 << 32])) % (1 << 32))


def test_late_packets_change_nothing_in_the_end(spark, tmp_path):
    """Reordered between micro-batches: the stream's last totals are the batch's."""
    seqs = [(s, a, (7 * a + s) % (1 << 32)) for s in (1, 2) for a in (3, 0, 9, 4, 1, 8)]
    for k in range(0, 12, 3):
        spark.createDataFrame(seqs[k : k + 3], "sender long, arrival long, seq long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("sender long, arrival long, seq long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    last = {r.sender: r for r in collected(live.gap_stream(stream), tmp_path, "c", "update")}
    assert {s: (r.packets, r.lost) for s, r in last.items()} == {r.sender: (r.packets, r.lost) for r in streams.seq_gaps(spark.read.parquet(str(tmp_path / "in"))).collect()}


def test_silent_senders_leave_the_state(spark, tmp_path):
    rows = [(1, 0, 5, 0), (1, 1, 7, 60), (1, 2, 100, 4000), (2, 0, 1, 30), (3, 0, 1, 20_000)]
    for k, r in enumerate(rows):
        spark.createDataFrame([r], "sender long, arrival long, seq long, s long").withColumn("ts", F.timestamp_seconds("s")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)
    stream = spark.readStream.schema("sender long, arrival long, seq long, s long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = collected(live.gap_sessions(stream, late="2 hours"), tmp_path, "c", "append")
    assert sorted((r.sender, r.packets, r.lost) for r in got) == [(1, 1, 0), (1, 2, 1), (2, 1, 0)]


def plain_rates(times, width=10**9):
    out, start, count = [], None, 0
    for t in sorted(times):
        start = t if start is None else start
        count += 1
        if t - start >= width:
            out.append((start, t, count, count / ((t - start) / 1e9)))
            start, count = t, 0
    return out


@pytest.mark.parametrize("rows_each", [7, 1_000_000])
def test_rate_windows_are_greedy(spark, monkeypatch, rows_each):
    monkeypatch.setattr(storage, "RANGE_ROWS", rows_each)
    rng = np.random.default_rng(3)
    times = np.cumsum(rng.choice([0, 1, 30_000_000, 400_000_000, 3_000_000_000], 120)).tolist()
    got = streams.rate_windows(spark.createDataFrame([(t,) for t in times] + [(None,)], "timestamp_ns long").repartition(3)).collect()
    assert sorted((r.start_ns, r.end_ns, r.frames, r.fps) for r in got) == plain_rates(times)
    assert streams.rate_windows(spark.createDataFrame([], "timestamp_ns long")).count() == 0
    assert streams.rate_windows(spark.createDataFrame([(5,), (5,)], "timestamp_ns long")).count() == 0


def test_a_stream_s_rate_windows_are_the_batch_s(spark, tmp_path):
    rng = np.random.default_rng(4)
    times = {v: np.cumsum(rng.choice([0, 30_000_000, 400_000_000, 1_700_000_000], 60)).tolist() for v in (1, 2)}
    for k in range(0, 60, 20):
        rows = [(v, t) for v in times for t in times[v][k : k + 20]] + [(1, None)]
        spark.createDataFrame(rows, "viewer long, timestamp_ns long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)
    stream = spark.readStream.schema("viewer long, timestamp_ns long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = collected(live.rate_window_stream(stream), tmp_path, "c", "append")
    for v in times:
        assert sorted((r.start_ns, r.end_ns, r.frames, r.fps) for r in got if r.viewer == v) == plain_rates(times[v])


def test_frames_cut_over_micro_batches_and_empty_ones_equal_the_batch(spark, recording, tmp_path):
    points = recorded.read_points(spark, str(recording / "points"))
    frames = spark.read.parquet(str(recording / "frames"))
    at = [r.timestamp_ns for r in frames.orderBy("timestamp_ns").collect()]
    end = at[-1] + 60 * 86400 * 10**9  # frame 8 has no points; frame 9 ends the recording, so that the watermark passes the others
    more = spark.createDataFrame([(8, at[-1] + 1000, (0.0, 0.0, 0.0, 1.0)), (9, end, (0.0, 0.0, 0.0, 1.0))], recorded.FRAMES)
    table = frames.unionByName(more)
    table.coalesce(1).write.parquet(str(tmp_path / "frames"))
    table = spark.read.parquet(str(tmp_path / "frames"))
    for part in range(3):  # each file has a third of the points of every frame
        points.where(F.pmod(F.xxhash64("pixel_id", "x"), F.lit(3)) == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "points"))
        time.sleep(1.1)
    spark.createDataFrame([(9, 1, 0.5, 0.0, 0.0, 0.0)], recorded.POINTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "points"))
    got = []
    streams_ = recorded.stream_points(spark, str(tmp_path / "points")), recorded.stream_frames(spark, str(tmp_path / "frames"))
    live.frame_stream(*streams_, table, C, lambda r, b: got.extend(r.collect()), str(tmp_path / "c"), late="30 days", conflate=False).awaitTermination(120)
    wanted = batch(spark, recording) | {8: None}
    assert sorted(r.frame_id for r in got if r.frame_id != 9) == sorted(wanted)
    for r in got:
        if wanted.get(r.frame_id):
            assert same(r, wanted[r.frame_id])
        elif r.frame_id == 8:
            assert all(map(math.isnan, r.trav_grid)) and np.allclose(r.height_map, -0.3)


def test_files_of_attempts_that_don_t_count_are_never_seen(tmp_path):
    rows = [{"file_index": k, "r_bins": 1, "theta_bins": 2, "trav_grid": [0.0, 1.0]} for k in range(3)]
    writer = committed.GridWriter({"path": f"file://{tmp_path}"})

    def dying():
        yield rows[0]
        raise OSError("lost executor")

    def seen():
        return sorted(p.name for p in tmp_path.iterdir() if p.name != committed.STAGING)

    with pytest.raises(OSError):
        writer.write(dying())
    first, twin, other = writer.write(iter(rows[:2])), writer.write(iter(rows[:2])), writer.write(iter(rows[2:]))
    assert seen() == []
    writer.commit([twin, None, other])
    assert seen() == ["frame_000000.csv", "frame_000001.csv", "frame_000002.csv"] and (tmp_path / "frame_000001.csv").read_text() == "0,1\n"
    assert not list((tmp_path / committed.STAGING).iterdir()) and first.names == twin.names
    failing = committed.GridStreamWriter({"path": f"file://{tmp_path}", "images": "true"})
    failing.abort([failing.write(iter(rows)), None], 4)
    assert len(seen()) == 3 and not list((tmp_path / committed.STAGING).iterdir())
    again = committed.GridStreamWriter({"path": f"file://{tmp_path}"})  # a repeated batch writes the same names
    again.commit([again.write(iter(rows))], 4)
    assert len(seen()) == 3


def test_a_job_that_fails_leaves_no_file(spark, tmp_path):
    spark.dataSource.register(committed.GridFiles)
    rows = spark.range(4).select(F.col("id").alias("file_index"), F.array(F.lit(1.0).cast("float")).alias("trav_grid"), F.lit(1).alias("r_bins"), F.when(F.col("id") == 3, 7).otherwise(1).alias("theta_bins"))
    out = rows.repartition(4).write.format("grid_files").option("path", f"file://{tmp_path}").mode("append")
    with pytest.raises(Exception, match="reshape"):
        out.save()
    assert not list(tmp_path.glob("*.csv")) and not list(tmp_path.glob("_staging/*"))


def test_of_equal_time_stamps_one_frame_is_the_newest(spark):
    rows = spark.createDataFrame([(1, 5), (2, 9), (3, 9)], "frame_id long, timestamp_ns long")
    kept, dropped = live.newest(rows)
    assert [r.frame_id for r in kept.collect()] == [3] and dropped == 2
    assert live.newest(rows.limit(0))[1] == 0


def test_a_lost_count_is_no_new_start(spark, tmp_path):
    with pytest.raises(RuntimeError):
        files.Counts(spark, f"file://{tmp_path}/state").before(4)


def collected(stream, tmp_path, name, mode):
    rows = []
    stream.writeStream.outputMode(mode).foreachBatch(lambda b, _: rows.extend(b.collect())).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination(120)
    return rows


def test_rates_and_replays_of_streams(spark, tmp_path):
    base = 1_700_000_000
    shown = [(k, base + s) for k, s in enumerate([0, 0, 0, 1, 1, 3])] + [(0, base), (3, base + 1), (99, base + 3600)]
    for k in range(0, len(shown), 3):
        rows = spark.createDataFrame(shown[k : k + 3], "frame_id long, s long").select("frame_id", F.timestamp_seconds("s").alias("ts"))
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)
    stream = spark.readStream.schema("frame_id long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    once = collected(live.without_replays(stream), tmp_path, "a", "append")
    assert sorted(r.frame_id for r in once) == [0, 1, 2, 3, 4, 5, 99]
    rates = collected(live.rate_stream(stream), tmp_path, "b", "append")
    assert {int(r.second.timestamp()) - base: r.fps for r in rates} == {0: 4, 1: 3, 3: 1}
    table = spark.read.parquet(str(tmp_path / "in")).where("frame_id < 99")
    assert {int(r.second.timestamp()) - base: r.fps for r in streams.viewer_fps(table).collect()} == {0: 4, 1: 3, 3: 1}


def test_files_are_numbered_by_consumption(spark, tmp_path):
    none = spark.createDataFrame([], recorded.POINTS)
    results = pipeline.results(none, synthetic.frames(spark, SF), C)
    assert files.write_files(results, f"file://{tmp_path}/csv", images=False, first=4) == 2
    lines = (tmp_path / "csv" / "frame_000005.csv").read_text().splitlines()
    assert len(lines) == 17 and lines[0] == ",".join(["nan"] * 19)


def test_datagrams_arrive_as_rows(spark, tmp_path):
    from gridlark.sources.udp import UdpReader

    reader = UdpReader({"host": "127.0.0.1", "port": "0"})
    rows, at = reader.read(reader.initialOffset())
    assert list(rows) == [] and at == {"arrival": 0}
    with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
        for x in (b"a", b"bc"):
            s.sendto(x, reader.socket.getsockname())
    rows, end = reader.read(at)
    assert list(rows) == [(0, b"a"), (1, b"bc")] == list(reader.readBetweenOffsets(at, end))
    reader.commit(end)
    assert not reader.kept
