"""A recording replayed at its own pace: ``spark.dataSource.register(PacedRecording)``, then ``spark.readStream.format("paced_recording")``.

Offsets are recorded time stamps, and the end of a micro-batch follows the clock: a frame is due when as much time has passed since ``began_ms`` as lies between it
and the first frame. So the recording's gaps and bursts are kept, a slow consumer gets larger micro-batches, and a restart catches up.

Options: path (a folder with the tables ``points`` and ``frames``), speed (1: as recorded), began_ms (the clock, in milliseconds since the epoch, at the first frame; by
default when the query starts, which a restarted query must be given again), frame_skip (so many frames are left out before each one).

A micro-batch's frames are found by their time stamps and its points' row groups by the statistics of frame_id; each such row group is a task's part, read by the executors.
Recordings sorted by frame read little else. The driver holds the due frames' ids and, of files, statistics.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from gridlark.sources.recorded import POINTS
from gridlark.storage import arrow_folder

STAMP = "timestamp_ns"


class PacedRecording(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paced_recording"

    def schema(self) -> str:
        return POINTS

    def streamReader(self, schema) -> PacedReader:
        return PacedReader(self.options)


@dataclass
class Part(InputPartition):
    """Row groups of a points file, and which frames of it are wanted."""

    file: str
    groups: list[int]
    frames: bytes


def tables(path: str, name: str) -> ds.Dataset:
    fs, root = arrow_folder(path if "://" in path else f"file://{path}")
    return ds.dataset(f"{root}/{name}", filesystem=fs, format="parquet")


def bounds(fragment, column: str) -> Iterator[tuple[int, int, int]]:
    """Number, least and greatest value of a column in each row group; all values where a file has no statistics."""
    for group in fragment.row_groups:
        found = (group.statistics or {}).get(column)
        yield (group.id, found["min"], found["max"]) if found else (group.id, -(1 << 63), (1 << 63) - 1)


class PacedReader(DataSourceStreamReader):
    def __init__(self, options: dict, clock=time.time):
        self.path, self.speed, self.clock = options["path"], float(options.get("speed", 1)), clock
        self.skip = int(options.get("frame_skip", 0))
        stamps = [b for f in tables(self.path, "frames").get_fragments() for _, *b in bounds(f, STAMP)]
        self.first, self.last = (min(a for a, _ in stamps), max(b for _, b in stamps)) if stamps else (0, -1)
        self.began = float(options["began_ms"]) / 1000 if "began_ms" in options else clock()

    def initialOffset(self) -> dict:
        return {"after": self.first - 1}

    def latestOffset(self) -> dict:
        due = self.first + int((self.clock() - self.began) * self.speed * 1e9)
        return {"after": max(self.first - 1, min(due, self.last))}

    def due(self, start: dict, end: dict) -> np.ndarray:
        """Ids, in ascending order, of the frames after start up to end that aren't skipped."""
        stamp = ds.field(STAMP)
        found = tables(self.path, "frames").to_table(["frame_id", STAMP], filter=(stamp > start["after"]) & (stamp <= end["after"]))
        if self.skip:  # ordinals count from the recording's start
            found = found.sort_by([(STAMP, "ascending"), ("frame_id", "ascending")])
            before = tables(self.path, "frames").count_rows(filter=stamp <= start["after"])
            found = found.filter(pa.array((np.arange(len(found)) + before) % (self.skip + 1) == self.skip))
        return np.unique(found["frame_id"].to_numpy())

    def partitions(self, start: dict, end: dict) -> list[Part]:
        ids, parts = self.due(start, end), []
        if not len(ids):
            return parts
        for fragment in tables(self.path, "points").get_fragments():
            for group, low, high in bounds(fragment, "frame_id"):
                wanted = ids[np.searchsorted(ids, low) : np.searchsorted(ids, high, side="right")]
                if len(wanted):
                    parts.append(Part(fragment.path, [group], wanted.tobytes()))
        return parts

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        fs, _ = arrow_folder(self.path if "://" in self.path else f"file://{self.path}")
        names = [c.split()[0] for c in POINTS.split(", ")]
        wanted = pa.array(np.frombuffer(partition.frames, np.int64))
        fragment = ds.ParquetFileFormat().make_fragment(partition.file, filesystem=fs, row_groups=partition.groups)
        for batch in fragment.to_batches(columns=names):
            rows = batch.filter(pc.is_in(batch.column(0), value_set=wanted))
            if rows.num_rows:
                yield rows

    def commit(self, end: dict) -> None:
        """Nothing is kept between micro-batches."""
