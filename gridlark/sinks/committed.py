"""Grid files as a transaction: ``spark.dataSource.register(GridFiles)``, then ``df.write.format("grid_files").option("path", folder).mode("append").save()``.

Rows: file_index, trav_grid, r_bins, theta_bins. Options: path (with its scheme), images (true: PNG, else CSV). Every attempt of a task writes to a place of its own below the job's
staging folder; only when all tasks have succeeded does the driver move the files of the attempts that count to their names. So retries, speculation
and lost executors leave no half-written and no doubled file, and a job that fails leaves none. A batch of a stream that is repeated writes the same names again.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Row
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage

from gridlark.storage import arrow_folder

STAGING = "_staging"


class GridFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "grid_files"

    def writer(self, schema, overwrite: bool) -> GridWriter:
        return GridWriter(self.options)

    def streamWriter(self, schema, overwrite: bool) -> GridStreamWriter:
        return GridStreamWriter(self.options)


@dataclass
class Staged(WriterCommitMessage):
    """Where an attempt has put its files, and their names."""

    folder: str
    names: list[str]


class Transaction:
    def __init__(self, options: dict):
        self.path, self.images = options["path"], str(options.get("images", "false")).lower() == "true"
        self.job = uuid.uuid4().hex  # of the driver; tasks get it with this object

    def staged(self, rows: Iterator[Row]) -> Staged:
        from gridlark.sinks.files import csv_text, png

        fs, root = arrow_folder(self.path)
        folder, names = f"{STAGING}/{self.job}/{uuid.uuid4().hex}", []
        fs.create_dir(f"{root}/{folder}", recursive=True)
        for r in rows:
            data = (png if self.images else csv_text)(r["r_bins"], r["theta_bins"], np.array(r["trav_grid"], np.float32))
            names.append(f"frame_{r['file_index']:06d}.{'png' if self.images else 'csv'}")
            with fs.open_output_stream(f"{root}/{folder}/{names[-1]}") as out:
                out.write(data)
        return Staged(folder, names)

    def publish(self, messages: list[Staged | None]) -> None:
        fs, root = arrow_folder(self.path)
        for m in filter(None, messages):
            for name in m.names:
                fs.move(f"{root}/{m.folder}/{name}", f"{root}/{name}")
        self.clear()

    def clear(self) -> None:
        """Deletes what attempts have staged, those too that don't count; other jobs' folders stay."""
        fs, root = arrow_folder(self.path)
        fs.create_dir(f"{root}/{STAGING}/{self.job}", recursive=True)
        fs.delete_dir(f"{root}/{STAGING}/{self.job}")


class GridWriter(Transaction, DataSourceWriter):
    def write(self, iterator: Iterator[Row]) -> Staged:
        return self.staged(iterator)

    def commit(self, messages: list[Staged | None]) -> None:
        self.publish(messages)

    def abort(self, messages: list[Staged | None]) -> None:
        self.clear()


class GridStreamWriter(Transaction, DataSourceStreamWriter):
    def write(self, iterator: Iterator[Row]) -> Staged:
        return self.staged(iterator)

    def commit(self, messages: list[Staged | None], batchId: int) -> None:
        self.publish(messages)

    def abort(self, messages: list[Staged | None], batchId: int) -> None:
        self.clear()
