"""Datagrams as a streaming source: ``spark.dataSource.register(UdpSource)``, then ``spark.readStream.format("udp")``.

Options: host (default 0.0.0.0), port (5005). Rows: arrival (a running number), payload. The reader drains what has
arrived since the last micro-batch; like the wire itself it doesn't repeat what a failed batch has lost. The socket belongs to the
driver, so this suits result packets (one small datagram per frame), not raw points.
"""

from __future__ import annotations

import socket
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from gridlark.functions.packets import MAX_BYTES

#: Datagrams of one micro-batch; what is left waits for the next.
BATCH = 4096


class UdpSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "udp"

    def schema(self) -> str:
        return "arrival bigint, payload binary"

    def simpleStreamReader(self, schema) -> UdpReader:
        return UdpReader(self.options)


class UdpReader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict):
        self.at = options.get("host", "0.0.0.0"), int(options.get("port", 5005))
        self.socket: socket.socket | None = None
        self.kept: dict[int, list[tuple[int, bytes]]] = {}

    def initialOffset(self) -> dict:
        return {"arrival": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple[int, bytes]], dict]:
        if self.socket is None:
            self.socket = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
            self.socket.bind(self.at)
            self.socket.setblocking(False)
        rows, first = [], start["arrival"]
        while len(rows) < BATCH:
            try:
                rows.append((first + len(rows), self.socket.recv(MAX_BYTES + 1)))
            except BlockingIOError:
                break
        self.kept[first] = rows
        return iter(rows), {"arrival": first + len(rows)}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple[int, bytes]]:
        return iter([r for rows in self.kept.values() for r in rows if start["arrival"] <= r[0] < end["arrival"]])

    def commit(self, end: dict) -> None:
        self.kept = {first: rows for first, rows in self.kept.items() if first + len(rows) > end["arrival"]}
