"""Sinks: functions of a stream writer to a started query."""

from __future__ import annotations

import json
import socket
import threading
import time
from collections.abc import Callable

from pyspark import TaskContext
from pyspark.sql import DataFrame


def discard() -> Callable:
    return lambda writer: writer.format("noop").start()


def files(path: str, kind: str = "parquet") -> Callable:
    """Exactly once: the sink's own log names the files of every committed batch."""
    return lambda writer: writer.format(kind).option("path", path).start()


def memory(name: str) -> Callable:
    return lambda writer: writer.queryName(name).format("memory").start()


def each_batch(path: str, fail_at: int | None = None) -> Callable:
    """Idempotent: a batch that is written again replaces its own folder. ``fail_at`` injects a failure: that batch is written but not committed."""

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch}")
        if batch == fail_at:
            raise RuntimeError(f"failure injected in batch {batch}")

    return lambda writer: writer.foreachBatch(write).start()


def tcp(host: str, port: int) -> Callable:
    """Rows as JSON lines to a listening socket, at least once, with their batch, partition and place in it as lineage."""

    def send(df: DataFrame, batch: int) -> None:
        def part(rows) -> None:
            of = TaskContext.get().partitionId()
            with socket.create_connection((host, port)) as s, s.makefile("w", encoding="utf-8") as out:
                for i, line in enumerate(rows):
                    out.write(f'{{"at":[{batch},{of},{i}],"row":{line}}}\n')

        df.toJSON().foreachPartition(part)

    return lambda writer: writer.foreachBatch(send).start()


class Receiver:
    """The other side of ``tcp``: rows by their place, each once however often its batch is sent again; for tests, as it holds them all."""

    def __init__(self, host: str = "127.0.0.1"):
        self.server = socket.create_server((host, 0))
        self.port = self.server.getsockname()[1]
        self.rows: dict[tuple[int, int, int], dict] = {}
        threading.Thread(target=self._accept, daemon=True).start()

    def _accept(self) -> None:
        while True:
            try:
                connection, _ = self.server.accept()
            except OSError:  # closed
                return
            threading.Thread(target=self._read, args=(connection,), daemon=True).start()

    def _read(self, connection: socket.socket) -> None:
        with connection, connection.makefile("r", encoding="utf-8") as lines:
            for line in lines:
                if line.endswith("\n"):  # else the sender died in the line and will send it again
                    said = json.loads(line)
                    self.rows[tuple(said["at"])] = said["row"]

    def close(self) -> None:
        self.server.close()


class Feeder:
    """Serves lines, or blocks of them, to the first that connects; for tests of socket sources.

    ``taken`` says how many lines have been worked on: at most ``ahead`` more are sent, as a socket source keeps them in memory.
    """

    def __init__(self, lines, host: str = "127.0.0.1", taken: Callable[[], int] | None = None, ahead: int = 500_000):
        self.server = socket.create_server((host, 0))
        self.port = self.server.getsockname()[1]
        self.taken, self.ahead, self.sent, self.error, self.closed = taken, ahead, 0, None, False
        threading.Thread(target=self._send, args=(lines,), daemon=True).start()

    def _send(self, lines) -> None:
        try:
            connection, _ = self.server.accept()
            with connection:
                for block in lines:
                    while self.taken and self.sent - self.taken() > self.ahead and not self.closed:
                        time.sleep(0.05)
                    connection.sendall(f"{block}\n".encode())
                    self.sent += block.count("\n") + 1
                connection.recv(1)  # until the reader goes
        except Exception as e:  # told by wait_for, which runs in another thread
            if not self.closed:
                self.error = e

    def close(self) -> None:
        self.closed = True
        self.server.close()


def wait_for(receiver: Receiver, rows: int, feeder: Feeder, run, stalled: float = 180) -> None:
    """Until the receiver has that many rows. Raises if the feeder or the query fails, the query ends, or nothing at all moves for ``stalled`` seconds.

    There is no limit on the whole, as a large table takes long.
    """
    before, since = None, time.monotonic()
    while len(receiver.rows) < rows:
        if feeder.error:
            raise RuntimeError("the feeder failed") from feeder.error
        for q in run.running:
            if q.exception():
                raise q.exception()
            if not q.isActive:
                raise RuntimeError(f"the query ended after {len(receiver.rows)} of {rows} rows")
        now = len(receiver.rows), feeder.sent, run.metrics.rows()
        if now != before:
            before, since = now, time.monotonic()
        elif time.monotonic() - since > stalled:
            raise TimeoutError(f"nothing moved for {stalled} s after {len(receiver.rows)} of {rows} rows")
        time.sleep(0.2)
    if len(receiver.rows) > rows:
        raise RuntimeError(f"{len(receiver.rows)} rows came, {rows} were sent")
