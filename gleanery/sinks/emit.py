"""Sinks that hand items on: callbacks, queues, webhooks, database upserts. They work on tables and inside ``foreachBatch``."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable, Iterator
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.sinks.export import json_lines


class Sink(Protocol):
    """What takes items. One is opened, written and closed in every partition, so it must survive pickling."""

    def open(self) -> None: ...

    def write(self, item: dict) -> None: ...

    def close(self) -> None: ...


def batches(rows: Iterator[dict], size: int) -> Iterator[list[dict]]:
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield held
            held = []
    if held:
        yield held


def emit(df: DataFrame, sink: Sink) -> tuple[int, int]:
    """(written, failed): every item to the sink; an item that it refuses is counted and left out. A task that is
    repeated writes its items again."""
    spark = df.sparkSession
    good, bad = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    lines = df.select(json_lines(df).alias("line"))

    def run(rows) -> None:
        sink.open()
        try:
            for r in rows:
                try:
                    sink.write(json.loads(r["line"]))
                    good.add(1)
                except Exception:  # the sink is the caller's: one item's failure is counted, not raised
                    bad.add(1)
        finally:
            sink.close()

    lines.foreachPartition(run)
    return good.value, bad.value


class Callback:
    """Calls a function with each item: a job queue's ``put``, for instance."""

    def __init__(self, call: Callable[[dict], None]):
        self.call = call

    def open(self) -> None:
        pass

    def write(self, item: dict) -> None:
        self.call(item)

    def close(self) -> None:
        pass


class Webhook:
    """Posts items as JSON, ``size`` at a time (a lone item as an object where ``size`` is 1); failures are counted, never raised."""

    def __init__(self, url: str, size: int = 1, headers: dict | None = None, timeout: int = 30):
        self.url, self.size, self.headers, self.timeout = url, max(1, size), headers or {}, timeout
        self.held: list[dict] = []
        self.failed = 0

    def open(self) -> None:
        self.held = []

    def write(self, item: dict) -> None:
        self.held.append(item)
        if len(self.held) >= self.size:
            self._post()

    def close(self) -> None:
        if self.held:
            self._post()

    def _post(self) -> None:
        items, self.held = self.held, []
        body = json.dumps(items[0] if self.size == 1 else items, ensure_ascii=False).encode()
        ask = urllib.request.Request(self.url, body, {"Content-Type": "application/json", **self.headers}, method="POST")
        try:
            urllib.request.urlopen(ask, timeout=self.timeout).close()
        except OSError:
            self.failed += len(items)


def upsert_statements(df: DataFrame, table: str, key: tuple[str, ...] = ("link",)) -> DataFrame:
    """``(statement, parameters)``: an ANSI MERGE for the table's columns and each row's values as JSON, for a driver of the caller's."""
    names = df.columns
    quoted = [f'"{n}"' for n in names]
    on = " AND ".join(f't."{k}" = s."{k}"' for k in key)
    sets = ", ".join(f'"{n}" = s."{n}"' for n in names if n not in key)
    update = f" WHEN MATCHED THEN UPDATE SET {sets}" if sets else ""
    statement = (
        f'MERGE INTO "{table}" t USING (VALUES ({", ".join("?" * len(names))})) AS s ({", ".join(quoted)}) ON {on}{update} '
        f'WHEN NOT MATCHED THEN INSERT ({", ".join(quoted)}) VALUES ({", ".join("s." + q for q in quoted)})'
    )
    return df.select(F.lit(statement).alias("statement"), F.to_json(F.array(*[F.col(f"`{n}`").cast("string") for n in names]), {"ignoreNullFields": "false"}).alias("parameters"))
