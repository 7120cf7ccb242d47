"""Events to send as a transactional sink, and the sink's readers.

``spark.write.format("outbox")`` and ``writeStream.format("outbox")`` put rows (of any columns) as JSON
lines into a folder. A task writes a file of its own under ``staged``; a batch counts once its
manifest, a list of its tasks' files, is there whole, and never changes after that. A task that
runs twice leaves a file that no manifest names, a batch that fails leaves no manifest, and one that
runs again after its manifest was written is dropped as done: each event is there once. Stream
batches are named by the query (option ``name``, if several write to a folder) and their number, a
batch job by its option ``batch``: writing that batch again changes nothing; without one it is new.

``read`` gives the events of all batches or of those after one, so that a sender that keeps the
last batch it sent goes on from there.
"""

from __future__ import annotations

import datetime
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from botledger.sources import stores


@dataclass
class _Staged(WriterCommitMessage):
    files: list[str] = field(default_factory=list)
    rows: int = 0


def _plain(value: object) -> object:
    if isinstance(value, (datetime.datetime, datetime.date)):
        return value.isoformat()
    return value.asDict(True) if isinstance(value, Row) else str(value)


class _Box:
    """What both writers do. Rows of a task go out in one file, a batch of them at a time."""

    def __init__(self, options: dict):
        self.folder = stores.bare(options["path"]).rstrip("/")
        self.name = options.get("name", "events")

    def write(self, rows: Iterator[Row]) -> _Staged:
        path = f"{self.folder}/staged/{self.name}-{uuid.uuid4().hex}.jsonl"
        out, n = None, 0
        for row in rows:
            if out is None:
                stores.make_folder(f"{self.folder}/staged")
                out = stores.create(path)
            out.write((json.dumps(row.asDict(True), default=_plain, ensure_ascii=False) + "\n").encode())
            n += 1
        if out is None:
            return _Staged()
        out.close()
        return _Staged([path], n)

    def _settle(self, batch: str, messages: list[_Staged | None]) -> None:
        staged = [m for m in messages if m is not None]
        files = [f for m in staged for f in m.files]
        manifest = f"{self.name}-{batch}.json"
        if manifest in stores.names(f"{self.folder}/batches"):
            self._drop(messages)  # done before
        else:
            stores.put(f"{self.folder}/batches/{manifest}", json.dumps({"files": files, "rows": sum(m.rows for m in staged)}).encode())

    def _drop(self, messages: list[_Staged | None]) -> None:
        for m in messages:
            for path in m.files if m is not None else []:
                stores.delete(path)


class _StreamWriter(_Box, DataSourceStreamWriter):
    def commit(self, messages: list, batchId: int) -> None:
        self._settle(f"{batchId:012d}", messages)

    def abort(self, messages: list, batchId: int) -> None:
        self._drop(messages)


class _Writer(_Box, DataSourceWriter):
    def __init__(self, options: dict):
        super().__init__(options)
        self.batch = options.get("batch") or uuid.uuid4().hex

    def commit(self, messages: list) -> None:
        self._settle(self.batch, messages)

    def abort(self, messages: list) -> None:
        self._drop(messages)


class Outbox(DataSource):
    @classmethod
    def name(cls) -> str:
        return "outbox"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options)

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamWriter:
        return _StreamWriter(self.options)


def post(events: DataFrame, folder: str, batch: str | None = None, name: str = "events") -> None:
    """Write a batch of events; one whose name is there already is left as it is."""
    events.sparkSession.dataSource.register(Outbox)
    writer = events.write.format("outbox").mode("append").option("path", folder).option("name", name)
    (writer.option("batch", batch) if batch else writer).save()


def post_stream(events: DataFrame, folder: str, checkpoint: str, name: str = "events"):
    """A query that writes each micro-batch of events once."""
    events.sparkSession.dataSource.register(Outbox)
    return events.writeStream.format("outbox").option("path", folder).option("name", name).option("checkpointLocation", checkpoint).start()


def batches(folder: str, after: str | None = None, name: str = "events") -> list[str]:
    """Names of the batches written, in order (stream batches by number), those after one if it is given."""
    found = sorted(n[len(name) + 1 : -5] for n in stores.names(f"{stores.bare(folder).rstrip('/')}/batches") if n.startswith(name + "-") and n.endswith(".json"))
    return [b for b in found if after is None or b > after]


def read(spark: SparkSession, folder: str, schema: str, after: str | None = None, name: str = "events") -> DataFrame:
    """The events (batch, and the schema's columns) of whole batches, each once."""
    files: list[tuple[str, str]] = []
    for b in batches(folder, after, name):
        with stores.open_file(f"{stores.bare(folder).rstrip('/')}/batches/{name}-{b}.json") as f:
            files += [(path.rsplit("/", 1)[-1], b) for path in json.loads(f.read())["files"]]
    if not files:
        return spark.createDataFrame([], f"batch string, {schema}")
    root = f"{folder.rstrip('/')}/staged"
    rows = spark.read.schema(schema).json([f"{root}/{file}" for file, _ in files]).withColumn("_file", F.substring_index("_metadata.file_path", "/", -1))
    return rows.join(F.broadcast(spark.createDataFrame(files, "_file string, batch string")), "_file").drop("_file")  # a name for each file that is listed here
