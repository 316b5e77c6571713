"""A reward log by rank and call, as a data source with a two-phase commit.

``df.write.format("rank_log").option("rank", r).option("call", n).mode("append").save(folder)`` adds the rows as call n of
rank r, and ``df.writeStream.format("rank_log").option("rank", r)`` each batch as the call of its number. Tasks write JSON Lines into a
folder of the write's own, under ``_staging``, which readers pass over. The commit keeps the files of the attempts that won
and renames that folder to ``rank=r/call=n``: readers see all rows of a call or none. A call that is there
already is left as it is, so a batch that is run again adds nothing, and of two writers of one call the later one fails.

The log is read as JSON of any kind: ``spark.read.json(folder)`` finds rank and call in the folders' names. ``next_call`` lists
the calls of a rank, so a process that starts anew goes on behind the last committed one.

Folders are local paths or URIs that ``pyarrow.fs`` knows (file, hdfs, s3, gs): commits run in Spark's Python
processes, which have no JVM. The rename is atomic in file systems with folders (local, HDFS); an object store without them needs one writer a rank.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage

NAME = "rank_log"
MANIFEST = "_committed"


def store(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    fs, path = pyarrow.fs.FileSystem.from_uri(folder) if re.match(r"[a-z][a-z0-9+.-]*:", folder) else (pyarrow.fs.LocalFileSystem(), folder)
    return fs, path.rstrip("/")


@dataclass
class Written(WriterCommitMessage):
    """A file of a task, in the staging folder of its write."""

    own: str
    file: str
    rows: int


class _Log:
    """One write: its staging folder, and its commit as a call."""

    def __init__(self, folder: str, rank: int):
        self.folder, self.rank, self.own = folder, rank, uuid.uuid4().hex

    def stage(self, rows: Iterator[Row], call: int | None) -> Written:
        fs, base = store(self.folder)
        task = TaskContext.get()
        name, n = f"part-{task.partitionId():05d}-{task.taskAttemptId()}.jsonl", 0
        fs.create_dir(f"{base}/_staging/{self.own}", recursive=True)
        with fs.open_output_stream(f"{base}/_staging/{self.own}/{name}") as out:
            for row in rows:
                record = {k: v for k, v in row.asDict(recursive=True).items() if k not in ("rank", "call")}
                out.write((json.dumps(({} if call is None else {"call": call}) | record, ensure_ascii=False, default=str) + "\n").encode("utf-8", "surrogatepass"))
                n += 1
        return Written(self.own, name, n)

    def commit(self, messages: list, call: int) -> bool:
        """Whether the rows are new: False if the call is there already. Messages name the staging folder: a stream stages and commits in different processes."""
        fs, base = store(self.folder)
        won = [m for m in messages if m is not None]
        ready, target = f"{base}/_staging/{uuid.uuid4().hex}", f"{base}/rank={self.rank}/call={call}"
        try:
            if _there(fs, f"{target}/{MANIFEST}"):
                return False
            fs.create_dir(ready, recursive=True)
            for m in won:
                if m.rows:
                    fs.move(f"{base}/_staging/{m.own}/{m.file}", f"{ready}/{m.file}")
            with fs.open_output_stream(f"{ready}/{MANIFEST}") as out:
                out.write(json.dumps({"rank": self.rank, "call": call, "files": {m.file: m.rows for m in won}}).encode())
            fs.create_dir(f"{base}/rank={self.rank}", recursive=True)
            fs.move(ready, target)  # fails if another writer's call is there
            return True
        finally:
            self._drop(ready.rpartition("/")[2], *(m.own for m in won))

    def abort(self, messages: list) -> None:
        self._drop(*(m.own for m in messages if m is not None))

    def _drop(self, *names: str) -> None:
        fs, base = store(self.folder)
        for name in {self.own, *names}:
            if _there(fs, f"{base}/_staging/{name}"):
                fs.delete_dir(f"{base}/_staging/{name}")


def _there(fs: pyarrow.fs.FileSystem, path: str) -> bool:
    return fs.get_file_info(path).type != pyarrow.fs.FileType.NotFound


class _Writer(DataSourceWriter):
    def __init__(self, folder: str, rank: int, call: int):
        self.log, self.call = _Log(folder, rank), call

    def write(self, iterator: Iterator[Row]) -> Written:
        return self.log.stage(iterator, self.call)

    def commit(self, messages: list) -> None:
        self.log.commit(messages, self.call)

    def abort(self, messages: list) -> None:
        self.log.abort(messages)


class _StreamWriter(DataSourceStreamWriter):
    """Each batch is the call of its number; its rows don't name the call, the folder does."""

    def __init__(self, folder: str, rank: int):
        self.log = _Log(folder, rank)

    def write(self, iterator: Iterator[Row]) -> Written:
        return self.log.stage(iterator, None)

    def commit(self, messages: list, batchId: int) -> None:  # noqa: N803
        self.log.commit(messages, batchId)

    def abort(self, messages: list, batchId: int) -> None:  # noqa: N803
        self.log.abort(messages)


class RankLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def _place(self) -> tuple[str, int]:
        return self.options["path"], int(self.options.get("rank", "0"))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("a rank log is only appended to")
        return _Writer(*self._place(), int(self.options["call"]))

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamWriter:  # noqa: N802
        return _StreamWriter(*self._place())


def next_call(folder: str, rank: int = 0) -> int:
    """The number behind the last committed call of a rank; 0 without one. It lists names and reads no rows."""
    fs, base = store(folder)
    if not _there(fs, f"{base}/rank={rank}"):
        return 0
    names = (info.base_name for info in fs.get_file_info(pyarrow.fs.FileSelector(f"{base}/rank={rank}")))
    return max((int(n[5:]) + 1 for n in names if re.fullmatch(r"call=\d+", n)), default=0)


def append(df: DataFrame, folder: str, *, rank: int = 0, call: int | None = None) -> int:
    """Adds df as a call of a rank (the next one, if none is named) and returns its number; a call that is there already stays as it is."""
    df.sparkSession.dataSource.register(RankLog)
    call = next_call(folder, rank) if call is None else call
    df.write.format(NAME).option("rank", rank).option("call", call).mode("append").save(folder)
    return call


def read(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The committed rows with rank and call."""
    return spark.read.schema(f"{schema}, rank int, call bigint").json(folder)
