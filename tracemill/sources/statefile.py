"""Small documents that processes share: each change is a new version, made whole or not at all, and only from the version it was made of.

A document at ``path`` has its versions in ``path.versions`` as files numbered from 1. A writer writes a file beside them
and renames it to the number behind the one that it read, which fails if that is there: of two writers that read the same
version one has a conflict. Readers take the greatest number, so a writer that ends between bytes leaves the old state. A copy at ``path``
itself is for people; it is read where there are no versions, as a document that something else wrote.

With a session the files are in any store that Hadoop knows, renamed by FileContext as Spark's own checkpoints are; without one, on the
local disk, where a link makes the rename fail.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from pathlib import Path

from pyspark.sql import SparkSession

#: Versions that are kept.
KEPT = 3


class StateConflict(RuntimeError):
    """Someone else has changed the document since it was read."""


class _Local:
    def names(self, folder: str) -> list[str]:
        return os.listdir(folder) if os.path.isdir(folder) else []

    def read(self, path: str) -> str | None:
        return Path(path).read_text(encoding="utf-8") if os.path.exists(path) else None

    def write(self, path: str, text: str) -> None:
        os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
        with open(path, "w", encoding="utf-8") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())

    def claim(self, source: str, target: str) -> bool:
        try:
            os.link(source, target)
        except FileExistsError:
            return False
        finally:
            os.remove(source)
        return True

    def replace(self, source: str, target: str) -> None:
        os.replace(source, target)

    def remove(self, path: str) -> None:
        if os.path.exists(path):
            os.remove(path)


class _Hadoop:
    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.gateway = spark._jvm, spark.sparkContext._gateway
        self.fs = self.jvm.org.apache.hadoop.fs
        place = self.fs.Path(path)
        self.at = place.getFileSystem(spark._jsc.hadoopConfiguration())
        self.context = self.fs.FileContext.getFileContext(self.at.getUri(), spark._jsc.hadoopConfiguration())

    def names(self, folder: str) -> list[str]:
        place = self.fs.Path(folder)
        return [s.getPath().getName() for s in self.at.listStatus(place)] if self.at.exists(place) else []

    def read(self, path: str) -> str | None:
        place = self.fs.Path(path)
        if not self.at.exists(place):
            return None
        stream = self.at.open(place)
        try:
            return bytes(stream.readAllBytes()).decode("utf-8")
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        stream = self.at.create(self.fs.Path(path), True)
        try:
            stream.write(bytearray(text.encode("utf-8")))
        finally:
            stream.close()

    def _rename(self, source: str, target: str, how: str) -> None:
        kind = getattr(self.fs, "Options$Rename")
        options = self.gateway.new_array(kind, 1)
        options[0] = getattr(kind, how)
        self.context.rename(self.fs.Path(source), self.fs.Path(target), options)

    def claim(self, source: str, target: str) -> bool:
        try:
            self._rename(source, target, "NONE")
        except Exception as e:  # noqa: BLE001
            self.remove(source)
            java = getattr(e, "java_exception", None)
            if java is None or java.getClass().getSimpleName() != "FileAlreadyExistsException":
                raise
            return False
        return True

    def replace(self, source: str, target: str) -> None:
        self._rename(source, target, "OVERWRITE")

    def remove(self, path: str) -> None:
        self.at.delete(self.fs.Path(path), False)


def _store(path: str, spark: SparkSession | None):
    return _Local() if spark is None else _Hadoop(spark, path)


def _versions(store, path: str) -> list[int]:
    return sorted(int(n[:-5]) for n in store.names(f"{path}.versions") if re.fullmatch(r"\d+\.json", n))


def read(path: str, spark: SparkSession | None = None) -> tuple[dict | None, int]:
    """The document (None if there is none) and its version (0: not written here)."""
    store = _store(path, spark)
    while found := _versions(store, path):
        text = store.read(f"{path}.versions/{found[-1]}.json")
        if text is not None:  # else it was removed as an old one meanwhile
            return json.loads(text), found[-1]
    text = store.read(path)
    return (None, 0) if text is None else (json.loads(text), 0)


def write(document: dict, path: str, version: int, spark: SparkSession | None = None) -> int:
    """Writes what was made of that version as the next one, and gives its number; a conflict if there is a later one."""
    store, text = _store(path, spark), json.dumps(document, indent=2, ensure_ascii=False)
    found = _versions(store, path)
    new, temporary = version + 1, f"{path}.versions/_{uuid.uuid4().hex}"
    if found and found[-1] != version:
        raise StateConflict(f"{path}: version {found[-1]} is there, not {version}")
    store.write(temporary, text)
    if not store.claim(temporary, f"{path}.versions/{new}.json"):
        raise StateConflict(f"{path}: version {new} has just been written")
    copy = f"{path}.versions/_{uuid.uuid4().hex}"
    store.write(copy, text)
    store.replace(copy, path)
    for old in found[: -KEPT + 1]:
        store.remove(f"{path}.versions/{old}.json")
    return new


def replace(text: str, path: str, spark: SparkSession | None = None) -> None:
    """Writes a text whole or not at all."""
    store, temporary = _store(path, spark), f"{path}.{uuid.uuid4().hex}.tmp"
    store.write(temporary, text)
    store.replace(temporary, path)
