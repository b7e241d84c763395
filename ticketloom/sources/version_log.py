"""Versions of a store: small files that name what belongs to a version, each published whole and once."""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

_NAME = re.compile(r"(\d{20})\.json")


class VersionTaken(Exception):
    """Another writer has published the version first."""


class SharedFiles:
    """The few calls on the cluster's file systems that need no Spark job."""

    def __init__(self, spark: SparkSession):
        self._jvm = spark._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._no_options = spark.sparkContext._gateway.new_array(
            getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 0
        )

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def _system(self, path: str):
        return self._path(path).getFileSystem(self._conf)

    def names(self, folder: str) -> dict[str, int]:
        """Names in a folder with the time of their last change in milliseconds; none without the folder."""
        system, path = self._system(folder), self._path(folder)
        if not system.exists(path):
            return {}
        return {s.getPath().getName(): s.getModificationTime() for s in system.listStatus(path)}

    def text(self, path: str) -> str:
        stream = self._system(path).open(self._path(path))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, path: str, text: str) -> None:
        """A new file with the text, visible only when it is whole; FileExistsError if there is one."""
        hidden = f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}"
        stream = self._system(path).create(self._path(hidden))
        stream.write(bytearray(text.encode()))
        stream.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._system(path).getUri(), self._conf)
        try:
            # Without the option to overwrite a rename fails where the name is taken.
            context.rename(self._path(hidden), self._path(path), self._no_options)
        except Py4JJavaError as error:
            self.delete(hidden)
            if "FileAlreadyExists" in error.java_exception.getClass().getName():
                raise FileExistsError(path) from None
            raise

    def delete(self, path: str) -> None:
        self._system(path).delete(self._path(path), True)


@dataclass(frozen=True)
class Load:
    """What one load added: its folder's name, the months in it, its rows, and the buckets it was written in, which
    the version holds."""

    name: str
    rows: int
    months: tuple[str, ...]
    buckets: int | None = field(default=None, compare=False)


@dataclass(frozen=True)
class Version:
    """The loads of a version, and per stream the last batch that it holds, with the rows that batch added."""

    number: int = 0
    buckets: int | None = None
    loads: tuple[Load, ...] = ()
    streams: dict[str, tuple[int, int]] = field(default_factory=dict)

    def json(self) -> str:
        loads = [[load.name, load.rows, list(load.months)] for load in self.loads]
        return json.dumps({"buckets": self.buckets, "loads": loads, "streams": self.streams})

    @classmethod
    def of(cls, number: int, text: str) -> "Version":
        found = json.loads(text)
        loads = tuple(Load(name, rows, tuple(months)) for name, rows, months in found["loads"])
        return cls(number, found["buckets"], loads, {s: tuple(b) for s, b in found["streams"].items()})


class VersionLog:
    """The versions of a store in one folder, numbered from 1; version 0 is empty.

    `kind` says what a version holds: it has a number and `json`, and `of` reads what that gave.
    """

    def __init__(self, files: SharedFiles, folder: str, kind=Version):
        self.files, self.folder, self.kind = files, folder, kind

    def numbers(self) -> list[int]:
        found = map(_NAME.fullmatch, self.files.names(self.folder))
        return sorted(int(m[1]) for m in found if m)

    def _file(self, number: int) -> str:
        return f"{self.folder}/{number:020d}.json"

    def at(self, number: int):
        return self.kind.of(number, self.files.text(self._file(number))) if number else self.kind()

    def latest(self):
        numbers = self.numbers()
        return self.at(numbers[-1] if numbers else 0)

    def publish(self, version) -> None:
        """Makes the version the latest one; VersionTaken if another writer has taken its number."""
        try:
            self.files.publish(self._file(version.number), version.json())
        except FileExistsError:
            raise VersionTaken(version.number) from None

    def forget(self, number: int) -> None:
        self.files.delete(self._file(number))
