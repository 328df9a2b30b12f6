"""Numbered commits in a folder: each number is taken once, by whichever writer comes first."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession


class CommitLog:
    """Commits 0, 1, 2 and on under `root`, each a short text that names what was committed.

    A commit is a file that appears whole and only if there is none: its text is written aside and then linked (on a
    mounted file system) or renamed (on a store whose rename refuses an existing target, as HDFS does) to its name. Only
    the driver writes commits."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._folder = spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/commits")
        self._fs = self._folder.getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(self._folder, name)

    def numbers(self) -> list[int]:
        """The numbers that are taken, in order."""
        if not self._fs.exists(self._folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._folder)]
        return sorted(int(n) for n in names if n.isdigit())

    def newest(self) -> int | None:
        return max(self.numbers(), default=None)

    def read(self, number: int) -> str | None:
        """What was committed under a number, if it is taken."""
        path = self._path(f"{number:020d}")
        if not self._fs.exists(path):
            return None
        stream = self._fs.open(path)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def put(self, number: int, text: str) -> bool:
        """Takes the number, unless another writer has it; tells whether it did."""
        if not 0 <= number < 10**20:
            raise ValueError(f"{number} is no number of a commit")
        aside, final = self._path(f".aside-{uuid.uuid4().hex}"), self._path(f"{number:020d}")
        self._fs.mkdirs(self._folder)
        out = self._fs.create(aside, False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        try:
            if self._fs.getScheme() == "file":
                os.link(aside.toUri().getPath(), final.toUri().getPath())
                return True
            return not self._fs.exists(final) and self._fs.rename(aside, final)
        except FileExistsError:
            return False
        finally:
            self._fs.delete(aside, False)
