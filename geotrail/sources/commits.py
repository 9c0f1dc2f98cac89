"""Stored tables whose parts change in whole commits."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import SparkSession


class CommitLog:
    """Commits of a table: small files named by number, each with the live version of each of its parts."""

    #: Commits that stay, for readers that have begun with an earlier one.
    KEPT = 3

    def __init__(self, spark: SparkSession, home: str):
        self.jvm = spark._jvm
        self.home = self.path(home)
        self.files = self.home.getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, *names):
        return self.jvm.org.apache.hadoop.fs.Path(*names)

    def numbers(self) -> list[int]:
        found = self.files.globStatus(self.path(self.home, "*.json")) or ()
        return sorted(int(f.getPath().getName().removesuffix(".json")) for f in found)

    def last(self) -> int | None:
        return max(self.numbers(), default=None)

    def read(self, before: int | None = None) -> dict[str, int]:
        """The live versions by the last commit, or by the last before a number."""
        known = [n for n in self.numbers() if before is None or n < before]
        if not known:
            return {}
        stream = self.files.open(self.path(self.home, f"{known[-1]}.json"))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def write(self, number: int, live: dict[str, int]) -> None:
        """Written aside and renamed, so that a commit is there as a whole or not at all."""
        aside = self.path(self.home, f"_{number}.new")
        stream = self.files.create(aside, True)
        try:
            stream.write(bytearray(json.dumps(live, sort_keys=True).encode()))
        finally:
            stream.close()
        if not self.files.rename(aside, self.path(self.home, f"{number}.json")):
            raise OSError(f"commit {number} wasn't written")

    def drop(self, folder: Callable[[str, int], str]) -> None:
        """Deletes the commits that are no longer kept, and the folders of versions that only they name."""
        known = self.numbers()
        named = {part for n in known[-self.KEPT :] for part in self.read(before=n + 1).items()}
        for n in known[: -self.KEPT]:
            for part in self.read(before=n + 1).items():
                if part not in named:
                    self.files.delete(self.path(folder(*part)), True)
            self.files.delete(self.path(self.home, f"{n}.json"), False)
