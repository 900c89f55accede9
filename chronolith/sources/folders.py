"""Folders of Spark's file systems: day partitions by name, and changes that are planned, made, and ended if cut off."""

from __future__ import annotations

import json
import re
from datetime import date

from pyspark.sql import SparkSession

from chronolith.sources.staging import STAGED


class Folder:
    """A folder of Spark's file systems, and its staged jobs."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark.sparkContext._jvm
        self.path = path.rstrip("/")
        self.system = self.at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def exists(self, name: str = "") -> bool:
        return self.system.exists(self.at(name))

    def names(self, name: str = "") -> list[str]:
        return [s.getPath().getName() for s in self.system.listStatus(self.at(name))] if self.exists(name) else []

    def delete(self, name: str) -> bool:
        return self.system.delete(self.at(name), True)

    def move(self, source: str, target: str) -> None:
        self.system.mkdirs(self.at(target).getParent())
        if not self.system.rename(self.at(source), self.at(target)):
            raise OSError(f"{source} can't be moved to {target} in {self.path}")

    def days(self) -> dict[date, str]:
        """Day partitions by their folders' names; no data is read."""
        found = (re.fullmatch(r"day=(\d{4}-\d\d-\d\d)", n) for n in self.names())
        return {date.fromisoformat(m[1]): m[0] for m in found if m}

    def commit(self, job: str, moves: list[tuple[str, str]], removed: list[str]) -> None:
        """Moves staged names over others and removes some; names are those inside the folder."""
        plan = self.system.create(self.at(f"{STAGED}/{job}/plan.tmp"), True)
        plan.write(bytearray(json.dumps({"moves": moves, "removed": removed}).encode()))
        plan.close()
        self.move(f"{STAGED}/{job}/plan.tmp", f"{STAGED}/{job}/plan.json")
        self.finish(job)

    def finish(self, job: str) -> None:
        file = self.system.open(self.at(f"{STAGED}/{job}/plan.json"))
        plan = json.loads(bytes(file.readAllBytes()))
        file.close()
        for n, (source, target) in enumerate(plan["moves"]):
            if self.exists(source):
                if self.exists(target):
                    self.move(target, f"{STAGED}/{job}/old/{n}")
                self.move(source, target)
        for name in plan["removed"]:
            self.delete(name)
        self.delete(f"{STAGED}/{job}")


def recover(spark: SparkSession, path: str) -> tuple[int, int]:
    """(finished, dropped): ends changes of a table that were cut off, and drops those that had no plan yet."""
    folder = Folder(spark, path)
    finished = dropped = 0
    for job in folder.names(STAGED):
        if folder.exists(f"{STAGED}/{job}/plan.json"):
            folder.finish(job)
            finished += 1
        else:
            folder.delete(f"{STAGED}/{job}")
            dropped += 1
    return finished, dropped
