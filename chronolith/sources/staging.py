"""Files that are written beside their place and moved into it: what Python data sources share.

Paths are those that pyarrow's file systems open (local, file:, s3:, gs:, hdfs: where libhdfs is installed), from the
driver and the executors alike. A job writes into ``_staged/<job>`` under its target. Its commit first writes down all
moves (``commit.json``), then makes them, then removes the folder; ``recover`` ends a commit that was cut off and drops
what was never committed. Readers look at final names alone, so nothing half-written is ever read.
"""

from __future__ import annotations

import json
import uuid

from pyarrow import fs

STAGED = "_staged"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path inside it."""
    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path.removeprefix("file:")
    system, inner = fs.FileSystem.from_uri(path)
    return system, inner.rstrip("/")


def listed(path: str) -> list[fs.FileInfo]:
    """All files under a path (none if it isn't there) but staged ones, in no certain order."""
    system, inner = opened(path)
    found = system.get_file_info(fs.FileSelector(inner, allow_not_found=True, recursive=True))
    return [f for f in found if f.type == fs.FileType.File and f"/{STAGED}/" not in f.path[len(inner) :]]


class Stage:
    """The staging folder of one job; made on the driver and sent to its tasks."""

    def __init__(self, root: str):
        self.root, self.job = root, uuid.uuid4().hex

    @property
    def folder(self) -> str:
        return f"{opened(self.root)[1]}/{STAGED}/{self.job}"

    def file(self):
        """(path, open stream) of a new file. A task that runs twice gets other names, so neither disturbs the other."""
        system, _ = opened(self.root)
        system.create_dir(self.folder, recursive=True)
        path = f"{self.folder}/{uuid.uuid4().hex}.part"
        return path, system.open_output_stream(path)

    def commit(self, moves: list[tuple[str, str]], removed: list[str] = ()) -> None:
        """Moves files (from, to; in order) and removes others; done in full or, once written down, by ``recover``."""
        system, _ = opened(self.root)
        if moves or removed:
            system.create_dir(self.folder, recursive=True)
            with system.open_output_stream(f"{self.folder}/commit.tmp") as out:
                out.write(json.dumps({"moves": list(moves), "removed": list(removed)}).encode())
            system.move(f"{self.folder}/commit.tmp", f"{self.folder}/commit.json")
            _finish(system, self.folder)
        self.abort()

    def abort(self) -> None:
        system, _ = opened(self.root)
        if system.get_file_info(self.folder).type == fs.FileType.Directory:
            system.delete_dir(self.folder)


def _finish(system: fs.FileSystem, folder: str) -> None:
    with system.open_input_file(f"{folder}/commit.json") as file:
        plan = json.loads(file.read())
    for source, target in plan["moves"]:
        if system.get_file_info(source).type == fs.FileType.File:
            system.create_dir(target.rsplit("/", 1)[0], recursive=True)
            system.move(source, target)
    for path in plan["removed"]:
        if system.get_file_info(path).type == fs.FileType.File:
            system.delete_file(path)


def recover(root: str) -> tuple[int, int]:
    """(finished, dropped): ends commits that were cut off and drops jobs that never came to theirs.

    Call it where no job writes under ``root``.
    """
    system, inner = opened(root)
    finished = dropped = 0
    for job in system.get_file_info(fs.FileSelector(f"{inner}/{STAGED}", allow_not_found=True)):
        if system.get_file_info(f"{job.path}/commit.json").type == fs.FileType.File:
            _finish(system, job.path)
            finished += 1
        else:
            dropped += 1
        system.delete_dir(job.path)
    return finished, dropped
