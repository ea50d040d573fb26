"""Files that tasks write and read in the shared folder, through Arrow's file systems.

A task writes to a name that holds its partition and attempt, and the job's result names the files of
the attempts that succeeded. An attempt that was lost or repeated leaves a file that nothing refers to.
"""

from __future__ import annotations

from pyarrow import fs
from pyspark import TaskContext


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder or file, from a URI or an absolute path."""
    return fs.FileSystem.from_uri(uri)


def attempt_name(suffix: str) -> str:
    context = TaskContext.get()
    return f"part-{context.partitionId():06d}-{context.taskAttemptId()}{suffix}"


class Reader:
    """Random access to the files of a folder; keeps the last file open."""

    def __init__(self, folder: str):
        self.fs, self.root = open_fs(folder)
        self.name, self.file = None, None

    def read(self, name: str, offset: int, length: int) -> memoryview:
        if name != self.name:
            self.close()
            self.name, self.file = name, self.fs.open_input_file(f"{self.root}/{name}")
        return memoryview(self.file.read_at(length, offset))

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
            self.file = None
