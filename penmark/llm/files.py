"""Binary files in the shared folder, written and read inside tasks.

Paths are URIs that pyarrow knows (file, hdfs, s3, gs). A file is written
under a name of its own attempt and moved into place when complete, so a
retried or speculative task leaves either nothing or the same whole file.
"""

from __future__ import annotations

import posixpath
import uuid

from pyarrow import fs


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    if "://" not in uri and uri.startswith("/"):
        uri = f"file://{uri}"
    elif uri.startswith("file:/") and not uri.startswith("file://"):
        uri = f"file://{uri[5:]}"
    return fs.FileSystem.from_uri(uri)


def make_folder(uri: str) -> str:
    at, path = open_fs(uri)
    at.create_dir(path, recursive=True)
    return uri


class NewFile:
    """A file that appears under its name only when ``close`` has run."""

    def __init__(self, folder: str, name: str):
        self.fs, root = open_fs(folder)
        self.path = posixpath.join(root, name)
        self.own = posixpath.join(root, f"_{name}.{uuid.uuid4().hex}")
        self.out = self.fs.open_output_stream(self.own)
        self.at = 0

    def write(self, data: bytes) -> int:
        """Append; returns the offset at which the data begin."""
        start = self.at
        self.out.write(data)
        self.at += len(data)
        return start

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.own, self.path)

    def drop(self) -> None:
        self.out.close()
        self.fs.delete_file(self.own)
