"""Files that tasks write in parts, and that a commit puts together."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyarrow import fs

#: Bytes that a commit copies at a time.
CHUNK = 1 << 24


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address, and the path in it: local or mounted folders, HDFS, S3, GCS."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def created(path: str):
    """A new file to write to, and the folders above it."""
    system, inside = opened(path)
    if above := inside.rpartition("/")[0]:
        system.create_dir(above)
    return system.open_output_stream(inside)


class Parts:
    """A folder beside a file, for the parts that tasks write; parts of failed attempts stay there until it is deleted."""

    def __init__(self, path: str):
        self.folder = f"{path}.parts-{uuid.uuid4().hex}"

    def create(self, name: str):
        return created(f"{self.folder}/{name}")

    def append(self, names: Iterable[str], file) -> None:
        """Copies parts to the end of an open file."""
        system, folder = opened(self.folder)
        for name in names:
            with system.open_input_stream(f"{folder}/{name}") as part:
                while data := part.read(CHUNK):
                    file.write(data)

    def move(self, name: str, path: str) -> None:
        """A part becomes a file."""
        created(path).close()
        system, folder = opened(self.folder)
        system.move(f"{folder}/{name}", opened(path)[1])

    def delete(self) -> None:
        system, folder = opened(self.folder)
        if system.get_file_info(folder).type == fs.FileType.Directory:
            system.delete_dir(folder)
