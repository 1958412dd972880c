"""Files written and read by tasks in a folder that all executors share, named by URI."""

from __future__ import annotations

import uuid

from pyarrow import fs


class Folder:
    """A folder on any file system that pyarrow reaches by URI."""

    def __init__(self, uri: str):
        self.fs, self.path = fs.FileSystem.from_uri(uri)

    def create(self, name: str) -> Pending:
        """A new file under a temporary name; it appears under its own when closed."""
        return Pending(self, name)

    def open(self, name: str):
        return self.fs.open_input_file(f"{self.path}/{name}")

    def stream(self, name: str):
        return self.fs.open_input_stream(f"{self.path}/{name}", compression=None)


class Pending:
    """A file being written. A task that dies leaves only a temporary name, which nobody reads; a
    repeated task writes the same bytes and replaces the file whole."""

    def __init__(self, folder: Folder, name: str):
        self.folder, self.name, self.size = folder, name, 0
        self.folder.fs.create_dir(folder.path, recursive=True)
        self.temporary = f"{folder.path}/.{name}.{uuid.uuid4().hex}.part"
        self.out = folder.fs.open_output_stream(self.temporary, compression=None)

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def commit(self) -> str:
        self.out.close()
        self.folder.fs.move(self.temporary, f"{self.folder.path}/{self.name}")
        return self.name
