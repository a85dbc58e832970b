"""Small files below a shared folder, on any file system that pyarrow opens."""

from __future__ import annotations

import uuid

from pyarrow import fs


class Files:
    def __init__(self, path: str):
        self.fs, self.path = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)

    def writing(self, name: str):
        full = f"{self.path}/{name}"
        self.fs.create_dir(full.rsplit("/", 1)[0], recursive=True)
        return self.fs.open_output_stream(full)

    def read(self, name: str) -> bytes | None:
        """The file's bytes; None if there is none."""
        try:
            with self.fs.open_input_stream(f"{self.path}/{name}") as f:
                return f.read()
        except FileNotFoundError:
            return None

    def exists(self, name: str) -> bool:
        return self.fs.get_file_info(f"{self.path}/{name}").type != fs.FileType.NotFound

    def names(self, folder: str) -> list[str]:
        """Names in a folder, in order; none if there is no such folder."""
        found = self.fs.get_file_info(fs.FileSelector(f"{self.path}/{folder}", allow_not_found=True))
        return sorted(f.base_name for f in found)

    def place(self, name: str, content: bytes) -> None:
        """The file as a whole: written beside, then moved."""
        beside = f"{name}.{uuid.uuid4().hex}.tmp"
        with self.writing(beside) as f:
            f.write(content)
        self.fs.move(f"{self.path}/{beside}", f"{self.path}/{name}")

    def remove(self, name: str) -> None:
        if self.exists(name):
            self.fs.delete_file(f"{self.path}/{name}")
