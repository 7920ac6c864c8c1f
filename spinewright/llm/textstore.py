"""Texts in files of the shared folder, read again by place.

A task appends compressed texts to a file of its own and names the place of
each in the rows that it returns; later tasks read only the texts that they
need. Whole texts are so never shuffled. A task that is run again writes a new
file, and the rows that count name only files that are complete.
"""

from __future__ import annotations

import uuid
from collections import OrderedDict

import zstandard
from pyarrow import fs


class StoreWriter:
    def __init__(self, folder: str):
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        self.name = uuid.uuid4().hex
        self.out = store.open_output_stream(f"{root}/{self.name}", compression=None)
        self.tool, self.at = zstandard.ZstdCompressor(level=1), 0

    def add(self, raw) -> str:
        """The place of a text: file, start and length."""
        data = self.tool.compress(raw)
        place = f"{self.name}:{self.at}:{len(data)}"
        self.out.write(data)
        self.at += len(data)
        return place

    def close(self) -> None:
        self.out.close()


class StoreReader:
    """Reads texts by place, with the last few files open."""

    def __init__(self, folder: str, files: int = 64):
        self.store, self.root = fs.FileSystem.from_uri(folder)
        self.tool, self.open, self.files = zstandard.ZstdDecompressor(), OrderedDict(), files

    def get(self, place: str) -> bytes:
        name, at, n = place.split(":")
        f = self.open.get(name)
        if f is None:
            if len(self.open) >= self.files:
                self.open.popitem(last=False)[1].close()
            f = self.open[name] = self.store.open_input_file(f"{self.root}/{name}")
        self.open.move_to_end(name)
        f.seek(int(at))
        return self.tool.decompress(f.read(int(n)))

    def close(self) -> None:
        while self.open:
            self.open.popitem()[1].close()
