"""Files that tasks write to and read from the shared folder by themselves."""

from __future__ import annotations

import uuid
from urllib.parse import unquote, urlparse

import numpy as np
from pyarrow import fs


def located(uri: str) -> tuple[fs.FileSystem, str]:
    parsed = urlparse(uri)
    if parsed.scheme in ("", "file"):
        return fs.LocalFileSystem(), unquote(parsed.path)
    return fs.FileSystem.from_uri(uri)


def new_name(folder: str, stem: str) -> str:
    """A name of its own for each attempt: what a lost or repeated task has left is never read."""
    return f"{folder}/{stem}-{uuid.uuid4().hex}"


def create(uri: str):
    store, path = located(uri)
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return store.open_output_stream(path, compression=None)


#: Bytes read at once where the folder is not mounted, and how many such blocks a task keeps of an array.
BLOCK, KEPT = 1 << 18, 64
#: Arrays up to so many bytes are read whole.
SMALL = 1 << 12


class Blocks:
    """An array in a file that is read block by block, as places of it are asked for."""

    def __init__(self, uri: str, kind: str, at: int, n: int):
        self.uri, self.kind, self.at, self.n, self.held = uri, np.dtype(kind), at, n, {}

    def __len__(self) -> int:
        return self.n

    def _read(self, block: int) -> np.ndarray:
        if block not in self.held:
            while len(self.held) >= KEPT:
                del self.held[next(iter(self.held))]
            size, begin = self.kind.itemsize, block * BLOCK
            store, path = located(self.uri)
            with store.open_input_file(path) as file:
                raw = file.read_at(min(BLOCK, self.n * size - begin), self.at + begin)
            self.held[block] = np.frombuffer(raw, self.kind)
        return self.held[block]

    def __getitem__(self, places: np.ndarray) -> np.ndarray:
        out = np.empty(len(places), self.kind)
        each = BLOCK // self.kind.itemsize
        blocks = places // each
        for block in np.unique(blocks).tolist():
            own = np.flatnonzero(blocks == block)
            out[own] = self._read(block)[places[own] - block * each]
        return out


def mapped(uri: str) -> np.ndarray:
    """The bytes of a file: mapped where the folder is mounted, else read."""
    store, path = located(uri)
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(path, np.uint8, "r")
    with store.open_input_file(path) as file:
        return np.frombuffer(file.read(), np.uint8)


def is_mounted(uri: str) -> bool:
    return isinstance(located(uri)[0], fs.LocalFileSystem)


def arrays(uri: str, layout: dict[str, list]) -> dict:
    """The arrays of a file by name, of (kind, first byte, length) each: mapped where the folder is mounted,
    else read as they are used."""
    full = {name: spec for name, spec in layout.items() if spec[2]}
    out = {name: np.empty(0, kind) for name, (kind, _, _) in layout.items()}
    if full and is_mounted(uri):
        raw = mapped(uri)
        return out | {name: np.asarray(raw[at : at + n * np.dtype(kind).itemsize]).view(kind) for name, (kind, at, n) in full.items()}
    for name, (kind, at, n) in full.items():
        lazy = Blocks(uri, kind, at, n)
        out[name] = lazy if n * lazy.kind.itemsize > SMALL else lazy[np.arange(n)]
    return out
