"""Ranges of files, from executors: of the local file system, and of the stores that Arrow reaches by their URI."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow.fs as pafs

#: Bytes of a file that are held at a time.
CHUNK = 8 << 20


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(path)


def size_of(path: str) -> int:
    fs, at = file_system(path)
    info = fs.get_file_info(at)
    if info.type != pafs.FileType.File:
        raise FileNotFoundError(path)
    return info.size


def read_range(path: str, start: int, length: int) -> bytes:
    """Bytes of a file; fewer than asked for are an error."""
    fs, at = file_system(path)
    with fs.open_input_file(at) as f:
        out = f.read_at(length, start)
    if len(out) != length:
        raise EOFError(f"{path} ends at {start + len(out)}, before {start + length}")
    return out


def chunks(path: str, size: int = CHUNK) -> Iterator[bytes]:
    fs, at = file_system(path)
    with fs.open_input_stream(at, buffer_size=0) as f:
        while part := f.read(size):
            yield part


def digest(path: str, size: int = CHUNK) -> str:
    """SHA-256 of a file of any size, in memory of one chunk."""
    running = hashlib.sha256()
    for part in chunks(path, size):
        running.update(part)
    return running.hexdigest()


def write_file(path: str, parts: Iterator[bytes]) -> None:
    """A file written under another name and moved when it is whole."""
    fs, at = file_system(path)
    fs.create_dir(at.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(f"{at}.part") as f:
        for part in parts:
            f.write(part)
    fs.move(f"{at}.part", at)


def delete_file(path: str) -> None:
    fs, at = file_system(path)
    if fs.get_file_info(at).type == pafs.FileType.File:
        fs.delete_file(at)
