"""Files by path or URI from any task, for formats that Spark doesn't write itself.

A path without a scheme, or of `file:`, must be a folder that the driver and all executors mount; other schemes (such as
hdfs, s3 and gs) are read and written through the file systems that pyarrow brings.
"""

from __future__ import annotations

import os

from pyarrow import fs


def locate(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if "://" not in path:
        return fs.LocalFileSystem(), os.path.abspath(path)
    return fs.FileSystem.from_uri(path)


def open_input(path: str):
    """A seekable file."""
    system, at = locate(path)
    return system.open_input_file(at)


def is_file(path: str) -> bool:
    system, at = locate(path)
    return system.get_file_info(at).type == fs.FileType.File


def names(path: str) -> list[str]:
    """Base names of the files of a folder, sorted; none where the folder is missing."""
    system, at = locate(path)
    return sorted(f.base_name for f in system.get_file_info(fs.FileSelector(at, allow_not_found=True)) if f.type == fs.FileType.File)


def write_bytes(path: str, data: bytes) -> None:
    """SNK7: a file that is there whole or not at all: written beside its place, its size checked, then moved there."""
    system, at = locate(path)
    system.create_dir(os.path.dirname(at), recursive=True)
    part = f"{at}.{os.getpid()}-{os.urandom(4).hex()}.part"
    with system.open_output_stream(part) as out:
        out.write(data)
    if system.get_file_info(part).size != len(data):
        raise OSError(f"{part} is incomplete")
    system.move(part, at)
