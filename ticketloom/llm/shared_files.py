"""Files that are not tables, in the folder that driver and executors share (see session.scratch_dir)."""

from __future__ import annotations

from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs


def locate(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI and the path in it; a plain path is a local or mounted one."""
    if not urlsplit(uri).scheme:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def create(uri: str):
    """A stream into a new file, whose folder is made if need be."""
    system, path = locate(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    return system.open_output_stream(path)


def mapped(uri: str) -> pa.NativeFile:
    """The file for random access: memory-mapped where it is mounted, else read through its store."""
    system, path = locate(uri)
    if isinstance(system, fs.LocalFileSystem):
        return pa.memory_map(path)
    return system.open_input_file(path)
