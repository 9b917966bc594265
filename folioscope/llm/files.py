"""Files that tasks write into the shared folder, through any Hadoop-style URI pyarrow knows."""

from __future__ import annotations

import uuid

from pyarrow import fs


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def put(uri: str, name: str, data: bytes) -> None:
    """Writes under a temporary name, then renames: a reader sees a whole file or none.

    Names and bytes depend on the rows alone, so a repeated task replaces its own earlier file.
    """
    store, folder = open_fs(uri)
    store.create_dir(folder, recursive=True)
    temporary = f"{folder}/_temporary.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(temporary, compression=None) as f:
        f.write(data)
    store.move(temporary, f"{folder}/{name}")


def get(uri: str, name: str) -> bytes:
    store, folder = open_fs(uri)
    with store.open_input_stream(f"{folder}/{name}", compression=None) as f:
        return f.read()
