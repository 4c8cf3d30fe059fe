"""Plain files in the shared folder, written and read by executors through pyarrow's file systems.

A file gets its final name by a rename after it is complete, and the name depends on partition and number alone: a task that
runs again, or twice at once, leaves the same file.
"""

from __future__ import annotations

import uuid

from pyarrow import fs


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def put(uri: str, name: str, parts: list[bytes]) -> None:
    system, folder = open_folder(uri)
    system.create_dir(folder, recursive=True)
    draft = f"{folder}/.{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(draft) as out:
        for part in parts:
            out.write(part)
    try:
        system.move(draft, f"{folder}/{name}")
    except OSError:  # stores that refuse to replace: another attempt has left the same file
        if system.get_file_info(f"{folder}/{name}").type != fs.FileType.File:
            raise
        system.delete_file(draft)


def read_range(uri: str, name: str, start: int = 0, length: int | None = None) -> bytes:
    system, folder = open_folder(uri)
    with system.open_input_file(f"{folder}/{name}") as f:
        return f.read_at(f.size() - start if length is None else length, start)
