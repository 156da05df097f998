"""Files in the shared folder, written and read by executors through Arrow's file systems."""

from __future__ import annotations

import uuid

from pyarrow import fs


def resolve(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def make_folder(uri: str) -> str:
    system, path = resolve(uri)
    system.create_dir(path, recursive=True)
    return uri


def fresh(folder: str, stem: str, ending: str) -> str:
    """A name no other attempt of a task uses. Only files that a finished task reports count."""
    return f"{folder}/{stem}-{uuid.uuid4().hex}{ending}"


def local_path(uri: str) -> str | None:
    """The path of a file that the operating system can open, if it is one."""
    system, path = resolve(uri)
    return path if isinstance(system, fs.LocalFileSystem) else None


def remove_folder(uri: str) -> None:
    system, path = resolve(uri)
    system.delete_dir(path)
