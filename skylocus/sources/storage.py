"""Files of any store that Arrow knows, by URI or local path: listing, reading, writing whole, hashing."""

from __future__ import annotations

import fnmatch
import hashlib
import posixpath
import tempfile
import uuid

from pyarrow import fs

CHUNK = 1 << 20


def scratch(spark, kind: str) -> str:
    """A fresh folder's name in the one that driver and executors share, which ``spark.checkpoint.dir`` names; one machine may use a temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        shared = tempfile.gettempdir()
    return f"{shared.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def resolve(uri: str) -> tuple[fs.FileSystem, str]:
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri)


def make_folder(uri: str) -> None:
    system, path = resolve(uri)
    system.create_dir(path, recursive=True)


def exists(uri: str) -> bool:
    system, path = resolve(uri)
    return system.get_file_info(path).type == fs.FileType.File


def read(uri: str) -> bytes:
    """A file's bytes; a missing one raises FileNotFoundError."""
    system, path = resolve(uri)
    with system.open_input_stream(path) as f:
        return f.read()


def write(uri: str, data) -> None:
    """Write a whole file under another name beside it and move it, so that readers see the old one or the new one."""
    system, path = resolve(uri)
    system.create_dir(posixpath.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.tmp"
    with system.open_output_stream(part, compression=None) as f:
        f.write(data)
    system.move(part, path)


def names(folder: str, pattern: str = "*") -> list[str]:
    """The names of a folder's files that match, sorted; a missing folder has none."""
    system, path = resolve(folder)
    found = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
    return sorted(f.base_name for f in found if f.type == fs.FileType.File and fnmatch.fnmatchcase(f.base_name, pattern))


def clean(folder: str, pattern: str) -> int:
    """Remove a folder's files that match; returns how many."""
    system, path = resolve(folder)
    old = names(folder, pattern)
    for name in old:
        system.delete_file(f"{path}/{name}")
    return len(old)


def sha256(uri: str) -> str:
    """A file's SHA-256, read some at a time."""
    system, path = resolve(uri)
    digest = hashlib.sha256()
    with system.open_input_stream(path, compression=None) as f:
        while chunk := f.read(CHUNK):
            digest.update(chunk)
    return digest.hexdigest()


def stem(name: str) -> str:
    """A file's name without folders and its last ending."""
    base = name.rpartition("/")[2]
    dot = base.rfind(".")
    return base if dot <= 0 else base[:dot]


def suffix(name: str) -> str:
    """The last ending, with its dot; none for names that begin with their only dot."""
    base = name.rpartition("/")[2]
    return base[len(stem(name)) :]


def portable(path: str, root: str) -> str:
    """A path below ``root`` relative to it, any other as it is, with forward slashes."""
    whole, base = (posixpath.normpath(p.replace("\\", "/")) for p in (path, root))
    return posixpath.relpath(whole, base) if whole == base or whole.startswith(base.rstrip("/") + "/") else whole
