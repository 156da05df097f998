"""Names of files as Column expressions: what ``storage`` does for one name, for a column of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def base(path: Column) -> Column:
    return F.regexp_extract(path, "[^/]*$", 0)


def stem(path: Column) -> Column:
    """The name without folders and its last ending; a name that begins with its only dot is whole."""
    return F.regexp_replace(base(path), "^(.+)[.][^.]*$", "$1")


def suffix(path: Column) -> Column:
    return F.substring(base(path), F.length(stem(path)) + 1, F.length(path))


def portable(path: Column, root: str) -> Column:
    """A path below ``root`` relative to it, any other as it is, with forward slashes."""
    whole, top = F.translate(path, "\\", "/"), root.rstrip("/") + "/"
    return F.when(whole.startswith(top), F.substring(whole, len(top) + 1, F.length(whole))).otherwise(whole)
