"""Readers and writers of text formats, by (extension, kind); others plug in by register()."""

from __future__ import annotations

from collections.abc import Callable

READERS: dict[tuple[str, str], Callable] = {}


def register(extension: str, kind: str) -> Callable:
    """Add a reader (spark, path) for files of an extension and a kind of content."""

    def put(f: Callable) -> Callable:
        READERS[extension.lower(), kind] = f
        return f

    return put


def reader(path: str, kind: str) -> Callable:
    extension = path.rpartition(".")[2].lower()
    if (extension, kind) not in READERS:
        raise ValueError(f"no reader for {kind} in .{extension} files; register() one")
    return READERS[extension, kind]
