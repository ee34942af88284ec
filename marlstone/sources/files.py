"""Small files that are replaced as a whole, and folders that one process at a time may write."""

from __future__ import annotations

import contextlib
import fcntl
import json
import os
import uuid
from collections.abc import Iterator
from pathlib import Path

from marlstone.model import EngineError


def sync_folder(folder: Path) -> None:
    handle = os.open(folder, os.O_RDONLY)
    try:
        os.fsync(handle)
    finally:
        os.close(handle)


def replace_json(path: Path, value) -> None:
    """Write ``value`` so that a reader sees the old file or the new one, also after a crash."""
    temporary = path.with_name(f".{path.name}-{uuid.uuid4()}.tmp")
    with open(temporary, "x") as f:
        json.dump(value, f, sort_keys=True, indent=1)
        f.flush()
        os.fsync(f.fileno())
    os.replace(temporary, path)
    sync_folder(path.parent)


def refuse_link(path: Path) -> None:
    if path.is_symlink():
        raise EngineError("unsafe_path", f"{path.name} must not be a symbolic link")


@contextlib.contextmanager
def locked(path: Path, exclusive: bool, busy: str) -> Iterator[None]:
    """An advisory lock that isn't waited for; ``busy`` is the code of the error if another holds it."""
    handle = take_lock(path, exclusive, busy)
    try:
        yield
    finally:
        os.close(handle)


def take_lock(path: Path, exclusive: bool, busy: str) -> int:
    refuse_link(path)
    handle = os.open(path, os.O_RDWR | os.O_CREAT, 0o600)
    try:
        fcntl.flock(handle, (fcntl.LOCK_EX if exclusive else fcntl.LOCK_SH) | fcntl.LOCK_NB)
    except BlockingIOError as e:
        os.close(handle)
        raise EngineError(busy, f"{path.name} is held by another process") from e
    return handle
