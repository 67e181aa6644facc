"""The manifest and the lock of an index: small blobs that the driver keeps."""

from __future__ import annotations

import dataclasses
import json
import os
import socket

from ..errors import IndexLockedError, ManifestCorruptionError, ManifestVersionError
from .blobs import StorageBackend

VERSION = 2
MANIFEST = "manifest.json"
LOCK = ".lock"


@dataclasses.dataclass(frozen=True)
class SegmentEntry:
    """One live segment; ``docs`` and ``total_len`` count what it was written with.

    ``checks``: a checksum for each table.  ``terms`` and ``postings_bytes``: distinct terms, and the size of the postings' files.
    """

    id: str
    docs: int
    total_len: int
    tier: int
    postings: int = 0
    deletes: int = 0
    terms: int = 0
    postings_bytes: int = 0
    checks: tuple[int, ...] = ()


@dataclasses.dataclass(frozen=True)
class Manifest:
    generation: int = 0
    segments: tuple[SegmentEntry, ...] = ()
    tokenizer: tuple[str, int] = ("unicode", 1)
    next_segment: int = 0
    next_num: int = 0
    #: The last batch of each stream.
    batches: tuple[tuple[str, int], ...] = ()

    @property
    def total_docs(self) -> int:
        return sum(s.docs for s in self.segments)

    @property
    def total_len(self) -> int:
        return sum(s.total_len for s in self.segments)

    def dump(self) -> bytes:
        return json.dumps({"version": VERSION} | dataclasses.asdict(self)).encode()


def load(backend: StorageBackend) -> Manifest | None:
    """The manifest, or None where there is no index yet; any other failure surfaces."""
    try:
        raw = backend.read(MANIFEST)
    except FileNotFoundError:
        return None
    try:
        held = json.loads(raw)
    except ValueError as x:
        raise ManifestCorruptionError(str(x)) from x
    if not isinstance(held, dict):
        raise ManifestCorruptionError("not an object")
    if held.get("version") != VERSION:
        raise ManifestVersionError(held.get("version"), VERSION)
    try:
        return Manifest(int(held["generation"]), tuple(SegmentEntry(**s | {"checks": tuple(s["checks"])}) for s in held["segments"]), tuple(held["tokenizer"]), int(held["next_segment"]), int(held["next_num"]), tuple((str(k), int(n)) for k, n in held["batches"]))
    except (KeyError, TypeError, ValueError) as x:
        raise ManifestCorruptionError(repr(x)) from x


def _alive(pid: int) -> bool:
    try:
        os.kill(pid, 0)
    except ProcessLookupError:
        return False
    except PermissionError:
        return True
    return True


class Lock:
    """One writer for each folder: a blob with its host and process; that of a dead process of this host is taken over."""

    def __init__(self, backend: StorageBackend):
        self.backend, self.held = backend, False

    def acquire(self) -> None:
        host = socket.gethostname()
        for _ in range(3):
            if self.backend.create(LOCK, f"{os.getpid()}@{host}".encode()):
                self.held = True
                return
            try:
                pid, _, where = self.backend.read(LOCK).decode().partition("@")
            except FileNotFoundError:
                continue
            number = int(pid) if pid.isdigit() else 0
            if number > 0 and (where not in ("", host) or _alive(number)):
                raise IndexLockedError(number)
            self.backend.delete(LOCK)
        raise IndexLockedError(0)

    def release(self) -> None:
        if self.held:
            self.held = False
            self.backend.delete(LOCK)
