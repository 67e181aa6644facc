"""What can go wrong with an index on disk."""

from __future__ import annotations


class StoreError(Exception):
    """The base of all errors of this package."""


class ManifestCorruptionError(StoreError):
    """The manifest is no JSON of the known form."""

    def __init__(self, detail: str):
        super().__init__(f"corrupt manifest: {detail}")
        self.detail = detail


class ManifestVersionError(StoreError):
    """The manifest was written in another version of the format."""

    def __init__(self, found: object, expected: int):
        super().__init__(f"manifest version {found!r}; this library reads {expected}")
        self.found, self.expected = found, expected


class IndexLockedError(StoreError):
    """A live process holds the index."""

    def __init__(self, pid: int):
        super().__init__(f"process {pid} has this index open")
        self.pid = pid


class SegmentCorruptionError(StoreError):
    """A segment's files are missing or do not hold what the manifest says."""

    def __init__(self, region: str, detail: str = ""):
        super().__init__(f"corrupt segment, {region}" + (f": {detail}" if detail else ""))
        self.region = region


class MappingCorruptionError(StoreError):
    """The names of documents cannot be read."""

    def __init__(self, detail: str):
        super().__init__(f"corrupt document names: {detail}")
        self.detail = detail


class TokenizerMismatchError(StoreError):
    """An index is opened with another tokenizer than it was built with."""

    def __init__(self, persisted: str, runtime: str):
        super().__init__(f"the index was built with tokenizer {persisted}, not {runtime}")
        self.persisted, self.runtime = persisted, runtime


class WriteStreamError(StoreError):
    """A blob could not be written to its end."""
