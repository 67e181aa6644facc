"""Named blobs in one flat folder, replaced atomically: on the driver's own file system, or by URI on any that Hadoop knows."""

from __future__ import annotations

import os
import re
import uuid
from pathlib import Path
from typing import Protocol

from pyspark.sql import SparkSession

from ..errors import WriteStreamError


class StorageBackend(Protocol):
    """Where manifests, names and locks live; a missing blob raises FileNotFoundError."""

    def read(self, name: str) -> bytes: ...

    def write(self, name: str, data: bytes) -> None: ...

    def append(self, name: str, data: bytes) -> None: ...

    def delete(self, name: str) -> None: ...

    def names(self, prefix: str = "") -> list[str]: ...

    def create(self, name: str, data: bytes) -> bool:
        """Writes a blob that is not there yet; False if it is."""
        ...

    def is_local(self) -> bool:
        """Whether the blobs are files of this machine."""
        ...


class BlobWriter:
    """A blob that appears when it is ended, and never if it is aborted; either can be called again."""

    def __init__(self, path: Path):
        self.path, self.part, self.open = path, path.with_name(f"{path.name}.{uuid.uuid4().hex}.tmp"), True
        self.file = self.part.open("wb")

    def write(self, data: bytes) -> None:
        if not self.open:
            raise WriteStreamError("the stream has ended")
        self.file.write(data)

    def end(self) -> None:
        if self.open:
            self.open = False
            self.file.flush()
            os.fsync(self.file.fileno())
            self.file.close()
            os.replace(self.part, self.path)
            _sync_folder(self.path.parent)

    def abort(self) -> None:
        if self.open:
            self.open = False
            self.file.close()
            self.part.unlink(missing_ok=True)


def _sync_folder(path: Path) -> None:
    handle = os.open(path, os.O_RDONLY)
    try:
        os.fsync(handle)
    finally:
        os.close(handle)


class FsBackend:
    """A folder of a file system that the driver can reach."""

    def __init__(self, folder: str | Path):
        self.folder = Path(folder)
        self.folder.mkdir(parents=True, exist_ok=True)

    def read(self, name: str) -> bytes:
        return (self.folder / name).read_bytes()

    def writer(self, name: str) -> BlobWriter:
        return BlobWriter(self.folder / name)

    def write(self, name: str, data: bytes) -> None:
        stream = self.writer(name)
        try:
            stream.write(data)
        except BaseException:
            stream.abort()
            raise
        stream.end()

    def append(self, name: str, data: bytes) -> None:
        with (self.folder / name).open("ab") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())

    def delete(self, name: str) -> None:
        (self.folder / name).unlink(missing_ok=True)

    def names(self, prefix: str = "") -> list[str]:
        if not self.folder.exists():
            return []
        return sorted(p.name for p in self.folder.iterdir() if p.is_file() and p.name.startswith(prefix))

    def create(self, name: str, data: bytes) -> bool:
        try:
            handle = os.open(self.folder / name, os.O_CREAT | os.O_EXCL | os.O_WRONLY)
        except FileExistsError:
            return False
        with os.fdopen(handle, "wb") as f:
            f.write(data)
        return True

    def is_local(self) -> bool:
        return True


class HadoopWriter:
    """As ``BlobWriter``, on a Hadoop file system: a temporary file that is renamed over the blob."""

    def __init__(self, backend: HadoopBackend, name: str):
        self.backend, self.name, self.part, self.open = backend, name, f"{name}.{uuid.uuid4().hex}.tmp", True
        self.stream = backend.fs.create(backend.path(self.part), True)

    def write(self, data: bytes) -> None:
        if not self.open:
            raise WriteStreamError("the stream has ended")
        self.stream.write(bytearray(data))

    def end(self) -> None:
        if self.open:
            self.open = False
            self.stream.hsync()
            self.stream.close()
            self.backend.replace(self.part, self.name)

    def abort(self) -> None:
        if self.open:
            self.open = False
            self.stream.close()
            self.backend.delete(self.part)


class HadoopBackend:
    """A folder named by a URI (``hdfs:``, ``s3a:``, ``file:`` and so on), reached by the session's Hadoop file systems.

    Replacing is as atomic as the file system's rename.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.jvm, self.gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.folder = folder.rstrip("/")
        self.fs = self.jvm.org.apache.hadoop.fs.Path(self.folder).getFileSystem(self.conf)
        self.fs.mkdirs(self.jvm.org.apache.hadoop.fs.Path(self.folder))

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def read(self, name: str) -> bytes:
        if not self.fs.exists(self.path(name)):
            raise FileNotFoundError(f"{self.folder}/{name}")
        stream = self.fs.open(self.path(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def writer(self, name: str) -> HadoopWriter:
        return HadoopWriter(self, name)

    def write(self, name: str, data: bytes) -> None:
        stream = self.writer(name)
        try:
            stream.write(data)
        except BaseException:
            stream.abort()
            raise
        stream.end()

    def replace(self, part: str, name: str) -> None:
        kind = self.jvm.org.apache.hadoop.fs.Options.Rename
        how = self.gateway.new_array(kind, 1)
        how[0] = kind.OVERWRITE
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path(name).toUri(), self.conf).rename(self.path(part), self.path(name), how)

    def append(self, name: str, data: bytes) -> None:
        """Not every file system appends: the blob is written anew."""
        try:
            held = self.read(name)
        except FileNotFoundError:
            held = b""
        self.write(name, held + data)

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)

    def names(self, prefix: str = "") -> list[str]:
        return sorted(n for f in self.fs.listStatus(self.path("")) if f.isFile() and (n := f.getPath().getName()).startswith(prefix))

    def create(self, name: str, data: bytes) -> bool:
        if self.fs.exists(self.path(name)):
            return False
        try:
            stream = self.fs.create(self.path(name), False)
        except Exception as x:
            if "exist" in str(x):
                return False
            raise
        stream.write(bytearray(data))
        stream.close()
        return True

    def is_local(self) -> bool:
        return self.folder.startswith("file:")


def backend_for(spark: SparkSession, folder: str | Path) -> FsBackend | HadoopBackend:
    """The backend of a folder: a path without a scheme is the driver's own."""
    return HadoopBackend(spark, str(folder)) if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", str(folder)) else FsBackend(folder)
