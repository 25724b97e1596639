"""Small named notes in a folder, each written once: what a store's state is, decided by who writes the next note first.

On a local file system a note is made with an exclusive open; elsewhere with Hadoop's create without overwriting, which HDFS and
stores with conditional writes do atomically. Data is written beforehand, in folders that only a note makes visible, so a
writer that dies leaves a folder that nobody reads, and of two writers of one note one learns that it came second."""

from __future__ import annotations

import contextlib
import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Notes:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        local = self.folder.removeprefix("file:")
        self.local = ("/" + local.lstrip("/") if self.folder.startswith("file:") else local) if ":" not in local.split("/", 1)[0] and self._is_local() else None

    def _jvm_path(self, name: str = ""):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def _file_system(self):
        return self._jvm_path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _is_local(self) -> bool:
        return self._file_system().getUri().getScheme() == "file"

    def put(self, name: str, text: str) -> bool:
        """Writes the note unless there is one of that name; says whether this call wrote it."""
        if self.local is not None:
            os.makedirs(self.local, exist_ok=True)
            draft = f"{self.local}/.{name}-{uuid.uuid4().hex}"
            with open(draft, "w", encoding="utf-8") as f:
                f.write(text)
            try:
                os.link(draft, f"{self.local}/{name}")  # a note is whole as soon as it is there
            except FileExistsError:
                return False
            finally:
                os.remove(draft)
            return True
        files = self._file_system()
        if files.exists(self._jvm_path(name)):
            return False
        try:
            out = files.create(self._jvm_path(name), False)
        except Exception:
            if files.exists(self._jvm_path(name)):
                return False
            raise
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        return True

    def get(self, name: str) -> str | None:
        if self.local is not None:
            with contextlib.suppress(FileNotFoundError), open(f"{self.local}/{name}", encoding="utf-8") as f:
                return f.read()
            return None
        if not self._file_system().exists(self._jvm_path(name)):
            return None
        return self.spark.read.option("wholetext", True).text(f"{self.folder}/{name}").first()[0]

    def names(self) -> list[str]:
        if self.local is not None:
            return sorted(n for n in (os.listdir(self.local) if os.path.isdir(self.local) else []) if n[0] not in "._")
        files = self._file_system()
        found = files.listStatus(self._jvm_path()) if files.exists(self._jvm_path()) else []
        return sorted(n for n in (f.getPath().getName() for f in found) if n[0] not in "._")


class Versions:
    """A table in versions: note number n names the folder of version n."""

    def __init__(self, spark: SparkSession, root: str, first: Callable[[], tuple[int, str | None]] | None = None):
        """first: the version to begin with where there is no note, (0, None) unless given."""
        self.spark, self.root = spark, root.rstrip("/")
        self.notes, self.first = Notes(spark, f"{self.root}/_commits"), first or (lambda: (0, None))

    def latest(self) -> tuple[int, str | None]:
        names = self.notes.names()
        return (int(names[-1]), self.notes.get(names[-1])) if names else self.first()

    def change(self, make: Callable[[str | None], DataFrame], tries: int = 10) -> int:
        """Writes make(folder of the latest version) as the next version. If another writer was first, the change is made again, to what
        that one left; after `tries` defeats it raises."""
        for _ in range(tries):
            version, folder = self.latest()
            new = f"v{version + 1}-{uuid.uuid4().hex}"
            make(folder).write.parquet(f"{self.root}/{new}")
            if self.notes.put(f"{version + 1:020d}", new):
                return version + 1
        raise RuntimeError(f"{tries} changes of {self.root} were overtaken by others")


def get_or_make(spark: SparkSession, root: str, key: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table stored under a key; if there is none, make() is stored, or, if another writer was faster, what that one stored is read."""
    notes = Notes(spark, f"{root.rstrip('/')}/_stored")
    folder = notes.get(key)
    if folder is None:
        own = f"{key}-{uuid.uuid4().hex}"
        make().write.parquet(f"{root.rstrip('/')}/{own}")
        folder = own if notes.put(key, own) else notes.get(key)
    return spark.read.parquet(f"{root.rstrip('/')}/{folder}")
