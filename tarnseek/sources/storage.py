"""Small files and folders next to tables, on whatever file system the path names."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from functools import cache

from pyspark.sql import SparkSession

from tarnseek.errors import TarnseekError


class Folder:
    """A folder seen through the Hadoop file system API of the session."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")

    def _at(self, name: str = ""):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        conf = self.spark._jsc.hadoopConfiguration()
        return path.getFileSystem(conf), path

    def child(self, name: str) -> Folder:
        return Folder(self.spark, f"{self.path}/{name}")

    def exists(self, name: str = "") -> bool:
        fs, path = self._at(name)
        return fs.exists(path)

    def names(self) -> list[str]:
        """Entries of the folder, without checksum and hidden files."""
        return [name for name, _ in self.entries()]

    def entries(self) -> list[tuple[str, float]]:
        """(name, time of last change in seconds) of each entry."""
        fs, path = self._at()
        if not fs.exists(path):
            return []
        found = [(s.getPath().getName(), s.getModificationTime() / 1000) for s in fs.listStatus(path)]
        return sorted(e for e in found if not e[0].startswith((".", "_tmp", "_SUCCESS")))

    def put_new(self, name: str, text: str = "") -> bool:
        """Write a small file that must not exist yet; False if it does."""
        fs, path = self._at(name)
        if fs.exists(path):
            return False
        _, draft = self._at(f"_tmp-{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(text.encode("utf-8")))
        out.close()
        if fs.rename(draft, path):
            return True
        fs.delete(draft, False)
        return False

    def now(self) -> float:
        """The time in seconds by the clock of the file system, from a small file that goes again."""
        fs, path = self._at(f"_tmp-{uuid.uuid4().hex}")
        fs.create(path, False).close()
        at = fs.getFileStatus(path).getModificationTime() / 1000
        fs.delete(path, False)
        return at

    def text(self, name: str) -> str:
        fs, path = self._at(name)
        stream = fs.open(path)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def remove(self) -> None:
        fs, path = self._at()
        fs.delete(path, True)


@cache
def _own_folder() -> str:
    path = tempfile.mkdtemp(prefix="tarnseek-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def work_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder for written intermediate tables.

    It lies in the shared folder the cluster names in ``spark.checkpoint.dir``.
    Only a session that runs in one process, and has no such setting, uses a temporary
    folder, which goes when the process ends.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise TarnseekError("set spark.checkpoint.dir to a folder all executors share")
        shared = _own_folder()
    return f"{shared.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
