"""Files of any Hadoop file system: texts kept in versions (manifests), and copies."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession) -> None:
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self._conf), p

    # kept texts: each write adds a numbered version and the newest counts, so there is never a moment without one

    def _versions(self, path: str) -> list[str]:
        folder, _, name = path.rpartition("/")
        return [n for n in self.names(folder) if n.startswith(f"{name}.") and n[len(name) + 1 :].isdigit()]

    def kept(self, folder: str) -> list[str]:
        """Names of the texts in a folder, without their versions."""
        return sorted({n.rpartition(".")[0] for n in self.names(folder) if n.rpartition(".")[2].isdigit()})

    def has(self, path: str) -> bool:
        return bool(self._versions(path))

    def read(self, path: str) -> str:
        folder = path.rpartition("/")[0]
        fs, p = self._at(f"{folder}/{self._versions(path)[-1]}")
        s = fs.open(p)
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(s)).decode()
        finally:
            s.close()

    def write(self, path: str, text: str) -> None:
        """The next version, written aside and renamed to its number; the one before stays for readers that hold it."""
        folder, _, name = path.rpartition("/")
        old = self._versions(path)
        n = int(old[-1].rpartition(".")[2]) + 1 if old else 1
        aside = f"{folder}/_{name}-{uuid.uuid4().hex}"
        fs, p = self._at(aside)
        out = fs.create(p, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        to = self._at(f"{path}.{n:012d}")[1]
        if fs.exists(to) or not fs.rename(p, to):
            fs.delete(p, False)
            raise RuntimeError(f"another writer was faster: {path}")
        for v in old[:-1]:
            self.delete(f"{folder}/{v}")

    # files

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def names(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def parquet(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return sorted(s.getPath().toString() for s in fs.listStatus(p) if s.getPath().getName().endswith(".parquet")) if fs.exists(p) else []

    def state(self, path: str) -> tuple[int, int]:
        """Length and time of the last change."""
        fs, p = self._at(path)
        s = fs.getFileStatus(p)
        return s.getLen(), s.getModificationTime()

    def size(self, path: str) -> int:
        fs, p = self._at(path)
        return fs.getContentSummary(p).getLength() if fs.exists(p) else 0

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def copy(self, a: str, b: str) -> None:
        fs, p = self._at(a)
        to, q = self._at(b)
        self._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, p, to, q, False, True, self._conf)

    def move(self, a: str, b: str) -> None:
        fs, p = self._at(a)
        fs.rename(p, self._at(b)[1])
