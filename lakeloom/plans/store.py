"""Versioned folders: staged files become visible by the exclusive creation of one small commit file."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import SparkSession


#: Schemes of file systems on which one of several writers of a name wins.
EXCLUSIVE = frozenset({"file", "hdfs", "viewfs", "abfs", "abfss"})


class Conflict(Exception):
    """Another writer published the version first."""


class Files:
    """The few file operations that metadata needs, through Hadoop's file systems (local, HDFS or object stores)."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf, self.gateway = spark._jvm, spark._jsc.hadoopConfiguration(), spark.sparkContext._gateway

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def create(self, path: str, text: str) -> bool:
        """Creates the file unless it is there; False if it is. Written whole before it appears under its name.

        Of several writers exactly one wins: locally by a hard link, on HDFS and hierarchical stores by a rename that
        refuses an existing target. Stores whose rename copies, or whose create looks first, can't promise that and are refused.
        """
        fs, p = self._at(path)
        scheme = fs.getScheme()
        if scheme not in EXCLUSIVE:
            raise NotImplementedError(f"commits need a file system with exclusive creation ({', '.join(sorted(EXCLUSIVE))}), not {scheme}")
        if fs.exists(p):
            return False
        tmp = self.jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
        fs.mkdirs(p.getParent())
        out = fs.create(tmp, False)
        out.write(bytearray(text.encode()))
        out.close()
        try:
            if scheme == "file":
                os.link(tmp.toUri().getPath(), p.toUri().getPath())
            else:
                rename = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
                options = self.gateway.new_array(rename, 1)
                options[0] = rename.NONE
                self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.conf).rename(tmp, p, options)
            return True
        except FileExistsError:
            return False
        except Exception:
            if fs.exists(p):
                return False
            raise
        finally:
            fs.delete(tmp, False)

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        fs, p = self._at(path)
        fs.mkdirs(p.getParent())
        out = fs.create(p, True)
        out.write(bytearray(text.encode()))
        out.close()

    def list(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def sizes(self, path: str) -> list[tuple[str, int]]:
        """(path, bytes) of the data files below ``path``."""
        fs, p = self._at(path)
        if not fs.exists(p):
            return []
        found, it = [], fs.listFiles(p, True)
        while it.hasNext():
            s = it.next()
            if s.getPath().getName()[0] not in "._":
                found.append((s.getPath().toString(), s.getLen()))
        return sorted(found)

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return bool(fs.exists(p))

    def delete(self, path: str) -> bool:
        fs, p = self._at(path)
        return bool(fs.delete(p, True))

    def copy(self, source: str, target: str) -> None:
        (a, p), (b, q) = self._at(source), self._at(target)
        b.mkdirs(q.getParent())
        self.jvm.org.apache.hadoop.fs.FileUtil.copy(a, p, b, q, False, self.conf)


class VersionedFolder:
    """``path/commits/N.json`` names the folder of version N; readers see nothing else."""

    def __init__(self, spark: SparkSession, path: str):
        self.files, self.path = Files(spark), path.rstrip("/")

    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self.files.list(f"{self.path}/commits") if n.endswith(".json"))

    def latest(self) -> int | None:
        return max(self.versions(), default=None)

    def commit(self, version: int) -> dict:
        return json.loads(self.files.read(f"{self.path}/commits/{version}.json"))

    def folder(self, version: int) -> str:
        return self.commit(version)["folder"]

    def stage(self) -> str:
        return f"{self.path}/data/{uuid.uuid4().hex}"

    def publish(self, folder: str, base: int | None, **info) -> int:
        """Makes ``folder`` the version after ``base``; raises Conflict if that version exists."""
        version = 0 if base is None else base + 1
        if not self.files.create(f"{self.path}/commits/{version}.json", json.dumps({"folder": folder, **info})):
            raise Conflict(f"version {version} of {self.path} was published by another writer")
        return version
