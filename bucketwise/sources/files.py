"""Whole small files, listing, renaming and deleting through Hadoop's file
systems, so that a store can lie wherever Spark can write."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a session on this machine alone, as in tests, may leave the setting
    out; it gets a temporary folder.  On a cluster that would be a folder of each
    machine's own, so there the setting is required."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="bucketwise-")
    return _own[app]


class Files:
    def __init__(self, spark: SparkSession, base: str):
        self.jvm = spark._jvm
        self._gateway = spark.sparkContext._gateway
        self.conf = spark._jsc.hadoopConfiguration()
        self.fs = self._path(base).getFileSystem(self.conf)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._path(name))

    def list(self, name: str) -> list[str]:
        """Names (not paths) in a folder; none if there is no such folder."""
        if not self.exists(name):
            return []
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._path(name)))

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> bool:
        """Write a file that appears whole or not at all; False if it exists.

        Of several writers one wins: a local file gets its name by a hard link,
        elsewhere by a rename that does not overwrite (atomic in HDFS)."""
        temporary = self._path(f"{name}.{uuid.uuid4().hex}.writing")
        stream = self.fs.create(temporary, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        try:
            if self.fs.getScheme() == "file":
                try:
                    os.link(temporary.toUri().getPath(), self._path(name).toUri().getPath())
                except FileExistsError:
                    return False
                return True
            context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(temporary.toUri(), self.conf)
            options = self._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 1)
            options[0] = self.jvm.org.apache.hadoop.fs.Options.Rename.NONE
            try:
                context.rename(temporary, self._path(name), options)
            except Py4JJavaError:
                if self.exists(name):
                    return False
                raise
            return True
        finally:
            self.fs.delete(temporary, False)

    def modified(self, name: str) -> float:
        """When a file or folder was last changed, in seconds since the epoch."""
        return self.fs.getFileStatus(self._path(name)).getModificationTime() / 1000

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)

    def make(self, name: str) -> None:
        self.fs.mkdirs(self._path(name))
