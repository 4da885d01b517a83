"""A folder of numbered manifest files; the highest complete number is the state. Works on any Hadoop file system."""

from __future__ import annotations

import os
import re
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class ConflictError(RuntimeError):
    """Another writer has published this version already."""


class ManifestFolder:
    def __init__(self, spark: SparkSession, path: str):
        jvm, self._spark = spark.sparkContext._jvm, spark
        self._path = jvm.org.apache.hadoop.fs.Path
        self._jvm, self._root = jvm, self._path(path)
        self._fs = self._root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._local = self._fs.getUri().getScheme() == "file"

    def _versions(self) -> list[int]:
        if not self._fs.exists(self._root):
            return []
        names = (s.getPath().getName() for s in self._fs.listStatus(self._root))
        return sorted(int(m[1]) for n in names if (m := re.fullmatch(r"v(\d{12})\.json", n)))

    def version(self) -> int | None:
        found = self._versions()
        return found[-1] if found else None

    def latest(self) -> str | None:
        version = self.version()
        return None if version is None else self.read(version)

    def read(self, version: int) -> str:
        stream = self._fs.open(self._path(self._root, f"v{version:012d}.json"))
        try:
            return bytes(stream.readAllBytes()).decode("utf-8")
        finally:
            stream.close()

    def beside(self, path: str) -> list[str]:
        """Names of what lies in a folder of the same file system."""
        where = self._path(path)
        return [s.getPath().getName() for s in self._fs.listStatus(where)] if self._fs.exists(where) else []

    def publish(self, version: int, text: str) -> None:
        """Write a draft of its own, then give it the version's name, which fails if that is taken: readers see all of
        it or nothing, and of two writers one wins. What is there afterwards is read again, as some object stores
        replace what they should refuse; two writers must not publish the same text."""
        final, draft = self._path(self._root, f"v{version:012d}.json"), self._path(self._root, f".draft-{uuid.uuid4().hex}")
        self._fs.mkdirs(self._root)
        out = self._fs.create(draft, False)
        try:
            out.write(bytearray(text.encode("utf-8")))
        finally:
            out.close()
        try:
            self._name(draft, final)
        except (FileExistsError, Py4JJavaError) as e:
            if not self._fs.exists(final):
                raise
            raise ConflictError(f"version {version} is published already") from e
        finally:
            self._fs.delete(draft, False)
        if self.read(version) != text:
            raise ConflictError(f"version {version} is published already")

    def _name(self, draft: object, final: object) -> None:
        if self._local:  # renaming would replace a file there
            os.link(draft.toUri().getPath(), final.toUri().getPath())
            return
        never = self._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename").getEnumConstants()[0]  # Rename.NONE
        kind = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self._spark.sparkContext._gateway.new_array(kind, 1)
        options[0] = never
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._root.toUri(), self._spark.sparkContext._jsc.hadoopConfiguration())
        context.rename(draft, final, options)
