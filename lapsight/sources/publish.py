"""Publishing several tables and documents at once: readers see all of a version or none of it.

A version is written to a folder of its own. Only then its number is taken in
the log by a rename that fails if the number is there, so of two writers one
wins and the other is told. A reader takes the last entry of the log. A write
that fails or is killed leaves no entry; its folder is removed at once, or by
the next clean(). Renames are atomic on HDFS and local disks; on an object store
the log needs a store that can create an object only if it is absent.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession

LOG, VERSIONS = "_log", "versions"
FORMATS = ("parquet", "json", "csv", "orc")


class Conflict(RuntimeError):
    """Another writer has published since this one began."""


class _Files:
    """The file system of a folder, as Spark sees it."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.gateway, self.jvm = spark.sparkContext._gateway, spark._jvm
        self.fs = self.path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self, folder: str) -> list[str]:
        at = self.path(folder)
        return sorted(f.getPath().getName() for f in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def read(self, path: str) -> str:
        stream = self.fs.open(self.path(path))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        stream = self.fs.create(self.path(path), False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def move(self, source: str, target: str) -> bool:
        """Whether ``source`` is now ``target``; False if that was there."""
        try:
            context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri())
            context.rename(self.path(source), self.path(target), self.gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0))
            return True
        except Exception as error:
            if "AlreadyExists" in str(error):
                return False
            raise

    def remove(self, path: str) -> None:
        self.fs.delete(self.path(path), True)


def _entries(files: _Files, root: str) -> list[int]:
    return [int(n[:-5]) for n in files.names(f"{root}/{LOG}") if n.endswith(".json") and n[:-5].isdigit()]


def _append(files: _Files, root: str, number: int, entry: Mapping[str, Any]) -> None:
    draft = f"{root}/{LOG}/.{uuid.uuid4().hex}.draft"
    files.write(draft, json.dumps(entry, sort_keys=True))
    if not files.move(draft, f"{root}/{LOG}/{number:012d}.json"):
        files.remove(draft)
        raise Conflict(f"{root}: entry {number} was taken by another writer")


def publish(spark: SparkSession, root: str, tables: Mapping[str, DataFrame], documents: Mapping[str, Any] | None = None, form: str = "parquet", expected: int | None = None) -> int:
    """The number of the new version, which holds ``tables`` and JSON ``documents`` with their checksums.

    ``expected`` is the version that this one was derived from; if another has
    been published since the write began (or since it), that is a Conflict and
    nothing is published.
    """
    if form not in FORMATS:
        raise ValueError(f"a table is written as one of {', '.join(FORMATS)}")
    files, root = _Files(spark, root), root.rstrip("/")
    before = max(_entries(files, root), default=0)
    if expected is not None and expected != before:
        raise Conflict(f"{root}: version {before} is there, {expected} was expected")
    folder = f"{VERSIONS}/{uuid.uuid4().hex}"
    manifest: dict[str, Any] = {"folder": folder, "format": form, "published": time.time(), "tables": {}, "documents": {}}
    try:
        for name, df in tables.items():
            df.write.format(form).options(**({"header": "true"} if form == "csv" else {})).save(f"{root}/{folder}/{name}")
            manifest["tables"][name] = {"schema": json.loads(df.schema.json())}
        for name, value in (documents or {}).items():
            text = json.dumps(value, sort_keys=True, ensure_ascii=False)
            files.write(f"{root}/{folder}/{name}.json", text)
            manifest["documents"][name] = hashlib.sha256(text.encode()).hexdigest()
        _append(files, root, before + 1, manifest)
    except BaseException:
        files.remove(f"{root}/{folder}")
        raise
    return before + 1


def versions(spark: SparkSession, root: str) -> list[int]:
    return _entries(_Files(spark, root), root.rstrip("/"))


def manifest_of(spark: SparkSession, root: str, version: int | None = None) -> dict[str, Any]:
    files, root = _Files(spark, root), root.rstrip("/")
    known = _entries(files, root)
    at = max(known, default=None) if version is None else version
    if at not in known:
        raise LookupError(f"{root}: no version {'yet' if version is None else version}")
    return {**json.loads(files.read(f"{root}/{LOG}/{at:012d}.json")), "version": at}


def read_table(spark: SparkSession, root: str, name: str, version: int | None = None) -> DataFrame:
    """A table of the last version, or of an earlier one; a reader that has begun keeps its version."""
    from pyspark.sql import types as T

    found = manifest_of(spark, root, version)
    if name not in found["tables"]:
        raise LookupError(f"{root}: version {found['version']} has no table {name}")
    reader = spark.read.format(found["format"]).schema(T.StructType.fromJson(found["tables"][name]["schema"]))
    return reader.options(**({"header": "true"} if found["format"] == "csv" else {})).load(f"{root.rstrip('/')}/{found['folder']}/{name}")


def read_document(spark: SparkSession, root: str, name: str, version: int | None = None) -> Any:
    """A document of a version; one that does not match its checksum is an error."""
    found = manifest_of(spark, root, version)
    text = _Files(spark, root).read(f"{root.rstrip('/')}/{found['folder']}/{name}.json")
    if hashlib.sha256(text.encode()).hexdigest() != found["documents"][name]:
        raise ValueError(f"{root}: document {name} of version {found['version']} does not match its checksum")
    return json.loads(text)


def roll_back(spark: SparkSession, root: str, version: int) -> int:
    """A new entry that shows an earlier version again; nothing is lost."""
    files, root = _Files(spark, root), root.rstrip("/")
    entry = manifest_of(spark, root, version)
    number = max(_entries(files, root)) + 1
    _append(files, root, number, {**entry, "rolled_back_to": version})
    return number


def clean(spark: SparkSession, root: str, keep: int = 2, older_s: float = 86_400.0) -> list[str]:
    """Remove the folders that none of the last ``keep`` entries shows and that are older than ``older_s`` seconds, so that no writer is in them."""
    files, root = _Files(spark, root), root.rstrip("/")
    known = sorted(_entries(files, root))
    shown = {manifest_of(spark, root, v)["folder"] for v in known[-keep:]} if keep else set()
    gone = []
    for name in files.names(f"{root}/{VERSIONS}"):
        path = f"{root}/{VERSIONS}/{name}"
        age = time.time() - files.fs.getFileStatus(files.path(path)).getModificationTime() / 1000
        if f"{VERSIONS}/{name}" not in shown and age >= older_s:
            files.remove(path)
            gone.append(name)
    for v in known[:-keep] if keep else []:
        if manifest_of(spark, root, v)["folder"] not in shown:
            files.remove(f"{root}/{LOG}/{v:012d}.json")
    return gone
