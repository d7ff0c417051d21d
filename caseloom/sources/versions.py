"""Versions of a folder that are complete before anybody reads them, and appends that count once.

A version is written under a new name; then a numbered manifest that names it appears
whole, by a rename. Readers follow the manifest with the highest number, so a writer that stops
half-way leaves the former version in place. Manifests and names are small: the driver
handles them, rows go through Spark.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable, Sequence

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _place(folder: str) -> tuple[fs.FileSystem, str]:
    if "://" in folder or folder.startswith("file:"):
        return fs.FileSystem.from_uri(folder)
    return fs.LocalFileSystem(), os.path.abspath(folder)


def _names(folder: str) -> list[str]:
    system, path = _place(folder)
    found = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
    return sorted(f.base_name for f in found)


def _remove(folder: str, name: str) -> None:
    system, path = _place(folder)
    if system.get_file_info(f"{path}/{name}").type == fs.FileType.Directory:
        system.delete_dir(f"{path}/{name}")


def _manifests(folder: str) -> list[str]:
    return [n for n in _names(folder) if n.startswith("manifest-") and n.endswith(".json")]


def read_manifest(folder: str) -> dict:
    """The current manifest; empty before the first one."""
    names = _manifests(folder)
    if not names:
        return {}
    system, path = _place(folder)
    with system.open_input_stream(f"{path}/{names[-1]}") as file:
        return json.loads(file.read())


def _switch(folder: str, content: dict, number: int) -> None:
    """Make ``content`` the manifest of this number, which must be new."""
    system, path = _place(folder)
    name = f"manifest-{number:08d}.json"
    if name in _manifests(folder):
        raise FileExistsError(f"{folder}: another writer has made {name}")
    system.create_dir(path, recursive=True)
    draft = f"{path}/.draft-{uuid.uuid4().hex}"
    with system.open_output_stream(draft) as file:
        file.write(json.dumps(content).encode())
    system.move(draft, f"{path}/{name}")


def publish(folder: str, write: Callable[[str], None], keep: int = 3) -> str:
    """Write a version by ``write(path)`` and make it the current one; returns its path.

    The last ``keep`` versions stay, so who follows an older manifest can still read.
    Folders that stopped writers left are not touched.
    """
    number = read_manifest(folder).get("number", 0) + 1
    version = f"version-{number:08d}-{uuid.uuid4().hex[:8]}"
    write(f"{folder.rstrip('/')}/{version}")
    versions = [*read_manifest(folder).get("versions", []), version]
    _switch(folder, {"number": number, "versions": versions[-keep:]}, number)
    for old in versions[:-keep]:
        _remove(folder, old)
    return f"{folder.rstrip('/')}/{version}"


def current(folder: str) -> str:
    """Path of the current version."""
    versions = read_manifest(folder).get("versions")
    if not versions:
        raise FileNotFoundError(f"nothing is published in {folder}")
    return f"{folder.rstrip('/')}/{versions[-1]}"


COMMIT = "__commit"


class KeyedAppends:
    """A table that grows by appends, of which the last row of each key counts.

    Each append is a folder of its own that counts once it is complete. ``compact``
    writes what the appends so far amount to into one folder, and a manifest says which
    appends it stands for; appends made meanwhile are not among them and stay.
    """

    def __init__(self, spark: SparkSession, folder: str, keys: Sequence[str] = ("run_id", "epoch"), attempt: str | None = None):
        self.spark, self.folder, self.keys, self.attempt = spark, folder.rstrip("/"), list(keys), attempt

    def append(self, df: DataFrame) -> None:
        commit = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        df.withColumn(COMMIT, F.lit(commit)).write.parquet(f"{self.folder}/append-{commit}")

    def _complete(self) -> list[str]:
        """Names of the folders that count now."""
        manifest = read_manifest(self.folder)
        gone = {*manifest.get("replaced", ())}
        system, path = _place(self.folder)
        fresh = [n for n in _names(self.folder) if n.startswith("append-") and n not in gone]
        whole = [n for n in fresh if system.get_file_info(f"{path}/{n}/_SUCCESS").type == fs.FileType.File]
        return [manifest["compacted"], *whole] if "compacted" in manifest else whole

    def _last(self, names: Sequence[str]) -> DataFrame:
        rows = self.spark.read.option("mergeSchema", "true").parquet(*(f"{self.folder}/{n}" for n in names))
        later = [c for c in (self.attempt, COMMIT) if c]
        order = F.struct(*(F.col(f"`{c}`") for c in later))
        columns = [c for c in rows.columns if c not in self.keys]
        newest = F.max_by(F.struct(*(F.col(f"`{c}`") for c in columns)), order)
        found = rows.groupBy(*(F.col(f"`{k}`") for k in self.keys)).agg(newest.alias("__row"))
        keys = {k: F.col(f"`{k}`") for k in self.keys}
        return found.select(*(keys[c] if c in keys else F.col("__row").getField(c).alias(c) for c in rows.columns))

    def read(self) -> DataFrame:
        """The row of the last append (of the highest attempt) of each key; null keys are keys, too."""
        names = self._complete()
        if not names:
            raise FileNotFoundError(f"nothing has been appended to {self.folder}")
        return self._last(names).drop(COMMIT)

    def files(self) -> int:
        """Folders that a reader opens."""
        return len(self._complete())

    def compact(self, parts: int | None = None) -> None:
        """Make one folder of all complete appends. One compaction at a time: the later of two raises."""
        names = self._complete()
        if len(names) < 2:
            return
        manifest = read_manifest(self.folder)
        number = manifest.get("number", 0) + 1
        compacted = f"compacted-{number:08d}-{uuid.uuid4().hex[:8]}"
        rows = self._last(names)
        (rows if parts is None else rows.coalesce(parts)).write.parquet(f"{self.folder}/{compacted}")
        replaced = [n for n in names if n.startswith("append-")]
        old = [manifest["compacted"]] if "compacted" in manifest else []
        _switch(self.folder, {"number": number, "compacted": compacted, "replaced": replaced, "old": old}, number)
        # readers of the former manifest may still be at work; those of the one before are not waited for
        for name in [*manifest.get("replaced", ()), *manifest.get("old", ())]:
            _remove(self.folder, name)
