"""Layouts as a table of (id, yaml) with create, save and delete, in numbered versions.

Every change writes the next version's rows to a folder of their own, and then claims the version's
number with a file that can be made only once and names that folder. Of two writers one gets the
number; the other reads the new version and makes its change to that. Readers see whole versions
only, and earlier ones stay until ``forget``. In a store that shows a file before it is whole, a writer that dies
just then leaves a number that no one gets past until its file is deleted.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable
from urllib.parse import unquote, urlparse

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.sources.files import folder_of

SCHEMA = "id string, yaml string"
VALID_ID = r"^[\p{L}\p{Nd}_-]+$"


class Refused(ValueError):
    """A change that the table can't take; it stays as it is."""


class Conflict(RuntimeError):
    """Other writers were faster each time."""


def settings_of(yaml: Column | str) -> Column:
    """map<string,string> of a text's key: value lines; # cuts a line, quotes go, the last of equal keys stands. null for a null text."""
    text = F.col(yaml) if isinstance(yaml, str) else yaml
    lines = F.transform(F.split(text, r"\r?\n"), lambda x: F.split(F.regexp_replace(x, r"(^|\s)#.*$", ""), ":", 2))
    pairs = F.transform(
        F.filter(lines, lambda p: (F.size(p) == 2) & (F.trim(p[0]) != "")),
        lambda p: F.struct(F.trim(p[0]).alias("key"), F.regexp_replace(F.trim(p[1]), r"""^(["'])(.*)\1$""", "$2").alias("value")),
    )
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(last)


class LayoutTable:
    """The layouts below a folder that all writers and readers share."""

    def __init__(self, spark: SparkSession, path: str, tries: int = 10):
        self.spark, self.path, self.tries = spark, path.rstrip("/"), tries

    def _folders(self) -> dict[int, str]:
        """Rows' folder of each version. A number whose file isn't whole yet isn't a version yet."""
        system, place = folder_of(self.spark, f"{self.path}/versions")
        if not system.exists(place):
            return {}
        found = {}
        for status in system.listStatus(place):
            name = status.getPath().getName()
            if name.isdigit():
                stream = system.open(status.getPath())
                try:
                    text = bytes(stream.readNBytes(200)).decode()
                finally:
                    stream.close()
                if text.endswith("\n"):
                    found[int(name)] = text.strip()
        return found

    def versions(self) -> list[int]:
        return sorted(self._folders())

    def read(self, version: int | None = None) -> DataFrame:
        """(id, yaml) of a version, by default the last; no rows if there is none yet."""
        folders = self._folders()
        if version is None and not folders:
            return self.spark.createDataFrame([], SCHEMA)
        if version is not None and version not in folders:
            raise Refused(f"there is no version {version}")
        return self.spark.read.schema(SCHEMA).parquet(f"{self.path}/rows/{folders[max(folders) if version is None else version]}")

    def layouts(self, version: int | None = None) -> DataFrame:
        """(id, name, yaml, settings): name is the layout's canvas, or its id if it has none."""
        rows = self.read(version).withColumn("settings", settings_of("yaml"))
        return rows.select("id", F.coalesce(F.element_at("settings", "canvas_id"), "id").alias("name"), "yaml", "settings")

    def _claim(self, version: int, folder: str) -> bool:
        """Make the version's file, which only one writer can."""
        system, place = folder_of(self.spark, f"{self.path}/versions/{version}")
        text = f"{folder}\n"
        if system.getScheme() == "file":
            # Hadoop's local file system looks first and makes then; a link does both at once, of a whole file
            system.mkdirs(place.getParent())
            target = unquote(urlparse(place.toUri().toString()).path)
            with open(f"{target}.{folder}", "w", encoding="utf-8") as out:
                out.write(text)
            try:
                os.link(out.name, target)
                return True
            except FileExistsError:
                return False
            finally:
                os.unlink(out.name)
        try:
            out = system.create(place, False)
        except Py4JJavaError as error:
            if "AlreadyExists" in error.java_exception.getClass().getName():
                return False
            raise
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        return True

    def _commit(self, change: Callable[[DataFrame], DataFrame]) -> int:
        """The number of the version that has the change; it is made again to each version that came between."""
        for _ in range(self.tries):
            folders = self._folders()
            now = max(folders, default=0)
            folder = uuid.uuid4().hex
            change(self.read(now or None)).write.parquet(f"{self.path}/rows/{folder}")
            if self._claim(now + 1, folder):
                return now + 1
            self._remove(folder)
        raise Conflict(f"{self.tries} tries met other writers")

    def _remove(self, folder: str) -> None:
        system, place = folder_of(self.spark, f"{self.path}/rows/{folder}")
        system.delete(place, True)

    def _checked(self, rows: DataFrame) -> DataFrame:
        """(id, yaml) with trimmed ids that are letters, digits, _ and -, one row each; a null yaml is an empty one."""
        mine = rows.select(F.trim("id").alias("id"), F.coalesce("yaml", F.lit("")).alias("yaml"))
        bad = mine.filter(F.col("id").isNull() | ~F.col("id").rlike(VALID_ID)).limit(1).collect()
        if bad:
            raise Refused(f"invalid id {bad[0].id!r}")
        twice = mine.groupBy("id").count().filter("count > 1").limit(1).collect()
        if twice:
            raise Refused(f"id {twice[0].id!r} comes twice")
        return mine

    def create(self, rows: DataFrame) -> int:
        """Add new layouts; an id that is there already refuses them all."""
        new = self._checked(rows)

        def change(now: DataFrame) -> DataFrame:
            there = now.join(new, "id", "left_semi").limit(1).collect()
            if there:
                raise Refused(f"id {there[0].id!r} is there already")
            return now.unionByName(new)

        return self._commit(change)

    def save(self, rows: DataFrame) -> int:
        """Put layouts in place of those with their ids, or beside the others."""
        new = self._checked(rows)
        return self._commit(lambda now: now.join(new, "id", "left_anti").unionByName(new))

    def update(self, rows: DataFrame) -> int:
        """Put layouts in place of those with their ids; one that isn't there refuses them all."""
        new = self._checked(rows)

        def change(now: DataFrame) -> DataFrame:
            self._all_there(new, now)
            return now.join(new, "id", "left_anti").unionByName(new)

        return self._commit(change)

    def delete(self, ids: DataFrame) -> int:
        """Take out the layouts of ids(id); one that isn't there refuses them all."""
        gone = ids.select(F.trim("id").alias("id")).distinct()

        def change(now: DataFrame) -> DataFrame:
            self._all_there(gone, now)
            return now.join(gone, "id", "left_anti")

        return self._commit(change)

    @staticmethod
    def _all_there(wanted: DataFrame, now: DataFrame) -> None:
        missing = wanted.join(now, "id", "left_anti").limit(1).collect()
        if missing:
            raise Refused(f"id {missing[0].id!r} is not found")

    def forget(self, before: int) -> None:
        """Delete the rows and numbers of versions under a number, but never the last one's."""
        folders = self._folders()
        for version, folder in folders.items():
            if version < min(before, max(folders)):
                self._remove(folder)
                system, place = folder_of(self.spark, f"{self.path}/versions/{version}")
                system.delete(place, False)
