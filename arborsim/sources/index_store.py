"""The index as Parquet folders and a pointer to those that are current.

A save writes a new folder and an append one more; then the pointer is replaced by an atomic rename. A reader
never sees half an index or none, and a failed save leaves the last one as it was. All paths go through Hadoop's
file systems.
"""

from __future__ import annotations

import json
import logging
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborsim import schema

log = logging.getLogger(__name__)


class IndexStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._p("").getFileSystem(self._conf)

    def _p(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _read(self, name: str) -> str | None:
        if not self._fs.exists(self._p(name)):
            return None
        stream = self._fs.open(self._p(name))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def _write(self, name: str, text: str) -> None:
        fresh = self._p(f".{name}.{uuid.uuid4().hex}")
        out = self._fs.create(fresh, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        self._replace(fresh, self._p(name))

    def _replace(self, fresh, old) -> None:
        """One rename over the old file: at no time is there none."""
        rename = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        over = self.spark.sparkContext._gateway.new_array(rename, 1)
        over[0] = rename.OVERWRITE
        fresh, old = self._fs.makeQualified(fresh), self._fs.makeQualified(old)
        self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(old.toUri(), self._conf).rename(fresh, old, over)

    def empty(self) -> DataFrame:
        return self.spark.createDataFrame([], schema.INDEX)

    def current(self) -> dict | None:
        """The pointer's content; None without an index; a damaged one is warned of and counts as none."""
        text = self._read("CURRENT")
        if text is None:
            return None
        try:
            found = json.loads(text)
            if {"dirs", "rows", "version", "model", "dims"} <= found.keys():
                return found
        except (ValueError, AttributeError):
            pass
        log.warning("stored index is damaged; starting empty")
        return None

    def _rows(self, dirs: list[str]) -> DataFrame:
        return self.spark.read.schema(schema.INDEX).parquet(*(f"{self.path}/{d}" for d in dirs))

    def load(self, strict_model: str | None = None) -> tuple[schema.IndexMeta, DataFrame]:
        """(meta, index); defaults and no rows if nothing (readable) is stored.

        The rows are counted, for which only the files' footers are read: a file that is missing, cut or no Parquet
        any more makes the index a damaged one.
        """
        at = self.current()
        if at is None:
            return schema.IndexMeta(), self.empty()
        if strict_model and at["model"] != strict_model:
            raise ValueError(f"the index was made with {at['model']}, not {strict_model}")
        try:
            index = self._rows(at["dirs"])
            if (found := index.count()) != at["rows"]:
                raise ValueError(f"{found} rows of {at['rows']}")
        except Exception as e:  # noqa: BLE001 - a damaged index loads as an empty one
            log.warning("stored index is damaged (%s); starting empty", str(e).split("\n", 1)[0])
            return schema.IndexMeta(), self.empty()
        return schema.IndexMeta(at["version"], at["model"], at["dims"]), index

    def _put(self, index: DataFrame, meta: schema.IndexMeta) -> tuple[str, int]:
        """A new folder with the rows, and their number."""
        name = f"v{time.time_ns()}"
        checked = index.select("blob_sha", F.when(F.size("vec") == meta.dims, F.col("vec")).otherwise(F.raise_error(F.lit("a vector's length isn't the index's dims"))).alias("vec"))
        checked.write.parquet(f"{self.path}/{name}")
        return name, self._rows([name]).count()

    def _point(self, dirs: list[str], rows: int, meta: schema.IndexMeta, before: list[str]) -> None:
        self._write("CURRENT", json.dumps({"dirs": dirs, "rows": rows, "version": meta.version, "model": meta.model, "dims": meta.dims, "before": before}))

    def save(self, index: DataFrame, meta: schema.IndexMeta = schema.IndexMeta()) -> int:
        """Replaces the whole index by one folder. The folders before stay for readers that still use them, until the next save."""
        before = self.current()
        name, rows = self._put(index, meta)
        self._point([name], rows, meta, before["dirs"] if before else [])
        for old in before.get("before", []) if before else ():
            self._fs.delete(self._p(old), True)
        return rows

    def append(self, new: DataFrame, meta: schema.IndexMeta = schema.IndexMeta()) -> int:
        """Adds rows of contents that aren't indexed, in a folder of their own; nothing that is stored is written again."""
        at = self.current()
        if at is None:
            return self.save(new, meta)
        if (at["model"], at["dims"]) != (meta.model, meta.dims):
            raise ValueError(f"the index was made with {at['model']} ({at['dims']}), not {meta.model} ({meta.dims})")
        name, rows = self._put(new, meta)
        if rows:
            self._point([*at["dirs"], name], at["rows"] + rows, meta, at["before"])
        else:
            self._fs.delete(self._p(name), True)
        return rows

    def compact(self) -> int:
        """Puts the folders of appends into one."""
        meta, index = self.load()
        return self.save(index, meta)

    def clear(self) -> bool:
        """Whether there was an index."""
        had = self._fs.exists(self._p("CURRENT"))
        self._fs.delete(self._p(""), True)
        return had
