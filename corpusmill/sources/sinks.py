"""Sinks: versioned snapshots behind a pointer, a run ledger, a vector store and deterministic JSON."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.errors import RunConflict


class _Files:
    """Hadoop's file system under a root, so that any store Spark can reach will do."""

    def __init__(self, spark: SparkSession, root: str):
        self.root, self.jvm = root.rstrip("/"), spark._jvm
        self.fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def create(self, name: str, text: str, replace: bool) -> None:
        out = self.fs.create(self._path(name), replace)
        out.write(bytearray(text.encode()))
        out.close()

    def read(self, name: str) -> str | None:
        path = self._path(name)
        if not self.fs.exists(path):
            return None
        source = self.fs.open(path)
        try:
            return bytes(source.readAllBytes()).decode()
        finally:
            source.close()

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)


class Snapshots:
    """Tables as immutable versions; readers see the version the pointer names, all of it or none."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.files = spark, _Files(spark, root)

    def version(self, name: str) -> str | None:
        return self.files.read(f"{name}/CURRENT")

    def read(self, name: str) -> DataFrame | None:
        version = self.version(name)
        return None if version is None else self.spark.read.parquet(f"{self.files.root}/{name}/{version}")

    def publish(self, name: str, df: DataFrame, partition_by: list[str] | None = None) -> str:
        """Write a version whole, then move the pointer; a failed write leaves the old version current."""
        version = f"v-{uuid.uuid4().hex}"
        writer = df.write.mode("errorifexists")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{self.files.root}/{name}/{version}")
        self.files.create(f"{name}/CURRENT", version, replace=True)
        return version

    def prune(self, name: str, version: str) -> None:
        """Delete a version that is no longer current."""
        if version == self.version(name):
            raise ValueError("the current version stays")
        self.files.delete(f"{name}/{version}")


class RunIsActive(RunConflict):
    """Another run holds the lock; nothing was done."""


@contextmanager
def single_run(spark: SparkSession, root: str, name: str = "RUN_LOCK") -> Iterator[str]:
    """Hold the one lock of a store for the length of a run; creating its file is what takes it."""
    files, run = _Files(spark, root), uuid.uuid4().hex
    try:
        files.create(name, run, replace=False)
    except Exception as error:
        raise RunIsActive("another run is in progress") from error
    try:
        yield run
    finally:
        files.delete(name)


def append_ledger(spark: SparkSession, root: str, entry: dict[str, object]) -> None:
    """Append one state of a run to the ledger; the latest state of a run is the one that counts."""
    columns = ("run_id", "run_mode", "run_status", "at", "counts", "abort_reason")
    row = tuple(json.dumps(entry.get(c)) if c == "counts" else entry.get(c) for c in columns)
    schema = "run_id string, run_mode string, run_status string, at timestamp, counts string, abort_reason string"
    spark.createDataFrame([row], schema).write.mode("append").parquet(f"{root.rstrip('/')}/ledger")


def append_vectors(vectors: DataFrame, path: str, dim: int) -> None:
    """Append vectors to a store keyed by hash, leaving out keys it has; a bad vector fails the write."""
    spark = vectors.sparkSession
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    checked = vectors.withColumn("embedding", F.when((F.size("embedding") == dim) & finite, F.col("embedding")).otherwise(F.raise_error(F.lit("a vector cannot be stored"))))
    checked = checked.groupBy("content_hash").agg(F.any_value("embedding").alias("embedding"))
    files = _Files(spark, path)
    if files.fs.exists(files._path("")):
        checked = checked.join(spark.read.schema("content_hash string").parquet(path), "content_hash", "left_anti")
    checked.write.mode("append").parquet(path)


def write_json_lines(rows: DataFrame, path: str, order: list[str], overwrite: bool = False) -> None:
    """A dataset of any size as JSON lines: keys as the columns stand, nulls kept, no time stamps, rows in ``order``.

    Executors write the parts; their names and the rows in them follow the order, so equal rows give equal text.
    """
    ordered = rows.orderBy(*order).select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value"))
    ordered.write.mode("overwrite" if overwrite else "errorifexists").text(path)


#: Rows up to which a result is small enough for a file written by the driver.
REPORT_ROWS = 10_000


def _small(rows: DataFrame, order: list[str]) -> list:
    found = (rows.orderBy(*order) if order else rows).limit(REPORT_ROWS + 1).collect()
    if len(found) > REPORT_ROWS:
        raise ValueError("too many rows for a report; write them as JSON lines")
    return found


def report_json(title: str, parts: dict[str, tuple[DataFrame, list[str]]]) -> str:
    """A report of small tables: per name its rows in order, keys as the columns stand."""
    body = {name: [r.asDict(recursive=True) for r in _small(rows, order)] for name, (rows, order) in parts.items()}
    return json.dumps({"title": title, **body}, indent=2, ensure_ascii=False, default=str) + "\n"


def report_markdown(title: str, parts: dict[str, tuple[DataFrame, list[str]]]) -> str:
    """The same for reading: a heading and a table each; bars in cells are escaped, nulls are empty."""
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = [f"# {title}"]
    for name, (rows, order) in parts.items():
        lines += ["", f"## {name}", "", "| " + " | ".join(rows.columns) + " |", "|" + " --- |" * len(rows.columns)]
        lines += ["| " + " | ".join(cell(v) for v in r) + " |" for r in _small(rows, order)]
    return "\n".join(lines) + "\n"


def evolve(rows: DataFrame, column: str, kind: str, default: object = None) -> DataFrame:
    """A snapshot with one more column; ``default`` fills the rows there are and is no default of later ones."""
    if column in rows.columns:
        raise ValueError(f"there is a column {column}")
    return rows.withColumn(column, F.lit(default).cast(kind))


def render_json(rows: DataFrame, order: list[str], head: dict[str, object], items: str) -> str:
    """A dataset file's text: fixed key order, no time stamps, rows in ``order``. For results small enough to ship as a file."""
    texts = rows.select(*order, F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("__json"))
    ordered = [json.loads(r["__json"]) for r in _small(texts, order)]
    return json.dumps(head | {items: ordered}, indent=2, ensure_ascii=False) + "\n"


def refuse_secrets(text: str, secrets: list[str]) -> str:
    """The text, or an error if it holds any of the secrets."""
    if any(s and s in text for s in secrets):
        raise ValueError("the output would disclose a credential")
    return text
