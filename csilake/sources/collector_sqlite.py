"""Collector files: folders of SQLite files in the desktop or mobile layout, read and written in parallel.

    spark.dataSource.register(CollectorSqlite)
    spark.read.format("collector_sqlite").load("/shared/collected")
    rows.write.format("collector_sqlite").option("layout", "mobile").mode("append").save("/shared/out")

Options: ``path`` (a file or folder every executor can reach), ``columns`` (comma list of canonical
columns to read), ``bytes_per_split``, ``pushdown``, ``layout``, ``rows_per_file``, ``newest``. With ``pushdown``
simple comparisons run inside the files; it needs ``spark.sql.python.filterPushdown.enabled``. With ``newest`` each file gives its
rows of greatest id alone, that many, found by its key (``newest_first`` takes the first of all files).
"""

from __future__ import annotations

import json
import os
import re
import shutil
import sqlite3
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import closing
from dataclasses import dataclass
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from csilake.schema import CSI_DDL, STORED_NAMES, WIRE_FIELDS, WIRE_NAMES

# The stored table, and the column order and id rule of its two layouts.
TABLE = "csi_data"
_MOBILE_ORDER = ["type", "mac", "seq", *WIRE_NAMES[3:]]
LAYOUTS = {
    "desktop": ("id INTEGER PRIMARY KEY", ["timestamp", "scenario", *WIRE_NAMES]),
    "mobile": ("id INTEGER PRIMARY KEY AUTOINCREMENT", ["data_hora", "cenario", *_MOBILE_ORDER]),
}

_AFFINITY = {"string": "TEXT", "int": "INTEGER", "bigint": "INTEGER", "float": "REAL"}
_COMPARE = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
# Only columns stored as declared compare alike in both systems: the key and the plain texts.
_PUSHABLE = {"id", "scenario", "type", "mac"}
_BATCH_ROWS = 4096
# A job's files wait in a folder of this name. While they move out, a list of them there tells readers to pass over them.
_STAGED, _COMING = ".job-", "coming"

SCHEMA_DDL = CSI_DDL + ", bad_fields array<string>, file string"


def create_statement(layout: str) -> str:
    kinds = dict(WIRE_FIELDS)
    key, columns = LAYOUTS[layout]
    body = ", ".join(f"{name} {_AFFINITY[kinds.get(name, 'string')]}" for name in columns)
    return f"CREATE TABLE IF NOT EXISTS {TABLE} ({key}, {body})"


@dataclass
class FileSlice(InputPartition):
    path: str
    index: int
    of: int


class CollectorSqlite(DataSource):
    @classmethod
    def name(cls) -> str:
        return "collector_sqlite"

    def schema(self) -> str:
        wanted = self.options.get("columns")
        if not wanted:
            return SCHEMA_DDL
        ddl = dict(part.split(" ", 1) for part in SCHEMA_DDL.replace("`", "").split(", "))
        return ", ".join(f"`{name.strip()}` {ddl[name.strip()]}" for name in wanted.split(","))

    def reader(self, schema: StructType) -> "SqliteReader":
        pushdown = self.options.get("pushdown", "false").lower() == "true"
        return (PushdownReader if pushdown else SqliteReader)(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> "SqliteWriter":
        return SqliteWriter(schema, self.options, overwrite)


class SqliteReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]) -> None:
        self.schema = schema
        self.path = options["path"]
        self.bytes_per_split = int(options.get("bytes_per_split", 128 << 20))
        self.newest = int(options["newest"]) if "newest" in options else None
        self.where: list[tuple[str, str, list]] = []

    def partitions(self) -> list[FileSlice]:
        """Files by size, from the folder listing alone. No file is opened on the driver."""
        slices = []
        for path, size in _list_files(self.path):
            of = 1 if self.newest is not None else max(1, -(-size // self.bytes_per_split))
            slices.extend(FileSlice(path, i, of) for i in range(of))
        return slices

    def read(self, part: FileSlice) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(self.schema)
        with _open_readonly(part.path) as db:
            stored = {row[1] for row in db.execute(f"PRAGMA table_info({TABLE})")}
            layout = "mobile" if STORED_NAMES["mobile"]["captured_at"] in stored else "desktop"
            low, high = db.execute(f"SELECT min(id), max(id) FROM {TABLE}").fetchone()
            if low is None:
                return
            span = high - low + 1
            bounds = [low + span * part.index // part.of, low + span * (part.index + 1) // part.of - 1]
            kinds = dict(WIRE_FIELDS)
            needs_all = "bad_fields" in self.schema.names
            names = [n for n in ["id", "captured_at", "scenario", *WIRE_NAMES] if needs_all or n in self.schema.names]
            conditions, values = ["id BETWEEN ? AND ?"], list(bounds)
            for column, test, arguments in self.where:
                conditions.append(f"{_stored_name(column, layout)} {test}")
                values.extend(arguments)
            select = ", ".join(_typed(_stored_name(n, layout), kinds.get(n, "string")) for n in names) or "id"
            order = "id" if self.newest is None else "id DESC LIMIT ?"
            values += [] if self.newest is None else [self.newest]
            cursor = db.execute(f"SELECT {select} FROM {TABLE} WHERE {' AND '.join(conditions)} ORDER BY {order}", values)
            while rows := cursor.fetchmany(_BATCH_ROWS):
                yield _to_batch(rows, names, kinds, arrow, part.path)


def newest_first(spark: SparkSession, path: str, size: int, columns: str | None = None) -> DataFrame:
    """The ``size`` rows of greatest id over all files of a folder, greatest first; files of one id come in the order of their names.

    Each file is asked for its own newest rows, so a task returns ``size`` rows at most, whatever a file holds.
    """
    reader = spark.read.format("collector_sqlite").option("newest", size)
    if columns is not None:
        reader = reader.option("columns", columns)
    rows = reader.load(path)
    order = [F.desc("id"), *(["file"] if "file" in rows.columns else [])]
    return rows.orderBy(*order).limit(size)


class PushdownReader(SqliteReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for item in filters:
            column = item.attribute[0] if len(item.attribute) == 1 else None
            if column in _PUSHABLE and type(item) in _COMPARE and item.value is not None:
                self.where.append((column, f"{_COMPARE[type(item)]} ?", [item.value]))
            elif column in _PUSHABLE and isinstance(item, In) and None not in item.value:
                self.where.append((column, "IN (SELECT value FROM json_each(?))", [json.dumps(list(item.value))]))
            else:
                yield item


def _stored_name(name: str, layout: str) -> str:
    return STORED_NAMES[layout].get(name, name)


def _typed(column: str, kind: str) -> str:
    """SQL for a stored value as its declared type; a text, a fraction where a whole number belongs or a value out of range is null."""
    if kind == "string":
        return column
    if kind == "float":
        return f"CASE WHEN typeof({column}) IN ('integer', 'real') THEN CAST({column} AS REAL) END"
    whole = f"typeof({column}) = 'integer' OR typeof({column}) = 'real' AND {column} = CAST({column} AS INTEGER)"
    limit = 1 << (63 if kind == "bigint" else 31)
    # the least whole number can't be written as a literal of 64 bits
    return f"CASE WHEN ({whole}) AND {column} BETWEEN {-limit + 1} - 1 AND {limit - 1} THEN CAST({column} AS INTEGER) END"


def _to_batch(rows: list[tuple], names: list[str], kinds: dict[str, str], schema: pa.Schema, path: str) -> pa.RecordBatch:
    columns = dict(zip(names, zip(*rows))) if names else {}
    bad: list[list[str]] = [[] for _ in rows]
    if "bad_fields" in schema.names:
        for name, kind in kinds.items():
            if kind != "string" and None in columns[name]:
                for i, number in enumerate(columns[name]):
                    if number is None:
                        bad[i].append(name)
    stamps = None
    if "captured_at" in columns:
        kind = schema.field("captured_at").type if "captured_at" in schema.names else pa.timestamp("us")
        stamps = _stamps(columns["captured_at"], kind)
        for i, (text, stamp) in enumerate(zip(columns["captured_at"], stamps)):
            if text is not None and not stamp.is_valid:
                bad[i].append("captured_at")
    arrays = []
    for field in schema:
        if field.name == "file":
            arrays.append(pa.array([path] * len(rows), field.type))
        elif field.name == "bad_fields":
            arrays.append(pa.array(bad, field.type))
        elif field.name == "captured_at":
            arrays.append(stamps)
        elif pa.types.is_string(field.type):
            arrays.append(pa.array([None if v is None else str(v) for v in columns[field.name]], field.type))
        else:
            arrays.append(pa.array(columns[field.name], field.type))
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def _stamps(texts: tuple, kind: pa.DataType) -> pa.Array:
    parsed = pd.to_datetime(pd.Series(texts, dtype="object"), format="ISO8601", errors="coerce")
    return pa.Array.from_pandas(parsed, type=kind, safe=False)


def mounted(path: str) -> str:
    """SQLite opens files by plain path, so the folder has to be mounted wherever tasks run."""
    plain = re.sub("^file:(//)?", "", path)
    if "://" in plain:
        raise ValueError(f"collector files need a mounted folder, not {path}")
    return plain


def _list_files(path: str) -> list[tuple[str, int]]:
    root = mounted(path)
    if os.path.isfile(root):
        return [(root, os.path.getsize(root))]
    found, coming = [], set()
    for entry in os.scandir(root):
        if entry.name.startswith(_STAGED) and os.path.exists(os.path.join(entry.path, _COMING)):
            with open(os.path.join(entry.path, _COMING)) as names:
                coming |= set(names.read().split())
    for folder, inner, names in os.walk(root):
        inner[:] = [name for name in inner if not name.startswith(_STAGED)]
        for name in names:
            if name in coming:
                continue
            # users choose the names; hidden files and SQLite's own side files are no tables
            if name[0] not in "._" and not name.endswith(("-wal", "-shm", "-journal")):
                full = os.path.join(folder, name)
                found.append((full, os.path.getsize(full)))
    return sorted(found)


def _open_readonly(path: str) -> closing:
    """A file with a write-ahead log beside it is opened with the log, any other as one that nobody writes."""
    fixed = "" if os.path.exists(f"{path}-wal") else "&immutable=1"
    return closing(sqlite3.connect(f"file:{quote(path)}?mode=ro{fixed}", uri=True))


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class SqliteWriter(DataSourceArrowWriter):
    """One or more files per task, kept aside until the job commits: all of a job's files show at once, by the removal of their list."""

    def __init__(self, schema: StructType, options: dict[str, str], overwrite: bool) -> None:
        self.columns = schema.names
        self.path = mounted(options["path"])
        self.layout = options.get("layout", "desktop")
        self.rows_per_file = int(options.get("rows_per_file", 200_000))
        self.overwrite = overwrite
        self.before = [p for p, _ in _list_files(self.path)] if overwrite and os.path.isdir(self.path) else []
        self.aside = os.path.join(self.path, f"{_STAGED}{uuid.uuid4().hex}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        os.makedirs(self.aside, exist_ok=True)
        names = [n for n in ["id", "captured_at", "scenario", *WIRE_NAMES] if n in self.columns]
        files, db, held = [], None, 0
        # A file grows on the executor's own disk, so a task holds a batch of rows and SQLite's few cached pages, whatever the file's size.
        with tempfile.TemporaryDirectory(prefix="collector-") as own:
            try:
                for batch in (whole.slice(at, _BATCH_ROWS) for whole in iterator for at in range(0, whole.num_rows, _BATCH_ROWS)):
                    columns = [batch.column(self.columns.index(n)).to_pylist() for n in names]
                    columns = [[self._stamp(x) for x in column] if n == "captured_at" else column for n, column in zip(names, columns)]
                    rows = list(zip(*columns))
                    while rows:
                        if db is None:
                            db = self._open(os.path.join(own, f"{uuid.uuid4().hex}.db"))
                        take = min(len(rows), self.rows_per_file - held)
                        self._insert(db, names, rows[:take])
                        rows, held = rows[take:], held + take
                        if held >= self.rows_per_file:
                            files.append(self._save(db))
                            db, held = None, 0
                if db is not None:
                    files.append(self._save(db))
                    db = None
            finally:
                if db is not None:
                    db.close()
        return Written(files)

    def _open(self, path: str) -> sqlite3.Connection:
        db = sqlite3.connect(path)
        # a file that is not finished is thrown away, so nothing needs to be undone or to last
        db.execute("PRAGMA journal_mode = OFF")
        db.execute("PRAGMA synchronous = OFF")
        db.execute(create_statement(self.layout))
        return db

    def _insert(self, db: sqlite3.Connection, names: list[str], rows: list[tuple]) -> None:
        stored = ", ".join(_stored_name(n, self.layout) for n in names)
        marks = ", ".join("?" * len(names))
        db.executemany(f"INSERT INTO {TABLE} ({stored}) VALUES ({marks})", rows)
        db.commit()

    def _stamp(self, value) -> str | None:
        if value is None:
            return None
        return value.isoformat() if self.layout == "desktop" else value.strftime("%Y-%m-%d %H:%M:%S")

    def _save(self, db: sqlite3.Connection) -> str:
        """Copies the finished database to the job's folder, in pieces, and removes it here."""
        path = db.execute("PRAGMA database_list").fetchone()[2]
        db.close()
        name = os.path.basename(path)
        with open(path, "rb") as source, open(os.path.join(self.aside, name), "wb") as out:
            shutil.copyfileobj(source, out, 1 << 20)
        os.remove(path)
        return name

    def commit(self, messages: list[Written | None]) -> None:
        """A driver lost on the way leaves none of the job's files to be read. On overwriting, the files of before go last."""
        kept = [name for message in messages if message for name in message.files]
        if kept:
            coming = os.path.join(self.aside, _COMING)
            with open(f"{coming}.part", "w") as names:
                names.write("\n".join(kept))
            os.replace(f"{coming}.part", coming)
            for name in kept:
                os.replace(os.path.join(self.aside, name), os.path.join(self.path, name))
            os.remove(coming)
        shutil.rmtree(self.aside, ignore_errors=True)
        for old in self.before:
            os.remove(old)

    def abort(self, messages: list[Written | None]) -> None:
        shutil.rmtree(self.aside, ignore_errors=True)
