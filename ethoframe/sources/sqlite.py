"""SQLite tables as a Spark data source: read in rowid ranges with comparisons pushed into the query, written as staged parts and one commit.

The file must lie where every executor can open it (a shared mount, or files distributed with the job).
"""

from __future__ import annotations

import os
import sqlite3
import uuid
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import BinaryType, BooleanType, ByteType, DoubleType, FloatType, IntegerType, LongType, ShortType, StructType

_TYPES = {"INT": "bigint", "REAL": "double", "FLOA": "double", "DOUB": "double", "BLOB": "binary", "BOOL": "boolean"}
_SIGNS = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


def _name(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


@dataclass
class _Range(InputPartition):
    lo: int
    hi: int


class SqliteSource(DataSource):
    """Options: path, table, rows_per_partition (100,000)."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> str:
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as db:
            columns = db.execute(f"PRAGMA table_info({_name(self.options['table'])})").fetchall()
        return ", ".join(f"`{c[1]}` {_TYPES.get((c[2] or '').upper()[:4], _TYPES.get((c[2] or '').upper()[:3], 'string'))}" for c in columns)

    def reader(self, schema: StructType) -> SqliteReader:
        return SqliteReader(dict(self.options), schema)

    def writer(self, schema: StructType, overwrite: bool) -> SqliteWriter:
        return SqliteWriter(dict(self.options), schema, overwrite)


class SqliteReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType) -> None:
        self.options, self.names, self.where, self.values = options, schema.names, [], []
        self.booleans = [i for i, f in enumerate(schema.fields) if isinstance(f.dataType, BooleanType)]

    def pushFilters(self, filters):
        for f in filters:
            sign = _SIGNS.get(type(f))
            if sign and len(f.attribute) == 1 and isinstance(f.value, int | float | str):
                self.where.append(f"{_name(f.attribute[0])} {sign} ?")
                self.values.append(f.value)
            else:
                yield f

    def partitions(self) -> list[_Range]:
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as db:
            lo, hi = db.execute(f"SELECT min(rowid), max(rowid) FROM {_name(self.options['table'])}").fetchone()
        if lo is None:
            return [_Range(0, 0)]
        step = int(self.options.get("rows_per_partition", 100_000))
        return [_Range(at, min(at + step, hi + 1)) for at in range(lo, hi + 1, step)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        columns = ", ".join(map(_name, self.names))
        where = " AND ".join(["rowid >= ?", "rowid < ?", *self.where])
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as db:
            rows = db.execute(f"SELECT {columns} FROM {_name(self.options['table'])} WHERE {where}", [partition.lo, partition.hi, *self.values])
            yield from map(self._typed, rows) if self.booleans else rows

    def _typed(self, row: tuple) -> tuple:
        """SQLite keeps booleans as numbers."""
        return tuple(bool(v) if i in self.booleans and v is not None else v for i, v in enumerate(row))


_KINDS = {LongType: "INTEGER", IntegerType: "INTEGER", ShortType: "INTEGER", ByteType: "INTEGER", BooleanType: "BOOLEAN", DoubleType: "REAL", FloatType: "REAL", BinaryType: "BLOB"}
#: Rows sent to SQLite at a time.
ROWS = 10_000


@dataclass
class _Part(WriterCommitMessage):
    path: str
    rows: int


class SqliteWriter(DataSourceWriter):
    """Each task writes its rows into a database file of its own beside the target; the commit moves all of them into the table in one transaction.

    Until then, and if any task or the commit fails, the table is as it was. Parts that failed attempts leave are removed with the job's folder. The target and
    its folder must lie where driver and executors see them.
    """

    def __init__(self, options: dict[str, str], schema: StructType, overwrite: bool) -> None:
        self.path, self.table, self.overwrite = options["path"], options["table"], overwrite
        self.columns = [(f.name, _KINDS.get(type(f.dataType), "TEXT")) for f in schema.fields]
        self.staged = f"{self.path}-staged-{uuid.uuid4().hex}"

    def _create(self, db: sqlite3.Connection, table: str) -> None:
        db.execute(f"CREATE TABLE IF NOT EXISTS {_name(table)} (" + ", ".join(f"{_name(n)} {kind}" for n, kind in self.columns) + ")")

    def write(self, iterator: Iterator) -> _Part:
        os.makedirs(self.staged, exist_ok=True)
        path, marks, n = f"{self.staged}/{uuid.uuid4().hex}", ", ".join("?" * len(self.columns)), 0
        texts = [kind == "TEXT" for _, kind in self.columns]
        with sqlite3.connect(path) as db:
            self._create(db, "part")
            held = []
            for row in iterator:
                held.append(tuple(str(v) if t and v is not None else v for v, t in zip(row, texts, strict=True)))
                if len(held) == ROWS:
                    db.executemany(f"INSERT INTO part VALUES ({marks})", held)
                    held, n = [], n + len(held)
            db.executemany(f"INSERT INTO part VALUES ({marks})", held)
        db.close()
        return _Part(path, n + len(held))

    def commit(self, messages: Sequence[_Part | None]) -> None:
        db = sqlite3.connect(self.path, isolation_level=None)
        names = ", ".join(_name(n) for n, _ in self.columns)
        try:
            db.execute("BEGIN IMMEDIATE")
            if self.overwrite:
                db.execute(f"DROP TABLE IF EXISTS {_name(self.table)}")
            self._create(db, self.table)
            for part in messages:
                if part is not None:
                    marks = ", ".join("?" * len(self.columns))
                    with sqlite3.connect(f"file:{part.path}?mode=ro", uri=True) as source:
                        db.executemany(f"INSERT INTO {_name(self.table)} ({names}) VALUES ({marks})", source.execute(f"SELECT {names} FROM part"))
                    source.close()
            db.execute("COMMIT")
        except BaseException:
            db.execute("ROLLBACK")
            raise
        finally:
            db.close()
            self._clear()

    def abort(self, messages: Sequence[_Part | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        if os.path.isdir(self.staged):
            for name in os.listdir(self.staged):
                os.unlink(f"{self.staged}/{name}")
            os.rmdir(self.staged)


def write_sqlite_table(df: DataFrame, path: str, table: str, if_exists: str = "replace") -> None:
    """Write a table: replace it, append to it, or fail if there is one. Types that SQLite lacks are written as text."""
    if if_exists not in ("replace", "append", "fail"):
        raise ValueError(f"unknown mode {if_exists}")
    if if_exists == "fail" and os.path.exists(path) and table in sqlite_tables(path):
        raise ValueError(f"{path} has a table {table}")
    df.sparkSession.dataSource.register(SqliteSource)
    df.write.format("sqlite").mode("overwrite" if if_exists == "replace" else "append").options(path=path, table=table).save()


def write_sqlite(frames: Mapping[str, DataFrame], path: str, if_exists: str = "replace") -> None:
    """Each frame as the table of its name; a table at a time, each whole or not at all."""
    for table, df in frames.items():
        write_sqlite_table(df, path, table, if_exists)


def read_sqlite_table(spark: SparkSession, path: str, table: str, **options) -> DataFrame:
    """A table; comparisons on its columns run in SQLite (this turns the session's filter pushdown of Python sources on)."""
    spark.dataSource.register(SqliteSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("sqlite").options(path=path, table=table, **options).load()


def sqlite_tables(path: str) -> list[str]:
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        return [r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type = 'table' ORDER BY name")]


def read_sqlite(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {t: read_sqlite_table(spark, path, t) for t in sqlite_tables(path)}
