"""All-or-nothing publication of several tables below one root folder.

Table data is written aside, each write into a folder of its own that no
reader knows yet; then one small manifest (table -> its folders) is renamed
into place under the next number. Readers follow the greatest number, so they
see either the state before or the state after, never some tables of each. A
writer that is lost before the rename changes nothing; one that finds its number
taken fails (``Conflict``) and may run again on the new state.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cauce.sources.store import duplicate_keys


class Conflict(RuntimeError):
    """Another writer published first."""


def _context(spark: SparkSession, root: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    return spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), spark._jsc.hadoopConfiguration())


def _path(spark: SparkSession, *parts: str):
    return spark._jvm.org.apache.hadoop.fs.Path("/".join(parts))


def _manifests(spark: SparkSession, root: str) -> list[str]:
    folder = _path(spark, root, "manifests")
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return []
    return sorted(n for n in (s.getPath().getName() for s in files.listStatus(folder)) if n.endswith(".json"))


def current(spark: SparkSession, root: str) -> tuple[int, dict[str, list[str]]]:
    """Number and tables of the published state; (0, {}) before the first."""
    names = _manifests(spark, root)
    if not names:
        return 0, {}
    text = spark.read.text(f"{root}/manifests/{names[-1]}", wholetext=True).first()[0]
    return int(names[-1].split(".")[0]), json.loads(text)


def read(spark: SparkSession, root: str, table: str) -> DataFrame:
    """The table as published."""
    _, tables = current(spark, root)
    return spark.read.parquet(*[f"{root}/{f}" for f in tables[table]])


def publish(spark: SparkSession, root: str, replace: dict[str, DataFrame] | None = None, append: dict[str, DataFrame] | None = None,
            base: int | None = None) -> int:
    """Publish new contents (``replace``) and further rows (``append``) of tables in one step; returns the new number.

    Tables not named stay as they are; appended rows are a further folder, so
    what is stored is not rewritten. ``base`` is the state the rows were made
    from (the one at the call if None).
    """
    number, tables = current(spark, root)
    if base is not None and base != number:
        raise Conflict(f"{root}: state {base} was read, {number} is published")
    tables = dict(tables)
    for frames, keep in ((replace or {}, False), (append or {}, True)):
        for table, frame in frames.items():
            folder = f"data/{table}-{uuid.uuid4().hex}"
            frame.write.parquet(f"{root}/{folder}")
            tables[table] = [*(tables.get(table, []) if keep else []), folder]
    files = _context(spark, root)
    files.mkdir(_path(spark, root, "manifests"), None, True)
    draft, target = _path(spark, root, "manifests", f".{uuid.uuid4().hex}"), _path(spark, root, "manifests", f"{number + 1:012d}.json")
    out = draft.getFileSystem(spark._jsc.hadoopConfiguration()).create(draft, False)
    out.write(bytearray(json.dumps(tables).encode()))
    out.close()
    rename = spark._jvm.org.apache.hadoop.fs.Options.Rename
    how = spark._sc._gateway.new_array(rename, 1)
    how[0] = rename.NONE
    try:
        files.rename(draft, target, how)
    except Exception as e:
        if files.util().exists(target):
            raise Conflict(f"{root}: state {number + 1} was published meanwhile") from e
        raise
    return number + 1


def bulk_load(spark: SparkSession, root: str, persons: DataFrame, key: str = "cedula") -> int:
    """S-08: all persons or none, plain inserts; returns their number. A null key,
    one that repeats or one that is stored refuses the whole load."""
    number, tables = current(spark, root)
    stored = read(spark, root, "persons") if "persons" in tables else None
    bad = duplicate_keys(persons, [key], stored).unionByName(persons.filter(F.col(key).isNull()).select(key).limit(1)).head()
    if bad is not None:
        raise ValueError(f"{key} {bad[0]!r} is null, repeated or stored already")
    publish(spark, root, append={"persons": persons}, base=number)
    _, after = current(spark, root)
    return spark.read.parquet(f"{root}/{after['persons'][-1]}").count()


def replace_dataset(spark: SparkSession, root: str, persons: DataFrame) -> int:
    """S-10: new persons and an empty outbox in one step; returns the persons removed."""
    number, tables = current(spark, root)
    removed = read(spark, root, "persons").count() if "persons" in tables else 0
    cleared = {"scheduled_messages": read(spark, root, "scheduled_messages").limit(0)} if "scheduled_messages" in tables else {}
    publish(spark, root, replace={"persons": persons, **cleared}, base=number)
    return removed


def without_batches(tables: dict[str, DataFrame], deleted: DataFrame, key: str = "batch_id") -> dict[str, DataFrame]:
    """J-11: every table without the rows of the deleted batches. Rows without a batch stay."""
    gone = deleted.select(key).distinct()
    return {name: frame.join(gone, key, "left_anti").select(*frame.columns) for name, frame in tables.items()}


def delete_batches(spark: SparkSession, root: str, deleted: DataFrame, children: tuple[str, ...] = ("batch_persons",), parent: str = "batches") -> int:
    """J-11 on the published tables: batches and the rows that hang on them go in one step."""
    number, _ = current(spark, root)
    return publish(spark, root, replace=without_batches({t: read(spark, root, t) for t in (parent, *children)}, deleted), base=number)
