"""Tables that change together: a store of versions, each naming the folders that its tables consist of.

A commit writes its rows to new folders first and then one row that lists the
folders of every table: the version. Readers take the latest version, so they
see all of a commit or nothing, and never a path that is not there; a commit
that is cut off leaves folders that no version names. A commit has a name and
counts once: repeated under the same name it does nothing. One writer at a time
may commit to a store; everything goes through Spark's own readers and writers,
so a store can be wherever these reach.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

VERSION = "version long, name string, tables string"


@dataclass(frozen=True)
class Append:
    """Rows that are added to a table."""

    rows: DataFrame


@dataclass(frozen=True)
class Replace:
    """Rows that a table has from now on."""

    rows: DataFrame


def _versions(spark: SparkSession, root: str) -> list[tuple[int, str, dict[str, list[str]]]]:
    """The number, name and tables of each version, the latest last."""
    try:
        rows = spark.read.schema(VERSION).option("recursiveFileLookup", "true").json(f"{root}/versions").collect()  # one row a commit
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    return sorted((r.version, r.name, json.loads(r.tables)) for r in rows)


def _publish(spark: SparkSession, root: str, version: int, name: str, tables: dict[str, list[str]]) -> None:
    row = spark.createDataFrame([(version, name, json.dumps(tables, sort_keys=True))], VERSION)
    row.coalesce(1).write.mode("errorifexists").json(f"{root}/versions/{version:08d}")


def tables(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The tables of the latest version."""
    versions = _versions(spark, root)
    return {name: spark.read.parquet(*folders) for name, folders in versions[-1][2].items() if folders} if versions else {}


def commit(spark: SparkSession, root: str, name: str, change: Callable[[dict[str, DataFrame]], dict[str, Append | Replace]]) -> bool:
    """Makes the changes that ``change`` gives for the tables as they are; False if a commit of that name has been made."""
    versions = _versions(spark, root)
    if any(made == name for _, made, _ in versions):
        return False
    number, _, now = versions[-1] if versions else (0, "", {})
    after = dict(now)
    for table, what in change(tables(spark, root)).items():
        folder = f"{root}/data/{table}-{uuid.uuid4()}"
        what.rows.write.parquet(folder)
        after[table] = [*(now.get(table, []) if isinstance(what, Append) else []), folder]
    _publish(spark, root, number + 1, name, after)
    return True


def by_key(stored: DataFrame | None, rows: DataFrame, key: str) -> DataFrame:
    """``rows``, and the stored rows of other keys."""
    return rows if stored is None else rows.unionByName(stored.join(rows.select(key), key, "left_anti"))
