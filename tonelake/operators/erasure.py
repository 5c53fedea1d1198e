"""Erasing accounts from every table that knows them, as one change.

What belongs to an account follows from the keys: rows that name the user, rows that name a job of
the user, and rows whose list of users holds them.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonelake.operators.upserts import erase, erase_by_member

#: Column that names the user, by table. Administrative records of a user go with them.
OWNED = {
    "users": "user_id",
    "jobs": "user_id",
    "subscriptions": "user_id",
    "push_tokens": "user_id",
    "admin_actions": "target_user_id",
}
#: Tables whose rows go with those of another: (table, column in both).
CASCADES = {"stage_runs": ("jobs", "job_id"), "score_versions": ("jobs", "job_id"), "result_cache": ("jobs", "job_id")}
#: Row key and list of users, by table.
SHARED = {"billing_events": ("event_id", "user_ids")}


def erase_accounts(tables: Mapping[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Every table of `tables` without what belongs to the users in `gone` (user_id).

    Rows that hang on an erased row are found by that row's key, so rows without an owner stay. Users
    may be any number: all steps are joins on ids, none carries a list. A table that no rule names
    is refused, so a new table cannot be forgotten.
    """
    unknown = set(tables) - set(OWNED) - set(CASCADES) - set(SHARED)
    if unknown:
        raise ValueError(f"no rule for {sorted(unknown)}")
    gone = gone.select("user_id").distinct()
    kept = {}
    for name, df in tables.items():
        if name in OWNED:
            kept[name] = erase(df, gone, OWNED[name])
        elif name in SHARED:
            kept[name] = erase_by_member(df, gone, *SHARED[name])
        else:
            parent, key = CASCADES[name]
            owner = F.col(OWNED[parent]).alias("user_id")
            lost = tables[parent].select(key, owner).join(gone, "user_id", "left_semi").select(key).distinct()
            kept[name] = df.join(lost, key, "left_anti")
    return {name: df.select(*tables[name].columns) for name, df in kept.items()}


class TableSet:
    """Tables below one folder that change together.

    Each change writes whole tables into folders of its own and then one row into `versions`, which
    names them. Readers go by the newest row, so they see all tables of a change or none; what a
    failed change has written is never read.
    """

    _VERSIONS = "version bigint, name string, path string"

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = spark
        self.root = root.rstrip("/")

    def _paths(self, version: int | None) -> dict[str, str]:
        if version is None:
            return {}
        rows = self.spark.read.schema(self._VERSIONS).parquet(f"{self.root}/versions")
        return {r.name: r.path for r in rows.where(F.col("version") == version).collect()}

    def newest(self) -> int | None:
        """Number of the last change; None before the first."""
        try:
            rows = self.spark.read.schema(self._VERSIONS).parquet(f"{self.root}/versions")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        return rows.agg(F.max("version")).first()[0]

    def read(self) -> dict[str, DataFrame]:
        return {name: self.spark.read.parquet(path) for name, path in self._paths(self.newest()).items()}

    def change(self, tables: Mapping[str, DataFrame]) -> int:
        """Put `tables` in place of those of the same names; the others stay as they are."""
        last = self.newest()
        version = 0 if last is None else last + 1
        paths = self._paths(last)
        for name, df in tables.items():
            paths[name] = f"{self.root}/data/{version}-{uuid.uuid4().hex}/{name}"
            df.write.parquet(paths[name])
        rows = [(version, name, path) for name, path in sorted(paths.items())]
        self.spark.createDataFrame(rows, self._VERSIONS).coalesce(1).write.mode("append").parquet(f"{self.root}/versions")
        return version


def erase_from(store: TableSet, gone: DataFrame) -> int:
    """Erase users from all tables of a store in one change; returns its number."""
    return store.change(erase_accounts(store.read(), gone))
