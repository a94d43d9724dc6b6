"""Merging new rows into tables that can't be changed in place: each operator returns the table's next state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first by a total order; null keys form one group."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__rank")


def upsert(target: DataFrame, updates: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Rows of updates replace those of target with equal keys; of several the first by order counts. Columns that updates lack become null."""
    new = first_by(updates, keys, order)
    return target.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def insert_or_ignore(target: DataFrame, updates: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Rows of updates whose keys target doesn't have yet are added."""
    return target.unionByName(first_by(updates, keys, order).join(target.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def replace_children(target: DataFrame, updates: DataFrame, parents: DataFrame, parent: str) -> DataFrame:
    """All rows of the given parents are replaced by those of updates, also by none."""
    return target.join(parents.select(parent).distinct(), parent, "left_anti").unionByName(updates.join(parents.select(parent).distinct(), parent, "left_semi"))


def set_once(target: DataFrame, updates: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Fills a column where it is null; a value that is there stays. updates holds each key once."""
    new = updates.select(*keys, F.col(column).alias("__new"))
    return target.join(new, keys, "left").withColumn(column, F.coalesce(column, "__new")).drop("__new")


def keep_on_error(target: DataFrame, updates: DataFrame, keys: list[str], kept: list[str], status: str = "status") -> DataFrame:
    """An upsert in which rows that report an error leave the kept columns of the old row as they are."""
    old = target.select(*keys, *[F.col(c).alias(f"__{c}") for c in kept])
    new = updates.join(old, keys, "left")
    for c in kept:
        new = new.withColumn(c, F.when(F.col(status) == "error", F.coalesce(F.col(f"__{c}"), F.col(c))).otherwise(F.col(c)))
    new = new.select(*updates.columns)
    return target.join(updates.select(*keys), keys, "left_anti").unionByName(new)


def numbered_names(files: DataFrame, group: str, name: Column, content: str, order: str) -> DataFrame:
    """Names for the distinct contents of a group: the first to come keeps the name, the r-th is called stem_{r-1}.ext.

    Rows of one content share a name; null contents are left out; ties in order fall to the smaller content.
    """
    f = files.where(F.col(content).isNotNull()).withColumn("__name", name)
    one = f.groupBy(group, "__name", content).agg(F.min(order).alias("__first"))
    ranked = one.withColumn("__rank", F.row_number().over(Window.partitionBy(group, "__name").orderBy("__first", content)))
    stem, ext = F.regexp_extract("__name", r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract("__name", r"^(.*?)(\.[^.]*)?$", 2)
    given = F.when(F.col("__rank") == 1, F.col("__name")).otherwise(F.concat(stem, F.lit("_"), (F.col("__rank") - 1).cast("string"), ext))
    return ranked.select(group, content, given.alias("stored_name"))
