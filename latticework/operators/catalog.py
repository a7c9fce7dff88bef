"""The catalog of a container: objects, links and attributes as tables.

``objects(path, parent, name, kind, object_id)``, ``links(path, kind, target_path,
target_file)`` with kind hard, soft or external, and ``attributes(path, name,
value)``. Group paths end in ``/`` when walked, dataset paths don't.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.strings import base_name, parent_path, path_problem
from ..plans.session import cut


def with_path_parts(paths: DataFrame, path: str = "path") -> DataFrame:
    return paths.withColumn("parent", parent_path(F.col(path))).withColumn("name", base_name(F.col(path)))


def walk(objects: DataFrame) -> DataFrame:
    """Objects with ``walk_path``, ``depth``, and ``walk_key``, by which they sort depth first, children by the bytes of their names.

    In the key a path's parts are joined by a byte below all bytes of names, so that
    a group comes before what is in it, and that before siblings with longer names.
    """
    bare = F.rtrim("path", F.lit("/"))
    shown = F.when(F.col("kind") == "group", F.concat(bare, F.lit("/"))).otherwise(F.col("path"))
    depth = (F.length(bare) - F.length(F.replace(bare, F.lit("/"), F.lit("")))).cast("int")
    return objects.withColumn("walk_path", shown).withColumn("depth", depth).withColumn("walk_key", F.replace(bare, F.lit("/"), F.lit("\0")))


def walk_ordinals(objects: DataFrame, name: str = "place") -> DataFrame:
    """walk() with each object's place in the walk, from 0.

    Places among siblings and sizes of subtrees are not needed: rows are dealt to
    ranges of the key by Spark's sort, numbered in each, and ranges' counts added.
    """
    rows = walk(objects).repartitionByRange("walk_key").sortWithinPartitions("walk_key", "object_id")
    rows = rows.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    counted = cut(rows)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each range, as many as there are partitions.
    starts = counted.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return counted.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_at")).drop("_part", "_at", "_start")


def visible(objects: DataFrame, links: DataFrame) -> DataFrame:
    """Objects that a walk meets: soft and external links are passed over, hard links show their target."""
    hard = links.where("kind = 'hard'").join(objects.select(F.col("path").alias("target_path"), F.col("kind").alias("target_kind"), "object_id"), "target_path")
    alias = with_path_parts(hard.select("path", F.col("target_kind").alias("kind"), "object_id"))
    return objects.select("path", "kind", "object_id", "parent", "name").unionByName(alias.select("path", "kind", "object_id", "parent", "name"))


def children(objects: DataFrame, parent: str) -> DataFrame:
    return objects.where((F.col("parent") == parent) & (F.col("path") != parent))


def child_counts(objects: DataFrame) -> DataFrame:
    return objects.where("path <> '/'").groupBy("parent").agg(F.count(F.lit(1)).alias("children"))


def reference_counts(objects: DataFrame, links: DataFrame) -> DataFrame:
    """How many paths lead to each object: its own and its hard links."""
    return visible(objects, links).groupBy("object_id").agg(F.count(F.lit(1)).alias("refs"))


def dangling(objects: DataFrame, links: DataFrame) -> DataFrame:
    """Soft links whose target doesn't exist."""
    soft = links.where("kind = 'soft'")
    return soft.join(objects.select(F.col("path").alias("target_path")), "target_path", "left_anti").select("path", "target_path")


def resolve(objects: DataFrame, links: DataFrame) -> DataFrame:
    """(path, target_path, object_id) of soft links whose target exists."""
    return links.where("kind = 'soft'").join(objects.select(F.col("path").alias("target_path"), "object_id"), "target_path").select("path", "target_path", "object_id")


def dereference(rows: DataFrame, objects: DataFrame, reference: str) -> DataFrame:
    """``rows`` with ``path``, that of the object that a reference (an object's id) leads to; null if it leads nowhere."""
    named = objects.select(F.col("object_id").alias("_id"), "path")
    return rows.join(named, F.col(reference) == F.col("_id"), "left").drop("_id", reference)


def orphans(objects: DataFrame, new: DataFrame) -> DataFrame:
    """New paths whose parent group doesn't exist."""
    groups = objects.where("kind = 'group'").select(F.col("path").alias("parent"))
    return with_path_parts(new).withColumn("parent", F.when(F.col("parent") == "", "/").otherwise(F.col("parent"))).join(groups, "parent", "left_anti").select("path", "parent")


def problems(new: DataFrame) -> DataFrame:
    """New paths that aren't valid, and why."""
    return new.withColumn("problem", path_problem(F.col("path"))).where("problem IS NOT NULL")


def upsert_attributes(attributes: DataFrame, new: DataFrame) -> DataFrame:
    """Attributes with new ones added, and those of equal path and name replaced."""
    return attributes.join(new.select("path", "name"), ["path", "name"], "left_anti").unionByName(new.select(*attributes.columns))


def delete_attributes(attributes: DataFrame, gone: DataFrame, strict: bool = True) -> DataFrame:
    """Attributes without some; with ``strict`` it is an error to name one that isn't there."""
    if strict and not gone.join(attributes, ["path", "name"], "left_anti").isEmpty():
        raise KeyError("an attribute to delete doesn't exist")
    return attributes.join(gone.select("path", "name"), ["path", "name"], "left_anti")
