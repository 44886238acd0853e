"""Updates of stored split settings that keep layout types and parameters consistent, as joins by key.

A record has a layout type (null: the default) and parameters of a kind (null: none). A type other than auto conflicts with
parameters of another kind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AUTO = "auto"


def conflicts(kind: Column, layout_type: Column) -> Column:
    return kind.isNotNull() & (layout_type != AUTO) & (kind != layout_type)


def _merged(settings: DataFrame, actions: DataFrame, key: str) -> DataFrame:
    """Every record and action by key: own_* as stored, new_* after the action. actions: key, set_type, layout_type, set_kind, kind (one row a key)."""
    own = settings.select(key, F.col("layout_type").alias("own_type"), F.col("kind").alias("own_kind"))
    both = own.join(actions.select(key, "set_type", F.col("layout_type").alias("to_type"), "set_kind", F.col("kind").alias("to_kind")), key, "full")
    chosen = lambda flag, to, stored: F.when(F.coalesce(F.col(flag), F.lit(False)), F.col(to)).otherwise(F.col(stored))
    return both.withColumns({"new_type": chosen("set_type", "to_type", "own_type"), "new_kind": chosen("set_kind", "to_kind", "own_kind")})


def update(settings: DataFrame, actions: DataFrame, default: str = AUTO, key: str = "img_ord") -> DataFrame:
    """The records after the actions: parameters that conflict with the type go, and records that hold nothing."""
    m = _merged(settings, actions, key)
    touched = F.col("set_type").isNotNull() | F.col("set_kind").isNotNull()
    lost = touched & F.coalesce(conflicts(F.col("new_kind"), F.coalesce("new_type", F.lit(default))), F.lit(False))
    d = m.select(key, F.col("new_type").alias("layout_type"), F.when(~lost, F.col("new_kind")).alias("kind"))
    return d.where("layout_type IS NOT NULL OR kind IS NOT NULL")


def conditional_update(settings: DataFrame, actions: DataFrame, default: str = AUTO, key: str = "img_ord") -> DataFrame:
    """The records after the actions, with conflict: an action that would make a conflict is refused and changes nothing. A refused
    action on a missing record gives a row that holds nothing."""
    m = _merged(settings, actions, key)
    touched = F.col("set_type").isNotNull() | F.col("set_kind").isNotNull()
    refused = touched & F.coalesce(conflicts(F.col("new_kind"), F.coalesce("new_type", F.lit(default))), F.lit(False))
    pick = lambda new, own: F.when(refused, F.col(own)).otherwise(F.col(new))
    d = m.select(key, pick("new_type", "own_type").alias("layout_type"), pick("new_kind", "own_kind").alias("kind"), refused.alias("conflict"))
    return d.where("conflict OR layout_type IS NOT NULL OR kind IS NOT NULL")


def set_type_for_all(settings: DataFrame, layout_type: str) -> DataFrame:
    """The records after a new default for all pages: those that conflict go, the others lose their own type."""
    stays = ~F.coalesce(conflicts(F.col("kind"), F.lit(layout_type)), F.lit(False))
    return settings.where(stays).withColumn("layout_type", F.lit(None).cast("string"))
