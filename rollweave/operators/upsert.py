"""Keyed merges and the integrity checks that stand for database constraints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def latest(updates: DataFrame, keys: Sequence[str], order: Column | None = None) -> DataFrame:
    """One row per key, the last by ``order`` (ties and no order: the largest row)."""
    rest = [c for c in updates.columns if c not in keys]
    first = [order.desc_nulls_last()] if order is not None else []
    w = Window.partitionBy(*keys).orderBy(*first, *[F.col(c).desc_nulls_last() for c in rest])
    return updates.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def merge_rows(
    target: DataFrame, updates: DataFrame, keys: Sequence[str], keep: Sequence[str] = ("created_at",)
) -> DataFrame:
    """Insert or replace by key. ``updates`` holds one row per key; columns in ``keep`` stay
    as the target has them, columns the updates lack become NULL on insert."""
    fresh = [c for c in updates.columns if c not in keys]
    new = updates.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in fresh], F.lit(True).alias("_hit"))
    joined = target.withColumn("_old", F.lit(True)).join(new, list(keys), "full_outer")

    def column(name: str) -> Column:
        if name in keys:
            return F.col(name)
        if name not in fresh:
            return F.col(name)
        incoming = F.col(f"_new_{name}").cast(target.schema[name].dataType)
        if name in keep:
            return F.when(F.col("_old"), F.col(name)).otherwise(incoming).alias(name)
        return F.when(F.col("_hit"), incoming).otherwise(F.col(name)).alias(name)

    return joined.select(*[column(c) for c in target.columns])


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows whose (non-NULL) key the parent lacks."""
    known = parent.select(F.col(parent_key).alias(child_key)).distinct()
    return child.where(F.col(child_key).isNotNull()).join(known, child_key, "left_anti")


def loadable(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    known = parent.select(F.col(parent_key).alias(child_key)).distinct()
    return child.join(known, child_key, "left_semi")


def key_violations(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, NULL keys left out as UNIQUE does."""
    present = df.dropna(subset=list(keys))
    return present.groupBy(*keys).agg(F.count("*").alias("occurrences")).where("occurrences > 1")


def orphan_counts(tables: dict[str, DataFrame], foreign_keys: Sequence[tuple]) -> DataFrame:
    """One row per foreign key with its number of orphan values."""
    reports = []
    for child, ck, parent, pk in foreign_keys:
        if child in tables and parent in tables:
            bad = orphans(tables[child].select(ck), tables[parent], ck, pk)
            reports.append(
                bad.agg(F.count("*").alias("orphans")).select(
                    F.lit(child).alias("child"), F.lit(ck).alias("column"),
                    F.lit(parent).alias("parent"), "orphans",
                )
            )
    out = reports[0]
    for r in reports[1:]:
        out = out.unionByName(r)
    return out


def select_states(states: DataFrame, state_id: str | None = None) -> DataFrame:
    """Registry rows as rows of the ``states`` table."""
    rows = states.select(
        "state_id", "eci_state_code", "name", "default_language", "data_capability", "public_launch_ready"
    )
    return rows if state_id is None else rows.where(F.col("state_id") == state_id)


def seed_states(target: DataFrame, states: DataFrame, state_id: str | None = None) -> DataFrame:
    """Registry states put into the table; ValueError if there is none, or none of that id."""
    if select_states(states, state_id).isEmpty():
        raise ValueError("no states to seed" if state_id is None else f"unknown state: {state_id}")
    return merge_rows(target, select_states(states, state_id), ["state_id"])


def append_new(existing: DataFrame, new: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(merged, rejected): rows whose key exists already, or comes twice in ``new``, are
    rejected, not replaced; of several new rows with a key the smallest is added."""
    known = existing.select(key).distinct().withColumn("_known", F.lit(True))
    nth = F.row_number().over(Window.partitionBy(key).orderBy(*[F.col(c) for c in existing.columns if c != key]))
    placed = new.withColumn("_nth", nth).join(known, key, "left").withColumn(
        "_new", F.col("_known").isNull() & ((F.col("_nth") == 1) | F.col(key).isNull()))
    added = placed.where("_new").select(*existing.columns)
    rejected = placed.where("NOT _new").select(*new.columns).withColumn(        "error", F.concat(F.lit(f"{key} already exists in manifest: "), F.col(key))
    )
    return existing.unionByName(added), rejected
