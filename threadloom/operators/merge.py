"""Merge rules: every rule is a function of (old, new) tables to the new state.

All compute one aggregate per key over the union with the later batch winning,
so a rule applied twice gives what it gave once, and keys need no sorted task:
``max_by`` combines on the map side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key by the order."""
    rest = [c for c in df.columns if c not in keys]
    row = F.max_by(F.struct(*rest), F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)))).alias("_r")
    return df.groupBy(*keys).agg(row).select(*(F.col(k) if k in keys else F.col("_r")[k].alias(k) for k in df.columns))


def keep_first(df: DataFrame, keys: list[Column | str], order: list[Column]) -> DataFrame:
    """The first row of each key in input order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def overwrite(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Full overwrite by key: a new row replaces the old one."""
    both = old.withColumn("_s", F.lit(0)).unionByName(new.withColumn("_s", F.lit(1)), allowMissingColumns=True)
    return latest(both, keys, [F.col("_s")]).drop("_s")


def overwrite_keep(old: DataFrame, new: DataFrame, keys: list[str], kept: list[str]) -> DataFrame:
    """Overwrite by key, but the kept columns of an existing row stay if filled."""
    o = old.select(*keys, *(F.col(c).alias(f"_{c}") for c in kept), F.lit(True).alias("_had"))
    cols = [F.coalesce(f"_{c}", c).alias(c) if c in kept else F.col(c) for c in new.columns]
    merged = new.join(o, keys, "left").select(*cols)
    return old.join(new.select(*keys), keys, "left_anti").unionByName(merged)


def fill_or_insert(old: DataFrame, new: DataFrame, keys: list[str], fill: list[str], order: list[Column]) -> tuple[DataFrame, DataFrame]:
    """Existing rows keep all but blank fill columns; absent keys are inserted.

    Returns the state and one outcome per new row (inserted or existing); the
    second row of a key within the batch counts as existing. Keys compare null-safe.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    n = new.withColumn("_n", F.row_number().over(w))
    first = n.where("_n = 1").drop("_n")
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    o, f = old.alias("o"), first.alias("f")
    same = None
    for k in keys:
        c = F.col(f"o.{k}").eqNullSafe(F.col(f"f.{k}"))
        same = c if same is None else same & c
    kept = o.join(f, same, "left").select(*(F.when(blank(f"o.{c}"), F.coalesce(f"f.{c}", f"o.{c}")).otherwise(F.col(f"o.{c}")).alias(c) if c in fill else F.col(f"o.{c}").alias(c) for c in old.columns))
    added = f.join(o, same, "left_anti")
    state = kept.unionByName(added.select(*[c for c in old.columns if c in new.columns]), allowMissingColumns=True)
    here = old.select(*keys).distinct().withColumn("_had", F.lit(True)).alias("h")
    cond = None
    for k in keys:
        c = F.col(f"h.{k}").eqNullSafe(F.col(f"n.{k}"))
        cond = c if cond is None else cond & c
    outcome = n.alias("n").join(here, cond, "left").select("n.*", F.when(F.col("h._had") | (F.col("n._n") > 1), "existing").otherwise("inserted").alias("outcome")).drop("_n")
    return state, outcome


def first_last_seen(rows: DataFrame, key: list[str], batch: str, first: list[str], last: list[str], last_filled: list[str] = ()) -> DataFrame:
    """first_seen and last_seen batch of each key; some columns from the first row, some from the last, some from the last filled one."""
    b = F.col(batch)
    aggs = [F.min(b).alias("first_seen_batch"), F.max(b).alias("last_seen_batch")]
    aggs += [F.min_by(c, b).alias(c) for c in first] + [F.max_by(c, b).alias(c) for c in last]
    aggs += [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), b)).alias(c) for c in last_filled]
    return rows.groupBy(*key).agg(*aggs)


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Absent keys are added, existing ones stay as they are."""
    return old.unionByName(keep_first(new, keys, order).join(old.select(*keys), keys, "left_anti").select(*old.columns))


def compute_once(wanted: DataFrame, have: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that were not computed yet."""
    return wanted.join(have.select(*keys).distinct(), keys, "left_anti")


def delete_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key), key, "left_anti")


def restore(current: DataFrame, snapshot: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The named rows as they were in the snapshot, all others as they are."""
    return delete_ids(current, ids, key).unionByName(snapshot.join(ids.select(key).distinct(), key, "left_semi"))


def changed(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Keys of both snapshots for which any column differs (null-safe)."""
    a, b = before.alias("a"), after.alias("b")
    diff = None
    for c in columns:
        d = ~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
        diff = d if diff is None else diff | d
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}")).where(diff).select(F.col(f"a.{key}").alias(key))


def mirror(target: DataFrame, batch: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """A batch into its mirror: the new state and (received, inserted, updated, unchanged, after) counts.

    The batch's rows replace those of their key; of rows of one key in a batch any
    stands for all (they are copies). One aggregate gives every count, so the
    mirror is read once for the state and once for the counts.
    """
    rest = [c for c in batch.columns if c not in keys]
    new = batch.groupBy(*keys).agg(F.count("*").alias("_n"), F.max(F.struct(*rest)).alias("_new"))
    old = target.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("_old"))
    both = old.join(new, keys, "full")
    state = both.select(*keys, F.coalesce("_new", "_old").alias("_r")).select(*(F.col(k) if k in keys else F.col("_r")[k].alias(k) for k in batch.columns))
    has_new, has_old = F.col("_new").isNotNull(), F.col("_old").isNotNull()
    counts = both.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("received"), F.count_if(has_new & ~has_old).alias("inserted"), F.count_if(has_new & has_old & ~F.col("_new").eqNullSafe(F.col("_old"))).alias("updated"),
        F.count_if(has_new & F.col("_new").eqNullSafe(F.col("_old"))).alias("unchanged"), F.count("*").alias("after"),
    )
    return state, counts


def counts_per_batch(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """(table_name, batch_id, n): rows per batch of several tables; tables: name -> (rows, batch column)."""
    out = None
    for name, (df, batch) in tables.items():
        g = df.groupBy(F.col(batch).alias("batch_id")).agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "batch_id", "n")
        out = g if out is None else out.unionByName(g)
    return out
