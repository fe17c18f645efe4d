"""Selection of work: queues, budgets, quotas, ordered lookups, set checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.text import like_pattern
from threadloom.session import cut

# Statuses before and after crawling, and the rank of finished ones.
RETRYABLE = ("pending_crawl", "crawl_failed", "extraction_failed")
POST_CRAWL = ("crawled", "crawled_wayback", "title_only")
GENERIC_SOURCES = ("generic", "youtube", "web")


def status_rank(c: Column) -> Column:
    return F.when(c == "crawled", 0).when(c == "crawled_wayback", 1).when(c == "title_only", 2).otherwise(99)


def is_generic(c: Column) -> Column:
    return c.isNull() | c.isin(*GENERIC_SOURCES)


def source_class(c: Column) -> Column:
    """reddit, linkedin, x, or generic for all others and null."""
    return F.when(c.isin("reddit", "linkedin", "x"), c).otherwise("generic")


def running(df: DataFrame, values: dict[str, str] | str, order: list[Column], alias: str = "running", buckets: int = 64) -> DataFrame:
    """Running sums over a total order without one task for all rows.

    The rows are cut into ranges of the whole order (sampled bounds of all its
    columns, so a first column of few values splits as well) and written once;
    sums of whole ranges (at most ``buckets`` rows) are added to the sums inside
    the range. values: new column by summed column, or one column for ``alias``.
    """
    values = {values: alias} if isinstance(values, str) else values
    d = cut(df.repartitionByRange(buckets, *order).withColumn("_range", F.spark_partition_id()))
    sums = d.groupBy("_range").agg(*(F.sum(v).alias(f"_s_{a}") for v, a in values.items()))
    before = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # at most ``buckets`` rows
    sums = sums.select("_range", *(F.coalesce(F.sum(f"_s_{a}").over(before), F.lit(0)).alias(f"_b_{a}") for a in values.values()))
    w = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = d.join(F.broadcast(sums), "_range")
    return out.withColumns({a: F.col(f"_b_{a}") + F.sum(v).over(w) for v, a in values.items()}).drop("_range", *(f"_b_{a}" for a in values.values()))


def ranked(df: DataFrame, order: list[Column], alias: str = "rank") -> DataFrame:
    """The number of each row in a total order, from 1, without one task for all rows."""
    return running(df.withColumn("_one", F.lit(1)), {"_one": alias}, order).drop("_one")


def budget_prefix(df: DataFrame, cost: str, order: list[Column], budget: float, first_free: bool = True, most: int | None = None) -> DataFrame:
    """The longest prefix of the order whose cost stays within the budget.

    first_free admits the first row whatever it costs; ``most`` also caps the rows.
    Costs are not negative, so the prefix is a filter on the running sum.
    """
    d = running(df.withColumn("_one", F.lit(1)), {cost: "running_cost", "_one": "rank"}, order).drop("_one")
    ok = F.col("running_cost") <= budget
    if first_free:
        ok = ok | (F.col("rank") == 1)
    if most is not None:
        ok = ok & (F.col("rank") <= most)
    return d.where(ok)


def quota_topk(df: DataFrame, klass: Column, quotas: dict[str, int], order: list[Column]) -> DataFrame:
    """The first rows of each class up to its quota; classes without a quota give none."""
    q = F.element_at(F.create_map(*(F.lit(x) for kv in quotas.items() for x in kv)), F.col("_class"))
    d = df.withColumn("_class", klass).where(F.col("_class").isin(*quotas))
    most = max(quotas.values(), default=0)
    w = Window.partitionBy("_class").orderBy(*order)
    return d.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).where(F.col("_n") <= q).withColumnRenamed("_class", "source_class").withColumnRenamed("_n", "rank")


def cascade(pending: DataFrame, limit: int) -> DataFrame:
    """(pos, class, pending, cap) to take = min(pending, cap, what the classes before left)."""
    want = F.least("pending", "cap")
    before = F.coalesce(F.sum(want).over(Window.partitionBy(F.lit(0)).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a few classes
    return pending.withColumn("take", F.greatest(F.lit(0), F.least(want, limit - before)))


def ordered_lookup(ids: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """(pos, key) joined with rows, to be ordered by pos."""
    return ids.join(rows, key).orderBy("pos")


def missing_ids(ids: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    return ids.join(rows.select(key), key, "left_anti")


def unseen(candidates: DataFrame, *existing: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates without a row in any of the existing tables (null-safe)."""
    out = candidates.alias("c")
    for e in existing:
        d = e.select(*keys).distinct().alias("e")
        cond = None
        for k in keys:
            x = F.col(f"c.{k}").eqNullSafe(F.col(f"e.{k}"))
            cond = x if cond is None else cond & x
        out = out.join(d, cond, "left_anti").alias("c")
    return out


def translate(rows: DataFrame, other: DataFrame, primary: DataFrame, other_id: str, other_key: str, primary_key: str, primary_id: str) -> DataFrame:
    """Ids of one store by way of a shared key to ids of another; one row per id."""
    a = rows.join(other.select(F.col(other_id).alias("_o"), F.col(other_key).alias("_k")), F.col(rows.columns[0]) == F.col("_o"))
    b = a.join(primary.select(F.col(primary_key).alias("_pk"), F.col(primary_id).alias("_pid")), F.col("_k") == F.col("_pk"))
    return b.groupBy(F.col("_pid").alias(primary_id)).agg(F.min(rows.columns[0]).alias("from_id"))


def top_per_group(df: DataFrame, group: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(rank) <= k)


def contains_url(c: Column, part: str) -> Column:
    """Whether an address contains a piece of text, without regard to ASCII case; the piece stands for itself."""
    return F.coalesce(c.ilike(like_pattern(part)), F.lit(False))


def by_subreddit(sub: Column, names: list[str], mode: str = "include") -> Column:
    """Include or exclude the named subreddits; no names pass all, an unknown one passes only if names are excluded."""
    if not names:
        return F.lit(True)
    hit = F.lower(sub).isin(*(n.strip().lower().removeprefix("r/") for n in names))
    known = F.coalesce(sub, F.lit("")) != ""
    return F.when(known, ~hit if mode == "exclude" else hit).otherwise(F.lit(mode == "exclude"))


def row_limit(text: str | None) -> int | None:
    """The number of rows asked for; None (all) if blank, not a number or not positive."""
    try:
        n = int((text or "").strip())
    except ValueError:
        return None
    return n if n > 0 else None


def next_items(pending: DataFrame, order: list[Column], n: int = 1) -> DataFrame:
    """The first pending rows of a queue; a sort with a limit keeps n rows per task."""
    return pending.orderBy(*order).limit(n)


def dictionary(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, row): a named projection, one row per key."""
    return rows.groupBy(key).agg(F.max(F.struct(*columns)).alias("row"))
