"""Problem 9: mixing sources to target weights.

Efraimidis-Spirakis sampling: each document gets the key -ln(u) / w, with u a
uniform hash of its id and w its quality weight; documents of a source in key
order, cut at the token budget, are a weighted sample without replacement. A
source's budget first takes complete epochs (every document once each), then
the prefix of the next epoch in key order.

The prefix sum has two levels: tokens per source and key bucket (a small
aggregate with partial sums), then the exact order inside the one bucket in
which the budget ends. No source is sorted as a whole, so a source with a third
of all rows is no task of its own.

The total is the largest for which every source with documents reaches its
share within its repeats, unless it is given. A source without documents has
nothing to give: its share is reported as 0 and the others keep their relation.

Edge cases: source names are compared without case and surrounding blanks; null
sources and those without a target are left out; null and empty texts have no
tokens and are never chosen; ties in the key go to the smaller doc_id; null
shares and repeats count as 0 and 1; empty tables give no rows; other columns
are ignored. Targets are a small table, checked against ``MAX_SOURCES``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.llm.tokens import DEFAULT_RANKS, with_tokens
from threadloom.session import cut

MAX_SOURCES = 10_000
#: buckets per factor e of the key: whatever the weights of a source, a bucket holds at most 1 / (e * PER_E) of its documents (0.04 %)
PER_E = 1_024


def _name(c: str):
    return F.lower(F.trim(F.col(c)))


def quality(text: str = "text"):
    """Weight in (0, 1]: share of letters and blanks, and less for very short texts."""
    n = F.greatest(F.length(text), F.lit(1))
    letters = F.length(F.regexp_replace(text, r"[^\p{L} ]+", ""))
    return F.greatest(F.lit(0.05), (letters / n) * F.least(F.lit(1.0), F.log1p(n) / F.log(F.lit(400.0))))


def keyed(docs: DataFrame, seed: int = 1, ranks: str = DEFAULT_RANKS) -> DataFrame:
    """(doc_id, source, tokens, key) of the documents with tokens."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _name("source").alias("source"), quality().alias("w"), "text").where("doc_id is not null and source <> '' and text <> ''")
    u = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    return with_tokens(d, ["doc_id", "source", "w"], ranks).where("tokens > 0").select("doc_id", "source", "tokens", (-F.log(u) / F.col("w")).alias("key"))


def budgets(tokens: dict[str, int], targets: dict[str, tuple[float, int]], total: int | None = None) -> dict[str, int]:
    """Token budget of every source that has documents and a share."""
    live = {s: (share, rep) for s, (share, rep) in targets.items() if share > 0 and rep > 0 and tokens.get(s, 0) > 0}
    whole = sum(share for share, _ in live.values())
    if not live:
        return {}
    most = min(rep * tokens[s] / (share / whole) for s, (share, rep) in live.items())
    t = most if total is None else min(most, total)
    return {s: int(t * share / whole) for s, (share, _) in live.items()}


def mixed(docs: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 1, ranks: str = DEFAULT_RANKS) -> tuple[DataFrame, DataFrame]:
    """The collection (doc_id, source, epoch, tokens) and the keyed documents it comes from."""
    spark = docs.sparkSession
    rows = targets.select(_name("source").alias("s"), F.coalesce("target_share", F.lit(0.0)).alias("t"), F.coalesce("max_repeats", F.lit(1)).alias("r")).where("s is not null").limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    goal: dict[str, tuple[float, int]] = {}
    for r in rows:
        have = goal.get(r["s"], (0.0, 0))
        goal[r["s"]] = (have[0] + r["t"], max(have[1], r["r"]))
    k = cut(keyed(docs, seed, ranks).where(F.col("source").isin(sorted(goal))))
    k = k.withColumn("bucket", F.floor(F.log("key") * PER_E).cast("int"))
    sums = {r["source"]: r["n"] for r in k.groupBy("source").agg(F.sum("tokens").alias("n")).collect()}  # at most MAX_SOURCES rows
    plan = [(s, b // sums[s], b % sums[s]) for s, b in sorted(budgets(sums, goal, total).items())]
    plan = spark.createDataFrame(plan, "source string, epochs long, rest long")
    w = Window.partitionBy("source").orderBy("bucket")
    steps = k.groupBy("source", "bucket").agg(F.sum("tokens").alias("t")).withColumn("before", F.sum("t").over(w) - F.col("t"))
    steps = steps.join(F.broadcast(plan), "source").where("before < rest").select("source", "bucket", "before", "rest", (F.col("before") + F.col("t") <= F.col("rest")).alias("all_of_it"))
    whole = k.join(F.broadcast(plan.where("epochs > 0")), "source").select("doc_id", "source", F.explode(F.expr("sequence(1L, epochs)")).alias("epoch"), "tokens")
    part = k.join(steps, ["source", "bucket"]).join(F.broadcast(plan.select("source", "epochs")), "source")
    full = part.where("all_of_it").select("doc_id", "source", (F.col("epochs") + 1).alias("epoch"), "tokens")
    o = Window.partitionBy("source", "bucket").orderBy("key", "doc_id")
    last = part.where("not all_of_it").withColumn("upto", F.col("before") + F.sum("tokens").over(o.rowsBetween(Window.unboundedPreceding, 0)))
    # up to the document with which the budget is met most closely
    over, under = F.col("upto") - F.col("rest"), F.col("rest") - (F.col("upto") - F.col("tokens"))
    last = last.where((over <= 0) | ((under > 0) & (over < under)))
    last = last.select("doc_id", "source", (F.col("epochs") + 1).alias("epoch"), "tokens")
    return whole.unionByName(full).unionByName(last), k


def shares(collection: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source of the targets: target and actual share, tokens, documents and the most repeats of one."""
    per = collection.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("rows"), F.countDistinct("doc_id").alias("documents"), F.max("epoch").alias("repeats"))
    t = targets.select(_name("source").alias("source"), "target_share", "max_repeats").groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    j = t.join(per, "source", "left").na.fill(0, ["tokens", "rows", "documents", "repeats"])
    total = F.sum("tokens").over(Window.partitionBy())  # a handful of rows: one per target
    return j.withColumn("actual_share", F.when(total > 0, F.col("tokens") / total).otherwise(F.lit(0.0)))
