"""Graph operators: edges, document frequency, similarity, components, hierarchy."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.text import tokens
from threadloom.operators.merge import latest
from threadloom.session import cut, release


def l2(v: Column) -> Column:
    """The vector over its length (at least 1e-12)."""
    d = F.transform(v, lambda x: x.cast("double"))
    n = F.greatest(F.sqrt(F.aggregate(d, F.lit(0.0), lambda a, x: a + x * x)), F.lit(1e-12))
    return F.transform(d, lambda x: x / n)


def source_concept_edges(mentions: DataFrame) -> DataFrame:
    """(source_id, concept_id, confidence, pos): one edge per pair, the last mention's confidence."""
    return mentions.groupBy("source_id", "concept_id").agg(F.max_by(F.struct("confidence"), "pos")["confidence"].alias("confidence"))


def doc_freq(edges: DataFrame, touched: DataFrame | None = None) -> DataFrame:
    """Sources per concept over all edges; only touched concepts if given."""
    e = edges if touched is None else edges.join(touched.select("concept_id").distinct(), "concept_id", "left_semi")
    return e.groupBy("concept_id").agg(F.countDistinct("source_id").alias("doc_freq"))


def cosine_edges(batch: DataFrame, targets: DataFrame, k: int = 8, min_sim: float = 0.55, block: int = 2_000) -> DataFrame:
    """(a, b, strength, rank): the k most similar targets of each batch node, itself excepted.

    Exact: batch and targets are cut into blocks, each pair of blocks is one
    group (a block nested loop, for a batch against all) and one matrix product,
    and only the best k of a group go on. (id, v) with v an array.
    """
    nb, nt = batch.count(), targets.count()
    gb, gt = max(1, -(-nb // block)), max(1, -(-nt // block))
    h = lambda g: F.pmod(F.xxhash64("id"), F.lit(g)).cast("int")
    q = batch.select("id", "v", h(gb).alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(gt - 1))).alias("tb"), F.lit(0).alias("role"))
    t = targets.select("id", "v", F.explode(F.sequence(F.lit(0), F.lit(gb - 1))).alias("qb"), h(gt).alias("tb"), F.lit(1).alias("role"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        q, t = pdf[pdf.role == 0], pdf[pdf.role == 1]
        if not len(q) or not len(t):
            return pd.DataFrame({"a": [], "b": [], "sim": []})
        norm = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        s = norm(np.array(q["v"].tolist(), np.float64)) @ norm(np.array(t["v"].tolist(), np.float64)).T
        s[q["id"].to_numpy()[:, None] == t["id"].to_numpy()[None, :]] = -9
        i, j = np.nonzero(s >= min_sim - 1e-6)
        out = pd.DataFrame({"a": q["id"].to_numpy()[i], "b": t["id"].to_numpy()[j], "sim": s[i, j]})
        return out.sort_values(["a", "sim", "b"], ascending=[True, False, True]).groupby("a").head(k)

    key = dict(batch.dtypes)["id"]
    pairs = q.unionByName(t).groupBy("qb", "tb").applyInPandas(run, f"a {key}, b {key}, sim double")
    w = Window.partitionBy("a").orderBy(F.desc(F.round("sim", 6)), "b")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("a", "b", F.round("sim", 6).alias("strength"), "rank")


#: memberships of one block of sets; a pair of blocks is one task
BLOCK_ITEMS = 1_500_000
#: postings, cells or looked-up items that are held at once
_STEP = 1_000_000


def jaccard(members: DataFrame, least: float = 0.30, forest: bool = False, whole: bool = False) -> DataFrame:
    """(a, b, jaccard) of sets (set_id, item) that are alike to at least ``least`` > 0.

    Sets are cut into blocks and every pair of blocks is one group, so candidates
    are counted where they arise and only pairs that are alike leave a task: a set
    is shuffled once per block, a candidate never. Inside a group the search is
    exact by prefixes (see :func:`alike`). Equal sets are one set until the end: a pair is
    given between the least ids of two classes, and each member with its class's
    least id. With ``whole`` each two sets that are alike are a pair, copies too.
    With ``forest`` a group gives only as many pairs as connect the same sets, for
    :func:`components`.
    """
    m = members.select("set_id", "item").where("set_id is not null and item is not null")
    sets = m.groupBy("set_id").agg(F.array_sort(F.collect_set("item")).alias("items"))
    sets = cut(sets.withColumn("k", F.sha2(F.array_join(F.transform("items", lambda x: x.cast("string")), "\x1f"), 256)))
    classes = cut(sets.groupBy("k").agg(F.min("set_id").alias("rep"), F.count("*").alias("n")).where("n > 1").select("k", "rep"))
    copies = sets.select("set_id", "k").join(classes, "k").where("set_id <> rep").select(F.col("rep").alias("a"), F.col("set_id").alias("b"), F.lit(1.0).alias("jaccard"))
    copies = cut(copies)
    n_copies = copies.count()
    others = copies.select(F.col("b").alias("set_id"))
    reps = sets.select("set_id", "items")
    if n_copies:
        reps = reps.join(F.broadcast(others) if n_copies <= 100_000 else others, "set_id", "left_anti")
    held = sets.agg(F.coalesce(F.sum(F.size("items")), F.lit(0))).first()[0]
    blocks = max(-(-held // BLOCK_ITEMS), min(-(-held // 50_000), round((4 * members.sparkSession.sparkContext.defaultParallelism) ** 0.5)), 1)
    packed = reps.select("set_id", "items", F.pmod(F.xxhash64("set_id"), F.lit(blocks)).cast("int").alias("block")).mapInArrow(_packed(blocks), "i int, j int, block int, sets binary")
    groups = blocks * (blocks + 1) // 2
    key = dict(sets.dtypes)["set_id"]
    pairs = packed.repartition(groups, "i", "j").groupBy("i", "j").applyInArrow(_alike_blocks(least, forest), f"a {key}, b {key}, jaccard double")
    if whole and n_copies:
        small = F.broadcast if n_copies <= 100_000 else lambda x: x
        kin = copies.select(F.col("a").alias("rep"), F.col("b").alias("one")).unionByName(copies.select(F.col("a").alias("rep"), F.col("a").alias("one")).distinct())
        for c in ("a", "b"):
            pairs = pairs.join(small(kin.select(F.col("rep").alias(c), "one")), c, "left").withColumn(c, F.coalesce("one", c)).drop("one")
        copies = kin.select("rep", F.col("one").alias("a")).join(kin.select("rep", F.col("one").alias("b")), "rep").where("a < b").select("a", "b", F.lit(1.0).alias("jaccard"))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "jaccard").unionByName(copies)


def _packed(blocks: int):
    """Sets of one block as compressed Arrow tables, once for every pair of blocks that it is in."""

    def run(batches):
        for batch in batches:
            of = batch.column("block").to_numpy()
            size = batch.column("items").value_lengths().to_numpy()
            rows = batch.select(["set_id", "items"])
            for block in np.unique(of).tolist():
                mine = np.flatnonzero(of == block)
                part = np.cumsum(size[mine]) // _STEP  # a table holds about so many items
                for p in np.unique(part).tolist():
                    sink = pa.BufferOutputStream()
                    got = rows.take(pa.array(mine[part == p]))
                    with pa.ipc.new_stream(sink, got.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                        w.write_batch(got)
                    held = sink.getvalue().to_pybytes()
                    for other in range(blocks):
                        ij = min(block, other), max(block, other)
                        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int32()) for x in (*ij, block)] + [pa.array([held], pa.binary())], names=["i", "j", "block", "sets"])

    return run


def _alike_blocks(least: float, forest: bool):
    def run(group: pa.Table) -> pa.Table:
        parts = sorted(zip(*(group.column(c).to_pylist() for c in ("block", "sets"))), key=lambda x: x[0])
        same = group.column("i")[0].as_py() == group.column("j")[0].as_py()
        tables = [(block, pa.ipc.open_stream(held).read_all()) for block, held in parts]
        first = sum(len(t) for block, t in tables if block == tables[0][0])
        both = pa.concat_tables([t for _, t in tables]).combine_chunks()
        ids, items = both.column("set_id").combine_chunks(), both.column("items").combine_chunks()
        size = items.value_lengths().to_numpy().astype(np.int64)
        codes = items.flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        del tables, parts, both, items
        pa.default_memory_pool().release_unused()
        only = len(size) if same else first
        if not only or only == len(size) and not same:
            a = b = np.zeros(0, np.int64)
            sim = np.zeros(0)
        else:
            a, b, sim = alike(size, codes, only, same, least, forest)
        return pa.table({"a": ids.take(pa.array(a)), "b": ids.take(pa.array(b)), "jaccard": pa.array(sim, pa.float64())})

    return run


def _spread(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each run of length n, one run after another."""
    ends = np.cumsum(n)
    out = np.repeat((start - ends + n).astype(np.int32), n)
    out += np.arange(len(out), dtype=np.int32)
    return out


def _runs(n: np.ndarray, most: int):
    """(from, to) of runs of rows whose sizes add up to about ``most``."""
    at = np.cumsum(n)
    i = 0
    while i < len(n):
        j = max(i + 1, int(np.searchsorted(at, (at[i - 1] if i else 0) + most, "right")))
        yield i, j
        i = j


def alike(size: np.ndarray, codes: np.ndarray, first: int, same: bool, least: float, forest: bool = False):
    """(a, b, jaccard): pairs of row numbers that are alike, of one of the first ``first`` sets and one of the rest (or of all, if ``same``).

    Prefix filtering: items are ordered from rare to frequent, and two sets can
    only be that much alike if they share one of their first n - ceil(least * n) + 1
    items; only those bring sets together, so frequent items do not. What the
    prefixes share and what may follow the shorter one must reach the overlap asked
    for; pairs that pass are compared whole.
    """
    rows, n_codes = len(size), int(codes.max()) + 1
    # sorting whole numbers is several times as fast as sorting places
    order = np.bincount(codes, minlength=n_codes) * n_codes + np.arange(n_codes)
    order.sort()
    rank = np.empty(n_codes, np.int32)
    rank[order % n_codes] = np.arange(n_codes)
    keys = np.repeat(np.arange(rows) * n_codes, size)  # (set, item), sets in order
    keys += rank[codes]
    keys.sort()
    del codes, order, rank
    items = (keys % n_codes).astype(np.int32)
    start = np.cumsum(size) - size
    head = np.maximum(1, size - np.ceil(least * size - 1e-9).astype(np.int64) + 1)
    head = np.minimum(head, size)
    last = items[start + head - 1]
    # postings of the prefixes of the sets searched
    lo = 0 if same else first
    nb = rows - lo
    posts = items[_spread(start[lo:], head[lo:])].astype(np.int64)
    count = np.bincount(posts, minlength=n_codes)
    begin = np.cumsum(count) - count
    posts *= nb
    posts += np.repeat(np.arange(nb), head[lo:])
    posts.sort()
    posts = (posts % nb).astype(np.int32)
    label = np.arange(rows)
    out: list[tuple] = []
    # postings met by each set; the rows of a step take at most _STEP postings, or one row at a time
    met = np.add.reduceat(count[items[_spread(start[:first], head[:first])]], np.cumsum(head[:first]) - head[:first])
    for i, j in _runs(np.maximum(met, 1), _STEP):
        mine = items[_spread(start[i:j], head[i:j])]
        n = count[mine]
        cell = np.repeat(np.repeat(np.arange(j - i, dtype=np.int64) * nb, head[i:j]), n)
        cell += posts[_spread(begin[mine], n)]
        if (j - i) * nb < 2 * max(len(cell), _STEP):
            c = np.bincount(cell, minlength=(j - i) * nb)
            cell = np.flatnonzero(c)
            c = c[cell]
        else:
            cell.sort()
            new = np.flatnonzero(np.diff(cell, prepend=-1))
            c = np.diff(new, append=len(cell))
            cell = cell[new]
        a, b = i + cell // nb, lo + cell % nb
        if same:
            ok = a < b
            a, b, c = a[ok], b[ok], c[ok]
        if forest:
            ok = label[a] != label[b]
            a, b, c = a[ok], b[ok], c[ok]
        need = least / (1 + least) * (size[a] + size[b]) - 1e-9
        follow = np.where(last[a] <= last[b], size[a] - head[a], size[b] - head[b])
        ok = (c + follow >= need) & (np.minimum(size[a], size[b]) >= least * np.maximum(size[a], size[b]) - 1e-9)
        a, b = a[ok], b[ok]
        for x, y in _runs(np.minimum(size[a], size[b]), _STEP):
            p, q = a[x:y], b[x:y]
            if forest:
                ok = label[p] != label[q]
                p, q = p[ok], q[ok]
                if not len(p):
                    continue
            short = size[p] <= size[q]
            s, t = np.where(short, p, q), np.where(short, q, p)
            want = np.repeat(t * n_codes, size[s]) + items[_spread(start[s], size[s])]
            place = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
            both = np.add.reduceat((keys[place] == want).astype(np.int64), np.cumsum(size[s]) - size[s])
            sim = both / (size[p] + size[q] - both)
            ok = sim >= least - 1e-12
            p, q, sim = p[ok], q[ok], sim[ok]
            if forest:
                kept = _link(label, p, q)
                p, q, sim = p[kept], q[kept], sim[kept]
            out.append((p, q, sim))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*out))


def _link(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Joins the parts of a and b in ``label`` (each row's least one); the numbers of the pairs that did it, none of which closes a ring."""
    kept, live = [], np.arange(len(a))
    while True:
        x, y = label[a[live]], label[b[live]]
        live, x, y = live[x != y], x[x != y], y[x != y]
        if not len(live):
            return np.concatenate(kept) if kept else np.zeros(0, np.int64)
        # every part takes one part of a smaller number
        high, one = np.unique(np.maximum(x, y), return_index=True)
        kept.append(live[one])
        up = np.arange(len(label))
        up[high] = np.minimum(x, y)[one]
        while (up[up] != up).any():
            up = up[up]
        label[:] = up[label]


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the least id of each connected component.

    Alternating large-star and small-star steps, which halve paths, so a chain
    of n nodes needs about log n rounds; every round is written once and the
    one before is deleted. The rounds go on until nothing changes.
    """
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    mark = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        old, e = e, cut(small)
        release(old)
        # nothing changed if the edges are as many and sum up to the same hash
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    label = e.groupBy("u").agg(F.min("v").alias("component"))
    return nodes.join(label, F.col("id") == F.col("u"), "left").select("id", F.coalesce("component", "id").alias("component"))


def infer_parents(children: DataFrame, parents: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, child_id, parent_id): the parent with the largest token overlap under the same keys.

    Ties and no overlap at all go to the first parent. children: keys, child_id,
    name; parents: keys, parent_id, name, pos. A source's lists are capped, so
    the join under one source stays small.
    """
    keys = keys or ["source_id"]
    c = children.select(*keys, "child_id", tokens(F.col("name")).alias("ct"))
    p = parents.select(*keys, "parent_id", "pos", tokens(F.col("name")).alias("pt"))
    j = c.join(p, keys).withColumn("score", F.size(F.array_intersect("ct", "pt")) / F.greatest(F.size(F.array_union("ct", "pt")), F.lit(1)))
    return j.groupBy(*keys, "child_id").agg(F.max_by("parent_id", F.struct("score", -F.col("pos"))).alias("parent_id"))


def cross_relations(edges: DataFrame, membership: DataFrame, tiers: DataFrame, min_strength: float) -> DataFrame:
    """Relations between nodes of different sources: (a_source, a, b_source, b, tier, strength), one per undirected pair and tier.

    edges: a, b, strength, pos; membership: source_id, id; tiers: id, tier.
    """
    e = edges.where((F.col("a") != F.col("b")) & (F.col("strength") >= min_strength))
    e = e.join(tiers.select(F.col("id").alias("a"), F.col("tier").alias("ta")), "a").join(tiers.select(F.col("id").alias("b"), F.col("tier").alias("tb")), "b").where("ta = tb and ta between 1 and 4")
    x = e.join(membership.select(F.col("id").alias("a"), F.col("source_id").alias("a_source")), "a").join(membership.select(F.col("id").alias("b"), F.col("source_id").alias("b_source")), "b").where("a_source <> b_source")
    left, right = F.concat_ws("::", F.col("a_source").cast("string"), F.col("a").cast("string")), F.concat_ws("::", F.col("b_source").cast("string"), F.col("b").cast("string"))
    w = Window.partitionBy(F.least(left, right), F.greatest(left, right), "ta").orderBy("pos", left, right)
    return x.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("a_source", "a", "b_source", "b", F.col("ta").alias("tier"), "strength")


def membership(edges: DataFrame) -> DataFrame:
    """id with its sorted distinct sources."""
    return edges.groupBy("id").agg(F.array_sort(F.collect_set("source_id")).alias("sources"))


def latest_edges(edges: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One edge per key over all batches: the last one's values and batch win."""
    return latest(edges, keys, order)


def first_names(mentions: DataFrame) -> DataFrame:
    """(concept_id, name, tier, kind, doc_freq): concepts over all sources; the first mention (source, pos) names each.

    mentions: concept_id, name, tier, kind, source_id, pos.
    """
    first = F.min(F.struct("source_id", "pos", "name", "tier", "kind")).alias("x")
    return mentions.groupBy("concept_id").agg(first, F.count_distinct("source_id").alias("doc_freq")).select("concept_id", "x.name", "x.tier", "x.kind", "doc_freq")


def children(nodes: DataFrame, parents: DataFrame, node: str, parent: str) -> DataFrame:
    """(parent, children): the sorted children of each parent; those whose parent is not known stand under null."""
    known = parents.select(F.col(parent).alias("_known")).distinct()
    up = nodes.join(known, F.col(parent) == F.col("_known"), "left").select(F.col("_known").alias(parent), node)
    return up.groupBy(parent).agg(F.array_sort(F.collect_list(node)).alias("children"))
