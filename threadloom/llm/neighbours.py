"""Problem 4: the k most similar vectors for every vector.

Balanced posting lists. Centroids are fitted on a bounded sample (``SAMPLE``
rows a model); their number follows the number of vectors, so lists keep their
size, up to one list per row of the sample. Every vector finds its nearest
centroids in an in-memory graph of centroids (a beam that starts from an entry
layer of up to ``ENTRIES``) and is stored in each list whose distance is within a
ratio of the least, up to ``COPIES``: boundary vectors are in several lists. The
ratio alone selects the lists a vector searches; where it goes on beyond the
beam, as in a dense cluster, all centroids are scanned.

Neighbouring lists are one region, so a vector travels once to a region and not
to each of its lists; inside, all that is stored meets all that searches there
by block products, and the best of all regions are merged. How wide regions are
follows the load that a probe shows: where vectors search most regions anyway,
wider ones cost less, up to one region in which everything meets. A region of many
rows is cut into parts of up to 8 x ``LIST_CAP`` rows and every two parts are one
group, in which a product serves both of its vectors; where far more search than are
stored, into query parts and data blocks of that size. So no task holds an unbounded
list. Equal vectors are one point with members: a group of copies costs one row per
region.

Broadcast: the centroids only, at most SAMPLE x 128 floats (10 MB) a model.

Edge cases: only the newest row of a node and model counts; null, broken,
non-finite, all-zero vectors or another length take no part; models never
meet; a node alone has no neighbours; an empty table gives no rows; ties in
similarity go to the smaller node number; other columns are ignored.
"""

from __future__ import annotations

import json
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.session import cut

DIM = 128
SAMPLE = 20_480
LIST_ROWS = 220
LIST_CAP = 6_000
RATIO = 1.1
COPIES = 10
#: centroids in the entry layer of their graph, and the width of its beam
ENTRIES, BEAM = 4_096, 64
#: rows on each side of a block product; products that cost as much as the way of one row to a group
TILE, TRAVEL = 1_024, 2_000
_SCALE = 32_000.0


# ---- reading vectors -------------------------------------------------------


def parse_vector(s: str | None, dim: int = DIM) -> np.ndarray | None:
    """The unit vector of a JSON list of ``dim`` finite numbers, else None."""
    if not s:
        return None
    try:
        v = json.loads(s)
    except (ValueError, RecursionError):
        return None
    if not isinstance(v, list) or len(v) != dim or any(type(x) not in (int, float) for x in v):
        return None
    try:
        a = np.array(v, np.float64)
    except OverflowError:
        return None
    if not np.isfinite(a).all():
        return None
    top = np.abs(a).max()
    if top == 0:
        return None
    a = a / top
    return a / np.sqrt(a @ a)


def pack(a: np.ndarray) -> bytes:
    """16-bit steps of the largest component, which is put in front (error below 1e-5)."""
    top = np.float32(np.abs(a).max())
    return top.tobytes() + np.rint(a / top * _SCALE).astype(np.int16).tobytes()


def unpack(rows, dim: int = DIM) -> np.ndarray:
    """Unit vectors (float32) of packed rows."""
    raw = np.frombuffer(b"".join(rows), np.uint8).reshape(-1, 4 + 2 * dim)
    a = raw[:, 4:].copy().view(np.int16).astype(np.float32)
    return a / np.sqrt(np.einsum("ij,ij->i", a, a))[:, None]


def _read(dim: int):
    def run(batches):
        for b in batches:
            out = []
            for s in b.column(3).to_pylist():
                v = parse_vector(s, dim)
                out.append(None if v is None else pack(v))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(out, pa.binary())], names=["model", "node_id", "at", "vec"])

    return run


def newest_vectors(df: DataFrame, dim: int = DIM) -> DataFrame:
    """(model, node_id, vec): the newest row of each node and model, where it is usable."""
    rows = df.select("model", "node_id", F.coalesce(F.col("updated_at").cast("timestamp").cast("double"), F.lit(-1e18)).alias("at"), "embedding_json").where("model is not null and node_id is not null")
    rows = rows.mapInArrow(_read(dim), "model string, node_id string, at double, vec binary")
    return rows.groupBy("model", "node_id").agg(F.max_by("vec", F.struct("at", F.coalesce("vec", F.lit(b"")))).alias("vec")).where("vec is not null")


# ---- centroids and their graph --------------------------------------------


def _products(x: np.ndarray, c: np.ndarray, cells: int = 4_000_000):
    """(first row, cosines with all centroids) of so many rows at once that a block stays small."""
    step = max(16, cells // len(c))
    for i in range(0, len(x), step):
        yield i, x[i : i + step] @ c.T


def fit_centroids(x: np.ndarray, k: int, rounds: int = 8, seed: int = 11) -> np.ndarray:
    """Spherical k-means; lists that stay empty start again at points far from their centroid."""
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        best = np.empty(len(x), np.int64)
        sim = np.empty(len(x), np.float32)
        for i, s in _products(x, c):
            best[i : i + len(s)] = s.argmax(1)
            sim[i : i + len(s)] = s.max(1)
        order = np.argsort(best, kind="stable")
        used, first = np.unique(best[order], return_index=True)
        sums = np.zeros_like(c)
        sums[used] = np.add.reduceat(x[order], first, axis=0)
        empty = np.setdiff1d(np.arange(k), used)
        if len(empty):
            sums[empty] = x[np.argsort(sim, kind="stable")[: len(empty)]]
        c = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    return c.astype(np.float32)


class CentroidGraph:
    """Centroids with links to their nearest and to a few far ones; searched by beams.

    The beam starts at the best of an entry layer (one matrix product), so it
    needs few hops; where that layer holds all centroids there is nothing left to
    visit.
    """

    def __init__(self, c: np.ndarray, degree: int = 24, far: int = 8, entries: int = ENTRIES, seed: int = 5):
        rng = np.random.default_rng(seed)
        k = len(c)
        d = min(degree, k - 1)
        links = []
        for i, s in _products(c, c):
            s[np.arange(len(s)), np.arange(i, i + len(s))] = -9
            # a copy: a slice would keep the whole block alive
            links.append(np.argpartition(-s, d - 1, axis=1)[:, :d].astype(np.int32) if d else np.zeros((len(s), 0), np.int32))
        near = np.concatenate(links)
        self.links = np.concatenate([near, rng.integers(0, k, (k, far))], axis=1).astype(np.int32)
        self.c = c
        self.entries = np.sort(rng.choice(k, min(entries, k), replace=False))

    def search(self, q: np.ndarray, want: int, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """The ``want`` nearest centroids of each row: numbers and cosines, best first."""
        k, n = len(self.c), len(q)
        want = min(want, k)
        beam = min(k, max(beam, want))
        seen = np.zeros((n, k), bool)
        rows = np.arange(n)
        s = q @ self.c[self.entries].T
        o = np.argpartition(-s, min(beam, s.shape[1]) - 1, axis=1)[:, :beam]
        ids = self.entries[o].astype(np.int32)
        sim = np.take_along_axis(s, o, 1)
        if len(self.entries) == k:  # all of them are visited
            o = np.argsort(-sim, axis=1, kind="stable")[:, :want]
            return np.take_along_axis(ids, o, 1), np.take_along_axis(sim, o, 1)
        seen[:, self.entries] = True
        if ids.shape[1] < beam:
            pad = beam - ids.shape[1]
            ids = np.pad(ids, ((0, 0), (0, pad)))
            sim = np.pad(sim, ((0, 0), (0, pad)), constant_values=-9)
        done = sim <= -9
        live = rows
        while len(live):
            masked = np.where(done[live], -9, sim[live])
            at = masked.argmax(1)
            go = masked[np.arange(len(live)), at] > -9
            live, at = live[go], at[go]
            if not len(live):
                break
            done[live, at] = True
            nb = self.links[ids[live, at]]
            fresh = ~seen[live[:, None], nb]
            seen[live[:, None], nb] = True
            ns = np.matmul(self.c[nb], q[live][:, :, None])[:, :, 0]
            ns = np.where(fresh, ns, -9)
            # a link listed twice counts once
            srt = np.sort(nb, axis=1)
            if (srt[:, 1:] == srt[:, :-1]).any():
                for j in range(1, nb.shape[1]):
                    ns[(nb[:, :j] == nb[:, j : j + 1]).any(1), j] = -9
            all_s = np.concatenate([sim[live], ns], axis=1)
            all_i = np.concatenate([ids[live], nb], axis=1)
            all_d = np.concatenate([done[live], ns <= -9], axis=1)
            o = np.argpartition(-all_s, beam - 1, axis=1)[:, :beam]
            sim[live] = np.take_along_axis(all_s, o, 1)
            ids[live] = np.take_along_axis(all_i, o, 1)
            done[live] = np.take_along_axis(all_d, o, 1)
        o = np.argsort(-sim, axis=1, kind="stable")[:, :want]
        return np.take_along_axis(ids, o, 1), np.take_along_axis(sim, o, 1)


def lists_of(graph: CentroidGraph, q: np.ndarray, copies: int = COPIES, ratio: float = RATIO):
    """(row, list, stored): every list whose distance is within ``ratio`` of the least; the nearest ``copies`` store the row."""
    want = max(copies, 16)
    ids, sim = graph.search(q, want)
    near = lambda s: (s > -9) & (np.sqrt(np.maximum(0.0, 2.0 - 2.0 * s)) <= np.sqrt(np.maximum(0.0, 2.0 - 2.0 * s.max(1, keepdims=True))) * ratio + 1e-6)
    ok = near(sim)
    wide = np.flatnonzero(ok[:, -1]) if want < len(graph.c) else np.zeros(0, np.int64)
    ok[wide] = False
    r, j = np.nonzero(ok)
    parts = [(r, ids[r, j], j < copies)]
    for i, s in _products(q[wide], graph.c):
        first = np.zeros(s.shape, bool)
        np.put_along_axis(first, np.argpartition(-s, copies - 1, axis=1)[:, :copies], True, 1)
        r, j = np.nonzero(near(s))
        parts.append((wide[i + r], j, first[r, j]))
    return tuple(np.concatenate(x) for x in zip(*parts))


def regions_of(c: np.ndarray, rows: np.ndarray, cap: float) -> np.ndarray:
    """The region of each list: halves along the widest direction until a region has at most ``cap`` rows."""
    out = np.zeros(len(c), np.int32)
    todo, n = [np.arange(len(c))], 0
    while todo:
        part = todo.pop()
        if len(part) == 1 or rows[part].sum() <= cap:
            out[part], n = n, n + 1
            continue
        x = c[part] - c[part].mean(0)
        part = part[np.argsort(x @ np.linalg.eigh(x.T @ x)[1][:, -1], kind="stable")]
        at = int(np.clip(np.searchsorted(np.cumsum(rows[part]), rows[part].sum() / 2), 1, len(part) - 1))
        todo += [part[:at], part[at:]]
    return out


def _once(r: np.ndarray, at: np.ndarray, stored: np.ndarray, n: int):
    """(row, region, stored), each row and region once; ``n`` regions."""
    keys, place = np.unique(r * n + at, return_inverse=True)
    kept = np.zeros(len(keys), bool)
    kept[place[stored]] = True
    return keys // n, keys % n, kept


def visits(graph: CentroidGraph, regions: np.ndarray, q: np.ndarray, copies: int, ratio: float):
    """(row, region, stored): every region of which a row searches a list, once."""
    if not regions.any():  # there is only one
        return np.arange(len(q)), np.zeros(len(q), np.int64), np.ones(len(q), bool)
    r, lists, stored = lists_of(graph, q, copies, ratio)
    return _once(r, regions[lists], stored, int(regions.max()) + 1)


def cuts_of(asked: np.ndarray, kept: np.ndarray, cap: float):
    """(query parts, data blocks, cost in products) of regions with so many rows; as many of both: parts that meet in pairs."""
    parts, blocks = (np.maximum(1, np.ceil(y / cap)) for y in (asked, kept))
    even = np.maximum(parts, np.minimum(4, np.ceil(2 * asked / cap)))  # a few more parts keep the tasks short
    even = np.where(asked <= cap, 1, even)
    apart = TRAVEL * (asked * blocks + kept * parts) + asked * kept
    paired = TRAVEL * asked * even + asked * kept - kept * kept / 2
    parts, blocks = np.where(paired <= apart, even, parts), np.where(paired <= apart, even, blocks)
    return parts.astype(np.int32), blocks.astype(np.int32), float(np.minimum(apart, paired).sum())


def fit_regions(x: np.ndarray, probe: np.ndarray, n: int, copies: int, ratio: float, widen: bool = False):
    """(centroids, regions, query parts, data blocks) for ``n`` rows, from a sample and other rows that show the load.

    A row of the sample lies nearer to its centroid than others do (on it, where there
    are as many lists as sampled rows) and would search too few lists. ``widen``: joins
    neighbouring regions as long as that costs less.
    """
    c = fit_centroids(x, max(1, math.ceil(n / LIST_ROWS)))
    held = np.zeros(len(c))
    for _, s in _products(probe, c):
        held += np.bincount(s.argmax(1), minlength=len(c))
    more, cap = n / len(probe), 8 * LIST_CAP
    ways = [regions_of(c, held * more, cap / 1.5)]  # room for boundary vectors
    while widen and ways[-1].any():  # the same halves, of which fewer are cut: regions of the one before, joined
        ways.append(regions_of(c, held * more, cap / 1.5 * 2 ** len(ways)))
    graph, counts = CentroidGraph(c), [np.zeros((2, w.max() + 1)) for w in ways]
    for i in range(0, len(probe), 1024):
        r, at, stored = visits(graph, ways[0], probe[i : i + 1024], copies, ratio)
        for j, (asked, kept) in enumerate(counts):
            if j:
                up = np.zeros(int(ways[j - 1].max()) + 1, np.int64)
                up[ways[j - 1]] = ways[j]
                r, at, stored = _once(r, up[at], stored, len(asked))
            asked += np.bincount(at, minlength=len(asked))
            kept += np.bincount(at[stored], minlength=len(kept))
    cuts = [cuts_of(asked * more, kept * more, cap) for asked, kept in counts]
    best = min(range(len(ways)), key=lambda j: cuts[j][2])
    return c, ways[best], *cuts[best][:2]


# ---- the operator ----------------------------------------------------------


def groups_of(at: np.ndarray, stored: np.ndarray, nid: np.ndarray, parts: np.ndarray, blocks: np.ndarray):
    """(row, query part, data block, role) of rows that visit the regions ``at``.

    Role: 0 searches, 1 is stored, 2 both; and 4 more on the second side of a group of two parts.
    """
    nq, nb = parts[at], blocks[at]
    mine = nid.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)
    part = lambda x, n: (mine[x] % n[x].astype(np.uint64)).astype(np.int32)
    every = lambda n: np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    pair, apart = np.flatnonzero(nq == nb), np.flatnonzero(nq != nb)
    kept = apart[stored[apart]]
    x, q, d = np.repeat(pair, nq[pair]), np.repeat(apart, nb[apart]), np.repeat(kept, nq[kept])
    m, o = part(x, nq), every(nq[pair])
    out = (
        (x, np.minimum(m, o), np.maximum(m, o), np.where(stored[x], 2, 0) + np.where(m > o, 4, 0)),
        (q, part(q, nq), every(nb[apart]), np.zeros(len(q), np.int64)),
        (d, every(nq[kept]), part(d, nb), np.ones(len(d), np.int64)),
    )
    return tuple(np.concatenate(y) for y in zip(*out))


def _assign(fitted, copies: int, ratio: float):
    """Rows of the regions' groups: every part meets itself and every other part, or every query part every data block."""

    def run(batches):
        built = {}
        for pdf in batches:
            for model, g in pdf.groupby("model", sort=False):
                c, regions, parts, blocks = fitted.value[model]
                if model not in built:
                    built[model] = CentroidGraph(c) if regions.any() else None
                for i in range(0, len(g), 1024):
                    part = g.iloc[i : i + 1024]
                    r, at, stored = visits(built[model], regions, unpack(part["vec"]), copies, ratio)
                    nid, vec = part["nid"].to_numpy()[r], part["vec"].to_numpy()[r]
                    x, qp, db, role = groups_of(at, stored, nid, parts, blocks)
                    yield pd.DataFrame({"model": model, "list": at[x].astype(np.int32), "qp": qp.astype(np.int32), "db": db.astype(np.int32), "role": role.astype(np.int32), "nid": nid[x], "vec": vec[x]})

    return run


def _tiles(second: np.ndarray, stored: np.ndarray):
    """(rows, other rows, both ways) of the block products of a group whose rows are ordered by side, stored first.

    Without a second side the rows meet one another, and only half of the tiles are needed.
    """
    na = len(second) - int(second.sum())
    sa, end = int(stored[:na].sum()), len(second)
    sb = na + int(stored[na:].sum())
    if na == end:
        for j in range(0, sa, TILE):
            for i in range(j, na, TILE):
                yield slice(i, min(i + TILE, na)), slice(j, min(j + TILE, na)), i > j
    else:
        for j in range(na, end, TILE):
            for i in range(0, na if j < sb else sa, TILE):
                yield slice(i, min(i + TILE, na)), slice(j, min(j + TILE, end)), True


def _true_cells(hit: np.ndarray) -> np.ndarray:
    """Places of the few true cells, eight cells at a look."""
    flat = hit.reshape(-1)
    if len(flat) % 8:
        return np.flatnonzero(flat)
    w = np.flatnonzero(flat.view(np.uint64))
    at = np.flatnonzero(flat.reshape(-1, 8)[w])
    return w[at >> 3] * 8 + (at & 7)


def _row_hits(m: np.ndarray, least: np.ndarray, rows: np.ndarray, cols: np.ndarray, stored: np.ndarray, k: int):
    """(row, column) of cells at or above their row's ``least``: all of them where few are, else a row's best k of other numbers that are stored."""
    hit = m >= least[:, None]
    if m.shape[1] <= k or np.count_nonzero(hit) * 50 < m.size:
        return np.divmod(_true_cells(hit), m.shape[1])
    m = np.where(stored & (rows[:, None] != cols), m, np.float32(-9))
    o = np.argpartition(-m, k - 1, axis=1)[:, :k]
    r, j = np.nonzero(np.take_along_axis(m, o, 1) >= least[:, None])
    return r, o[r, j]


def best_in_group(ids: np.ndarray, x: np.ndarray, role: np.ndarray, k: int, min_sim: float):
    """(a, b, similarity): the best k stored rows of each row that searches, itself excepted; equal ones by number."""
    second = (role >= 4) | (role == 1)
    o = np.lexsort((role & 3 == 0, second))
    ids, x, second, role = ids[o], x[o], second[o], role[o] & 3
    asks, stored = role != 1, role != 0
    least = np.full(len(ids), min_sim, np.float32)  # rises to the k-th best found
    found, fresh = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))], 0

    def settle():
        q, d, v = (np.concatenate(y) for y in zip(*found))
        o = np.lexsort((ids[d], -v, q))
        q, d, v = q[o], d[o], v[o]
        n = np.arange(len(q)) - np.searchsorted(q, q)
        least[q[n == k - 1]] = v[n == k - 1]
        found[:] = [(q[n < k], d[n < k], v[n < k])]

    for i, j, both in _tiles(second, stored):
        m = x[i] @ x[j].T
        hit = m >= (min(least[i].min(), least[j].min()) if both else least[i].min())
        if np.count_nonzero(hit) * 50 < m.size:
            at = _true_cells(hit)
            r, c = np.divmod(at, m.shape[1])
            ways = [(r + i.start, c + j.start, m.reshape(-1)[at])]
            ways += [(ways[0][1], ways[0][0], ways[0][2])] if both else []
        else:
            ways = []
            for y, rows, cols in ((m, i, j), (m.T, j, i))[: 2 if both else 1]:
                y = np.ascontiguousarray(y)
                r, c = _row_hits(y, least[rows], ids[rows], ids[cols], stored[cols], k)
                ways.append((r + rows.start, c + cols.start, y[r, c]))
        for q, d, v in ways:
            ok = asks[q] & stored[d] & (ids[q] != ids[d]) & (v >= least[q])
            found.append((q[ok], d[ok], v[ok]))
            fresh += int(ok.sum())
        if fresh > 500_000:
            settle()
            fresh = 0
    settle()
    q, d, v = found[0]
    return ids[q], ids[d], v


def _search(k: int, min_sim: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b, s = best_in_group(pdf["nid"].to_numpy(), unpack(pdf["vec"]), pdf["role"].to_numpy(), k, min_sim)
        return pd.DataFrame({"a": a, "b": b, "sim": s})

    return run


def nearest(df: DataFrame, k: int = 5, min_sim: float = -1.0, dim: int = DIM, copies: int = COPIES, ratio: float = RATIO) -> DataFrame:
    """(model, node_id, rank, neighbour_id, sim): the k most similar nodes of each node."""
    spark = df.sparkSession
    v = newest_vectors(df, dim).withColumns({"nid": F.monotonically_increasing_id(), "h": F.xxhash64("vec")})
    v = cut(v)
    # equal vectors: one representative, the others are members
    same = v.groupBy("model", "h").agg(F.min("nid").alias("rep"), F.count("*").alias("m")).where("m > 1")
    same = cut(same)
    members = v.select("model", "node_id", "nid", "h").join(same, ["model", "h"])
    members = cut(members.select("nid", "rep"))
    others = members.where("nid <> rep").select("nid")
    n_others = others.count()
    points = v.select("model", "nid", "vec").join(F.broadcast(others) if n_others <= 100_000 else others, "nid", "left_anti")
    sizes = {r["model"]: r["n"] for r in points.groupBy("model").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return spark.createDataFrame([], "model string, node_id string, rank int, neighbour_id string, sim float")
    fitted = {}
    for model, n in sizes.items():
        s, seen = points.where(F.col("model") == model).select("vec"), 1.0
        if n > SAMPLE:
            seen = min(1.0, 1.1 * SAMPLE / n)
            at = F.pmod(F.hash("nid"), F.lit(1 << 20))
            probe = s.where((at >= int((1 << 20) * seen)) & (at < int((1 << 20) * 2 * seen)))
            s = s.where(at < int((1 << 20) * seen))
        x = unpack(s.limit(SAMPLE).toPandas()["vec"], dim)
        y = unpack(probe.limit(SAMPLE).toPandas()["vec"], dim) if seen < 1 else x
        fitted[model] = fit_regions(x, y if len(y) * 4 >= len(x) else x, n, copies, ratio, widen=True)
    placed = points.mapInPandas(_assign(spark.sparkContext.broadcast(fitted), copies, ratio), "model string, list int, qp int, db int, role int, nid long, vec binary")
    # a task for about each group; where groups are few, more tasks than groups keep two of them from meeting in one
    n = sum(int(np.where(p == b, p * (p + 1) // 2, p * b).sum()) for _, _, p, b in fitted.values())
    placed = placed.repartition(max(min(4 * n, 1_000), n), "model", "list", "qp", "db")
    pairs = placed.groupBy("model", "list", "qp", "db").applyInPandas(_search(k, min_sim), "a long, b long, sim float")
    best = _best(pairs, k)
    return _named(best, v, members, k)


def _best(pairs: DataFrame, k: int) -> DataFrame:
    """The k best of each point over all its regions; a pair met in several regions counts once."""
    c = pairs.groupBy("a").agg(F.sort_array(F.collect_list(F.struct((-F.col("sim")).alias("far"), "b", "sim"))).alias("c"))
    empty = F.expr("cast(array() as array<struct<b:bigint,sim:float>>)")
    once = F.aggregate("c", empty, lambda acc, x: F.when((F.size(acc) >= k) | F.exists(acc, lambda y: y["b"] == x["b"]), acc).otherwise(F.array_append(acc, F.struct(x["b"].alias("b"), x["sim"].alias("sim")))))
    return c.select("a", F.posexplode(once).alias("rank", "p")).select("a", "rank", F.col("p.b").alias("b"), F.col("p.sim").alias("sim"))


def _named(best: DataFrame, v: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """Members in place of their representatives; the copies of a vector come first."""
    w = Window.partitionBy("rep").orderBy("nid")
    first = members.withColumn("o", F.row_number().over(w)).where(F.col("o") <= k + 1)
    shown = first.groupBy("rep").agg(F.array_sort(F.collect_list("nid")).alias("shown"))  # at most k + 1
    names = v.select("nid", "model", "node_id")
    plain = best.join(shown.select(F.col("rep").alias("b"), F.col("shown").alias("bs")), "b", "left")
    plain = plain.select("a", F.col("rank").alias("o"), "sim", F.posexplode(F.coalesce("bs", F.array("b"))).alias("o2", "b")).where(F.col("o2") < k)
    spread = plain.join(members.select(F.col("rep").alias("a"), F.col("nid").alias("m")), "a", "left").select(F.coalesce("m", "a").alias("a"), F.col("o") + 1, F.col("o2"), "b", "sim").toDF("a", "o", "o2", "b", "sim")
    copies = members.join(shown, "rep").select(F.col("nid").alias("a"), F.lit(0).alias("o"), F.posexplode("shown").alias("o2", "b"), F.lit(1.0).cast("float").alias("sim")).where("a <> b")
    w2 = Window.partitionBy("a").orderBy("o", "o2")
    both = spread.unionByName(copies).withColumn("rank", F.row_number().over(w2)).where(F.col("rank") <= k)
    left = both.join(names.withColumnRenamed("nid", "a"), "a")
    return left.join(names.select(F.col("nid").alias("b"), F.col("node_id").alias("neighbour_id")), "b").select("model", "node_id", "rank", "neighbour_id", "sim")


def similar_pairs(df: DataFrame, k: int = 5, min_sim: float = 0.70) -> DataFrame:
    """(model, node_id_a, node_id_b): similar pairs in which one is among the other's k nearest."""
    n = nearest(df, k, min_sim - 2e-5).where(F.round("sim", 5) >= min_sim)
    return n.select("model", F.least("node_id", "neighbour_id").alias("node_id_a"), F.greatest("node_id", "neighbour_id").alias("node_id_b")).distinct()
