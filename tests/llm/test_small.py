"""The training-data operators on small fixtures: brute force, round trips, edge cases."""

import json
import random
from collections import defaultdict
from datetime import datetime

import numpy as np
import pandas as pd
import pytest

from threadloom.llm import batchdedup, boilerplate, mixing, neighbours, packing, pairs, recurrence, residue, spans, tokens, truncation

ITEMS = "id string, title string, extracted_text string, url_source string, record_id string, source string"
PROMPTS = "id string, canonical_url string, source string, messages array<struct<role:string,content:string>>, verdict int"
OUT = (
    "id string, canonical_url string, source string, assistant_content string, raw struct<choices:array<struct<index:int,message:struct<role:string,content:string>,finish_reason:string>>>,"
    "parsed struct<root:struct<label:string,why_saved:string>,domains:array<struct<name:string,confidence:double>>,micro_insights:array<struct<text:string,type:string>>>, opening string"
)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def prose(n, seed=1):
    r = random.Random(seed)
    words = "quiet bicycles ledgers winter notebooks carry several stories about gardens that nobody planned before spring arrived".split()
    return " ".join(" ".join(r.choice(words) for _ in range(9)).capitalize() + "." for _ in range(n))


# ---- p10 -----------------------------------------------------------------------


def brute_spans(docs, n=200):
    seen = defaultdict(set)
    for i, t in docs:
        for k in range(len(t or "") - n + 1):
            seen[t[k : k + n]].add(i)
    out = set()
    for i, t in docs:
        cur = None
        for k in range(len(t or "") - n + 1):
            if len(seen[t[k : k + n]]) > 1:
                if cur and k <= cur[1]:
                    cur[1] = k + n
                else:
                    if cur:
                        out.add((i, *cur))
                    cur = [k, k + n]
        if cur:
            out.add((i, *cur))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_spans_are_exact(spark, seed):
    r = random.Random(seed)
    letters = "abcdé🙂 \n"
    rand = lambda n: "".join(r.choice(letters) for _ in range(n))
    shared = [rand(n) for n in (199, 200, 201, 260, 420, 900)]
    docs = []
    for i in range(40):
        t = "".join(rand(r.randint(0, 120)) + r.choice(shared)[r.randint(0, 30) : r.choice([None, -1, -20])] for _ in range(r.randint(0, 4)))
        docs.append((i, t))
    docs += [(50, None), (51, ""), (52, "a" * 500), (53, "a" * 500), (54, "b" * 700), (55, "xy" * 300), (56, docs[0][1]), (56, docs[0][1])]
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, h string")
    assert set(rows(spans.shared_spans(df))) == brute_spans(dict(docs).items())


def test_spans_edges(spark):
    e = spark.createDataFrame([], "doc_id long, text string")
    assert rows(spans.shared_spans(e)) == []
    t = prose(3000)
    big = spark.createDataFrame([(1, t * 5), (2, t), (3, None)], "doc_id long, text string")
    assert rows(spans.shared_spans(big)) == [(1, 0, 5 * len(t)), (2, 0, len(t))]
    assert {r["doc_id"]: r["share"] for r in spans.shared_share(big).collect()} == {1: 1.0, 2: 1.0, 3: 0.0}


# ---- p7 ------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ("https://www.a.example/x/y/?utm_source=1", "http://M.A.example:443//x/%79#f", True), ("https://a.example/x?id=1&section=b", "https://a.example/x/?section=b&id=1&ref=z", True),
        ("https://a.example/x?id=1", "https://a.example/x?id=2", False), ("https://a.example/Kx", "https://a.example/kx", False), ("https://news.a.example/x", "https://a.example/x", False),
        ("https://www.threadnest.example/r/s/comments/k1/one_title/", "https://old.threadnest.example/r/s/comments/k1/another/", True),
        ("https://www.threadnest.example/r/s/comments/k1/t/", "https://www.threadnest.example/r/s/comments/k1/t/comment/c1/", False),
        ("https://www.threadnest.example/r/s/comments/k1/t/comment/c1/", "https://www.threadnest.example/r/s/comments/k1/u/comment/c1", True),
        ("https://a.example/x?page=3", "https://a.example/x", False), ("HTTPS://a.example/x?&v=", "https://a.example/x", True),
    ],
)
def test_page_key(a, b, same):
    assert (batchdedup.page_key(a) == batchdedup.page_key(b)) is same


def test_batches_against_brute_force(spark):
    r = random.Random(4)
    data = []
    for i in range(1, 801):
        u = None if r.random() < 0.05 else r.choice(["https://www.a.example/", "http://a.example:80/"]) + str(r.randint(0, 300)) + r.choice(["", "/", "?utm_x=1"])
        hot = r.random() < 0.33
        data.append((i, "hot" if hot else r.choice([None, f"s{r.randint(0, 500)}"]), "https://hot.example/k" if hot else u, f"batch{(i + r.randint(-40, 40)) // 90}", "p"))
    df = spark.createDataFrame(data + [(900, None, None, None, "p")], "row_id long, saved_item_id string, canonical_url string, batch_file string, shard string")
    seen, want = set(), set()
    for i, s, u, _, _ in data:
        keys = {("i", s)} if s else set()
        if u:
            keys.add(("u", batchdedup.page_key(u)))
        if keys & seen:
            want.add(i)
        seen |= keys
    assert {x["row_id"] for x in batchdedup.batch_duplicates(df, keys_per_shard=300).collect()} == want
    assert batchdedup.batch_duplicates(df.limit(0)).count() == 0


def test_store_takes_batch_after_batch(spark, tmp_path):
    r = random.Random(8)
    store = batchdedup.SegmentStore(spark, str(tmp_path / "segments"), shards=3)
    seen, n = set(), 0
    for b in range(4):
        data = []
        for _ in range(60):
            n += 1
            data.append((n, r.choice([None, f"s{r.randint(0, 80)}"]), f"https://www.a.example/{r.randint(0, 90)}?utm_x={n}", f"b{b}"))
        want = set()
        for i, s, u, _ in data:
            keys = ({("i", s)} if s else set()) | {("u", batchdedup.page_key(u))}
            if keys & seen:
                want.add(i)
            seen |= keys
        df = spark.createDataFrame(data, "row_id long, saved_item_id string, canonical_url string, batch_file string")
        assert {x["row_id"] for x in store.accept(df).collect()} == want
    live = store._live([0, 1, 2]).groupBy("shard").count().collect()
    assert all(x["count"] <= 4 for x in live)


def test_segments_merge_and_cover():
    index = batchdedup.SegmentIndex()
    for b in range(50):
        index.add([f"site.example/posts/{b}-{i}" for i in range(4)], [b * 10 + i for i in range(4)])
    assert len(index.segments) <= 7 and sum(s.size for s in index.segments) == 200
    assert index.duplicate("site.example/posts/7-3", 900) == 900 and index.duplicate("site.example/posts/7-9", 901) is None
    assert index.duplicate("site.example/posts/8-1", 2) == 81 and index.duplicate("site.example/posts/8-1", 5) == 5  # a late row with a smaller number
    assert index.coverage("site.example/posts/7-3")[0] == (73, 1.0) and index.coverage("site.example/posts/7-3", 1.0) == [(73, 1.0)]
    assert index.coverage("site.example/posts/7-3?page=2")[0][0] == 73 and index.coverage("nothing.test/like/it", 0.9) == []
    for s in index.segments:
        assert s.suffixes == sorted(s.suffixes) and batchdedup.Segment.stored(*s.written()).suffixes == s.suffixes


def test_coverage_decides(monkeypatch):
    asked, plain = [], batchdedup.SegmentIndex.coverage
    monkeypatch.setattr(batchdedup.SegmentIndex, "coverage", lambda self, key, least=0.0: asked.append(least) or plain(self, key, least))
    record, pieces = "site.example/aaaaaaaa/bbbbbbbb/cccccccc", "site.example/aaaaaaaa/cccccccc"
    assert batchdedup.replay([([record], [1]), ([pieces, record, "other.test/x"], [2, 3, 4]), ([record], [5])]) == [3, 5]
    assert asked == [1.0] * 5
    index = batchdedup.SegmentIndex()
    index.add([record], [1])
    # covered whole by two long matches of one record, yet another page
    assert index.coverage(pieces, 1.0) == [(1, 1.0)] and index.duplicate(pieces, 2) is None


# ---- p4 ------------------------------------------------------------------------


def vectors(n, seed, dim=128, groups=12):
    r = np.random.default_rng(seed)
    c = r.normal(size=(groups, dim))
    return [c[i % groups] + 0.6 * r.normal(size=dim) for i in range(n)]


def test_neighbours_recall(spark):
    v = vectors(900, 1)
    data = [(f"n{i:04d}", "m", 128, json.dumps([float(x) for x in a]), datetime(2031, 1, 1), 1) for i, a in enumerate(v)]
    df = spark.createDataFrame(data, "node_id string, model string, dim int, embedding_json string, updated_at timestamp, nid int")
    got = {(r["node_id"], r["neighbour_id"]) for r in neighbours.nearest(df, 5).collect()}
    u = np.array(v) / np.linalg.norm(v, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    want = {(f"n{i:04d}", f"n{j:04d}") for i in range(len(v)) for j in np.argsort(-s[i])[:5]}
    assert len(got & want) >= 0.9 * len(want) and len(got) == len(want)


def test_neighbours_edges(spark):
    a, b = [1.0] + [0.0] * 127, [0.9, 0.1] + [0.0] * 126
    j = json.dumps
    t1, t2 = datetime(2031, 1, 1), datetime(2031, 1, 2)
    data = [("a", "m", 128, j(a), t1), ("b", "m", 128, j(b), t1), ("b", "m", 128, j(b), t1), ("a", "other", 128, j(a), t1), ("c", "m", 128, j(b), t1), ("c", "m", 128, "[1, 2]", t2)]
    data += [(f"x{i}", "m", 128, bad, None) for i, bad in enumerate([None, "", "{}", "[" + "0," * 127 + "0]", j(a)[:-2], j([float("nan")] + a[1:]), j(["1"] + a[1:]), j([True] + a[1:]), j(a + [0]), "[1e999" + ",0" * 127 + "]"])]
    df = spark.createDataFrame(data, "node_id string, model string, dim int, embedding_json string, updated_at timestamp")
    assert rows(neighbours.similar_pairs(df)) == [("m", "a", "b")]
    assert rows(neighbours.similar_pairs(df.limit(0))) == []
    # a group of copies: every copy gets k neighbours, pairs stay linear
    many = spark.createDataFrame([(f"c{i:03d}", "m", 128, j(a), t1) for i in range(200)] + [("z", "m", 128, j(b), t1)], df.schema)
    n = neighbours.nearest(many, 5).groupBy("node_id").count().collect()
    assert len(n) == 201 and all(r["count"] == 5 for r in n)


def test_large_lists_are_blocked(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "LIST_CAP", 40)
    monkeypatch.setattr(neighbours, "LIST_ROWS", 400)
    v = vectors(300, 2, groups=2)
    df = spark.createDataFrame([(f"n{i:04d}", "m", 128, json.dumps([float(x) for x in a]), datetime(2031, 1, 1)) for i, a in enumerate(v)], "node_id string, model string, dim int, embedding_json string, updated_at timestamp")
    got = {(r["node_id"], r["neighbour_id"]) for r in neighbours.nearest(df, 5).collect()}
    u = np.array(v) / np.linalg.norm(v, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    assert got == {(f"n{i:04d}", f"n{j:04d}") for i in range(len(v)) for j in np.argsort(-s[i])[:5]}


@pytest.mark.parametrize("cap", [6_000, 100])
def test_recall_in_a_dense_cluster(spark, monkeypatch, cap):
    monkeypatch.setattr(neighbours, "LIST_ROWS", 25)
    monkeypatch.setattr(neighbours, "LIST_CAP", cap)
    r = np.random.default_rng(4)
    noise = lambda n: 0.6 * r.normal(size=(n, 128)) / np.sqrt(128)
    one = lambda n: (x := r.normal(size=(n, 128))) / np.linalg.norm(x, axis=1, keepdims=True)
    v = np.concatenate([one(1) + noise(900), np.repeat(one(60), 30, axis=0) + noise(1_800)])  # a third in one cluster
    df = spark.createDataFrame([(f"n{i:04d}", "m", 128, json.dumps([float(x) for x in a]), datetime(2031, 1, 1)) for i, a in enumerate(v)], "node_id string, model string, dim int, embedding_json string, updated_at timestamp")
    got = {(r["node_id_a"], r["node_id_b"]) for r in neighbours.similar_pairs(df, 5).collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    want = {tuple(sorted((f"n{i:04d}", f"n{j:04d}"))) for i in range(900) for j in np.argsort(-s[i])[:5] if s[i, j] >= 0.7}
    assert len(want) > 2_000 and len(got & want) >= 0.99 * len(want)


def test_groups_keep_their_size_with_a_list_per_sampled_row(monkeypatch):
    """Rows of the sample lie on their centroids then; the load is that of other rows."""
    from threadloom.llm import neighbours as nb

    monkeypatch.setattr(nb, "LIST_ROWS", 10)
    monkeypatch.setattr(nb, "LIST_CAP", 50)
    rng = np.random.default_rng(3)
    x = (rng.normal(size=(1, 128)) * 0.5 + rng.normal(size=(6000, 128))).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c, regions, parts, blocks = nb.fit_regions(x[:500], x[500:1000], len(x), 10, 1.1)
    assert len(c) == 500
    _, at, stored = nb.visits(nb.CentroidGraph(c), regions, x, 10, 1.1)
    assert (np.bincount(at, minlength=len(parts)) / parts).max() <= 1.5 * 8 * 50
    assert (np.bincount(at[stored], minlength=len(blocks)) / blocks).max() <= 1.5 * 8 * 50
    # the sample itself would have shown a fraction of it
    _, _, few, _ = nb.fit_regions(x[:500], x[:500], len(x), 10, 1.1)
    assert few.sum() * 2 < parts.sum()


def test_rows_that_search_everywhere_travel_little(spark, monkeypatch):
    """Where nearly every region is searched, narrow regions only send the same rows again and again."""
    monkeypatch.setattr(neighbours, "LIST_ROWS", 10)
    monkeypatch.setattr(neighbours, "LIST_CAP", 40)
    monkeypatch.setattr(neighbours, "SAMPLE", 400)
    fits, fit = [], neighbours.fit_regions
    monkeypatch.setattr(neighbours, "fit_regions", lambda *a, **b: fits.append(fit(*a, **b)) or fits[-1])
    x = np.random.default_rng(5).normal(size=(1200, 128))
    df = spark.createDataFrame([(f"n{i:04d}", "m", 128, json.dumps([float(y) for y in a]), datetime(2031, 1, 1)) for i, a in enumerate(x)], "node_id string, model string, dim int, embedding_json string, updated_at timestamp")
    got = {(r["node_id"], r["neighbour_id"]) for r in neighbours.nearest(df, 5).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    want = {(f"n{i:04d}", f"n{j:04d}") for i in range(len(x)) for j in np.argsort(-s[i])[:5]}
    assert len(got & want) >= 0.999 * len(want)

    class Sent:
        value = {"m": fits[0]}

    rows_in = pd.DataFrame({"model": "m", "nid": np.arange(len(u)), "vec": [neighbours.pack(a) for a in u]})
    sent = pd.concat(neighbours._assign(Sent, neighbours.COPIES, neighbours.RATIO)(iter([rows_in])))
    assert len(sent) <= 10 * len(u)
    side = (sent["role"] >= 4) | (sent["role"] == 1)
    assert sent.groupby(["list", "qp", "db", side]).size().max() <= 1.5 * 8 * 40


@pytest.mark.parametrize("roles", [[0, 2], [0, 1], [0, 2, 4, 6], [2]])
@pytest.mark.parametrize("min_sim", [-1.0, 0.3, 0.7])
def test_groups_against_brute_force(monkeypatch, roles, min_sim):
    monkeypatch.setattr(neighbours, "TILE", 48)
    r = np.random.default_rng(len(roles))
    x = r.normal(size=(30, 128))[r.integers(0, 30, 300)] + 0.5 * r.normal(size=(300, 128))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    ids, role = r.permutation(300) * 7, r.choice(roles, 300)
    if roles == [0, 1]:  # a row that searches and is stored comes twice
        ids[:40], x[:40], role[:40], role[100:140] = ids[100:140], x[100:140], 0, 1
    a, b, _ = neighbours.best_in_group(ids, x, role, 5, min_sim)
    s = x @ x.T
    ok = (role & 3 != 1)[:, None] & (role & 3 != 0) & (ids[:, None] != ids) & (s >= min_sim)
    if 4 in roles:
        ok &= (role >= 4)[:, None] != (role >= 4)
    s = np.where(ok, s, -9)
    got = list(zip(a.tolist(), b.tolist()))
    assert len(got) == len(set(got))
    assert set(got) == {(ids[i], ids[j]) for i in range(300) for j in np.argsort(-s[i])[:5] if s[i, j] > -9}


def test_graph_of_many_centroids_is_small():
    import tracemalloc

    from threadloom.llm import neighbours as nb

    rng = np.random.default_rng(4)
    c = rng.normal(size=(6000, 128)).astype(np.float32)
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    tracemalloc.start()
    try:
        nb.CentroidGraph(c)
        assert tracemalloc.get_traced_memory()[1] < 150e6  # 6000 x 6000 places would be 288 MB
    finally:
        tracemalloc.stop()


def test_graph_search_finds_the_nearest():
    r = np.random.default_rng(3)
    c = r.normal(size=(600, 32)).astype(np.float32)
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    q = c[:200] + 0.05 * r.normal(size=(200, 32)).astype(np.float32)
    ids, _ = neighbours.CentroidGraph(c).search(q, 3, beam=32)
    assert (ids[:, 0] == np.arange(200)).mean() > 0.95


# ---- p8, p9 ----------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(6))
def test_packing_invariants(seed):
    r = random.Random(seed)
    cap, sep = r.choice([(10, 0), (64, 1), (512, 2), (1, 0)])
    items = [(i, r.choice([1, r.randint(1, cap), r.randint(1, 3 * cap), cap])) for i in range(300)]
    bins = packing.pack(items, cap, sep)
    assert all(sum(p[3] for p in b) + sep * (len(b) - 1) <= cap for b in bins)
    by = defaultdict(list)
    for b in bins:
        for d, piece, start, n in b:
            by[d].append((piece, start, n))
    for d, n in items:
        ps = sorted(by[d])
        assert [p[1] for p in ps] == [sum(q[2] for q in ps[:k]) for k in range(len(ps))] and sum(p[2] for p in ps) == n
        assert len(ps) == 1 or n > cap
    classes = [packing.harmonic_class(n, cap, sep) for _, n in items if n <= cap]
    assert min(classes, default=1) >= 1


def test_packing_table(spark):
    docs = spark.createDataFrame([(1, prose(2)), (2, None), (3, ""), (4, prose(400)), (5, prose(2))], "doc_id long, text string")
    caps = spark.createDataFrame([("s", 64, 1), ("s", 64, 1), ("l", 4096, None)], "pack_name string, capacity_tokens int, separator_tokens int")
    p = packing.packed(docs, caps)
    assert {r["doc_id"] for r in p.collect()} == {1, 4, 5}
    rep = {r["pack_name"]: r for r in packing.fill_report(p, caps).collect()}
    assert rep["s"]["fullest"] <= 64 and rep["s"]["tokens"] == rep["l"]["tokens"]
    assert packing.packed(docs.limit(0), caps).count() == 0
    with pytest.raises(ValueError):
        packing.packed(docs, spark.createDataFrame([("z", 0, 0)], caps.schema))


def test_long_texts_count_like_short_ones():
    t = prose(9000)
    e = tokens.encoder()
    assert len(t) > 400_000 and tokens.count_tokens(t) == len(e.encode_ordinary(t))
    assert tokens.count_tokens("a" * 300_000) > 1_000 and tokens.count_tokens(" " * 300_000) > 0
    assert tokens.count_tokens("<|endoftext|> a") > 2 and tokens.count_tokens("") == 0


def test_mixing(spark):
    r = random.Random(2)
    data = [(i, prose(r.randint(1, 12), i), r.choice(["A", "a ", "A"]) if i % 10 else "b") for i in range(400)] + [(900, None, "a"), (901, "", "b"), (902, "x y", None), (903, "x y", "other")]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string")
    t = spark.createDataFrame([("a", 0.7, 1), ("B", 0.2, 3), ("none", 0.1, 5)], "source string, target_share double, max_repeats int")
    c, _ = mixing.mixed(docs, t)
    c = c.cache()
    uses = {(r["doc_id"],): r["n"] for r in c.groupBy("doc_id").count().withColumnRenamed("count", "n").collect()}
    got = {r["source"]: r for r in mixing.shares(c, t).collect()}
    assert abs(got["a"]["actual_share"] - 0.7 / 0.9) < 0.02 and abs(got["b"]["actual_share"] - 0.2 / 0.9) < 0.02 and got["none"]["tokens"] == 0
    assert got["a"]["repeats"] == 1 and got["b"]["repeats"] <= 3 and max(uses.values()) <= 3
    assert c.groupBy("doc_id", "epoch").count().where("count > 1").count() == 0
    # complete epochs come before the fraction
    b = [r["epoch"] for r in c.where("source = 'b'").groupBy("doc_id").agg({"epoch": "max"}).withColumnRenamed("max(epoch)", "epoch").collect()]
    assert max(b) - min(b) <= 1
    assert rows(c) == rows(mixing.mixed(docs, t)[0])
    assert mixing.mixed(docs.limit(0), t)[0].count() == 0
    small = mixing.mixed(docs, t, total=500)[0].agg({"tokens": "sum"}).first()[0]
    assert abs(small - 500) < 150


# ---- p3, p5 ----------------------------------------------------------------------


def page(i, head="Zu den Inhalten springen", foot="Gedruckt mit Sorgfalt", body=None):
    """A page whose furniture no list knows."""
    lines = [head, "Start | Kurse | Karten", prose(2, 7 * i + 1), "Auch gerade beliebt", f"How a gardener number {chr(97 + i)} counted birds", f"Why the {prose(1, i)[:20].strip()} matters", prose(3, 7 * i + 2), foot, f"© {2000 + i} Verlag am See"]
    return "\n".join(lines if body is None else [*lines[:2], body, *lines[-2:]])


def corpus(spark, more=(), n=8):
    data = [(f"c{i}", f"Page {chr(97 + i)}", page(i), "web", "x", "y") for i in range(n)]
    return spark.createDataFrame(data + data[:2] + list(more), ITEMS)


def test_bodies(spark):
    end = (prose(2, 91) + "\n\nbis bald")
    more = [(f"s{i}", f"Signed {i}", prose(3, 400 + i) + "\n\nbis bald", None, None, None) for i in range(5)]
    more += [("cut", "Cut", page(9)[: page(9).rindex("am See")].replace("\n©", "\n" + end + "\n©"), None, None, None), ("n", "t", None, None, None, None), ("e", None, "", None, None, None), ("b", None, " \n ", None, None, None), (None, "x", page(3), None, None, None)]
    df = corpus(spark, more)
    got = defaultdict(list)
    for r in boilerplate.surrounding_rows(df).collect():
        got[r["saved_item_id"]].append(r["line_no"])
    want = [1, 2, 4, 5, 6, 8, 9]
    assert {k: sorted(v) for k, v in got.items()} == {**{f"c{i}": want for i in range(8)}, "cut": [*want[:-1], 12]}
    body = {r["saved_item_id"]: r["body"] for r in boilerplate.main_bodies(df).collect()}
    assert body["c1"] == "\n".join(page(1).split("\n")[i] for i in (2, 6)) and body["e"] == "" and body["s1"].endswith("bis bald") and "n" not in body
    assert boilerplate.surrounding_rows(df.limit(0)).count() == 0 and boilerplate.main_bodies(df.limit(0)).count() == 0


def test_copies_are_no_furniture(spark):
    one = prose(3, 1) + "\n" + prose(2, 2) + "\nA short line here"
    data = [(f"k{i}", "One title", one + f"\nLine {chr(97 + i)} of its own", None, None, None) for i in range(6)] + [(f"m{i}", None, prose(3, 50 + i), None, None, None) for i in range(4)]
    df = spark.createDataFrame(data, ITEMS)
    assert boilerplate.surrounding_rows(df).count() == 0
    assert residue.residue(df, spark.createDataFrame([], PROMPTS)).count() == 0


def test_lines_full_of_tags(spark):
    links = "".join(f'<a href="/n{i}"><b>Quiet town {i}</b></a> ' for i in range(8))
    data = [(f"t{i}", f"T{i}", "\n".join([prose(4, 3 * i), prose(3, 3 * i + 1), links + chr(97 + i), "<p>" + prose(5, 3 * i + 2) + "</p>"]), None, None, None) for i in range(2)]
    assert sorted(r["line_no"] for r in boilerplate.surrounding_rows(spark.createDataFrame(data, ITEMS)).collect()) == [3, 3]


def test_smoothing_and_threshold():
    smooth = boilerplate.smoother()
    assert smooth([]) == [] and smooth([1.0]) == [1.0]
    s = smooth([1.0, 0.0, 1.0, 1.0])
    assert s[1] < 0.3 < 0.8 < s[3]
    assert boilerplate.threshold({}) == -1.0 and boilerplate.threshold({199: 5}) == -1.0
    assert 0.3 < boilerplate.threshold({2: 100, 30: 20, 180: 400, 199: 900}) < 0.8


@pytest.mark.parametrize(
    ("text", "windows"),
    [
        ("Hi {{ name }}, how are you?", ["hi \x00, how are you?"]), ("Title: undefined", ["title: \x00"]), ("nan", ["\x00"]), (prose(2) + " [TRUNCATED]", []), ("None of this works.", ["\x00 of this works."]), (prose(3), []), ("", []),
        ("First. Dear %%NAME%%, we saved [LINK] for you. Last.", ["dear \x00, we saved \x00 for you."]),
    ],
)
def test_slot_windows(text, windows):
    assert recurrence.slot_windows(text) == windows


def test_units():
    no, marks, tags, words, u, at, chars, spelled = recurrence.read("A | B\n\nPOST:Short text\n---COMMENT---\n© 2031 Lakeside. All", None, "https://www.lakeside.example/x")
    assert no == [1, 3, 5] and spelled == ["a", "b", "short text", "© # *. all"] and at == [0, 0, 1, 2] and marks[1] & recurrence.MARKED and tags == [0, 0, 0]
    assert recurrence.read(None, None, None)[0] == [] and recurrence.read(" \n", "{{ x }}", None, True)[-1] == ["\x00"]
    assert recurrence.prompt_parts("URL: u\nTITLE: a\nCONTENT:\nTITLE: b\nCONTENT:\nbody\nTITLE: no") == ("b", "body\nTITLE: no") and recurrence.prompt_parts("plain") == ("", "plain")
    assert recurrence.site_name(None) == "" and recurrence.site_name("https://a.b-c.example:80/x") == "b-c"


def test_rare_residue_is_an_exemplar(spark):
    from threadloom.llm import recurrence

    c = recurrence.Corpus.__new__(recurrence.Corpus)
    flag = recurrence.RECURS | recurrence.RESIDUE
    c.named = spark.createDataFrame([(1, "page not found", 1_000_000, flag), (2, "diese seite ruht sich gerade aus", 3, flag), (3, "read more", 9, recurrence.RECURS | recurrence.FURNITURE)], "u long, spelled string, n long, flag int")
    assert sorted(c.exemplars()) == [("diese seite ruht sich gerade aus", 3), ("page not found", 1_000_000)]


def test_residue(spark):
    notice = "Diese Seite ruht sich gerade aus"
    bad = {f"r{i}": notice + f"\nVorgang {1000 + i}" for i in range(4)}  # recurs in texts without anything else
    bad |= {f"p{i}": page(i, body=notice) for i in range(3)}
    bad |= {"seed": "404 Not Found", "script": "You need to enable JavaScript to run this app.", "lorem": residue.LOREM, "slot": "{{ title }}", "alone": "Title: undefined"}
    bad |= {f"d{i}": f"Dear {{{{ name{chr(97 + i)} }}}}, we kept the page for you.\n" + prose(5, 70 + i) for i in range(4)}
    good = {
        "quote": prose(3, 31) + f"\nThe screen said: {notice}, and we laughed about it for weeks.", "full": page(6, body=prose(6, 32) + "\n" + notice + "\n" + prose(4, 33)), "tells": "In the template you write {{ title }} and the tool fills in the rest of the page later.",
        "error": "We got a 404 Not Found for two days, then the page came back as if nothing had been wrong.", "none": "None of this works.", "empty": "", "blank": "  \n", "null": None, "long": prose(20_000, 34),
    }
    items = corpus(spark, [(k, f"Title {k}", v, None, None, None) for k, v in {**bad, **good}.items()] + [(None, "x", notice, None, None, None)])
    user = lambda t, b: [("user", f"URL: u\nTITLE: {t}\nCONTENT:\n{b}")]
    prompts = spark.createDataFrame(
        [("a", None, None, user("{{ x }}", prose(2)), 1), ("b", None, None, user("B", notice), 1), ("c", None, None, user("T", "{text}"), 1), ("d", None, None, None, 1), ("e", None, None, [("system", "{{ x }}"), ("user", None)], 1), ("f", None, None, user("F", prose(4)), 1)], PROMPTS
    )
    got = rows(residue.residue(items, prompts).select("table_name", "record_id"))
    assert got == sorted([("groq_batch_3r", x) for x in "abc"] + [("saved_items", k) for k in bad], key=repr)
    assert residue.residue(items.limit(0), prompts.limit(0)).count() == 0
    # records of residue keep their lines
    assert {r["saved_item_id"] for r in boilerplate.surrounding_rows(items).select("saved_item_id").distinct().collect()} == {f"c{i}" for i in range(8)} | {"full"}


def test_containment():
    index = residue.ExemplarIndex([("error", "access denied for *"), ("filler", "your text here")], {"the": 0.9, "for": 0.5})
    assert index.match("access denied") == "error" and index.match("access denied for readers") == "error" and index.match("your text here your text here") == "filler"
    assert index.match("we were denied access for two whole days because of the cold winter") is None and index.match("") is None


def test_only_what_decides_is_read():
    """What p3_found and p5_found cost: a window too heavy for any exemplar is read no further, nor are the sentences after its first."""
    word = lambda i: "".join(chr(97 + int(c)) for c in str(i))
    index = residue.ExemplarIndex([("error", "access denied for *")], {"the": 0.9})
    assert index.match(" ".join(word(i) for i in range(5000))) is None and len(index.idf) < 50
    index = residue.ExemplarIndex([("error", "access denied")], {"the": 0.9})
    seen = []
    index.match = lambda w: seen.append(w) or residue.ExemplarIndex.match(index, w)
    s = "the birds came back. " + "then it was quiet. " * 50
    assert residue._label(index, [0], s, [s], [False]) is None and seen == [s, "the birds came back."]
    assert residue._label(index, [0], "access denied. access denied!", ["x"], [False]) == "error" and residue._label(index, [0], "access denied. the birds came back.", ["x"], [False]) is None


def test_prefilters_lose_nothing():
    r = random.Random(3)
    bits = ["a", "é", "ß", "İ", "²", "٣", "१२", "_", "don't", "404", "1,000.5", "deadbeef12", "v2.0", "*", "#", "the", "lorem", "dolor", ".", "…", "!", ")", "”", " ", " ", "\u2028", "\x1c", "-", "中文", "{{ x }}", "<<a>>", "[NAME]", "[[x]]", "$500", "$name$", "nan", "finance", "(null)", "N/A", "__X__", "%(a)s", "*|A|*", "X_GOES_HERE", "@Model.Name", "[object Object]", "{a b}", "%%X%%", "<INSERT X>", "{% if %}", "<%= x %>", "#{a}", "${b}"]
    index = residue.ExemplarIndex([("error", "access denied"), ("filler", "lorem * the")], {"the": 0.9, "a": 0.6})
    for i in range(4000):
        t = "".join(r.choice(bits) + r.choice(["", " "]) for _ in range(r.choice([1, 3, 10, 40])))
        assert recurrence.letter_words(t) == set(recurrence._LETTERS.findall(t))
        p = " ".join(t.casefold().split())
        assert recurrence.spell(t) == recurrence._CODE.sub("#", p)
        assert bool(recurrence.slot_windows(t)) == (recurrence.hints(t) and bool(recurrence._SLOT.search(t))), t
        assert bool(residue._FIRST_END.search(p)) == (len(residue._SENT.split(p)) > 1)
        # the definition: a fifth of the words at most is common, and the pairs of the others are the filler's
        w = [x for x in residue.words_of(p) if x.isalpha()]
        pairs = [x for y in w if y not in index.common for x in residue._pairs(y)]
        assert index.filler(p) == (len(w) >= 4 and sum(x in index.common for x in w) <= 0.2 * len(w) and bool(pairs) and sum(x in residue._FILLER for x in pairs) >= residue.PAIRS * len(pairs))


def test_plain_columns():
    import pyarrow as pa

    for kind, data in [(pa.string(), ["a", None, ""]), (pa.list_(pa.int32()), [[1, 2], None, [], [3]]), (pa.list_(pa.int64()), [[1 << 62, -1]]), (pa.list_(pa.string()), [["é", ""], [], None]), (pa.list_(pa.int32()), [[1, None]]), (pa.list_(pa.int32()), []), (pa.int64(), [1, None])]:
        col = pa.array(data, kind)
        assert recurrence.plain(col) == data and recurrence.plain(col[1:]) == data[1:]


# ---- p1 --------------------------------------------------------------------------


def test_cut_records(spark):
    whole = {f"w{i}": prose(6, i) + f"\n- {' '.join(prose(1, 70 + i).lower().split()[:3])}\n" + prose(2, 900 + i) for i in range(40)}
    for i in range(4):
        whole[f"w{i}"] += "\n\n" + ["thanks in advance", "#winter #garden", "(and no, I have no regrets)", "And so we wait..."][i]
        whole[f"v{i}"] = whole[f"x{i}"] = ""
    whole |= {f"v{k}{i}": prose(3, 950 + 9 * i + k) + "\n\n" + ["thanks in advance", "#winter #garden", "(and no, I have no regrets)", "And so we wait...", "Photos: https://pics.example/album/1", "Back to top", "🙂", "Read on: {{ link }}"][k] for k in range(8) for i in range(3)}
    cases = {
        "mid_word": prose(5) + " Several not", "mid_sentence": prose(5) + " Several notebooks carry stories about", "mark": prose(4) + " Several note [TRUNCATED]", "broken": prose(4) + " Several no��", "dots": prose(4) + " Several bicycles carry note…",
        "entity": prose(4) + " Several bicycles &am", "link": prose(3) + " Several bicycles about https://www.exam", "item": prose(3) + "\n- several notebo", "closing_cut": prose(3) + "\n\nthanks in adv",
    }
    sound = {
        "emoji": prose(3) + " 🙂", "closing": prose(3) + "\n\nthanks in advance", "tags": prose(3) + "\n#winter #garden", "aside": prose(3) + " (and no, I have no regrets)", "dots_whole": prose(3) + "\nAnd so we wait...", "photo": prose(3) + "\nPhotos: https://pics.example/album/77",
        "list": prose(3) + "\n- several winter notebooks", "slot": "Read on: {{ link }}", "empty": "", "null": None, "footer": prose(3) + "\nBack to top",
    }
    data = [(k, None, v, "web", "x", "y") for k, v in {**whole, **cases, **sound}.items()]
    items = spark.createDataFrame(data + data[:3], ITEMS)
    prompts = spark.createDataFrame([("p1", "https://a/b", None, [("system", prose(2)), ("user", "URL: u\nTITLE: T\nCONTENT:\n" + prose(3) + " Several bicycles carr")], 1), ("p3", None, None, None, 1)], PROMPTS)
    good = json.dumps({"root": {"label": "L"}, "domains": []})
    outs = spark.createDataFrame([("o1", None, None, good, None, None, "x"), ("o2", None, None, good[:-5], None, None, "x"), ("o3", None, None, None, ([(0, ("assistant", "Here is the map:\n" + good[:12]), None)],), None, "x"), ("o4", None, None, "```json\n" + good + "\n```", None, None, None), ("o5", None, None, None, ([],), None, None)], OUT)
    got = set(rows(truncation.cut_records(items, prompts, outs)))
    o = "groq_batch_all_1776865759_outputs"
    assert got == {("saved_items", k) for k in cases} | {("groq_batch_3r", "p1"), (o, "o2"), (o, "o3")}
    share = {(r["table_name"], r["source"]): r for r in truncation.cut_share(items, prompts, outs).collect()}
    assert share[("saved_items", "web")]["records"] == len(data) and share[("saved_items", "web")]["cut_records"] == len(cases)
    assert truncation.cut_records(items.limit(0), prompts.limit(0), outs.limit(0)).count() == 0


def test_copies_hide_no_cut(spark):
    whole = {f"w{i}": "\n".join(prose(3, 500 + 3 * i + k) for k in range(3)) for i in range(40)}
    one = prose(5) + " Several quiet ledgers carry the notebooks of win"  # "win" begins "winter"
    word = prose(5, 7) + " Several ledgers carry quiet stories about"
    copies = {f"c{i}": one for i in range(6)} | {f"d{i}": word for i in range(6)}
    usual = {f"u{i}": prose(3, 200 + i) + "\n\nKept by our winter club" for i in range(4)}
    items = spark.createDataFrame([(k, None, v, "web", "x", "y") for k, v in {**whole, **copies, **usual}.items()], ITEMS)
    prompts = spark.createDataFrame([(k, None, None, [("user", f"URL: u\nTITLE: T\nCONTENT:\n{v}")], 1) for k, v in copies.items()], PROMPTS)
    got = set(rows(truncation.cut_records(items, prompts, spark.createDataFrame([], OUT))))
    assert got == {("saved_items", k) for k in copies} | {("groq_batch_3r", k) for k in copies}


def test_long_text_ends():
    assert truncation.end_evidence(prose(30_000))[0] == truncation.WHOLE
    assert truncation.open_map('{"a": "x\\"}') and not truncation.open_map('{"a": [1, "]"]}')


# ---- p2 --------------------------------------------------------------------------

TEXT = prose(12, 9)
GERMAN = "Das Fahrrad und der Garten sind neben dem Haus und die Brücke ist immer noch alt. Der Markt und die Mühle wird nicht wieder geöffnet."


def answer(why, n=3, label="A label"):
    return json.dumps({"root": {"label": label, "why_saved": why}, "domains": [{"name": "Gardens", "confidence": 0.5}], "themes": [], "concepts": [], "micro_insights": [{"text": f"An own thought number {i} about the plants and their keepers in the yard.", "type": "Aha"} for i in range(n)]})


@pytest.mark.parametrize(
    ("text", "defect"),
    [
        ("", "empty_answer"), (None, "empty_answer"), ("null", "empty_answer"), ("```json\n```", "empty_answer"), ("N/A", "empty_answer"), ("​", "empty_answer"), ("{}", "empty_answer"), (answer("", 0).replace("Gardens", ""), "empty_answer"),
        (answer("It is about the plants.")[:-30], "truncated_answer"), (TEXT.lower(), "copied_question"), (answer(TEXT, 0), "copied_question"), (answer(GERMAN, 0), "other_language"), ("Sorry, I can't help with mapping this page.", None),
        (answer("It is about the plants and how they grow in the yard."), None), ("Here is the map:\n" + answer("It is about the plants and how they grow."), None), ("```json\n" + answer("It is about the plants and how they grow.") + "\n```", None),
        (answer("I can't believe how well this routine worked, worth keeping."), None), (answer("A thread on why assistants say they cannot help, with the best of the answers."), None), (answer(TEXT.split(".")[0] + "."), None),
    ],
)
def test_defects(text, defect):
    messages = [{"role": "system", "content": "Map the saved item below. Keep names short."}, {"role": "user", "content": f"URL: u\nTITLE: Gardens\nCONTENT:\n{TEXT}"}]
    assert pairs.judge(text, None, messages)[0] == defect


def test_defect_table(spark):
    user = [("user", f"URL: u\nTITLE: Gardens\nCONTENT:\n{TEXT}")]
    prompts = spark.createDataFrame([(i, None, None, user, 1) for i in ("1", "2", "2")], PROMPTS)
    outs = spark.createDataFrame(
        [
            ("1", None, None, None, ([(0, ("assistant", answer("It is about the plants and how they grow.")), "stop")],), None, None), ("2", None, None, None, None, None, None), ("2", None, None, None, None, None, None),
            ("3", None, None, "Sorry, I can't help with that.", None, None, None), ("4", None, None, " ", None, (("L", "It is about plants."), [], []), None), ("5", None, None, None, None, (("", ""), [], []), None),
        ],
        OUT,
    )
    assert rows(pairs.defects(outs, prompts)) == [("2", "empty_answer"), ("5", "empty_answer")]
    assert pairs.defects(outs.limit(0), prompts.limit(0)).count() == 0


def test_templates(spark):
    base = "this item was left out by our checks and nothing about it can be shown to you at the moment thanks"
    df = spark.createDataFrame([(base,)] * 5 + [(base + " again",), (prose(2).lower(),)], "opening string")
    t = {r["opening"]: r["prompts"] for r in pairs.templates(df).collect()}
    assert t[base] >= 5 and len(t) <= 2


def test_languages():
    assert pairs.language(TEXT) == "en" and pairs.language(GERMAN) == "de" and pairs.language("12 34") is None
    assert pairs.language("El huerto del taller es la cocina de la casa y el puente con la lista.") == "es"
    assert pairs.language("O moinho e a feira limpou sempre o caderno e a estante sobre o horário.") == "pt"
    assert pairs.language("La cuisine pour le carnet derrière le dossier pour le marché avec la liste.") == "fr"


def test_language_of_a_long_text():
    assert pairs.language(" ".join([TEXT] * 30) + " " + " ".join([GERMAN] * 900)) == "de"  # English for its first 20,000 characters


def test_refusals_in_other_words(spark):
    text = "Our checks left this entry out and nothing of it may be shown at the moment, so please choose one more of your saved pages"
    bare = lambda why: json.dumps({"root": {"label": "Entry", "why_saved": why}, "domains": []})
    user = lambda i: [("user", f"URL: u\nTITLE: T{i}\nCONTENT:\n{prose(4, i)}")]
    prompts = spark.createDataFrame([(f"{k}{i}", None, None, user(i if k == "r" else 77), 1) for k in "rs" for i in range(5)] + [("o", None, None, user(9), 1)], PROMPTS)
    alone = "A page about ledgers and how they came to be kept in the garden for the winter by nobody who planned it before spring"
    outs = [(f"r{i}", None, None, bare(text + (" again." if i % 2 else ".")), None, None, None) for i in range(5)]
    outs += [(f"s{i}", None, None, bare(alone), None, None, None) for i in range(5)]  # one saved text under five ids
    outs += [("o", None, None, answer("I can't believe how well this routine worked, worth keeping.", 1), None, None, None)]
    assert rows(pairs.defects(spark.createDataFrame(outs, OUT), prompts)) == [(f"r{i}", "refusal") for i in range(5)]


def test_refusals_put_together(spark):
    """Beginnings and ends change, so no opening is like another; the middle recurs over unrelated prompts."""
    middle = "nothing about this entry may be told here"
    heads, tails = ["Well", "As asked", "Having looked", "To be plain", "Alas"], ["", " for now", ", kindly pick one more page", " by rule", ", as it would break our word"]
    prompts = spark.createDataFrame([(str(i), None, None, [("user", f"URL: u\nTITLE: T{i}\nCONTENT:\n{prose(4, i)}")], 1) for i in range(6)], PROMPTS)
    outs = [(str(i), None, None, f"{heads[i]}, {middle}{tails[i]}.", None, None, None) for i in range(5)] + [("5", None, None, "A page about ledgers that somebody kept in a garden for a long time.", None, None, None)]
    assert rows(pairs.defects(spark.createDataFrame(outs, OUT), prompts)) == [(str(i), "refusal") for i in range(5)]
