"""Operators on small tables: invariants, boundaries, plain Python references."""

import json
import random

import pytest
from pyspark.sql import functions as F

from threadloom.operators import embed, graph, layout, ledger, merge, nested, responses, selection
from threadloom.sources import readers, sinks


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda t: tuple((x is not None, x) for x in t))


# ---- merge -------------------------------------------------------------------


def test_fill_or_insert(spark):
    old = spark.createDataFrame([("p", "u1", "", "raw1"), (None, "u2", "web", "")], "profile string, url string, source string, raw string")
    new = spark.createDataFrame([(1, "p", "u1", "x", "r"), (2, None, "u2", "y", "r2"), (3, "p", "u3", "z", "r3"), (4, "p", "u3", "z", "r4")], "pos int, profile string, url string, source string, raw string")
    state, outcome = merge.fill_or_insert(old, new, ["profile", "url"], ["source", "raw"], [F.col("pos")])
    got = {r["url"]: (r["source"], r["raw"]) for r in state.collect()}
    assert got == {"u1": ("x", "raw1"), "u2": ("web", "r2"), "u3": ("z", "r3")}
    assert [r["outcome"] for r in outcome.orderBy("pos").collect()] == ["existing", "existing", "inserted", "existing"]


def test_merge_twice_is_once(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, None)], "k int, v string")
    once = merge.overwrite(old, new, ["k"])
    assert rows(merge.overwrite(once, new, ["k"])) == rows(once) == [(1, "a"), (2, "c"), (3, None)]


def test_changed_is_null_safe(spark):
    a = spark.createDataFrame([(1, None), (2, None), (3, "x")], "k int, v string")
    b = spark.createDataFrame([(1, None), (2, "y"), (3, None)], "k int, v string")
    assert rows(merge.changed(a, b, "k", ["v"])) == [(2,), (3,)]


def test_empty_tables(spark):
    e = spark.createDataFrame([], "k int, v string")
    assert rows(merge.overwrite(e, e, ["k"])) == [] and rows(merge.latest(e, ["k"], [F.col("v")])) == []


# ---- selection ---------------------------------------------------------------


@pytest.mark.parametrize(("free", "want"), [(True, [1]), (False, [])])
def test_budget(spark, free, want):
    df = spark.createDataFrame([(1, 5), (2, 3), (3, 3)], "pos int, cost int")
    assert [r["pos"] for r in selection.budget_prefix(df, "cost", [F.col("pos")], 4, first_free=free).orderBy("pos").collect()] == want


def test_running_matches_plain(spark):
    r = random.Random(1)
    data = [(i, r.randint(0, 20), r.randint(0, 9)) for i in range(500)]
    df = spark.createDataFrame(data, "id int, o int, v int")
    got = {x["id"]: x["running"] for x in selection.running(df, "v", [F.col("o"), F.col("id")]).collect()}
    total, want = 0, {}
    for i, _, v in sorted(data, key=lambda x: (x[1], x[0])):
        total += v
        want[i] = total
    assert got == want


def test_cascade(spark):
    df = spark.createDataFrame([(1, "r", 5, 3), (2, "l", 4, 3), (3, "x", 0, 3), (4, "g", 9, 3)], "pos int, class string, pending int, cap int")
    assert [r["take"] for r in selection.cascade(df, 7).orderBy("pos").collect()] == [3, 3, 0, 1]


# ---- graph -------------------------------------------------------------------


def test_parents(spark):
    c = spark.createDataFrame([("s", "c1", "deep learning"), ("s", "c2", "zebra")], "source_id string, child_id string, name string")
    p = spark.createDataFrame([("s", "p1", "art", 0), ("s", "p2", "machine learning", 1)], "source_id string, parent_id string, name string, pos int")
    assert {r["child_id"]: r["parent_id"] for r in graph.infer_parents(c, p).collect()} == {"c1": "p2", "c2": "p1"}


def test_jaccard(spark):
    m = spark.createDataFrame([(1, x) for x in "abc"] + [(2, x) for x in "bcd"] + [(3, "z")], "set_id int, item string")
    assert rows(graph.jaccard(m)) == [(1, 2, 0.5)]


@pytest.mark.parametrize("least", [0.1, 0.3, 0.5, 0.8, 1.0])
def test_jaccard_against_brute_force(spark, least):
    r = random.Random(11)
    sets = {i: frozenset(r.choices("abcdefghijkl", k=r.randint(1, 9)) + (["hub"] if r.random() < 0.8 else [])) for i in range(60)}
    rep = {}
    for i in sorted(sets):
        rep.setdefault(sets[i], i)
    want = {(rep[s], i) for i, s in sets.items() if rep[s] != i}
    reps = sorted(rep.values())
    want |= {(a, b) for a in reps for b in reps if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= least - 1e-12}
    df = spark.createDataFrame([(i, x) for i, s in sets.items() for x in s], "set_id int, item string")
    assert {(x["a"], x["b"]) for x in graph.jaccard(df, least).collect()} == want


def test_components(spark):
    r = random.Random(3)
    n = 120
    edges = [(i, i + 1) for i in range(40)] + [(r.randrange(50, n), r.randrange(50, n)) for _ in range(40)]
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = graph.components(spark.range(n), spark.createDataFrame(edges, "a long, b long"))
    assert {x["id"]: x["component"] for x in got.collect()} == {i: find(i) for i in range(n)}


def test_cosine_blocks_agree(spark):
    r = random.Random(5)
    v = spark.createDataFrame([(i, [r.gauss(0, 1) for _ in range(8)]) for i in range(60)] + [(60, [0.0] * 8)], "id long, v array<double>")
    whole, parts = graph.cosine_edges(v, v, 4, 0.2), graph.cosine_edges(v, v, 4, 0.2, block=13)
    assert rows(whole) == rows(parts) and whole.count() > 0


def test_embedder(spark):
    t = spark.createDataFrame([("a", "red bike"), ("b", "red bike"), ("c", None)], "id string, text string")
    got = {r["id"]: r["embedding"] for r in embed.embed(t, embed.hashing_embedder(16)).collect()}
    assert got["a"] == got["b"] and abs(sum(x * x for x in got["a"]) - 1) < 1e-5
    have = spark.createDataFrame([("a",)], "id string")
    assert {r["id"] for r in embed.embed_missing(t, have, embed.hashing_embedder(16)).collect()} == {"b", "c"}


# ---- layout ------------------------------------------------------------------


def test_siblings_do_not_overlap(spark):
    nodes = [("s", f"d{i}", 1, None) for i in range(3)] + [("s", f"t{i}", 2, f"d{i % 3}") for i in range(7)] + [("s", f"c{i}", 3, f"t{i % 7}") for i in range(15)] + [("s", f"m{i}", 4, f"c{i % 15}") for i in range(30)] + [("s", "lost", 4, "nowhere")]
    placed = layout.source_boards(spark.createDataFrame(nodes, "source_id string, node_id string, tier int, parent_id string")).collect()
    at = {r["node_id"]: r for r in placed}
    assert "lost" not in at and len(at) == 1 + len(nodes) - 1
    for tier in (1, 2, 3):
        w = layout.BOX[tier][0]
        xs = sorted(r["x"] for r in placed if r["tier"] == tier)
        assert all(b - a >= w for a, b in zip(xs, xs[1:]))
    assert all(r["parent_id"] in at for r in placed if r["parent_id"])


def test_ring_and_sides(spark):
    e = spark.createDataFrame([("a", f"b{i:02d}", 0.9 - i / 100) for i in range(15)], "a string, b string, strength double")
    got = layout.ring(e).collect()
    assert len(got) == 12 and {r["b"] for r in got} == {f"b{i:02d}" for i in range(12)}
    top = next(r for r in got if r["b"] == "b00")
    assert (top["x"], top["y"]) == (1200, 840)
    s = spark.createDataFrame([(0, 0, 10, 3), (0, 0, -10, 3), (0, 0, 1, 5), (0, 0, 1, -5)], "ax int, ay int, bx int, by int")
    assert [r[0] for r in s.select(layout.side(*(F.col(c) for c in ("ax", "ay", "bx", "by")))).collect()] == ["right", "left", "bottom", "top"]


def test_file_names(spark):
    df = spark.createDataFrame([("1", "a"), ("2", "a"), ("3", "b"), ("4", "a")], "id string, t string")
    assert rows(layout.file_names(df, F.col("t"), [F.col("id")]).select("id", "name")) == [("1", "a"), ("2", "a-2"), ("3", "b"), ("4", "a-3")]
    known = spark.createDataFrame([("2", "a"), ("9", "a-2")], "id string, name string")
    got = rows(layout.file_names(df, F.col("t"), [F.col("id")], known).select("id", "name"))
    assert got == [("1", "a-3"), ("2", "a"), ("3", "b"), ("4", "a-4")]


def test_routes(spark):
    rel = spark.createDataFrame([("s1", "a", "s2", "b", 1, 0.9), ("s2", "c", "s1", "a", 1, 0.8)], "a_source string, a string, b_source string, b string, tier int, strength double")
    order = spark.createDataFrame([("s1", 1), ("s2", 2)], "source_id string, pos int")
    boxes = spark.createDataFrame([("s1", 0, 1000), ("s2", 5000, 7000)], "source_id string, left int, right int")
    placed = spark.createDataFrame([("s1", "a", 1, 10, 20), ("s2", "b", 1, 5010, 40), ("s2", "c", 1, 5500, 60)], "source_id string, node_id string, tier int, x int, y int")
    got = layout.routed(layout.lanes(rel, order), boxes, placed).orderBy("edge", "segment").collect()
    assert len(got) == 10 and got[0]["from_node"] == "srcnode::s1::a" and got[4]["to_node"] == "srcnode::s2::b"
    assert (got[0]["a_px"], got[0]["b_px"]) == (1700, 4300) and got[0]["from_side"] == "right"
    assert [r["from_node"] for r in got[1:5]] == [r["to_node"] for r in got[0:4]]


# ---- nested ------------------------------------------------------------------

NESTED = [
    {"a": [1, None, {"b": [[], [None, 2], "x"]}, []], "c": {"d": None, "e": []}},
    [{"a": 1}, [2, [3]], None, "t"],
    {"": [1], "x.y": [{"z": None}]},
    {}, [], {"a": [None, None]}, {"a": [[[[1]]]]},
]


def walk(v, path=""):
    out = []
    if isinstance(v, dict):
        for k, x in v.items():
            out += walk(x, path + ("." if path else "") + k)
    elif isinstance(v, list):
        for i, x in enumerate(v):
            if x is not None:
                out.append(f"{path}[{i}]")
            out += walk(x, f"{path}[{i}]")
    return out


def leaves(v, path=""):
    if isinstance(v, dict):
        return [y for k, x in v.items() for y in leaves(x, path + ("." if path else "") + k)]
    if isinstance(v, list):
        return [y for i, x in enumerate(v) for y in leaves(x, f"{path}[{i}]")]
    return [] if v is None else [(path, v)]


@pytest.mark.parametrize("v", NESTED[:2] + NESTED[3:])
def test_shred_round_trip(v):
    cols = nested.shred(v)
    assert sorted(p for r in nested.elements(cols).values() for p, _, _ in r) == sorted(walk(v))
    assert nested.restore(cols) == sorted(leaves(v), key=lambda x: x[0])


def test_shred_random():
    r = random.Random(7)

    def make(d):
        k = r.random()
        if d == 0 or k < 0.3:
            return r.choice([None, 1, "x", True, 2.5])
        if k < 0.65:
            return [make(d - 1) for _ in range(r.randint(0, 3))]
        return {c: make(d - 1) for c in r.sample("abcd", r.randint(0, 3))}

    for _ in range(300):
        v = make(5)
        if isinstance(v, (dict, list)):
            cols = nested.shred(v)
            assert sorted(p for x in nested.elements(cols).values() for p, _, _ in x) == sorted(walk(v))
            assert nested.restore(cols) == sorted(leaves(v), key=lambda x: x[0])


def payloads(spark, data):
    return spark.createDataFrame(data, "source_node_id string, batch_id string, groq_output_json string, cognitive_map_json string, updated_at timestamp, node_path string")


def test_payload_rows(spark):
    from datetime import datetime

    t1, t2 = datetime(2031, 1, 1), datetime(2031, 1, 2)
    data = [
        ("s", "b", None, '{"a":[1]}', t2, "clash"), ("s", "b", None, '{"a":[1,2,3]}', t1, None), ("s", "b", None, '{"a":[1]}', t2, None),
        ("s2", "b", '{"x":[{"y":[null,"' + "z" * 100_000 + '"]}]}', '"{\\"q\\":[7]}"', None, None), ("s3", None, "{broken", "", t1, None), (None, None, "[1]", '"text"', t1, None), ("s4", "b", "[" * 20_000 + "]" * 20_000, "null", t1, None),
    ]
    got = rows(nested.element_paths(payloads(spark, data)))
    want = [("s", "b", "cognitive_map_json", "a[0]"), ("s2", "b", "cognitive_map_json", "q[0]"), ("s2", "b", "groq_output_json", "x[0]"), ("s2", "b", "groq_output_json", "x[0].y[1]"), (None, None, "groq_output_json", "[0]")]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert nested.element_paths(payloads(spark, [])).count() == 0
    flat = nested.flat_table(payloads(spark, data), "a[]", ["value"]).collect()
    assert [(r["node_path"], r["parent_path"], r["position"], r["value"]) for r in flat] == [("a[0]", "", 0, "1")]


def test_deep_nesting_is_kept(spark):
    from datetime import datetime

    deep = payloads(spark, [("s", "b", "[" * 2000 + "]" * 2000, None, datetime(2031, 1, 1), None)])
    got = {r["node_path"] for r in nested.element_paths(deep).collect()}
    assert len(got) == 1999 and "[0]" * 1999 in got


def test_parents_exist(spark):
    from datetime import datetime

    v = {"themes": [{"name": "t", "children": [{"name": "c", "aliases": ["a", None, "b"]}]}, None]}
    df = nested.flat_rows(payloads(spark, [("s", "b", None, json.dumps(v), datetime(2031, 1, 1), None)]))
    got = {r["node_path"]: r for r in df.collect()}
    assert set(got) == {"", "themes[0]", "themes[0].children[0]", "themes[0].children[0].aliases[0]", "themes[0].children[0].aliases[2]"}
    assert all(r["parent_path"] in got for p, r in got.items() if p)
    assert got["themes[0].children[0]"]["fields"] == {"name": '"c"'}


# ---- ledger, calls, sources, sinks ---------------------------------------------


def test_ledger(spark):
    e = spark.createDataFrame([("r", "a", "running", 1, None), ("r", "a", "failed", 2, "x" * 5000), ("r", "a", "running", 3, None), ("r", "a", "done", 4, None), ("r", "b", "failed", 5, "y" * 5000)], "run_id string, step_name string, status string, seq long, error string").withColumn("at", F.timestamp_seconds("seq"))
    s = {r["step_name"]: r for r in ledger.step_states(ledger.event(e)).collect()}
    assert (s["a"]["status"], s["a"]["error"], s["a"]["attempts"]) == ("done", None, 2) and len(s["b"]["error"]) == 4000
    assert rows(ledger.run_states(ledger.step_states(e)).select("status")) == [("failed",)]
    with pytest.raises(ValueError):
        ledger.one_profile(spark.createDataFrame([("1",), ("2",)], "id string"))
    with pytest.raises(ValueError):
        ledger.validate_plan({"x": 0}, 1)


def test_retry():
    calls, pauses = [], []

    def call(_):
        calls.append(1)
        return (429, "slow") if len(calls) < 3 else (200, "{}")

    assert responses.call_with_retry(call, {}, sleep=pauses.append)[:2] == (200, 3) and pauses == [1.5, 3.0]
    assert responses.call_with_retry(lambda _: (404, "no"), {}, sleep=pauses.append)[:2] == (404, 1)
    assert responses.call_with_retry(lambda _: (400, "json_validate_failed"), {}, sleep=pauses.append)[:2] == (400, 3)


def test_replay_and_normalise(spark):
    body = json.dumps({"choices": [{"message": {"content": json.dumps({"root": {"label": "L"}, "domains": [{"name": "Art"}]})}}]})
    batch = spark.createDataFrame([("1", [("user", "hi")]), ("2", [("user", "no")])], "id string, messages array<struct<role:string,content:string>>")
    got = {r["id"]: r for r in responses.complete(batch, responses.replay({"1": body}), pause=0).collect()}
    assert got["1"]["http_status"] == 200 and got["2"]["error"].startswith("HTTP 404")
    o = spark.createDataFrame([("1", "https://a/b-c", 200, "{}", got["1"]["assistant_content"], None), ("2", "https://a/", 200, "{}", "{oops", None), ("3", " ", 200, "{}", "{}", None), ("4", "https://a", 500, "{}", "{}", None)], "id string, canonical_url string, http_status int, parsed string, assistant_content string, raw_json string")
    n = {r["id"]: r for r in responses.normalise(o).collect()}
    assert set(n) == {"1", "2"} and n["2"]["normalize_warning"] == "json_loads_failed" and n["2"]["concepts"] == [] and n["1"]["name"] == "L"


def test_sources(spark, tmp_path):
    (tmp_path / "u.txt").write_text("\n  https://a/1\nHTTP://b/2\nftp://c\n[https://a](https://b)\nhttp://d\n")
    assert rows(readers.url_text(spark, str(tmp_path / "u.txt"))) == [("http://d",), ("https://a/1",)]
    p = spark.createDataFrame([(1, '{"urls":[],"items":["https://no"]}'), (2, '["https://a",{"url":5,"link":" https://b "},{"x":1}]'), (3, '{"urls":"x","data":["https://c"]}'), (4, "broken")], "k int, payload string")
    assert rows(readers.payload_urls(p)) == [(2, 0, "https://a"), (2, 1, "https://b"), (3, 0, "https://c")]
    (tmp_path / "c.csv").write_text('name,link,url\n"a ""q""\nb",https://l,https://u\n,,https://v\nhttps://w,,\n,,\n')
    assert rows(readers.csv_urls(spark, str(tmp_path / "c.csv"))) == [("https://l",), ("https://v",), ("https://w",)]
    (tmp_path / "d.csv").write_text("name,profile\nx,https://p\ny,z\n")
    assert rows(readers.csv_urls(spark, str(tmp_path / "d.csv"))) == [("https://p",)]
    assert rows(readers.id_list(spark, '["a"," ","b "]')) == [(0, "a"), (2, "b")]
    (tmp_path / "x.jsonl").write_text('{"id":"1"}\n\n{"id":"2"}\n')
    assert rows(readers.jsonl(spark, str(tmp_path / "x.jsonl"), "id string")) == [("1",), ("2",)]
    (tmp_path / "y.jsonl").write_text('{"id":"1"}\n{oops\n')
    with pytest.raises(Exception):
        readers.jsonl(spark, str(tmp_path / "y.jsonl"), "id string").collect()
    with pytest.raises(ValueError):
        readers.attach(spark, "a-b", {})
    h = spark.createDataFrame([("<html><head><meta property='og:title' content='A &amp; B'><title>T</title></head><body><p>One</p><script>x</script><p>Two</p></body></html>",)], "h string")
    r = h.select(readers.html_title(F.col("h")).alias("t"), readers.html_text(F.col("h")).alias("b")).first()
    assert r["t"] == "A &amp; B" and "One" in r["b"] and "x" not in r["b"].replace("T", "")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("1", 'a "q"', None, True)], "id string, t string, n string, b boolean")
    sinks.write_twins(df, str(tmp_path / "o"))
    assert rows(spark.read.json(str(tmp_path / "o.jsonl")).select("id", "t")) == [("1", 'a "q"')]
    assert df.select(sinks.csv_line([F.col("t"), F.col("n")])).first()[0] == '"a ""q""",""'
    new = spark.createDataFrame([("1", " auto "), ("2", "auto"), ("3", "auto")], "id string, body string")
    old = spark.createDataFrame([("1", f"mine\n{sinks.AUTO_MARK.strip()}\nold"), ("2", "all mine")], "id string, body string")
    got = {r["id"]: r["body"] for r in sinks.keep_header(new, old).collect()}
    assert got["1"].startswith("mine\n\n") and "old" not in got["1"] and got["2"].startswith("all mine\n\n") and got["3"].count("auto") == 1
    nodes = spark.createDataFrame([("b", "n1", "t", 0, 0, 1, 1, 0)], "board string, id string, text string, x int, y int, w int, h int, tier int")
    edges = spark.createDataFrame([], "board string, from_node string, to_node string, from_side string, to_side string, label string")
    assert json.loads(sinks.canvas(nodes, edges).first()["json"])["edges"] == []
    sinks.write_notes(new, str(tmp_path / "notes"))
    assert (tmp_path / "notes" / "2.md").read_text() == "auto"


def test_stream_equals_batch(spark, tmp_path):
    from threadloom.streaming import ingest

    for i, part in enumerate([[(1, 1, "a"), (2, 2, "b")], [(1, 5, "c")], [(1, 3, "late"), (3, 4, "d")]]):
        spark.createDataFrame(part, "k int, seq int, v string").coalesce(1).write.parquet(str(tmp_path / "in" / f"p{i}"))
    schema = "k int, seq int, v string"
    ingest.upsert_files(spark, str(tmp_path / "in" / "*"), schema, ["k"], "seq", str(tmp_path / "state"), str(tmp_path / "cp"))
    want = rows(merge.latest(spark.read.schema(schema).parquet(str(tmp_path / "in" / "*")), ["k"], [F.col("seq")]))
    assert rows(ingest.current(spark, str(tmp_path / "state"))) == want == [(1, 5, "c"), (2, 2, "b"), (3, 4, "d")]
    ingest.upsert_files(spark, str(tmp_path / "in" / "*"), schema, ["k"], "seq", str(tmp_path / "state"), str(tmp_path / "cp"))
    assert rows(ingest.current(spark, str(tmp_path / "state"))) == want


def test_a_batch_that_fails_half_way_leaves_the_state(spark, tmp_path, monkeypatch):
    from threadloom.streaming import ingest

    schema = "k int, seq int, v string"
    run = lambda: ingest.upsert_files(spark, str(tmp_path / "in" / "*"), schema, ["k"], "seq", str(tmp_path / "state"), str(tmp_path / "cp"), parts=4)
    spark.createDataFrame([(i, 1, "a") for i in range(20)], schema).coalesce(1).write.parquet(str(tmp_path / "in" / "p0"))
    assert ingest.current(spark, str(tmp_path / "state")) is None
    run()
    before = rows(ingest.current(spark, str(tmp_path / "state")))
    spark.createDataFrame([(3, 2, "b"), (50, 1, "c")], schema).coalesce(1).write.parquet(str(tmp_path / "in" / "p1"))
    publish = ingest.publish_text

    def broken(*_):
        raise OSError("lost while publishing")

    monkeypatch.setattr(ingest, "publish_text", broken)
    with pytest.raises(Exception, match="lost while publishing"):
        run()
    assert rows(ingest.current(spark, str(tmp_path / "state"))) == before
    monkeypatch.setattr(ingest, "publish_text", publish)
    run()
    after = rows(ingest.current(spark, str(tmp_path / "state")))
    assert set(after) == {(3, 2, "b"), (50, 1, "c")} | {r for r in before if r[0] != 3} and len(after) == 21
    folders = set(ingest.manifest(spark, str(tmp_path / "state")).values())
    assert len(folders) == 2  # untouched parts stay where they were


def test_a_state_that_cannot_be_read_is_an_error(spark, tmp_path):
    from threadloom.streaming import ingest

    (tmp_path / "state").mkdir()
    (tmp_path / "state" / "manifest-00000001.json").write_text(json.dumps({"0": str(tmp_path / "gone")}))
    with pytest.raises(Exception, match="gone"):
        ingest.current(spark, str(tmp_path / "state")).count()


def test_mirror(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    new = spark.createDataFrame([("b", 2), ("c", 3), ("c", 3), ("a", 9)], "id string, v int")
    state, counts = merge.mirror(old, new, ["id"])
    assert rows(state) == [("a", 9), ("b", 2), ("c", 3)]
    assert counts.first().asDict() == {"received": 4, "inserted": 1, "updated": 1, "unchanged": 1, "after": 3}
    assert merge.mirror(old.limit(0), new.limit(0), ["id"])[1].first()["received"] == 0


def test_running_over_a_heavy_first_column(spark):
    from threadloom.operators import selection

    df = spark.createDataFrame([(0, i, 2) for i in range(300)], "p int, i int, c int")
    got = selection.running(df, "c", [F.col("p"), F.col("i")]).orderBy("i").collect()
    assert [r["running"] for r in got] == [2 * (i + 1) for i in range(300)]
    assert [r["rank"] for r in selection.ranked(df, [F.desc("i")]).orderBy("i").collect()] == list(range(300, 0, -1))
    assert selection.ranked(df.limit(0), [F.col("i")]).count() == 0


def test_choices(spark):
    from threadloom.operators import selection

    assert [selection.row_limit(x) for x in (None, "", " 7 ", "0", "-3", "x")] == [None, None, 7, None, None, None]
    df = spark.createDataFrame([("Nice",), ("other",), ("",), (None,)], "s string")
    pick = lambda names, mode: [r[0] for r in df.select(selection.by_subreddit(F.col("s"), names, mode)).collect()]
    assert pick([], "include") == [True] * 4 and pick(["r/nice"], "include") == [True, False, False, False] and pick(["nice"], "exclude") == [False, True, True, True]


def test_components_of_a_long_chain(spark):
    n = 300
    nodes = spark.range(n).withColumnRenamed("id", "id")
    edges = spark.range(n - 1).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert graph.components(nodes, edges).select("component").distinct().count() == 1


def test_jaccard_against_brute_force(spark):
    import random

    r = random.Random(3)
    sets = {i: {r.randint(0, 60) for _ in range(r.randint(1, 25))} for i in range(60)} | {100: {1, 2, 3}, 101: {1, 2, 3}, 102: {1}}
    m = spark.createDataFrame([(i, x) for i, s in sets.items() for x in s] + [(None, 1), (1, None)], "set_id int, item int")
    for least in (0.1, 0.3, 0.7):
        got = {(x["a"], x["b"]) for x in graph.jaccard(m, least).collect()}
        same: dict = {}
        for i in sorted(sets):
            same.setdefault(frozenset(sets[i]), []).append(i)
        reps = [v[0] for v in same.values()]
        want = {(a, b) for a in reps for b in reps if a < b and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]) - 1e-12}
        want |= {(v[0], x) for v in same.values() for x in v[1:]}
        assert got == want


def test_checkpoint_folder_is_never_silently_local():
    from types import SimpleNamespace

    from threadloom import session

    none = SimpleNamespace(isDefined=lambda: False)
    conf = SimpleNamespace(get=lambda *_: None)
    sc = SimpleNamespace(_jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: none)), getConf=lambda: conf, master="spark://host:7077")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(SimpleNamespace(sparkContext=sc, conf=conf))


def test_a_broken_run_is_marked(spark, tmp_path):
    path = str(tmp_path / "run")
    with pytest.raises(KeyboardInterrupt), sinks.run_output(spark, path) as p:
        sinks.write_lines(spark.createDataFrame([("a",)], "value string"), p)
        raise KeyboardInterrupt
    assert not (tmp_path / "run").exists() and spark.read.text(f"{path}_incomplete").count() == 1
    with sinks.run_output(spark, path) as p:
        sinks.write_lines(spark.createDataFrame([("b",)], "value string"), p)
    assert spark.read.text(path).first()[0] == "b"


@pytest.mark.parametrize("names", [False, True])
def test_jaccard_over_blocks(spark, monkeypatch, names):
    monkeypatch.setattr(graph, "BLOCK_ITEMS", 100)
    monkeypatch.setattr(graph, "_STEP", 50)
    r = random.Random(6)
    sets = {i: frozenset(r.choices(range(40), [1 / (x + 1) for x in range(40)], k=r.randint(1, 8))) for i in range(90)}
    name = (lambda i: f"s{i:03}") if names else (lambda i: i)
    m = spark.createDataFrame([(name(i), name(x)) for i, s in sets.items() for x in s], "set_id string, item string" if names else "set_id long, item long")
    least_of = {}
    for i, s in sets.items():
        least_of.setdefault(s, i)
    want = {(name(a), name(b)): len(s & t) / len(s | t) for s, a in least_of.items() for t, b in least_of.items() if a < b and len(s & t) >= 0.3 * len(s | t)}
    want |= {(name(least_of[s]), name(i)): 1.0 for i, s in sets.items() if least_of[s] != i}
    assert {(x["a"], x["b"]): x["jaccard"] for x in graph.jaccard(m, 0.3).collect()} == pytest.approx(want)
    # as a forest: fewer pairs, the same components
    few = graph.jaccard(m, 0.3, forest=True).select("a", "b").collect()
    assert {tuple(x) for x in few} <= want.keys() and len(few) < len(want)
    nodes = m.select(F.col("set_id").alias("id")).distinct()
    few_schema = ", ".join(f"{c} {dict(m.dtypes)['set_id']}" for c in "ab")
    edges = lambda pairs: spark.createDataFrame(sorted(pairs), few_schema)
    assert rows(graph.components(nodes, edges(tuple(x) for x in few))) == rows(graph.components(nodes, edges(want)))


def test_jaccard_shuffles_no_candidates(spark):
    """An item in every set makes n * n / 2 candidates; they are counted inside a task."""
    m = spark.createDataFrame([(i, x) for i in range(60) for x in (0, i + 1, i + 2)], "set_id long, item long")
    pairs = graph.jaccard(m, 0.5)
    assert rows(pairs.select("a", "b")) == [(i, i + 1) for i in range(59)]
    assert "Join" not in pairs._jdf.queryExecution().executedPlan().toString()


def test_jaccard_of_copies_is_whole(spark):
    sets = {1: {1, 2, 3}, 2: {1, 2, 3}, 3: {1, 2, 3, 4}, 4: {1, 2, 3, 4}, 5: {3, 4}, 6: {9}, 7: {9}, 8: {9}, 9: {7, 8}}
    m = spark.createDataFrame([(i, x) for i, s in sets.items() for x in s], "set_id long, item long")
    got = {(x["a"], x["b"]): x["jaccard"] for x in graph.jaccard(m, 0.5, whole=True).collect()}
    assert got == pytest.approx({(a, b): len(s & t) / len(s | t) for a, s in sets.items() for b, t in sets.items() if a < b and len(s & t) >= 0.5 * len(s | t)})
    none = spark.createDataFrame([(1, 1), (2, 1), (2, 2)], "set_id long, item long")
    assert rows(graph.jaccard(none, 0.5, whole=True)) == [(1, 2, 0.5)]


def test_concept_notes_name_every_partner(spark, monkeypatch):
    """A copy of a name has the partners of the name, and every row of a repeated id counts."""
    from threadloom.plans import graph_queries

    concept = "array<struct<type:string,name:string,tier:int,confidence:double>>"
    rows_ = [("1", "s1", ["big data", "data big", "big data tools"]), ("1", "s1", ["graph theory"]), ("2", "s2", ["data big tools", "theory graph proofs"])]
    n = spark.createDataFrame([(i, s, [("Theme", x, 2, None) for x in names]) for i, s, names in rows_], f"id string, source_id string, concepts {concept}")
    monkeypatch.setattr(graph_queries, "_normalised", lambda *_: n)
    body = {b.split("\n# ")[1].split("\n")[0]: b.split("## Similar concepts")[1] for _, b in graph_queries.concept_notes(spark, "").collect()}
    names = [x for *_, r in rows_ for x in r]
    words = {x: set(x.split()) for x in names}
    assert body.keys() == set(names)
    for x in names:
        near = {y for y in names if y != x and len(words[x] & words[y]) >= 0.5 * len(words[x] | words[y])}
        assert {y for y in names if f"|{y}]]" in body[x]} == near


def _overview_of(spark, n_sources=14, n_names=24):
    """(edges both ways with ranks, tiers, placed, order, boxes) of random islands; many ranks tie."""
    r = random.Random(8)
    tier = {f"n{i:02}": r.choice([1, 2, 2, 3, 4]) for i in range(n_names)}
    pairs = [(a, b) for a in tier for b in tier if a < b and r.random() < 0.4]
    edges = [(x, y, r.choice([0.4, 0.5, 0.8]), r.randint(1, 3)) for a, b in pairs for x, y in ((a, b), (b, a))]
    strength = {}
    edges = [(a, b, strength.setdefault(frozenset((a, b)), s), k) for a, b, s, k in edges]
    sources = [f"s{i}" for i in range(n_sources)]
    placed = [(s, n, t, r.randint(0, 900), r.randint(0, 900)) for s in sources for n, t in tier.items() if r.random() < 0.5] + [(s, f"root::{s}", 0, 5, 5) for s in sources]
    frame = spark.createDataFrame
    placed = frame(placed, "source_id string, node_id string, tier int, x int, y int")
    order = frame(list(zip(r.sample(sources, n_sources), range(1, n_sources + 1))), "source_id string, pos long")
    return frame(edges, "a string, b string, strength double, pos int"), frame(list(tier.items()), "id string, tier int"), placed, order, layout.bounding_boxes(placed)


@pytest.mark.parametrize("block, step", [(8_000_000, 500_000), (100, 30)])
def test_overview_makes_relations_in_place(spark, monkeypatch, block, step):
    """Against relations that are listed, sorted and numbered one by one; only meetings are shuffled."""
    monkeypatch.setattr(layout, "BLOCK", block)
    monkeypatch.setattr(layout, "_STEP", step)
    edges, tiers, placed, order, boxes = _overview_of(spark)
    on_board = placed.select("source_id", F.col("node_id").alias("id"))
    laned = layout.lanes(graph.cross_relations(edges, on_board, tiers, 0.5), order)
    half, lists = layout.meetings(layout.linked(edges, tiers, 0.5), placed, order, boxes)
    n = layout.relation_counts(half)
    listed = [r["tier"] for r in laned.select("tier").collect()]
    assert n == {t: listed.count(t) for t in set(listed)} and half.count() < len(listed)
    top = layout.lane_starts(n)[2]
    assert top == laned.first()["islands_top"]
    islands = layout.islands(boxes, order, top)
    moved = placed.join(islands.select("source_id", "dy"), "source_id").select("source_id", "node_id", "tier", "x", (F.col("y") + F.col("dy")).alias("y"))
    want = layout.routed(laned, islands, moved)
    got = layout.routes(half, lists, order, islands, n)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_lanes_beyond_two_to_the_31(spark):
    box = spark.createDataFrame([("s", 0, 10, 100, 300)], "source_id string, min_x int, min_y int, max_r int, max_b int")
    order = spark.createDataFrame([("s", 1)], "source_id string, pos long")
    top = layout.lane_starts({3: 40_000_000})[2]
    assert top > 2**31
    got = layout.islands(box, order, top).first()
    assert (got["top"], got["bottom"], got["dy"]) == (top, top + 290, top - 10)
