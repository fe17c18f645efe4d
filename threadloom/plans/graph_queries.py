"""Queries over maps, graphs, similarity, boards and notes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.functions import cogmap, ids, text
from threadloom.operators import graph, layout, responses, selection
from threadloom.plans import sql
from threadloom.plans.registry import query
from threadloom.session import cut, table
from threadloom.sources import readers, sinks

_TOKENS = r"tok AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]{6,}')) AS name FROM documents)"


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    """Distinct words of six letters or more as concepts of each document."""
    t = table(spark, d, "documents").select("doc_id", F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"([\p{L}\p{N}_]{6,})"), 1).alias("w"))
    return t.select("doc_id", F.explode(F.array_distinct("w")).alias("name"))


@query("doc_freq", f"WITH {_TOKENS} SELECT name, count(DISTINCT doc_id) AS doc_freq FROM tok GROUP BY 1")
def doc_freq(spark: SparkSession, d: str) -> DataFrame:
    e = _tokens(spark, d).select(F.col("doc_id").alias("source_id"), F.col("name").alias("concept_id"))
    return graph.doc_freq(e).select(F.col("concept_id").alias("name"), "doc_freq")


@query("doc_freq_incremental", f"WITH {_TOKENS} SELECT name, count(DISTINCT doc_id) AS doc_freq FROM tok WHERE name IN (SELECT name FROM tok WHERE doc_id % 10 = 0) GROUP BY 1")
def doc_freq_incremental(spark: SparkSession, d: str) -> DataFrame:
    e = _tokens(spark, d).select(F.col("doc_id").alias("source_id"), F.col("name").alias("concept_id"))
    return graph.doc_freq(e, e.where("source_id % 10 = 0")).select(F.col("concept_id").alias("name"), "doc_freq")


@query(
    "top_concepts",
    f"WITH {_TOKENS} SELECT {sql.concept_id(chr(39) + 'concept' + chr(39), 'name')} AS concept_id, name, doc_freq FROM (SELECT name, count(DISTINCT doc_id) AS doc_freq FROM tok GROUP BY 1 ORDER BY doc_freq DESC, name LIMIT 500)",
)
def top_concepts(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: which concepts recur across most sources."""
    e = _tokens(spark, d).select(F.col("doc_id").alias("source_id"), F.col("name").alias("concept_id"))
    top = graph.doc_freq(e).orderBy(F.desc("doc_freq"), "concept_id").limit(500)
    return top.select(ids.concept_id(F.lit("concept"), F.col("concept_id")).alias("concept_id"), F.col("concept_id").alias("name"), "doc_freq")


@query("type_index_topn", "SELECT p_type AS kind, p_partkey AS id, rank FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY coalesce(n, 0) DESC, p_name, p_partkey) AS rank FROM part LEFT JOIN (SELECT l_partkey, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1) ON l_partkey = p_partkey) WHERE rank <= 20")
def type_index(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.countDistinct("l_orderkey").alias("n"))
    p = table(spark, d, "part").join(n, F.col("l_partkey") == F.col("p_partkey"), "left")
    return selection.top_per_group(p, ["p_type"], [F.desc(F.coalesce("n", F.lit(0))), F.col("p_name"), F.col("p_partkey")], 20).select(F.col("p_type").alias("kind"), F.col("p_partkey").alias("id"), "rank")


@query("sources_per_concept_200", f"WITH {_TOKENS} SELECT name, doc_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY doc_id) AS rank FROM tok) WHERE rank <= 200")
def sources_per_concept(spark: SparkSession, d: str) -> DataFrame:
    return selection.top_per_group(_tokens(spark, d), ["name"], [F.col("doc_id")], 200)


_KEYS = ["url", "post_url", "postUrl", "link", "href", "canonical_url", "canonicalUrl"]


@query(
    "json_key_precedence",
    "SELECT event_id, pos, u AS url FROM (SELECT event_id, 0 AS pos, 'https://a/' || event_id AS u FROM events UNION ALL SELECT event_id, 1, 'https://b/' || event_id FROM events UNION ALL SELECT event_id, 2, 'https://c/' || event_id FROM events WHERE event_id % 2 = 0)",
)
def json_key_precedence(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id").cast("string")
    third = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit(',{"url":" ","href":"https://c/'), i, F.lit('"}'))).otherwise(F.lit(',{"url":7}'))
    p = F.concat(F.lit('{"label":"x","items":["https://a/'), i, F.lit('",{"link":"https://no/","post_url":"https://b/'), i, F.lit('"}'), third, F.lit('],"data":["https://never/"]}'))
    return readers.payload_urls(table(spark, d, "events").select("event_id", p.alias("payload")))


OUT = "groq_batch_all_1776865759_outputs"
# parsed maps of the outputs as rows: level, tier, type, name, confidence
_MENTIONS = f"""o AS (SELECT DISTINCT id, canonical_url, parsed FROM {OUT} WHERE http_status IS NOT NULL AND http_status < 400 AND parsed IS NOT NULL AND trim(coalesce(canonical_url, '')) <> ''),
 m AS (SELECT id, 1 AS tier, 'Domain' AS kind, unnest(parsed.domains).name AS raw FROM o
 UNION ALL SELECT id, 2, 'Theme', x.name FROM (SELECT id, unnest(parsed.themes) AS x FROM o)
 UNION ALL SELECT id, 3, coalesce(x.type, 'Concept'), x.name FROM (SELECT id, unnest(parsed.concepts) AS x FROM o)
 UNION ALL SELECT id, 4, coalesce(x.type, 'Insight'), left(trim(x.text), 100) FROM (SELECT id, unnest(parsed.micro_insights) AS x FROM o)),
 c AS (SELECT id, tier, kind, {sql.concept_id('kind', 'raw')} AS concept_id FROM m)"""


def _normalised(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, OUT).select("id", "canonical_url", "http_status", "parsed")
    o = o.select("id", "canonical_url", "http_status", "parsed", F.to_json("parsed").alias("assistant_content"), F.lit(None).cast("string").alias("raw_json"))
    return responses.normalise(o)


@query("explode_concepts", f"WITH {_MENTIONS} SELECT id, tier, kind, concept_id, count(*) AS n FROM c WHERE concept_id IS NOT NULL GROUP BY ALL")
def explode_concepts(spark: SparkSession, d: str) -> DataFrame:
    n = _normalised(spark, d).select("id", "concepts").distinct()
    m = n.select("id", F.explode("concepts").alias("c"))
    return m.groupBy("id", F.col("c.tier").alias("tier"), F.col("c.type").alias("kind"), ids.concept_id(F.col("c.type"), F.col("c.name")).alias("concept_id")).agg(F.count("*").alias("n"))


@query("concept_doc_freq", f"WITH {_MENTIONS} SELECT concept_id, count(DISTINCT id) AS doc_freq FROM c WHERE concept_id IS NOT NULL GROUP BY 1")
def concept_doc_freq(spark: SparkSession, d: str) -> DataFrame:
    n = _normalised(spark, d).select("id", F.explode("concepts").alias("c"))
    e = n.select(F.col("id").alias("source_id"), ids.concept_id(F.col("c.type"), F.col("c.name")).alias("concept_id"))
    return graph.doc_freq(e)


@query("default_fill", f"SELECT id, coalesce(parsed.root.label, '') AS label, coalesce(parsed.root.intellectual_need, 'Learn') AS need, coalesce(len(parsed.domains), 0) AS domains, coalesce(len(parsed.micro_insights), 0) AS micros, coalesce(parsed.quality_flags.content_thin, false) AS thin FROM (SELECT DISTINCT id, parsed FROM {OUT} WHERE http_status < 400 AND parsed IS NOT NULL)")
def default_fill(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, OUT).where(cogmap.succeeded(F.col("http_status"), F.col("parsed"))).select("id", F.to_json("parsed").alias("t")).distinct()
    f = o.select("id", cogmap.filled(cogmap.parse(F.col("t"))).alias("m"))
    return f.select("id", "m.root.label", "m.root.need", F.size("m.domains").alias("domains"), F.size("m.micro_insights").alias("micros"), F.col("m.quality_flags.content_thin").alias("thin"))


@query("answer_parse_states", f"SELECT id, CASE WHEN trim(coalesce(t, ''), ' \t\n\r') = '' THEN 'missing_assistant_content' WHEN json_valid(t) THEN 'ok' ELSE 'json_loads_failed' END AS state FROM (SELECT DISTINCT id, CASE WHEN trim(coalesce(assistant_content, ''), ' \t\n\r') <> '' THEN assistant_content ELSE raw.choices[1].message.content END AS t FROM {OUT})")
def answer_parse_states(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, OUT).select("id", cogmap.assistant_text(F.col("assistant_content"), F.to_json("raw")).alias("t")).distinct()
    return o.select("id", cogmap.parse_state(F.col("t")).alias("state"))


@query("embedding_l2", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 6) AS norm2, round(embedding[1]::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS first FROM embeddings")
def embedding_l2(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", "embedding", graph.l2(F.col("embedding")).alias("u"))
    n = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return e.select("vec_id", F.round(n, 6).alias("norm2"), F.round(F.col("u")[0], 6).alias("first"))


_SIM = "s AS (SELECT a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS sim FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id{extra}), r AS (SELECT a, b, round(sim, 6) AS strength, row_number() OVER (PARTITION BY a ORDER BY round(sim, 6) DESC, b) AS rank FROM s WHERE sim >= {least})"


@query("cosine_topk", f"WITH {_SIM.format(extra=' AND a.vec_id % 100 = 0', least=0.25)} SELECT a, b, strength, rank FROM r WHERE rank <= 8")
def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return graph.cosine_edges(e.where("id % 100 = 0"), e, 8, 0.25)


_CLASSES = "s AS (SELECT set_id, list_sort(list(DISTINCT item)) AS items FROM m GROUP BY 1), cl AS (SELECT items, min(set_id) AS rep FROM s GROUP BY 1), rep AS (SELECT rep AS set_id, items FROM cl), u AS (SELECT set_id, unnest(items) AS item FROM rep), p AS (SELECT x.set_id AS a, y.set_id AS b, count(*) AS c FROM u x JOIN u y ON x.item = y.item AND x.set_id < y.set_id GROUP BY 1, 2), j AS (SELECT a, b, c / (len(ra.items) + len(rb.items) - c) AS jaccard FROM p JOIN rep ra ON ra.set_id = a JOIN rep rb ON rb.set_id = b UNION ALL SELECT rep, set_id, 1.0 FROM s JOIN cl USING (items) WHERE set_id <> rep)"
_SETS = f"{_MENTIONS}, ms AS (SELECT DISTINCT id AS set_id, concept_id AS item FROM c WHERE concept_id IS NOT NULL)"


def _sets(spark: SparkSession, d: str) -> DataFrame:
    n = _normalised(spark, d).select(F.col("id").alias("set_id"), F.explode("concepts").alias("c"))
    return n.select("set_id", ids.concept_id(F.col("c.type"), F.col("c.name")).alias("item")).distinct()


@query("similarity_components", f"WITH RECURSIVE {_SETS}, {_CLASSES.replace('FROM m ', 'FROM ms ')}, e AS (SELECT a, b FROM j WHERE jaccard >= 0.1 UNION SELECT b, a FROM j WHERE jaccard >= 0.1), w(id, c) AS (SELECT DISTINCT set_id, set_id FROM ms UNION SELECT e.b, w.c FROM w JOIN e ON e.a = w.id) SELECT id, min(c) AS component FROM w GROUP BY 1")
def similarity_components(spark: SparkSession, d: str) -> DataFrame:
    """Sources clustered by the concepts they share."""
    m = cut(_sets(spark, d))
    return graph.components(m.select(F.col("set_id").alias("id")).distinct(), graph.jaccard(m, 0.1, forest=True).select("a", "b"))


@query("related_names", f"WITH {_SIM.format(extra=' AND a.vec_id % 100 = 0', least=0.3)} SELECT a, 'node ' || b AS name, strength, rank FROM r WHERE rank <= 10")
def related_names(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    names = e.select(F.col("id").alias("b"), F.concat(F.lit("node "), F.col("id").cast("string")).alias("name"))
    return graph.cosine_edges(e.where("id % 100 = 0"), e, 10, 0.3).join(names, "b").select("a", "name", "strength", "rank")


_MEMBERS = "m AS (SELECT DISTINCT l_suppkey AS set_id, l_partkey AS item FROM lineitem)"


@query("jaccard_pairs", f"WITH {_MEMBERS}, {_CLASSES} SELECT a, b, round(jaccard, 9) AS jaccard FROM j WHERE jaccard >= 0.15 - 1e-12")
def jaccard_pairs(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("set_id"), F.col("l_partkey").alias("item"))
    return graph.jaccard(m, 0.15).withColumn("jaccard", F.round("jaccard", 9))


@query("membership_lists", f"WITH {_MEMBERS} SELECT item AS id, sha1(array_to_string(list_sort(list(set_id)), ',')) AS sources FROM m GROUP BY 1")
def membership_lists(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("source_id"), F.col("l_partkey").alias("id"))
    return graph.membership(m).select("id", F.sha1(F.array_join("sources", ",")).alias("sources"))


_WORDS = r"list_distinct(list_filter(string_split(regexp_replace(lower(coalesce({0}, '')), '[^\p{{L}}\p{{N}}_]+', ' ', 'g'), ' '), lambda w: w <> ''))"


@query(
    "token_overlap_parent",
    f"WITH k AS (SELECT DISTINCT id, parsed FROM {OUT} WHERE parsed IS NOT NULL), p AS (SELECT id, unnest(parsed.themes).name AS name, generate_subscripts(parsed.themes, 1) - 1 AS pos FROM k), c AS (SELECT DISTINCT id, x.name AS child FROM (SELECT id, unnest(parsed.concepts) AS x FROM k)),"
    f" j AS (SELECT c.id, child, p.name, pos, {_WORDS.format('child')} AS ct, {_WORDS.format('p.name')} AS pt FROM c JOIN p ON c.id = p.id), s AS (SELECT *, len(list_intersect(ct, pt)) / greatest(len(list_distinct(ct || pt)), 1) AS score FROM j)"
    " SELECT id AS source_id, child AS child_id, arg_max(name, {'s': score, 'p': -pos}) AS parent_id FROM s GROUP BY 1, 2",
)
def token_overlap_parent(spark: SparkSession, d: str) -> DataFrame:
    k = table(spark, d, OUT).where("parsed is not null").select("id", "parsed").distinct()
    p = k.select(F.col("id").alias("source_id"), F.posexplode("parsed.themes").alias("pos", "x")).select("source_id", F.col("x.name").alias("parent_id"), F.col("x.name").alias("name"), "pos")
    c = k.select(F.col("id").alias("source_id"), F.explode("parsed.concepts").alias("x")).select("source_id", F.col("x.name").alias("child_id"), F.col("x.name").alias("name")).distinct()
    return graph.infer_parents(c, p)


@query(
    "cross_source_relations",
    f"WITH {_SIM.format(extra=' AND a.vec_id % 100 = 0', least=0.2)}, e AS (SELECT a, b, strength FROM r WHERE rank <= 30), x AS (SELECT a % 7 AS a_source, a, b % 7 AS b_source, b, a % 2 + 1 AS tier, strength FROM e WHERE a % 2 = b % 2 AND a % 7 <> b % 7)"
    " SELECT least(a, b) AS lo, greatest(a, b) AS hi, tier, max(strength) AS strength FROM x GROUP BY 1, 2, 3",
)
def cross_source_relations(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    edges = graph.cosine_edges(e.where("id % 100 = 0"), e, 30, 0.2).withColumn("pos", F.col("rank"))
    m = e.select((F.col("id") % 7).alias("source_id"), "id")
    t = e.select("id", (F.col("id") % 2 + 1).cast("int").alias("tier"))
    r = graph.cross_relations(edges, m, t, 0.2)
    return r.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"), F.col("tier").cast("long").alias("tier"), "strength")


@query("concept_ring", f"WITH {_SIM.format(extra=' AND a.vec_id % 100 = 0', least=0.25)}, e AS (SELECT a, b, strength, rank - 1 AS slot FROM r WHERE rank <= 12), n AS (SELECT *, count(*) OVER (PARTITION BY a) AS n FROM e) SELECT a, b, slot, CAST(trunc(1200 + 360 * cos(-pi() / 2 + 2 * pi() * slot / n)) AS INTEGER) AS x, CAST(trunc(1200 + 360 * sin(-pi() / 2 + 2 * pi() * slot / n)) AS INTEGER) AS y FROM n")
def concept_ring(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return layout.ring(graph.cosine_edges(e.where("id % 100 = 0"), e, 12, 0.25)).select("a", "b", F.col("slot").cast("long").alias("slot"), "x", "y")


_SITES = {"x": text.X_LINES, "linkedin": text.LINKEDIN_LINES, "reddit": text.REDDIT_LINES}


@query("tree_widths", "SELECT n_regionkey, max(w) AS widest, sum(w) + 420 * (count(*) - 1) AS total FROM (SELECT n_regionkey, n_nationkey, 320 + 80 * count(c_custkey) AS w FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2) GROUP BY 1")
def tree_widths(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").join(table(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    w = n.groupBy("n_regionkey", "n_nationkey").agg((320 + 80 * F.count("c_custkey")).alias("w"))
    return w.groupBy("n_regionkey").agg(F.max("w").alias("widest"), (F.sum("w") + layout.GAP[3] * (F.count("*") - 1)).alias("total"))


def map_nodes(spark: SparkSession, d: str) -> DataFrame:
    """source_id, node_id, name, tier, pos, parent_id of every map of the outputs, parents by token overlap."""
    k = table(spark, d, OUT).where("parsed is not null").select("id", "parsed")
    level = lambda key, tier, f: F.transform(F.col(f"parsed.{key}"), lambda x, i: F.struct(F.lit(tier).alias("tier"), i.alias("pos"), x[f].alias("name")))
    lists = [F.coalesce(level(k, t, f), F.array().cast("array<struct<tier:int,pos:int,name:string>>")) for k, t, f in (("domains", 1, "name"), ("themes", 2, "name"), ("concepts", 3, "name"), ("micro_insights", 4, "text"))]
    x = k.select(F.col("id").alias("source_id"), F.explode(F.concat(*lists)).alias("x")).select("source_id", "x.*").where(ids.concept_name(F.col("name")) != "")
    x = x.withColumn("node_id", F.concat(F.lit("t"), F.col("tier").cast("string"), F.lit("_"), F.left(F.sha1("name"), F.lit(12))))
    n = cut(x.groupBy("source_id", "node_id").agg(F.min("tier").alias("tier"), F.min_by("name", "pos").alias("name"), F.min("pos").alias("pos")))
    p = graph.infer_parents(n.select("source_id", "tier", F.col("node_id").alias("child_id"), "name"), n.select("source_id", (F.col("tier") + 1).alias("tier"), F.col("node_id").alias("parent_id"), "name", "pos"), ["source_id", "tier"])
    return n.join(p.select("source_id", F.col("child_id").alias("node_id"), "parent_id"), ["source_id", "node_id"], "left")


@query("source_boards")
def source_boards(spark: SparkSession, d: str) -> DataFrame:
    return layout.source_boards(map_nodes(spark, d))


@query("board_boxes")
def board_boxes(spark: SparkSession, d: str) -> DataFrame:
    return layout.bounding_boxes(layout.source_boards(map_nodes(spark, d)))


def _alike(nodes: DataFrame, least: float) -> DataFrame:
    """(a, b, strength, rank): nodes (id, name) by the words of their names, both ways; names of the same words are alike to all that one of them is."""
    words = nodes.select(F.col("id").alias("set_id"), F.explode(text.tokens(F.col("name"))).alias("item"))
    j = graph.jaccard(words, least, whole=True).select("a", "b", F.round("jaccard", 6).alias("strength"))
    both = j.unionByName(j.select(F.col("b").alias("a"), F.col("a").alias("b"), "strength"))
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("strength"), "b")))


def _clusters(m: DataFrame) -> DataFrame:
    """Sources clustered by the nodes they share (Jaccard of at least the overview's threshold)."""
    sets = m.select(F.col("source_id").alias("set_id"), F.col("node_id").alias("item"))
    return graph.components(m.select(F.col("source_id").alias("id")).distinct(), graph.jaccard(sets, layout.OVERVIEW["threshold"], forest=True).select("a", "b"))


def _overview(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, dict[int, int]]:
    """(islands, order, meetings, islands of the nodes, relations by tier) of the overview."""
    m = cut(map_nodes(spark, d))
    placed = cut(layout.source_boards(m))
    boxes = cut(layout.bounding_boxes(placed))
    order = cut(layout.cluster_order(_clusters(m)))
    nodes = m.groupBy(F.col("node_id").alias("id")).agg(F.min("name").alias("name"), F.min("tier").alias("tier"))
    # half of the words in common: a measure of its own, so not the threshold for cosines
    edges = _alike(nodes.select("id", "name"), 0.5).withColumn("pos", F.col("rank"))
    half, lists = layout.meetings(cut(layout.linked(edges, nodes.select("id", "tier"), 0.5)), placed, order, boxes)
    n = layout.relation_counts(half)
    return cut(layout.islands(boxes, order, layout.lane_starts(n)[2])), order, half, lists, n


@query("overview_islands")
def overview_islands(spark: SparkSession, d: str) -> DataFrame:
    """Boxes of the sources side by side, larger clusters first."""
    return _overview(spark, d)[0]


@query("overview_routes")
def overview_routes(spark: SparkSession, d: str) -> DataFrame:
    """The relations between islands as edges by way of ports and lanes."""
    boxes, order, half, lists, n = _overview(spark, d)
    return layout.routes(half, lists, order, boxes, n)


_NODES = f"""k AS (SELECT id, parsed FROM {OUT} WHERE parsed IS NOT NULL),
 l AS (SELECT id, unnest(list_distinct(list_filter(coalesce(list_transform(parsed.domains, lambda x: x.name), []) || coalesce(list_transform(parsed.themes, lambda x: x.name), []) || coalesce(list_transform(parsed.concepts, lambda x: x.name), []) || coalesce(list_transform(parsed.micro_insights, lambda x: x.text), []), lambda x: {sql.strip('x')} <> ''))) AS name FROM k)"""


@query("source_clusters", f"""WITH RECURSIVE {_NODES}, m AS (SELECT DISTINCT id AS set_id, name AS item FROM l), {_CLASSES}, e AS (SELECT a, b FROM j WHERE jaccard >= 0.3 - 1e-12 UNION SELECT b, a FROM j WHERE jaccard >= 0.3 - 1e-12),
 w(id, c) AS (SELECT DISTINCT set_id, set_id FROM m UNION SELECT e.b, w.c FROM w JOIN e ON e.a = w.id), q AS (SELECT id, min(c) AS component FROM w GROUP BY 1), z AS (SELECT *, count(*) OVER (PARTITION BY component) AS n FROM q) SELECT id AS source_id, row_number() OVER (ORDER BY n DESC, component, id) AS pos FROM z""")
def source_clusters(spark: SparkSession, d: str) -> DataFrame:
    """The order of the islands: clusters of sources by size, then by member."""
    k = table(spark, d, OUT).where("parsed is not null").select("id", "parsed")
    levels = [F.transform("parsed.domains", lambda x: x["name"]), F.transform("parsed.themes", lambda x: x["name"]), F.transform("parsed.concepts", lambda x: x["name"]), F.transform("parsed.micro_insights", lambda x: x["text"])]
    names = F.concat(*(F.coalesce(x, F.array().cast("array<string>")) for x in levels))
    m = k.select(F.col("id").alias("source_id"), F.explode(names).alias("node_id")).where(ids.concept_name(F.col("node_id")) != "").distinct()
    return layout.cluster_order(_clusters(cut(m)))


@query("canvas_json")
def canvas_json(spark: SparkSession, d: str) -> DataFrame:
    m = map_nodes(spark, d)
    b = cut(layout.source_boards(m))
    names = m.select("source_id", "node_id", "name")
    n = b.join(names, ["source_id", "node_id"], "left")
    w, h = layout.box_size(F.col("tier"))
    nodes = n.select(F.col("source_id").alias("board"), F.col("node_id").alias("id"), F.concat(F.lit("# "), F.coalesce(text.shorten(F.col("name")), F.lit("root"))).alias("text"), "x", "y", w.alias("w"), h.alias("h"), "tier")
    up = b.select(F.col("source_id"), F.col("node_id").alias("parent_id"), F.col("x").alias("px"), F.col("y").alias("py"))
    e = b.where("parent_id is not null").join(up, ["source_id", "parent_id"])
    s = layout.side(F.col("px"), F.col("py"), F.col("x"), F.col("y"))
    opposite = F.element_at(F.create_map(F.lit("top"), F.lit("bottom"), F.lit("bottom"), F.lit("top"), F.lit("left"), F.lit("right"), F.lit("right"), F.lit("left")), s)
    edges = e.select(F.col("source_id").alias("board"), F.col("parent_id").alias("from_node"), F.col("node_id").alias("to_node"), s.alias("from_side"), opposite.alias("to_side"), F.lit("contains").alias("label"))
    return sinks.canvas(nodes, edges)


@query("markdown_notes")
def markdown_notes(spark: SparkSession, d: str) -> DataFrame:
    n = _normalised(spark, d).dropDuplicates(["id"])
    src = n.select(F.col("source_id").alias("id"), F.col("canonical_url").alias("url"), "name", F.lit("batch").alias("batch_id")).dropDuplicates(["id"])
    m = responses.mentions(n).select(F.col("source_id").alias("id"), F.col("concept_id").alias("stem"), "name", F.col("concept_type").alias("kind"), "tier", "confidence").dropDuplicates(["id", "stem"])
    e = _source_edges(spark, d)
    rel = e.join(src.select(F.col("id").alias("b"), "name"), "b").select(F.col("a").alias("id"), F.col("b").alias("stem"), "name", "strength")
    return sinks.source_notes(src, m, rel)


def _source_edges(spark: SparkSession, d: str, k: int = 8, least: float = 0.55) -> DataFrame:
    """(a, b, strength, rank): the most similar sources by their newest vectors of one model."""
    v = table(spark, d, "source_embeddings")
    v = v.join(F.broadcast(v.agg(F.max("model").alias("model"))), "model")  # one row
    v = v.groupBy(F.col("node_id").alias("id")).agg(F.max_by("embedding_json", F.struct("updated_at", "embedding_json")).alias("t")).select("id", F.from_json("t", "array<double>").alias("v"))
    v = v.where((F.size("v") == 128) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0))
    v = cut(v)
    return graph.cosine_edges(v, v, k, least)


def _concepts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Concept nodes (first name, kind and tier win) with their frequency, and all mentions."""
    m = cut(responses.mentions(_normalised(spark, d)))
    freq = graph.doc_freq(m).withColumnRenamed("concept_id", "id")
    first = m.groupBy(F.col("concept_id").alias("id")).agg(F.min("tier").alias("tier"), F.min("name").alias("name"), F.min("concept_type").alias("kind"))
    return first.join(freq, "id").withColumn("stem", F.concat(F.lit("concept - "), text.slug(F.col("name")), F.lit(" - "), text.tail8(F.col("id")))), m


@query("concept_notes")
def concept_notes(spark: SparkSession, d: str) -> DataFrame:
    c, m = _concepts(spark, d)
    src = m.select(F.col("concept_id").alias("id"), F.col("source_id").alias("stem"), F.col("source_id").alias("title"), F.crc32("source_id").alias("pos")).distinct()
    e = _alike(c.select("id", "name"), 0.5).where("rank <= 10")
    near = e.join(c.select(F.col("id").alias("b"), "stem", "name"), "b").select(F.col("a").alias("id"), "stem", "name", "strength")
    return sinks.concept_notes(c, src, near)


@query("map_pages")
def map_pages(spark: SparkSession, d: str) -> DataFrame:
    """The index pages: top concepts, one per type, sources."""
    c, m = _concepts(spark, d)
    s = m.select(F.col("source_id").alias("stem"), F.col("source_id").alias("title"), F.crc32("source_id").alias("pos")).distinct()
    return sinks.top_page(c).unionByName(sinks.index_pages(c)).unionByName(sinks.sources_page(s))
