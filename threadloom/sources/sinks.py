"""Sinks: JSONL and CSV twins, notes, maps, boards, exports. Each builds rows; writing is Spark's."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.functions.cogmap import bullets
from threadloom.functions.text import yaml_quote
from threadloom.session import exists, rename

# The mark below which a note is rewritten; note and board texts.
AUTO_MARK = "\n<!-- AUTO-GENERATED BELOW -->\n"
NOTE_PROMPT = "(Write your notes here)"
CANVAS_COLORS = {0: "1", 1: "2", 2: "3", 3: "4", 4: "5"}


def batch_lines(rows: DataFrame, order: list[Column]) -> DataFrame:
    """(value): one request per line in queue order."""
    return rows.orderBy(*order).select(F.to_json(F.struct("id", "canonical_url", "source", "status", "max_completion_tokens", F.round("estimated_cost_usd", 6).alias("estimated_cost_usd"), "content_mode", "messages")).alias("value"))


def write_lines(df: DataFrame, path: str) -> None:
    df.select("value").write.mode("overwrite").text(path)


def write_twins(df: DataFrame, path: str) -> None:
    """The same rows as JSONL and as quoted CSV; nested columns as JSON text in the CSV."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}.jsonl")
    flat = [F.to_json(c).alias(c) if t.startswith(("struct", "array", "map")) else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.mode("overwrite").csv(f"{path}.csv", header=True, quoteAll=True, escape='"')


def write_normalised(df: DataFrame, path: str) -> None:
    """Normalised outputs, one JSON object a line."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


@contextmanager
def run_output(spark: SparkSession, path: str):
    """The folder of a run's output; if the run is broken off it is renamed to ``path_incomplete``, so it never passes for a whole one."""
    try:
        yield path
    except BaseException:
        if exists(spark, path):
            rename(spark, path, f"{path}_incomplete")
        raise


def html_row(columns: list[Column]) -> Column:
    """A table row; text is escaped, null is an empty cell."""
    out = [F.lit("<tr>")]
    for c in columns:
        cell = F.coalesce(c.cast("string"), F.lit(""))
        for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            cell = F.replace(cell, F.lit(a), F.lit(b))
        out += [F.lit("<td>"), cell, F.lit("</td>")]
    return F.concat(*out, F.lit("</tr>"))


def csv_line(columns: list[Column]) -> Column:
    """A CSV line with doubled quotes; null as an empty quoted cell, booleans bare."""
    cell = lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    return F.concat_ws(",", *(cell(c) for c in columns))


def front_matter(fields: dict[str, Column]) -> Column:
    return F.concat(F.lit("---\n"), F.concat_ws("\n", *(F.concat(F.lit(f"{k}: "), yaml_quote(v.cast("string"))) for k, v in fields.items())), F.lit("\n---\n"))


def wikilink(stem: Column, shown: Column) -> Column:
    s = F.trim(F.coalesce(shown, F.lit("")))
    return F.when((s != "") & (s != stem), F.concat(F.lit("[["), stem, F.lit("|"), s, F.lit("]]"))).otherwise(F.concat(F.lit("[["), stem, F.lit("]]")))


def map_section(levels: dict[str, Column]) -> Column:
    """The levels of a map as bullets; empty ones say (None)."""
    part = lambda k, v: F.concat(F.lit(f"### {k}\n\n"), F.when(F.size(v) > 0, bullets(v)).otherwise("(None)"), F.lit("\n"))
    return F.concat(F.lit("## Cognitive map\n\n"), F.concat_ws("\n", *(part(k, v) for k, v in levels.items())))


def source_notes(sources: DataFrame, mentions: DataFrame, related: DataFrame) -> DataFrame:
    """(id, body): sources id, url, name, batch_id; mentions id, stem, name, kind, tier, confidence; related id, stem, name, strength."""
    conf = F.when(F.col("confidence").isNotNull(), F.format_string("%.2f", "confidence")).otherwise("unknown")
    m = mentions.select("id", F.struct("tier", "name", F.concat(F.lit("- "), wikilink(F.col("stem"), F.col("name")), F.lit(" - "), F.col("kind"), F.lit(", tier "), F.col("tier").cast("string"), F.lit(", confidence "), conf).alias("line")).alias("x"))
    m = m.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n").alias("mentioned"))
    r = related.select("id", F.struct((-F.col("strength")).alias("o"), "stem", F.concat(F.lit("- "), wikilink(F.col("stem"), F.col("name")), F.lit(" ("), F.format_string("%.3f", "strength"), F.lit(")")).alias("line")).alias("x"))
    r = r.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n").alias("related"))
    d = sources.join(m, "id", "left").join(r, "id", "left")
    body = F.concat(
        front_matter({"kind": F.lit("source"), "source_node_id": F.col("id"), "canonical_url": F.col("url"), "title": F.col("name"), "batch_id": F.coalesce("batch_id", F.lit(""))}),
        F.lit("# "), F.coalesce("name", "url"), F.lit("\n\n- URL: "), F.coalesce("url", F.lit("")), F.lit("\n\n## My notes\n\n"), F.lit(NOTE_PROMPT),
        F.lit("\n\n## Mentioned concepts\n\n"), F.coalesce("mentioned", F.lit("(None)")), F.lit("\n\n## Related sources\n\n"), F.coalesce("related", F.lit("(None)")), F.lit("\n"),
    )
    return d.select("id", body.alias("body"))


def index_pages(concepts: DataFrame, per_page: int = 500) -> DataFrame:
    """(page, body): the first concepts of each type by frequency and name. concepts: id, stem, name, kind, tier, doc_freq."""
    w = Window.partitionBy("kind").orderBy(F.desc(F.coalesce("doc_freq", F.lit(0))), "name", "id")
    top = concepts.withColumn("n", F.row_number().over(w)).where(F.col("n") <= per_page)
    line = F.concat(F.lit("- "), wikilink(F.col("stem"), F.col("name")), F.lit(" - tier "), F.col("tier").cast("string"), F.lit(", doc_freq "), F.coalesce("doc_freq", F.lit(0)).cast("string"))
    g = top.groupBy("kind").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", line.alias("line")))), lambda x: x["line"]), "\n").alias("lines"))
    return g.select(F.concat("kind", F.lit(" Index")).alias("page"), F.concat(front_matter({"kind": F.lit("map"), "map": F.lit("concept_type"), "concept_type": F.col("kind")}), F.lit("# "), F.col("kind"), F.lit(" index\n\n"), F.col("lines"), F.lit("\n")).alias("body"))


def concept_notes(concepts: DataFrame, sources: DataFrame, similar: DataFrame, most_sources: int = 200) -> DataFrame:
    """(id, body): concepts id, name, kind, tier, doc_freq; sources id, stem, title, pos; similar id, stem, name, strength.

    The first sources of a concept by position are listed, so a concept of very
    many sources stays a note; the rank filter is pushed before the shuffle.
    """
    w = Window.partitionBy("id").orderBy("pos", "stem")
    s = sources.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most_sources)
    s = s.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", F.concat(F.lit("- "), wikilink(F.col("stem"), F.col("title"))).alias("line")))), lambda x: x["line"]), "\n").alias("found"))
    r = similar.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("strength")).alias("o"), F.concat(F.lit("- "), wikilink(F.col("stem"), F.col("name")), F.lit(" ("), F.format_string("%.3f", "strength"), F.lit(")")).alias("line")))), lambda x: x["line"]), "\n").alias("near"))
    d = concepts.join(s, "id", "left").join(r, "id", "left")
    body = F.concat(
        front_matter({"kind": F.lit("concept"), "concept_node_id": F.col("id"), "concept_type": F.col("kind"), "tier": F.col("tier"), "doc_freq": F.coalesce("doc_freq", F.lit(0))}),
        F.lit("# "), F.col("name"), F.lit("\n\n## My notes\n\n"), F.lit(NOTE_PROMPT), F.lit("\n\n## Sources\n\n"), F.coalesce("found", F.lit("(None)")), F.lit("\n\n## Similar concepts\n\n"), F.coalesce("near", F.lit("(None)")), F.lit("\n"),
    )
    return d.select("id", body.alias("body"))


def top_page(concepts: DataFrame, most: int = 500) -> DataFrame:
    """(page, body): the most frequent concepts; concepts: stem, name, kind, tier, doc_freq."""
    top = concepts.orderBy(F.desc("doc_freq"), "tier", "name", "stem").limit(most)
    line = F.concat(F.lit("- "), wikilink(F.col("stem"), F.col("name")), F.lit(" - "), F.col("kind"), F.lit(", tier "), F.col("tier").cast("string"), F.lit(", doc_freq "), F.col("doc_freq").cast("string"))
    g = top.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("doc_freq")).alias("o"), "tier", "name", "stem", line.alias("line")))), lambda x: x["line"]), "\n").alias("lines"))
    return g.select(F.lit("Top Concepts").alias("page"), F.concat(front_matter({"kind": F.lit("map"), "map": F.lit("top_concepts")}), F.lit("# Top concepts (by frequency)\n\n"), F.coalesce(F.nullif("lines", F.lit("")), F.lit("(None)")), F.lit("\n")).alias("body"))


def sources_page(sources: DataFrame, most: int = 5_000) -> DataFrame:
    """(page, body): the first sources by node number; sources: pos, stem, title."""
    first = sources.orderBy("pos", "stem").limit(most)
    g = first.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "stem", F.concat(F.lit("- "), wikilink(F.col("stem"), F.col("title"))).alias("line")))), lambda x: x["line"]), "\n").alias("lines"))
    return g.select(F.lit("Sources Index").alias("page"), F.concat(front_matter({"kind": F.lit("map"), "map": F.lit("sources")}), F.lit("# Sources index\n\n"), F.coalesce(F.nullif("lines", F.lit("")), F.lit("(None)")), F.lit("\n")).alias("body"))


def keep_header(new: DataFrame, old: DataFrame) -> DataFrame:
    """New bodies below what users wrote above the mark; a note without the mark is kept whole. (id, body)."""
    o = old.select("id", F.col("body").alias("_old"))
    mark = F.trim(F.lit(AUTO_MARK.strip()))
    at = F.locate(AUTO_MARK.strip(), F.col("_old"))
    head = F.when(at > 0, F.substring("_old", F.lit(1), at - 1)).otherwise(F.col("_old"))
    kept = F.when(F.col("_old").isNull(), "").otherwise(F.concat(F.regexp_replace(head, r"\s+$", ""), F.lit("\n\n")))
    return new.join(o, "id", "left").select("id", F.concat(kept, F.lit("\n"), mark, F.lit("\n"), F.regexp_replace("body", r"^\s+|\s+$", ""), F.lit("\n")).alias("body"))


def canvas(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(board, json): nodes board, id, text, x, y, w, h, tier; edges board, from_node, to_node, from_side, to_side, label."""
    color = F.element_at(F.create_map(*(F.lit(x) for kv in CANVAS_COLORS.items() for x in kv)), F.col("tier"))
    n = nodes.groupBy("board").agg(F.array_sort(F.collect_list(F.struct("id", F.lit("text").alias("type"), "text", "x", "y", F.col("w").alias("width"), F.col("h").alias("height"), color.alias("color")))).alias("nodes"))
    e = edges.groupBy("board").agg(F.array_sort(F.collect_list(F.struct(F.concat_ws("->", "from_node", "to_node").alias("id"), F.col("from_node").alias("fromNode"), F.col("to_node").alias("toNode"), F.col("from_side").alias("fromSide"), F.col("to_side").alias("toSide"), "label"))).alias("edges"))
    none = F.array().cast("array<struct<id:string,fromNode:string,toNode:string,fromSide:string,toSide:string,label:string>>")
    return n.join(e, "board", "left").select("board", F.to_json(F.struct("nodes", F.coalesce("edges", none).alias("edges"))).alias("json"))


def run_manifest(ids: DataFrame) -> DataFrame:
    """(json): a JSON array of the ids of a run, sorted. One run's ids are one small file by contract."""
    return ids.agg(F.to_json(F.array_sort(F.collect_list("id"))).alias("json"))


def write_notes(notes: DataFrame, folder: str) -> None:
    """One Markdown file per note (id as the file name), written by the tasks."""

    def write(rows):
        import os

        os.makedirs(folder, exist_ok=True)
        for r in rows:
            with open(os.path.join(folder, f"{r['id']}.md"), "w", encoding="utf-8") as f:
                f.write(r["body"])

    notes.select("id", "body").foreachPartition(write)
