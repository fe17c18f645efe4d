"""Sources: URL texts, JSON payloads, CSV exports, JSONL documents, id lists, pages, files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.functions.url import strip_blanks

# Keys under which lists and addresses are looked for, first match wins.
LIST_KEYS = ("urls", "items", "posts", "saved_posts", "savedPosts", "data", "results")
URL_KEYS = ("url", "post_url", "postUrl", "link", "href", "canonical_url", "canonicalUrl")

BATCH_SCHEMA = "id string, canonical_url string, source string, status string, max_completion_tokens int, estimated_cost_usd double, content_mode string, messages array<struct<role:string,content:string>>"
OUTPUT_SCHEMA = "id string, canonical_url string, source string, model string, max_completion_tokens int, http_status int, attempts int, raw string, error string, assistant_content string, parsed string, content_mode string"
NORMALISED_SCHEMA = "id string, source_node struct<id:string,name:string,canonical_url:string,type:string>, concept_nodes array<struct<id:string,type:string,name:string,tier:int,confidence:double>>, groq_output string, cognitive_map string, normalize_warning string"


def url_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """(url): stripped lines that start with http:// or https:// (case matters)."""
    u = strip_blanks(F.col(column))
    return lines.select(u.alias("url")).where(F.col("url").rlike("^https?://"))


def url_text(spark: SparkSession, path: str) -> DataFrame:
    return url_lines(spark.read.text(path))


def _text(v: Column, key: str) -> Column:
    """A string member of a variant, or null (numbers and objects are no addresses)."""
    return F.when(F.schema_of_variant(F.try_variant_get(v, f"$.{key}", "variant")) == "STRING", F.try_variant_get(v, f"$.{key}", "string"))


def item_url(item: Column) -> Column:
    """The address of one payload item: the item itself if a string, else the first non-blank string key."""
    own = F.when(F.schema_of_variant(item) == "STRING", F.try_variant_get(item, "$", "string"))
    keys = [F.nullif(strip_blanks(_text(item, k)), F.lit("")) for k in URL_KEYS]
    return F.coalesce(own, *keys)


def payload_urls(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """(..., pos, url) of JSON payloads: a list, or the first list under a known key, even an empty one."""
    v = F.try_parse_json(F.col(column))
    whole = F.try_variant_get(v, "$", "array<variant>")
    lists = [F.try_variant_get(v, f"$.{k}", "array<variant>") for k in LIST_KEYS]
    rest = [c for c in payloads.columns if c != column]
    d = payloads.select(*rest, F.posexplode(F.coalesce(whole, *lists)).alias("pos", "item"))
    return d.select(*rest, "pos", item_url(F.col("item")).alias("url")).where("url is not null")


def payload_file(spark: SparkSession, path: str) -> DataFrame:
    return payload_urls(spark.read.text(path, wholetext=True).withColumnRenamed("value", "payload"))


def csv_urls(spark: SparkSession, path: str) -> DataFrame:
    """(url) per row: the known header columns in header order, else the first cell that is an address."""
    df = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')
    names = [c for c in df.columns if c.strip() in URL_KEYS or c.strip().lower() in URL_KEYS]
    cells = [F.nullif(strip_blanks(F.col(f"`{c}`")), F.lit("")) for c in df.columns]
    some = [F.nullif(strip_blanks(F.col(f"`{c}`")), F.lit("")) for c in names]
    first = F.try_element_at(F.filter(F.array(*cells), lambda c: c.rlike("^https?://")), F.lit(1))
    return df.select(F.coalesce(*some, first).alias("url")).where("url is not null")


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSONL file: blank lines skipped, a broken line fails the read."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def jsonl_ids(rows: DataFrame) -> DataFrame:
    return rows.select("id").where(F.trim(F.coalesce("id", F.lit(""))) != "")


def success_ids(outputs: DataFrame) -> DataFrame:
    return outputs.where("http_status is not null and http_status < 400 and parsed is not null").select("id")


def id_list(spark: SparkSession, text: str) -> DataFrame:
    """(pos, id) of a JSON array of ids, blanks dropped; anything else is an error."""
    one = spark.createDataFrame([(text,)], "t string").select(F.from_json("t", "array<string>", {"mode": "FAILFAST"}).alias("a"))
    return one.select(F.posexplode("a").alias("pos", "id")).select("pos", F.trim("id").alias("id")).where("id <> ''")


def normalised(spark: SparkSession, path: str) -> DataFrame:
    """Normalised rows that have an address, with their batch (the file's stem)."""
    rows = spark.read.text(path).where(F.trim("value") != "").select("value", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.normalized)?\.[^.]*$", 1).alias("batch_id"))
    d = rows.select("batch_id", F.from_json("value", NORMALISED_SCHEMA, {"mode": "FAILFAST"}).alias("r")).select("batch_id", "r.*")
    return d.where(F.trim(F.coalesce("source_node.canonical_url", F.lit(""))) != "")


def manifest(rows: DataFrame) -> DataFrame:
    """Per batch: source ids with repeats, distinct sorted concept ids."""
    ids = F.flatten(F.collect_list(F.transform("concept_nodes", lambda c: c["id"])))
    return rows.groupBy("batch_id").agg(F.sort_array(F.collect_list("source_node.id")).alias("source_ids"), F.array_sort(F.array_distinct(ids)).alias("concept_ids"))


def pages_with_archive(pages: DataFrame, archive: DataFrame) -> DataFrame:
    """Fetched pages, with the archive's copy where the live one failed; (url, html, status)."""
    a = archive.select("url", F.col("html").alias("_h"))
    ok = (F.col("status") < 400) & F.col("html").isNotNull()
    return pages.join(a, "url", "left").select("url", F.when(ok, F.col("html")).otherwise(F.col("_h")).alias("html"), "status", (~F.coalesce(ok, F.lit(False)) & F.col("_h").isNotNull()).alias("from_archive"))


def html_title(html: Column) -> Column:
    """og:title, else the title element; "" if none."""
    og = F.coalesce(
        F.nullif(F.regexp_extract(html, r"""(?is)<meta[^>]+(?:property|name)\s*=\s*["']og:title["'][^>]*content\s*=\s*["']([^"']*)["']""", 1), F.lit("")),
        F.nullif(F.regexp_extract(html, r"""(?is)<meta[^>]+content\s*=\s*["']([^"']*)["'][^>]*(?:property|name)\s*=\s*["']og:title["']""", 1), F.lit("")),
        F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1),
    )
    return strip_blanks(og)


def html_text(html: Column) -> Column:
    """Visible text by patterns: scripts, styles and tags out, blocks to lines, common entities back."""
    c = F.regexp_replace(html, r"(?is)<(script|style|noscript|template)[^>]*>.*?</\1\s*>|<!--.*?-->", " ")
    c = F.regexp_replace(c, r"(?i)<(?:br|/p|/div|/li|/h[1-6]|/tr|/section|/article)[^>]*>", "\n")
    c = F.regexp_replace(c, r"<[^>]*>", "")
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return strip_blanks(F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), r"\s*\n\s*", "\n"))


def crawl_usable(text: Column, least: int = 200) -> Column:
    return F.length(strip_blanks(F.coalesce(text, F.lit("")))) >= least


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, size_bytes, sha256) of files, for the artifact register."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))


def push_stream(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of pushed imports: {source_key, label, payload{urls}} as JSON files in a folder."""
    schema = T.StructType([T.StructField("source_key", T.StringType()), T.StructField("label", T.StringType()), T.StructField("payload", T.StringType())])
    return spark.readStream.schema(schema).json(folder)


def attach(spark: SparkSession, alias: str, tables: dict[str, DataFrame]) -> list[str]:
    """Registers the tables of another store as views alias_table; the alias must be a plain name."""
    import re

    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", alias):
        raise ValueError(f"not a plain name: {alias!r}")
    for name, df in tables.items():
        df.createOrReplaceTempView(f"{alias}_{name}")
    return [f"{alias}_{n}" for n in tables]


def graph_edges(edges: DataFrame, least: float = 0.0) -> DataFrame:
    """Edges of a graph table of at least a strength; the filter is pushed to the scan."""
    return edges.where(F.col("strength") >= least)
