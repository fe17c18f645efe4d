"""Cognitive maps: answers to maps, defaults, concept lists, embedding and note texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from threadloom.functions.ids import concept_id, confidence
from threadloom.functions.url import strip_blanks

# The four levels of a map, in order, with tier and default type.
LEVELS = [("domains", 1, "Domain"), ("themes", 2, "Theme"), ("concepts", 3, "Concept"), ("micro_insights", 4, "Insight")]
MAP_SCHEMA = (
    "root struct<label:string,intellectual_need:string,intellectualneed:string,why_saved:string,whysaved:string>,"
    "domains array<struct<name:string,confidence:string,type:string>>,"
    "themes array<struct<name:string,tier:string,confidence:string,type:string>>,"
    "concepts array<struct<name:string,type:string,confidence:string>>,"
    "micro_insights array<struct<text:string,type:string,confidence:string>>,"
    "microinsights array<struct<text:string,type:string,confidence:string>>,"
    "quality_flags struct<content_thin:boolean,access_blocked_or_paywalled:boolean,extraction_suspect:boolean>"
)

_ITEM = {
    "domains": "array<struct<name:string,confidence:string,type:string>>",
    "themes": "array<struct<name:string,tier:string,confidence:string,type:string>>",
    "concepts": "array<struct<name:string,type:string,confidence:string>>",
    "micro_insights": "array<struct<text:string,type:string,confidence:string>>",
}


def assistant_text(content: Column, raw_json: Column) -> Column:
    """The answer's own column if not blank, else the first choice of the raw response."""
    return F.coalesce(F.when(strip_blanks(content) != "", content), F.get_json_object(raw_json, "$.choices[0].message.content"))


def parse_state(text: Column) -> Column:
    """ok, missing_assistant_content or json_loads_failed."""
    return F.when(F.coalesce(strip_blanks(text), F.lit("")) == "", "missing_assistant_content").when(F.try_parse_json(text).isNull(), "json_loads_failed").otherwise("ok")


def parse(text: Column) -> Column:
    return F.from_json(text, MAP_SCHEMA)


def succeeded(status: Column, parsed: Column) -> Column:
    return status.isNotNull() & (status < 400) & parsed.isNotNull()


def root_of(m: Column) -> Column:
    """struct(label, need, why) with the older spellings and the default need."""
    r = m["root"]
    return F.struct(
        F.coalesce(r["label"], F.lit("")).alias("label"),
        F.coalesce(r["intellectual_need"], r["intellectualneed"], F.lit("Learn")).alias("need"),
        F.coalesce(r["why_saved"], r["whysaved"], F.lit("")).alias("why"),
    )


def filled(m: Column) -> Column:
    """The map with defaults for whatever is missing."""
    flags = m["quality_flags"]
    lists = [F.coalesce(m[k], F.array().cast(_ITEM[k])).alias(k) for k in ("domains", "themes", "concepts")]
    micro = F.coalesce(m["micro_insights"], m["microinsights"], F.array().cast(_ITEM["micro_insights"])).alias("micro_insights")
    f = F.struct(*(F.coalesce(flags[k], F.lit(False)).alias(k) for k in ("content_thin", "access_blocked_or_paywalled", "extraction_suspect"))).alias("quality_flags")
    return F.struct(root_of(m).alias("root"), *lists, micro, f)


def concepts(m: Column, name_cut: int = 100) -> Column:
    """array<struct<type, name, tier, confidence>> over the four levels in their order."""

    def level(key: str, tier: int, default: str) -> Column:
        text = key == "micro_insights"
        src = F.coalesce(m[key], m["microinsights"]) if text else m[key]
        own = key in ("themes", "concepts", "micro_insights")
        item = lambda x: F.struct(
            (F.coalesce(x["type"], F.lit(default)) if own else F.lit(default)).alias("type"),
            (F.left(strip_blanks(x["text"]), F.lit(name_cut)) if text else strip_blanks(x["name"])).alias("name"),
            F.lit(tier).alias("tier"),
            confidence(x["confidence"]).alias("confidence"),
        )
        some = F.filter(F.coalesce(src, F.array().cast(_ITEM[key])), lambda x: x.isNotNull())
        return F.transform(some, item)

    return F.filter(F.concat(*(level(*x) for x in LEVELS)), lambda c: concept_id(c["type"], c["name"]).isNotNull())


def source_text(url: Column, m: Column) -> Column:
    """The text a source is embedded by."""
    r = root_of(m)
    names = lambda k, f="name": F.filter(F.transform(F.coalesce(m[k], F.array()), lambda x: strip_blanks(x[f])), lambda s: F.coalesce(s, F.lit("")) != "")
    line = lambda label, v: F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(label + ": "), v))
    return F.concat_ws("\n", line("URL", url), line("Label", r["label"]), line("Need", r["need"]), line("Why", r["why"]), line("Domains", F.array_join(names("domains"), "; ")), line("Themes", F.array_join(names("themes"), "; ")), line("Concepts", F.array_join(names("concepts"), "; ")), line("Micro", F.array_join(names("micro_insights", "text"), " | ")))


def concept_text(kind: Column, name: Column, tier: Column) -> Column:
    return F.concat(F.lit("Type: "), kind, F.lit("\nName: "), name, F.lit("\nTier: "), tier.cast("string"))


def bullets(items: Column) -> Column:
    """"- name (0.80)" lines; the number only where there is a confidence."""
    return F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x["name"], F.when(x["confidence"].isNotNull(), F.concat(F.lit(" ("), F.format_string("%.2f", x["confidence"]), F.lit(")"))).otherwise(""))), "\n")
