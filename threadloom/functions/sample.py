"""Sampling of long texts for prompts, and the cost estimate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.url import strip_blanks, title as title_from_url

# Prices per million tokens, characters per token and the answer's token limit.
IN_PRICE, OUT_PRICE, CHARS_PER_TOKEN, OUT_TOKENS = 0.15, 0.60, 4, 2493
TITLE_ONLY = "(title only, no text was kept)"
NO_TEXT = "(no text)"


def fraction(n: Column) -> Column:
    """Share of a text of n characters that is sent."""
    return F.when(n <= 4_000, 0.25).when(n <= 12_000, 0.35).when(n <= 40_000, 0.45).when(n <= 120_000, 0.55).otherwise(0.60)


def clamp(x: Column, low: int, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(x, F.lit(high)))


def allowed(n: Column, low: int = 1_200, high: int = 18_000) -> Column:
    return clamp(F.floor(fraction(n) * n).cast("int"), low, high)


def with_sample(df: DataFrame, text: str, most: str, alias: str = "sent") -> DataFrame:
    """Head, five windows of the middle and tail; the whole text where it fits.

    Windows are stripped, blank ones left out, joined by an empty line; they may
    overlap. Steps are columns of their own, so each is computed once.
    """
    d = df.withColumn("_s", strip_blanks(F.col(text)))
    d = d.withColumns({"_n": F.length("_s"), "_head": F.floor(F.col(most) * 0.20).cast("int"), "_tail": F.floor(F.col(most) * 0.10).cast("int")})
    d = d.withColumns({
        "_each": F.greatest(F.lit(200), F.floor((F.col(most) - F.col("_head") - F.col("_tail")) / 5).cast("int")),
        "_span": F.greatest(F.lit(1), F.greatest(F.col("_head"), F.col("_n") - F.col("_tail")) - F.col("_head")),
    })
    start = "greatest(0, _head + cast(floor((i + 0.5D) * (_span / 5D)) as int) - cast(floor(_each / 2) as int)) + 1"
    d = d.withColumn("_parts", F.expr(f"concat(array(substring(_s, 1, _head)), transform(sequence(0, 4), i -> substring(_s, {start}, _each)), array(if(_tail > 0, right(_s, _tail), '')))"))
    joined = F.array_join(F.filter(F.transform("_parts", strip_blanks), lambda p: p != ""), "\n\n")
    return d.withColumn(alias, F.when(F.col("_n") <= F.col(most), F.col("_s")).otherwise(joined)).drop("_s", "_n", "_head", "_tail", "_each", "_span", "_parts")


def with_payload(df: DataFrame, text: str, low: int = 1_200, high: int = 18_000) -> DataFrame:
    """Adds mode, chars, p, allowed_chars, sent: title_only for a blank text."""
    d = df.withColumn("_t", strip_blanks(F.coalesce(F.col(text), F.lit("")))).withColumn("chars", F.length("_t"))
    full = F.col("chars") > 0
    d = d.withColumns({"mode": F.when(full, "full").otherwise("title_only"), "p": F.when(full, fraction(F.col("chars"))), "allowed_chars": F.when(full, allowed(F.col("chars"), low, high)).otherwise(0)})
    return with_sample(d, "_t", "allowed_chars").drop("_t")


def with_user_content(df: DataFrame, url: str, title: str, text: str, twice: bool = True, high: int = 18_000) -> DataFrame:
    """Adds content, the user message of a link; its title and content head comes twice unless told otherwise."""
    d = with_payload(df, text, high=high)
    name = F.coalesce(F.nullif(strip_blanks(F.col(title)), F.lit("")), title_from_url(F.col(url)))
    d = d.withColumn("_head", F.concat(F.lit("TITLE: "), name, F.lit("\nCONTENT:\n")))
    body = F.when(F.col("mode") == "title_only", TITLE_ONLY).when(F.col("sent") == "", NO_TEXT).otherwise(F.col("sent"))
    return d.withColumn("content", F.concat(F.lit("URL: "), F.col(url), F.lit("\n"), F.col("_head"), *([F.col("_head")] if twice else []), body)).drop("_head")


def cost_usd(chars: Column) -> Column:
    return chars / CHARS_PER_TOKEN / 1e6 * IN_PRICE + OUT_TOKENS / 1e6 * OUT_PRICE
