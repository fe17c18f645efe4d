"""Text expressions: cleaning, line filters, structured sections, scores, names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.url import strip_blanks

# Interface lines dropped per site (lower case).
X_LINES = (
    "follow",
    "following",
    "reply",
    "repost",
    "like",
    "bookmark",
    "share",
    "copy link",
    "show more",
    "show this thread",
    "view post engagements",
    "post your reply",
    "translate post",
    "show replies",
    "view community note",
    "this post may contain sensitive content",
    "read more",
    "sign up",
    "log in",
    "ad",
    "promoted",
)
LINKEDIN_LINES = (
    "like",
    "comment",
    "repost",
    "send",
    "copy link",
    "follow",
    "following",
    "connect",
    "message",
    "translate",
    "see translation",
    "edited",
    "more",
    "show more",
    "show less",
    "view more comments",
    "load more comments",
    "load previous replies",
    "view previous comments",
    "view more replies",
    "view previous replies",
    "most relevant",
    "top",
    "recent",
    "all comments",
    "add a comment",
    "sign in",
    "join now",
)
REDDIT_LINES = (
    "reply",
    "share",
    "save",
    "hide",
    "report",
    "give award",
    "award",
    "crosspost",
    "follow",
    "sort by",
    "best",
    "new",
    "top",
    "controversial",
    "old",
    "q&a",
    "view discussions in",
    "more posts from",
    "single comment thread",
    "view all comments",
    "continue this thread",
    "load more comments",
    "show replies",
    "more replies",
)
# Markers of advertising, login walls and missing posts.
AD_MARKERS = (
    "promoted",
    "who to follow",
    "relevant people",
    "trends for you",
    "subscribe to premium",
    "discover more",
    "you might like",
    "show more posts",
    "sign up to get the full experience",
    "new to x?",
    "don’t miss what’s happening",
    "don't miss what's happening",
)
WALL_URLS = {"x": ["/i/flow/login", "/i/flow/signup", "/login", "/signup"], "linkedin": ["/authwall", "/uas/login", "/checkpoint/", "/signup"]}
WALL_TEXTS = {
    "x": ["sign in to x", "join x today", "sign up for x", "log in to x", "create account"],
    "linkedin": ["join now", "sign in", "new to linkedin", "sign in to see", "continue to linkedin"],
}
GONE_MARKERS = {
    "x": "this post is unavailable|this post was deleted|this account doesn’t exist|this account doesn't exist|these posts are protected|are you sure you want to view these posts|you’re unable to view these posts|you're unable to view these posts|this post violated the x rules|something went wrong. try reloading|page doesn’t exist|page doesn't exist".split("|"),
    "linkedin": "this post is unavailable|the post you’re looking for can't be displayed|the post you're looking for can't be displayed|content unavailable|this content is not available|page not found|profile unavailable|this page doesn’t exist|this page doesn't exist|member-only content|not visible".split("|"),
    "reddit": "page not found|error 404|404|server error|something went wrong|sorry, nobody on reddit goes by that name|this page is no longer available|request failed|bad gateway|gateway timeout|service unavailable".split("|"),
}
SECTIONS = {
    "x": ["VISIBILITY_NOTE", "MEDIA_NOTE", "TITLE", "THREAD_ABOVE", "POST", "QUOTE", "COMMUNITY_NOTE", "THREAD_BELOW", "TOP_REPLY_LT_POST", "TOP_REPLY_GTE_POST", "COMMENTS"],
    "linkedin": ["VISIBILITY_NOTE", "MEDIA_NOTE", "TITLE", "POST", "QUOTE", "COMMENTS"],
    "reddit": ["TITLE", "POST", "COMMENTS"],
}


def norm_space(c: Column) -> Column:
    """One blank for every run of white space, none at the ends."""
    return strip_blanks(F.regexp_replace(c, r"[\s\u00a0]+", " "))


def collapse(c: Column) -> Column:
    """Blanks and tabs to one blank, at most one empty line in a row."""
    c = F.regexp_replace(F.replace(c, F.lit("\u00a0"), F.lit(" ")), r"[ \t]+", " ")
    return strip_blanks(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def strip_urls(c: Column, site: str = "x") -> Column:
    own = {"x": (r"\bx\.com/\S+\b", r"\btwitter\.com/\S+\b"), "linkedin": (r"\blinkedin\.com/\S+\b",)}.get(site, ())
    for p in (r"https?://\S+", r"\bwww\.\S+\b", *own):
        c = F.regexp_replace(c, "(?i)" + p, "")
    return c


def _lines(c: Column) -> Column:
    return F.split(F.regexp_replace(c, r"\r\n?", "\n"), "\n")


def clean_lines(c: Column, site: str) -> Column:
    """The text without the interface lines of a site."""
    if site != "reddit":
        c = strip_urls(c, site)
    lines = F.transform(_lines(c), strip_blanks if site == "reddit" else collapse)
    low = F.lower
    drop = {
        "x": lambda s: low(s).isin(*X_LINES) | low(s).startswith("replying to ") | s.rlike(r"^@\S+$") | low(s).rlike(r"^\d+[smhdwy]$") | s.rlike(r"^[^\p{L}\p{N}]+$") | low(s).rlike(r"^\d+(\.\d+)?[kmb]?$"),
        "linkedin": lambda s: low(s).isin(*LINKEDIN_LINES) | low(s).rlike(r"^\d+\s+(reactions?|comments?|reposts?)$") | low(s).rlike(r"^\d+[smhdwy]$") | s.rlike(r"^[^\p{L}\p{N}]+$") | s.rlike(r"^#[\p{L}\p{N}_]+$"),
        "reddit": lambda s: low(s).isin(*REDDIT_LINES) | low(s).rlike(r"^\d+\s+(upvotes?|downvotes?|points?|votes?)$") | low(s).rlike(r"^\d+\s+(second|minute|hour|day|week|month|year)s?\s+ago$") | (F.length(s) == 1) | s.rlike(r"^u/[\p{L}\p{N}_]+$"),
    }[site]
    return F.array_join(F.filter(lines, lambda s: (s != "") & ~drop(s)), "\n")


def is_meaningful(c: Column, site: str, least: int) -> Column:
    """Enough text after cleaning; on reddit any text."""
    if site == "reddit":
        return F.length(strip_blanks(F.coalesce(c, F.lit("")))) > 0
    return F.length(clean_lines(F.coalesce(c, F.lit("")), site)) >= least


def first_line(c: Column, site: str) -> Column:
    """The first line of at least 8 characters without blanks and dashes around it, cut to 120; "" if none."""
    t = F.transform(_lines(clean_lines(c, site)), lambda s: F.regexp_replace(s, r"^[ \-–—|]+|[ \-–—|]+$", ""))
    return F.coalesce(F.left(F.try_element_at(F.filter(t, lambda s: F.length(s) >= 8), F.lit(1)), F.lit(120)), F.lit(""))


def compact_number(c: Column) -> Column:
    """1.2K, 3,400, 5M as numbers; other text by its digits, or 0."""
    s = F.upper(F.replace(strip_blanks(F.coalesce(c, F.lit(""))), F.lit(","), F.lit("")))
    num, suf = F.regexp_extract(s, r"^(\d+(?:\.\d+)?)([KMB])?$", 1), F.regexp_extract(s, r"^(\d+(?:\.\d+)?)([KMB])?$", 2)
    times = F.when(suf == "K", 1e3).when(suf == "M", 1e6).when(suf == "B", 1e9).otherwise(1.0)
    rest = F.regexp_replace(s, r"[^\d.]", "")
    return F.when(num != "", num.try_cast("double") * times).otherwise(F.coalesce(rest.try_cast("double"), F.lit(0.0)))


def engagement(c: Column, words: list[str]) -> Column:
    """The number before one of the words, else the one after."""
    w = "|".join(words)
    before = F.regexp_extract(c, rf"(?i)(\d+(?:\.\d+)?[KMB]?)\s+(?:{w})\b", 1)
    after = F.regexp_extract(c, rf"(?i)\b(?:{w})\s+(\d+(?:\.\d+)?[KMB]?)\b", 1)
    return F.when(before != "", compact_number(before)).when(after != "", compact_number(after)).otherwise(0.0)


def most_engagement(texts: list[Column], words: list[str]) -> Column:
    """The largest number that any of the texts gives for one of the words."""
    return F.greatest(*(F.coalesce(engagement(t, words), F.lit(0.0)) for t in texts))


def best_of_classes(rows: DataFrame, group: list[str], item: Column, likes: Column, main: Column, order: list[Column]) -> DataFrame:
    """(group, below_main, at_least_main): the best item with fewer likes than the main post, and with as many or more."""
    key = F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)))
    best = lambda c: F.max_by(F.when(c, item), F.when(c, key))
    return rows.groupBy(*group).agg(best(likes < main).alias("below_main"), best(likes >= main).alias("at_least_main"))


def reply_quality(text: Column, likes: Column, replies: Column) -> Column:
    marks = F.regexp_count(text, F.lit("[.!?]"))
    return F.length(text) + F.when(marks > 0, 12).otherwise(0) + 3 * F.least(marks, F.lit(6)) + F.least(likes / 10.0, F.lit(500.0)) + F.least(replies * 3.0, F.lit(300.0))


def article_quality(text: Column, is_target: Column, has_text: Column) -> Column:
    return F.when(F.coalesce(text, F.lit("")) == "", -999).otherwise(
        F.least(F.length(text), F.lit(400)) + F.when(is_target, 1000).otherwise(0) + F.when(has_text, 120).otherwise(0) + F.when(F.lower(text).contains("replying to"), 20).otherwise(0) + F.when(~is_ad(text), 40).otherwise(0)
    )


def _any(c: Column, markers: list[str]) -> Column:
    return F.exists(F.array(*(F.lit(m) for m in markers)), lambda m: F.contains(c, m))


def is_ad(c: Column) -> Column:
    low = F.concat(F.lit("\n"), F.lower(F.coalesce(c, F.lit(""))), F.lit("\n"))
    return _any(low, [*AD_MARKERS, "\nad\n"])


def login_wall(site: str, url: Column, body: Column) -> Column:
    """authwall_url, authwall_text or null."""
    hits = F.size(F.filter(F.array(*(F.lit(m) for m in WALL_TEXTS[site])), lambda m: F.contains(F.lower(body), m)))
    return F.when(_any(F.lower(url), WALL_URLS[site]), "authwall_url").when(hits >= 2, "authwall_text")


def gone_reason(site: str, status: Column, body: Column) -> Column:
    """http_N, the marker found (blanks as _), or null."""
    found = F.try_element_at(F.filter(F.array(*(F.lit(m) for m in GONE_MARKERS[site])), lambda m: F.contains(F.lower(body), m)), F.lit(1))
    return F.when(status >= 400, F.concat(F.lit("http_"), status.cast("string"))).otherwise(F.replace(found, F.lit(" "), F.lit("_")))


def broken_reason(status: Column, body: Column, title: Column, post: Column, comments: Column) -> Column:
    """Why a live reddit page is to be taken from an archive, or null."""
    none = (F.coalesce(title, F.lit("")) == "") & (F.coalesce(post, F.lit("")) == "") & (F.coalesce(comments, F.lit("")) == "")
    clean = clean_lines(F.coalesce(body, F.lit("")), "reddit")
    return (
        F.when(status >= 400, F.concat(F.lit("http_"), status.cast("string")))
        .when(_any(F.lower(clean), GONE_MARKERS["reddit"]) & none, "broken_marker_and_no_content")
        .when(none & (F.length(clean) < 80), "empty_page")
    )


def structured(site: str, parts: dict[str, Column]) -> Column:
    """Labelled non-empty sections in the site's order; reddit joins them without a gap."""
    have = [F.when(F.coalesce(parts[s], F.lit("")) != "", F.concat(F.lit(s + ":"), parts[s])) for s in SECTIONS[site] if s in parts]
    return F.concat_ws("" if site == "reddit" else "\n\n", *have)


def clean_comment(c: Column) -> Column:
    c = clean_lines(c, "linkedin")
    c = F.regexp_replace(c, r"(?i)\b\d+\s*(reactions?|likes?)\b", "")
    return collapse(F.regexp_replace(c, r"(?i)\b(reply|like|repost|send)\b", ""))


def first_of(*candidates: Column, cut: int | None = None) -> Column:
    c = F.coalesce(*(F.nullif(strip_blanks(x), F.lit("")) for x in candidates))
    return F.left(c, F.lit(cut)) if cut else c


def slug(c: Column, most: int = 80) -> Column:
    """Lower-case ASCII letters, digits and single hyphens; "untitled" if nothing remains."""
    s = F.regexp_replace(F.lower(strip_blanks(F.coalesce(c, F.lit("")))), r"\s+", "-")
    s = F.regexp_replace(F.regexp_replace(s, r"[^a-z0-9\-]+", ""), "-{2,}", "-")
    s = F.regexp_replace(F.left(F.regexp_replace(s, "^-+|-+$", ""), F.lit(most)), "^-+|-+$", "")
    return F.coalesce(F.nullif(s, F.lit("")), F.lit("untitled"))


def slug_short(c: Column, words: int = 6, most: int = 44) -> Column:
    """The first words without punctuation, case kept; "Untitled" if nothing remains."""
    w = F.slice(F.split(norm_space(F.coalesce(c, F.lit(""))), " "), 1, words)
    s = norm_space(F.regexp_replace(F.array_join(w, " "), r"[^\p{L}\p{N}_\s\-]", ""))
    return F.coalesce(F.nullif(strip_blanks(F.left(s, F.lit(most))), F.lit("")), F.lit("Untitled"))


def tail8(node_id: Column) -> Column:
    """The last eight characters of the last part of an id."""
    return F.right(F.element_at(F.split(node_id, "_"), -1), F.lit(8))


def tokens(c: Column) -> Column:
    """Distinct lower-case words."""
    return F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}_]+", " "), " "), lambda x: x != ""))


def yaml_quote(c: Column) -> Column:
    s = F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.concat(F.lit('"'), s, F.lit('"'))


def shorten(c: Column, most: int = 220) -> Column:
    return F.when(F.length(c) > most, F.concat(F.left(c, F.lit(most - 3)), F.lit("..."))).otherwise(c)


def like_pattern(part: str) -> str:
    """A LIKE pattern for text that contains ``part`` as it is."""
    return "%" + "".join("\\" + c if c in "%_\\" else c for c in part) + "%"
