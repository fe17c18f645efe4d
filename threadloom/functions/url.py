"""URL expressions: canonical form, source, kind, titles and site normalisers.

All are Column builders of JVM expressions; a null input gives null unless said
otherwise. A URL is taken apart by the generic RFC 3986 pattern, which never
fails, also with blanks inside.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_PARTS = r"(?s)^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
# Tracking parameters dropped besides those that start with utm_.
TRACKING = ("ref", "ref_src", "ref_url", "fbclid", "gclid", "igshid")


def part(url: Column, n: int) -> Column:
    """1 scheme, 2 authority, 3 path, 4 query, 5 fragment; "" where missing."""
    return F.regexp_extract(url, _PARTS, n)


def strip_blanks(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"^[\s\u00a0]+|[\s\u00a0]+$", "")


def unwrap_markdown(url: Column) -> Column:
    """The target of a text that is one Markdown link ``[http…](http…)``, else the stripped text."""
    s = strip_blanks(url)
    target = F.regexp_extract(s, r"^\[https?://[^\]]*\]\((https?://[^)]*)\)$", 1)
    return F.when(target != "", target).otherwise(s)


def form_decode(c: Column) -> Column:
    plain = F.replace(c, F.lit("+"), F.lit(" "))
    return F.coalesce(F.try_url_decode(c), plain)


def form_encode(c: Column) -> Column:
    return F.replace(F.replace(F.url_encode(c), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def _key(p: Column) -> Column:
    return form_decode(F.regexp_extract(p, r"(?s)^([^=]*)", 1))


def _value(p: Column) -> Column:
    return form_decode(F.regexp_extract(p, r"(?s)^[^=]*=?(.*)$", 1))


def canonical(url: Column) -> Column:
    """Unwrapped, scheme and host lower, tracking parameters and fragment gone; the rest as it is."""
    s = unwrap_markdown(url)
    kept = F.filter(F.split(part(s, 4), "&"), lambda p: (p != "") & ~F.startswith(_key(p), F.lit("utm_")) & ~_key(p).isin(*TRACKING))
    query = F.array_join(F.transform(kept, lambda p: F.concat(form_encode(_key(p)), F.lit("="), form_encode(_value(p)))), "&")
    scheme, host = F.lower(part(s, 1)), F.lower(part(s, 2))
    return F.concat(F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(""), F.when(host != "", F.concat(F.lit("//"), host)).otherwise(""), part(s, 3), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def host(url: Column) -> Column:
    return F.lower(part(url, 2))


def bare_host(url: Column) -> Column:
    return F.regexp_replace(host(url), r"^www\.", "")


def source(url: Column) -> Column:
    """reddit, linkedin, x or generic, by host."""
    h = bare_host(url)
    return (
        F.when((h == "redd.it") | h.endswith("reddit.com"), "reddit")
        .when(h.endswith("linkedin.com"), "linkedin")
        .when(h.isin("x.com", "twitter.com") | h.endswith(".x.com") | h.endswith(".twitter.com"), "x")
        .otherwise("generic")
    )


def platform(url: Column) -> Column:
    """By substring of the host, as the visual graph labels pages (also netflix.com is "twitter")."""
    h = host(url)
    return (
        F.when(h.contains("reddit"), "reddit")
        .when(h.contains("youtube") | h.contains("youtu.be"), "youtube")
        .when(h.contains("twitter") | h.contains("x.com"), "twitter")
        .when(h.contains("linkedin"), "linkedin")
        .otherwise("web")
    )


def segments(url: Column) -> Column:
    return F.filter(F.split(part(url, 3), "/"), lambda p: p != "")


# Hosts of the sites that kinds are told by.
REDDIT_HOSTS = ("reddit.com", "www.reddit.com", "old.reddit.com", "np.reddit.com", "redd.it")
X_HOSTS = ("x.com", "www.x.com", "twitter.com", "www.twitter.com", "mobile.twitter.com")
POCKET_HOSTS = ("getpocket.com", "app.getpocket.com", "getpocket.app")
YOUTUBE_HOSTS = ("youtu.be", "www.youtu.be", "youtube.com", "www.youtube.com", "m.youtube.com")
_THREAD = r"(?i)^/r/[^/]+/comments/[a-z0-9]+/"


def is_reddit(url: Column) -> Column:
    return host(url).isin(*REDDIT_HOSTS) | host(url).endswith("reddit.com")


def is_reddit_comment(url: Column) -> Column:
    return (host(url) != "redd.it") & is_reddit(url) & part(url, 3).rlike(_THREAD) & (F.size(segments(url)) >= 6)


def is_reddit_post(url: Column) -> Column:
    return (host(url) == "redd.it") | (is_reddit(url) & part(url, 3).rlike(_THREAD) & ~is_reddit_comment(url))


def is_tweet(url: Column) -> Column:
    return host(url).isin(*X_HOSTS) & part(url, 3).rlike(r"/[^/]+/status/\d+")


def is_landing(url: Column, title: Column) -> Column:
    """No path or one short segment, and no telling title."""
    path = F.regexp_replace(part(url, 3), "^/+|/+$", "")
    short = (path == "") | (~F.contains(path, F.lit("/")) & (F.length(path) <= 12))
    t = F.lower(strip_blanks(F.coalesce(title, F.lit(""))))
    return short & (t.isin("", "home", "homepage", "welcome", "index") | (t == F.replace(host(url), F.lit("www."), F.lit(""))))


def kind(url: Column, title: Column) -> Column:
    """What a saved link is."""
    h = host(url)
    return (
        F.when(is_reddit_comment(url), "reddit_comment")
        .when(is_reddit_post(url), "reddit_post")
        .when(is_tweet(url), "x_twitter")
        .when(h.isin(*POCKET_HOSTS), "pocket")
        .when(h.endswith("linkedin.com"), "linkedin")
        .when(is_landing(url, title), "chrome_landing")
        .when(h.isin(*YOUTUBE_HOSTS), "youtube")
        .otherwise("chrome_article")
    )


# Priority of each kind, 0 first.
PRIORITY = {"reddit_comment": 0, "reddit_post": 1, "x_twitter": 2, "pocket": 2, "linkedin": 3, "chrome_landing": 4, "youtube": 4, "chrome_article": 2}


def kind_priority(k: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in PRIORITY.items() for x in kv)), k)


def title(url: Column) -> Column:
    """A title from the last path segment; the host, or "Untitled", where there is none."""
    last = F.coalesce(F.try_element_at(segments(url), F.lit(-1)), F.lit(""))
    stem = F.regexp_replace(last, r"(?i)\.(?:html|htm|php|aspx|asp)$", "")
    plain = F.coalesce(F.try_url_decode(F.replace(stem, F.lit("+"), F.lit("%2B"))), stem)
    words = strip_blanks(F.regexp_replace(F.regexp_replace(plain, "[-_]+", " "), r"\s+", " "))
    h = part(url, 2)
    return F.when(words != "", F.initcap(words)).when(h != "", h).otherwise("Untitled")


def reddit_thread(url: Column) -> Column:
    """https://www.reddit.com + path of a thread, without query and closing slash; "" for others."""
    ok = F.lower(part(url, 1)).isin("http", "https") & ((host(url) == "reddit.com") | host(url).endswith(".reddit.com")) & part(url, 3).contains("/comments/")
    return F.when(ok, F.concat(F.lit("https://www.reddit.com"), F.regexp_replace(part(url, 3), "/+$", ""))).otherwise("")


def x_status(url: Column) -> Column:
    """https://x.com/user/status/id of a post; "" for others and its sub-pages."""
    p = part(url, 3)
    user, num = F.regexp_extract(p, r"^/([^/]+)/status/(\d+)", 1), F.regexp_extract(p, r"^/([^/]+)/status/(\d+)", 2)
    ok = bare_host(url).isin("x.com", "twitter.com", "mobile.twitter.com") & (user != "") & ~p.rlike(r"/(?:analytics|retweets|quotes|likes)/?$")
    return F.when(ok, F.concat(F.lit("https://x.com/"), user, F.lit("/status/"), num)).otherwise("")


def x_clean(url: Column) -> Column:
    """Without query and fragment, twitter.com as x.com."""
    return F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"(?i)^https?://(?:www\.|mobile\.)?twitter\.com", "https://x.com")


def subreddit(url: Column) -> Column:
    return F.regexp_extract(part(url, 3), r"(?i)^/r/([^/]+)", 1)


def is_comment_permalink(url: Column) -> Column:
    s = segments(url)
    return (F.size(s) >= 6) & (F.lower(F.coalesce(F.try_element_at(s, F.lit(3)), F.lit(""))) == "comments")


def status_id(url: Column) -> Column:
    return F.regexp_extract(url, r"/status(?:es)?/(\d+)", 1)


def handle(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"(?i)https?://(?:www\.)?(?:x\.com|twitter\.com)/([^/?#]+)/status(?:es)?/\d+", 1))


def post_link(urn: Column) -> Column:
    """The address of a post from the name it has in a page; "" if there is none."""
    name = F.regexp_extract(urn, r"(urn:li:(?:activity|ugcPost|share):\d+)", 1)
    return F.when(name != "", F.concat(F.lit("https://www.linkedin.com/feed/update/"), name, F.lit("/"))).otherwise("")


def is_saved_page(url: Column) -> Column:
    """Whether an address is a user's page of saved posts."""
    return (host(url) == "reddit.com") & part(url, 3).rlike(r"^/user/[^/]+/saved/?$") | host(url).endswith(".reddit.com") & part(url, 3).rlike(r"^/user/[^/]+/saved/?$")
