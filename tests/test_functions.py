"""Expressions against hand-derived values."""

import pytest
from pyspark.sql import functions as F

from threadloom.functions import cogmap, ids, sample, text, url


def one(spark, f, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{i} {'string' if v is None or isinstance(v, str) else 'int' if isinstance(v, int) else 'double'}" for i, v in enumerate(values)))
    return df.select(f(*(F.col(c) for c in df.columns)).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ("HTTPS://WWW.Example.com/A/?utm_source=x&b=1&ref=q&c=#top", "https://www.example.com/A/?b=1&c="),
        ("[https://a.test](https://b.test/x?fbclid=1)", "https://b.test/x"),
        ("https://b.test/x?q=a%20b&UTM_x=1", "https://b.test/x?q=a+b&UTM_x=1"),
        ("https://b.test/x?q=~*", "https://b.test/x?q=~%2A"),
        ("https://b.test/a b?&&x", "https://b.test/a b?x="),
        ("  https://b.test  ", "https://b.test"),
        ("", ""),
        (None, None),
    ],
)
def test_canonical(spark, given, want):
    assert one(spark, url.canonical, given) == want


@pytest.mark.parametrize(("u", "s", "p"), [("https://www.netflix.com/t", "generic", "twitter"), ("https://redd.it/abc", "reddit", "web"), ("https://mobile.twitter.com/a", "x", "twitter"), ("https://notreddit.com/", "reddit", "reddit")])
def test_source_and_platform(spark, u, s, p):
    assert one(spark, url.source, u) == s and one(spark, url.platform, u) == p


@pytest.mark.parametrize(
    ("u", "t", "k"),
    [
        ("https://old.reddit.com/r/s/comments/abc/slug/def/", None, "reddit_comment"), ("https://redd.it/abc", None, "reddit_post"), ("https://b.test/", None, "chrome_landing"),
        ("https://b.test/", "A real title", "chrome_article"), ("https://x.com/u/status/12", None, "x_twitter"), ("https://youtu.be/a1b2c3d4e5f6g7", None, "youtube"), ("https://getpocket.com/read", None, "pocket"),
    ],
)
def test_kind(spark, u, t, k):
    assert one(spark, url.kind, u, t) == k


@pytest.mark.parametrize(("u", "t"), [("https://e.test/2024/my-first_post.HTML", "My First Post"), ("https://e.test/", "e.test"), ("https://e.test/a+b%20c", "A+b C"), ("https://e.test/100%zz", "100%zz"), ("", "Untitled")])
def test_title(spark, u, t):
    assert one(spark, url.title, u) == t


def test_ids(spark):
    assert one(spark, ids.concept_name, " AI! ") == "ai"
    assert one(spark, ids.concept_id, "Domain", " AI! ") == "concept_domain_ba1de5c2952d"
    assert one(spark, ids.concept_id, "Domain", "!!!") is None
    assert one(spark, ids.concept_name, "É  ü/日本 +c#.-_") == "é ü/日本 +c#.-_"


@pytest.mark.parametrize(("given", "want"), [("1.2K", 1200.0), ("3,400", 3400.0), ("n/a", 0.0), ("5m", 5e6), (None, 0.0), ("1.2.3", 0.0)])
def test_compact_number(spark, given, want):
    assert one(spark, text.compact_number, given) == want


@pytest.mark.parametrize(("given", "want"), [("0.8", 0.8), ("1.2", None), ("NaN", None), ("x", None), ("-1", None), ("0", 0.0), (None, None)])
def test_confidence(spark, given, want):
    assert one(spark, ids.confidence, given) == want


@pytest.mark.parametrize(("n", "p"), [(0, 0.25), (4000, 0.25), (4001, 0.35), (12000, 0.35), (12001, 0.45), (40000, 0.45), (40001, 0.55), (120000, 0.55), (120001, 0.60)])
def test_fraction(spark, n, p):
    assert one(spark, sample.fraction, n) == p


def windows(s: str, most: int) -> str:
    """The sampling rule in plain Python."""
    s = s.strip()
    if len(s) <= most:
        return s
    head, tail = int(most * 0.2), int(most * 0.1)
    each, span = max(200, (most - head - tail) // 5), max(1, max(head, len(s) - tail) - head)
    mid = [s[max(0, head + int((i + 0.5) * (span / 5)) - each // 2) :][:each] for i in range(5)]
    return "\n\n".join(x.strip() for x in [s[:head], *mid, s[len(s) - tail :]] if x.strip())


@pytest.mark.parametrize("n", [0, 1, 1199, 1200, 1201, 4000, 4001, 12001, 40001, 120001])
def test_sample(spark, n):
    t = "".join(chr(97 + (i * 7) % 26) if i % 11 else " " for i in range(n))
    got = sample.with_payload(spark.createDataFrame([(t,)], "t string"), "t").first()
    body = t.strip()
    if not body:
        assert got["mode"] == "title_only" and got["sent"] == ""
    else:
        p = 0.25 if len(body) <= 4000 else 0.35 if len(body) <= 12000 else 0.45 if len(body) <= 40000 else 0.55 if len(body) <= 120000 else 0.6
        most = max(1200, min(int(p * len(body)), 18000))
        assert (got["allowed_chars"], got["sent"]) == (most, windows(body, most))


def test_cost(spark):
    assert round(one(spark, sample.cost_usd, 13471), 6) == 0.002001


def test_cleaners(spark):
    t = "Reply\n12 points\nu/someone\n5 hours ago\nx\nReal text here\n"
    assert one(spark, lambda c: text.clean_lines(c, "reddit"), t) == "Real text here"
    t = "Follow\n@someone\n5h\n1.2K\n…\nReplying to a\nSee https://a.b/c now\n"
    assert one(spark, lambda c: text.clean_lines(c, "x"), t) == "See now"
    t = "Like\n3 reactions\n#tag\n•\nGood point"
    assert one(spark, lambda c: text.clean_lines(c, "linkedin"), t) == "Good point"
    assert one(spark, lambda c: text.first_line(c, "x"), "ok\n- A longer line -\n") == "A longer line"


def test_walls(spark):
    assert one(spark, lambda u, b: text.login_wall("x", u, b), "https://x.com/login", "") == "authwall_url"
    assert one(spark, lambda u, b: text.login_wall("x", u, b), "https://x.com/a", "Sign in to X or create account") == "authwall_text"
    assert one(spark, lambda s, b: text.gone_reason("x", s, b), 404, "") == "http_404"
    assert one(spark, lambda s, b: text.gone_reason("x", s, b), 200, "This post was deleted") == "this_post_was_deleted"
    assert one(spark, text.is_ad, "a\nAd\nb") is True and one(spark, text.is_ad, "a bad ad") is False


def test_names(spark):
    assert one(spark, text.slug, "Hello,  Wörld -- x") == "hello-wrld-x" and one(spark, text.slug, "!!!") == "untitled"
    assert one(spark, text.slug_short, "One two, three four five six seven") == "One two three four five six"
    assert one(spark, text.tail8, "concept_x_0123456789ab") == "456789ab"
    assert one(spark, text.yaml_quote, 'a "b" \\c') == '"a \\"b\\" \\\\c"'


def test_maps(spark):
    good = '{"root":{"label":"L"},"domains":[{"name":"Art","confidence":"0.8"},{"name":"!!","confidence":1}],"themes":[{"name":"T","type":null}],"microinsights":[{"text":"' + "x" * 120 + '"}]}'
    df = spark.createDataFrame([(good,)], "t string").select(cogmap.parse(F.col("t")).alias("m"))
    r = df.select(cogmap.concepts(F.col("m")).alias("c"), cogmap.root_of(F.col("m")).alias("r")).first()
    assert [(c["type"], c["tier"], c["confidence"]) for c in r["c"]] == [("Domain", 1, 0.8), ("Theme", 2, None), ("Insight", 4, None)]
    assert len(r["c"][2]["name"]) == 100 and r["r"]["need"] == "Learn"
    assert one(spark, cogmap.parse_state, "{") == "json_loads_failed" and one(spark, cogmap.parse_state, " ") == "missing_assistant_content"
