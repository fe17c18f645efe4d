"""Snippets of oracle SQL (DuckDB): the same rules written a second time, independently of the Column builders."""

from __future__ import annotations

URL = r"(?s)^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^[\s\x{{00A0}}]+|[\s\x{{00A0}}]+$', '', 'g')"


def part(x: str, n: int) -> str:
    return f"regexp_extract({x}, '{URL}', {n})"


def host(x: str) -> str:
    return f"lower({part(x, 2)})"


def bare(x: str) -> str:
    return rf"regexp_replace({host(x)}, '^www\.', '')"


def unwrap(x: str) -> str:
    s = strip(x)
    m = rf"regexp_extract({s}, '^\[https?://[^\]]*\]\((https?://[^)]*)\)$', 1)"
    return f"(CASE WHEN {m} <> '' THEN {m} ELSE {s} END)"


def decode(x: str) -> str:
    return f"url_decode(replace({x}, '+', ' '))"


def encode(x: str) -> str:
    return f"replace(url_encode({x}), '%20', '+')"


def canonical(x: str) -> str:
    k = decode("regexp_extract(p, '(?s)^([^=]*)', 1)")
    v = decode("regexp_extract(p, '(?s)^[^=]*=?(.*)$', 1)")
    kept = f"list_filter(string_split({part(x, 4)}, '&'), lambda p: p <> '' AND NOT starts_with({k}, 'utm_') AND {k} NOT IN ('ref', 'ref_src', 'ref_url', 'fbclid', 'gclid', 'igshid'))"
    q = f"array_to_string(list_transform({kept}, lambda p: {encode(k)} || '=' || {encode(v)}), '&')"
    return (
        f"(CASE WHEN {part(x, 1)} <> '' THEN lower({part(x, 1)}) || ':' ELSE '' END || CASE WHEN {part(x, 2)} <> '' THEN '//' || {host(x)} ELSE '' END"
        f" || {part(x, 3)} || CASE WHEN {q} <> '' THEN '?' || {q} ELSE '' END)"
    )


def source(x: str) -> str:
    h = bare(x)
    return f"(CASE WHEN {h} = 'redd.it' OR {h} LIKE '%reddit.com' THEN 'reddit' WHEN {h} LIKE '%linkedin.com' THEN 'linkedin' WHEN {h} IN ('x.com', 'twitter.com') OR {h} LIKE '%.x.com' OR {h} LIKE '%.twitter.com' THEN 'x' ELSE 'generic' END)"


def platform(x: str) -> str:
    h = host(x)
    return f"(CASE WHEN {h} LIKE '%reddit%' THEN 'reddit' WHEN {h} LIKE '%youtube%' OR {h} LIKE '%youtu.be%' THEN 'youtube' WHEN {h} LIKE '%twitter%' OR {h} LIKE '%x.com%' THEN 'twitter' WHEN {h} LIKE '%linkedin%' THEN 'linkedin' ELSE 'web' END)"


def segments(x: str) -> str:
    return f"list_filter(string_split({part(x, 3)}, '/'), lambda s: s <> '')"


def kind(x: str, title: str) -> str:
    h, p, n = host(x), part(x, 3), f"len({segments(x)})"
    reddit = f"({h} IN ('reddit.com', 'www.reddit.com', 'old.reddit.com', 'np.reddit.com', 'redd.it') OR {h} LIKE '%reddit.com')"
    thread = f"regexp_matches({p}, '(?i)^/r/[^/]+/comments/[a-z0-9]+/')"
    path = f"regexp_replace({p}, '^/+|/+$', '', 'g')"
    t = f"lower({strip(f'coalesce({title}, chr(32))')})"
    landing = f"(({path} = '' OR (NOT contains({path}, '/') AND length({path}) <= 12)) AND ({t} IN ('', 'home', 'homepage', 'welcome', 'index') OR {t} = replace({h}, 'www.', '')))"
    return (
        f"(CASE WHEN {h} <> 'redd.it' AND {reddit} AND {thread} AND {n} >= 6 THEN 'reddit_comment' WHEN {h} = 'redd.it' OR ({reddit} AND {thread}) THEN 'reddit_post'"
        rf" WHEN {h} IN ('x.com', 'www.x.com', 'twitter.com', 'www.twitter.com', 'mobile.twitter.com') AND regexp_matches({p}, '/[^/]+/status/\d+') THEN 'x_twitter'"
        f" WHEN {h} IN ('getpocket.com', 'app.getpocket.com', 'getpocket.app') THEN 'pocket' WHEN {h} LIKE '%linkedin.com' THEN 'linkedin' WHEN {landing} THEN 'chrome_landing'"
        f" WHEN {h} IN ('youtu.be', 'www.youtu.be', 'youtube.com', 'www.youtube.com', 'm.youtube.com') THEN 'youtube' ELSE 'chrome_article' END)"
    )


def priority(k: str) -> str:
    return f"(CASE {k} WHEN 'reddit_comment' THEN 0 WHEN 'reddit_post' THEN 1 WHEN 'x_twitter' THEN 2 WHEN 'pocket' THEN 2 WHEN 'chrome_article' THEN 2 WHEN 'linkedin' THEN 3 ELSE 4 END)"


def title(x: str) -> str:
    stem = rf"regexp_replace(coalesce(list_last({segments(x)}), ''), '(?i)\.(?:html|htm|php|aspx|asp)$', '')"
    words = rf"trim(regexp_replace(regexp_replace(url_decode({stem}), '[-_]+', ' ', 'g'), '\s+', ' ', 'g'))"
    cap = f"array_to_string(list_transform(string_split({words}, ' '), lambda w: upper(left(w, 1)) || lower(substring(w, 2))), ' ')"
    return f"(CASE WHEN {words} <> '' THEN {cap} WHEN {part(x, 2)} <> '' THEN {part(x, 2)} ELSE 'Untitled' END)"


def concept_name(x: str) -> str:
    return strip(rf"regexp_replace(regexp_replace(lower({strip(x)}), '[\s\x{{00A0}}]+', ' ', 'g'), '[^\p{{L}}\p{{N}}_\s\-/+.#]', '', 'g')")


def concept_id(kind: str, x: str) -> str:
    k = f"lower({strip(kind)})"
    n = concept_name(x)
    return f"(CASE WHEN {n} <> '' THEN 'concept_' || {k} || '_' || left(sha1({k} || '||' || {n}), 12) END)"
