"""URL expressions: parts, canonical form, post id, platform, cluster key. No Python runs."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from recolta.functions.text import text_or_empty

# Query keys that are dropped, and those that a platform keeps.
DROPPED_KEYS = "utm_source utm_medium utm_campaign utm_term utm_content utm_id gclid fbclid igshid mc_cid mc_eid spm ref ref_src session sessionid sid phpsessid jsessionid token auth authorization bearer api_key apikey key".split()
YOUTUBE_KEYS = "v t start time_continue list index".split()
FACEBOOK_KEYS = "story_fbid id comment_id reply_comment_id".split()
MEDIA_KEYS = "index i img_index".split()
# Hosts of the platforms; subdomains belong to them.
HOSTS = {"facebook.com": "facebook", "twitter.com": "twitter", "x.com": "twitter", "youtube.com": "youtube", "youtu.be": "youtube", "linkedin.com": "linkedin", "instagram.com": "instagram", "tiktok.com": "tiktok"}

_SCHEME = r"^([A-Za-z][A-Za-z0-9+.-]*):"


def let(value: Column, body) -> Column:
    """body(value), with the value computed once per row and once in the plan, however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def scheme(u: Column) -> Column:
    return F.lower(F.regexp_extract(u, _SCHEME, 1))


def netloc(u: Column) -> Column:
    return F.regexp_extract(u, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)


def path(u: Column) -> Column:
    return F.regexp_extract(u, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def query(u: Column) -> Column:
    return F.regexp_extract(u, r"^[^?#]*\?([^#]*)", 1)


def fragment(u: Column) -> Column:
    return F.regexp_extract(u, r"#(.*)$", 1)


def host(u: Column) -> Column:
    """Lower-case host without www."""
    return F.regexp_replace(F.lower(F.trim(netloc(u))), r"^www\.", "")


def domain(u: Column) -> Column:
    found = host(text_or_empty(u))
    return F.when(found == "", "unknown").otherwise(found)


def valid_url(u: Column) -> Column:
    return (scheme(text_or_empty(u)) != "") & (netloc(text_or_empty(u)) != "")


def platform_name(p: Column) -> Column:
    """Spelling variants of a platform as one; null and blank are unknown."""
    made = F.lower(F.trim(p))
    return F.when(made.isNull() | (made == ""), "unknown").otherwise(made)


def query_items(u: Column) -> Column:
    """array<struct<k,v>> of the query, decoded, without blank values."""
    decode = lambda s: F.coalesce(F.try_url_decode(s), s)
    pairs = F.transform(F.split(query(u), "&"), lambda s: F.struct(F.trim(decode(F.split_part(s, F.lit("="), F.lit(1)))).alias("k"), F.trim(decode(F.regexp_extract(s, "^[^=]*=(.*)$", 1))).alias("v")))
    return F.filter(pairs, lambda x: (x["k"] != "") & (x["v"] != ""))


def _encode(items: Column) -> Column:
    quote = lambda s: F.replace(F.replace(F.url_encode(s), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    return F.array_join(F.transform(items, lambda x: F.concat(quote(x["k"]), F.lit("="), quote(x["v"]))), "&")


def _keep(items: Column, keys: list[str]) -> Column:
    return F.filter(items, lambda x: x["k"].isin(*keys))


def _ordered(items: Column, keys: list[str]) -> Column:
    """The last value of each key, in the order of keys."""
    last = lambda k: F.slice(F.filter(items, lambda x: x["k"] == k), -1, 1)
    has = lambda k: F.exists(items, lambda x: x["k"] == k)
    return F.flatten(F.array(*[F.when(has(k), last(k)).otherwise(F.slice(items, 1, 0)) for k in keys]))


def canonical_url(url: Column, platform: Column) -> Column:
    """The canonical form: lower host without www, no trailing slash, tracking and session keys, or
    fragment; and what each platform's own addresses keep. Blank gives ''."""
    parts = lambda r: F.struct(r["u"].alias("u"), r["p"].alias("p"), host(r["u"]).alias("h"), F.regexp_replace(path(r["u"]), "/+$", "").alias("path"), F.filter(query_items(r["u"]), lambda x: ~F.lower(x["k"]).isin(*DROPPED_KEYS)).alias("q"), F.regexp_replace(fragment(r["u"]), "^#+", "").alias("f"))
    raw = F.struct(F.trim(text_or_empty(url)).alias("u"), platform_name(platform).alias("p"))
    made = let(raw, lambda r: let(parts(r), lambda r: let(_watch_form(r), _platform_form)))
    return F.when(F.trim(text_or_empty(url)) == "", "").otherwise(made)


def _watch_form(r: Column) -> Column:
    """Addresses of youtu.be become those of the watch page."""
    name = F.regexp_extract(r["path"], "^/+([^/]+)", 1)
    short = (r["p"] == "youtube") & (r["h"] == "youtu.be") & (name != "")
    video = F.array(F.struct(F.lit("v").alias("k"), name.alias("v")))
    where = F.when(short, "/watch").when(r["path"] == "", "/").otherwise(r["path"])
    return F.struct(r["u"].alias("u"), r["p"].alias("p"), F.when(short, "youtube.com").otherwise(r["h"]).alias("h"), where.alias("path"), F.when(short, F.concat(video, _ordered(r["q"], YOUTUBE_KEYS[1:]))).otherwise(r["q"]).alias("q"), r["f"].alias("f"))


def _platform_form(r: Column) -> Column:
    """The path and parameters that each platform keeps, put together."""
    p, own, items = r["p"], r["path"], r["q"]
    none = F.slice(items, 1, 0)
    part = lambda pattern: F.regexp_extract(own, pattern, 1)
    status, update, clip, shorts = part(r"(/[^/]+/status/\d+)"), part(r"(/feed/update/[^/?#]+)"), part(r"(/@[^/]+/video/\d+)"), part(r"/shorts/([^/]*)")
    is_shorts = own.startswith("/shorts/")
    where = (
        F.when((p == "twitter") & (status != ""), status)
        .when((p == "youtube") & is_shorts, F.when(shorts != "", F.concat(F.lit("/shorts/"), shorts)).otherwise("/shorts"))
        .when((p == "linkedin") & (update != ""), update)
        .when((p == "tiktok") & (clip != ""), clip)
        .otherwise(own)
    )
    stamp = F.when(r["f"].startswith("t="), F.substring(r["f"], 3, 10000)).when(r["f"].rlike(r"^\d+[smh]?\d*[sm]?$"), r["f"]).otherwise("")
    watch = F.when(F.exists(items, lambda x: x["k"] == "v"), _ordered(items, YOUTUBE_KEYS)).otherwise(none)
    timed = F.exists(items, lambda x: x["k"].isin("t", "start", "time_continue")) & F.exists(items, lambda x: x["k"] == "v")
    added = F.when((stamp != "") & ~timed, F.array(F.struct(F.lit("t").alias("k"), stamp.alias("v")))).otherwise(none)
    kept = (
        F.when(p == "twitter", none)
        .when((p == "youtube") & (own == "/watch"), F.concat(watch, added))
        .when((p == "youtube") & is_shorts, _keep(items, ["t"]))
        .when(p == "youtube", _keep(items, MEDIA_KEYS))
        .when(p == "linkedin", F.when(update != "", none).otherwise(_keep(items, MEDIA_KEYS)))
        .when((p == "facebook") & own.rlike("/(posts|permalink)/"), _keep(items, FACEBOOK_KEYS))
        .when(p == "facebook", _keep(items, FACEBOOK_KEYS + MEDIA_KEYS))
        .when(p == "tiktok", _keep(items, MEDIA_KEYS))
        .otherwise(items)
    )
    full = lambda q: F.concat(F.when(scheme(r["u"]) == "", "https").otherwise(scheme(r["u"])), F.lit("://"), r["h"], where, F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""))
    return let(_encode(kept), full)


def post_id(url: Column, platform: Column) -> Column:
    """The platform's own number of a post; null where the address has none."""
    u, p = text_or_empty(url), platform_name(platform)
    own = path(u)
    value = lambda k: F.element_at(F.transform(F.filter(query_items(u), lambda x: x["k"] == k), lambda x: x["v"]), F.lit(-1))
    last = lambda k: F.when(F.exists(query_items(u), lambda x: x["k"] == k), value(k))
    part = lambda pattern: F.nullif(F.regexp_extract(own, pattern, 1), F.lit(""))
    return (
        F.when(p == "twitter", part(r"/status/(\d+)"))
        .when((p == "youtube") & (own == "/watch"), last("v"))
        .when((p == "youtube") & own.startswith("/shorts/"), part("/shorts/([^/]*)"))
        .when(p == "linkedin", part("/feed/update/([^/?#]+)"))
        .when(p == "facebook", F.coalesce(part("/posts/([^/?#]+)"), part("/permalink/([^/?#]+)"), last("story_fbid")))
        .when(p == "tiktok", part(r"/video/(\d+)"))
    )


def detect_platform(url: Column, fallback: Column) -> Column:
    """The platform of an address's host, else the fallback. A host belongs to a platform if it is its host or a subdomain."""
    h = host(text_or_empty(url))
    out = F.when(F.lit(False), "")
    for name, platform in HOSTS.items():
        out = out.when((h == name) | h.endswith("." + name), platform)
    return out.otherwise(platform_name(fallback))


def content_type(url: Column, images: Column) -> Column:
    """video, image, article or post by the look of the address and the images."""
    u = F.lower(text_or_empty(url))
    return (
        F.when(u.contains("youtube.com/watch") | u.contains("youtu.be/") | u.contains("tiktok.com"), "video")
        .when(F.coalesce(F.size(images), F.lit(0)) > 0, "image")
        .when(u.rlike(r"\.(jpg|jpeg|png|gif|webp)$"), "image")
        .when(u.contains("/article") | u.contains("/blog") | u.contains("medium.com"), "article")
        .otherwise("post")
    )


def cluster_key(canonical: Column, url: Column, text: Column) -> Column:
    """Near-duplicate cluster: host and path of the address, else a digest of the first words."""
    u = F.lower(F.trim(F.coalesce(F.nullif(canonical, F.lit("")), url, F.lit(""))))
    words = F.slice(F.regexp_extract_all(F.lower(text_or_empty(text)), F.lit("[a-z0-9]{3,}"), 0), 1, 16)
    by_url = F.concat(F.lit("url:"), netloc(u), F.regexp_replace(path(u), "/+$", ""))
    return F.when(u != "", by_url).otherwise(F.concat(F.lit("txt:"), F.sha1(F.array_join(words, " "))))
