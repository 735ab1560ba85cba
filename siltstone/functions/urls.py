"""URL algebra as Spark column expressions.

Five different normal forms are in use, for different ends: a link resolved
against its page, the canonical form (tracking removed), the equivalence key
(identity parameters only), the pattern key (shape of path and parameters),
and the resolved form that keeps all parameters.  All are built-in functions.
Parameters keep the encoding they came with.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parameters that only track, for links and (wider) for canonical forms.
LINK_TRACKING = ("fbclid", "gclid", "msclkid", "_ga", "_gl", "ref", "source", "session", "tracking")
TRACKING = (*LINK_TRACKING, "sid", "sessionid", "phpsessid", "jsessionid", "aspsessionid")
# Parameters that name a resource.
IDENTITY = ("id", "product_id", "sku", "slug", "handle", "item")
# Parameters that select within a page.
FUNCTIONAL = ("page", "offset", "cursor", "collection", "category", "tag", "sort", "price", "color", "size", "brand", "vendor", "search", "q")
# File extensions by kind of asset.
ASSETS = {
    "image": ("jpg", "jpeg", "png", "gif", "webp", "avif", "svg", "ico", "bmp", "tif", "tiff", "heic", "heif"),
    "font": ("woff", "woff2", "ttf", "otf", "eot"),
    "stylesheet": ("css",),
    "script": ("js", "mjs", "cjs", "map"),
    "media": ("mp4", "webm", "ogg", "ogv", "mov", "avi", "mkv", "m4v", "mp3", "wav", "flac", "aac", "m4a", "wmv"),
    "document": ("pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "csv", "rtf", "zip", "rar", "7z", "gz", "tar", "tgz", "dmg", "exe", "apk", "bin", "iso"),
}
# Kinds of pages by their path, in order, and how soon each kind is fetched.
KINDS = (
    ("Product", r"(/product|/item|/shop|/store)/"),
    ("Category", r"(/category|/cat)/"),
    ("Collection", r"(/collection|/coll)/"),
    ("Blog", r"(/blog|/news)/"),
    ("Legal", r"(/legal|/terms|/privacy)/"),
    ("LandingPage", r"(/landing|/home)/"),
)
PRIORITY = {"Product": 100, "Category": 90, "Collection": 80, "LandingPage": 70, "Blog": 60, "Legal": 50, "Secondary": 40, "Functional": 30, "Static": 20, "Unknown": 10, "Tracking": 5}
# Product routes in several languages.
PRODUCT_ROUTE = r"/(products?|productos?|produits?|produkte?|prodotti|item|shop/[^/]+)/[^/]+"

URL = r"^(?i)(https?)://([^/?#]+)([^?#]*)(\?[^#]*)?"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_http(url: Column | str) -> Column:
    """Whether a URL has the form of an http(s) address with a host."""
    return F.coalesce(_c(url).rlike(r"(?i)^https?://[^/?#\s]+"), F.lit(False))


def scheme(url: Column | str) -> Column:
    return F.lower(F.regexp_extract(_c(url), URL, 1))


def host(url: Column | str) -> Column:
    """Lower-case host with its port, unless that is the scheme's own."""
    return F.regexp_replace(F.lower(F.regexp_extract(_c(url), URL, 2)), r"(?<=[^:]):(80|443)$", "")


def path(url: Column | str) -> Column:
    own = F.regexp_extract(_c(url), URL, 3)
    return F.when(own == "", F.lit("/")).otherwise(own)


def query(url: Column | str) -> Column:
    """The query without its question mark."""
    return F.regexp_replace(F.regexp_extract(_c(url), URL, 4), r"^\?", "")


def origin(url: Column | str) -> Column:
    return F.concat(scheme(url), F.lit("://"), host(url))


def trimmed_path(url: Column | str) -> Column:
    """The path without one closing slash; the root keeps it."""
    own = path(url)
    return F.when(own == "/", own).otherwise(F.regexp_replace(own, "/$", ""))


def param_key(param: Column) -> Column:
    return F.regexp_replace(param, "=.*$", "")


def is_tracking(key: Column, names: tuple[str, ...] = TRACKING) -> Column:
    low = F.lower(key)
    return low.startswith("utm_") | low.isin(*names)


def params(url: Column | str) -> Column:
    """The parameters as ``key=value``, in order."""
    return F.transform(F.filter(F.split(query(url), "&"), lambda x: x != ""), lambda x: F.when(x.contains("="), x).otherwise(F.concat(x, F.lit("="))))


def _sorted(own: Column) -> Column:
    """Parameters by key, those of one key in their order."""
    keyed = F.transform(own, lambda x, i: F.struct(param_key(x).alias("k"), i.alias("i"), x.alias("p")))
    return F.transform(F.array_sort(keyed), lambda x: x["p"])


def _joined(url: Column | str, own: Column, keep_root: bool = False) -> Column:
    at = trimmed_path(url)
    tail = F.when(F.size(own) > 0, F.concat(at, F.lit("?"), F.array_join(own, "&"))).when((at == "/") & F.lit(not keep_root), F.lit("")).otherwise(at)
    return F.concat(origin(url), tail)


def normalized(url: Column | str) -> Column:
    """A resolved link without fragment and tracking parameters, null unless http(s)."""
    return F.when(is_http(url), _joined(url, _sorted(F.filter(params(url), lambda x: ~is_tracking(param_key(x), LINK_TRACKING)))))


def canonical(url: Column | str) -> Column:
    """The form by which exact duplicates are known; what is no URL stays as it is."""
    return F.when(is_http(url), _joined(url, _sorted(F.filter(params(url), lambda x: ~is_tracking(param_key(x)))))).otherwise(_c(url))


def equivalence_key(url: Column | str) -> Column:
    """Path and identity parameters; of a repeated one, the last value at the place of the first."""
    own = _sorted(F.filter(params(url), lambda x: F.lower(param_key(x)).isin(*IDENTITY)))
    keys = F.array_distinct(F.transform(own, param_key))
    last = F.transform(keys, lambda k: F.try_element_at(F.filter(own, lambda x: param_key(x) == k), F.lit(-1)))
    return F.when(is_http(url), _joined(url, last)).otherwise(_c(url))


def pattern_key(url: Column | str) -> Column:
    """The shape of path and parameters, on any host."""
    parts = F.filter(F.split(F.lower(path(url)), "/"), lambda x: x != "")
    parts = F.transform(parts, lambda x: F.when(x.rlike(r"^[0-9]+$"), F.lit(":id")).otherwise(x))
    at = F.when(F.size(parts) > 0, F.concat(F.lit("/"), F.array_join(parts, "/"), F.lit("/*"))).otherwise(F.lit("/"))
    keys = F.array_sort(F.filter(F.transform(params(url), lambda x: F.lower(param_key(x))), lambda k: ~is_tracking(k)))
    shape = F.array_join(F.transform(keys, lambda k: F.concat(k, F.lit("=*"))), "&")
    return F.when(is_http(url), F.when(F.size(keys) > 0, F.concat(at, F.lit("?"), shape)).otherwise(at)).otherwise(_c(url))


def kind(url: Column | str) -> Column:
    """What sort of page a URL seems to lead to; the first rule that fits."""
    at, out = F.lower(path(url)), F.when(~is_http(url), F.lit("Unknown"))
    for name, pattern in KINDS:
        out = out.when(at.rlike(pattern), F.lit(name))
    keys = F.transform(params(url), lambda x: F.lower(param_key(x)))
    out = out.when(F.exists(keys, lambda k: is_tracking(k, LINK_TRACKING)), F.lit("Tracking"))
    return out.when(F.exists(keys, lambda k: k.isin(*FUNCTIONAL)), F.lit("Functional")).otherwise(F.lit("Static"))


def priority(of_kind: Column | str) -> Column:
    table = F.create_map(*[F.lit(x) for pair in PRIORITY.items() for x in pair])
    return F.coalesce(F.element_at(table, _c(of_kind)), F.lit(0))


def adjusted_priority(of_kind: Column | str, demoted: Column) -> Column:
    """The priority, 50 less (not below 1) where the crawl is to hold back."""
    return F.when(demoted, F.greatest(priority(of_kind) - 50, F.lit(1))).otherwise(priority(of_kind))


def extension(url: Column | str) -> Column:
    """The file extension of the last part of the path; a dot that begins it does not count."""
    last = F.try_element_at(F.filter(F.split(path(url), "/"), lambda x: x != ""), F.lit(-1))
    return F.when(is_http(url) & last.rlike(r"^.+\.[^.]*$"), F.lower(F.regexp_extract(last, r"\.([^.]*)$", 1)))


def asset_type(url: Column | str) -> Column:
    ext = extension(url)
    out = F.when(ext.isNull(), F.lit("other"))
    for name, own in ASSETS.items():
        out = out.when(ext.isin(*own), F.lit(name))
    return out.otherwise(F.lit("other"))


def is_asset(url: Column | str) -> Column:
    return F.coalesce(extension(url).isin(*[x for own in ASSETS.values() for x in own]), F.lit(False))


def resolved(link: Column | str, base: Column | str) -> Column:
    """A link made absolute against its page: schemes, hosts, roots, queries, fragments and dot segments."""
    raw, folder = F.trim(_c(link)), F.regexp_replace(path(base), "[^/]*$", "")
    full = (
        F.when(raw.rlike(r"(?i)^https?://"), raw)
        .when(raw.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), raw)
        .when(raw.startswith("//"), F.concat(scheme(base), F.lit(":"), raw))
        .when(raw.startswith("/"), F.concat(origin(base), raw))
        .when(raw.startswith("?"), F.concat(origin(base), path(base), raw))
        .when((raw == "") | raw.startswith("#"), F.concat(origin(base), path(base), F.when(query(base) != "", F.concat(F.lit("?"), query(base))).otherwise(F.lit("")), raw))
        .otherwise(F.concat(origin(base), folder, raw))
    )
    parts = F.split(path(full), "/")
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda held, x: F.when(x == ".", held).when(x == "..", F.when(F.size(held) > 1, F.slice(held, 1, F.size(held) - 1)).otherwise(held)).otherwise(F.array_append(held, x)),
    )
    closed = F.when(F.try_element_at(parts, F.lit(-1)).isin(".", ".."), F.lit("/")).otherwise(F.lit(""))
    rest = F.regexp_extract(full, r"^(?i)https?://[^/?#]+[^?#]*(.*)$", 1)
    clean = F.concat(origin(full), F.concat(F.array_join(kept, "/"), closed), rest)
    return F.when(is_http(full) & full.rlike(r"^(?i)https?://[^/?#]+[^?#]*/\.\.?(/|$|[?#])"), clean).otherwise(full)


def resolved_href(link: Column | str, base: Column | str) -> Column:
    """The parser's form of a link: no script, mail or phone links, parameters sorted and kept, the root with its slash."""
    raw, full = F.trim(_c(link)), resolved(link, base)
    kept = ~raw.rlike(r"(?i)^(javascript|mailto|tel):") & is_http(full)
    return F.when(kept, _joined(full, _sorted(params(full)), keep_root=True))


def without_fragment(link: Column | str, base: Column | str) -> Column:
    return F.regexp_replace(resolved(link, base), "#.*$", "")


def same_site(url: Column | str, allowed: list[str]) -> Column:
    """Whether host or origin is allowed."""
    return F.regexp_replace(host(url), ":[0-9]+$", "").isin(*allowed) | origin(url).isin(*allowed)


def commerce_key(url: Column | str) -> Column:
    """A product's URL as a key: lower case, no query, fragment or closing slashes."""
    return F.lower(F.regexp_replace(F.regexp_replace(_c(url), r"[?#].*$", ""), r"/+$", ""))


def product_key(url: Column | str) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(_c(url), r"[?#].*$", ""), r"/$", ""))


def site_key(url: Column | str) -> Column:
    """A site by its address: host without ``www.`` and path without closing slash."""
    return F.lower(F.concat(F.regexp_replace(host(url), r"^www\.", ""), F.regexp_replace(path(url), r"/+$", "")))


def replay_path(at: Column | str) -> Column:
    """A path with one slash at both ends."""
    own = F.regexp_replace(F.regexp_replace(_c(at), r"[?#].*$", ""), r"^/+|/+$", "")
    return F.when(own == "", F.lit("/")).otherwise(F.concat(F.lit("/"), own, F.lit("/")))


def ancestors(at: Column | str) -> Column:
    """The paths above a path: of /a/b/c these are /a and /a/b."""
    parts = F.filter(F.split(_c(at), "/"), lambda x: x != "")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, i), "/")))).otherwise(F.array().cast("array<string>"))


def is_product_route(url: Column | str) -> Column:
    return F.lower(path(url)).rlike(PRODUCT_ROUTE)


def safe_zip_path(at: Column | str) -> Column:
    """A relative path without drive, leading slashes and parent steps."""
    own = F.regexp_replace(F.regexp_replace(_c(at), r"\\", "/"), r"^([A-Za-z]:)?/+", "")
    return F.array_join(F.filter(F.split(own, "/"), lambda x: ~x.isin("", ".", "..")), "/")
