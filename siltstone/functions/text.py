"""Text, hash and number helpers as Spark column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Mime types by file extension.
MIME = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "webp": "image/webp", "gif": "image/gif", "avif": "image/avif", "svg": "image/svg+xml", "pdf": "application/pdf", "mp4": "video/mp4"}
# Seconds to wait before each further try.
RETRY_STEPS = (1, 2, 5, 10, 20, 30, 60)
# Accented letters and what they are without accents.
ACCENTED, PLAIN = "áàâäãåéèêëíìîïóòôöõúùûüñçýÿ", "aaaaaaeeeeiiiiooooouuuuncyy"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def collapsed(text: Column | str) -> Column:
    """White space (no-break space too) to single spaces, trimmed; null if nothing is left."""
    own = F.regexp_replace(_c(text), r"(?U)\s+", " ")
    return F.nullif(F.trim(own), F.lit(""))


def utf16_length(text: Column | str) -> Column:
    """Length in UTF-16 units, as limits on titles count it."""
    return (F.octet_length(F.encode(_c(text), "UTF-16LE")) / 2).cast("int")


def stable_id(prefix: str, value: Column | str) -> Column:
    slug = F.regexp_replace(F.regexp_replace(F.lower(_c(value)), "[^a-z0-9]+", "-"), "^-|-$", "")
    return F.concat(F.lit(f"{prefix}:"), F.substring(slug, 1, 80))


def folded(text: Column | str) -> Column:
    """Lower case without the accents of Latin letters."""
    return F.translate(F.lower(_c(text)), ACCENTED, PLAIN)


def slug(text: Column | str, limit: int, otherwise: str, fold: bool = True) -> Column:
    """Words of letters and digits joined by dashes, cut to ``limit``."""
    own = folded(text) if fold else F.lower(_c(text))
    own = F.substring(F.regexp_replace(F.regexp_replace(own, "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, limit)
    return F.coalesce(F.nullif(own, F.lit("")), F.lit(otherwise))


def path_slug(path: Column | str) -> Column:
    """The parts of a path joined by dashes; the root is ``home``."""
    parts = F.filter(F.split(_c(path), "/"), lambda x: x != "")
    return F.coalesce(F.nullif(F.array_join(parts, "-"), F.lit("")), F.lit("home"))


def base36(value: Column) -> Column:
    return F.lower(F.conv(value.cast("string"), 10, 36))


def fnv1a(text: Column | str) -> Column:
    """32-bit FNV-1a over code points (the first UTF-16 unit of each), in base 36."""
    points = F.transform(F.split(_c(text), ""), lambda x: F.when(F.octet_length(F.encode(x, "UTF-16LE")) > 2, F.lit(0xD7C0) + F.floor(_code_point(x) / 1024)).otherwise(_code_point(x)))
    points = F.filter(points, lambda x: x.isNotNull())
    mask = F.lit(0xFFFFFFFF).cast("long")
    step = lambda h, p: (h.bitwiseXOR(p.cast("long")) * F.lit(0x01000193).cast("long")).bitwiseAND(mask)
    return base36(F.aggregate(points, F.lit(0x811C9DC5).cast("long"), step))


def _code_point(x: Column) -> Column:
    """The code point of a one-character string."""
    return F.conv(F.hex(F.encode(x, "UTF-32")), 16, 10).cast("long")


def hash31(text: Column | str) -> Column:
    """Signed 32-bit hash with the factor 31 over bytes, in base 36 with its sign."""
    pairs = F.filter(F.regexp_extract_all(F.hex(F.encode(_c(text), "UTF-8")), F.lit("(..)"), 1), lambda x: x != "")
    step = lambda h, x: F.shiftright(F.shiftleft(h * 31 + F.conv(x, 16, 10).cast("long"), 32), 32)
    value = F.aggregate(pairs, F.lit(0).cast("long"), step)
    return F.concat(F.when(value < 0, F.lit("-")).otherwise(F.lit("")), base36(F.abs(value)))


def short_digest(text: Column | str) -> Column:
    return F.substring(F.sha2(_c(text), 256), 1, 16)


def trimmed_to(text: Column | str, n: int) -> Column:
    """At most ``n`` characters, cut at the last white space before that where there is one."""
    own = _c(text)
    cut = F.trim(F.regexp_replace(F.substring(own, 1, n + 1), r"\s+\S*$", ""))
    return F.when(F.length(own) <= n, own).otherwise(F.substring(cut, 1, n))


def html_escaped(text: Column | str) -> Column:
    own = _c(text)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        own = F.replace(own, F.lit(a), F.lit(b))
    return own


def csv_cell(value: Column | str) -> Column:
    """A quoted cell, quotes doubled; null is empty."""
    return F.concat(F.lit('"'), F.replace(F.coalesce(_c(value).cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))


def masked_fragment(html: Column | str) -> Column:
    """A fragment's key: URLs and numbers masked, first 600 characters."""
    own = F.regexp_replace(_c(html), r"https?://[^\s\"'<>]+", "{url}")
    own = F.regexp_replace(F.regexp_replace(own, "[0-9]+", "{n}"), r"\s+", " ")
    return F.substring(own, 1, 600)


def mime_type(ext: Column | str) -> Column:
    table = F.create_map(*[F.lit(x) for pair in MIME.items() for x in pair])
    return F.element_at(table, _c(ext))


def srcset_urls(srcset: Column | str) -> Column:
    return F.filter(F.transform(F.split(_c(srcset), ","), lambda x: F.regexp_extract(F.trim(x), r"^(\S+)", 1)), lambda x: x != "")


def phone_digits(phone: Column | str) -> Column:
    """Digits without a leading 00; nine digits get the country's 34."""
    own = F.regexp_replace(F.regexp_replace(_c(phone), "[^0-9]", ""), "^00", "")
    return F.when(F.length(own) == 9, F.concat(F.lit("34"), own)).otherwise(own)


def postal_code(address: Column | str) -> Column:
    return F.nullif(F.regexp_extract(_c(address), r"\b([0-9]{5})\b", 1), F.lit(""))


def city(address: Column | str) -> Column:
    """What follows the postal code, up to a comma."""
    return F.nullif(F.trim(F.regexp_extract(_c(address), r"\b[0-9]{5}\s+([^,]+)", 1)), F.lit(""))


def version_key(version: Column | str) -> Column:
    """major, minor and patch as a struct that sorts; null if it is none."""
    parts = F.split(F.regexp_replace(_c(version), "^v", ""), r"\.")
    ok = _c(version).rlike(r"^v?[0-9]+\.[0-9]+\.[0-9]+$")
    return F.when(ok, F.struct(*[F.get(parts, i).cast("int").alias(n) for i, n in enumerate(("major", "minor", "patch"))]))


def backoff_ms(attempt: Column | str, base_ms: int) -> Column:
    return (F.lit(base_ms) * F.pow(F.lit(2.0), _c(attempt) - 1)).cast("long")


def retry_step_ms(attempt: Column | str) -> Column:
    steps = F.array(*[F.lit(1000 * s) for s in RETRY_STEPS])
    return F.element_at(steps, F.least(F.greatest(_c(attempt), F.lit(1)), F.lit(len(RETRY_STEPS))))


def liveness(silent_ms: Column | str, limit_ms: int = 600_000) -> Column:
    return F.when(_c(silent_ms) > limit_ms, F.lit("slow_or_blocked")).otherwise(F.lit("active"))


def duration_label(seconds: Column | str) -> Column:
    own = _c(seconds).cast("long")
    hours, minutes = F.floor(own / 3600), F.floor(own % 3600 / 60)
    text = lambda *parts: F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.when(hours > 0, text(hours, "h ", minutes, "min")).when(minutes > 0, text(minutes, "min ", own % 60, "s")).otherwise(text(own, "s"))


def clamped(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))
