"""Personal data: plain identifiers, and disguised ones found through offset-preserving normalisation.

A text that shows a sign of disguise is rewritten by a chain of transducers
(look-alike letters and digits, invisible code points, at/dot disguises,
spelled digits).  Each keeps, for every code point that it writes, the source
span that it came from, so what the plain detectors find in the rewritten
text maps back to source code points.

Edge cases: a null text is empty; an empty text has no spans; texts of any
length are searched whole, in linear time; a source span inside a plain span
of its kind is not added, a wider one is; repeated rows are judged alike; other columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.endings import ENDINGS

KINDS = ("email", "ip", "card", "phone")
SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
MASKS = {k: f"<{k.upper()}>" for k in KINDS}

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# started at the first digit of a run only: a later start in the run fails as the first does
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Letters of other scripts that look like Latin ones.
LOOKALIKES = {
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "α": "a", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "χ": "x",
}
# Code points that do not show.
INVISIBLE = "­​‌‍‎‏⁠﻿"
# Spelled digits, and the words for the signs.
DIGITS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
    "zéro": "0", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
}
AT_WORDS = "at|arroba|arobase|ät"
DOT_WORDS = "dot|punto|punkt|point"


@lru_cache(1)
def folded() -> dict[int, str]:
    """Code point to its ASCII look-alike: the table above, digits of all scripts, and compatible forms."""
    out = {ord(k): v for k, v in LOOKALIKES.items()}
    for c in range(128, sys.maxunicode + 1):
        if c in out or 0xD800 <= c < 0xE000:
            continue
        ch = chr(c)
        if unicodedata.category(ch) == "Nd":
            out[c] = str(unicodedata.digit(ch))
        elif 0xFF01 <= c <= 0xFF5E or 0x1D400 <= c <= 0x1D7FF or c in (0xFE52, 0xFE6B):
            plain = unicodedata.normalize("NFKC", ch)
            if len(plain) == 1 and plain.isascii():
                out[c] = plain
    return out


def _any_of(points: list[int]) -> str:
    """A character class of code points, as ranges."""
    runs: list[list[int]] = []
    for p in sorted(points):
        if runs and runs[-1][1] == p - 1:
            runs[-1][1] = p
        else:
            runs.append([p, p])
    return "[" + "".join(re.escape(chr(a)) if a == b else f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in runs) + "]"


# Words that an address said in words does not begin or end with, as they stand in sentences.
BEFORE_AT = frozenset(
    "look looks looked looking it me us him her them you one all more here there not only also still even is are was were be been arrive arrived arrives stay stayed live lives meet met shop visit buy find found"
    " available online site website page pages read see start starts started time times day home work school best least most first last sold based located hosted register sign up out back down over in on and or".split()
)
OPENERS = frozenset("the a an this that these those his her its our your their my no any each every el la los las un una le les der die das ein eine o os as".split())
AFTER_DOT = frozenset("in it is as so to no at be me my us am do".split())
CLOSERS = frozenset("on the and or an of by if up we he she they you your his her its our not but for from with was are were when then than that this which who".split())


_words = "|".join(sorted(DIGITS, key=len, reverse=True))
SPELLED = re.compile(rf"(?<!\w)(?:(?:plus|{_words})(?:[\s,]+|-|\s*(?:\.|(?<!\w)(?:{DOT_WORDS})(?!\w))\s*)){{3,}}(?:{_words})(?!\w)", re.I)
SPELLED_PART = re.compile(rf"({_words})|(plus)|(\.|{DOT_WORDS})|[\s,-]+", re.I)
OPEN, SHUT = r"[\[({<]", r"[\])}>]"
BRACKETED = re.compile(rf"\s*{OPEN}\s*(?:({AT_WORDS}|@)|({DOT_WORDS}|\.))\s*{SHUT}\s*", re.I)
SAID = re.compile(rf"(?<![A-Za-z0-9._%+-])([A-Za-z0-9._%+-]+)(\s+(?:{AT_WORDS})\s+|@)([A-Za-z0-9-]+(?:(?:\s+(?:{DOT_WORDS})\s+|\.)[A-Za-z0-9-]+)+)(?![\w-])", re.I)
SAID_DOT = re.compile(rf"\s+(?:{DOT_WORDS})\s+|\.", re.I)

SIGN_DISGUISE = re.compile(rf"{OPEN}\s*(?:{AT_WORDS}|{DOT_WORDS}|@|\.)\s*{SHUT}")
SIGN_DOT = re.compile(rf"\s(?:{DOT_WORDS})\s")
SIGN_AT = re.compile(rf"[a-z0-9._%+-]\s+(?:{AT_WORDS})\s+[a-z0-9-]+\.[a-z0-9]")
SIGN_SPELLED = re.compile(rf"(?:{_words})(?:[\s,.-]+(?:{DOT_WORDS})?[\s,.-]*)(?:{_words})(?:[\s,.-]+(?:{DOT_WORDS})?[\s,.-]*)(?:{_words})")


@lru_cache(1)
def sign_folded() -> re.Pattern:
    return re.compile(_any_of([*folded(), *map(ord, INVISIBLE)]))


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of EMAIL; each holds an @, so only the runs before an @ are tried."""
    out, past, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > past and text[start - 1] in LOCAL:
            start -= 1
        m = EMAIL.match(text, start) if start < at else None
        if m:
            out.append(m.span())
        past = m.end() if m else at + 1
        at = text.find("@", past)
    return out


def luhn(digits: str) -> bool:
    twice = [sum(divmod(2 * int(d), 10)) for d in digits[-2::-2]]
    return (sum(twice) + sum(map(int, digits[-1::-2]))) % 10 == 0


def detect(text: str) -> dict[str, list[tuple[int, int]]]:
    """The plain identifiers of a text by kind, in order."""
    out: dict[str, list[tuple[int, int]]] = {"email": emails(text), "ip": [], "card": [], "phone": []}
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out["ip"].append(m.span())
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out["card"].append(m.span())
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c in "0123456789" for c in m.group()) <= 15:
                out["phone"].append(m.span())
    return out


class Rewritten:
    """A text with the source span of each of its code points."""

    def __init__(self, text: str):
        self.text, self.begin, self.end = text, list(range(len(text))), list(range(1, len(text) + 1))

    def put(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace ordered, disjoint spans; what is written stands for the whole span replaced."""
        if not edits:
            return
        parts, begin, end, at = [], [], [], 0
        for a, b, new in edits:
            parts += [self.text[at:a], new]
            begin += self.begin[at:a] + [self.begin[a]] * len(new)
            end += self.end[at:a] + [self.end[b - 1]] * len(new)
            at = b
        self.text = "".join([*parts, self.text[at:]])
        self.begin, self.end = begin + self.begin[at:], end + self.end[at:]


def normalise(text: str) -> Rewritten:
    """Undo disguises: look-alikes, invisible code points, spelled digits, bracketed and spoken at/dot."""
    out, table = Rewritten(text), folded()
    out.put([(m.start(), m.end(), table.get(ord(m.group()), "")) for m in sign_folded().finditer(out.text)])
    edits = []
    for m in SPELLED.finditer(out.text):
        for x in SPELLED_PART.finditer(out.text, m.start(), m.end()):
            edits.append((x.start(), x.end(), DIGITS[x[1].lower()] if x[1] else "+" if x[2] else "." if x[3] else ""))
    out.put(edits)
    out.put([(m.start(), m.end(), "@" if m[1] else ".") for m in BRACKETED.finditer(out.text)])
    edits = []
    for m in SAID.finditer(out.text):
        dots = _dots(m, out.text)
        if m[2] != "@" and dots:
            edits.append((*m.span(2), "@"))
        edits += [(*x.span(), ".") for x in dots if x.group() != "."]
    out.put(edits)
    return out


def _dots(m: re.Match, text: str) -> list[re.Match]:
    """The dots of an address said in words, up to the last label that can end it; none if none can.

    Where at and a dot are both said, any word of letters can; else a top-level domain.
    """
    dots, said = list(SAID_DOT.finditer(text, *m.span(3))), m[2] != "@"
    opened = said and text[m.start(3) : dots[0].start()].lower() in OPENERS
    ends = [x.start() for x in dots[1:]] + [m.end(3)]
    while dots:
        last = text[dots[-1].end() : ends[len(dots) - 1]].lower()
        spoken = any(x.group() != "." for x in dots)
        if said and spoken:
            fits = len(last) >= 2 and last.isalpha() and last not in CLOSERS
        else:
            fits = last in ENDINGS and not (said and m[1].lower() in BEFORE_AT)
        if fits and not (opened and last in AFTER_DOT):
            return dots
        dots.pop()
    return []


def disguised(text: str) -> bool:
    """Whether a transducer may have something to rewrite."""
    if not text.isascii() and sign_folded().search(text):
        return True
    low = text.lower()
    return bool(SIGN_DISGUISE.search(low) or SIGN_DOT.search(low) or SIGN_AT.search(low) or SIGN_SPELLED.search(low))


def spans(text: str) -> tuple[dict[str, list[tuple[int, int]]], dict[str, list[tuple[int, int]]]]:
    """Plain spans, and all spans with those found after normalising."""
    base = detect(text)
    if not disguised(text):
        return base, base
    seen = normalise(text)
    every = {}
    for kind, found in detect(seen.text).items():
        own = base[kind]
        new = [(seen.begin[a], seen.end[b - 1]) for a, b in found]
        every[kind] = sorted(own + [s for s in new if not any(a <= s[0] and s[1] <= b for a, b in own)])
    return base, every


def written(found: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in found[k])


def mask(text: str) -> str:
    """The text with each personal span replaced by its kind; of overlapping spans the first and longest counts."""
    _, every = spans(text)
    flat = sorted(((a, -b, k) for k in KINDS for a, b in every[k]))
    parts, at = [], 0
    for a, minus, kind in flat:
        if a >= at:
            parts += [text[at:a], MASKS[kind]]
            at = -minus
        elif -minus > at:
            at = -minus
    return "".join([*parts, text[at:]])


def find(docs: DataFrame) -> DataFrame:
    """Counts and spans of each row of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1):
                base, every = spans(text.as_py() or "")
                plain, whole = written(base), written(every)
                rows.append((*(len(base[k]) for k in KINDS), hashlib.sha256(plain.encode()).hexdigest(), whole, sum(len(every[k]) - len(base[k]) for k in KINDS)))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(run, SCHEMA)


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with its text masked; all columns stay, null texts too."""

    @F.pandas_udf("string")
    def masked(texts):
        return texts.map(lambda t: None if t is None else mask(t))

    return docs.withColumn("text", masked(F.col("text")))
