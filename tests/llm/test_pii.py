from __future__ import annotations

import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from siltstone.llm import pii

TEXTS = [
    None, "", "mail a.b+c@x-y.org, or q@z", "ip 10.0.0.1 and 300.1.1.1 1.2.3.4.5.6.7.8", "card 4111 1111 1111 1111 or 4111-1111-1111-1112", "call +1 (555) 010-9999 now, +12",
    "a@b.c@d.e f@g.h+i@j.k", "1.2.3.4" * 3, "9" * 5000, "é ñ +34 600 123 456 é@é.com", "jane [at] example [dot] com", "jane at example dot com",
    "jаne@exаmple.com", "one nine two dot one six eight dot zero dot one", "same 1.1.1.1", "same 1.1.1.1", "plus one five five five zero one zero nine nine nine nine",
    "look at the dot on it", "j​ane@example.com", "card ４１１１ １１１１ １１１１ １１１１",
]


def brute(text):
    def luhn(d):
        s = 0
        for i, c in enumerate(reversed(d)):
            v = int(c) * (1 + i % 2)
            s += v - 9 if v > 9 else v
        return s % 10 == 0

    digits = lambda m: re.sub(r"[^0-9]", "", m.group())
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) < 256 for p in m.group().split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    ]
    return {k: [m.span() for m in re.finditer(p, text) if ok(m)] for k, p, ok in kinds}


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text("a1.@+- (é", max_size=40), st.text("0123456789 -+.", max_size=60), st.text("ab@.", max_size=30)))
def test_plain_spans_match_the_patterns(text):
    assert pii.detect(text) == brute(text)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_plain_spans_stay(text):
    base, every = pii.spans(text)
    assert base == brute(text)
    for kind, own in base.items():
        assert set(own) <= set(every[kind])


def test_disguises_map_back_to_the_source():
    want = {
        "jane [at] example [dot] com": "email", "jane at example dot com": "email", "jаne@exаmple.com": "email", "j​ane@example.com": "email",
        "one nine two dot one six eight dot zero dot one": "ip", "plus one five five five zero one zero nine nine nine nine": "phone", "４１１１ １１１１ １１１１ １１１１": "card",
    }
    for text, kind in want.items():
        for lead in ("", "é see: "):
            _, every = pii.spans(lead + text + " end")
            assert (len(lead), len(lead) + len(text)) in every[kind] and len(every[kind]) <= 2, (text, every)
            assert pii.mask(lead + text + " end") == lead + pii.MASKS[kind] + " end"


def test_said_addresses_of_all_endings():
    every = ("jane at example dot ru", "jane@example dot ru", "jane at example.com", "jane at mail dot example dot dev", "jane at example.co dot jp", "j.doe at example dot ca", "jane at example [dot] ai")
    for text in every:
        for lead, tail in (("", ""), ("Write to ", " today"), ("é: ", ".")):
            assert pii.mask(lead + text + tail) == lead + "<EMAIL>" + tail, (text, pii.mask(lead + text + tail))


def test_sentences_with_at_and_a_dot_are_left_alone():
    for text in ("look at the dot in it", "see more at example.com", "arrived at 9.30 today", "he was at version 2.1 dot on"):
        assert "<EMAIL>" not in pii.mask(text), text


def test_ordinary_words_are_left_alone():
    for text in ("look at the dot on it", "one two of three", "at home (at) last", "he arrived at noon dot", "zero or one"):
        _, every = pii.spans(text)
        assert not any(every.values()), text


def test_query_rows(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, spans string")
    for r in pii.find(docs).collect():
        base = brute(TEXTS[r.doc_id] or "")
        text = ",".join(f"{k}:{a}:{b}" for k in pii.KINDS for a, b in base[k])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(len(base[k]) for k in pii.KINDS)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert set(filter(None, text.split(","))) <= set(r.spans.split(","))
    assert pii.find(docs.limit(0)).count() == 0
    kept = pii.redact(docs).where("doc_id in (0, 5)").orderBy("doc_id").collect()
    assert kept[0].text is None and kept[1].text == "call <PHONE> now, +12"
