from __future__ import annotations

import random
import re

from siltstone.operators import detect as D


def plain(text):
    """Every pattern on the whole text."""
    out = {}
    for i, (_, _, pattern, _) in enumerate(D.RULES):
        if m := re.search(pattern, text, re.I | re.A):
            out[i] = (m[0], m[1] if m.re.groups else None)
    return out


def test_one_pass_finds_what_every_pattern_finds():
    rng = random.Random(3)
    scraps = [s for _, _, p, _ in D.RULES for s in re.sub(r"\\(.)", r"\1", p).split("|")] + ["WordPress 6.1", "wordpress\n", "bootstrap.css", "bootstrap.min.css", "bootstrap", "shopify.theme", "elementor-pro", "wp-content/themes/x/y", 'wp-content/themes/"', "İ", "ſ", "K", "é"]
    for _ in range(3000):
        text = "".join(rng.choice([str, str.upper, str.title])(rng.choice(scraps)) + rng.choice(["", " ", "-", "x"]) for _ in range(rng.randrange(8)))
        assert D.signs_of(text) == plain(text)
    assert D.signs_of("") == {}


def test_every_sign_has_a_literal_start():
    for _, _, pattern, _ in D.RULES:
        for sign in re.split(r"\|(?![^(]*\))", pattern):
            assert len(D.literal(sign)) >= 3


def test_sites_tell_evidence_of_their_first_page(spark):
    rows = [
        ("a", 1, '<meta name="generator" content="WordPress 6.4"><link href="/wp-content/themes/Mine/s.css">'),
        ("a", 0, "plain"),
        ("a", 2, '<div class="wp-block-x">WordPress 5</div> astra genesis'),
        ("b", 5, None),
        (None, 1, "<meta content='Magento 2' name=generator>"),
    ]
    pages = spark.createDataFrame(rows, "site string, place int, html string")
    got = {(r.site, r.kind, r.name): (r.evidence, r.version, r.first_page, r.rank) for r in D.detections(pages).collect()}
    assert got["a", "platform", "WordPress"] == ("WordPress 6.4", "6.4", 1, 1) and got["a", "framework", "Genesis"][2] == 2
    assert got["a", "builder", "Gutenberg"] == ("wp-block-", None, 2, 1) and got[None, "platform", "Magento"] == ("Magento", None, 1, 1)
    themes = {r.site: (r.active, r.framework, r.type, r.confidence, r.evidence) for r in D.themes(pages).collect()}
    assert themes["a"] == ("Mine", "Genesis", "block", 80, ["wp-content/themes/Mine", "Genesis", "block theme markers"]) and themes["b"] == (None, None, "unknown", 20, [])
    assert D.detections(pages.limit(0)).count() == 0
