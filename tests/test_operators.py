from __future__ import annotations

import json
import random

from pyspark.sql import functions as F

from siltstone.functions import urls as U
from siltstone.operators import catalog as C
from siltstone.operators import detect, dom, frontier, gates, graph, rules, telemetry


# --- rules --------------------------------------------------------------------------------------------------------

GOOD = """<html><head><title>A title of a proper length</title><meta name="description" content="%s"><link rel="canonical" href="https://x.com/a">%s</head><body><h1>H</h1>%s</body></html>""" % (
    "d" * 100, "".join(f'<meta property="{p}" content="x">' for p in ("og:title", "og:description", "og:image", "twitter:card", "twitter:title", "twitter:description")), "word " * 300)
BAD = '<title>short</title><body><h1>a</h1><h1>b</h1><img src="x.png"><img alt="y" src="data:image/png;base64,%s"><meta name="robots" content="noindex, nofollow">few words</body>' % ("A" * 400_000)


def judged(spark):
    rows = [
        (0, "https://x.com/a", "https://x.com/a", 200, 10, 0, GOOD), (1, "https://x.com/b", "https://x.com/c", 301, 2000, 2, BAD), (2, "https://x.com/d", "https://x.com/d", 500, None, None, None),
        (3, "https://x.com/" + "e" * 120, None, 404, None, None, GOOD),
    ]
    frame = spark.createDataFrame(rows, "place int, url string, final_url string, status_code int, response_ms int, broken_links int, html string")
    return rules.page_issues(rules.features(frame))


def test_page_rules(spark):
    codes = {r.place: [x.code for x in r.issues] for r in judged(spark).collect()}
    assert codes[0] == []
    assert codes[1] == ["TITLE_LENGTH", "DESCRIPTION_MISSING", "CANONICAL_MISSING", "REDIRECT", "H1_MULTIPLE", "OPEN_GRAPH_INCOMPLETE", "TWITTER_CARD_INCOMPLETE", "IMAGES_WITHOUT_ALT", "HEAVY_IMAGES", "BROKEN_LINKS", "NOINDEX", "NOFOLLOW", "THIN_CONTENT", "SLOW_RESPONSE"]
    assert codes[2][:4] == ["TITLE_MISSING", "DESCRIPTION_MISSING", "CANONICAL_MISSING", "HTTP_5XX"]
    assert codes[3] == ["CANONICAL_INCORRECT", "URL_TOO_LONG", "HTTP_4XX"]


def test_scores_and_summaries(spark):
    own = judged(spark).withColumn("host", U.host("url")).cache()
    row = rules.site_scores(own, "host").first()
    assert row.pages == 4 and row.score == max(0, 100 - row.penalty) and row.penalty == 8 * row.critical + 3 * row.warning + row.info
    # two pages have one title and one description: two global warnings
    long = rules.issues_long(own)
    assert rules.severity_counts(long).first().warning + 2 == row.warning
    counts = {r.code: (r.n, r.critical) for r in rules.issue_counts(long).collect()}
    assert counts["DESCRIPTION_MISSING"] == (2, True) and "NOINDEX" not in counts
    total = rules.summary(own).first()
    assert (total.pages, total.valid, total.broken, total.redirects, total.broken_links, total.without_title, total.noindex, total.thin) == (4, 2, 2, 1, 2, 1, 1, 1)
    sites = spark.createDataFrame([("x.com",), ("empty.com",)], "host string")
    scored = {r.host: (r.score, r.reason) for r in rules.with_empty_capture(rules.site_scores(own, "host"), sites, "host").collect()}
    assert scored["empty.com"] == (0, "EMPTY_CAPTURE_EXPORT")


def test_broken_links_use_the_last_page_of_an_address(spark):
    pages = spark.createDataFrame([(0, "https://x.com", "https://x.com", 404), (1, "https://x.com/r", "https://x.com", 200), (2, "https://x.com/b", None, 410)], "place int, url string, final_url string, status_code int")
    links = spark.createDataFrame([("p", "https://x.com"), ("p", "https://x.com/b"), ("p", "https://x.com/b#f")], "page_url string, target string")
    assert [r.target for r in rules.broken_links(links, pages).collect()] == ["https://x.com/b"]


# --- frontier -----------------------------------------------------------------------------------------------------


def admitted_by_loop(urls, allowed, cap, barred=()):
    """Admission by a plain loop over known keys."""
    canonical, equivalence, patterns, out = set(), set(), {}, []
    for url, (norm, canon, equi, pattern, asset) in urls:
        if norm is None:
            out.append("invalid")
        elif asset:
            out.append("asset")
        elif canon in canonical:
            out.append("duplicate")
        elif equi in equivalence:
            out.append("equivalent")
        elif patterns.get(pattern, 0) >= cap:
            out.append("pattern_cap")
        elif not any(f"://{a}" in norm for a in allowed):
            out.append("domain")
        elif any(b in norm for b in barred):
            out.append("robots")
        else:
            canonical.add(canon)
            equivalence.add(equi)
            patterns[pattern] = patterns.get(pattern, 0) + 1
            out.append(None)
    return out


def test_admission_matches_a_loop(spark):
    rng = random.Random(4)
    for seed in range(3):
        rng.seed(seed)
        urls = []
        for _ in range(150):
            host, path = rng.choice(["x.com", "x.com", "y.com"]), rng.choice(["/a", "/b/1", "/b/2", "/b/3", "/b/4", "/private/z", "/i.png", "/", "/c"])
            urls.append(f"https://{host}{path}" + rng.choice(["", "", "?utm_a=1", "?sort=x", "?id=1", "?id=2", "#f"]))
        urls += ["mailto:a@b", ""]
        frame = spark.createDataFrame(list(enumerate(urls)), "seq long, url string")
        keys = frame.select("seq", "url", U.normalized("url").alias("n")).select("seq", "url", "n", U.canonical("n").alias("c"), U.equivalence_key("n").alias("e"), U.pattern_key("n").alias("p"), U.is_asset("n").alias("a")).orderBy("seq").collect()
        robots = frontier.robots_rules(spark.createDataFrame([("https://x.com", "User-agent: *\nDisallow: /private\n")], "origin string, body string"))
        got = [r.reject_reason for r in frontier.admission(frame, ["x.com"], robots=robots, cap=2).orderBy("seq").collect()]
        assert got == admitted_by_loop([(k.url, (k.n, k.c, k.e, k.p, k.a)) for k in keys], ["x.com"], 2, ["x.com/private"])


def test_admission_after_what_is_known(spark):
    frame = spark.createDataFrame([(1, "https://x.com/a?utm_x=1"), (2, "https://x.com/a?sort=1"), (3, "https://x.com/c/3"), (4, "https://x.com/c/4")], "seq long, url string")
    known = spark.createDataFrame([("https://x.com/a",), ("https://x.com/c/1",)], "url string")
    assert [r.reject_reason for r in frontier.admission(frame, [], accepted=known, cap=2).orderBy("seq").collect()] == ["duplicate", "equivalent", None, "pattern_cap"]


def test_robots(spark):
    body = "User-agent: other\nDisallow: /\nUser-agent: *\nDisallow: /a\nAllow: /a/b\nDisallow:\n# Disallow: /c"
    got = frontier.robots_rules(spark.createDataFrame([("o", body)], "origin string, body string")).collect()
    assert sorted((r.allow, r.prefix) for r in got) == [(False, "/a"), (True, "/a/b")]
    links = spark.createDataFrame([(i, f"https://x.com{p}") for i, p in enumerate(["/a", "/a/b/c", "/c", "/ab"])], "seq long, normalized string")
    own = frontier.robots_rules(spark.createDataFrame([("https://x.com", body)], "origin string, body string"))
    assert sorted(r.seq for r in frontier.blocked_by_robots(links, own).collect()) == [0, 3]


def test_breadth_first_and_closure(spark):
    edges = spark.createDataFrame([("a", 0, "b"), ("a", 1, "c"), ("b", 0, "d"), ("c", 0, "d"), ("d", 0, "a"), ("d", 1, "e")], "source string, place int, target string")
    start = spark.createDataFrame([("a",)], "url string")
    rows = sorted((r.found, r.url, r.depth) for r in frontier.breadth_first(start, edges, 10).collect())
    assert rows == [(1, "a", 0), (2, "b", 1), (3, "c", 1), (4, "d", 2), (5, "e", 3)]
    assert {r.url for r in frontier.breadth_first(start, edges, 2).collect()} == {"a", "b"}
    assert {r.url for r in frontier.dependency_closure(start, edges, passes=2).collect()} == {"a", "b", "c", "d"}
    assert {r.url for r in frontier.dependency_closure(start, edges).collect()} == set("abcde")


def test_last_wins_and_content_duplicates(spark):
    rows = spark.createDataFrame([("k", 1, "a"), ("k", 2, "b"), ("j", 1, "c")], "key string, n int, v string")
    assert sorted(r.v for r in frontier.last_wins(rows, "key", "n").collect()) == ["b", "c"]
    pages = spark.createDataFrame([(1, "T  a", "c", 2), (2, "t a", "C ", 2), (3, "t a", None, 2)], "place int, title string, canonical string, n_links int")
    assert [r.published for r in frontier.content_duplicates(pages, "place").orderBy("place").collect()] == [True, False, True]


def test_robots_index_against_every_rule(spark, monkeypatch):
    from siltstone.operators import joins

    rng = random.Random(8)
    part = lambda: "/" + "".join(rng.choice("aé") for _ in range(rng.randrange(6)))
    rules = [(rng.choice(["https://a.com", "https://b.com"]), rng.random() < 0.3, part()) for _ in range(60)]
    links = [(i, rng.choice(["https://a.com", "https://b.com", "https://c.com"]) + part() + rng.choice(["", "?q=/a"])) for i in range(400)] + [(1000, "no address"), (1001, None), (1002, "https://a.com")]
    want = set()
    for seq, url in links:
        if url and url.startswith("https"):
            origin, at = url[:13], url[13:].split("?")[0] or "/"
            met = {allow for o, allow, prefix in rules if o == origin and at.startswith(prefix)}
            want |= {seq} if met == {False} else set()
    frames = spark.createDataFrame(links, "seq long, normalized string"), spark.createDataFrame(rules + rules[:5], "origin string, allow boolean, prefix string")
    for small, least in ((100_000, 4096), (0, 1), (3, 4096)):
        for name, value in (("SMALL", small), ("LEAST", least), ("HOT", 4)):
            monkeypatch.setattr(joins, name, value)
        assert {r.seq for r in frontier.blocked_by_robots(*frames).collect()} == want
    index = frontier.robots_index(frames[1]).collect()
    assert not any(a.origin == b.origin and a.allow == b.allow and a.prefix != b.prefix and b.prefix.startswith(a.prefix) for a in index for b in index)


def test_connected_with_hot_ids_and_labels(spark, monkeypatch):
    from siltstone.operators import joins

    for name, value in (("SMALL", 2), ("LEAST", 5), ("HOT", 4)):
        monkeypatch.setattr(joins, name, value)
    edges = spark.createDataFrame([(0, i) for i in range(1, 60)] + [(100 + i, 101 + i) for i in range(9)], "a long, b long")
    got = {r.id: r.component for r in graph.connected(edges).collect()}
    assert got == {**{i: 0 for i in range(60)}, **{100 + i: 100 for i in range(10)}}


def test_connected(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (9, 8), (7, 9)], "a long, b long")
    assert {r.id: r.component for r in graph.connected(edges).collect()} == {5: 2, 4: 2, 3: 2, 2: 2, 9: 7, 8: 7, 7: 7}


# --- telemetry ----------------------------------------------------------------------------------------------------


def samples(spark, rows):
    return spark.createDataFrame([("r", i, q, k, d, p, 100, w) for i, (q, k, d, p, w) in enumerate(rows)], "run string, tick int, queue_size long, knowledge_size long, discovered long, processed long, memory_rss long, active_workers int")


def test_stability_verdicts(spark):
    same = (5, 5, 5, 5, 1)
    got = [r.verdict for r in telemetry.verdicts(samples(spark, [same] * 5), "run", "tick").orderBy("tick").collect()]
    assert got == ["continue"] * 3 + ["pause_discovery"] * 2
    moving = [(i + 1, i, i, i, 1) for i in range(4)] + [(0, 9, 9, 9, 0)]
    assert [r.verdict for r in telemetry.verdicts(samples(spark, moving), "run", "tick").orderBy("tick").collect()] == ["continue"] * 4 + ["complete"]
    assert "exhausted" in [r.verdict for r in telemetry.verdicts(samples(spark, [same] * 20), "run", "tick").collect()]


def test_concurrency(spark):
    steps = ["ok"] * 3 + ["limited", "limited"] + ["ok"] * 6
    rows = spark.createDataFrame([("r", i, s, False) for i, s in enumerate(steps)], "run string, n int, outcome string, in_cooldown boolean")
    assert [r.workers for r in telemetry.concurrency(rows, "run", "n", 8).orderBy("n").collect()] == [8, 8, 8, 4, 2, 2, 2, 3, 4, 5, 6]
    assert [r.workers for r in telemetry.concurrency(rows, "run", "n", 8, adaptive=False).orderBy("n").collect()][3:6] == [7, 6, 6]


def test_phases_retries_and_progress(spark):
    rows = spark.createDataFrame([("j", "a", "completed"), ("j", "b", "pending"), ("j", "c", "failed"), ("k", "a", "completed"), ("k", "b", "pending")], "job_id string, phase string, status string")
    assert {r.job_id: r.phase for r in telemetry.phase_to_resume(rows, ["a", "b", "c"]).collect()} == {"j": "c", "k": "b"}
    due = spark.createDataFrame([("u", 5, 1, 3), ("v", 50, 1, 3), ("w", 5, 3, 3)], "url string, next_attempt_at long, attempt int, max_attempts int")
    assert [r.state for r in telemetry.due_retries(due, 10).orderBy("url").collect()] == ["due", "waiting", "failed"]
    row = spark.range(1).select(telemetry.progress(F.lit(1), F.lit(3)).alias("a"), telemetry.build_progress(F.lit(6), F.lit(1), F.lit(6)).alias("b"), telemetry.remaining_ms(F.lit(1), F.lit(4), F.lit(10)).alias("c")).first()
    assert tuple(row) == (33, 99, 30)


# --- catalogue ----------------------------------------------------------------------------------------------------


def products(spark, rows):
    names = [c.split(": ")[0].split()[0] for c in ("site string", "seq long", "source_url string")] + list(C.FIELDS) + list(C.LISTS) + ["variants"]
    full = [tuple(r.get(n, "s" if n == "site" else "https://x.com/p" if n == "source_url" else [] if n in (*C.LISTS, "variants") else None) for n in names) for r in rows]
    return spark.createDataFrame(full, C.PRODUCT)


def variant(sku=None, **attributes):
    return {"id": None, "sku": sku, "price": None, "sale_price": None, "stock_status": None, "image": None, "attributes": attributes}


def test_products_merge_in_order(spark):
    own = products(spark, [
        {"seq": 1, "name": "Shirt", "url": "https://x.com/p/a?v=1", "images": ["1.png"], "variants": [variant("A", color="red")]},
        {"seq": 2, "name": "shirt ", "canonical": "https://x.com/p/a/", "sku": "S1", "price": "9", "images": ["2.png", "1.png"], "variants": [variant("a"), variant("B", color="blue")]},
        {"seq": 3, "sku": "s1", "name": "Other name", "description": "d"},
        {"seq": 4, "name": "Trousers", "url": "https://x.com/p/a"},
        {"seq": 5, "site": "t", "name": "Shirt", "url": "https://x.com/p/a"},
    ])
    merged = {(r.site, r.seq): r for r in C.merge(own).collect()}
    assert set(merged) == {("s", 1), ("s", 4), ("t", 5)}
    one = merged["s", 1]
    assert (one.name, one.sku, one.price, one.description, one.images, one.merged) == ("Shirt", "S1", "9", "d", ["1.png", "2.png"], 2)
    assert [v.sku for v in one.variants] == ["A", "B"]
    stats = {r.site: r for r in C.merge_stats(own, C.merge(own)).collect()}["s"]
    assert (stats.discovered, stats.final, stats.merged_duplicates, stats.duplicates) == (4, 2, 2, 0)


def test_products_meet_by_key_and_not_by_name(spark):
    own = products(spark, [
        {"seq": 1, "name": "Cap", "source_url": "https://x.com/1"},
        {"seq": 2, "name": "Cap two", "source_url": "https://x.com/1", "price": "3"},
        {"seq": 3, "name": "Cap", "source_url": "https://x.com/2"},
        {"seq": 4, "name": "Hat", "url": "https://x.com/p/h"},
        {"seq": 5, "name": "Hat", "url": "https://x.com/p/h", "sku": "H"},
        {"seq": 6, "name": "Hat", "url": "https://x.com/p/other", "sku": "h"},
        {"seq": 7, "name": "Hat", "url": "https://x.com/p/other"},
        {"seq": 8, "name": "Hat", "url": "https://x.com/p/alone"},
    ])
    merged = {r.seq: (r.name, r.price, r.merged) for r in C.merge(own).collect()}
    assert merged == {1: ("Cap", "3", 1), 3: ("Cap", None, 0), 4: ("Hat", None, 2), 7: ("Hat", None, 0), 8: ("Hat", None, 0)}


def test_confidence_and_options(spark):
    own = products(spark, [{"seq": 1, "name": "n", "slug": "s", "url": "u", "price": "1", "sku": "x", "variants": [variant(size="S", color="red"), variant(size="M", color="red")]}, {"seq": 2, "name": ""}])
    rows = own.select("seq", C.confidence(own).alias("c"), C.options("variants").alias("o")).orderBy("seq").collect()
    assert [r.c for r in rows] == [100, 60] and rows[0].o == {"size": ["S", "M"], "color": ["red"]}


def test_normalise_groups_variants_by_name(spark):
    rows = [
        {"seq": 1, "name": "Robe", "url": "https://x.com/products/robe", "price": "5", "images": ["a.png"], "description": "long text"},
        {"seq": 2, "name": "Robe - Rojo / S", "url": "https://x.com/products/robe?variant=1", "price": "6", "images": ["b.png"]},
        {"seq": 3, "name": "Robe - Azul / M", "url": "https://x.com/products/robe?variant=2", "price": "7"},
        {"seq": 4, "name": "About", "url": "https://x.com/about", "price": "1"},
        {"seq": 5, "site": "t", "name": "Lone", "price": "3"},
    ]
    own = products(spark, rows).withColumn("has_schema", F.lit(False))
    got = {r.site: r for r in C.normalise(own).collect()}
    robe = got["s"]
    assert (robe.name, robe.source_url, robe.regular_price, robe.images) == ("Robe", "https://x.com/products/robe", "", ["a.png", "b.png"])
    assert [(v.regular_price, v.attributes) for v in robe.variants] == [("6", {"color": "Rojo", "talla": "S"}), ("7", {"color": "Azul", "talla": "M"})]
    assert robe.options == {"color": ["Rojo", "Azul"], "talla": ["S", "M"]}
    assert (got["t"].name, got["t"].regular_price) == ("Lone", "3")
    shop = C.woo_rows(C.normalise(own)).where("site = 's'").collect()
    assert [(r.type, r.parent) for r in shop] == [("variable", None), ("variation", "product-robe"), ("variation", "product-robe")]


def test_synchronisation(spark):
    wanted = spark.createDataFrame([("p", "A"), ("p", "B")], "product_sku string, sku string")
    there = spark.createDataFrame([("p", "A", 1), ("p", "A", 2), ("p", "C", 3)], "product_sku string, sku string, pos int")
    assert [r.action for r in C.variant_actions(wanted, there).orderBy("pos").collect()] == ["keep", "delete", "delete"]
    source = spark.createDataFrame([("A", "u1", "s1"), ("Z", "u2", "s2"), (None, "u9", "s3"), ("Q", None, None)], "sku string, source_url string, slug string")
    target = spark.createDataFrame([(1, "A", "u2", "x"), (2, "B", "u2", "s2"), (3, None, None, "s3")], "target_id long, sku string, source_url string, slug string")
    assert {r.source_url: r.target_id for r in C.matched(source, target).collect()} == {"u1": 1, "u2": 1, "u9": 3, None: None}
    row = spark.range(1).select(C.price_equal(F.lit("48"), F.lit("48.00")).alias("a"), C.price_equal(F.lit("48"), F.lit("48.01")).alias("b"), C.price_equal(F.lit(""), F.lit("x")).alias("c")).first()
    assert tuple(row) == (True, False, True)
    same = spark.createDataFrame([({"Color": "Rojo", "Talla": "S"}, {"talla": "s", "color": "rojo"}), ({"a": "b"}, None)], "x map<string,string>, y map<string,string>").select(C.same_attributes(F.col("x"), F.col("y")).alias("e"))
    assert [r.e for r in same.collect()] == [True, False]


def test_media(spark):
    media = spark.createDataFrame([(0, "https://x.com/A%20b.png", 7, "l0"), (1, "https://x.com/c.png?v=2", 8, None), (2, "https://x.com/c.png", 9, "l2")], "place int, url string, media_id long, local string")
    wanted = spark.createDataFrame([("https://y.com/a b.png?x",), ("https://x.com/c.png",)], "url string")
    got = {r.url: r.media_id for r in C.media_lookup(wanted.where("url like '%c.png'"), media).collect()}
    assert got == {"https://x.com/c.png": 9}
    assert [r.local for r in C.first_media(wanted.where("url like '%c.png'"), media).collect()] == [None]


def test_garments(spark):
    rows = spark.createDataFrame([("Vestido rojo mujer",), ("Zapatos hombre",), ("Jean men",), ("Camisa unisex hombre mujer",), ("Camisa con capucha",), ("Short baggy",), ("Bermuda",), ("Cardigan",), ("Vestido con cinturón",), ("Dress with belt",), ("Blusa manga larga",), ("Vestido hombre",), (None,)], "t string")
    assert [tuple(r) for r in rows.select(C.garment("t").alias("a"), C.wearer("t").alias("b")).collect()] == [("one-pieces", "female"), (None, "male"), ("bottoms", "male"), ("tops", "female"), ("tops", "female"), ("bottoms", "female"), ("bottoms", "female"), ("tops", "female"), (None, "female"), (None, "female"), ("tops", "female"), ("one-pieces", "female"), (None, "female")]


# --- pages as nodes -----------------------------------------------------------------------------------------------

DOM = """<html><head><title> T  t </title><meta name="Description" content="D"><meta property="og:title" content="O"><link rel="canonical" href="/c"><link rel="stylesheet" href="s.css">
<script type="application/ld+json">{"@type": "Product"}</script><script type="application/ld+json">{bad</script><script src="a.js"></script></head>
<body><header><img class="logo" src="l.png"><nav><ul><li><a href="/1">One</a><li><a href="/2">Two</a></ul></nav></header>
<div itemscope itemtype="http://schema.org/Product"><span itemprop="name">N <b>n</b></span><meta itemprop="price" content="5"></div>
<form action="/go"><input name="q" type="search" required><select name="s"></select></form><h1>A <i>b</i></h1><h1></h1><img src="x.png" width="0" height="5"><iframe src="https://youtube.com/x"></iframe>
<section id="s1"><h2>S</h2><p>text</section><footer><a href="https://facebook.com/x">f</a></footer></body></html>"""


def test_dom_features(spark):
    frame = spark.createDataFrame([(1, DOM), (2, None), (3, "")], "page_id long, html string")
    rows = {r.page_id: r for r in dom.features(frame).collect()}
    r = rows[1]
    assert (r.title, r.description, r.canonical, r.h1, r.h2, r.open_graph.title) == ("T t", "D", "/c", ["A b"], ["S"], "O")
    assert [(a.href, a.text) for a in r.anchors] == [("/1", "One"), ("/2", "Two"), ("https://facebook.com/x", "f")]
    assert [(m.place, [i.href for i in m.items]) for m in r.menus] == [("header", ["/1", "/2"])]
    assert r.json_ld == ['{"@type": "Product"}'] and (r.assets.scripts, r.assets.stylesheets) == (["a.js"], ["s.css"])
    assert [(m.type, [(p.name, p.value) for p in m.properties]) for m in r.microdata] == [("http://schema.org/Product", [("name", "N n"), ("price", "5")])]
    assert [(f.action, f.method, [(x.tag, x.type, x.required) for x in f.fields]) for f in r.forms] == [("/go", "get", [("input", "search", True), ("select", "text", False)])]
    assert [(i.src, i.width, i.height) for i in r.images] == [("l.png", None, None), ("x.png", None, 5)]
    assert r.header.logo == "l.png" and r.footer.social == ["https://facebook.com/x"] and [w.kind for w in r.widgets] == ["video"]
    assert [(s.tag, s.anchor, s.title) for s in r.sections] == [("header", None, None), ("section", "s1", "S"), ("footer", None, None)]
    assert rows[2].anchors == rows[3].anchors == [] and rows[2].title is None


# --- gates --------------------------------------------------------------------------------------------------------


def reports(**changes):
    ok = {"status": "pass"}
    out = {k: dict(ok) for k in ("runtime", "visual", "css_runtime", "interactions", "content_order", "local_dependencies", "network", "consent", "source_capture", "commerce", "commerce_visual")}
    out |= {"pages": {"missingPages": []}, "resources": {}, "forms": {}, "content": {}, "urls": {"originalInternalDomainReferences": 0}, "capture_integrity": {"complete": True}}
    out |= {"editable": {**ok, "allPagesEditable": True, "visualEditorAvailable": True, "pageCount": 1, "expectedPageCount": 1, "blockCount": 2}, "globals": {**ok, "headerPresent": True, "footerPresent": True, "navigationPresent": True}}
    for k, v in changes.items():
        if v is None:
            del out[k]
        else:
            out[k] = out.get(k, {}) | v
    return {k: json.dumps(v) for k, v in out.items()}


def test_gate_fails_closed(spark):
    cases = {"ok": {}, "no runtime": {"runtime": None}, "missing page": {"pages": {"missingPages": ["a"]}}, "shop": {"runtime": {"commerce": {"expectedProducts": 2}}}, "links": {"urls": {"originalInternalDomainReferences": 3}}, "source": {"source_capture": {"status": "fail"}}}
    sites = spark.createDataFrame([(k, reports(**v)) for k, v in cases.items()] + [("none", {})], "site string, reports map<string,string>")
    got = {r.site: r.failures for r in gates.quality_gate(sites).collect()}
    assert got["ok"] == [] and got["no runtime"] == ["runtime"] and got["missing page"] == ["pages"] and got["shop"] == ["commerce-purchase-flow"] and got["links"] == ["original-links"]
    assert len(got["none"]) == 17 and "commerce-purchase-flow" not in got["none"]
    pages = spark.createDataFrame([(k, "home", "pass") for k in cases], "site string, slug string, status string")
    captures = spark.createDataFrame([(k, "home", v) for k in cases if k != "links" for v in gates.VIEWPORTS] + [("links", "home", "mobile")], "site string, slug string, viewport string")
    verdicts = {r.site: r.verdict for r in gates.acceptance(sites, pages, captures).collect()}
    assert verdicts["ok"] == "ready" and verdicts["no runtime"] == "blocked_by_environment" and verdicts["links"] == "needs_partial_reconstruction" and verdicts["source"] == "blocked_by_source" and verdicts["shop"] == "needs_manual_review"


def test_audits(spark):
    files = spark.createDataFrame([("s", "a.json")], "site string, path string")
    assert sorted((r.path, r.severity) for r in gates.missing_artifacts(files, ["a.json", "b.json"], ["c"]).collect()) == [("b.json", "error"), ("c", "warning")]
    expected = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "slug string")
    built = spark.createDataFrame([("a", "<p>text</p>"), ("b", "<p> </p>"), ("c", "")], "slug string, raw string")
    assert {r.slug: r.issue for r in gates.page_audit(expected, built).collect()} == {"b": "empty", "c": "empty", "d": "missing"}
    row = spark.range(1).select(gates.sequence_similarity(F.array(*map(F.lit, "abcd")), F.array(*map(F.lit, "axbd"))).alias("x"), gates.sequence_similarity(F.array(), F.array(F.lit("a"))).alias("y")).first()
    assert tuple(row) == (0.5, 1.0)


# --- products in pages, and sites ---------------------------------------------------------------------------------

SHOP = """<html><head><meta property="og:type" content="product"><meta property="og:title" content="Robe"><meta property="product:price:amount" content="12">
<script type="application/ld+json">{"@graph": [{"@type": "Product", "name": "Robe", "sku": "R1", "image": [{"url": "/a.png"}, "b.png"], "brand": {"name": "B"}, "offers": [{"price": 12.5, "priceCurrency": "EUR"}],
 "hasVariant": [{"sku": "R1-S", "size": "S", "offers": {"price": "12"}}, {"sku": "R1-M", "size": "M"}]}]}</script><script type="application/ld+json">{broken</script>
<script id="__NEXT_DATA__" type="application/json">{"props": {"p": {"@type": "Product", "name": "Other", "sku": "O"}}}</script></head>
<body><h1>Robe</h1><div itemscope itemtype="https://schema.org/Product"><span itemprop="name">Micro</span><span itemprop="price" content="3"></span></div><span class="price">€ 12,50</span><button>Add to cart</button><img class="gallery" data-src="z.png" src="s.png"></body></html>"""


def test_product_extractors_and_merge(spark):
    from siltstone.operators import products as P

    pages = spark.createDataFrame([("x.com", 0, "https://x.com/p/robe", SHOP), ("x.com", 1, "https://x.com/about", "<h1>About</h1>"), ("x.com", 2, "https://x.com/n", None)], "site string, place int, url string, html string")
    found = P.extract(pages).orderBy("seq").collect()
    assert [(r.discovery_sources[0], r.name, r.price) for r in found] == [("jsonLd", "Robe", "12.5"), ("embedded", "Other", None), ("microdata", "Micro", "3"), ("openGraph", "Robe", "12"), ("html", "Robe", "12,50")]
    one = found[0]
    assert (one.images, one.brand, one.currency, one.slug, one.url) == (["https://x.com/a.png", "https://x.com/p/b.png"], "B", "EUR", "robe", "https://x.com/p/robe")
    assert [(v.sku, v.attributes) for v in one.variants] == [("R1-S", {"size": "S"}), ("R1-M", {"size": "M"})]
    merged = {r.name: r for r in C.merge(P.extract(pages)).collect()}
    assert set(merged) == {"Robe", "Other", "Micro"} and merged["Robe"].merged == 2 and merged["Robe"].discovery_sources == ["jsonLd", "openGraph", "html"]
    assert P.source_counts(P.extract(pages)).first().jsonLd == 1
    roles = [(r.order, r.role, r.filename, r.mime_type) for r in P.media(P.extract(pages)).where("seq = 0").orderBy("order").collect()]
    assert roles == [(0, "featured", "a.png", "image/png"), (1, "gallery", "b.png", "image/png")]


THEMED = """<h1>Cape</h1><script>window.theme = {"currency": "EUR"}; window.Shopify = {}; Shopify.product = {"@type": "Product", "name": "Cape", "sku": "C1"}; track();</script>
<script type="application/json">{"id": 9, "title": "Cape", "vendor": "B", "product_type": "Coats", "tags": ["new"], "images": ["/c1.png", {"src": "/c2.png"}],
 "variants": [{"id": 1, "sku": "C1-R", "price": 40, "option1": "Red", "available": false, "featured_image": {"src": "/r.png"}}, {"id": 2, "sku": "C1-B", "colour": "Blue"}]}</script>
<script>var state = {"page": {"items": [{"title": "Scarf", "images": ["s.png"], "variants": [{"sku": "S1"}]}]}}; other(1);</script>
<div data-mage-init='{"x": {"@type": "Product", "name": "Magic", "sku": "M1"}}'></div>
<div class="product-detail"><span data-variant-id="v1" data-sku="C1-X" data-price="7" data-color="red"></span></div>"""


def test_platform_payloads_and_variants_in_html(spark):
    from siltstone.operators import products as P

    found = P.extract(spark.createDataFrame([("x.com", 3, "https://x.com/p/cape", THEMED)], "site string, place int, url string, html string")).orderBy("seq").collect()
    got = [(r.discovery_sources[0], r.name, r.sku) for r in found]
    assert got == [("embedded", "Cape", "C1"), ("embedded", "Scarf", None), ("magento", "Magic", "M1"), ("inline", "Cape", None), ("html", "Cape", None)]
    cape = found[3]
    assert (cape.brand, cape.categories, cape.tags, cape.images) == ("B", ["Coats"], ["new"], ["https://x.com/c1.png", "https://x.com/c2.png"])
    assert [(v.sku, v.price, v.stock_status, v.image, v.attributes) for v in cape.variants] == [("C1-R", "40", "outofstock", "/r.png", {"option1": "Red"}), ("C1-B", None, None, None, {"color": "Blue"})]
    assert [(v.id, v.sku, v.price, v.attributes) for v in found[4].variants] == [("v1", "C1-X", "7", {"color": "red"})]
    counts = P.source_counts(P.extract(spark.createDataFrame([("x.com", 3, "https://x.com/p/cape", THEMED)], "site string, place int, url string, html string"))).first()
    assert (counts.inline, counts.magento, counts.embedded, counts.html) == (1, 1, 2, 1)


def test_small_rules_of_catalogue_and_gates(spark):
    row = lambda **c: spark.range(1).select(*[v.alias(k) for k, v in c.items()]).first()
    got = row(a=rules.status_class(F.lit(503)), b=rules.status_class(F.lit(404)), c=rules.status_class(F.lit(301)), d=rules.status_class(F.lit(200)), e=rules.indexability(F.lit(404), F.lit(True)), f=rules.indexability(F.lit(200), F.lit(True)), g=rules.indexability(F.lit(200), F.lit(False)))
    assert tuple(got) == ("server_error", "client_error", "redirect", "ok", "error", "noindex", "indexable")
    got = row(a=rules.sales_readiness(F.lit(2), F.lit(1), F.lit(True)), b=rules.sales_readiness(F.lit(0), F.lit(0), F.lit(False)), c=rules.sales_readiness(F.lit(99), F.lit(1), F.lit(True)))
    assert tuple(got) == (100 - 16 - 3 - 8, 78, 0)
    assert row(a=C.category_difference(F.array(F.lit("x"), F.lit("y")), F.array(F.lit("y")))).a == ["x"]
    groups = spark.createDataFrame([("s", "k", 5, 2), ("s", "k", 3, 4), ("s", "k", 4, 4), ("s", "j", 1, 0)], "site string, key string, seq long, n_variants int")
    assert {tuple(r) for r in C.best_group(groups).collect()} == {("s", "k", 3, 4), ("s", "j", 1, 0)}
    shown = spark.createDataFrame([("s", 1, None, "a", ["i"]), ("s", 2, "3", "b", ["i"]), ("s", 3, "4", "c", ["j"]), ("t", 4, None, None, None)], "site string, seq long, price string, name string, images array<string>")
    assert {(r.site, r.seq) for r in C.best_sample(shown).collect()} == {("s", 2), ("t", 4)}
    stock = spark.createDataFrame([("p", 2, True, {"c": "x"}), ("p", 1, False, {"c": "w"}), ("p", 3, True, {"c": "y"})], "product_sku string, pos int, in_stock boolean, attributes map<string,string>")
    assert C.default_attributes(stock).first().attributes == {"c": "x"}
    told = spark.createDataFrame([("s", 1, []), ("s", 2, []), ("t", 1, ["x"])], "site string, target_id int, issues array<string>")
    want = spark.createDataFrame([("s", 2), ("t", 1), ("u", 1)], "site string, expected int")
    assert {r.site: r.status for r in C.import_status(told, want).collect()} == {"s": "pass", "t": "needs_review", "u": "needs_review"}


def test_variants_are_reconciled(spark):
    kind = "struct<sku: string, regular_price: string, sale_price: string, stock_status: string, attributes: map<string,string>, image: string>"
    one = ("A", "5", None, "instock", {"Color": "Rojo"}, "i.png")
    rows = [(one, ("A", "5.00", None, "instock", {"color": "rojo"}, "j.png"), True), (one, ("B", "6", None, "outofstock", {"color": "azul"}, None), True), (one, None, True), (one, one, False)]
    got = [r.issues for r in C.variant_reconciliation(spark.createDataFrame(rows, f"source {kind}, target {kind}, same_parent boolean")).collect()]
    assert got[0] == [] and got[2] == got[3] == ["missing-variant"]
    assert got[1] == ["variant-sku-mismatch", "variant-regular-price-mismatch", "variant-stock-status-mismatch", "variant-attributes-mismatch", "variant-image-missing"]


def test_site_models(spark):
    from siltstone.operators import site

    pages = spark.createDataFrame([("s", 0, '<link href="/wp-content/x"><div class="elementor">'), ("s", 1, "woocommerce yoast"), ("t", 0, "plain")], "site string, place int, html string")
    got = {(r.site, r.kind, r.name): (r.rank, r.evidence, r.first_page) for r in detect.detections(pages).collect()}
    assert got == {
        ("s", "platform", "WordPress"): (1, "wp-content", 0), ("s", "platform", "WooCommerce"): (2, "woocommerce", 1), ("s", "builder", "Elementor"): (1, "elementor", 0),
        ("s", "plugin", "WooCommerce"): (1, "woocommerce", 1), ("s", "plugin", "Elementor"): (2, "elementor", 0), ("s", "plugin", "Yoast"): (3, "yoast", 1),
    }
    links = spark.createDataFrame([("s", 0, "https://www.facebook.com/shop/"), ("s", 1, "https://facebook.com/sharer?u=1"), ("s", 2, "https://www.Facebook.com/Shop"), ("s", 3, "https://x.com/me"), ("s", 4, "https://y.org/a")], "site string, place int, url string")
    assert [(r.platform, r.url) for r in site.social_profiles(links).orderBy("n").collect()] == [("facebook", "https://www.Facebook.com/Shop"), ("twitter", "https://x.com/me")]
    values = spark.createDataFrame([("s", 1, ["b", "c"]), ("s", 0, ["a", "b"])], "site string, place int, v array<string>")
    assert [r.value for r in site.facets(values, "v", 2).orderBy("n").collect()] == ["a", "b"]
    menus = spark.createDataFrame([("s", 0, False, ["1", "2", "3", "4"]), ("s", 1, True, ["Home", "Shop"]), ("s", 2, False, ["One two", "Three", "Four"])], "site string, menu int, semantic boolean, labels array<string>")
    assert [r.menu for r in site.best_menu(menus).orderBy("n").collect()] == [1, 2, 0]
    page = spark.createDataFrame([("https://x.com/", None, "d" * 100, ["A long heading of the page itself"], "text", [("a.png", None), ("b.png", "alt")])], "url string, title string, description string, h1 array<string>, content string, images array<struct<src: string, alt: string>>")
    assert sorted((r.kind, r.page_type, r.target) for r in site.proposals(page).collect()) == [("image_alt", "home", "a.png"), ("title", "home", "title")]
    held = spark.createDataFrame([("s", "es", "<p>1 https://a.com"), ("s", "es", "<p>22 https://b.com"), ("s", "es", "<b>x")], "site string, locale string, fragment string")
    assert site.fragment_consensus(held).first().fragment == "<p>22 https://b.com"
    wanted = spark.createDataFrame([("h", 400, 800)], "slug string, w int, h int")
    shots = spark.createDataFrame([("h", 1000, 800, "d", 0), ("h", 390, 844, "m", 1)], "slug string, w int, h int, capture string, place int")
    assert site.nearest_viewport(wanted, shots).first().capture == "m"
    nodes = spark.createDataFrame([("u", ["a", "a"], ["f"])], "url string, media array<string>, forms array<string>").withColumns({c: F.lit(None).cast("array<string>") for c in ("components", "widgets", "products")})
    assert sorted((r.target, r.type) for r in site.edges(nodes).collect()) == [("a", "media"), ("f", "form")]
    declared = spark.createDataFrame([("s", "a"), ("s", "b")], "site string, slug string")
    assert site.capture_integrity(declared, declared.where("slug = 'a'").withColumn("html", F.lit("<p>"))).first().complete is False


def test_numbers_of_a_hot_key_over_many_ranges(spark):
    from siltstone.operators.ranks import numbered

    rows = spark.range(3000).select(F.when(F.col("id") % 3 < 2, F.lit("hot")).when(F.col("id") % 9 == 2, F.lit(None)).otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"), ((F.col("id") * 7919) % 3001).alias("at"), F.lit(1).alias("n_"))
    got = sorted((r.k or "", r.at, r.n) for r in numbered(rows, ["at"], ["k"]).collect())
    want, seen = [], {}
    for k, at in sorted((r.k or "", r.at) for r in rows.collect()):
        seen[k] = seen.get(k, 0) + 1
        want.append((k, at, seen[k]))
    assert got == want and seen["hot"] == 2000
    assert [r.n for r in numbered(rows, ["at"]).orderBy("at").collect()] == list(range(1, 3001))
    assert numbered(rows.limit(0), ["at"], ["k"]).count() == 0


def test_trailing_counts_of_a_hot_key_over_stretches(spark):
    rows = spark.range(2000).select(F.when(F.col("id") % 3 < 2, F.lit("hot")).otherwise(F.lit("cold")).alias("k"), F.timestamp_micros(((F.col("id") * 7919) % 9001) * 500_000).alias("ts"), F.col("id"))
    own = telemetry.trailing_count(rows.union(spark.createDataFrame([("hot", None, -1)], rows.schema)), "k", "ts", 7)
    got = {r.id: r.n for r in own.collect()}
    at = {r.id: (r.k, r.us) for r in rows.select("id", "k", F.unix_micros("ts").alias("us")).collect()}
    want = {i: sum(k == k2 and us - 7_000_000 <= us2 <= us for k2, us2 in at.values()) for i, (k, us) in at.items()}
    assert got == want | {-1: 1}
