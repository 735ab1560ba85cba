from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions import html as H
from siltstone.functions import text as S
from siltstone.functions import urls as U


def values(spark, rows, **columns):
    """Results of column expressions over rows of strings."""
    width = len(rows[0]) if isinstance(rows[0], tuple) else 1
    frame = spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], ", ".join(f"c{i} string" for i in range(width)))
    got = frame.select(*[c.alias(n) for n, c in columns.items()]).collect()
    return got if len(columns) > 1 else [r[0] for r in got]


CANONICAL = [
    ("https://X.com/", "https://x.com"),
    ("https://x.com/a/?b=2&a=1&utm_source=f&sid=9#top", "https://x.com/a?a=1&b=2"),
    ("https://x.com:443/a?k&k=2", "https://x.com/a?k=&k=2"),
    ("https://x.com/?a=1", "https://x.com/?a=1"),
    ("not a url", "not a url"),
    (None, None),
]


def test_canonical_and_its_idempotence(spark):
    got = values(spark, [a for a, _ in CANONICAL], x=U.canonical("c0"))
    assert got == [b for _, b in CANONICAL]
    assert values(spark, [b for _, b in CANONICAL], x=U.canonical("c0")) == got


def test_links_keep_session_ids_that_canonical_forms_drop(spark):
    row = values(spark, ["https://x.com/p?sid=1&ref=2&id=3"], n=U.normalized("c0"), c=U.canonical("c0"), e=U.equivalence_key("c0"))[0]
    assert tuple(row) == ("https://x.com/p?id=3&sid=1", "https://x.com/p?id=3", "https://x.com/p?id=3")


def test_equivalence_and_pattern(spark):
    same = values(spark, ["https://x.com/l?sort=a&color=red", "https://x.com/l?page=2", "https://x.com/l/"], x=U.equivalence_key("c0"))
    assert len(set(same)) == 1
    assert values(spark, ["https://x.com/l?id=1&id=2"], x=U.equivalence_key("c0")) == ["https://x.com/l?id=2"]
    assert values(spark, ["https://a.com/P/12/x?b=1&A=2&utm_x=1", "https://b.com/", "https://b.com/1"], x=U.pattern_key("c0")) == ["/p/:id/x/*?a=*&b=*", "/", "/:id/*"]


def test_kinds(spark):
    urls = ["https://x.com/product/a", "https://x.com/products/a", "https://x.com/blog/a", "https://x.com/a?utm_x=1", "https://x.com/a?page=2", "https://x.com/a", "?", "https://x.com/home/x"]
    assert values(spark, urls, x=U.kind("c0")) == ["Product", "Static", "Blog", "Tracking", "Functional", "Static", "Unknown", "LandingPage"]
    assert values(spark, ["Product", "Static", "nothing"], x=U.priority("c0")) == [100, 20, 0]
    assert values(spark, ["Product", "Tracking"], x=U.adjusted_priority("c0", F.lit(True))) == [50, 1]


def test_assets(spark):
    urls = ["https://x.com/a.JPG?x=1", "https://x.com/.htaccess", "https://x.com/a.tar.gz", "https://x.com/a", "https://x.com/v1.2/page", "https://x.com/f.woff2", "https://x.com/a.html"]
    assert values(spark, urls, x=U.is_asset("c0")) == [True, False, True, False, False, True, False]
    assert values(spark, urls, x=U.asset_type("c0")) == ["image", "other", "document", "other", "other", "font", "other"]


def test_links_are_resolved(spark):
    base = "https://x.com/a/b/c.html?q=1"
    want = {"d": "https://x.com/a/b/d", "/d": "https://x.com/d", "../d": "https://x.com/a/d", "./d/./e/..": "https://x.com/a/b/d/", "//y.com/z": "https://y.com/z", "?r=2": "https://x.com/a/b/c.html?r=2", "#f": "https://x.com/a/b/c.html?q=1#f", "mailto:a@b": "mailto:a@b", "https://z.com": "https://z.com"}
    assert values(spark, [(k, base) for k in want], x=U.resolved("c0", "c1")) == list(want.values())
    kept = values(spark, [("javascript:void(0)", base), ("/x/?b=1&a=2", base), ("/", base)], x=U.resolved_href("c0", "c1"))
    assert kept == [None, "https://x.com/x?a=2&b=1", "https://x.com/"]


def test_other_url_forms(spark):
    assert values(spark, ["/a/b/c", "/a", "/"], x=U.ancestors("c0")) == [["/a", "/a/b"], [], []]
    assert values(spark, ["a/b?x", "/", "//a//"], x=U.replay_path("c0")) == ["/a/b/", "/", "/a/"]
    assert values(spark, ["https://www.Shop.com/es/"], x=U.site_key("c0")) == ["shop.com/es"]
    assert values(spark, ["https://x.com/P/A/?v=1#x"], x=U.commerce_key("c0")) == ["https://x.com/p/a"]
    assert values(spark, ["..\\a/../b//c", "C:/x"], x=U.safe_zip_path("c0")) == ["a/b/c", "x"]
    assert values(spark, ["https://x.com/a", "https://y.com"], x=U.same_site("c0", ["x.com"])) == [True, False]


def test_texts(spark):
    row = values(spark, ["  a \u00a0 b\n"], c=S.collapsed("c0"), u=S.utf16_length(F.lit("a😀")))[0]
    assert tuple(row) == ("a b", 3)
    assert values(spark, ["   ", None], x=S.collapsed("c0")) == [None, None]
    assert values(spark, ["Hello, World!"], x=S.stable_id("k", "c0")) == ["k:hello-world"]
    assert values(spark, ["Café Niño", "***"], x=S.slug("c0", 72, "tienda")) == ["cafe-nino", "tienda"]
    assert values(spark, ["abc"], x=S.fnv1a("c0")) == ["7aigaz"]
    assert values(spark, ["one two three", "one", "abcdefghij"], x=S.trimmed_to("c0", 8)) == ["one two", "one", "abcdefgh"]
    assert values(spark, ["a.jpg 1x, b.jpg 2x"], x=S.srcset_urls("c0")) == [["a.jpg", "b.jpg"]]
    assert values(spark, ["+34 600-123-456", "0034600123456", "600123456"], x=S.phone_digits("c0")) == ["34600123456"] * 3
    assert values(spark, ["C/ Mayor 1, 28013 Madrid, Spain"], a=S.postal_code("c0"), b=S.city("c0"))[0] == ("28013", "Madrid")
    assert values(spark, ["59", "61", "3700"], x=S.duration_label("c0")) == ["59s", "1min 1s", "1h 1min"]


def test_hash31_matches_a_plain_loop(spark):
    def plain(text):
        h = 0
        for b in text.encode():
            h = (h * 31 + b) & 0xFFFFFFFF
        h = h - (1 << 32) if h >= 1 << 31 else h
        digits, n = "", abs(h)
        while n:
            n, r = divmod(n, 36)
            digits = "0123456789abcdefghijklmnopqrstuvwxyz"[r] + digits
        return ("-" if h < 0 else "") + digits

    texts = ["https://example.com/a", "é", "some longer text with numbers 123456"]
    assert values(spark, texts, x=S.hash31("c0")) == [plain(t) for t in texts]


def test_versions_and_retries(spark):
    rows = values(spark, ["1.2.10", "v1.10.0", "1.2"], x=S.version_key("c0"))
    assert rows[0] < rows[1] and rows[2] is None
    frame = spark.createDataFrame([(1,), (3,), (9,)], "k int")
    assert [r[0] for r in frame.select(S.backoff_ms("k", 100)).collect()] == [100, 400, 25600]
    assert [r[0] for r in frame.select(S.retry_step_ms("k")).collect()] == [1000, 5000, 60000]


PAGE = """<html lang="ES"><head><title> A  b </title><meta name="description" content="D'oh"><meta property="og:title" content="O"><link rel="canonical" href="https://x.com/a">
<link rel="stylesheet" href="/s"><style>@import "i.css"; a{color:#FFF;background:url('bg.png')} b{color:#FFF;--v:1}</style></head>
<body><h1>H <b>1</b></h1><h1></h1><img src="a.png" srcset="b.png 1x, c.png 2x"><img alt="x" data-src="d.jpg"><a href="/n">n</a><script>let x=1</script>one two</body></html>"""


def test_html(spark):
    want = [
        (H.title("c0"), "A b"), (H.headings("c0", 1), ["H 1"]), (H.meta("c0", "description"), "D'oh"), (H.meta("c0", "og:title"), "O"), (H.meta("c0", "none"), None), (H.canonical_href("c0"), "https://x.com/a"),
        (H.hrefs("c0"), ["/n"]), (H.language("c0"), "es"), (H.css_urls("c0"), ["bg.png", "i.css"]), (H.css_tokens("c0")["colors"], ["#FFF"]), (F.map_keys(H.css_tokens("c0")["variables"]), ["--v"]), (H.visible_text("c0", 5), "A b H"),
        (F.array_sort(H.resource_urls("c0")), ["/s", "a.png", "b.png", "bg.png", "c.png", "d.jpg", "i.css"]), (H.is_challenge("c0"), False), (H.word_count(H.body_text("c0")), 4),
    ]
    row = spark.createDataFrame([(PAGE,)], "c0 string").select(*[c.alias(f"x{i}") for i, (c, _) in enumerate(want)]).first()
    assert list(row) == [w for _, w in want]


def test_css_spacing_takes_all_values_of_all_styles(spark):
    from siltstone.operators import dom as D

    many = "".join(f"p{i} {{ padding-left: {i}em }}" for i in range(70))
    page = f"<html><head><style>a {{ margin-top: 1px; GAP : 2px }}</style></head><body><p style='margin:3px;row-gap:4px'></p><style>{many}</style></body></html>"
    row = D.parsed(spark.createDataFrame([(page,)], "html string")).select(H.css_spacing(D.css()).alias("x")).first()
    assert row.x == ["1px", "2px", *[f"{i}em" for i in range(70)], "3px", "4px"]
