"""Catalogue operators: product keys, ordered merging, normalisation by evidence, synchronisation and reconciliation.

A product is a row with its site, its place in the capture (``seq``: page,
extractor, position in one order), the fields of ``FIELDS`` and lists.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from siltstone.checkpoints import cut
from siltstone.functions import urls as U
from siltstone.functions.text import collapsed, folded, slug
from siltstone.operators.graph import connected
from siltstone.operators.joins import join_by

IDENTIFIERS = ("sku", "gtin", "ean", "upc", "isbn", "mpn")
FIELDS = (*IDENTIFIERS, "name", "title", "url", "canonical", "slug", "price", "regular_price", "sale_price", "currency", "description", "short_description", "brand", "stock", "stock_status", "availability")
LISTS = ("images", "categories", "tags", "discovery_sources")
VARIANT = "struct<id: string, sku: string, price: string, sale_price: string, stock_status: string, image: string, attributes: map<string, string>>"
PRODUCT = "site string, seq long, source_url string, " + ", ".join(f"{c} string" for c in FIELDS) + ", " + ", ".join(f"{c} array<string>" for c in LISTS) + f", variants array<{VARIANT}>"
# Words for colours in shops' languages.
COLORS = ("negro", "negra", "blanco", "blanca", "beige", "marrón", "marron", "rojo", "roja", "azul", "azul marino", "verde", "rosa", "gris", "café", "cafe", "cocoa", "perla", "chantilly", "vino", "nude")
SIZE = r"(?i)^(\d{2,3}[a-z]?|\d?x{0,3}s|[smlx]{1,4}|[a-h])$"


# --- keys and ordered merging -------------------------------------------------------------------------------------


def with_keys(products: DataFrame) -> DataFrame:
    """Adds what may tie products together: identifier, address, name (all null where unknown)."""
    named = F.lower(collapsed(F.coalesce("name", "title")))
    return products.withColumns(
        {
            "id_key": F.lower(F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in IDENTIFIERS])),
            "url_key": U.product_key(F.coalesce("canonical", "url")),
            "name_key": named,
        }
    )


def primary_key(keyed: DataFrame) -> Column:
    """The first key of a product: its identifier, else address and name, else address, else where it was seen."""
    c = F.col
    return (
        F.when(c("id_key").isNotNull(), F.concat(F.lit("id:"), c("id_key")))
        .when(c("url_key").isNotNull() & c("name_key").isNotNull(), F.concat(F.lit("url-name:"), c("url_key"), F.lit(":"), c("name_key")))
        .when(c("url_key").isNotNull(), F.concat(F.lit("url:"), c("url_key")))
        .otherwise(F.concat(F.lit("unknown:"), F.coalesce("source_url", F.lit(""))))
    )


def _keys(row: dict) -> list[str]:
    out = [f"id:{row['id_key']}"] if row["id_key"] else []
    if row["url_key"]:
        out.append(f"url-name:{row['url_key']}:{row['name_key']}" if row["name_key"] else f"url:{row['url_key']}")
    return out or [f"unknown:{row['source_url']}"]


def _variant_key(v: dict) -> str:
    if v.get("sku"):
        return f"sku:{v['sku'].lower()}"
    return "|".join(f"{k}:{x}" for k, x in sorted(dict(v.get("attributes") or {}).items())) or repr(sorted(v.items(), key=str))


def _joined(a: dict, b: dict) -> dict:
    """Two records of one product: the earlier one's fields first, lists joined, variants by their key."""
    out = dict(a)
    for c in (*FIELDS, "id_key", "url_key", "name_key"):
        out[c] = a[c] if a[c] is not None else b[c]
    for c in LISTS:
        out[c] = list(dict.fromkeys([*a[c], *b[c]]))
    seen = {_variant_key(v) for v in a["variants"]}
    out["variants"] = [*a["variants"], *[v for v in b["variants"] if (k := _variant_key(v)) not in seen and not seen.add(k)]]
    out["merged"] = a["merged"] + 1
    return out


def merge(products: DataFrame) -> DataFrame:
    """Products of each site merged in order of ``seq``; a merged product answers to the keys of all its records.

    The fold depends on order, so it needs the records of one product
    together, but not those of a whole site: records meet by an identifier,
    by an address or, without both, by where they were seen, and never by a
    name alone.  Records of one address are one node; components over nodes
    that share an identifier are found first, so where no two do nothing is
    left to search.  Each component is folded by itself as its sorted rows
    stream by, and what is held of it are its merged products.
    """
    seen = F.coalesce("source_url", F.lit(""))
    node = F.when(F.col("url_key") != "", F.concat(F.lit("url:"), "url_key")).when(F.col("id_key") != "", F.concat(F.lit("id:"), "id_key")).otherwise(F.concat(F.lit("unknown:"), seen))
    keyed = cut(with_keys(products).withColumn("part", node))
    shared = keyed.where("id_key != ''").groupBy("site", "id_key").agg(F.min("part").alias("a"), F.max("part").alias("z")).where("a != z").drop("z")
    links = join_by(keyed.where("id_key != ''").select("site", "id_key", "part").distinct(), cut(shared), ["site", "id_key"]).where("part != a")
    parts = connected(links.select(F.struct("site", F.col("a").alias("part")).alias("a"), F.struct("site", "part").alias("b")))
    parts = parts.select(F.col("id.site").alias("site"), F.col("id.part").alias("part"), F.col("component.part").alias("root"))
    own = keyed.join(parts, ["site", "part"], "left").withColumn("part", F.coalesce("root", "part")).drop("root")
    own = own.repartition("site", "part").sortWithinPartitions("site", "part", "seq")
    columns = ["site", "seq", "source_url", *FIELDS, *LISTS, "variants", "merged"]
    out_kind = to_arrow_schema(T.StructType.fromDDL(PRODUCT + ", merged int"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[dict] = []  # of the component that the rows are in from here on, what ended before
        out: list[dict] = []
        at: dict[str, int] = {}
        part = None

        def batch_of(rows: list[dict]) -> pa.RecordBatch:
            entries = lambda v: dict(v, attributes=list(v["attributes"].items()))
            rows = [dict(r, variants=[entries(v) for v in r["variants"]]) if r["variants"] else r for r in rows]
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], out_kind.field(c).type) for c in columns], columns)

        for batch in batches:
            names = batch.schema.names
            for values in zip(*(batch.column(i).to_pylist() for i in range(len(names))), strict=True):
                row = dict(zip(names, values, strict=True))
                if (row["site"], row["part"]) != part:
                    found += out
                    out, at, part = [], {}, (row["site"], row["part"])
                    if len(found) >= 1024:
                        yield batch_of(found)
                        found = []
                for c in LISTS:
                    row[c] = row[c] or []
                row["variants"] = [dict(v, attributes=dict(v["attributes"] or {})) for v in row["variants"] or []]
                row["merged"] = 0
                i = next((at[k] for k in _keys(row) if k in at), None)
                if i is None:
                    i = len(out)
                    out.append(row)
                else:
                    out[i] = _joined(out[i], row)
                at |= dict.fromkeys(_keys(out[i]), i)
        found += out
        if found:
            yield batch_of(found)

    return own.select("part", "site", "seq", "source_url", *FIELDS, *LISTS, "variants", "id_key", "url_key", "name_key").mapInArrow(fold, PRODUCT + ", merged int")


def options(variants: Column | str) -> Column:
    """Attribute name to its distinct values, both in the order in which variants show them."""
    own = F.col(variants) if isinstance(variants, str) else variants
    entries = F.flatten(F.transform(own, lambda v: F.map_entries(F.coalesce(v["attributes"], F.create_map().cast("map<string,string>")))))
    names = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    return F.map_from_entries(F.transform(names, lambda n: F.struct(n, F.array_distinct(F.transform(F.filter(entries, lambda e: e["key"] == n), lambda e: e["value"])))))


def confidence(products: DataFrame) -> Column:
    """How complete a product is, from 50 to 100; a list counts as given even if empty."""
    has = lambda c: F.when(F.col(c).isNotNull() & (F.col(c) != ""), 1).otherwise(0)
    score = 50 + 10 * (has("name") + has("slug") + has("url") + has("price") + F.when(F.col("images").isNotNull(), 1).otherwise(0))
    score += 5 * (has("description") + has("sku") + has("gtin") + has("brand"))
    return F.least(score + F.least(5 * F.coalesce(F.size("variants"), F.lit(0)), F.lit(20)), F.lit(100))


def merge_stats(products: DataFrame, merged: DataFrame) -> DataFrame:
    """Totals of each site before and after merging."""
    before = with_keys(products).withColumn("key", primary_key(products)).groupBy("site").agg(F.count(F.lit(1)).alias("discovered"), F.countDistinct("key").alias("distinct_keys"))
    given = lambda c: F.col(c).isNotNull() & (F.col(c) != "")
    complete = given("name") & given("slug") & given("url") & given("price") & given("description") & (F.size("images") > 0)
    after = merged.groupBy("site").agg(
        F.sum("merged").alias("merged_duplicates"), F.count(F.lit(1)).alias("final"), F.count_if(complete).alias("complete"), F.sum(F.size("images")).alias("images"),
        F.sum(F.size("variants")).alias("variants"), F.count_if(F.size("images") == 0).alias("missing_galleries"),
    )
    return before.join(after, "site").withColumn("duplicates", F.greatest(F.lit(0), F.col("discovered") - F.col("distinct_keys") - F.col("merged_duplicates"))).drop("distinct_keys")


def filled_columns(merged: DataFrame) -> Column:
    """Names of the columns that some row fills, for use in an aggregation."""
    some = lambda c: F.max((F.size(c) > 0) if c in (*LISTS, "variants") else F.col(c).isNotNull())
    return F.array_compact(F.array(*[F.when(some(c), F.lit(c)) for c in (*FIELDS, *LISTS, "variants")]))


# --- normalisation by evidence ------------------------------------------------------------------------------------


def evidence(products: DataFrame) -> Column:
    """How much speaks for a row being a product: route, schema, identifier, variants, price, name, media, categories."""
    given = lambda *names: F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in names]).isNotNull().cast("int")
    some = lambda c: (F.coalesce(F.size(c), F.lit(0)) > 0).cast("int")
    at = U.commerce_key(F.coalesce("canonical", "url", "source_url"))
    route = F.coalesce(at.rlike(r"/(products?|producto|productos|produit|produkte?)/[^/]+$"), F.lit(False)).cast("int")
    return 4 * route + 4 * F.coalesce(F.col("has_schema"), F.lit(False)).cast("int") + 2 * given("sku") + 2 * some("variants") + given("price", "regular_price", "sale_price") + given("name", "title") + some("images") + some("categories")


def normalised_key(products: DataFrame) -> Column:
    score, at = evidence(products), U.commerce_key(F.coalesce("canonical", "url", "source_url"))
    stable = F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in ("sku", "slug")])
    return F.when(at.isNotNull() & (score >= 4), at).when(stable.isNotNull() & (score >= 5), F.concat(F.lit("product:"), slug(stable, 200, "product")))


def variant_tokens(name: Column, base: Column) -> Column:
    """What a variant's name adds to the product's, split at slashes."""
    own, low = F.regexp_replace(F.trim(name), r"\s+", " "), F.concat(F.lower(F.regexp_replace(F.trim(base), r"\s+", " ")), F.lit(" - "))
    tail = F.when(F.lower(own).startswith(low), F.regexp_replace(own, r"^.*? - ", "")).otherwise(own)
    return F.filter(F.transform(F.split(tail, "/"), lambda x: F.trim(x)), lambda x: x != "")


def attribute_names(tokens: Column) -> Column:
    """A name for each place in rows of tokens: color or talla if all values there fit, else opcion-n."""
    width = F.coalesce(F.array_max(F.transform(tokens, lambda r: F.size(r))), F.lit(0))
    places = F.when(width > 0, F.sequence(F.lit(0), width - 1)).otherwise(F.array().cast("array<int>"))

    def name(i: Column) -> Column:
        values = F.filter(F.transform(tokens, lambda r: F.lower(F.get(r, i))), lambda v: v.isNotNull())
        return F.when(F.forall(values, lambda v: v.isin(*COLORS)), F.lit("color")).when(F.forall(values, lambda v: v.rlike(SIZE)), F.lit("talla")).otherwise(F.concat(F.lit("opcion-"), (i + 1).cast("string")))

    return F.transform(places, name)


def normalise(products: DataFrame) -> DataFrame:
    """One row for each product that evidence shows, sorted by name.

    Rows without a key are dropped; only where a site has none at all, rows
    with a name and a price are taken as they are.
    """
    keyed = products.withColumn("key", normalised_key(products))
    strong = keyed.where("key is not null")
    weak = keyed.join(strong.select("site").distinct(), "site", "left_anti").where(F.coalesce("name", "title").isNotNull() & F.coalesce("price", "regular_price").isNotNull())
    weak = weak.withColumn("key", F.concat(F.lit("fallback:"), F.coalesce("sku", "slug", slug(F.coalesce("name", "title"), 200, "product"))))
    rows = strong.unionByName(weak).withColumn("label", F.coalesce("name", "title"))
    held = F.sort_array(F.collect_list(F.struct("seq", "label", "slug", "regular_price", "price", "sale_price", "stock_status", F.coalesce("description", F.lit("")).alias("description"), "currency", "categories", "tags", "images", "sku", F.coalesce("canonical", "url", "source_url").alias("at"))))
    own = rows.groupBy("site", "key").agg(held.alias("rows"))
    names = F.filter(F.array_distinct(F.transform("rows", lambda r: r["label"])), lambda n: n.isNotNull() & ~n.contains(" - "))
    slugs = F.filter(F.transform("rows", lambda r: r["slug"]), lambda s: s.isNotNull() & (s != ""))
    own = own.withColumn("slug", F.coalesce(F.get(slugs, 0), F.try_element_at(F.split("key", "/"), F.lit(-1))))
    shortest = F.get(F.array_sort(F.transform(names, lambda n, i: F.struct(F.length(n).alias("l"), i.alias("i"), n.alias("n")))), 0)["n"]
    own = own.withColumn("name", F.coalesce(shortest, F.regexp_replace("slug", "-", " ")))
    variants = F.filter("rows", lambda r: F.lower(r["label"]).startswith(F.concat(F.lower("name"), F.lit(" - "))) & F.coalesce(r["price"], r["regular_price"]).isNotNull())
    own = own.withColumn("parts", variants)
    own = own.withColumn("tokens", F.transform("parts", lambda r: variant_tokens(r["label"], F.col("name"))))
    own = own.withColumn("attributes", attribute_names(F.col("tokens")))
    made = F.transform(
        "parts",
        lambda r, i: F.struct(
            F.coalesce(r["sku"], F.concat("slug", F.lit("-"), (i + 1).cast("string"))).alias("id"),
            F.coalesce(r["regular_price"], r["price"]).alias("regular_price"),
            r["sale_price"].alias("sale_price"),
            r["stock_status"].alias("stock_status"),
            F.map_from_arrays(F.slice("attributes", 1, F.size(F.get("tokens", i))), F.get("tokens", i)).alias("attributes"),
            F.get(r["images"], 0).alias("image"),
        ),
    )
    own = own.withColumn("variants", made)
    best = F.coalesce(F.get(F.filter("rows", lambda r: F.lower(F.trim(r["label"])) == F.lower(F.trim("name"))), 0), F.get("rows", 0))
    longest = F.get(F.array_sort(F.transform("rows", lambda r, i: F.struct((-F.length(r["description"])).alias("l"), i.alias("i"), r["description"].alias("d")))), 0)["d"]
    every = lambda c: F.array_distinct(F.flatten(F.transform("rows", lambda r: F.coalesce(r[c], F.array().cast("array<string>")))))
    alone = F.size("variants") == 0
    return own.withColumn("best", best).select(
        "site",
        F.when(F.col("key").rlike("^(fallback|product):"), F.col("best.at")).otherwise(F.col("key")).alias("source_url"),
        F.get(F.filter(F.transform("rows", lambda r: r["currency"]), lambda c: c.isNotNull()), 0).alias("currency"),
        F.concat(F.lit("product-"), slug("slug", 200, "product")).alias("sku"),
        slug("slug", 200, "product").alias("slug"),
        "name",
        longest.alias("description"),
        F.when(alone, F.coalesce("best.regular_price", "best.price", F.lit(""))).otherwise(F.lit("")).alias("regular_price"),
        F.when(alone, F.coalesce("best.sale_price", F.lit(""))).otherwise(F.lit("")).alias("sale_price"),
        F.when(alone, F.coalesce("best.stock_status", F.lit(""))).otherwise(F.lit("")).alias("stock_status"),
        every("categories").alias("categories"),
        every("tags").alias("tags"),
        every("images").alias("images"),
        options("variants").alias("options"),
        "variants",
    ).orderBy("site", folded("name"), "name")


def best_group(groups: DataFrame) -> DataFrame:
    """Of each key the group (seq, n_variants) with most variants, the first among equals."""
    return groups.groupBy("site", "key").agg(F.max(F.struct("n_variants", (-F.col("seq")).alias("minus"))).alias("x")).select("site", "key", (-F.col("x.minus")).alias("seq"), F.col("x.n_variants").alias("n_variants"))


def best_sample(products: DataFrame) -> DataFrame:
    """Of each site the product to show: most of price, name and images; the first among equals."""
    score = F.col("price").isNotNull().cast("int") + F.col("name").isNotNull().cast("int") + F.coalesce(F.size("images"), F.lit(0))
    n = F.row_number().over(Window.partitionBy("site").orderBy(F.desc("score"), "seq"))
    return products.withColumn("score", score).withColumn("_n", n).where("_n = 1").drop("_n")


# --- synchronisation and reconciliation ---------------------------------------------------------------------------


def price_equal(a: Column, b: Column, places: int = 2) -> Column:
    """Whether two prices are the same as decimals, so 48 is 48.00; two that are no numbers are equal."""
    of = lambda c: c.try_cast(f"decimal(18,{places})")
    return of(a).eqNullSafe(of(b))


def sync_actions(source: DataFrame, target: DataFrame) -> DataFrame:
    """What a full synchronisation by SKU does: insert, update, replace (other type), delete (imported before), keep."""
    s = source.select("sku", F.col("type").alias("source_type"))
    t = target.select("sku", F.col("type").alias("target_type"), "imported")
    own = s.join(t, "sku", "full_outer")
    action = (
        F.when(F.col("target_type").isNull(), F.lit("insert"))
        .when(F.col("source_type").isNull(), F.when(F.col("imported"), F.lit("delete")).otherwise(F.lit("keep")))
        .when(F.col("source_type") != F.col("target_type"), F.lit("replace"))
        .otherwise(F.lit("update"))
    )
    return own.select("sku", action.alias("action"))


def variant_actions(desired: DataFrame, existing: DataFrame) -> DataFrame:
    """Per child of a product: keep the first of each wanted SKU, delete its repeats and what is not wanted."""
    n = F.row_number().over(Window.partitionBy("product_sku", "sku").orderBy("pos"))
    own = existing.withColumn("_n", n).join(desired.select("product_sku", "sku").distinct().withColumn("wanted", F.lit(True)), ["product_sku", "sku"], "left")
    return own.withColumn("action", F.when(F.col("wanted") & (F.col("_n") == 1), F.lit("keep")).otherwise(F.lit("delete"))).drop("_n", "wanted")


def default_attributes(variants: DataFrame) -> DataFrame:
    """Attributes of the first variant in stock of each product."""
    return variants.where("in_stock").groupBy("product_sku").agg(F.min_by("attributes", "pos").alias("attributes"))


def matched(source: DataFrame, target: DataFrame) -> DataFrame:
    """The target of each source row by SKU, else by source address, else by slug."""
    out = source
    for key in ("sku", "source_url", "slug"):
        found = target.where(F.col(key).isNotNull() & (F.col(key) != "")).groupBy(key).agg(F.min("target_id").alias(f"_by_{key}"))
        out = out.join(found, key, "left")
    return out.withColumn("target_id", F.coalesce("_by_sku", "_by_source_url", "_by_slug")).drop("_by_sku", "_by_source_url", "_by_slug")


def same_attributes(a: Column, b: Column) -> Column:
    """Whether two attribute maps are equal once names and values are slugs and in order."""
    of = lambda m: F.array_sort(F.transform(F.map_entries(F.coalesce(m, F.create_map().cast("map<string,string>"))), lambda e: F.struct(slug(e["key"], 200, "").alias("k"), slug(e["value"], 200, "").alias("v"))))
    return of(a) == of(b)


def same_categories(a: Column, b: Column) -> Column:
    of = lambda c: F.array_sort(F.array_distinct(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: slug(x, 200, ""))))
    return of(a) == of(b)


def reconciliation(pairs: DataFrame) -> DataFrame:
    """Issues between source and target fields of matched products (source, target: structs, the target null where missing)."""
    s, t = (lambda c: F.col(f"source.{c}")), (lambda c: F.col(f"target.{c}"))
    single = F.coalesce(s("n_variants"), F.lit(0)) == 0
    checks = [
        ("sku-mismatch", ~s("sku").eqNullSafe(t("sku"))),
        ("name-mismatch", ~s("name").eqNullSafe(t("name"))),
        ("variant-count-mismatch", F.coalesce(s("n_variants"), F.lit(0)) != F.coalesce(t("n_variants"), F.lit(0))),
        ("regular-price-mismatch", single & ~price_equal(s("regular_price"), t("regular_price"))),
        ("sale-price-mismatch", single & ~price_equal(s("sale_price"), t("sale_price"))),
        ("stock-status-mismatch", single & (F.coalesce(s("stock_status"), F.lit("")) != "") & ~s("stock_status").eqNullSafe(t("stock_status"))),
        ("image-count-mismatch", F.coalesce(s("n_images"), F.lit(0)) != F.coalesce(t("n_images"), F.lit(0))),
        ("category-mismatch", ~same_categories(s("categories"), t("categories"))),
    ]
    told = F.array_compact(F.array(*[F.when(when, F.lit(code)) for code, when in checks]))
    issues = F.when(F.col("target").isNull(), F.array(F.lit("missing-product"))).otherwise(told)
    return pairs.withColumn("issues", issues).withColumn("status", F.when(F.size("issues") == 0, F.lit("pass")).otherwise(F.lit("needs_review")))


def variant_reconciliation(pairs: DataFrame) -> DataFrame:
    """The same for variants."""
    s, t = (lambda c: F.col(f"source.{c}")), (lambda c: F.col(f"target.{c}"))
    checks = [
        ("variant-sku-mismatch", (F.coalesce(s("sku"), F.lit("")) != "") & ~s("sku").eqNullSafe(t("sku"))),
        ("variant-regular-price-mismatch", ~price_equal(s("regular_price"), t("regular_price"))),
        ("variant-sale-price-mismatch", ~price_equal(s("sale_price"), t("sale_price"))),
        ("variant-stock-status-mismatch", (F.coalesce(s("stock_status"), F.lit("")) != "") & ~s("stock_status").eqNullSafe(t("stock_status"))),
        ("variant-attributes-mismatch", ~same_attributes(s("attributes"), t("attributes"))),
        ("variant-image-missing", s("image").isNotNull() & t("image").isNull()),
    ]
    told = F.array_compact(F.array(*[F.when(when, F.lit(code)) for code, when in checks]))
    return pairs.withColumn("issues", F.when(F.col("target").isNull() | ~F.col("same_parent"), F.array(F.lit("missing-variant"))).otherwise(told))


def import_status(reconciled: DataFrame, expected: DataFrame) -> DataFrame:
    """Of each site whether all expected products are there and none has an issue."""
    got = reconciled.groupBy("site").agg(F.countDistinct("target_id").alias("imported"), F.sum(F.size("issues")).alias("issues"))
    own = expected.join(got, "site", "left")
    return own.withColumn("status", F.when((F.col("imported") == F.col("expected")) & (F.col("issues") == 0), F.lit("pass")).otherwise(F.lit("needs_review")))


def media_lookup(wanted: DataFrame, media: DataFrame) -> DataFrame:
    """Media of wanted addresses: by the whole address, else by its decoded path in lower case."""
    key = lambda c: F.lower(F.try_url_decode(U.path(c)))
    exact = media.groupBy("url").agg(F.min("media_id").alias("_exact"))
    by_path = media.groupBy(key("url").alias("_path")).agg(F.min("media_id").alias("_by_path"))
    own = wanted.withColumn("_path", key("url")).join(exact, "url", "left").join(by_path, "_path", "left")
    return own.withColumn("media_id", F.coalesce("_exact", "_by_path")).drop("_exact", "_by_path", "_path")


def first_media(html_urls: DataFrame, media: DataFrame) -> DataFrame:
    """The first entry (by ``place``) of a media list that equals an address, or equals it without its query.

    Two joins by key instead of one join with an OR; the earlier entry wins.
    """
    bare = F.regexp_replace("url", r"\?.*$", "")
    own = html_urls.withColumn("bare", bare)
    entries = media.groupBy("url").agg(F.min(F.struct("place", "local")).alias("e"))
    stripped = media.groupBy(bare.alias("bare")).agg(F.min(F.struct("place", "local")).alias("b"))
    both = own.join(entries, "url", "left").join(stripped, "bare", "left")
    return both.withColumn("entry", F.least("e", "b")).select(*html_urls.columns, F.col("entry.local").alias("local"))


def category_difference(source: Column, target: Column) -> Column:
    return F.array_except(source, target)


def woo_rows(normalised: DataFrame) -> DataFrame:
    """Catalogue rows for a shop import: a simple row, or a variable parent followed by its variations."""
    simple = F.size("variants") == 0
    parent = normalised.select(
        "site", "sku", F.lit(0).alias("place"), F.when(simple, F.lit("simple")).otherwise(F.lit("variable")).alias("type"), F.lit(None).cast("string").alias("parent"), "name", "regular_price", "sale_price", "stock_status",
        F.array_join("categories", ", ").alias("categories"), F.array_join("images", ", ").alias("images"), F.array_join(F.transform(F.map_entries("options"), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], ", "))), "; ").alias("attributes"),
    )
    child = normalised.select("site", "sku", "name", "categories", F.posexplode("variants").alias("n", "v")).select(
        "site", F.concat("sku", F.lit("-"), F.col("v.id")).alias("sku"), (F.col("n") + 1).alias("place"), F.lit("variation").alias("type"), F.col("sku").alias("parent"), "name", F.col("v.regular_price").alias("regular_price"),
        F.col("v.sale_price").alias("sale_price"), F.col("v.stock_status").alias("stock_status"), F.lit("").alias("categories"), F.col("v.image").alias("images"),
        F.array_join(F.transform(F.map_entries("v.attributes"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "; ").alias("attributes"),
    )
    return parent.unionByName(child).orderBy("site", F.coalesce("parent", "sku"), "place")


# --- garments, phones -----------------------------------------------------------------------------------------------


def is_commerce_row() -> Column:
    return F.coalesce(F.col("price").rlike("[0-9]"), F.lit(False)) | (F.coalesce("sku", F.lit("")) != "") | (F.coalesce(F.size("variants"), F.lit(0)) > 0)


# Words for what cannot be worn on a figure, kinds of garments in order, and words for whom they are.
NOT_WORN = "zapato|calzado|sandalia|bolso|mochila|gorra|sombrero|gafas|joya|bisuter[ií]a|cintur[oó]n|shoe|bag|hat|jewelry|belt"
GARMENTS = (
    ("one-pieces", "vestido|dress|mono|jumpsuit|overall"),
    ("bottoms", "pantal[oó]n|jean|vaquero|falda|short|bermuda|trouser|skirt"),
    ("tops", "camisa|blusa|camiseta|top|jersey|cardigan|chaqueta|blazer|bomber|polo|shirt|jacket|sweater|coat"),
)
WOMEN, MEN = "mujer|woman|women|chica|girl|femenin|vestido|falda|blusa", "hombre|man|men|chico|boy|masculin"


def says(text: Column | str, words: str) -> Column:
    """Whether a text has one of some words; a word ends where no ASCII letter, digit or underscore follows."""
    own = F.col(text) if isinstance(text, str) else text
    return F.coalesce(own.rlike(rf"(?iu)(?<![A-Za-z0-9_])({words})(?![A-Za-z0-9_])"), F.lit(False))


def garment(text: Column | str) -> Column:
    """Kind of garment by words, the first rule that fits; null for what cannot be worn this way."""
    kind = F.when(says(text, NOT_WORN), F.lit(None).cast("string"))
    for name, words in GARMENTS:
        kind = kind.when(says(text, words), F.lit(name))
    return kind


def wearer(text: Column | str) -> Column:
    """For men where a text names only them, else for women."""
    return F.when(says(text, MEN) & ~says(text, WOMEN), F.lit("male")).otherwise(F.lit("female"))
