"""Catalogue queries: synchronisation and reconciliation of the parts with a perturbed copy of them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from siltstone.checkpoints import shared_folder
from siltstone.operators import catalog as C
from siltstone.registry import query
from siltstone.sources import workbooks as W
from siltstone.sources.tables import table


def source(spark, folder):
    own = table(spark, folder, "part").where("p_partkey % 11 != 0")
    kind = F.when(F.col("p_size") % 2 == 0, F.lit("simple")).otherwise(F.lit("variable"))
    return own.select(F.col("p_partkey").cast("string").alias("sku"), kind.alias("type"), F.col("p_name").alias("name"), F.format_string("%.1f", F.round("p_retailprice", 1)).alias("price"))


def target(spark, folder):
    own = table(spark, folder, "part").where("p_partkey % 7 != 0")
    kind = F.when((F.col("p_size") % 2 == 0) != (F.col("p_partkey") % 5 == 0), F.lit("simple")).otherwise(F.lit("variable"))
    name = F.when(F.col("p_partkey") % 13 == 0, F.concat("p_name", F.lit(" x"))).otherwise(F.col("p_name"))
    price = F.when(F.col("p_partkey") % 17 == 0, F.lit("n/a")).otherwise(F.format_string("%.2f", F.round("p_retailprice", 1)))
    return own.select(F.col("p_partkey").cast("string").alias("sku"), kind.alias("type"), name.alias("name"), price.alias("price"), (F.col("p_partkey") % 3 == 0).alias("imported"))


TABLES = """WITH s AS (SELECT p_partkey::VARCHAR AS sku, CASE WHEN p_size % 2 = 0 THEN 'simple' ELSE 'variable' END AS type, p_name AS name, round(p_retailprice, 1) AS price FROM part WHERE p_partkey % 11 <> 0),
t AS (SELECT p_partkey::VARCHAR AS sku, CASE WHEN (p_size % 2 = 0) <> (p_partkey % 5 = 0) THEN 'simple' ELSE 'variable' END AS type, CASE WHEN p_partkey % 13 = 0 THEN p_name || ' x' ELSE p_name END AS name,
 CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE round(p_retailprice, 1) END AS price, p_partkey % 3 = 0 AS imported FROM part WHERE p_partkey % 7 <> 0)
"""


@query(TABLES + """SELECT sku, CASE WHEN t.type IS NULL THEN 'insert' WHEN s.type IS NULL THEN CASE WHEN imported THEN 'delete' ELSE 'keep' END WHEN s.type <> t.type THEN 'replace' ELSE 'update' END AS action FROM s FULL JOIN t USING (sku)""")
def sync_actions(spark, folder):
    return C.sync_actions(source(spark, folder), target(spark, folder))


@query(TABLES + """SELECT sku, CASE WHEN t.name IS NULL THEN 'missing-product' ELSE concat_ws(',', CASE WHEN s.name <> t.name THEN 'name-mismatch' END, CASE WHEN s.price IS DISTINCT FROM t.price THEN 'regular-price-mismatch' END) END AS issues FROM s LEFT JOIN t USING (sku)""")
def reconcile_issues(spark, folder):
    fields = lambda: F.struct("sku", "name", F.col("price").alias("regular_price"), F.lit(None).cast("string").alias("sale_price"), F.lit(None).cast("string").alias("stock_status"), F.lit(0).alias("n_variants"), F.lit(1).alias("n_images"), F.array().cast("array<string>").alias("categories"))
    s, t = (df.select("sku", fields().alias(name)) for df, name in ((source(spark, folder), "source"), (target(spark, folder), "target")))
    return C.reconciliation(s.join(t, "sku", "left")).select("sku", F.array_join("issues", ",").alias("issues"))


@query(TABLES + "SELECT sku, coalesce(s.price = t.price, false) AS equal FROM s JOIN t USING (sku)")
def price_equal_decimal(spark, folder):
    s, t = source(spark, folder).select("sku", F.col("price").alias("a")), target(spark, folder).select("sku", F.col("price").alias("b"))
    return s.join(t, "sku").select("sku", C.price_equal(F.col("a"), F.col("b")).alias("equal"))


@query("SELECT p_brand, array_to_string(list_sort(list_distinct(list(p_type))), ',') AS types, count(*) AS n, max(length(p_name)) AS longest FROM part GROUP BY p_brand")
def brand_facets(spark, folder):
    own = table(spark, folder, "part")
    return own.groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_set("p_type")), ",").alias("types"), F.count(F.lit(1)).alias("n"), F.max(F.length("p_name")).cast("long").alias("longest"))


#: Names of garments by the part's number; the same text in Spark's and DuckDB's SQL.
WORN = "concat(case p_partkey % 13 when 0 then 'Camisa con capucha' when 1 then 'Short baggy' when 2 then 'Bermuda' when 3 then 'CARDIGAN fino' when 4 then 'Vestido con cinturón' when 5 then 'Dress with belt' when 6 then 'Blusa manga larga' when 7 then 'Vestido' when 8 then 'PANTALÓN vaquero' when 9 then 'hats and bags' when 10 then 'topcoat' when 11 then 'coat_x coat' else p_name end, case p_partkey % 5 when 0 then ' hombre' when 1 then ', men' when 2 then ' mujer' when 3 then ' Mens' else '' end)"


@query(f"""SELECT p_partkey, CASE WHEN regexp_matches(t, '(?i)\\b({C.NOT_WORN})\\b') THEN NULL {" ".join(f"WHEN regexp_matches(t, '(?i)\\b({words})\\b') THEN '{name}'" for name, words in C.GARMENTS)} END AS zone,
 CASE WHEN regexp_matches(t, '(?i)\\b({C.MEN})\\b') AND NOT regexp_matches(t, '(?i)\\b({C.WOMEN})\\b') THEN 'male' ELSE 'female' END AS wearer FROM (SELECT p_partkey, {WORN} AS t FROM part)""")
def garment_kinds(spark, folder):
    own = table(spark, folder, "part").select("p_partkey", F.expr(WORN).alias("t"))
    return own.select("p_partkey", C.garment("t").alias("zone"), C.wearer("t").alias("wearer"))


@query("""WITH r AS (SELECT c_custkey, trim(c_name) AS name, CASE WHEN c_custkey % 5 = 0 THEN 'ftp://x' ELSE 'https://' || CASE WHEN c_custkey % 2 = 0 THEN 'www.' ELSE '' END || 'Shop' || (c_custkey % 400) || '.example' || CASE WHEN c_custkey % 3 = 0 THEN '/es/' ELSE '' END END AS website FROM customer),
k AS (SELECT *, 'shop' || (c_custkey % 400) || '.example' || CASE WHEN c_custkey % 3 = 0 THEN '/es' ELSE '' END AS key FROM r WHERE c_custkey % 5 <> 0)
SELECT min_by(name, c_custkey) AS name, min_by(website, c_custkey) AS website, count(*) AS n_rows FROM k GROUP BY key""")
def workbook_shops(spark, folder):
    """Customers as workbooks, written and read back as a list of businesses."""
    at = f"{shared_folder(spark)}/books-{uuid.uuid4().hex}"
    site = """case when c_custkey % 5 = 0 then 'ftp://x' else concat('https://', if(c_custkey % 2 = 0, 'www.', ''), 'Shop', c_custkey % 400, '.example', if(c_custkey % 3 = 0, '/es/', '')) end"""
    rows = table(spark, folder, "customer").orderBy("c_custkey").coalesce(1).select(F.concat(F.lit(" "), "c_name").alias("NOMBRE "), F.expr(site).alias("Página  web"), F.col("c_custkey").alias("Teléfono"))
    W.write_workbooks(rows, at, 10_000_000)
    return W.workbook_businesses(W.workbook_rows(spark, at)).select("name", "website", F.size("rows").cast("long").alias("n_rows"))
