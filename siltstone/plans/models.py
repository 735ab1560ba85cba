"""Queries of page models: stored by version, read back, and taken apart again; the SQL is that of the tables they were made of."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.checkpoints import shared_folder
from siltstone.operators import models as M
from siltstone.plans import layout
from siltstone.registry import ORACLES, query


def captured(spark, folder) -> DataFrame:
    """The derived pages of the layout queries as captured pages."""
    own = layout.pages(spark, folder)
    place = F.regexp_extract("url", "/p([0-9]+)", 1).cast("long")
    return own.select(F.lit("site.example").alias("site"), place.alias("place"), F.col("url").alias("source_url"), "url", F.when(place % 9 == 0, 404).otherwise(200).alias("status_code"), F.lit(1).alias("depth"), "html")


def stored(spark, folder) -> DataFrame:
    """Their models, written and read back."""
    at = f"{shared_folder(spark)}/models-{uuid.uuid4().hex}"
    M.write_models(M.nested(M.page_tables(captured(spark, folder))), at)
    return M.read_models(spark, at)


def long(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in columns})


@query(ORACLES["layout_sections"])
def restored_sections(spark, folder):
    return long(M.tables_of(stored(spark, folder))["sections"].withColumnRenamed("page", "url"), "section", "columns", "elements")


@query(ORACLES["layout_blocks"])
def restored_blocks(spark, folder):
    own = M.tables_of(stored(spark, folder))["blocks"].withColumnRenamed("page", "url").withColumn("images", F.size("media")).drop("media")
    return long(own, "section", "level", "node", "parent", "images")


@query(
    layout.TREE
    + """g AS (SELECT url, count(*) FILTER (tag = 'h2') AS h2, string_agg(CASE WHEN tag = 'h3' THEN text END, '|' ORDER BY node) AS h3, count(DISTINCT CASE WHEN tag = 'a' THEN regexp_extract(tok, 'href="([^"]*)"', 1) END) AS internal, count(*) FILTER (tag = 'img') AS images, count(*) FILTER (tag = 'img' AND contains(tok, 'src=')) AS media_refs,
 count(*) FILTER (tag = 'aside') AS widgets, count(*) FILTER (tag = 'form') AS forms FROM a GROUP BY url)
SELECT regexp_extract(url, '/p([0-9]+)', 1)::BIGINT AS place, replace(regexp_extract(url, 'example/(.*)$', 1), '/', '-') AS slug, 't' AS title, '' AS meta_description, url AS canonical, h2, coalesce(h3, '') AS h3, internal, images, media_refs, widgets, forms,
 'page:' || replace(regexp_extract(url, 'example/(.*)$', 1), '/', '-') AS model_ref, 'b' AS body_classes FROM g"""
)
def restored_pages(spark, folder):
    own = stored(spark, folder)
    pages = M.restored(own)[0].join(own.select("place", F.array_join("body_classes", " ").alias("body_classes")), "place")
    forms = F.size(F.array_distinct(F.transform("forms", lambda x: x["form"])))
    sizes = {"h2": F.size("h2"), "internal": F.size("internal"), "images": F.size("images"), "media_refs": F.size("media_refs"), "widgets": F.size("widgets"), "forms": forms}
    own = pages.select("place", "slug", "title", "meta_description", "canonical", *[v.cast("long").alias(k) for k, v in sizes.items()], F.array_join("h3", "|").alias("h3"), "model_ref", "body_classes")
    return own


@query(
    layout.TREE + "m AS (SELECT *, regexp_extract(url, '/p([0-9]+)', 1)::BIGINT AS place FROM p) SELECT row_number() OVER (ORDER BY place) AS n, 't' AS title, replace(regexp_extract(url, 'example/(.*)$', 1), '/', '-') AS slug FROM m QUALIFY n <= 20"
)
def restored_menu(spark, folder):
    return long(M.restored(stored(spark, folder))[1].drop("site"), "n")
