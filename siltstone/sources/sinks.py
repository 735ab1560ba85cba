"""Writers of what a crawl yields: each by itself, with a status for each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HEAVY = ("html", "page_content", "page_html", "screenshot", "computed_styles", "nodes")
PAGE_COLUMNS = ("url", "final_url", "status_code", "title", "description", "canonical", "h1_count", "words", "html_bytes", "response_ms", "noindex", "nofollow", "images_without_alt", "heavy_images", "broken_links")


def light(pages: DataFrame) -> DataFrame:
    return pages.drop(*HEAVY)


def public(rows: DataFrame) -> DataFrame:
    """Without the columns whose names begin with an underscore."""
    return rows.select(*[c for c in rows.columns if not c.startswith("_")])


def write_all(spark: SparkSession, writers: dict[str, Callable[[], None]]) -> DataFrame:
    """Run every writer; one that fails does not keep the others from it.  name, ok, error."""
    told = []
    for name, write in writers.items():
        try:
            write()
            told.append((name, True, None))
        except Exception as error:  # noqa: BLE001  a writer may fail in any way
            told.append((name, False, str(error)[:500]))
    return spark.createDataFrame(told, "name string, ok boolean, error string")


def pages_csv(judged: DataFrame, path: str) -> None:
    """Pages as CSV with every cell quoted and quotes doubled; the issues' codes are one cell."""
    own = judged.select(*[c for c in PAGE_COLUMNS if c in judged.columns], F.array_join(F.transform("issues", lambda x: x["code"]), " | ").alias("issues"))
    own.write.mode("overwrite").csv(path, header=True, quoteAll=True, quote='"', escape='"')


def pages_json(judged: DataFrame, path: str) -> None:
    """Pages without heavy columns as JSON lines; Spark's committer makes the result appear as a whole."""
    light(judged).write.mode("overwrite").json(path)


def manifest(summary: DataFrame, products: DataFrame, path: str) -> None:
    """One row for a crawl: its totals, and whether it sells anything."""
    sold = products.agg(F.count(F.lit(1)).alias("products"))
    summary.crossJoin(F.broadcast(sold)).withColumn("is_shop", F.col("products") > 0).coalesce(1).write.mode("overwrite").json(path)  # one row each


def shop_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").csv(path, header=True, quoteAll=True, quote='"', escape='"')


def site_index(pages: DataFrame, menu: int = 20) -> DataFrame:
    """The menu of each site: its first pages in order, with slugs."""
    from siltstone.functions import text as S
    from siltstone.functions import urls as U
    from siltstone.operators.frontier import capped

    own = capped(pages.withColumn("site", U.host("url")), "site", "place", menu)
    return own.select("site", "place", S.path_slug(U.path("url")).alias("slug"), "title")


def checkpointed(phases: DataFrame, inputs: DataFrame) -> DataFrame:
    """Phases that may be skipped: completed, on inputs (name, content) whose digest is the same as then."""
    now = inputs.select("name", F.sha2("content", 256).alias("digest"))
    own = phases.join(now.withColumnRenamed("digest", "now"), "name", "left")
    return own.withColumn("skip", (F.col("status") == "completed") & F.col("digest").eqNullSafe(F.col("now"))).drop("now")
