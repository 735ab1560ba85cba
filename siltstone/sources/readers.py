"""Readers of captures: tolerant JSON, archives, manifests, business lists, layered settings."""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import urls as U
from siltstone.functions.text import collapsed, slug
from siltstone.operators.frontier import first_wins, numbered_slugs


def json_documents(spark: SparkSession, path: str) -> DataFrame:
    """path and document of each file as a variant; what does not parse is null and fails no job."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return raw.select("path", F.try_parse_json("value").alias("document"))


def archive_members(spark: SparkSession, path: str, suffixes: tuple[str, ...] = (".html", ".json", ".css", ".js", ".txt")) -> DataFrame:
    """archive, name, text and problem of the text members of ZIP archives; stored and deflated ones only, with safe names.

    A member that cannot be read has a ``problem`` and no text; an archive that is none has a row without a name.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def members(content: memoryview) -> Iterator[tuple[str | None, str | None, str | None]]:
        try:
            archive = zipfile.ZipFile(io.BytesIO(content))
        except (zipfile.BadZipFile, OSError, ValueError) as problem:
            yield None, None, str(problem)
            return
        with archive:
            for info in archive.infolist():
                if info.is_dir() or not info.filename.endswith(suffixes) or info.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
                    continue
                if info.filename.startswith("/") or ".." in info.filename.split("/"):
                    continue
                try:
                    yield info.filename, archive.read(info).decode("utf-8", "replace"), None
                except (zipfile.BadZipFile, zlib.error, OSError, EOFError, RuntimeError, NotImplementedError) as problem:
                    yield info.filename, None, str(problem)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for row in members(content.as_buffer()):
                    yield pa.RecordBatch.from_arrays([pa.array([x], pa.string()) for x in (at, *row)], ["archive", "name", "text", "problem"])

    return files.mapInArrow(run, "archive string, name string, text string, problem string")


def manifest_pages(manifest: DataFrame, models: DataFrame, found: DataFrame) -> DataFrame:
    """Pages that a manifest (site, slug, url) names with their models; sites without a manifest take what was found."""
    listed = manifest.join(models, ["site", "slug"], "left").select("site", "slug", F.coalesce("url", "model_url").alias("url"), "title", F.col("title").isNotNull().alias("has_model"))
    rest = found.join(manifest.select("site").distinct(), "site", "left_anti").join(models, ["site", "slug"], "left")
    return listed.unionByName(rest.select("site", "slug", F.col("model_url").alias("url"), "title", F.col("title").isNotNull().alias("has_model")))


def businesses(rows: DataFrame) -> DataFrame:
    """Businesses (place, name, website) with an http(s) site, the first of each site, with numbered slugs."""
    own = rows.where(U.is_http(F.trim("website"))).withColumn("key", U.site_key(F.trim("website")))
    own = first_wins(own, "key", "place").withColumn("base", slug(F.coalesce(collapsed("name"), F.lit("")), 72, "tienda"))
    return numbered_slugs(own, "base", "place", "slug").drop("base")


def settings(*layers: Mapping[str, object]) -> dict[str, object]:
    """Layers of settings, later ones first; texts that say true, false or a number become that."""

    def value(x: object) -> object:
        if not isinstance(x, str):
            return x
        if x in ("true", "false"):
            return x == "true"
        try:
            return float(x) if "." in x else int(x)
        except ValueError:
            return x

    out: dict[str, object] = {}
    for layer in layers:
        out |= {k: value(v) for k, v in layer.items()}
    return out


def jobs(rows: DataFrame) -> dict[str, DataFrame]:
    """The views of stored jobs: by newest, still open, and without the report."""
    terminal = ["completed", "failed", "cancelled", "ready", "needs_review", "report_ready", "blocked"]
    return {
        "newest": rows.orderBy(F.desc("created_at"), "id"),
        "open": rows.where(~F.col("status").isin(*terminal)).orderBy("created_at", "id"),
        "summary": rows.withColumn("seo_report_json", F.lit(None).cast("string")),
    }


def patched(base: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    """``base`` with the fields that a patch gives; what it leaves null stays."""
    fields = [c for c in base.columns if c != key]
    p = patch.select(key, *[F.col(c).alias(f"_new_{c}") if c in patch.columns else F.lit(None).alias(f"_new_{c}") for c in fields])
    return base.join(p, key, "left").select(key, *[F.coalesce(f"_new_{c}", c).alias(c) for c in fields])


def with_columns(rows: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Adds the columns that older rows lack, as nulls."""
    return rows.withColumns({c: F.lit(None).cast(kind) for c, kind in kinds.items() if c not in rows.columns})


def is_uuid(value: Column | str) -> Column:
    c = F.col(value) if isinstance(value, str) else value
    return F.coalesce(c.rlike(r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"), F.lit(False))
