"""The registered query of each operator, over its whole table, and its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siltstone.llm.oracles import ORACLES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm.decontamination import matches

    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def benchmark_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The members that stand behind op1's rows."""
    from siltstone.llm.decontamination import families

    return families(table(spark, sf_dir, "benchmark"))


def benchmark_wording(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of words that documents share with any item of the benchmark, common wording too."""
    from siltstone.llm.decontamination import wording

    return wording(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm.suffix_dedup import deduplicate

    return deduplicate(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op3_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm.weak_quality import score

    return score(table(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm.pii import find

    return find(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm.quality_rules import judge

    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm.toxicity import score

    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm.minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm.html_text import extract

    return extract(table(spark, sf_dir, "pages"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm.lm_scoring import score

    return score(table(spark, sf_dir, "documents"))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm.warc import archived

    return archived(table(spark, sf_dir, "pages"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm.ranked_search import search

    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm.whitening import GRID, whiten

    return whiten(table(spark, sf_dir, "embeddings"), grid=GRID)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_weak_quality": op3_weak_quality,
    "op4_pii": op4_pii,
    "op5_quality_rules": op5_quality_rules,
    "op6_toxicity": op6_toxicity,
    "op7_minhash": op7_minhash,
    "op8_html_text": op8_html_text,
    "op9_packing": op9_packing,
    "op10_lm_scoring": op10_lm_scoring,
    "op11_warc": op11_warc,
    "op12_ranked_search": op12_ranked_search,
    "op13_whitening": op13_whitening,
    "benchmark_families": benchmark_families,
    "benchmark_wording": benchmark_wording,
}

__all__ = ["ORACLES", "QUERIES"]
