"""Registered queries on text and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scriptorium.llm import lang, mix, noise, pack, pii, toxic
from scriptorium.sources import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Personal information by text, kind and number."""
    return pii.find(table(spark, d, "block"), table(spark, d, "cell"), table(spark, d, "key_value"), table(spark, d, "form_attr"))


def p2_masked(spark: SparkSession, d: str) -> DataFrame:
    """All texts with typed placeholders."""
    return pii.mask(table(spark, d, "block"), table(spark, d, "cell"), table(spark, d, "key_value"), table(spark, d, "form_attr"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Noise of scanned pages by text and kind."""
    return noise.find(table(spark, d, "block"), table(spark, d, "cell"))


def p4_repaired(spark: SparkSession, d: str) -> DataFrame:
    """All texts repaired."""
    return noise.repair(table(spark, d, "block"), table(spark, d, "cell"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Scans with a missing or wrong label, and blocks with foreign sentences."""
    return lang.find(table(spark, d, "scan"), table(spark, d, "block"))


def p5_labels(spark: SparkSession, d: str) -> DataFrame:
    """Language and confidence of every scan and foreign passage."""
    return lang.labels(table(spark, d, "scan"), table(spark, d, "block"))


def p6_packed(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of texts in the containers of each capacity."""
    return pack.pack(table(spark, d, "documents"), table(spark, d, "pack_spec"))


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers are."""
    specs = table(spark, d, "pack_spec")
    return pack.report(pack.pack(table(spark, d, "documents"), specs), specs)


def p7_mixed(spark: SparkSession, d: str) -> DataFrame:
    """The records drawn for each mix."""
    return mix.mix(table(spark, d, "documents"), table(spark, d, "mix_target"))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and reached share of each source in each mix."""
    return mix.shares(table(spark, d, "documents"), table(spark, d, "mix_target"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a toxic passage."""
    return toxic.found(table(spark, d, "documents"), table(spark, d, "mod_sample"))


def p8_rates(spark: SparkSession, d: str) -> DataFrame:
    """Rate of toxic documents by source."""
    return toxic.rates(table(spark, d, "documents"), table(spark, d, "mod_sample"))


QUERIES = {"p6_packed": p6_packed, "p6_report": p6_report, "p7_mixed": p7_mixed, "p7_shares": p7_shares, "p5_found": p5_found, "p5_labels": p5_labels, "p8_found": p8_found, "p8_rates": p8_rates, "p2_found": p2_found, "p2_masked": p2_masked, "p4_found": p4_found, "p4_repaired": p4_repaired}
ORACLES: dict[str, str] = {}
