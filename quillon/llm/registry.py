"""The queries of this package and the SQL that some of them have."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

NAMES = {"op1_media_sniffing": "media", "op9_simhash_vptree": "simhash", "op5_contextual_pii": "pii", "op10_license_diagonals": "licenses", "op2_bradley_terry": "quality", "op4_text_density": "extract", "op7_bm25_blockmax_wand": "decontaminate", "op6_line_minhash": "linededup", "op3_raked_mixture": "mixing", "op8_secret_forest": "secrets"}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: getattr(import_module(f"quillon.llm.{module}"), name) for name, module in NAMES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"quillon.llm.{module}"), "ORACLE_SQL", {}).get(name) for name, module in NAMES.items()}
    return {name: sql for name, sql in found.items() if sql}
