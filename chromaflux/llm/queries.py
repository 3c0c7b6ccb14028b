"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import documents
from .decontam import op8_decontamination
from .license import op3_license
from .lm import op1_lm
from .merkle import op4_merkle
from .packing import op7_packing
from .pii import op9_pii
from .quality import op6_quality, quality_tables
from .repair import op11_repair
from .repeats import op5_repeats
from .secret import op2_secrets
from .simhash import op10_simhash
from .tokens import op13_tokens
from .whitening import op12_whitening


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_lm": op1_lm,
        "op2_secrets": lambda spark, d: op2_secrets(documents(spark, d, "doc_id", "text", "source")),
        "op10_simhash": lambda spark, d: op10_simhash(documents(spark, d)),
        "op3_license": lambda spark, d: op3_license(documents(spark, d)),
        "op4_merkle": lambda spark, d: op4_merkle(documents(spark, d)),
        "op5_repeats": lambda spark, d: op5_repeats(documents(spark, d)),
        "op6_quality": lambda spark, d: op6_quality(*quality_tables(spark, d)),
        "op8_decontamination": lambda spark, d: op8_decontamination(documents(spark, d), spark.read.parquet(f"{d}/benchmark.parquet")),
        "op7_packing": lambda spark, d: op7_packing(documents(spark, d)),
        "op9_pii": lambda spark, d: op9_pii(documents(spark, d)),
        "op11_repair": lambda spark, d: op11_repair(spark.read.parquet(f"{d}/conversations.parquet")),
        "op12_whitening": lambda spark, d: op12_whitening(spark.read.parquet(f"{d}/embeddings.parquet")),
        "op13_tokens": lambda spark, d: op13_tokens(documents(spark, d)),
    }


def oracle_sql() -> dict[str, str]:
    return {}
