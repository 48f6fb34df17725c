"""Signed payload intake."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.functions import signing


def verify(payloads: DataFrame, secret: str) -> DataFrame:
    """Payload rows (``body, signature``) with their verdict."""
    return payloads.withColumn("verdict", signing.verdict(secret, F.col("body"), F.col("signature")))


def accepted(verified: DataFrame) -> DataFrame:
    return verified.filter(F.col("verdict") == "valid")


def rejected(verified: DataFrame) -> DataFrame:
    return verified.filter(F.col("verdict") != "valid")


def erase_requests(verified: DataFrame, topic: str = "tenant/erase") -> DataFrame:
    """Tenants named by valid erase requests."""
    asked = accepted(verified).filter(F.col("topic") == topic)
    return asked.select(F.get_json_object("body", "$.shop_domain").alias("shop_domain")).filter(
        F.col("shop_domain").isNotNull()
    ).distinct()
