"""HMAC-SHA256 as a native expression: two SHA-256 passes over padded keys."""

from __future__ import annotations

from hashlib import sha256

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLOCK = 64


def _pads(secret: str) -> tuple[str, str]:
    key = secret.encode()
    if len(key) > _BLOCK:
        key = sha256(key).digest()
    key = key.ljust(_BLOCK, b"\0")
    return bytes(b ^ 0x36 for b in key).hex(), bytes(b ^ 0x5C for b in key).hex()


def signature(secret: str, body: Column) -> Column:
    """Base64 signature of a text body (its UTF-8 bytes)."""
    inner_pad, outer_pad = _pads(secret)
    inner = F.sha2(F.concat(F.unhex(F.lit(inner_pad)), F.encode(body, "UTF-8")), 256)
    outer = F.sha2(F.concat(F.unhex(F.lit(outer_pad)), F.unhex(inner)), 256)
    return F.base64(F.unhex(outer))


def verdict(secret: str, body: Column, header: Column) -> Column:
    """``missing``, ``invalid`` or ``valid``; an empty secret validates nothing."""
    if not secret:
        return F.when(F.coalesce(header, F.lit("")) == "", "missing").otherwise("invalid")
    return (
        F.when(F.coalesce(header, F.lit("")) == "", "missing")
        .when(signature(secret, body) == header, "valid")
        .otherwise("invalid")
    )
