"""Keyed signatures of request parameters."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the block size of SHA-256.
BLOCK_BYTES = 64


def signed_message(items: Column) -> Column:
    """Parameters (array of key, value) but the signature as sorted ``k=v`` strings, values of one key joined by commas."""
    rest = F.filter(items, lambda p: p["key"] != "signature")
    keys = F.array_distinct(F.transform(rest, lambda p: p["key"]))
    rendered = F.transform(keys, lambda k: F.concat(k, F.lit("="), F.array_join(F.transform(F.filter(rest, lambda p: p["key"] == k), lambda p: p["value"]), ",")))
    return F.array_join(F.array_sort(rendered), "")


def provided_signature(items: Column) -> Column:
    """The last signature given, empty without one."""
    given = F.filter(items, lambda p: p["key"] == "signature")
    return F.coalesce(F.try_element_at(F.transform(given, lambda p: p["value"]), F.lit(-1)), F.lit(""))


def hmac_sha256(message: Column, secret: str) -> Column:
    """The HMAC-SHA256 of a string in lowercase hex, from the hash function alone."""
    key = secret.encode()
    key = (hashlib.sha256(key).digest() if len(key) > BLOCK_BYTES else key).ljust(BLOCK_BYTES, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in key)) for pad in (0x36, 0x5C))
    inside = F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256))
    return F.sha2(F.concat(outer, inside), 256)


def valid_signature(items: Column, secret: str) -> Column:
    """Whether parameters carry the HMAC-SHA256 of their message in hex.

    Hashes of both are compared, so how long that takes tells nothing of the signature.
    Null parameters carry none.
    """
    same = F.sha2(hmac_sha256(signed_message(items), secret), 256) == F.sha2(provided_signature(items), 256)
    return F.coalesce(same, F.lit(False))
