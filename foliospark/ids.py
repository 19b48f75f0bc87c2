"""Ids: random ones for the driver, derived ones for transformations (tasks may run again)."""

from __future__ import annotations

import os
import time

from pyspark.sql import Column
from pyspark.sql import functions as F

ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
PREFIXES = {"document": "doc", "section": "sec", "version": "ver", "snapshot": "snap", "revision": "rev"}


def base62(number: int, width: int = 22) -> str:
    out = ""
    for _ in range(width):
        number, digit = divmod(number, 62)
        out = ALPHABET[digit] + out
    return out


def new_id(kind: str) -> str:
    """Prefix and 22 base62 digits of a time-ordered UUID: ids sort by creation time. Driver only."""
    raw = (int(time.time() * 1000) << 80) | int.from_bytes(os.urandom(10), "big")
    raw = (raw & ~(0xF << 76)) | (0x7 << 76)
    raw = (raw & ~(0x3 << 62)) | (0x2 << 62)
    return f"{PREFIXES[kind]}-{base62(raw)}"


def derived_id(kind: str, *parts: Column) -> Column:
    """The same id for the same parts, however often a task runs."""
    return F.concat(F.lit(PREFIXES[kind] + "-"), F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, 22))
