"""Keyed and content digests as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hmac_sha256(key: bytes, message: Column) -> Column:
    """HMAC-SHA256 in hex, composed from sha2; the pads are columns' literals, so use a key meant for one run."""
    import hashlib

    if len(key) > 64:
        key = hashlib.sha256(key).digest()
    key = key.ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)
    return F.sha2(F.concat(F.lit(outer), F.unhex(F.sha2(F.concat(F.lit(inner), message.cast("binary")), 256))), 256)


def base32(hex_digest: Column, letters: int) -> Column:
    """The first letters of the base32 form of a hex digest."""
    digits = F.concat(*[F.lpad(F.conv(F.substring(hex_digest, 10 * k + 1, 10), 16, 32), 8, "0") for k in range(-(-letters // 8))])
    return F.substring(F.translate(digits, "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), 1, letters)


def credential_id(identity: Column) -> Column:
    return base32(F.sha2(identity, 256), 16)


def canonical_digest(*columns: Column) -> Column:
    """SHA-256 over compact JSON of named columns; name them in sorted order."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)
