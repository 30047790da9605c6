"""Digests and name-based ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: RFC 4122 namespace for domain names.
NAMESPACE = "6ba7b8109dad11d180b400c04fd430c8"


def sha256(content: Column) -> Column:
    """Hex digest; null counts as empty."""
    return F.sha2(F.coalesce(content.cast("binary"), F.lit(b"")), 256)


def uuid5(name: Column, namespace: str = NAMESPACE) -> Column:
    """The version-5 UUID of a name."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    part = lambda a, n: F.substring(h, a, n)
    variant = F.lower(F.lpad(F.hex(F.conv(part(17, 2), 16, 10).cast("int").bitwiseAND(0x3F).bitwiseOR(0x80)), 2, "0"))
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(19, 2)), part(21, 12))


def point_id(repo: Column, path: Column, chunk_hash: Column) -> Column:
    return uuid5(F.concat_ws(":", repo, path, chunk_hash))


def hmac_sha256(key: bytes, message: Column) -> Column:
    """Hex HMAC by two nested digests; the key is a constant, so its pads are too."""
    import hashlib

    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in key)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)


def valid_signature(key: bytes, body: Column, header: Column) -> Column:
    """Whether the header is `sha256=` and the body's HMAC; a missing header is not valid."""
    return F.coalesce(header == F.concat(F.lit("sha256="), hmac_sha256(key, body)), F.lit(False))


def archive_commit(content: Column) -> Column:
    """The commit id that stands for an uploaded archive."""
    return F.concat(F.lit("zip_"), F.substring(sha256(content), 1, 16))
