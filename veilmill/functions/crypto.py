"""Keyed digests and sealed values as built-in expressions; keys stay on the driver and enter plans as pads."""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import Column
from pyspark.sql import functions as F


def pads(key: bytes) -> tuple[bytes, bytes]:
    """Inner and outer padded key of HMAC-SHA256."""
    if len(key) > 64:
        key = hashlib.sha256(key).digest()
    key = key.ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)


def hmac_hex(key: bytes, message: Column) -> Column:
    """Lowercase hex HMAC-SHA256 of a string or binary column."""
    inner, outer = pads(key)
    return F.sha2(F.concat(F.lit(outer), F.unhex(F.sha2(F.concat(F.lit(inner), message.cast("binary")), 256))), 256)


def hmac_sql(key: bytes, message: str) -> str:
    """The same digest of a text expression as DuckDB SQL."""
    inner, outer = (p.hex() for p in pads(key))
    return f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({message}))))"


def derive(master: bytes, purpose: str) -> bytes:
    return hmac.new(master, purpose.encode(), hashlib.sha256).digest()


def prefixed(*parts: Column) -> Column:
    """Parts behind their byte lengths in four bytes each, so that no two lists of parts run together."""
    out = []
    for p in parts:
        b = p.cast("binary")
        out += [F.unhex(F.lpad(F.hex(F.octet_length(b).cast("bigint")), 8, "0")), b]
    return F.concat(*out)


def prefixed_sql(*parts: str) -> str:
    return " || ".join(f"unhex(lpad(to_hex(octet_length(encode({p}))), 8, '0')) || encode({p})" for p in parts)


def number(digest: Column, at: int = 0) -> Column:
    """Eight bytes of a hex digest, from byte at, as an unsigned whole number."""
    return F.conv(F.substring(digest, 2 * at + 1, 16), 16, 10).cast("decimal(20,0)")


def choice(values: list[str] | tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(index, F.lit(len(values)).cast("decimal(20,0)")) + 1).cast("int"))


#: Sealed values are padded to a multiple of this, which hides lengths.
SEAL_BLOCK = 32


def seal(key: bytes, value: Column, bound_to: Column) -> Column:
    """AES-256-GCM of the value, its length in front and zeros behind, bound to the row it belongs to; a random nonce."""
    raw = value.cast("binary")
    size = F.octet_length(raw)
    zeros = F.unhex(F.repeat(F.lit("00"), F.pmod(F.lit(SEAL_BLOCK) - F.pmod(size + 4, F.lit(SEAL_BLOCK)), F.lit(SEAL_BLOCK))))
    payload = F.concat(F.unhex(F.lpad(F.hex(size.cast("bigint")), 8, "0")), raw, zeros)
    return F.aes_encrypt(payload, F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), F.lit(b""), bound_to)


def unseal(key: bytes, sealed: Column, bound_to: Column) -> Column:
    """The sealed value; a wrong key or a value moved to another row is an error, never a guess."""
    payload = F.aes_decrypt(sealed, F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), bound_to)
    size = F.conv(F.hex(F.substring(payload, 1, 4)), 16, 10).cast("int")
    return F.substring(payload, F.lit(5), size).cast("string")
