"""Token maps as text, and their encryption at rest (AES, 256-bit key, GCM)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAP = "map<string,string>"


def key_of(secret: str) -> Column:
    """The key as a literal of 32 bytes; the secret itself enters no plan."""
    import hashlib

    return F.lit(bytearray(hashlib.sha256(secret.encode("utf-8")).digest()))


def encode_map(token_map: Column) -> Column:
    return F.to_json(token_map)


def decode_map(text: Column) -> Column:
    return F.from_json(text, MAP)


def encrypt_map(token_map: Column, secret: str) -> Column:
    return F.aes_encrypt(encode_map(token_map).cast("binary"), key_of(secret), F.lit("GCM"))


def decrypt_map(stored: Column, secret: str) -> Column:
    """The map; a row stored in clear is read as such, an unreadable one is empty."""
    opened = F.try_aes_decrypt(stored, key_of(secret), F.lit("GCM")).cast("string")
    return F.coalesce(
        decode_map(opened), decode_map(stored.cast("string")), F.create_map().cast(MAP)
    )


def readable(stored: Column, secret: str) -> Column:
    """Whether the row can be opened at all, so a wrong key does not pass unseen."""
    opened = F.try_aes_decrypt(stored, key_of(secret), F.lit("GCM")).cast("string")
    return F.coalesce(decode_map(opened), decode_map(stored.cast("string"))).isNotNull()
