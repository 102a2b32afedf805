"""Hashes, identities and byte tokens, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The byte tokenizer's end-of-text id; it never occurs in UTF-8.
EOS = 255


def content_hash(text: Column) -> Column:
    """SHA-256 of the UTF-8 text, lowercase hex."""
    return F.sha2(text, 256)


def token_bytes(text: Column) -> Column:
    """The byte tokenizer's ids as little-endian unsigned 32-bit integers, end to end (binary), in one pass over the text."""
    return F.unhex(F.regexp_replace(F.hex(F.encode(text, "UTF-8")), "(..)", "$1000000"))


def token_hash(text: Column) -> Column:
    """SHA-256 of the byte tokens as little-endian unsigned 32-bit integers."""
    return F.sha2(token_bytes(text), 256)


def token_slice(ids: Column, start: Column, n: Column) -> Column:
    """n tokens of a binary token column from place `start` (from 0)."""
    return F.substring(ids, (4 * start + 1).cast("int"), (4 * n).cast("int"))


def hash_bucket(seed: int, content: Column, buckets: int = 10000) -> Column:
    """The first 8 bytes of sha256(seed:content), big-endian, modulo the number of buckets."""
    head = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), content), 256), 1, 16)
    return (F.conv(head, 16, 10).cast("decimal(20,0)") % buckets).cast("long")


def split_of(seed: int, content: Column, validation_permyriad: int) -> Column:
    return F.when(hash_bucket(seed, content) < validation_permyriad, "validation").otherwise("train")


def source_id(identity: Column, content: Column) -> Column:
    """sha256 of the id as JSON; null and empty ids fall back to the content hash. Zero is an id."""
    value = F.to_json(F.struct(identity.alias("v")))
    bare = F.substring(value, F.lit(6), F.length(value) - 6)
    known = identity.isNotNull() & (identity.cast("string") != "")
    return F.when(known, F.concat(F.lit("source-id-sha256:"), F.sha2(bare, 256))).otherwise(F.concat(F.lit("content-sha256:"), content))


def order_key(seed: int, content: Column, identity: Column) -> Column:
    """A deterministic order: sha256 of seed, content hash and id."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), content, identity.cast("string")), 256)
