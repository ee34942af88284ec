"""The portable ``media`` struct and its two functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query parameters that a media address must not carry (fixed values).
CREDENTIALS = ("signature", "sig", "token", "access_token", "x-amz-signature", "x-goog-signature")


def valid_uri(uri: Column) -> Column:
    """An absolute address without user, password or a credential among its query parameters."""
    absolute = uri.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:")
    user = uri.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*@")
    secret = uri.rlike(rf"(?i)[?&]({'|'.join(CREDENTIALS)})(=|&|#|$)")
    return F.coalesce(absolute & ~user & ~secret, F.lit(False))


def media(uri: Column, media_type: Column, storage_mode: str = "external") -> Column:
    """A reference with its optional fields null."""
    null = lambda kind: F.lit(None).cast(kind)
    return F.struct(
        uri.alias("uri"), media_type.alias("media_type"), null("string").alias("mime_type"), null("bigint").alias("size_bytes"), null("string").alias("etag"), null("timestamp_ntz").alias("modified_at"),
        null("string").alias("catalog_ref"), F.lit(storage_mode).alias("storage_mode"), F.expr("cast(map() as map<string,string>)").alias("metadata"),
    )


def media_uri(value: Column) -> Column:
    return value["uri"]


def media_type(value: Column) -> Column:
    return value["media_type"]
