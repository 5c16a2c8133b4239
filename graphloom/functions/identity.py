"""Content identities as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import DIGEST_PATTERN, ID_NAMESPACE


def stable_uuid(path: Column, namespace: str = ID_NAMESPACE) -> Column:
    """The UUID of version 5 of a path in a namespace; null for a null path."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(path, "UTF-8")))
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12))


def is_digest(value: Column) -> Column:
    """Whether a value is 64 lower-case hexadecimal digits; false for null."""
    return F.coalesce(value.rlike(DIGEST_PATTERN), F.lit(False))


def content_digest(*parts: Column) -> Column:
    """SHA-256 of the parts, each with its length ahead, so that no two lists of parts are spelled alike."""
    spelled = [F.when(p.isNull(), F.lit("-;")).otherwise(F.concat(F.octet_length(p.cast("string")).cast("string"), F.lit(":"), p.cast("string"), F.lit(";"))) for p in parts]
    return F.sha2(F.concat(*spelled), 256)
