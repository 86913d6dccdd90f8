"""Ids that follow from names."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F


def name_id(namespace: str, name: Column | str) -> Column:
    """The version-5 UUID of a name in a namespace (RFC 9562): the first 16 bytes of SHA-1 of both, with version and variant set. A null name has none."""
    name = F.col(name) if isinstance(name, str) else name
    h = F.sha1(F.concat(F.unhex(F.lit(uuid.UUID(namespace).hex)), F.encode(name, "UTF-8")))
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    parts = F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12)
    return F.when(h.isNotNull(), F.concat_ws("-", *parts))
