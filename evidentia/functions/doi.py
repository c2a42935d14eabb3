"""DOI forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLANKS = r"(?U)[\s​﻿]+"
_PREFIX = r"^(?:urn:)?(?:https?://)?(?:[a-z0-9-]+\.)*doi\.org/|^(?:info:|urn:)?doi[:/]?"


def canonical_doi(doi: str | Column) -> Column:
    """One form for all ways to write a DOI: lower case, bare, unescaped, without blanks.

    Null where nothing is left.
    """
    c = F.col(doi) if isinstance(doi, str) else doi
    plain = F.when(c.contains("%"), F.coalesce(F.try_url_decode(F.regexp_replace(c, r"\+", "%2B")), c)).otherwise(c)
    bare = F.lower(F.regexp_replace(plain, _BLANKS, ""))
    for _ in range(2):
        bare = F.regexp_replace(bare, _PREFIX, "")
    return F.nullif(bare, F.lit(""))
