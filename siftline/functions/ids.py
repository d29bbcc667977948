"""Name-based ids (version 5) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Namespaces of passages, chunks and chunks of the study.
PASSAGE_NAMESPACE = "018f0884-e1c7-7e4f-a9c2-0f6b2a8d4e10"
CHUNK_NAMESPACE = "5eb87ec6-06da-4ad2-8a61-dff55c8b11ee"
STUDY_NAMESPACE = "9c92e2fa-5f06-4db4-9cd9-2a69695be660"
SEP = "\x1f"


def uuid5(namespace: str, name: Column) -> Column:
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab89ab89ab89ab"), F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") + 1, F.lit(1))
    return F.concat(
        F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("-5"), F.substring(digest, 14, 3), F.lit("-"), variant, F.substring(digest, 18, 3), F.lit("-"), F.substring(digest, 21, 12)
    )


def joined(*parts) -> Column:
    return F.concat_ws(SEP, *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts])
