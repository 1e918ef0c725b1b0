"""Content hashes and seeded orders."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def blake2b8(text: str | None) -> str:
    """BLAKE2b with 8 bytes of digest, as 16 hex characters (they order like the unsigned number); null hashes like ''."""
    return hashlib.blake2b((text or "").encode(), digest_size=8).hexdigest()


@F.pandas_udf(StringType())
def content_hash(text: pd.Series) -> pd.Series:
    return text.map(blake2b8, na_action=None)


def text_key(text: Column) -> Column:
    """JVM-side content key for joins and grouping where the digest itself is not part of the result."""
    return F.md5(F.coalesce(text, F.lit("")))


def seeded(value: Column, seed: str) -> Column:
    """A pseudo-random order that depends on the value and seed only, never on partitions."""
    return F.sha2(F.concat_ws("|", value.cast("string"), F.lit(seed)), 256)


def seeded8(value: Column, seed: str) -> Column:
    """The same with BLAKE2b-8 of value, a bar and the seed, where draws must equal those made with it elsewhere."""
    return content_hash(F.concat_ws("|", value.cast("string"), F.lit(seed)))
