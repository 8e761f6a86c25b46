"""Personal data: marked in column metadata, masked by role.

This is a policy for views, not a security boundary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import pseudonym

#: Roles that see values as they are, and the roles each inherits from.
CLEAR_ROLES = {"PII_READER", "TRANSFORMER", "LOADER"}
INHERITS = {"PII_READER": {"ANALYST"}, "ADMIN": {"ANALYST", "TRANSFORMER", "LOADER"}, "ANALYST": set(), "TRANSFORMER": set(), "LOADER": set()}


def tag(df: DataFrame, **kinds: str) -> DataFrame:
    """Mark columns, e.g. tag(df, user_id="pseudonymous"). The mark follows a
    column through projections, filters and joins."""
    return df.select(*[F.col(f"`{c}`").alias(c, metadata=df.schema[c].metadata | {"pii": kinds[c]}) if c in kinds else F.col(f"`{c}`") for c in df.columns])


def tagged(df: DataFrame) -> dict[str, str]:
    return {f.name: f.metadata["pii"] for f in df.schema if "pii" in f.metadata}


def mask(df: DataFrame, role: str, salt: str) -> DataFrame:
    """The frame as a role may see it: marked columns become salted SHA-256
    digests unless the role reads clear; null stays null."""
    hidden = {} if role in CLEAR_ROLES else tagged(df)
    return df.select(*[pseudonym(F.col(f"`{c}`"), salt).alias(c) if c in hidden else F.col(f"`{c}`") for c in df.columns])


def may_use(role: str, needed: str) -> bool:
    """Whether a role holds another's rights, through what it inherits."""
    return role == needed or any(may_use(r, needed) for r in INHERITS.get(role, ()))
