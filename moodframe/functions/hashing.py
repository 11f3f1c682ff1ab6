"""Deterministic randomness.

Every random choice in the library is a pure function of
``(row key, seed, salt, k)`` so that results do not depend on partitioning,
survive task retries unchanged, and can be reproduced by an independent SQL
engine. ``u01`` maps to [0, 1) using the first 52 bits of an md5 digest.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_POW_52 = 4503599627370496.0


def _as_str(c) -> Column:
    if isinstance(c, Column):
        return c.cast("string")
    return F.lit(str(c))


def hash_key(*parts) -> Column:
    return F.concat_ws(":", *[_as_str(p) for p in parts])


def u01(key, seed=42, salt="", k=0) -> Column:
    """Uniform [0,1) number from md5(key:seed:salt:k)."""
    digest = F.md5(hash_key(key, seed, salt, k))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") / F.lit(TWO_POW_52)


def pick_index(n, key, seed=42, salt="", k=0) -> Column:
    """Integer in [0, n) chosen by ``u01``."""
    n_col = n if isinstance(n, Column) else F.lit(n)
    return F.floor(u01(key, seed, salt, k) * n_col).cast("int")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row. A column that is
    only used inside a lambda may be inlined there and evaluated per element;
    a lambda variable can't be."""
    return F.element_at(F.transform(F.array(value), lambda v: body(v)), 1)


# ---- DuckDB text for the oracle SQL -------------------------------------

def sql_key(*parts: str) -> str:
    return "concat_ws(':', " + ", ".join(f"CAST({p} AS VARCHAR)" for p in parts) + ")"


def sql_u01(key: str, seed=42, salt="", k="0") -> str:
    digest = f"md5({sql_key(key, repr(str(seed)), repr(str(salt)), str(k))})"
    return f"(CAST(('0x' || substr({digest}, 1, 13)) AS BIGINT) / {TWO_POW_52})"


def sql_pick_index(n: str, key: str, seed=42, salt="", k="0") -> str:
    return f"CAST(floor({sql_u01(key, seed, salt, k)} * ({n})) AS INTEGER)"
