"""Deterministic per-row hashes and uniforms.

Sampling, splitting and the Sobol design draw their randomness from ``md5`` of
``"<salt>:<seed>:<key>"``.  The draw of a row depends only on its key, never on
partitioning, task order or retries, so a re-run after an executor loss, or an
independent SQL engine, selects exactly the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HEX_DIGITS_PER_UNIFORM = 13            # 52 bits: exact in a double
UNIFORM_SCALE = float(16 ** HEX_DIGITS_PER_UNIFORM)


def hash_hex(key: str | Column, seed: int, salt: str) -> Column:
    """32-char lowercase hex md5 of ``salt:seed:key``; orders rows uniformly.

    A NULL key fails the job: all such rows would share one hash, and which of
    them a sample takes would be left to chance."""
    k = (F.col(key) if isinstance(key, str) else key).cast("string")
    k = F.coalesce(k, F.raise_error(F.lit("a row to be hashed has no key")).cast("string"))
    return F.md5(F.concat_ws(":", F.lit(salt), F.lit(str(seed)), k))


def uniform(key: str | Column, seed: int, salt: str) -> Column:
    """A uniform double in [0, 1) from the first 52 bits of the md5."""
    h = hash_hex(key, seed, salt)
    bits = F.conv(F.substring(h, 1, HEX_DIGITS_PER_UNIFORM), 16, 10).cast("bigint")
    return bits.cast("double") / F.lit(UNIFORM_SCALE)
