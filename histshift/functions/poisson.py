"""Deterministic Poisson(1) bootstrap weights (B1).

Every weight is a pure function of (client, build, replicate, seed): a 32-bit uniform
integer taken from a hash, mapped through the Poisson(1) inverse CDF by integer
comparisons. Recomputing a lost partition gives the same weights, so no cache or
checkpoint is needed for correctness, and any SQL engine with md5 reproduces them.
"""

from __future__ import annotations

import decimal
from fractions import Fraction
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO32 = 1 << 32


@lru_cache(maxsize=None)
def poisson1_thresholds() -> tuple[int, ...]:
    """T_k = ceil(P(X <= k) * 2**32) for X ~ Poisson(1), while T_k < 2**32.

    w = #{k : u >= T_k} for a uniform integer u in [0, 2**32) is Poisson(1) up to the
    2**-32 resolution of u. Computed with 60-digit arithmetic, so every engine that
    compares integers gets identical weights.
    """
    ctx = decimal.Context(prec=60)
    e_inv = Fraction(ctx.exp(decimal.Decimal(-1)))
    out, cdf, term, k = [], Fraction(0), Fraction(1), 0
    while True:
        cdf += term
        t = -((-(e_inv * cdf * TWO32).numerator) // (e_inv * cdf * TWO32).denominator)
        if t >= TWO32:
            return tuple(out)
        out.append(int(t))
        k += 1
        term /= k


def hash_key_text(client: Column, build: Column, rep: Column, seed: int = 0) -> Column:
    parts = [client, build, rep.cast("string")]
    if seed:
        parts.append(F.lit(str(seed)))
    return F.concat_ws("|", *parts)


def uniform32(client: str | Column, build: str | Column, rep: str | Column,
              seed: int = 0, method: str = "md5") -> Column:
    """A uniform integer in [0, 2**32) per (client, build, rep, seed).

    md5: first 8 hex digits of md5('client|build|rep[|seed]') (portable to SQL engines).
    xxhash64: high 32 bits of Spark's xxhash64 over the same values (about 3x faster).
    """
    c = F.col(client) if isinstance(client, str) else client
    b = F.col(build) if isinstance(build, str) else build
    r = F.col(rep) if isinstance(rep, str) else rep
    if method == "md5":
        hexs = F.substring(F.md5(hash_key_text(c, b, r, seed)), 1, 8)
        return F.conv(hexs, 16, 10).cast("bigint")
    if method == "xxhash64":
        return F.shiftrightunsigned(F.xxhash64(c, b, r, F.lit(seed)), 32)
    raise ValueError(f"unknown uniform method {method!r}")


def hash_key_start(client: str | Column, build: str | Column) -> Column:
    """The part of ``hash_key_text`` before the replicate, the same for all of them."""
    return F.concat_ws("|", client, build, F.lit(""))


def hex_digits(start: str | Column, rep: Column, seed: int = 0) -> Column:
    """The md5 text whose first 8 digits are the uniform integer of ``uniform32``; ``start`` is
    ``hash_key_start`` of the client and build."""
    parts = [F.col(start) if isinstance(start, str) else start, rep.cast("string")]
    return F.md5(F.concat(*parts, *([F.lit(f"|{seed}")] if seed else [])))


def poisson1_from_hex(digits: Column) -> Column:
    """``poisson1_from_uniform`` of the md5 text itself: lower-case digits of one length order as
    the integers they write, so no text is converted. NULL where the weight is 0."""
    ts = [f"{t:08x}" for t in poisson1_thresholds()]
    expr = F.when(digits < F.lit(ts[0]), F.lit(None).cast("int"))
    for k, t in enumerate(ts[1:], start=1):
        expr = expr.when(digits < F.lit(t), F.lit(k))
    return expr.otherwise(F.lit(len(ts)))


def poisson1_from_uniform(u: Column) -> Column:
    """Inverse CDF as a CASE chain: on average two comparisons per weight."""
    ts = poisson1_thresholds()
    expr = F.when(u < F.lit(ts[0]), F.lit(0))
    for k, t in enumerate(ts[1:], start=1):
        expr = expr.when(u < F.lit(t), F.lit(k))
    return expr.otherwise(F.lit(len(ts)))
