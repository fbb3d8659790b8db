"""Deterministic audit sampling by a 64-bit wrapping hash, in decimal limbs (ANSI mode forbids bigint overflow)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values of the sampling hash
MULTIPLIER = 2654435761
OFFSET = 0x9E3779B97F4A7C15
FINAL = 0x2545F4914F6CDD1D


def _limbs(x: Column) -> tuple[Column, Column]:
    """High and low 32 bits of a bigint read as unsigned."""
    return F.shiftrightunsigned(x, 32), x.bitwiseAND(F.lit(0xFFFFFFFF))


def _product(high: Column, low: Column, factor: int) -> tuple[Column, Column]:
    """Limbs of the product modulo 2**64."""
    fh, fl = factor >> 32, factor & 0xFFFFFFFF
    two32 = F.lit(1 << 32).cast("decimal(20,0)")

    def dec(c: Column) -> Column:
        return c.cast("decimal(12,0)")

    def lit(n: int) -> Column:
        return F.lit(n).cast("decimal(12,0)")

    low_full = (dec(low) * lit(fl)).cast("decimal(24,0)")
    carry = F.floor(low_full / two32).cast("decimal(24,0)")
    out_low = (low_full % two32).cast("bigint")
    high_full = (dec(high) * lit(fl)).cast("decimal(24,0)") + (dec(low) * lit(fh)).cast("decimal(24,0)") + carry
    return (high_full % two32).cast("bigint"), out_low


def audit_unit(doc_id: Column) -> Column:
    """The sampling hash of a document mapped to [0, 1], in single precision."""
    high, low = _product(*_limbs(doc_id.cast("bigint")), MULTIPLIER)
    sum_low = low + (OFFSET & 0xFFFFFFFF)
    high = (high + (OFFSET >> 32) + F.shiftright(sum_low, 32)).bitwiseAND(F.lit(0xFFFFFFFF))
    low = sum_low.bitwiseAND(F.lit(0xFFFFFFFF))
    # x ^ (x >> 15)
    shifted_low = F.shiftright(low, 15).bitwiseOR(F.shiftleft(high.bitwiseAND(F.lit(0x7FFF)), 17))
    high, low = high.bitwiseXOR(F.shiftright(high, 15)), low.bitwiseXOR(shifted_low)
    top, _ = _product(high, low, FINAL)
    return top.cast("float") / F.lit(4294967295).cast("float")


def audit_sampled(doc_id: Column, rate: float) -> Column:
    """Whether a document goes to a full review although all its tags are decided."""
    return audit_unit(doc_id).cast("float") < F.lit(rate).cast("float")
