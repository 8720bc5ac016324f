"""Unsigned 64-bit arithmetic in Column expressions (a long holds the bits; sums and products wrap), and the hashes and generators on it."""

from __future__ import annotations

import struct

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let

LOW = (1 << 32) - 1
#: Fixed values of the splitmix64 generator: its step and the two multipliers of its finish.
GOLDEN, MIX_1, MIX_2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
#: Fixed values of the byte-wise hash: its first state (not the usual FNV offset) and its prime.
FNV_START, FNV_PRIME = 1469598103934665603, 1099511628211


def signed(bits: int) -> int:
    """The long with these 64 bits."""
    bits &= (1 << 64) - 1
    return bits - (1 << 64) if bits >> 63 else bits


def _join(high: Column, low: Column) -> Column:
    """high, low: at most 63 bits each; what low has over 32 bits is carried, what high then has over 32 bits is lost."""
    up = (high + F.shiftrightunsigned(low, 32)).bitwiseAND(F.lit(LOW))
    return F.shiftleft(up, 32).bitwiseOR(low.bitwiseAND(F.lit(LOW)))


def wrapping_add(x: Column, y: Column) -> Column:
    high = lambda c: F.shiftrightunsigned(c, 32)
    return _join(high(x) + high(y), x.bitwiseAND(F.lit(LOW)) + y.bitwiseAND(F.lit(LOW)))


def wrapping_multiply(x: Column, by: int) -> Column:
    """x times a constant, in parts of 32 bits times 16, so that no product leaves a long."""
    parts = [by >> s & 0xFFFF for s in (0, 16, 32, 48)]

    def product(c: Column) -> Column:
        low, high = c.bitwiseAND(F.lit(LOW)), F.shiftrightunsigned(c, 32)
        mask = lambda v, bits: v.bitwiseAND(F.lit((1 << bits) - 1))
        first, second = low * parts[0], low * parts[1]  # below 2**48
        middle = first + F.shiftleft(mask(second, 16), 16)
        upper = F.shiftrightunsigned(second, 16) + mask(low * parts[2] + high * parts[0], 32) + F.shiftleft(mask(low * parts[3] + high * parts[1], 16), 16)
        return _join(upper, middle)

    return let(x, product)


def remainder(x: Column, n: Column) -> Column:
    """x, as unsigned, modulo n (1 to 2**61)."""
    half = F.shiftrightunsigned(x, 1)
    return (half % n * 2 + x.bitwiseAND(F.lit(1))) % n


def splitmix64(state: Column) -> Column:
    """The number that the generator gives in this state."""
    shifted = lambda c, n: c.bitwiseXOR(F.shiftrightunsigned(c, n))
    first = wrapping_multiply(let(state, lambda s: shifted(s, 30)), MIX_1)
    second = wrapping_multiply(let(first, lambda z: shifted(z, 27)), MIX_2)
    return let(second, lambda z: shifted(z, 31))


def seeded_number(seed: Column, step: Column) -> Column:
    """The step-th number (from 1) of the sequence of a seed, whose lowest bit is set first; steps don't depend on each other."""
    # step * GOLDEN wraps; the step is the variable factor
    return splitmix64(wrapping_add(seed.cast("long").bitwiseOR(F.lit(1).cast("long")), wrapping_multiply(step.cast("long"), GOLDEN)))


def hash_string(text: Column) -> Column:
    """Byte by byte over the UTF-8: exclusive or, then times the prime."""
    hexed = F.regexp_extract_all(F.hex(text.cast("binary")), F.lit(".."), F.lit(0))
    codes = F.transform(hexed, lambda h: F.conv(h, 16, 10).cast("long"))
    return F.aggregate(codes, F.lit(FNV_START).cast("long"), lambda h, b: wrapping_multiply(h.bitwiseXOR(b), FNV_PRIME))


def hash_of(text: str) -> int:
    """hash_string of a parameter."""
    h = FNV_START
    for b in text.encode():
        h = (h ^ b) * FNV_PRIME & ((1 << 64) - 1)
    return h


def double_bits(x: float) -> int:
    return struct.unpack("<q", struct.pack("<d", x))[0]


def derived_seeds(seed: int, n: int) -> list[int]:
    """The first n numbers of a seed's sequence, as longs: the seeds of repeated draws."""
    out, state = [], seed | 1
    for _ in range(n):
        state = (state + GOLDEN) & ((1 << 64) - 1)
        z = state
        for shift, by in ((30, MIX_1), (27, MIX_2)):
            z = (z ^ (z >> shift)) * by & ((1 << 64) - 1)
        out.append(signed(z ^ (z >> 31)))
    return out
