"""64-bit wrapping arithmetic, hashes and random streams as column expressions.

Spark's own arithmetic raises on overflow, so sums and products are worked out
on halves that cannot overflow. A BIGINT holds the 64 bits; read as unsigned
where that matters.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_LOW = 0xFFFFFFFF


def signed(x: int) -> int:
    """The BIGINT with the bits of an unsigned number."""
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


def let(value: Column, body) -> Column:
    """body(value), with the value worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def add64(a: Column, b: Column) -> Column:
    low = a.bitwiseAND(_LOW) + b.bitwiseAND(_LOW)
    high = F.shiftrightunsigned(a, 32) + F.shiftrightunsigned(b, 32) + F.shiftrightunsigned(low, 32)
    return F.shiftleft(high, 32).bitwiseOR(low.bitwiseAND(_LOW))


def mul64(a: Column, k: int) -> Column:
    """a times a constant, modulo 2^64."""
    k &= (1 << 64) - 1
    k0, k1 = k & _LOW, k >> 32

    def body(x: Column) -> Column:
        a0, a1 = x.bitwiseAND(_LOW), F.shiftrightunsigned(x, 32)
        # The product of the low halves, by 16 bits of the constant; of the mixed ones only 32 bits matter.
        low = add64(a0 * (k0 & 0xFFFF), F.shiftleft(a0 * (k0 >> 16), 16))
        part = lambda y, z: (y * (z & 0xFFFF) + F.shiftleft((y * (z >> 16)).bitwiseAND(0xFFFF), 16)).bitwiseAND(_LOW)
        mixed = (part(a0, k1) + part(a1, k0)).bitwiseAND(_LOW)
        return add64(low, F.shiftleft(mixed, 32))

    return let(a, body)


def unsigned_mod(a: Column, n: int) -> Column:
    """The unsigned 64-bit number modulo a small n."""
    return ((F.shiftrightunsigned(a, 1) % n) * 2 + a.bitwiseAND(1)) % n


def octets(text: Column) -> Column:
    """UTF-8 bytes of a text as an array of 0..255."""
    pairs = F.hex(F.encode(text, "utf-8"))
    return F.transform(F.regexp_extract_all(pairs, F.lit("(..)"), 1), lambda h: F.conv(h, 16, 10).cast("long"))


# Fixed values of the published hashes.
FNV_OFFSET, FNV_PRIME = 1469598103934665603, 1099511628211
MIX_1, MIX_2, MIX_3 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
PCG_MULTIPLIER = 6364136223846793005


def fnv1a(values: Column) -> Column:
    """FNV-1a over an array of bytes."""
    return F.aggregate(values, F.lit(FNV_OFFSET).cast("long"), lambda h, v: mul64(h.bitwiseXOR(v.cast("long")), FNV_PRIME))


def djb2(values: Column) -> Column:
    """h <- 33 h xor byte, from 5381."""
    return F.aggregate(values, F.lit(5381).cast("long"), lambda h, v: mul64(h, 33).bitwiseXOR(v.cast("long")))


def hash_ids(ids: Column, width: int = 4) -> Column:
    """FNV-1a of sorted ids, ``width`` bytes each, lowest first, then of their number in eight bytes."""
    split = lambda v, n: F.transform(F.lit(list(range(0, 8 * n, 8))), lambda s: F.shiftright(v, 0) if n == 0 else F.call_function("shiftrightunsigned", v, s).bitwiseAND(255))
    body = F.flatten(F.transform(F.array_sort(ids), lambda i: split(i.cast("long"), width)))
    return fnv1a(F.concat(body, split(F.size(ids).cast("long"), 8)))


def splitmix64(x: Column) -> Column:
    def shifted(v: Column, by: int, k: int | None) -> Column:
        return let(v, lambda y: mul64(y.bitwiseXOR(F.shiftrightunsigned(y, by)), k) if k else y.bitwiseXOR(F.shiftrightunsigned(y, by)))

    return shifted(shifted(shifted(add64(x, F.lit(signed(MIX_1))), 30, MIX_2), 27, MIX_3), 31, None)


def derive(seed: Column, stream: Column, nonce: Column) -> tuple[Column, Column]:
    """(state, sequence) seeds of a substream."""
    state = splitmix64(seed.bitwiseXOR(add64(mul64(stream, MIX_1), nonce)))
    sequence = splitmix64(add64(add64(seed, F.shiftleft(stream, 1)), F.lit(0x632BE59BD9B4E019)))
    return state, sequence


def pcg32(seed: Column, sequence: Column, n: int) -> Column:
    """The first n numbers of a PCG32 stream, as an array of 0..2^32-1."""
    inc = F.shiftleft(sequence, 1).bitwiseOR(F.lit(1).cast("long"))

    def output(state: Column) -> Column:
        x = F.shiftrightunsigned(F.shiftrightunsigned(state, 18).bitwiseXOR(state), 27).bitwiseAND(_LOW)
        turn = F.shiftrightunsigned(state, 59).cast("int")
        right = F.call_function("shiftrightunsigned", x, turn)
        left = F.call_function("shiftleft", x, (32 - turn) % 32)
        return right.bitwiseOR(left).bitwiseAND(_LOW)

    step = lambda s, i: add64(mul64(s, PCG_MULTIPLIER), i)

    def draws(i: Column) -> Column:
        start = step(add64(i, seed), i)  # from state 0: one step, the seed, one step
        first = F.struct(start.alias("s"), F.array().cast("array<bigint>").alias("out"))
        run = F.aggregate(F.sequence(F.lit(1), F.lit(n)), first, lambda a, _: F.struct(step(a["s"], i).alias("s"), F.array_append(a["out"], output(a["s"])).alias("out")))
        return run["out"]

    return let(inc, draws)


def bounded(numbers: Column, bound: int) -> Column:
    """Unbiased numbers below the bound: those under 2^32 modulo the bound are rejected."""
    least = (1 << 32) % bound
    return F.transform(F.filter(numbers, lambda v: v >= least), lambda v: v % bound)
