"""Arithmetic modulo 2^64 in column expressions, and the generators and fingerprints that stand on it.

A 64-bit number is a BIGINT of the same bits. Sums and products go by halves and quarters of a word, whose terms stay below 2^52, so
nothing overflows where Spark would raise; only shifts lose high bits, which is what a modulus asks for. Generators are functions of
their counter: the k-th number of a stream is found without the ones before it.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LOW, QUARTER = 0xFFFFFFFF, 0xFFFF
# fixed values: the splitmix64 step and its two factors; the 64-bit FNV-1a basis and prime
STEP, FIRST, SECOND = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
BASIS, PRIME = 0xCBF29CE484222325, 0x100000001B3


def bits(x: int) -> Column:
    """A number below 2^64 as the BIGINT of its bits."""
    x &= (1 << 64) - 1
    return F.lit(x - (1 << 64) if x >> 63 else x).cast("long")


def bound(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x worked out once, however often f names it."""
    return F.element_at(F.transform(F.array(x), f), 1)


def _upper(x: Column) -> Column:
    return F.shiftrightunsigned(x, 32)


def _lower(x: Column) -> Column:
    return x.bitwiseAND(F.lit(LOW).cast("long"))


def plus(x: Column, y: Column) -> Column:
    """x + y modulo 2^64; x and y are columns or bound names, as each is named twice."""
    low = _lower(x) + _lower(y)
    return F.shiftleft(_upper(x) + _upper(y) + _upper(low), 32).bitwiseOR(_lower(low))


def times(x: Column, factor: int) -> Column:
    """x * factor modulo 2^64, for a fixed factor."""
    factor &= (1 << 64) - 1
    low, high = factor & LOW, factor >> 32

    def below(y: Column, half: int) -> Column:
        """y * half modulo 2^32, for y and half below 2^32."""
        return _lower(y * (half & QUARTER) + F.shiftleft((y * (half >> 16)).bitwiseAND(F.lit(QUARTER).cast("long")), 16))

    def product(v: Column) -> Column:
        a, b = _lower(v), _upper(v)
        outer = a * (low >> 16)
        inner = a * (low & QUARTER) + F.shiftleft(outer.bitwiseAND(F.lit(QUARTER).cast("long")), 16)
        return F.shiftleft(_upper(inner) + F.shiftright(outer, 16) + below(a, high) + below(b, low), 32).bitwiseOR(_lower(inner))

    return bound(x, product)


def modulo(x: Column, n: Column) -> Column:
    """The remainder of x, as a number from 0 to 2^64, on division by n, from 1 to 2^31."""
    return bound(x, lambda v: F.pmod(F.pmod(F.shiftrightunsigned(v, 1), n) * 2 + v.bitwiseAND(F.lit(1).cast("long")), n))


def finalised(x: Column) -> Column:
    """The splitmix64 finaliser."""
    once = bound(x, lambda v: times(v.bitwiseXOR(F.shiftrightunsigned(v, 30)), FIRST))
    twice = bound(once, lambda v: times(v.bitwiseXOR(F.shiftrightunsigned(v, 27)), SECOND))
    return bound(twice, lambda v: v.bitwiseXOR(F.shiftrightunsigned(v, 31)))


def unit(x: Column) -> Column:
    """The upper 53 bits as a number in [0, 1)."""
    return F.shiftrightunsigned(x, 11).cast("double") / float(1 << 53)


def counter_unit(seed: Column, sequence: Column, dimension: Column) -> Column:
    """The counter generator: a number in [0, 1) from a seed, a sequence and a dimension (longs from 0), without state."""
    mixed = seed.cast("long").bitwiseXOR(times(sequence.cast("long") + 1, STEP)).bitwiseXOR(times(dimension.cast("long") + 1, FIRST))
    return unit(finalised(bound(mixed, lambda v: plus(v, bits(STEP)))))


def stream(seed: Column, k: Column) -> Column:
    """Number k (from 0) of the splitmix64 stream of a seed, as bits; a seed of 0 stands for the step."""
    start = F.when(seed == 0, bits(STEP)).otherwise(seed.cast("long"))
    return bound(start, lambda s: bound(times(k.cast("long") + 1, STEP), lambda t: finalised(plus(s, t))))


def mixed_seed(seed: Column, sequence: Column) -> Column:
    """The seed of a numbered sequence: the first number of the stream of seed XOR (sequence + step)."""
    return bound(seed.cast("long").bitwiseXOR(bound(sequence.cast("long"), lambda v: plus(v, bits(STEP)))), lambda v: stream(v, F.lit(0)))


def fnv1a(octets: Column) -> Column:
    """64-bit FNV-1a of an array of numbers from 0 to 255."""
    return F.aggregate(octets, bits(BASIS), lambda h, x: times(h.bitwiseXOR(x.cast("long")), PRIME))


def little_endian(x: Column) -> Column:
    """The eight bytes of a long as numbers, the lowest first."""
    return F.array(*[F.shiftrightunsigned(x, s).bitwiseAND(F.lit(255).cast("long")) for s in range(0, 64, 8)])


def gene_fingerprint(*values: Column) -> Column:
    """FNV-1a over the values times 10^6, rounded half away from zero, as little-endian 64-bit numbers in the order given.

    A null value makes it null; values lie below 9.2 * 10^12."""
    whole = F.array(*[F.when(v < 0, -F.floor(-v * 1e6 + 0.5)).otherwise(F.floor(v * 1e6 + 0.5)).cast("long") for v in values])
    any_null = F.exists(whole, lambda x: x.isNull())
    return F.when(~any_null, fnv1a(F.flatten(F.transform(whole, little_endian))))


def framed(text: Column) -> Column:
    """The UTF-8 bytes of a text after their number as four bytes, highest first."""
    raw = text.cast("binary")
    return F.concat(F.unhex(F.lpad(F.hex(F.octet_length(raw).cast("long")), 8, "0")), raw)


def big_endian(x: Column) -> Column:
    """The eight bytes of a long, the highest first."""
    return F.unhex(F.lpad(F.hex(x.cast("long")), 16, "0"))


def source_unit(domain: str, seed: Column, source: list[Column], time: Column, coordinate: Column, draw: Column) -> Column:
    """A number in [0, 1): the upper 53 bits of the SHA-256 of domain, seed, the source's texts, time, coordinate (0 to 3) and draw (0 or 1)
    as framed texts, 8-byte numbers and single bytes. An empty or null text of the source makes it null."""
    one = lambda x: F.unhex(F.lpad(F.hex(x.cast("long")), 2, "0"))
    body = F.concat(framed(F.lit(domain)), big_endian(seed), *[framed(F.nullif(s, F.lit(""))) for s in source], big_endian(time), one(coordinate), one(draw))
    return F.shiftright(F.conv(F.substring(F.sha2(body, 256), 1, 14), 16, 10).cast("long"), 3).cast("double") / float(1 << 53)


def source_triangular(domain: str, seed: Column, source: list[Column], time: Column, coordinate: Column) -> Column:
    """The difference of a coordinate's two draws."""
    return source_unit(domain, seed, source, time, coordinate, F.lit(0)) - source_unit(domain, seed, source, time, coordinate, F.lit(1))


def fisher_yates(rows: DataFrame, keys: list[str], order: str, value: str, seed: int, sequences: int) -> DataFrame:
    """(keys, sequence, order, value): for each sequence the key's values as the seeded Fisher-Yates shuffle leaves them.

    Place i, from the last to the second, is exchanged with place draw % (i + 1); draws are the stream of the sequence's mixed seed.
    The draws are columns; the exchanges go through one key's values in one sequence at a time, which is what a task holds. `order` is
    unique within a key.
    """
    each = rows.select(*keys, F.col(order).alias("_order"), F.col(value).alias("_value")).withColumn("sequence", F.explode(F.sequence(F.lit(0), F.lit(sequences - 1))))
    group = Window.partitionBy(*keys, "sequence")
    each = each.withColumns({"_i": F.row_number().over(group.orderBy("_order")) - 1, "_n": F.count(F.lit(1)).over(group)})
    seeded = each.withColumn("_seed", mixed_seed(F.lit(seed), F.col("sequence")))
    # place i is the (n - 1 - i)-th to be exchanged; place 0 is never
    drawn = seeded.withColumn("_to", modulo(stream(F.col("_seed"), F.greatest(F.col("_n") - 1 - F.col("_i"), F.lit(0))), F.col("_i") + 1)).drop("_seed", "_n")

    def exchange(part: pa.Table) -> pa.Table:
        part = part.sort_by("_i")
        to, at = part.column("_to").to_numpy().tolist(), list(range(part.num_rows))
        for i in range(len(at) - 1, 0, -1):
            at[i], at[to[i]] = at[to[i]], at[i]
        return part.set_column(part.schema.get_field_index("_value"), "_value", part.column("_value").take(pa.array(np.array(at, np.int64)))).drop_columns(["_i", "_to"])

    names = [*keys, "_order", "_value", "sequence"]
    kinds = {f.name: f.dataType.simpleString() for f in drawn.schema}
    out = drawn.groupBy(*keys, "sequence").applyInArrow(exchange, ", ".join(f"`{c}` {kinds[c]}" for c in names))
    return out.select(*keys, "sequence", F.col("_order").alias(order), F.col("_value").alias(value))
