"""64-bit arithmetic, generators and fingerprints against Python's whole numbers and published values."""

from __future__ import annotations

import hashlib
import random
import struct

import pytest
from pyspark.sql import functions as F

from tidemark.functions import wrapping as U

M = (1 << 64) - 1
EDGES = [0, 1, 2, 0xFFFF, 0x10000, 0xFFFFFFFF, 1 << 32, 1 << 63, (1 << 63) - 1, M, M - 1, U.STEP, U.FIRST]
signed = lambda x: x - (1 << 64) if x >> 63 else x


def final(x):
    x = (x ^ x >> 30) * U.FIRST & M
    x = (x ^ x >> 27) * U.SECOND & M
    return x ^ x >> 31


@pytest.fixture(scope="module")
def pairs(spark):
    r = random.Random(4)
    rows = [(a, b) for a in EDGES for b in EDGES] + [(r.getrandbits(64), r.getrandbits(64)) for _ in range(200)]
    return spark.createDataFrame([(i, signed(a), signed(b)) for i, (a, b) in enumerate(rows)], "i int, a long, b long").cache(), rows


def test_sums_products_and_remainders(pairs):
    df, rows = pairs
    factors = [1, 3, 0x1B3, U.STEP, U.FIRST, U.SECOND, U.PRIME, M]
    got = df.select("i", U.plus(F.col("a"), F.col("b")).alias("s"), U.modulo(F.col("a"), F.col("i") + 1).alias("m"), *[U.times(F.col("a"), f).alias(f"p{k}") for k, f in enumerate(factors)]).collect()
    for r in got:
        a, b = rows[r.i]
        assert r.s & M == (a + b) & M and r.m == a % (r.i + 1)
        assert [r[f"p{k}"] & M for k in range(len(factors))] == [a * f & M for f in factors]


def test_published_values(spark):
    one = spark.range(5)
    got = [r[0] & M for r in one.orderBy("id").select(U.stream(F.lit(1234567), F.col("id"))).collect()]
    assert got == [6457827717110365317, 3203168211198807973, 9817491932198370423, 4593380528125082431, 16408922859458223821]
    texts = ["", "a", "foobar"]
    got = [r[0] & M for r in spark.createDataFrame([(i, list(t.encode())) for i, t in enumerate(texts)], "i int, o array<int>").orderBy("i").select(U.fnv1a(F.col("o"))).collect()]
    assert got == [0xCBF29CE484222325, 0xAF63DC4C8601EC8C, 0x85944171F73967E8]


def test_generators(spark):
    r = random.Random(5)
    rows = [(signed(s), k, d) for s in (0, 7, M, 1 << 63, U.STEP, r.getrandbits(64)) for k in (0, 1, 9, 1 << 40) for d in (0, 3, 927)]
    df = spark.createDataFrame(rows, "s long, k long, d long")
    got = df.select("s", "k", "d", U.counter_unit(F.col("s"), F.col("k"), F.col("d")).alias("u"), U.stream(F.col("s"), F.col("k")).alias("z"), U.mixed_seed(F.col("s"), F.col("k")).alias("m")).collect()
    for x in got:
        s = x.s & M
        v = s ^ ((x.k + 1) * U.STEP & M) ^ ((x.d + 1) * U.FIRST & M)
        assert x.u == (final((v + U.STEP) & M) >> 11) / (1 << 53)
        assert x.z & M == final(((s or U.STEP) + (x.k + 1) * U.STEP) & M)
        y = s ^ ((x.k + U.STEP) & M)
        assert x.m & M == final(((y or U.STEP) + U.STEP) & M)


def test_gene_fingerprint(spark):
    rows = [(0.1, -0.25, 12.0), (0.0, -0.0, 1e6), (1.0000005, -1.0000005, 2.5e-7), (None, 1.0, 1.0)]

    def plain(vs):
        h = U.BASIS
        for v in vs:
            q = int(abs(v) * 1e6 + 0.5) * (-1 if v < 0 else 1)
            for b in struct.pack("<Q", q & M):
                h = (h ^ b) * U.PRIME & M
        return h

    got = [r[0] for r in spark.createDataFrame(rows, "a double, b double, c double").select(U.gene_fingerprint(F.col("a"), F.col("b"), F.col("c"))).collect()]
    assert [g & M for g in got[:3]] == [plain(r) for r in rows[:3]] and got[3] is None


def test_source_draws(spark):
    def plain(seed, source, time, coordinate, draw):
        body = b"".join(struct.pack(">I", len(t.encode())) + t.encode() for t in ("dom",)) + struct.pack(">Q", seed & M)
        body += b"".join(struct.pack(">I", len(t.encode())) + t.encode() for t in source) + struct.pack(">Q", time & M) + bytes([coordinate, draw])
        return (int.from_bytes(hashlib.sha256(body).digest()[:8], "big") >> 11) / (1 << 53)

    rows = [(-1, "i", "örtlich", "S", "1d", 86_400_000, 3), (0, "x" * 300, "d", "S", "1h", -5, 0), (1, "", "d", "S", "1h", 1, 0)]
    df = spark.createDataFrame(rows, "seed long, a string, b string, c string, e string, t long, k int")
    source = [F.col(x) for x in "abce"]
    got = df.select(U.source_unit("dom", F.col("seed"), source, F.col("t"), F.col("k"), F.lit(1)).alias("u"), U.source_triangular("dom", F.col("seed"), source, F.col("t"), F.col("k")).alias("d")).collect()
    for g, (s, a, b, c, e, t, k) in zip(got[:2], rows):
        assert g.u == plain(s, (a, b, c, e), t, k, 1) and g.d == plain(s, (a, b, c, e), t, k, 0) - plain(s, (a, b, c, e), t, k, 1)
    assert got[2].u is None


def test_fisher_yates(spark):
    rows = [("a", i, float(i * i)) for i in range(41)] + [("b", 5, 1.0)] + [("c", i, 2.0) for i in range(2)]
    got = U.fisher_yates(spark.createDataFrame(rows, "k string, t int, v double"), ["k"], "t", "v", -9, 3).collect()
    for key in "abc":
        plain = [v for k, _, v in rows if k == key]
        for sequence in range(3):
            x = (-9 & M) ^ ((sequence + U.STEP) & M)
            state = final(((x or U.STEP) + U.STEP) & M) or U.STEP
            want = plain.copy()
            for i in range(len(want) - 1, 0, -1):
                state = (state + U.STEP) & M
                j = final(state) % (i + 1)
                want[i], want[j] = want[j], want[i]
            assert [r.v for r in sorted(got, key=lambda r: r.t) if r.k == key and r.sequence == sequence] == want
