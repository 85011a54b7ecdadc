"""Sort-means, spelling variants and deleted interpolation against plain Python, with nulls, empty and long texts, ties and repeated rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import interpolation, queries, sort_means, spelling
from tidemark.session import table

SF = "/root/testdata/sf0.001"
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# op11


def brute_clusters(rows, dims, k=8, rounds=10, scale=1024, seed=3):
    kept = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    spot = lambda r: (hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1])
    cents = [list(v) for _, v in sorted((r for r in kept if r[0] is not None), key=spot)[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    for _ in range(rounds):
        own = defaultdict(list)
        for _, v in kept:
            own[min(range(len(cents)), key=lambda c: (far(v, cents[c]), c))].append(v)
        for c, vs in own.items():
            cents[c] = [sum(x) // len(vs) for x in zip(*vs)]
    out = [(i, *min((far(v, c), n) for n, c in enumerate(cents))[::-1]) for i, v in kept] if cents else []
    total = Counter()
    for _, c, d in out:
        total[c] += d
    return sorted(((i, c, d, total[c], sum(total.values()), hashlib.sha256(",".join(map(str, cents[c])).encode()).hexdigest()) for i, c, d in out), key=str)


def odd_vectors():
    r = random.Random(1)
    rows = [(i, [r.choice([-1.0, 0.0, 0.5, 1.0, r.gauss(0, 1)]) for _ in range(4)]) for i in range(60)]
    rows += rows[:5] + [(None, [1.0, 1.0, 1.0, 1.0]), (61, None), (62, []), (63, [1.0, 2.0, 3.0]), (64, [1.0, None, 0.0, 0.0]), (65, [float("nan"), 0.0, 0.0, 0.0]), (66, [float("inf"), 0.0, 0.0, 0.0]), (67, [0.0] * 4), (68, [0.0] * 4)]
    return rows


@pytest.mark.parametrize("k, rounds", [(1, 3), (5, 0), (8, 10), (100, 2)])
def test_clusters_equal_brute_force(spark, k, rounds):
    rows = odd_vectors()
    docs = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, cluster string")
    got = sort_means.cluster(docs, dims=4, k=k, rounds=rounds)
    assert got.columns == ["vec_id", *sort_means.ADDED]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_clusters(rows, 4, k, rounds)


def test_sort_means_skips_what_is_too_far():
    r = np.random.default_rng(2)
    x = (r.normal(size=(500, 8)) * 100 + r.integers(0, 4, 500)[:, None] * 10_000).astype(np.int64)
    c = x[:32].copy()
    c[7] = c[3]  # a tie goes to the smaller number
    every = ((x[:, None] - c[None]) ** 2).sum(2)
    was = every.argmin(1)
    for start in (was, np.zeros(500, np.int64), np.full(500, 31)):
        best, dist, measured = sort_means.nearest(x, start, c)
        assert (best == every.argmin(1)).all() and (dist == every.min(1)).all()
    assert sort_means.nearest(x, was, c)[2] < 500 * 32 / 2


def test_clusters_of_nothing_extra_columns_and_refusals(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert sort_means.cluster(empty).count() == 0
    assert sort_means.cluster(spark.createDataFrame([(1, None), (2, [1.0])], empty.schema)).count() == 0
    some = spark.createDataFrame([(1, [1.0, 2.0], "a"), (2, [3.0, 2.0], None)], "v long, x array<float>, `a.b` string")
    got = {tuple(r)[:3] for r in sort_means.cluster(some, "v", "x", dims=2, k=2, keep=("a.b",)).collect()}
    assert {r[:2] for r in got} == {(1, "a"), (2, None)}
    with pytest.raises(ValueError):
        sort_means.cluster(some, "v", "x", dims=2, keep=("v",))
    with pytest.raises(Exception, match="too large"):
        sort_means.cluster(spark.createDataFrame([(1, [1e30])], "vec_id long, embedding array<double>"), dims=1).collect()


# op12


def slip(doc, run):
    h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
    return run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run


def brute_groups(rows, least_n=5):
    n = Counter(slip(d, m.translate(UP)) for d, t in rows for m in re.findall("[A-Za-zÀ-ÿ]+", t or ""))
    n = {w: c for w, c in n.items() if len(w) >= 6 and c >= least_n}

    def are_near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    near = {w: [o for o in n if o != w and are_near(w, o)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda o: (-n[o], o), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n}


COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def test_variants_equal_brute_force(spark):
    r = random.Random(5)
    base = ["banana", "bananas", "bandana", "banananas", "aaaaaa", "aaaaaaa", "aaaaaab", "baaaaaa", "listen", "silent", "élance", "elance", "Éclair", "ÉCLAIR", "×÷×÷×÷", "colour", "color", "colours", "coolour"]
    base += ["".join(r.choice("ab") for _ in range(r.choice([6, 7, 8]))) for _ in range(60)]
    times = [r.choice([1, 4, 5, 6, 25, 30, 130, 700]) for _ in base]
    rows = [(i % 97, f"{w.upper() if i % 3 else w},{w}\n{w}-") for i, (w, t) in enumerate(zip(base, times)) for i in range(t)]
    rows += [(None, "listen listen"), (1, None), (2, ""), (3, " \n"), (4, "listen " * 20_000), (5, "x" * 300_000), (5, "tiny")]
    docs = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, run int")
    got = [tuple(x) for x in spelling.variants(docs).select(*COLUMNS).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_groups(rows)
    assert any(g[1] and g[2] != g[1] for g in got), "no chain of forms proves nothing"


def test_variants_over_the_table_and_of_nothing(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text")
    got = [tuple(r) for r in queries.QUERIES["op12_spelling"](spark, SF).select(*COLUMNS).collect()]
    assert set(got) == brute_groups([tuple(r) for r in docs.collect()]) and len(got) == len(set(got))
    assert spelling.variants(docs.limit(0)).count() == 0
    assert spelling.variants(docs.limit(0).unionByName(spark.createDataFrame([(1, "words too few")], docs.schema))).count() == 0


@pytest.mark.parametrize("name", ["op11_centroids", "op12_spelling"])
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({queries.ORACLES[name]})").fetchall()
    assert sorted(map(str, (tuple(r) for r in df.collect()))) == sorted(map(str, want)) and want


# op13


def tokens_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UP)) + [None]


def part_of(doc):
    h = zlib.crc32(str(doc).encode())
    if doc is None:
        return interpolation.KEPT
    return interpolation.TEST if h % 5 == 1 else interpolation.DEV if h // 5 % 8 == 0 else interpolation.KEPT


def brute_scores(rows, order, rounds=20, close=1e-5):
    """Dictionaries of grams, one event at a time; the same update of the weights."""

    def counted(parts):
        n = Counter()
        for d, t in rows:
            if part_of(d) in parts:
                seq = [False, *tokens_of(t)]
                n[(False,)] += 1
                for i in range(1, len(seq)):
                    for k in range(1, min(order, i + 1) + 1):
                        n[tuple(seq[i - k + 1 : i + 1])] += 1
        words = {g for g in n if len(g) == 1 and g != (False,)}
        return n, sum(n[g] for g in words), len(words)

    def events(seq, n, total):
        for i in range(1, len(seq)):
            f, level, log = [], 0, 0
            for k in range(1, order + 1):
                context = total if k == 1 else n[tuple(seq[i - k + 1 : i])] if i - k + 1 >= 0 else 0
                f.append(n[tuple(seq[i - k + 1 : i + 1])] / context if context else 0.0)
                if context:
                    level, log = k, 0 if k == 1 else context.bit_length() - 1
            yield (level, log), f

    kept, total, v = counted({interpolation.KEPT})
    dev = [e for d, t in rows if part_of(d) == interpolation.DEV for e in events([False, *tokens_of(t)], kept, total)]
    lam = defaultdict(lambda: None)
    even = lambda level: [1 / (level + 1)] * (level + 1) + [0.0] * (order - level)
    last = -math.inf
    for _ in range(rounds):
        taken, gain = defaultdict(lambda: [0.0] * (order + 1)), 0.0
        for slot, f in dev:
            share = [a * b for a, b in zip(lam[slot] or even(slot[0]), [1 / (v + 1), *f])]
            gain += math.log(sum(share))
            for k in range(order + 1):
                taken[slot][k] += share[k] / sum(share)
        for slot, x in taken.items():
            x = [a + (k <= slot[0]) for k, a in enumerate(x)]
            lam[slot] = [a / sum(x) for a in x]
        if not dev or gain - last < close * len(dev):
            break
        last = gain
    n, total, v = counted({interpolation.KEPT, interpolation.DEV})
    out = []
    for d, t in rows:
        seq = [False, *tokens_of(t)]
        base = sum(math.log10((n[(w,)] + 0.5) / (total + 0.5 * (v + 1))) for w in seq[1:])
        found = sum(math.log10(sum(a * b for a, b in zip(lam[s] or even(s[0]), [1 / (v + 1), *f]))) for s, f in events(seq, n, total))
        out.append((d, len(seq) - 1, sum(n[(w,)] > 0 for w in seq[1:]), total, base, found))
    return out


def same_scores(got, want):
    got, want = (sorted(x, key=lambda r: (str(r[0]), r[1], r[4])) for x in (got, want))
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert tuple(g[:4]) == tuple(w[:4])
        assert g[4] == pytest.approx(w[4], rel=1e-9, abs=1e-9) and g[5] == pytest.approx(w[5], rel=1e-9, abs=1e-9)


def prose(seed, n):
    r = random.Random(seed)
    words = ["the", "a", "cat", "dog", "sat", "on", "mat", "ran", "Far", "é"]
    out, at = [], 0
    for _ in range(n):
        at = (at * 3 + r.choice([1, 1, 1, 2, 5])) % len(words)
        out.append(words[at] if r.random() > 0.05 else f"w{r.randrange(1000)}")
    return " ".join(out)


NAMES = ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_equal_brute_force(spark, monkeypatch, order):
    monkeypatch.setattr(interpolation, "PIECE", 300)
    monkeypatch.setattr(interpolation, "BLOCK", 900)
    rows = [(i, prose(i, 5 + 7 * (i % 30))) for i in range(90)]
    rows += [rows[3], rows[3], (None, "no id here"), (200, None), (201, ""), (202, " \n\t"), (203, prose(7, 4000)), (204, "UPPER the Cat"), (3, "same id, other text")]
    docs = spark.createDataFrame([(*x, 0.0) for x in rows], "doc_id long, text string, score double")
    got = interpolation.score(docs, interpolation.part_of(), order=order).select(*NAMES).collect()
    same_scores([tuple(r) for r in got], brute_scores(rows, order))


def test_mixture_sums_to_one_and_beats_single_words(spark):
    rows = [(i, prose(i, 200)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [r for r in interpolation.score(docs, interpolation.part_of()).collect() if part_of(r.doc_id) == interpolation.TEST]
    assert sum(r.score for r in got) > sum(r.base_score for r in got)
    # every word that can follow "the", and the rest as one unknown word, by texts that differ in it alone
    words = sorted({w for d, t in rows if part_of(d) != interpolation.TEST for w in tokens_of(t)[:-1]})
    n0 = 10_000
    probes = [(n0 + i, f"the {w}") for i, w in enumerate([*words, "neverseenword"])]
    more = docs.select("*", interpolation.part_of().alias("p")).unionByName(spark.createDataFrame([(*x, interpolation.TEST) for x in probes], "doc_id long, text string, p int"))
    by = {r.doc_id: r.score for r in interpolation.score(more, F.col("p"), order=1).collect()}
    first = 10 ** by[n0 + len(words)]
    # order 1: P(the) P(w) P(end) over all w and the end itself is P(the) P(end) times what the words sum to
    single = {r.doc_id: r.score for r in interpolation.score(more.where("doc_id < 10000").unionByName(spark.createDataFrame([(1, "", interpolation.TEST), (2, "the", interpolation.TEST)], "doc_id long, text string, p int").selectExpr("doc_id + 20000 AS doc_id", "text", "p")), F.col("p"), order=1).collect()}
    end = 10 ** single[20001]
    the = 10 ** (single[20002] - single[20001])
    assert sum(10 ** by[n0 + i] for i in range(len(words))) / (the * end) + end + first / (the * end) == pytest.approx(1, rel=1e-6)


def test_scores_without_training_texts_and_of_nothing(spark):
    schema = "doc_id long, text string"
    docs = spark.createDataFrame([(1, "a b"), (2, None)], schema)
    got = {tuple(r[c] for c in NAMES) for r in interpolation.score(docs, F.lit(interpolation.TEST)).collect()}
    assert got == {(1, 3, 0, 0, 0.0, 0.0), (2, 1, 0, 0, 0.0, 0.0)}
    assert interpolation.score(spark.createDataFrame([], schema), interpolation.part_of()).count() == 0


def test_score_query_has_the_contract_columns(spark):
    got = queries.QUERIES["op13_interpolation"](spark, SF)
    rows = {r.doc_id: r for r in got.collect()}
    docs = [tuple(r) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    n = Counter(w for d, t in docs if part_of(d) != interpolation.TEST for w in tokens_of(t))
    total, v = sum(n.values()), len(n)
    assert len(rows) == len(docs)
    for d, t in docs:
        r = rows[d]
        base = sum(math.log10((n[w] + 0.5) / (total + 0.5 * (v + 1))) for w in tokens_of(t))
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (part_of(d) == interpolation.TEST, len(tokens_of(t)), sum(n[w] > 0 for w in tokens_of(t)), total)
        assert r.base_score == pytest.approx(base, rel=1e-9)
    held = [r for r in rows.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
