"""The corpus operators against plain Python, with nulls, empty and long texts, ties and repeated rows."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import textwrap
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import ann, chat_windows, decontaminate, language_id, license_scan, mixing, paragraph_dedup, simhash, sst, warc
from tidemark.llm.common import shared_folder
from tidemark.llm.components import components

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def rng_words(seed: int, n: int, size: int = 4000) -> list[str]:
    r = random.Random(seed)
    return [f"w{r.randrange(size)}" for _ in range(n)]


@pytest.fixture(scope="session")
def odd_docs(spark):
    base = " ".join(rng_words(1, 120))
    rows = [
        (1, base, "en", "a", 1),
        (2, base, "en", "a", 1),
        (2, base, "en", "a", 1),
        (3, None, "en", None, 0),
        (4, "", None, "b", 0),
        (5, "  \n\t ", "en", None, 0),
        (6, base.upper() + " tail", "fr", "b", 1),
        (7, " ".join(rng_words(2, 30000)), "fr", "c", 1),
        (None, "no id here", "en", "c", 1),
        (8, "Hello, été!\n\nReleased under the MIT License.", "fr", "", 1),
    ]
    return spark.createDataFrame(rows, DOC)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC)


def space_words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


# op1


def test_repeats_finds_equal_and_similar_paragraphs(spark):
    p = rng_words(3, 60)
    q = p.copy()
    q[30] = "changed"
    other = rng_words(4, 60)
    docs = spark.createDataFrame(
        [(1, " ".join(p)), (2, "intro line\n" + " ".join(q)), (3, " ".join(other) + "\n" + " ".join(other)), (4, None), (5, ""), (6, " ".join(rng_words(5, 5000)))], "doc_id long, text string"
    )
    got = {(r.doc_id, r.first_word, r.n_words, r.cluster_doc, r.kept) for r in paragraph_dedup.repeats(docs).collect()}
    assert got == {(1, 0, 60, 1, True), (2, 2, 60, 1, False)}


def test_repeats_catches_a_passage_inside_long_lines(spark):
    passage = " ".join(rng_words(6, 80))
    docs = spark.createDataFrame([(i, " ".join(rng_words(100 + i, 200 + 13 * i)) + " " + passage + " " + " ".join(rng_words(200 + i, 150))) for i in range(4)] + [(9, " ".join(rng_words(7, 500)))], "doc_id long, text string")
    rows = paragraph_dedup.repeats(docs).collect()
    assert {r.doc_id for r in rows} == {0, 1, 2, 3}


def test_short_lines_and_documents_are_paragraphs(spark):
    seven, twelve, three = rng_words(31, 7), rng_words(32, 12), rng_words(33, 3)
    rows = [
        (1, " ".join(seven)),
        (2, " ".join(seven).upper()),
        (3, " ".join(rng_words(34, 40)) + "\n" + " ".join(twelve) + "\n\n" + " ".join(three)),
        (4, " ".join(rng_words(35, 90)) + "\n" + " ".join(three)),
        (5, " ".join(twelve) + " more"),
        (6, "one"),
        (7, "two\none"),
        (8, " ".join(three[:2]) + "\ntwice\ntwice"),
    ]
    got = {(r.doc_id, r.first_word, r.n_words, r.exact_only, r.cluster_doc, r.kept) for r in paragraph_dedup.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {
        (1, 0, 7, False, 1, True),
        (2, 0, 7, False, 1, False),
        (3, 40, 12, False, 3, True),
        (5, 0, 13, False, 3, False),
        (3, 52, 3, False, 3, True),
        (4, 90, 3, False, 3, False),
        (6, 0, 1, False, 6, True),
        (7, 1, 1, False, 6, False),
    }


@pytest.mark.parametrize("n, changes", [(70, 1), (100, 2), (200, 4)])
def test_long_lines_are_compared_whole(spark, n, changes):
    rows = []
    for k in range(40):
        p = rng_words(1000 * n + k, n, 1_000_000)
        q = p.copy()
        for c in range(changes):
            q[(2 * c + 1) * n // (2 * changes)] = f"changed{c}"
        rows += [(2 * k, " ".join(p)), (2 * k + 1, " ".join(q))]
    got = {(r.doc_id, r.cluster_doc) for r in paragraph_dedup.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.n_words == n}
    assert all(doc // 2 == cluster // 2 for doc, cluster in got)
    assert sum({(2 * k, 2 * k), (2 * k + 1, 2 * k)} <= got for k in range(40)) >= 39  # 99.4 % of pairs share a band


def test_buckets_crowded_by_words_lose_no_link(spark):
    base = rng_words(36, 900)
    docs = spark.createDataFrame([(i, " ".join(base[:450] + [f"x{i}"] + base[451:])) for i in range(40)], "doc_id long, text string")
    one, many = (sorted(tuple(r) for r in paragraph_dedup.repeats(docs, crowd=c).where("n_words = 900").select("doc_id", "cluster_doc", "members").collect()) for c in (1000, 20))
    assert one == many == [(i, 0, 40) for i in range(40)]


def test_crowded_buckets_lose_no_link(spark):
    base = rng_words(8, 50)
    docs = spark.createDataFrame([(i, " ".join(base[:25] + [f"x{i}"] + base[26:])) for i in range(60)], "doc_id long, text string")
    one, many = (sorted(tuple(r) for r in paragraph_dedup.repeats(docs, crowd=c).groupBy("exact_only", "cluster_doc").count().collect()) for c in (1000, 7))
    assert one == many and (False, 0, 60) in one


@pytest.mark.parametrize("before", [0, 3, 200])
def test_any_fifty_shared_words_share_a_run(before):
    r = random.Random(before)
    for _ in range(50):
        passage, found = [r.randrange(1 << 60) for _ in range(50)], []
        for _ in range(2):
            h = np.array([*(r.randrange(1 << 60) for _ in range(before)), *passage, *(r.randrange(1 << 60) for _ in range(before))], np.uint64)
            found.append({tuple(h[i : i + paragraph_dedup.RUN].tolist()) for i in paragraph_dedup.runs(h).tolist()})
        assert found[0] & found[1]


def test_runs_of_one_word_repeated_are_few():
    assert len(paragraph_dedup.runs(np.full(10_000, 7, np.uint64))) == 1


def test_repeats_of_nothing(spark, no_docs, odd_docs):
    assert paragraph_dedup.repeats(no_docs).count() == 0
    assert {r.doc_id for r in paragraph_dedup.repeats(odd_docs).collect()} == {1, 2, 6}


def test_spanning_forest_joins_what_all_pairs_join():
    r = random.Random(5)
    base = [f"a{i}" for i in range(40)]
    bodies = []
    for _ in range(30):
        w = base.copy()
        for _ in range(r.randrange(4)):
            w[r.randrange(40)] = f"b{r.randrange(9)}"
        bodies.append(" ".join(w).encode())
    sets = [{tuple(b.split()[k : k + 5]) for k in range(36)} for b in bodies]

    def groups(pairs):
        root = list(range(len(bodies)))

        def find(i):
            return i if root[i] == i else find(root[i])

        for a, b in pairs:
            root[max(find(a), find(b))] = min(find(a), find(b))
        return [find(i) for i in range(len(bodies))]

    exact = [(i, j) for i in range(30) for j in range(i) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8]
    assert groups(paragraph_dedup.similar(bodies, 0.8)) == groups(exact)


# op2


def test_code_lengths_are_those_of_a_plain_ppm():
    train = b"abracadabra arbadacarba"
    grams = language_id._grams(np.frombuffer(train, np.uint8), np.array([0, len(train)]), 0, len(train))
    keys, n = np.unique(grams, return_counts=True)
    tree = language_id.ContextTree(keys, n)
    counts = collections.defaultdict(collections.Counter)
    padded = b"\0\0\0" + train
    for i in range(3, len(padded)):
        for k in range(4):
            counts[padded[i - k : i]][padded[i]] += 1

    def bits(context, symbol):
        total, out = 0.0, set()
        for k in range(3, -1, -1):
            c = counts.get(context[3 - k :])
            if c is None:
                continue
            left = {s: m for s, m in c.items() if s not in out}
            n_, d = sum(left.values()), len(left)
            if symbol in left:
                return total + np.log2((n_ + d) / left[symbol])
            if d:
                total += np.log2((n_ + d) / d)
            out |= set(c)
        return total + np.log2(256 - len(out))

    probe = [(b"abr", ord("a")), (b"abr", ord("z")), (b"zzz", ord("a")), (b"ada", ord("c")), (b"\0\0\0", ord("b")), (b"xab", ord("q"))]
    got = tree.bits(np.array([(a[0] << 24) | (a[1] << 16) | (a[2] << 8) | b for a, b in probe], np.uint32))
    assert np.allclose(got, [bits(a, b) for a, b in probe])


def test_language_id_on_held_out_documents(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.train(docs.where(~language_id.held_out()))
    found = language_id.predict(docs, model).where(language_id.held_out())
    right, n = found.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int")), F.count("*")).first()
    assert n > 30 and right > 0.95


def test_language_slices_do_not_change_lengths(monkeypatch):
    texts = [b"", b"a", b"some words here", b"x" * 3, b"die der und", b"", b"le la les"]
    model = language_id.Model([("x", int(g), 1) for g in language_id._grams(np.frombuffer(b"der die und", np.uint8), np.array([0, 11]), 0, 11)])
    data, off = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    whole = model.lengths(data, off)
    for size in (1, 2, 3, 5):
        monkeypatch.setattr(language_id, "SLICE", size)
        assert np.allclose(model.lengths(data, off), whole)


def test_language_id_odd_rows(spark, odd_docs, no_docs):
    model = language_id.train(odd_docs)
    clash = odd_docs.withColumn("score", F.lit("x")).withColumn("_s", F.lit(1))
    rows = {(r.doc_id, r.lang_pred, r.score) for r in language_id.predict(clash, model).collect()}
    assert {(3, "und", 0.0), (4, "und", 0.0), (5, "und", 0.0)} <= rows
    assert all(0 <= s <= 1 for _, _, s in rows)
    empty = language_id.train(no_docs)
    assert {r.lang_pred for r in language_id.predict(odd_docs, empty).collect()} == {"und"}
    assert language_id.predict(no_docs, model).count() == 0


# op3


def seats_by_quotients(values, n):
    seats = [0] * len(values)
    for _ in range(n):
        best = max(range(len(values)), key=lambda i: (values[i] / (2 * seats[i] + 1), -i))
        seats[best] += 1
    return seats


@pytest.mark.parametrize("values,n", [([53.0, 24.0, 23.0], 10), ([1.0, 1.0, 1.0], 2), ([1000.0, 1.0, 1.0, 1.0], 7), ([5.0, 0.0, 3.0], 0), ([9.5, 9.5, 2.0, 700.0], 313)])
def test_apportion_is_sainte_lague(spark, values, n):
    rows = spark.createDataFrame([(i, v, n) for i, v in enumerate(values)], "i int, v double, seats long")
    got = {r.i: r.to for r in mixing.apportion(rows, [], ["i"], "v", "seats", "to").collect()}
    assert [got[i] for i in range(len(values))] == seats_by_quotients(values, n)


def fill(sizes, weights, cap=3):
    total, capped = sum(sizes), set()
    while True:
        free = [i for i in range(len(sizes)) if i not in capped]
        level = (total - sum(cap * sizes[i] for i in capped)) / sum(weights[i] for i in free)
        over = [i for i in free if weights[i] * level > cap * sizes[i]]
        if not over:
            return [cap * sizes[i] if i in capped else weights[i] * level for i in range(len(sizes))]
        capped |= set(over)


def test_mix_targets_and_bounds(spark):
    r = random.Random(3)
    sizes = {"a": 40, "b": 3, "c": 200, None: 30, "é": 5}
    rows, i = [], 0
    for s, n in sizes.items():
        for _ in range(n):
            rows.append((i, " ".join(["w"] * r.randrange(60)), s))
            i += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("_quota", F.lit(1))
    got = mixing.mix(docs, docs_per_shard=20).collect()
    by = collections.defaultdict(list)
    for x in got:
        by[x.source].append(x)
        assert 0 <= x.mix_taken <= 3 * x.mix_size
    names = ["a", "b", "c", "é", None]
    assert len(got) == len(rows) and set(by) == set(names)
    true = fill([sum(x.mix_size for x in by[s]) for s in names], [1, 2, 3, 1, 2])
    for s, t in zip(names, true):
        assert by[s][0].mix_target == pytest.approx(t) and by[s][0].mix_source_size == sum(x.mix_size for x in by[s])
        shards = max(1, -(-sizes[s] // 20))
        assert abs(sum(x.mix_taken for x in by[s]) - t) <= 16 * (1 + 3 * shards)
    again = mixing.mix(docs.repartition(7), docs_per_shard=20).collect()
    assert {(x.doc_id, x.mix_taken) for x in got} == {(x.doc_id, x.mix_taken) for x in again}


def test_mix_odd_rows(spark, odd_docs, no_docs):
    rows = mixing.mix(odd_docs).collect()
    assert len(rows) == 10 and all(r.mix_taken == 0 for r in rows if not space_words(r.text))
    assert mixing.mix(no_docs).count() == 0
    assert mixing.mix(no_docs.union(spark.createDataFrame([(1, None, None, None, 0)], DOC))).first().mix_taken == 0


# op4


def plain_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute_decon(docs, items):
    out = []
    for doc_id, text in docs:
        w, hit, ids = plain_words(text), set(), set()
        for item, t in items:
            v = plain_words(t)
            size = min(13, len(v))
            wins = {tuple(v[k : k + size]) for k in range(len(v) - size + 1)} if size else set()
            for k in range(len(w) - size + 1) if size else ():
                if tuple(w[k : k + size]) in wins:
                    hit |= set(range(k, k + size))
                    ids.add(item or "")
        out.append((doc_id, len(w), len(hit), sorted(ids)))
    return sorted(out, key=str)


@pytest.mark.parametrize("part_bytes", [1 << 20, 60])
def test_decontamination_equals_brute_force(spark, part_bytes):
    r = random.Random(9)
    vocabulary = ["a", "b", "c", "d", "é", "9"]
    items = [(f"i{k}", " ".join(r.choice(vocabulary) for _ in range(r.choice([0, 1, 2, 5, 13, 14, 20])))) for k in range(12)]
    items += [("i3", items[5][1]), (None, "Zebra, zebra crossing"), ("n", None), ("e", " ... ")]
    docs = []
    for k in range(60):
        w = [r.choice(vocabulary + ["x", "y"]) for _ in range(r.randrange(40))]
        if k % 3 == 0:
            w += plain_words(items[r.randrange(12)][1])
        docs.append((k, ", ".join(w).upper() if k % 2 else " ".join(w)))
    docs += [(100, None), (101, ""), (102, "zebra zebra crossing"), (102, "zebra zebra crossing"), (103, "one " * 20000)]
    found = decontaminate.judged(
        decontaminate.scan(spark.createDataFrame(docs, "doc_id long, text string").withColumn("_f", F.lit(0)), spark.createDataFrame(items, "item_id string, text string"), part_bytes=part_bytes)
    ).collect()
    assert sorted(((x.doc_id, x.decon_words, x.decon_hit_words, x.decon_items) for x in found), key=str) == brute_decon(docs, items)
    assert all(x.contaminated == (x.decon_hit_words > 0 and 20 * x.decon_hit_words >= x.decon_words) for x in found)


def test_decontamination_of_nothing(spark, no_docs, odd_docs):
    none = spark.createDataFrame([], "item_id string, text string")
    assert decontaminate.scan(no_docs, none).count() == 0
    assert {x.decon_items[0] if x.decon_items else None for x in decontaminate.scan(odd_docs, none).collect()} == {None}


# op5


def plain_fingerprint(t):
    w = space_words("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(points, near):
    root = {p: p for p in points}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in points:
        for b in points:
            if a < b and near(a, b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {p: find(p) for p in points}


def test_fingerprints(odd_docs, spark):
    texts = [r.text for r in odd_docs.collect()]
    assert [simhash.fingerprint((t or "").encode()) for t in texts] == [plain_fingerprint(t) for t in texts]


@pytest.mark.parametrize("crowd", [4096, 5])
def test_links_connect_all_near_fingerprints(spark, crowd):
    r = random.Random(4)
    points = {0, (1 << 64) - 1}
    for _ in range(12):
        p = r.getrandbits(64)
        for _ in range(12):
            points.add(p)
            for _ in range(r.choice([1, 3, 4, 5])):
                p ^= 1 << r.randrange(64)
    signed = [p - (1 << 64) if p >> 63 else p for p in points]
    found = simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"), crowd=crowd).collect()
    near = lambda a, b: bin((a ^ b) & (1 << 64) - 1).count("1") <= 4
    linked = {(x.a, x.b) for x in found} | {(x.b, x.a) for x in found}
    assert brute_components(signed, lambda a, b: (a, b) in linked) == brute_components(signed, near)


def test_covering_meets_every_pair_within_four():
    r = np.random.default_rng(2)
    for _ in range(300):
        a = r.integers(0, 1 << 63, dtype=np.uint64)
        b = a ^ np.bitwise_or.reduce(np.uint64(1) << r.choice(64, r.integers(1, 5), replace=False).astype(np.uint64))
        row, key, home = simhash.anchors(np.array([a, b]))
        assert set(key[(row == 0) & home]) & set(key[(row == 1) & ~home])


def test_near_duplicates_odd_rows(spark, odd_docs, no_docs):
    rows = simhash.near_duplicates(odd_docs).collect()
    assert len(rows) == 10
    by = collections.defaultdict(set)
    for x in rows:
        by[x.doc_id].add((x.fingerprint, x.component_id))
    assert by[1] == by[2] and {c for _, c in by[2]} == {1}
    assert {c for i in (3, 4, 5) for _, c in by[i]} == {3} and by[3] == {("0" * 16, 3)}
    assert simhash.near_duplicates(no_docs).count() == 0


def test_components_of_chains_and_stars(spark):
    r = random.Random(6)
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + k) for k in range(1, 50)] + [(7, 7), (300, 200), (200, 300), (149, 250)]
    r.shuffle(links)
    got = {(x.node, x.root) for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {(i, 0) for i in range(41)} | {(i, 100) for i in range(100, 150)} | {(250, 100), (200, 200), (300, 200)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# op6


def brute_templates(w, templates):
    """The best share of each template's words in any run of 64 words, or of twice its own number where that is more."""
    best = {}
    for label, template in templates.items():
        v = plain_words(template)
        s, block = set(v), max(64, 2 * len(v))
        for i in range(max(len(w) - block, 0) + 1):
            said = f" {' '.join(w[i : i + block])} "
            told = any(f" {p} " in said for p in license_scan.REQUIRED[label]) and not any(f" {p} " in said for p in license_scan.FORBIDDEN.get(label, ()))
            if told and (c := len(s & set(w[i : i + block])) / len(s)) >= 0.8:
                best[label] = max(best.get(label, 0), c)
    return best


def test_near_misses_have_no_label_of_another_license(spark):
    """Written out by hand, so that the rule is not its own judge."""
    t = license_scan.TEMPLATES
    lgpl = t["gpl-header"].replace("GNU General", "GNU Lesser General")
    gpl2 = t["gpl-header"].replace("version 3", "version 2")
    bsd3 = t["bsd-2-text"].replace("THIS SOFTWARE IS PROVIDED BY", "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse products. THIS SOFTWARE IS PROVIDED BY")
    zero_bsd = t["isc-text"].replace(", provided that the\n        above copyright notice and this permission notice appear in all copies", "")
    mit_0 = t["mit-text"].replace("The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "")
    assert zero_bsd != t["isc-text"] and mit_0 != t["mit-text"]
    cases = {
        "Released under the Apache License.": [],
        "Released under the BSD License.": [],
        "The album was released under a small label; the license to print it ran out. Mit freundlichen": [],
        "The MIT Press released it under a license": [],
        "Licensed under CC BY 4.0.": [],
        "Licensed under CC BY-SA 4.0.": [],
        "Licensed under CC BY-NC-SA 4.0.": [],
        "Licensed under CC BY-NC 3.0.": [],
        "Licensed under CC BY-NC 4.0.": ["cc-by-nc-4.0"],
        "This work is licensed under the GNU General Public License, version 2.": [],
        "This work is licensed under the GNU Lesser General Public License, version 3.": [],
        "This work is licensed under the GNU Affero General Public License, version 3.": [],
        "This work is licensed under the GNU General Public License, version 3.": ["gpl-3.0"],
        "Licensed under the Apache License, Version 1.1.": [],
        "Licensed under the Apache License, Version 2.0.": ["apache-2.0"],
        "Licensed under the Educational Community License, Version 2.0.": [],
        "Released under the MIT License.": ["mit-notice"],
        "Licensed under the MIT License.": ["mit-notice"],
        "license mit the under released": [],
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 1.1.": [],
        t["mpl-2.0"]: ["mpl-2.0"],
        lgpl: [],
        gpl2: [],
        t["gpl-header"]: ["gpl-header"],
        bsd3: ["bsd"],
        t["bsd-2-text"]: ["bsd", "bsd-2-text"],
        zero_bsd: [],
        t["isc-text"]: ["isc-text"],
        mit_0: [],
        t["mit-text"]: ["mit-text"],
        t["apache-2.0-header"]: ["apache-2.0", "apache-2.0-header"],
    }
    for around in ("", " ".join(rng_words(77, 150))):
        rows = [(i, f"{around} {text} {around}") for i, text in enumerate(cases)]
        got = {x.doc_id: x.scan_templates for x in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        for i, (text, labels) in enumerate(cases.items()):
            assert got[i] == labels, (text, got[i])


def test_license_scan_equals_brute_force(spark, odd_docs, no_docs):
    long = " ".join(rng_words(11, 500)) + " This work is licensed under the GNU General Public License, version 3. " + " ".join(rng_words(12, 300))
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()] + [
        (20, "MIT License mit license MIT-License."),
        (21, long),
        (22, "licensed under CC BY\nNC 4.0 and Apache  License"),
        (23, "Licensed under the Apache License, Version 2.0.\nReleased under the MIT License."),
        (23, "Licensed under the Apache License, Version 2.0.\nReleased under the MIT License."),
        (24, "gnu general public licenses"),
    ]
    got = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string").withColumn("_score", F.lit(1))).collect()
    expected = []
    for doc_id, text in rows:
        w = plain_words(text)
        places = [(k, label) for p, label in license_scan.PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        best = brute_templates(w, license_scan.TEMPLATES)
        at = [k for k, _ in places]
        expected.append((doc_id, len(w), len(at), min(at, default=None), max(at, default=None), sorted({x for _, x in places}), sorted(best), max(best.values(), default=0.0)))
    real = [(x.doc_id, x.scan_words, x.scan_base, x.scan_first, x.scan_last, sorted(x.scan_labels), x.scan_templates, x.scan_score) for x in got]
    assert sorted(real, key=str) == sorted(expected, key=str)
    assert license_scan.scan(no_docs).count() == 0


def test_license_query_reads_across_lines(spark, odd_docs, tmp_path):
    from tidemark.llm.queries import op6_license_scan

    t = license_scan.TEMPLATES
    r = random.Random(12)
    bsd = "* Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that the following conditions\n * are met:"
    mpl = "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed"
    rows = [(x.doc_id, x.text) for x in odd_docs.collect()] + [(30, bsd), (31, mpl), (32, "licensed under CC BY\nNC 4.0")]
    for k, label in enumerate(sorted(t) * 6):
        w = t[label].split()
        for _ in range(r.randrange(4)):
            w.insert(r.randrange(len(w)), "\n".join(rng_words(r.randrange(99), r.choice([1, 20, 50]))))
        text = [*rng_words(k, r.choice([0, 30, 63, 64, 65, 128, 400])), *w, *rng_words(k + 50, r.choice([0, 40, 64, 300]))]
        rows.append((100 + k, "".join(x + r.choice([" ", "\n"]) for x in text)))
    for k, label in enumerate(("mit-text", "bsd-2-text", "apache-2.0-header", "gpl-header")):  # wrapped at 72 columns as comments, with words changed
        lines = textwrap.wrap(t[label], 72)
        rows.append((300 + k, " */\nint main() {}\n * ".join([" ".join(rng_words(90 + k, 300)), "\n * ".join(lines), "x y z"])))
        rows.append((400 + k, "\n".join(x.replace("the", "THE ").replace("any", "some") for x in lines)))
        rows.append((500 + k, "\n".join(x for j, x in enumerate(lines) if j % 2)))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(x.doc_id, x.labels, round(x.score, 9)) for x in op6_license_scan(spark, str(tmp_path)).collect()}
    expected = set()
    for doc_id, text in rows:
        w = plain_words(text)
        best = brute_templates(w, t)
        said = f" {' '.join(w)} "
        base = {label for p, label in license_scan.PHRASES.items() if f" {p} " in said}
        expected.add((doc_id, ",".join(sorted(base | set(best))), round(max(best.values(), default=0.0), 9)))
    assert got == expected
    assert {(30, "bsd", 1.0), (31, "mpl-2.0", 1.0)} <= got
    assert all(any(i == 300 + k and label in labels.split(",") for i, labels, _ in got) for k, label in enumerate(("mit-text", "bsd-2-text", "apache-2.0-header", "gpl-header")))


# op7


def test_windows_round_trip(spark):
    r = random.Random(8)
    odd = ["", "&amp;lt;", "</turn>\n", '<turn role="user">\n', "a & b < c > d \"q\"", "é x", None, "\\### Assistant: </turn> ok"]
    rows = []
    for c in [1, 2, 3, None, -7]:
        n = 40 if c == 2 else r.randrange(1, 9)
        for t in range(n):
            role = "system" if t == 0 and c in (1, 2) else r.choice(["user", "assistant", None, 'x"<&>'])
            rows.append((c, t if t != 3 else 2, role, r.choice(odd) if r.random() < 0.5 else " ".join(rng_words(t, r.randrange(300)))))
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("window", F.lit(1))
    made = chat_windows.windows(turns)
    kept = {w.conv_id: [] for w in made.select("conv_id").collect()}
    for x in chat_windows.read_back(made).collect():
        own = sorted(((t, ro is not None, ro or "", tx or "") for c, t, ro, tx in rows if c == x.conv_id))
        assert [(t.role, t.text) for t in x.turns] == [(ro if has else None, tx) for _, has, ro, tx in own]
        assert x.loss_text == "".join(tx for _, _, ro, tx in own if ro == "assistant")
        kept.pop(x.conv_id)
    assert not kept
    several = made.where("conv_id = 2").orderBy("window").collect()
    assert len(several) > 3 and all(w.formatted.startswith('<turn role="system">') and w.n_context >= 1 for w in several[1:])
    assert chat_windows.windows(turns.limit(0)).count() == 0
    d = {x.conv_id: x for x in chat_windows.digests(chat_windows.read_back(made)).collect()}
    own = sorted(((t, ro is not None, ro or "", tx or "") for c, t, ro, tx in rows if c == -7))
    assert d[-7].turns_sha256 == hashlib.sha256("".join(f"{ro}\n{tx}\n" for _, _, ro, tx in own).encode()).hexdigest()


# op8


@pytest.fixture(scope="session")
def tokenizer_path():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def test_pieces_give_the_ids_of_whole_texts(tokenizer_path, monkeypatch):
    from tokenizers import Tokenizer

    plain, r = Tokenizer.from_file(tokenizer_path), random.Random(1)
    parts = ["a", "b", " ", "  ", "\n", ".", ",", "'s", "é", "1", "_", "!", "<|endoftext|>", "\t", "\x1c", " ", " It", "don't", "中", "½", "\0", "\r\n", "🙂", "́", ")"]
    monkeypatch.setattr(sst, "REMEMBERED", 100)
    e = sst.Encoder(tokenizer_path)
    assert e.by_piece
    for _ in range(40):
        texts = ["".join(r.choice(parts) for _ in range(r.randrange(25))) for _ in range(25)]
        assert [np.frombuffer(x, e.kind).tolist() for x in e.encode(texts)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_shards_round_trip_and_look_up(spark, odd_docs, no_docs, tokenizer_path):
    from pyarrow import fs as pafs
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_path)
    docs = odd_docs.union(spark.createDataFrame([(i * 7 - 500, f"text {i}", None, None, 0) for i in range(300)], DOC))
    files = sst.write(docs, shared_folder(spark), tokenizer_path, shards=3)
    got = sorted(((x.start, x.doc_id, x.n_tokens, x.ids_crc32) for x in sst.read(spark, files).collect()))
    ids = {(r.doc_id, r.text): [*plain.encode(r.text or "", add_special_tokens=False).ids, 0] for r in docs.collect()}
    assert [x[1] for x in got] == sorted((r.doc_id for r in docs.collect()), key=lambda i: (i is not None, i or 0))
    at = 0
    for start, doc_id, n, crc in got:
        assert start == at and any(len(v) == n and zlib.crc32(np.array(v, "<u4").tobytes()) == crc for (i, _), v in ids.items() if i == doc_id)
        at += n
    hits = 0
    for f in files.collect():
        source, path = pafs.FileSystem.from_uri(f.file)
        with source.open_input_file(path) as stream:
            reader = sst.Reader(stream)
            keys = [k for k, _ in reader]
            assert keys == sorted(keys) and len(keys) == reader.docs == f.docs
            for key in keys:
                assert len(reader.get(key)) == keys.count(key)
            hits += sum(reader.may_have(sst.key_bytes(10**12 + i)) for i in range(200))
            assert reader.get(sst.key_bytes(10**12)) == []
    assert hits < 60
    assert sst.read(spark, sst.write(no_docs, shared_folder(spark), tokenizer_path)).count() == 0


# op9


def test_archives_round_trip(spark):
    from pyarrow import fs as pafs

    big, other = "<p>" + "é" * 800, "<b>" + "x" * 2000
    rows = [(1, "http://a/1", big), (2, None, big), (3, "u\r\nInjected: 1", other), (4, "u", None), (5, "u", "short"), (6, "u", "short"), (7, "u", big), (None, "u", big)]
    rows += [(100 + i, f"http://h/{i}", f"<html>page number {i} of the same template, again and again {i * 7}</html>") for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("x"))
    files = warc.archive(pages, shared_folder(spark))
    got = {(r.record_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in warc.read(spark, files).collect()}
    kept = {}
    for i, _, h in rows:
        if h and len(h.encode()) >= 1000:
            kept[h] = max(kept.get(h, -1), i if i is not None else -1)
    want = set()
    for i, _, h in rows:
        p = (h or "").encode()
        again = h in kept and kept[h] != i
        want.add((f"urn:page:{'' if i is None else i}", "revisit" if again else "response", f"urn:page:{kept[h]}" if again else None, len(p), hashlib.sha1(p).hexdigest()))
    assert got == want
    payloads = {r.record_id: bytes(r.payload) for r in warc.read(spark, files).where("record_type = 'response'").collect()}
    assert all(payloads[f"urn:page:{i}"] == (h or "").encode() for i, _, h in rows if f"urn:page:{i}" in payloads)
    for f in files.collect():
        source, path = pafs.FileSystem.from_uri(f.file)
        with source.open_input_file(path) as stream:
            assert int.from_bytes(stream.read(4), "little") == warc.DICTIONARY_FRAME
    assert warc.read(spark, warc.archive(pages.limit(0), shared_folder(spark))).count() == 0


# op10


def brute_neighbours(rows, queries, k=5):
    out = {}
    for i, q in queries:
        s = sorted((-float(np.dot(q, v) / np.sqrt(np.dot(q, q) * np.dot(v, v))), j) for j, v in rows if j != i)
        out[i] = [j for _, j in s[:k]]
    return out


def test_ann_recall_and_odd_vectors(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding")
    router = ann.learn(vectors)
    got = collections.defaultdict(list)
    for r in ann.search(vectors, vectors.where("vec_id % 10 = 0"), router, block=64).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    rows = [(r.vec_id, np.array(r.embedding, float)) for r in vectors.collect()]
    true = brute_neighbours(rows, [x for x in rows if x[0] % 10 == 0])
    assert set(got) == set(true) and np.mean([len(set(got[i]) & set(true[i])) / 5 for i in true]) >= 0.9


def test_ann_ties_and_what_takes_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (50, [2.0, 0.0]), (3, [1.0, 0.0]), (2, [4.0, 0.0]), (1, [1.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, [1.0]), (100, [0.0, 0.0]), (None, [1.0, 0.0]), (10, [])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [(r.query_id, r.rank, r.vec_id) for r in ann.search(v, v.where("vec_id % 50 = 0"), ann.learn(v), block=2).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 2), (0, 2, 3), (0, 3, 50), (0, 4, 1), (50, 1, 0), (50, 2, 2), (50, 3, 3), (50, 4, 1)]
    none = v.limit(0)
    assert ann.search(none, none, ann.learn(none)).count() == 0


# the pipeline


def test_pipeline_stages_against_plain_python(spark, tokenizer_path):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = []
    for name, stage in p.STAGES[:4]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        before, after = docs.collect(), out.collect()
        rows.append((name, before, after))
        docs = spark.createDataFrame(after, docs.schema)
    (_, a, b), (_, c, d), (_, e, f), (_, g, h) = rows
    assert {r.doc_id for r in b} >= {r.doc_id for r in a if r.text and len(r.text) > 60 and re.search(r"[^\W\d_]{3}", r.text)}
    prints = {r.doc_id: plain_fingerprint(r.text) for r in c}
    comp = brute_components(sorted(prints), lambda x, y: bin(prints[x] ^ prints[y]).count("1") <= 4)
    assert sorted(r.doc_id for r in d) == sorted(set(comp.values()))
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {i for i, n, hit, _ in brute_decon([(r.doc_id, r.text) for r in e], items) if hit and 20 * hit >= n}
    assert {r.doc_id for r in f} == {r.doc_id for r in e} - bad
    taken = {r.doc_id: int(r.mix_taken / r.mix_size + 0.5) for r in mixing.mix(spark.createDataFrame(g, docs.schema)).collect() if r.mix_size}
    assert collections.Counter(r.doc_id for r in h) == collections.Counter({i: n for i, n in taken.items() if n})
    shards = p.STAGES[4][1](spark, docs, SF).collect()
    assert len(shards) == len(h) and max(r.start + r.n_tokens for r in shards) == sum(r.n_tokens for r in shards)


def test_pipeline_keeps_clashing_columns_and_repeated_ids(spark, tokenizer_path):
    import corpus_pipeline as p

    said = ["the quick brown fox jumps over the lazy dog and runs away " + " ".join(rng_words(s, 60)) for s in range(9)]
    rows = [(1, said[0], "en", "a"), (1, said[1], "en", "a"), (1, said[1], "en", "a"), (2, said[1], "en", None), (None, said[2], "en", "b"), (None, said[3], None, "b"), (3, None, "en", "a"), (4, "", "en", "a"), (5, "12 34", "fr", "a")]
    docs = spark.createDataFrame([(*r, i % 2, f"s{i % 2}", True, 7, "f") for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, _s int, score string, contaminated boolean, _key long, _f string")
    by_text = lambda out: sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    for name, stage in p.STAGES[:4]:
        none = stage(spark, docs.limit(0), SF)
        assert none.columns == docs.columns and none.count() == 0, name
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        want = {(r.doc_id, r.text): {tuple(x) for x in docs.collect() if (x.doc_id, x.text) == (r.doc_id, r.text)} for r in docs.collect()}
        assert all(tuple(r) in want[(r.doc_id, r.text)] for r in out.collect()), name
        if name == "language_id":
            assert by_text(out) == sorted(((i, t) for i, t, *_ in rows if t and not t[0].isdigit()), key=str)
        if name == "simhash":  # the two texts of id 1 are unlike, so both stay; its copies and doc 2 go; empty texts are one group
            assert by_text(out) == sorted([(1, said[0]), (1, said[1]), (None, said[2]), (None, said[3]), (3, None), (5, "12 34")], key=str)
        if name == "decontamination":
            assert out.count() == len(rows)
        if name == "mixing":
            assert all(r.text for r in out.collect())
    assert p.STAGES[4][1](spark, docs, SF).count() == len(rows)
    assert p.STAGES[4][1](spark, docs.limit(0), SF).count() == 0


# queries against brute force


def brute_repeats(rows):
    """(doc_id, first_word, n_words, cluster_doc) of equal or similar lines in several documents; no line is over 64 words."""
    lines = []
    for doc_id, text in rows:
        at = 0
        for line in (text or "").lower().split("\n"):
            if w := tuple(space_words(line)):
                lines.append((doc_id, at, w))
                at += len(w)
    sets = [{w[k : k + 5] for k in range(max(1, len(w) - 4))} for _, _, w in lines]
    root = brute_components(list(range(len(lines))), lambda a, b: lines[a][2] == lines[b][2] or (min(len(lines[a][2]), len(lines[b][2])) >= 5 and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])))
    groups = collections.defaultdict(list)
    for i, r in root.items():
        groups[r].append(lines[i])
    return {(d, at, len(w), min(x[0] for x in g)) for g in groups.values() if len({x[0] for x in g}) > 1 for d, at, w in g}


def test_op1_query_equals_brute_force(spark, tmp_path):
    from tidemark.llm.queries import op1_paragraph_dedup

    r = random.Random(21)
    base = [rng_words(700 + k, r.choice([1, 2, 4, 5, 8, 15, 16, 40, 60]), 500) for k in range(30)]
    rows = [(90, None), (91, ""), (92, " \n \n")]
    for doc in range(60):
        lines = []
        for _ in range(r.randrange(1, 6)):
            w = r.choice(base).copy()
            if len(w) >= 40 and r.random() < 0.6:
                w[r.randrange(len(w))] = f"changed{r.randrange(3)}"
            lines.append(" ".join(w))
        rows.append((doc, "\n".join(lines)))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(x.doc_id, x.first_word, x.n_words): x.cluster_doc for x in op1_paragraph_dedup(spark, str(tmp_path)).collect() if not x.exact_only}
    want = {x[:3]: x[3] for x in brute_repeats(rows)}
    assert set(got) <= set(want) and len(want) > 100
    # equal lines always meet; bands miss under one similar pair in a hundred, so a few rows may lack a farther member of their cluster
    assert len(got) >= 0.98 * len(want) and sum(got[row] == want[row] for row in got) >= 0.95 * len(want)
    assert all(got[row] >= want[row] for row in got)


def brute_mix(rows, block=16, docs_per_shard=2000, seed=7, weights=(1, 2, 3), cap=3):
    """taken of each (doc_id, text, source), by the same draws and plain loops; sources of fewer rows than a shard holds."""
    spot = lambda s, *p: int(hashlib.md5(":".join([str(s), *("-" if x is None else str(x) for x in p)]).encode()).hexdigest()[:8], 16)
    names = sorted({r[2] for r in rows if r[2] is not None}) + ([None] if any(r[2] is None for r in rows) else [])
    of = {s: [r for r in rows if r[2] == s] for s in names}
    size = {s: sum(len(space_words(t)) for _, t, _ in of[s]) for s in names}
    target = fill([size[s] for s in names], [weights[i % len(weights)] for i in range(len(names))], cap)
    seats = seats_by_quotients(target, int(sum(size.values()) / block + 0.5))
    out = {}
    for s, t, n_blocks in zip(names, target, seats):
        n = max(1, -(-size[s] // block))
        quota, start = min(n_blocks, n * cap), spot(seed, "-" if s is None else f"={s}", 0) % n * block
        run, at = quota % n * block, 0
        for doc_id, text, _ in sorted(of[s], key=lambda x: (spot(seed + 1, x[0]), x[0], len(space_words(x[1])))):
            k = len(space_words(text))
            common = lambda lo, hi: max(0, min(at + k, hi) - max(at, lo))  # noqa: B023, E731
            out[doc_id] = (k, size[s], t, quota // n * k + common(start, min(start + run, n * block)) + common(0, start + run - n * block))
            at += k
    return out


def test_op3_query_equals_brute_force(spark, tmp_path):
    from tidemark.llm.queries import op3_mixing

    r = random.Random(22)
    rows = [(i, None if i % 29 == 0 else " ".join(["w"] * r.choice([0, 1, 5, 40, 200, 3000 if i == 77 else 9])), r.choice(["a", "a", "a", "b", "é", None])) for i in range(300)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {x.doc_id: (x.size, x.source_size, x.target, x.taken) for x in op3_mixing(spark, str(tmp_path)).collect()}
    want = brute_mix(rows)
    assert set(got) == set(want)
    for i, (size, source_size, target, taken) in want.items():
        assert (got[i][0], got[i][1], got[i][3]) == (size, source_size, taken) and got[i][2] == pytest.approx(target)


def test_files_are_read_one_a_task(spark, tokenizer_path):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(200)], "doc_id long, text string")
    files = sst.write(docs, shared_folder(spark), tokenizer_path, shards=5)
    assert files.count() == 5
    tasks = sst.read(spark, files).select(F.spark_partition_id().alias("p"), "doc_id").groupBy("p").agg(F.min("doc_id"), F.max("doc_id")).collect()
    assert len(tasks) == 5
    pages = spark.createDataFrame([(i, "u", f"<p>{i}" + "x" * 50) for i in range(90)], "page_id long, url string, html string").repartition(6, "page_id")
    written = warc.archive(pages, shared_folder(spark))
    assert warc.read(spark, written).select(F.spark_partition_id()).distinct().count() == written.count()


@pytest.mark.parametrize("n", [0, 1, 5])
def test_small_archives_have_a_dictionary(spark, n):
    from pyarrow import fs as pafs

    pages = spark.createDataFrame([(i, None, "short" * i) for i in range(max(n, 1))], "page_id long, url string, html string")
    files = warc.archive(pages, shared_folder(spark))
    assert sorted(bytes(r.payload) for r in warc.read(spark, files).collect()) == sorted(("short" * i).encode() for i in range(max(n, 1)))
    for f in files.collect():
        source, path = pafs.FileSystem.from_uri(f.file)
        with source.open_input_file(path) as stream:
            assert int.from_bytes(stream.read(4), "little") == warc.DICTIONARY_FRAME


def test_hot_keys_join_like_cold_ones(spark):
    from tidemark.llm.common import split_join

    rows = spark.range(6000).select(F.when(F.col("id") < 4000, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("x"))
    sized = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("x").alias("most"))
    got = split_join(rows, sized, ["k"], 6000, ["x"])
    assert got.columns == ["k", "x", "most"] and got.count() == 6000
    assert got.where((F.col("k") == 0) & (F.col("most") == 3999)).count() == 4000
    assert split_join(rows, sized.where("n > 1"), ["k"], 6000, ["x"], "left").where("most IS NULL").count() == 2000


def test_router_parts_grow_with_the_table(spark, monkeypatch):
    monkeypatch.setattr(ann, "ROWS", 20)
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding").limit(480)
    assert ann.learn(vectors, parts=None).parts <= 480 // 20
    monkeypatch.setattr(ann, "LEAST_PARTS", 2)
    monkeypatch.setattr(ann, "ROWS", 100)
    assert ann.learn(vectors).parts == 4


def test_mix_of_a_hot_id_fills_many_shards(spark):
    rows = [(7, " ".join(rng_words(i, 20 + i % 9)), "en", "a", 0) for i in range(600)] + [(i, " ".join(rng_words(i, 25)), "en", "b", 0) for i in range(300)]
    docs = spark.createDataFrame(rows, DOC)
    whole = mixing.mix(docs, docs_per_shard=50)
    lean = mixing.mix(mixing.narrow(docs), docs_per_shard=50, size="size")
    key = lambda r: (r.doc_id, r.source, r.mix_size, r.mix_source_size, round(r.mix_target, 6), r.mix_taken)
    assert sorted(map(key, whole.collect())) == sorted(map(key, mixing.mix(docs, docs_per_shard=50).collect()))
    for got in (whole.collect(), lean.collect()):
        for source in "ab":
            own = [r for r in got if r.source == source]
            assert abs(sum(r.mix_taken for r in own) - own[0].mix_target) < 0.02 * own[0].mix_target + 64
            assert all(r.mix_taken <= 3 * r.mix_size for r in own)
    spread = mixing._spot(7, F.col("doc_id"), F.xxhash64("text"))
    assert docs.where("doc_id = 7").select(spread.alias("s")).distinct().count() > 500


def test_narrow_table_of_the_mix_holds_no_text(spark, odd_docs):
    lean = mixing.narrow(odd_docs)
    assert dict(lean.dtypes) == {"doc_id": "bigint", "source": "string", "size": "bigint", "text": "bigint"}
    assert sorted(r["size"] for r in lean.collect()) == sorted(len(space_words(r.text)) for r in odd_docs.collect())


def test_stores_that_arrow_cannot_open_are_refused_by_name(spark, no_docs, tokenizer_path):
    from tidemark.llm.common import arrow_uri

    assert arrow_uri("s3a://bucket/x") == "s3://bucket/x" and arrow_uri("file:///x/y") == "file:///x/y" and arrow_uri("hdfs://n:8020/x") == "hdfs://n:8020/x"
    for bad in ("dbfs:/x", "/x", "oss://b/x"):
        with pytest.raises(ValueError, match="Arrow"):
            sst.write(no_docs, bad, tokenizer_path)
        with pytest.raises(ValueError, match="Arrow"):
            warc.archive(spark.createDataFrame([], "page_id long, url string, html string"), bad)
