"""The queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import ann, chat_windows, decontaminate, interpolation, language_id, license_scan, mixing, paragraph_dedup, simhash, sort_means, spelling, sst, warc
from tidemark.llm.common import shared_folder
from tidemark.session import table


def op1_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraph_dedup.repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.train(docs.where(~language_id.held_out()))
    return language_id.predict(docs.select("doc_id", language_id.held_out().alias("held_out"), "text"), model).drop("text")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(mixing.narrow(table(spark, sf_dir, "documents")), size="size")
    return mixed.select(
        "doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), F.col("mix_taken").alias("taken")
    )


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark").select("item_id", "text")
    found = decontaminate.judged(decontaminate.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), items))
    return found.select(
        "doc_id",
        F.col("decon_words").alias("n_words"),
        F.col("decon_hit_words").alias("n_hit"),
        F.size("decon_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("decon_items", ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), with_text=False)
    both = F.array_sort(F.array_distinct(F.concat("scan_labels", "scan_templates")))
    return found.select(
        "doc_id",
        F.col("scan_words").alias("n_words"),
        F.col("scan_base").alias("n_base"),
        F.col("scan_first").alias("first_word"),
        F.col("scan_last").alias("last_word"),
        F.array_join(F.array_sort("scan_labels"), ",").alias("base_labels"),
        F.array_join(both, ",").alias("labels"),
        F.col("scan_score").alias("score"),
    )


def op7_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    own = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text")
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat_windows.digests(chat_windows.read_back(chat_windows.windows(turns)))


def op8_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sst.read(spark, sst.write(docs, shared_folder(spark), public_tokenizers.path("byte_bpe_50k.json")))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = warc.archive(table(spark, sf_dir, "pages"), shared_folder(spark))
    records = warc.read(spark, files, payloads=False)
    number = lambda c: F.expr(f"try_cast(substring({c}, 10) AS BIGINT)")  # noqa: E731  after urn:page:
    return records.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.search(vectors, vectors.where("vec_id % 50 = 0"), ann.learn(vectors))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sort_means.cluster(table(spark, sf_dir, "embeddings"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = interpolation.score(table(spark, sf_dir, "documents").select("doc_id", "text"), interpolation.part_of())
    return found.withColumn("held_out", interpolation.held_out())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_paragraph_dedup": op1_paragraph_dedup,
    "op2_language_id": op2_language_id,
    "op3_mixing": op3_mixing,
    "op4_decontamination": op4_decontamination,
    "op5_simhash": op5_simhash,
    "op6_license_scan": op6_license_scan,
    "op7_chat_windows": op7_chat_windows,
    "op8_token_shards": op8_token_shards,
    "op9_warc": op9_warc,
    "op10_ann": op10_ann,
    "op11_centroids": op11_centroids,
    "op12_spelling": op12_spelling,
    "op13_interpolation": op13_interpolation,
}


def _rounds_in_sql(rounds: int = 10, k: int = 8) -> str:
    """The clustering of op11 as one query: two tables a round, whole numbers throughout."""
    parts = [
        """v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, [floor(1024 * x::DOUBLE)::BIGINT for x in embedding] AS v FROM embeddings
          WHERE len(embedding) = 64 AND len([1 for x in embedding if x IS NOT NULL AND isfinite(x)]) = 64)""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS c, v FROM v ORDER BY c LIMIT {k})",
    ]
    for i in range(rounds + 1):
        parts.append(
            f"""a{i} AS MATERIALIZED (SELECT r, vec_id, v.v, min((list_sum([(z[1] - z[2]) * (z[1] - z[2]) for z in list_zip(v.v, c{i}.v)]), c)) AS best
            FROM v, c{i} GROUP BY r, vec_id, v.v)"""
        )
        if i < rounds:
            parts.append(
                f"""s{i} AS MATERIALIZED (SELECT c, p, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT best[2] AS c, unnest(v) AS x, unnest(range(64)) AS p FROM a{i}) GROUP BY ALL),
            c{i + 1} AS MATERIALIZED (SELECT c{i}.c, coalesce(m.v, c{i}.v) AS v FROM c{i} LEFT JOIN
              (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY p) AS v FROM s{i} GROUP BY c) m ON m.c = c{i}.c)"""
            )
    return (
        f"WITH {', '.join(parts)} SELECT vec_id, best[2]::INTEGER AS cluster, best[1]::BIGINT AS distance, sum(best[1]) OVER (PARTITION BY best[2])::BIGINT AS cluster_inertia, "
        f"sum(best[1]) OVER ()::BIGINT AS inertia, sha256(array_to_string(c{rounds}.v, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} ON c{rounds}.c = best[2]"
    )

#: The contract in SQL, over whole tables.
ORACLES: dict[str, str] = {
    # the checksum by bytes over its table of 256 remainders, near words by what is left without one letter
    "op12_spelling": """
        WITH RECURSIVE crc AS MATERIALIZED (SELECT list(x ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)),
               lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS x FROM range(256) r(i))),
        r AS MATERIALIZED (SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run
              FROM documents) GROUP BY ALL),
        b AS (SELECT run, n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM r),
        h AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295, [('0x' || substr(x, 2 * i + 1, 2))::BIGINT for i in range(len(x) // 2)]),
              lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1])), 4294967295) AS h FROM b, crc),
        w AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h),
        v AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM w WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
        d AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS s FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
        a AS (SELECT DISTINCT d.word, d.n, v.word AS o, v.n AS m FROM d JOIN v ON v.word = d.s),
        e AS MATERIALIZED (SELECT word, o, m FROM a UNION ALL SELECT o, word, n FROM a UNION ALL SELECT x.word, y.word, y.n FROM d x JOIN d y ON x.i = y.i AND x.s = y.s AND x.word <> y.word),
        g AS (SELECT word, count(*) AS n_near, min((-m, o)) AS best FROM e GROUP BY word),
        f AS MATERIALIZED (SELECT v.word, CASE WHEN -best[1] >= 5 * v.n THEN best[2] END AS form, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN -best[1] >= 5 * v.n THEN (-best[1])::BIGINT END AS form_n
              FROM v LEFT JOIN g ON g.word = v.word),
        p AS (SELECT word, word AS root, 0 AS k FROM f UNION ALL SELECT p.word, f.form, k + 1 FROM p JOIN f ON f.word = p.root WHERE f.form IS NOT NULL)
        SELECT f.word, form, root, n, n_near, form_n FROM f JOIN (SELECT word, arg_max(root, k) AS root FROM p GROUP BY word) z ON z.word = f.word""",
    "op11_centroids": _rounds_in_sql(),
    "op4_decontamination": """
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
        b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
        bw AS (SELECT item_id, least(13, len(w)) AS size, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0),
        win AS (SELECT DISTINCT item_id, size, array_to_string(w[i : i + size - 1], ' ') AS k FROM bw),
        sizes AS (SELECT DISTINCT size FROM win),
        pos AS (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size),
        occ AS (SELECT doc_id, i, size, array_to_string(w[i : i + size - 1], ' ') AS k FROM pos),
        hit AS (SELECT occ.doc_id, occ.i, occ.size, win.item_id FROM occ JOIN win ON win.k = occ.k AND win.size = occ.size),
        hw AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS j FROM hit) GROUP BY doc_id),
        hi AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
        SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)""",
    "op9_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        k AS (SELECT html, max(page_id) AS kept, count(*) AS n FROM p WHERE strlen(html) >= 1000 GROUP BY html)
        SELECT p.page_id, strlen(p.html)::BIGINT AS payload_bytes, sha1(p.html) AS payload_digest,
               CASE WHEN k.kept <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN k.kept <> p.page_id THEN k.kept END AS refers_to
        FROM p LEFT JOIN k ON k.html = p.html""",
    "op7_chat_windows": """
        WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
                   UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok'
                   UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'),
        e AS (SELECT *, replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS safe FROM t),
        r AS (SELECT *, row_number() OVER w AS at_, len(regexp_extract_all(safe, '[^ \t\n\x0B\f\r]+')) AS n,
                     length(safe) + length(coalesce(' role="' || replace(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') || '"', '')) + 15 AS chars
              FROM e WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text)),
        b AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY at_) - n AS before FROM r),
        s AS (SELECT *, (before // 384) AS span FROM b),
        o AS (SELECT *, lead(span) OVER (PARTITION BY conv_id ORDER BY at_) AS following FROM s),
        x AS (SELECT conv_id, span, min(before) AS opens FROM s GROUP BY ALL),
        y AS (SELECT *, lead(opens) OVER (PARTITION BY conv_id ORDER BY span) AS next_opens FROM x),
        h AS (SELECT s.conv_id, sum(s.chars) AS chars FROM s JOIN y ON y.conv_id = s.conv_id AND y.span = s.span
              WHERE y.next_opens - s.before <= 128 AND NOT (s.at_ = 1 AND s.role IS NOT DISTINCT FROM 'system') GROUP BY s.conv_id),
        z AS (SELECT x.conv_id, (count(*) - 1) * max(f.chars) AS chars FROM x JOIN r f ON f.conv_id = x.conv_id AND f.at_ = 1 AND f.role = 'system' GROUP BY x.conv_id)
        SELECT s.conv_id, count(*)::BIGINT AS n_turns,
               sha256(string_agg(coalesce(role, '') || chr(10) || text || chr(10), '' ORDER BY at_)) AS turns_sha256,
               coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY at_), '')) AS loss_sha256,
               (sum(s.chars) + coalesce(any_value(h.chars), 0) + coalesce(any_value(z.chars), 0))::BIGINT AS formatted_chars
        FROM s LEFT JOIN h USING (conv_id) LEFT JOIN z USING (conv_id) GROUP BY s.conv_id""",
}
