"""Mixing sources to target weights by Sainte-Lague apportionment.

A source's words are blocks of equal size. The blocks of the mix go to sources by highest
quotients target / (2k + 1), then each source's blocks go to its shards the same way, so every
shard gets an integer quota and the sums stay exact. Within a shard the documents stand in a
seeded order; the quota takes every block as often as it can and the rest as a run of blocks from
a seeded start, around the end. Only one row per source and per shard is ever ranked; hot sources
have as many more shards as they have documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import SPACE_WORD, without, written

#: Spots that documents are dealt to before their source's number of shards is known: so many at least, and two for each shard that all
#: documents could fill.
SPOTS = 4096
OWN = ("mix_size", "mix_source_size", "mix_target", "mix_taken", "_source", "_spot", "_shard", "_words", "_quota", "_n", "_to", "_start", "_run", "_tie")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SPACE_WORD)), F.lit(0)).cast("long")


def _spot(seed: int, *cols: Column) -> Column:
    """A number below 2^32 from the seed and the columns."""
    parts = [F.coalesce(c.cast("string"), F.lit("-")) for c in cols]
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *parts)), 1, 8), 16, 10).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...], cap: int) -> DataFrame:
    """Adds the target of each source (source, size): the weighted share of all sizes, at most cap
    times its own; what is above goes to the others by weight until none is above.

    Sources weigh by code point order, null last. The water level: in order of cap / weight,
    the first source that the level of those from it on does not flood ends the capped ones.
    """
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    at = (F.row_number().over(by_name) - 1) % len(weights)
    rows = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (at + 1).cast("int")).cast("long")).withColumn("most", F.col("size") * cap)
    everything = Window.partitionBy(F.lit(0))
    order = everything.orderBy((F.col("most") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns(
        {
            "rank": F.row_number().over(order),
            "level": (F.sum("size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0)))
            / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))),
        }
    )
    fits = F.when(F.col("level") <= F.col("most") / F.col("weight"), F.struct("rank", "level"))
    rows = rows.withColumn("first", F.min(fits).over(everything))
    target = F.when(F.col("rank") < F.col("first.rank"), F.col("most").cast("double")).otherwise(F.col("weight") * F.col("first.level"))
    return rows.withColumn("target", target).drop("rank", "level", "most", "first")


def apportion(rows: DataFrame, within: list[str], order: list[str], value: str, seats: str, to: str) -> DataFrame:
    """Adds `to`: the seats of each row by Sainte-Lague, among the rows of equal `within`.

    A divisor shifted by half a seat per row gives every row seats it surely has and seats it
    might have, at most four a row on average; only those are ranked by quotient.
    Ties go to the first by `order`. `order` must be unique within a group.
    """
    group = Window.partitionBy(*(within or [F.lit(0)]))
    total, half = F.sum(value).over(group), F.count(F.lit(1)).over(group) / 2
    bounds = rows.withColumn("_total", total.cast("double")).withColumn("_half", half)
    low = F.greatest(F.col(seats) - F.col("_half"), F.lit(0.0)) / F.nullif(F.col("_total"), F.lit(0.0))
    high = (F.col(seats) + F.col("_half")) / F.nullif(F.col("_total"), F.lit(0.0))
    sure = F.coalesce(F.greatest(F.floor(F.col(value) * low + 0.5) - 1, F.lit(0)), F.lit(0)).cast("long")
    most = F.coalesce(F.floor(F.col(value) * high + 0.5) + 1, F.lit(1)).cast("long")
    maybe = bounds.withColumn("_sure", sure).withColumn("_seat", F.explode(F.sequence(F.col("_sure") + 1, F.greatest(most, F.col("_sure") + 1))))
    quotient = F.col(value) / (2 * F.col("_seat") - 1)
    ranked = maybe.withColumn("_rank", F.row_number().over(group.orderBy(quotient.desc(), *order, "_seat")))
    first = F.when(F.col("_seat") == F.col("_sure") + 1, F.col("_sure")).otherwise(0)
    left = F.col(seats) - F.sum(first).over(group)
    won = ranked.withColumn("_won", ((F.col("_rank") <= left) & (F.col(value) > 0)).cast("long"))
    return won.groupBy(*rows.columns).agg((F.max("_sure") + F.sum("_won")).alias(to))


def narrow(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """(doc_id, source, size, text) for mix(size="size"): a table in the shared folder, for which texts are read once; text is a hash."""
    return written(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"), F.xxhash64(text).alias("text")))


def mix(
    docs: DataFrame,
    doc_id: str = "doc_id",
    source: str = "source",
    text: str = "text",
    weights: tuple[int, ...] = (1, 2, 3),
    cap: int = 3,
    block: int = 16,
    docs_per_shard: int = 2000,
    seed: int = 7,
    size: str | None = None,
) -> DataFrame:
    """Adds mix_size, mix_source_size, mix_target and mix_taken (words, repeats counted) to every row.

    A null or empty text has size 0 and takes 0. A null source is a source of its own, last. No
    row takes more than cap times its size. A source's taken words differ from its target by about
    a block and what its shards' last, shorter blocks lack. Rows are dealt and ordered by their id and the hash of their text, so
    one id with many texts fills many shards; rows alike in both are interchangeable and share a shard. An empty table gives an empty one.
    Columns of docs named like those added, or like this function's own (see OWN), are left out.

    With `size`, a column that holds the words of each row, text may be a hash of the text: nothing but that column, id and
    source is read again, and texts are neither counted nor carried (`narrow`).
    """
    docs = without(docs, *OWN)
    spots_in_all = max(SPOTS, 1 << (2 * docs.count() // docs_per_shard).bit_length())
    named = F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("-"))
    tie = F.xxhash64(text)
    words = n_words(F.col(text)) if size is None else F.col(size).cast("long")
    sized = docs.withColumns({"mix_size": words, "_source": named, "_spot": _spot(seed, F.col(doc_id), tie) % spots_in_all, "_tie": tie})
    spots = sized.groupBy("_source", "_spot").agg(F.first(source).alias("source"), F.sum("mix_size").alias("words"), F.count(F.lit(1)).alias("n"))
    sources = spots.groupBy("_source").agg(F.first("source").alias("source"), F.sum("words").alias("size"), F.sum("n").alias("n"))
    sources = targets(sources, weights, cap).withColumn("_all", F.floor(F.sum("size").over(Window.partitionBy(F.lit(0))) / block + 0.5).cast("long"))
    sources = apportion(sources, [], ["_source"], "target", "_all", "_blocks").withColumn(
        "_shards", F.ceil(F.col("n") / docs_per_shard).cast("long")
    )
    of_source = sources.select("_source", "size", "target", "_blocks", "_shards")
    spots = spots.select("_source", "_spot", "words").join(of_source, "_source").withColumn("_shard", F.col("_spot") % F.col("_shards"))
    shards = spots.groupBy("_source", "_shard", "size", "target", "_blocks").agg(F.sum("words").alias("_words"))
    shards = apportion(shards, ["_source"], ["_shard"], "_words", "_blocks", "_quota")
    quotas = spots.select("_source", "_spot", "_shard").join(
        shards.select("_source", "_shard", F.col("size").alias("mix_source_size"), F.col("target").alias("mix_target"), "_words", "_quota"), ["_source", "_shard"]
    )
    rows = sized.join(quotas, ["_source", "_spot"])
    n = F.ceil(F.col("_words") / block).cast("long")
    rows = rows.withColumn("_n", F.greatest(n, F.lit(1))).withColumn("_quota", F.least(F.col("_quota"), F.col("_n") * cap))
    start = _spot(seed, F.col("_source"), F.col("_shard")) % F.col("_n") * block
    order = Window.partitionBy("_source", "_shard").orderBy(_spot(seed + 1, F.col(doc_id)), doc_id, "mix_size", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"_to": F.sum("mix_size").over(order), "_start": start, "_run": F.col("_quota") % F.col("_n") * block})
    end, whole = F.col("_start") + F.col("_run"), F.col("_n") * block

    def common(lo: Column, hi: Column) -> Column:
        return F.greatest(F.least(F.col("_to"), hi) - F.greatest(F.col("_to") - F.col("mix_size"), lo), F.lit(0))

    taken = F.floor(F.col("_quota") / F.col("_n")).cast("long") * F.col("mix_size") + common(F.col("_start"), F.least(end, whole)) + common(F.lit(0).cast("long"), end - whole)
    return rows.select(*docs.columns, "mix_size", "mix_source_size", "mix_target", taken.cast("long").alias("mix_taken"))
