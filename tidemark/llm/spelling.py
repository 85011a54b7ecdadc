"""Spelling variants by anagram hashing.

A word's key is the sum of the fifth powers of its letters, so words with the same letters share a key, and one letter more,
fewer or another changes it by a known value. Near words are found by joins of keys: a word's key less the value of one
of its letters is the key of a word without that letter (an addition or removal), and equals another word's key less the value
of another letter where one letter is exchanged. What letters cannot tell, their order can: one edit leaves one half
of a word as it was, so the half that the changed letter is not in is part of the join's key, and whole words are compared
in the end.

Words are counted before the shuffle, and only the vocabulary is joined; no pair of words is made that does not share its
letters but for one and its half.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import lower_ascii, shared_folder, written
from tidemark.shared import removed

#: A word's letters: a run of these.
RUN = "[A-Za-zÀ-ÿ]+"
#: Keys are sums modulo this; above any letter's value, so letters stay apart.
WRAP = 1 << 62
#: A letter of a run falls out where the checksum is a multiple of this.
SLIP = 199


def slipped(doc_id: Column, run: Column) -> Column:
    """The run without the letter at h % length where SLIP divides h, the CRC-32 of `<doc_id>:<run>`; a null id is empty."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.char_length(run)).cast("int")
    return F.when(h % SLIP == 0, F.concat(F.substr(run, F.lit(1), at), F.substr(run, at + 2))).otherwise(run)


def runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, run) of all lower-cased runs of letters, repeats included. A null text has none."""
    found = F.regexp_extract_all(lower_ascii(F.col(f"`{text}`")), F.lit(f"({RUN})"), F.lit(1))
    return docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.explode(found).alias("run"))


def vocabulary(words: DataFrame, least_length: int = 6, least_n: int = 5) -> DataFrame:
    """(word, n) of the words of at least so many letters and occurrences, counted over all rows."""
    long_enough = words.where(F.char_length("word") >= least_length)
    return long_enough.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_n)


def value(letter: Column) -> Column:
    code = F.ascii(letter).cast("long")
    return code * code * code * code * code % WRAP


def key(word: Column) -> Column:
    """The sum of the values of a word's letters."""
    return F.aggregate(F.split(word, ""), F.lit(0).cast("long"), lambda a, c: (a + value(c)) % WRAP)


def without_one(words: DataFrame) -> DataFrame:
    """(word, n, length, less, letter, side, half) for each letter that can be taken out: `less` is the key that is left, and half the first
    or last half of the shorter length (side 1 or 2) that the letter does not stand in."""
    half = F.floor((F.col("length") - 1) / 2).cast("int")
    return (
        words.select("word", "n", "length", "key", F.posexplode(F.split("word", "")).alias("at", "letter"))
        .withColumn("side", F.when(F.col("at") >= half, 1).otherwise(2))
        .dropDuplicates(["word", "letter", "side"])
        .select("word", "n", "length", F.pmod(F.col("key") - value(F.col("letter")), F.lit(WRAP)).alias("less"), "letter", "side", _half(F.col("side"), F.col("word"), half, F.lit(2)))
    )


def _half(side: Column, word: Column, half: Column, skip: Column) -> Column:
    """A hash of the first `half` letters, or of those from place half + skip on."""
    return F.xxhash64(F.when(side == 1, F.substr(word, F.lit(1), half)).otherwise(F.substr(word, half + skip))).alias("half")


def _first_unlike(long: Column, short: Column) -> Column:
    """How many letters two words have in common before the first unlike one, or the end of the shorter."""
    return F.aggregate(
        F.zip_with(F.split(long, ""), F.split(short, ""), lambda a, b: a.eqNullSafe(b)),
        F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")),
        lambda a, same: F.struct((a["n"] + F.when(a["on"] & same, 1).otherwise(0)).alias("n"), (a["on"] & same).alias("on")),
    )["n"]


def near(words: DataFrame) -> DataFrame:
    """(word, other, other_n) for every two words (word, n) that differ by one inserted, deleted or replaced letter, both ways."""
    words = words.withColumns({"length": F.char_length("word"), "key": key(F.col("word"))})
    less = written(without_one(words), folder := shared_folder(words.sparkSession))
    whole = words.withColumn("side", F.explode(F.array(F.lit(1), F.lit(2)))).select(
        F.col("word").alias("short"), F.col("n").alias("short_n"), F.col("key").alias("less"), (F.col("length") + 1).alias("length"), "side", _half(F.col("side"), F.col("word"), F.floor(F.col("length") / 2).cast("int"), F.lit(1))
    )
    # letters may repeat, so a pair can meet by both sides; it counts by that of the first place where the words differ
    side = lambda other: F.when(_first_unlike(F.col("word"), F.col(other)) >= F.floor((F.col("length") - 1) / 2), 1).otherwise(2) == F.col("side")
    added = less.join(whole, ["less", "length", "side", "half"]).where((F.levenshtein("word", "short", 1) == 1) & side("short"))
    other = less.select(F.col("word").alias("other"), F.col("n").alias("other_n"), "less", "length", "side", "half", F.col("letter").alias("other_letter"))
    exchanged = less.join(other, ["less", "length", "side", "half"]).where((F.col("letter") != F.col("other_letter")) & (F.levenshtein("word", "other", 1) == 1) & side("other"))
    both = added.select("word", F.col("short").alias("other"), F.col("short_n").alias("other_n")).unionByName(added.select(F.col("short").alias("word"), F.col("word").alias("other"), F.col("n").alias("other_n")))
    found = written(both.unionByName(exchanged.select("word", "other", "other_n")))
    removed(words.sparkSession, folder)
    return found


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the rows (word, form) whose form is not null: the last word that forms lead to.

    Each round doubles the steps taken. Forms must not lead in a circle, as those of `group` cannot: n grows at each step."""
    spark = forms.sparkSession
    state = written(forms.where("form IS NOT NULL").select("word", F.col("form").alias("root")), last := shared_folder(spark))
    while True:
        step = state.alias("a").join(state.select(F.col("word").alias("root"), F.col("root").alias("next")).alias("b"), "root", "left")
        state = written(step.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("went")), folder := shared_folder(spark))
        went = state.where("went").limit(1).count()
        removed(spark, last)
        last, state = folder, state.drop("went")
        if not went:
            return state


def group(words: DataFrame, factor: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the rows (word, n), which hold each word once.

    form is the near word of largest n (ties: the first in code-point order) if that is at least `factor` times the word's n, else
    null; root is the last word that forms lead to, the word itself without one. An empty table gives an empty one.
    """
    words = written(words.select("word", F.col("n").cast("long").alias("n")))
    best = near(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("other"))).alias("best"))
    found = words.join(best, "word", "left").withColumn("fits", F.coalesce(-F.col("best.less") >= factor * F.col("n"), F.lit(False)))
    found = written(
        found.select(
            "word", F.when(F.col("fits"), F.col("best.other")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("fits"), -F.col("best.less")).alias("form_n")
        )
    )
    led = roots(found)
    return found.join(led, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_length: int = 6, least_n: int = 5, factor: int = 5, slips: bool = True) -> DataFrame:
    """The words of a table's texts, grouped: the columns of `group`.

    Words are runs of letters (RUN), A-Z in lower case; with `slips`, a letter falls out of some (`slipped`). Null and empty texts
    have none, repeated rows count as often as they stand, and other columns stay behind whatever their names.
    """
    found = runs(docs, doc_id, text)
    word = slipped(F.col("doc_id"), F.col("run")) if slips else F.col("run")
    return group(vocabulary(found.select(word.alias("word")), least_length, least_n), factor)
