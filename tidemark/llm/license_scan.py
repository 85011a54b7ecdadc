"""License scan: phrases, and an exact set-similarity join of text blocks with license templates.

A block is any run of words of a text, wherever lines break, twice as long as the template (BLOCK words at least); a template
matches a block that holds the threshold of its distinct words. Texts are normalised once, into a narrow table with what each
row holds of the templates' words. Tokens are ordered by how many rows of the whole corpus hold them, rarest first. A row that
contains a template to the threshold must hold one of the template's first |t| - ceil(threshold * |t|) + 1 tokens, so rows
meet templates on these alone. At the first token in common, what is left of the template and of the row's own tokens bounds the
overlap (position), and the overlap itself must reach the need (length); only rows that pass are cut into blocks, and an exact
intersection decides. DataFrame functions only. Only the templates, of fixed number and size, are broadcast.

Word sets alone cannot tell a license from its neighbours, which differ by a word or a number. So a template may name phrases of which
one must stand in the block as it is (REQUIRED), and phrases that must not (FORBIDDEN): `version 3` behind the name, `nc` in it, a third clause.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import PLAIN_GAP, lower_ascii, without, written

#: Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: License statements, notices and texts by label of the method's own.
TEMPLATES = {
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "mit-notice": "Released under the MIT License.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
        You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing,
        software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
        See the License for the specific language governing permissions and limitations under the License.""",
    "gpl-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by
        the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that
        it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the
        GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program.
        If not, see <https://www.gnu.org/licenses/>.""",
    "mit-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the
        "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute,
        sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following
        conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
        MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
        CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE
        OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "isc-text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the
        above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
        WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY
        SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION
        OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "bsd-2-text": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are
        met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
        2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
        documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
        AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR
        PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL,
        EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS;
        OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR
        OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
}

#: Of these phrases one must stand in a template's block; they hold what tells the license from its neighbours.
REQUIRED = {
    "gpl-3.0": ("gnu general public license version 3", "gnu general public license v3", "gnu general public license v 3"),
    "apache-2.0": ("licensed under the apache license version 2 0", "licensed under apache license version 2 0"),
    "cc-by-nc-4.0": ("licensed under cc by nc 4 0", "licensed under a cc by nc 4 0", "licensed under the cc by nc 4 0"),
    "mit-notice": ("released under the mit license", "licensed under the mit license", "distributed under the mit license", "released under mit license"),
    "bsd": ("redistribution and use in source and binary forms",),
    "mpl-2.0": ("mozilla public license v 2 0", "mozilla public license version 2 0"),
    "apache-2.0-header": ("apache license version 2 0",),
    "gpl-header": ("gnu general public license as published by the free software foundation either version 3", "gnu general public license as published by the free software foundation version 3"),
    "mit-text": ("the above copyright notice and this permission notice shall be included",),
    "isc-text": ("provided that the above copyright notice and this permission notice appear in all copies",),
    "bsd-2-text": ("redistributions in binary form must reproduce the above copyright notice",),
}

#: None of these may stand there; they belong to another license with much the same words.
FORBIDDEN = {"bsd-2-text": ("neither the name", "all advertising materials"), "apache-2.0": ("llvm exceptions",)}

#: The least words of a block.
BLOCK = 64
ADDED = ("scan_words", "scan_base", "scan_first", "scan_last", "scan_labels", "scan_templates", "scan_score")
OWN = ("_norm", "_found", "_held", "_row", "_labels", "_score")


def words_of(text: str) -> list[str]:
    return [w for w in re.split("[^0-9a-z\x80-\U0010ffff]+", text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))) if w]


class Templates:
    """Word sets, needs, block lengths and phrases of templates."""

    def __init__(self, templates: dict[str, str], threshold: float, required: dict[str, tuple[str, ...]], forbidden: dict[str, tuple[str, ...]]):
        self.phrases = {label: tuple([" ".join(words_of(p)) for p in listed.get(label, ())] for listed in (required, forbidden)) for label in templates}
        self.words = {label: sorted(set(words_of(t))) for label, t in templates.items() if words_of(t)}
        self.need = {label: max(1, math.ceil(round(threshold * len(w), 9))) for label, w in self.words.items()}
        self.block = {label: max(BLOCK, 2 * len(words_of(templates[label]))) for label in self.words}
        self.vocabulary = sorted({w for ws in self.words.values() for w in ws})


def _normal(text: Column) -> Column:
    """Words with a space before and after each, or one space for none."""
    spaced = F.regexp_replace(lower_ascii(F.coalesce(text, F.lit(""))), PLAIN_GAP, " ")
    inner = F.trim(spaced)
    return F.when(inner == "", F.lit(" ")).otherwise(F.concat(F.lit(" "), inner, F.lit(" ")))


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" ")))


def _any_of(listed: dict[str, str]) -> str:
    return f" (?={'|'.join(f'{p} ' for p in listed)})"


def _phrase_columns(listed: dict[str, str]) -> dict[str, Column]:
    """What phrases() adds, from _norm and _found."""
    any_phrase, some = _any_of(listed), F.col("_found") > 0
    until_first = F.substring(F.col("_norm"), F.lit(1), F.regexp_instr("_norm", F.lit(any_phrase)))
    until_last = F.regexp_extract("_norm", f"(?s)^(.*{any_phrase})", 1)
    labels = F.array(*[F.when(F.contains("_norm", F.lit(f" {p} ")), F.lit(label)) for p, label in listed.items()])
    return {
        "scan_words": F.greatest(_spaces(F.col("_norm")) - 1, F.lit(0)).cast("long"),
        "scan_base": F.col("_found").cast("long"),
        "scan_first": F.when(some, _spaces(until_first) - 1).cast("long"),
        "scan_last": F.when(some, _spaces(until_last) - 1).cast("long"),
        "scan_labels": F.when(some, F.array_compact(labels)).otherwise(F.array().cast("array<string>")),
    }


def phrases(docs: DataFrame, text: str = "text", listed: dict[str, str] = PHRASES) -> DataFrame:
    """Adds scan_words, scan_base (places of all phrases), scan_first, scan_last (words from 0) and
    scan_labels (array) to every row. No two phrases may start with the same word."""
    rows = docs.withColumn("_norm", _normal(F.col(text))).withColumn("_found", F.regexp_count("_norm", F.lit(_any_of(listed))))
    return rows.select(*docs.columns, *[c.alias(n) for n, c in _phrase_columns(listed).items()])


def _strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def _one_of(text: Column | str, listed: str) -> Column:
    """Whether one of the listed phrases stands in a normalised text; where none is listed, none is asked for."""
    text = F.col(text) if isinstance(text, str) else text
    return (F.size(listed) == 0) | F.exists(listed, lambda p: F.contains(text, F.concat(F.lit(" "), p, F.lit(" "))))


def matches(rows: DataFrame, known: Templates) -> DataFrame:
    """(_row, label, containment) of the templates that rows (_row, _norm, _held) hold to the threshold: the share of the best block that has the template's phrases.

    _held are the tokens of the templates that the row holds."""
    spark = rows.sparkSession
    held_by = {r[0]: r[1] for r in rows.select(F.explode("_held").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n")).collect()}  # the templates' words at most
    order = sorted(known.vocabulary, key=lambda w: (held_by.get(w, 0), w))
    place = {w: i for i, w in enumerate(order)}
    entries = []
    for label, words in known.words.items():
        ranked = sorted(words, key=place.__getitem__)
        size, need = len(words), known.need[label]
        entries += [(w, label, r, size, need, known.block[label], words, *known.phrases[label]) for r, w in enumerate(ranked[: size - need + 1], 1)]
    prefix = F.broadcast(spark.createDataFrame(entries, "token string, label string, rank int, size int, need int, block int, words array<string>, required array<string>, forbidden array<string>"))
    # a row's own tokens in the global order, so that a token's place in the array says how many are left after it
    own = F.array_intersect(_strings(order), F.col("_held"))
    met = rows.where("_norm IS NOT NULL").select("_row", "_norm", own.alias("_own")).withColumn("_count", F.size("_own"))
    met = met.select("_row", "_norm", "_own", "_count", F.posexplode("_own").alias("at", "token")).join(prefix, "token")
    left = F.least(F.col("size") - F.col("rank"), F.col("_count") - F.col("at") - 1)
    # at a later common token the bound is only lower, and the first one alone is asked: no common token of the template before it
    met = met.where(1 + left >= F.col("need"))
    overlap = F.size(F.array_intersect("_own", "words"))
    first = F.array_position(F.col("_own"), F.element_at(F.array_intersect("_own", "words"), 1)) == F.col("at") + 1
    met = met.where((overlap >= F.col("need")) & first & _one_of("_norm", "required"))
    words = F.filter(F.split("_norm", " "), lambda w: w != "")
    spans = met.select("_row", "label", "size", "need", "block", "words", "required", "forbidden", words.alias("_words"))
    starts = F.sequence(F.lit(0), F.greatest(F.ceil((F.size("_words") - 2 * F.col("block")) / F.col("block")), F.lit(0)).cast("int"))
    spans = spans.select("_row", "label", "size", "need", "block", "words", "required", "forbidden", F.explode(F.transform(starts, lambda i: F.slice(F.col("_words"), i * F.col("block") + 1, 2 * F.col("block")))).alias("_span"))
    spans = spans.where(F.size(F.array_intersect("_span", "words")) >= F.col("need"))
    begins = F.sequence(F.lit(0), F.greatest(F.size("_span") - F.col("block"), F.lit(0)))
    common = lambda block: F.size(F.array_intersect(block, F.col("words")))
    said = lambda block: F.concat(F.lit(" "), F.array_join(block, " "), F.lit(" "))

    def count(i: Column) -> Column:
        block = F.slice(F.col("_span"), i + 1, F.col("block"))
        fits = _one_of(said(block), "required") & ((F.size("forbidden") == 0) | ~F.exists("forbidden", lambda p: F.contains(said(block), F.concat(F.lit(" "), p, F.lit(" ")))))
        return F.when(common(block) >= F.col("need"), F.when(fits, common(block)))

    best = F.array_max(F.transform(begins, count))
    found = spans.select("_row", "label", "size", "need", best.alias("_n")).where(F.col("_n") >= F.col("need"))
    return found.groupBy("_row", "label").agg(F.max(F.col("_n") / F.col("size")).alias("containment"))


def scan(
    docs: DataFrame,
    text: str = "text",
    templates: dict[str, str] = TEMPLATES,
    threshold: float = 0.8,
    with_text: bool = True,
    required: dict[str, tuple[str, ...]] = REQUIRED,
    forbidden: dict[str, tuple[str, ...]] = FORBIDDEN,
) -> DataFrame:
    """Adds the columns of phrases() and scan_templates (array of labels) and scan_score to every row; without the text if with_text is false.

    A template counts in blocks that hold one of its required phrases and none of the forbidden ones; a label without such lists asks for none.
    scan_score is the best containment of a template in such a block, or 0. A null text has no words; every row has its own result,
    rows alike the same; an empty table gives an empty one. Columns of docs named like those added, and _norm, _found,
    _held, _row, _labels and _score, are left out. The narrow table is written to the shared folder.
    """
    docs = without(docs, *ADDED, *OWN)
    known = Templates(templates, threshold, required, forbidden)
    kept = [F.col(f"`{c}`") for c in docs.columns if with_text or c != text]
    rows = docs.withColumn("_norm", _normal(F.col(text)))
    rows = rows.withColumns({"_found": F.regexp_count("_norm", F.lit(_any_of(PHRASES))), "_held": F.array_intersect(_strings(known.vocabulary), F.split("_norm", " "))})
    may = F.lit(False)
    for label, words in known.words.items():
        may = may | (F.size(F.array_intersect("_held", _strings(words))) >= known.need[label])
    narrow = rows.select(
        *kept, *[c.alias(n) for n, c in _phrase_columns(PHRASES).items()], "_held", F.when(may, F.col("_norm")).alias("_norm"), F.monotonically_increasing_id().alias("_row")
    )
    narrow = written(narrow)
    best = matches(narrow.select("_row", "_norm", "_held"), known).groupBy("_row").agg(F.sort_array(F.collect_set("label")).alias("_labels"), F.max("containment").alias("_score"))
    none = F.array().cast("array<string>")
    both = narrow.drop("_held", "_norm").join(best, "_row", "left")
    return both.select(
        *[F.col(f"`{c}`") for c in narrow.columns if c not in OWN], F.coalesce("_labels", none).alias("scan_templates"), F.coalesce("_score", F.lit(0.0)).alias("scan_score")
    )
