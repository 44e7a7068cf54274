"""License scans by diagonal voting, with DataFrame functions only.

A document's words and those of the license templates become rolling hashes of six words: each word is hashed once, and
hashes of spans are made of those of two shorter spans, so that six words take three more hashes. The join of both gives each match
a diagonal (document position less template position). Matches vote for their diagonal; diagonals of one document and
template that lie within `slack` of each other are merged into an island, since an inserted or dropped word moves the rest to a
neighbour. More inserted words leave several islands: each is joined with those that follow it in the document and in the
template and bring more of its words, as long as the length in the document fits the template's. A joined span is verified:
it must hold `coverage` of the template's words, where a match holds k. Base phrases are found word by word besides; their labels always stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import cut

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
K = 6
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Notices and passages of public licenses (fixed values, letters and digits only). Other tables go to scan_licenses().
TEMPLATES = {
    "mit": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    ),
    "apache": (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
        "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce prepare derivative works of publicly display publicly perform sublicense and distribute the work and such derivative works in source or object form",
    ),
    "gpl": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version",
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details",
        "you should have received a copy of the gnu general public license along with this program if not see",
        "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed",
    ),
    "lgpl": (
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version",
        "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu lesser general public license for more details",
        "you should have received a copy of the gnu lesser general public license along with this library if not",
    ),
    "agpl": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
        "you should have received a copy of the gnu affero general public license along with this program if not see",
    ),
    "bsd": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
    ),
    "mpl": (
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at",
        "the contents of this file are subject to the mozilla public license version 1 1 the license you may not use this file except in compliance with the license you may obtain a copy of the license at",
    ),
    "isc": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
        "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    ),
    "cc-by": (
        "this work is licensed under a creative commons attribution 4 0 international license to view a copy of this license visit",
        "this work is licensed under the creative commons attribution 4 0 international license to view a copy of this license visit",
        "this work is licensed under the creative commons attribution 3 0 unported license to view a copy of this license visit",
    ),
    "cc-by-sa": (
        "this work is licensed under a creative commons attribution sharealike 4 0 international license to view a copy of this license visit",
        "this work is licensed under the creative commons attribution sharealike 4 0 international license to view a copy of this license visit",
    ),
    "cc-by-nc": (
        "this work is licensed under a creative commons attribution noncommercial 4 0 international license to view a copy of this license visit",
        "this work is licensed under the creative commons attribution noncommercial 4 0 international license to view a copy of this license visit",
    ),
    "cc0": ("to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",),
    "zlib": (
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software",
        "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    ),
    "unlicense": (
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    ),
    "boost": (
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
    ),
    "epl": ("this program and the accompanying materials are made available under the terms of the eclipse public license v1 0 which accompanies this distribution and is available at",),
    "wtfpl": ("everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed",),
}


def words_of(text: F.Column) -> F.Column:
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(low, NOT_WORD), lambda w: w != "")


def _let(value: F.Column, body) -> F.Column:
    """body(value) with value evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def rolling(words: str, k: int) -> F.Column:
    """Hashes of each k consecutive words of the array column: positions from 0 in array order.

    A hash of m + n words is that of the hashes of its first m and its last n words, and each array of hashes is made once."""

    def both(a: F.Column, b: F.Column, m: int) -> F.Column:
        return F.zip_with(a, F.slice(b, m + 1, F.greatest(F.size(b) - m, F.lit(0))), lambda x, y: F.xxhash64(x, y))

    def grown(spans: list[F.Column]) -> F.Column:
        """spans: hashes of 1, 2, 4, ... words."""
        if 1 << len(spans) <= k:
            return _let(both(spans[-1], spans[-1], 1 << len(spans) - 1), lambda s: grown([*spans, s]))
        bits = [i for i in range(len(spans)) if k >> i & 1]
        out, length = spans[bits[0]], 1 << bits[0]
        for i in bits[1:]:
            out, length = both(out, spans[i], length), length + (1 << i)
        return out

    # Entries past the last whole span are made of missing words.
    return F.slice(_let(F.transform(F.col(words), lambda w: F.xxhash64(w)), lambda s: grown([s])), 1, F.greatest(F.size(words) - (k - 1), F.lit(0)))


def template_table(spark: SparkSession, templates: dict[str, tuple[str, ...]]) -> DataFrame:
    """(label, text) of a dict of labels and texts."""
    rows = [F.struct(F.lit(label).alias("label"), F.lit(t).alias("text")) for label, texts in templates.items() for t in texts]
    return spark.range(1).select(F.inline(F.array(*rows)))


def template_grams(templates: DataFrame, k: int) -> DataFrame:
    """(h, template, label, size, position, longest) of a table (label, text): one row a gram, with the gram's longest word. Rows
    without label or text are left out."""
    t = templates.filter("label is not null and text is not null").select("label", "text").distinct()
    t = t.select("label", words_of(F.col("text")).alias("words")).withColumn("template", F.concat_ws("-", "label", F.hex(F.xxhash64("words"))))
    grams = t.select("template", "label", "words", F.size("words").alias("size"), F.posexplode(rolling("words", k)).alias("position", "h"))
    longest = F.array_max(F.transform(F.slice("words", F.col("position") + 1, k), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    return grams.select("h", "template", "label", "size", "position", longest.alias("longest"))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] | None = None, templates: DataFrame | None = None, k: int = K, slack: int = 3, coverage: float = 0.6) -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    Null texts count as empty: no words, no labels, nulls for first and last word, score 0. score is 1 with a base phrase,
    else the largest share of a template's words that a verified span holds. templates: a table (label, text) of at most some
    hundred thousand words, as all executors look its hashes up; TEMPLATES, if not given; shorter ones than k words match nothing. spans: label, template, first and last word, coverage.
    Null and repeated ids are rows of their own. Empty tables give no rows. Other columns are ignored."""
    phrases = PHRASES if phrases is None else phrases
    grams = template_grams(templates or template_table(docs.sparkSession, TEMPLATES), k)
    # The templates' hashes (a fixed number, given by the caller) are looked up before grams leave their row.
    known = sorted(r["h"] for r in grams.select("h").distinct().collect())
    # A text with a gram of a template has the gram's longest word; others need no hashes.
    longest = F.array(*[F.lit(r["longest"]) for r in grams.select("longest").distinct().orderBy("longest").collect()]).cast("array<string>")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("words", words_of(F.col("text")))
    maybe = F.arrays_overlap("words", F.array(*[F.lit(w) for w in sorted({p.split()[0] for p in phrases})]).cast("array<string>"))

    def label(i: F.Column) -> F.Column:
        out = F.lit(None).cast("string")
        for phrase, name in reversed(phrases.items()):
            here = F.lit(True)
            for j, word in enumerate(phrase.split()):
                here = here & (F.get("words", i + j) == word)
            out = F.when(here, F.lit(name)).otherwise(out)
        return out

    places = F.transform(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.struct(i.cast("long").alias("at"), label(i).alias("label")))
    base = F.when(maybe, F.filter(places, lambda x: x["label"].isNotNull())).otherwise(F.array().cast("array<struct<at:bigint,label:string>>"))
    hits = F.array_compact(F.transform("grams", lambda h, i: F.when(h.isin(known), F.struct(h.alias("h"), i.alias("at")))))
    rows = rows.select("doc_id", F.monotonically_increasing_id().alias("rid"), F.size("words").cast("long").alias("n_words"), base.alias("base"), F.when(F.arrays_overlap("words", longest), rolling("words", k)).otherwise(F.array().cast("array<bigint>")).alias("grams"))
    rows = cut(rows.select("doc_id", "rid", "n_words", "base", hits.alias("hits")), "license-words")

    matches = rows.select("rid", F.inline("hits")).join(F.broadcast(grams.drop("longest")), "h")
    votes = matches.groupBy("rid", "template", "label", "size", (F.col("at") - F.col("position")).alias("diagonal")).agg(
        F.collect_set("position").alias("seen"), F.min("at").alias("first"), F.max("at").alias("last")
    )
    order = Window.partitionBy("rid", "template").orderBy("diagonal")
    votes = votes.withColumn("new", (F.col("diagonal") - F.lag("diagonal").over(order) > slack).cast("int"))
    votes = votes.withColumn("island", F.sum(F.coalesce("new", F.lit(0))).over(order))
    held = F.array_sort(F.array_distinct(F.flatten(F.transform(F.flatten(F.collect_list("seen")), lambda p: F.sequence(p, p + k - 1)))))
    islands = votes.groupBy("rid", "template", "label", "size", "island").agg(held.alias("held"), F.min("first").alias("first"), (F.max("last") + k - 1).alias("last"))
    islands = islands.filter(F.col("last") - F.col("first") < 2 * F.col("size"))
    # An island's frame has the islands that start within two template lengths from its start, so its size is bounded.
    near = Window.partitionBy("rid", "template").orderBy(F.col("first") / (2.0 * F.col("size"))).rangeBetween(0, 1)
    frames = islands.withColumn("near", F.sort_array(F.collect_list(F.struct("first", "last", "held")).over(near)))

    def joined_to(span: F.Column, island: F.Column) -> F.Column:
        follows = (island["held"][0] > F.col("held")[0]) & (island["last"] - F.col("first") < 2 * F.col("size"))
        more = F.struct(F.greatest(span["last"], island["last"]).alias("last"), F.array_union(span["held"], island["held"]).alias("held"))
        return F.when(follows & (F.size(F.array_except(island["held"], span["held"])) > 0), more).otherwise(span)

    spans = frames.withColumn("span", F.aggregate("near", F.struct("last", "held"), joined_to))
    spans = spans.select("rid", "template", "label", "first", F.col("span.last").alias("last"), (F.size("span.held") / F.col("size")).alias("coverage")).filter(F.col("coverage") >= coverage)
    # Spans of one template that overlap are parts of one passage: the one with most of the template stands for it.
    before = Window.partitionBy("rid", "template").orderBy("first", "last")
    apart = F.coalesce((F.col("first") > F.max("last").over(before.rowsBetween(Window.unboundedPreceding, -1))).cast("int"), F.lit(0))
    spans = spans.withColumn("apart", apart).withColumn("passage", F.sum("apart").over(before.rowsBetween(Window.unboundedPreceding, 0)))
    best = F.max_by(F.struct("first", "last", "coverage"), F.struct("coverage", -F.col("first"), -F.col("last")))
    spans = spans.groupBy("rid", "template", "label", "passage").agg(best.alias("s")).select("rid", "template", "label", "s.*")
    by_row = spans.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("label", "template", "first", "last", "coverage"))).alias("spans"))

    out = rows.join(by_row, "rid", "left").withColumn("spans", F.coalesce("spans", F.array().cast(by_row.schema["spans"].dataType)))
    at, names = F.transform("base", lambda x: x["at"]), F.transform("base", lambda x: x["label"])
    more = F.transform("spans", lambda x: x["label"])
    joined = lambda c: F.array_join(F.sort_array(F.array_distinct(c)), ",")
    score = F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform("spans", lambda x: x["coverage"])), F.lit(0.0)))
    return out.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"),
        joined(names).alias("base_labels"), joined(F.concat(names, more)).alias("labels"), score.alias("score"), "spans",
    )


def op9_licenses(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans")
