"""Licence scans by diagonal voting.

Rolling hashes of three words join template positions; a match votes for its diagonal, the document place minus the
template place. On a diagonal lies a copy without insertions. From each diagonal on which a copy may begin, it merges
with those around it, no further off than a share of the template, and the matches, compared as words, are verified
as an alignment: they must follow one another in the document as in the template, with few words put in between, and
cover all of a phrase, or four fifths of a long text.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .words import grams, let, words

#: Words of a gram; words that may be put in at one place; shares of a long template that must be covered, and that may be put in altogether.
GRAM, NEAR, COVERED, PUT_IN = 3, 8, 0.8, 0.2
#: Template grams up to which their hashes stand in the plan and their positions are broadcast; beyond, both sides shuffle.
FEW_GRAMS = 50_000


class Template(NamedTuple):
    label: str
    text: str
    base: bool = False
    phrase: bool = False


TEMPLATES = [
    Template("mit", "under the mit license", base=True, phrase=True),
    Template("apache-2", "apache license version 2", base=True, phrase=True),
    Template("cc-by-nc", "cc by nc", base=True, phrase=True),
    Template("gpl-3", "gnu general public license version 3", phrase=True),
    Template("all-rights-reserved", "all rights reserved", phrase=True),
    Template("mit", """
        Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without
        limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
        Software, and to permit persons to whom the Software is furnished to do so, subject to the following
        conditions: The above copyright notice and this permission notice shall be included in all copies or
        substantial portions of the Software."""),
    Template("isc", """
        Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
        hereby granted, provided that the above copyright notice and this permission notice appear in all copies."""),
    Template("apache-2", """
        Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing,
        software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS
        OF ANY KIND, either express or implied. See the License for the specific language governing permissions and
        limitations under the License."""),
    Template("bsd", """
        Redistribution and use in source and binary forms, with or without modification, are permitted provided that
        the following conditions are met: Redistributions of source code must retain the above copyright notice,
        this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above
        copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
        materials provided with the distribution."""),
    Template("gpl-3", """
        This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
        Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
        option) any later version."""),
]


def template_grams(spark: SparkSession, templates: list[Template]) -> DataFrame:
    """h, gram, tmpl, tpos of all templates. A template of fewer than GRAM words is refused, for no gram would find it."""
    rows = spark.createDataFrame([(k, t.text) for k, t in enumerate(templates)], "tmpl int, text string").select("tmpl", words(F.col("text")).alias("ws"))
    texts = F.transform(F.sequence(F.lit(1), F.size("ws") - (GRAM - 1)), lambda i: F.array_join(F.slice("ws", i, GRAM), " "))
    return rows.select("tmpl", F.posexplode(F.arrays_zip(grams(F.col("ws"), GRAM).alias("h"), texts.alias("gram"))).alias("tpos", "g")).select("g.h", "g.gram", "tmpl", "tpos")


def template_lengths(templates: list[Template]) -> list[int]:
    """Words of each template; they are ASCII."""
    found = [len(re.findall("[0-9a-z]+", t.text.lower())) for t in templates]
    if any(n < GRAM for n in found) or not all(t.text.isascii() for t in templates):
        raise ValueError(f"a template has {GRAM} ASCII words or more")
    return found


def drifts(templates: list[Template]) -> list[int]:
    """Words that may be put into a copy of each template: none for phrases."""
    return [0 if t.phrase else int(PUT_IN * n) for t, n in zip(templates, template_lengths(templates))]


def _aligned(pairs: Column, diag: Column, most: Column) -> Column:
    """Template words that the best chain from a diagonal covers. pairs: array of t, pos.

    The chain takes matches in order of the template: the first on the diagonal, others behind the last one in the
    document too, with at most NEAR words put in since and most altogether.
    """
    start = F.struct(F.lit(-1).alias("t"), F.lit(-1).alias("pos"), F.lit(0).alias("cover"), F.lit(0).alias("put"))

    def step(a: Column, x: Column) -> Column:
        put = F.greatest(F.lit(0), (x["pos"] - a["pos"]) - (x["t"] - a["t"]))
        first = (a["cover"] == 0) & (x["pos"] - x["t"] == diag)
        goes_on = (a["cover"] > 0) & (x["t"] > a["t"]) & (x["pos"] > a["pos"]) & (put <= NEAR) & (a["put"] + put <= most)
        return F.when(first, F.struct(x["t"].alias("t"), x["pos"].alias("pos"), F.lit(GRAM).alias("cover"), F.lit(0).alias("put"))).when(
            goes_on, F.struct(x["t"].alias("t"), x["pos"].alias("pos"), (a["cover"] + F.least(F.lit(GRAM), x["t"] - a["t"])).alias("cover"), (a["put"] + put).alias("put"))
        ).otherwise(a)

    return F.aggregate(F.array_sort(pairs), start, step, lambda a: a["cover"])


def scan(docs: DataFrame, templates: list[Template] = TEMPLATES) -> DataFrame:
    """Licences of each row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    docs: doc_id, text; other columns are ignored whatever their names. Null and empty texts have no words, no places
    and empty labels. Repeated rows each get their result. A very long text is read whole, and of it only its matches
    go on. score is the largest share of a template's words that an aligned chain covers, 0 where none match. No rows
    give no rows.
    """
    spark = docs.sparkSession
    lengths = template_lengths(templates)
    known = template_grams(spark, templates)
    few = sum(lengths) <= FEW_GRAMS
    wanted = [r.h for r in known.select("h").distinct().collect()] if few else []

    def hits(ws):
        def place(h, i):
            found = F.struct(i.cast("int").alias("pos"), h.alias("h"), F.array_join(F.slice(ws, i + 1, GRAM), " ").alias("gram"))
            return F.when(h.isin(wanted), found) if few else found

        return F.filter(F.transform(grams(ws, GRAM), place), lambda x: x.isNotNull())

    # of each row one entry carries n_words on, under a hash of its own, so that no key of the join is hot
    row = F.xxhash64("text").alias("row")
    own = F.array(F.struct(F.lit(None).cast("int").alias("pos"), F.xxhash64("doc_id", "row", F.lit("own")).alias("h"), F.lit(None).cast("string").alias("gram")))
    rows = docs.select("doc_id", row, words(F.col("text")).alias("ws")).select(
        "doc_id", "row", F.size("ws").alias("n_words"), F.explode(F.concat(own, let(F.col("ws"), hits))).alias("x")
    )
    met = rows.select("doc_id", "row", "n_words", "x.*").join(F.broadcast(known) if few else known, ["h", "gram"], "left")
    met = common.stash(met.where("pos is null or tmpl is not null").select("doc_id", "row", "n_words", "pos", "tmpl", "tpos"), "licence_hits")

    of = lambda found: F.create_map(*(F.lit(x) for k, v in enumerate(found) for x in (k, v)))[F.col("tmpl")]
    label, length, drift = of([t.label for t in templates]), of(lengths), of(drifts(templates))
    base, phrase = ([k for k, t in enumerate(templates) if getattr(t, f)] for f in ("base", "phrase"))
    # repeated rows vote as one: a diagonal keeps the set of template places
    votes = met.where("tmpl is not null").groupBy("doc_id", "row", "tmpl", (F.col("pos") - F.col("tpos")).alias("diag")).agg(F.collect_set("tpos").alias("at"))
    most = max([0, *drifts(templates)])
    around = Window.partitionBy("doc_id", "row", "tmpl").orderBy("diag").rangeBetween(-most, most)
    near = F.filter(F.collect_list(F.struct("diag", "at")).over(around), lambda v: F.abs(v["diag"] - F.col("diag")) <= drift)
    pairs = F.flatten(F.transform("near", lambda v: F.transform(v["at"], lambda t: F.struct(t.alias("t"), (v["diag"] + t).alias("pos")))))
    spans = votes.withColumn("near", near).select("doc_id", "row", "tmpl", "diag", (_aligned(pairs, F.col("diag"), drift) / length).alias("cover"))
    good = F.col("cover") >= F.when(F.col("tmpl").isin(phrase), 1.0).otherwise(COVERED)
    place = F.when(good & F.col("tmpl").isin(base), F.col("diag"))
    found = spans.groupBy(F.col("doc_id").alias("__id"), F.col("row").alias("__row")).agg(
        F.count(place).alias("n_base"), F.min(place).alias("first_word"), F.max(place).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(place.isNotNull(), label))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(F.when(good, label))), ",").alias("labels"), F.max("cover").alias("score"),
    )
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("row") == F.col("__row"))
    return met.where("pos is null").join(found, same, "left").select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        F.col("first_word").cast("long").alias("first_word"), F.col("last_word").cast("long").alias("last_word"),
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def scan_sql(word_list: str, templates: list[Template] = TEMPLATES) -> str:
    """scan() of `documents` as DuckDB SQL; word_list is the expression for a text's words."""
    rows = ", ".join(f"({k}, '{t.label}', {t.base}, {t.phrase}, {n}, {d}, $t${t.text}$t$)" for k, (t, n, d) in enumerate(zip(templates, template_lengths(templates), drifts(templates))))
    put = "greatest(0, (x.pos - a.pos) - (x.t - a.t))"
    return f"""
        WITH t(tmpl, label, base, phrase, n, drift, text) AS (VALUES {rows}),
        tg AS (SELECT *, array_to_string(ws[tpos + 1:tpos + {GRAM}], ' ') AS gram FROM (SELECT tmpl, ws, unnest(range(len(ws) - {GRAM - 1})) AS tpos FROM (SELECT tmpl, {word_list} AS ws FROM t))),
        d AS (SELECT doc_id, row_number() OVER () AS r, {word_list} AS ws FROM documents),
        dg AS (SELECT r, pos, array_to_string(ws[pos + 1:pos + {GRAM}], ' ') AS gram FROM (SELECT r, ws, unnest(range(len(ws) - {GRAM - 1})) AS pos FROM d)),
        v AS (SELECT DISTINCT r, tmpl, pos - tpos AS diag, tpos AS t, pos FROM dg JOIN tg USING (gram)),
        p AS (SELECT a.r, a.tmpl, a.diag, label, base, phrase, n, drift, list_sort(list({{'t': v.t, 'pos': v.pos, 'cover': 0, 'put': 0}})) AS pairs
            FROM (SELECT DISTINCT r, tmpl, diag FROM v) a JOIN t USING (tmpl) JOIN v ON v.r = a.r AND v.tmpl = a.tmpl AND abs(v.diag - a.diag) <= drift GROUP BY ALL),
        e AS (SELECT *, list_reduce(list_concat([{{'t': -1, 'pos': -1, 'cover': 0, 'put': 0}}], pairs), lambda a, x: CASE
                WHEN a.cover = 0 AND x.pos - x.t = diag THEN {{'t': x.t, 'pos': x.pos, 'cover': {GRAM}, 'put': 0}}
                WHEN a.cover > 0 AND x.t > a.t AND x.pos > a.pos AND {put} <= {NEAR} AND a.put + {put} <= drift THEN {{'t': x.t, 'pos': x.pos, 'cover': a.cover + least({GRAM}, x.t - a.t), 'put': a.put + {put}}}
                ELSE a END).cover / CAST(n AS DOUBLE) AS cover FROM p),
        f AS (
            SELECT r, count(*) FILTER (base AND cover >= 1) AS n_base, min(diag) FILTER (base AND cover >= 1) AS first_word, max(diag) FILTER (base AND cover >= 1) AS last_word,
                string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base AND cover >= 1) AS base_labels,
                string_agg(DISTINCT label, ',' ORDER BY label) FILTER (cover >= CASE WHEN phrase THEN 1 ELSE {COVERED} END) AS labels, max(cover) AS score
            FROM e GROUP BY r
        )
        SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
            coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
        FROM d LEFT JOIN f USING (r)
    """
