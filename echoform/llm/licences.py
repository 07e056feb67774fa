"""Licence scans by the Dice coefficient of word bigrams, in DataFrame operations only.

A text is normalised (lower case, words of letters, digits and inner dots) and read
paragraph by paragraph (pieces between line feeds). A paragraph is compared with
licence templates by Dice: twice the number of distinct word bigrams that it shares
with the template over the sum of both numbers. Size bounds prune first: a Dice of t
needs sizes a and b with min(a, b) >= t / 2 * (a + b), so a paragraph whose bigrams
are too few or too many for every template is never compared, and only templates that
fit its size are. A text without any of the words that a match cannot lack is passed over
(see needed_words and gate_words). The whole text is one more unit.

Windows of words over the whole text, across line feeds, find statements inside longer
lines or wrapped over lines. A template of up to SHORT bigrams is compared with every
window that can reach the least Dice. A longer one is compared with windows of its length
at each place to which one of its ANCHORS (bigrams spread over it that stand in it once)
aligns it. A window counts unless a matched paragraph under it shares as many bigrams;
paragraphs under a window that shares more do not count (nor does the whole text, if a
window shares as many at a higher Dice); of windows that overlap, the one that shares most
bigrams counts.

Everything stays inside the row that it began in: no shuffle, no join; the templates
are literals, a bounded list that callers give. A template of one word has itself as
its only gram. Of equal coefficients the first template by name wins.

Nulls and empty texts match nothing: licence null, dice 0, no matches. Repeated rows
give repeated results. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Mapping
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Short statements of common licences, by SPDX identifier.
TEMPLATES = {
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
    "BSD-2-Clause": "Released under the BSD 2-Clause License.",
    "BSD-3-Clause": "Released under the BSD 3-Clause License.",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "Released into the public domain under CC0 1.0.",
    "EPL-2.0": "Made available under the terms of the Eclipse Public License, version 2.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": "Released under the ISC License.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
LEAST_DICE = 0.8
#: Whole licences (-text) and the notices that files carry, by SPDX identifier. The AGPL's terms are the GPL's with section 13 and the name changed, as they are published.
TEXTS = Path(__file__).resolve().parent / "licence_texts"
#: Templates of more bigrams are placed by their anchors, so many at most.
SHORT, ANCHORS = 40, 64


def every_template() -> dict[str, str]:
    """Short statements, whole licences and notices."""
    return TEMPLATES | {p.stem: p.read_text() for p in sorted(TEXTS.glob("*.txt"))}


def normal_words(text: Column) -> Column:
    """Words of a text: lower case, runs of letters and digits, dots kept between digits."""
    plain = F.regexp_replace(F.lower(text), r"(?<![0-9])\.|\.(?![0-9])|[^\p{L}\p{N}.]+", " ")
    return F.filter(F.split(F.trim(plain), " +"), lambda w: w != "")


def bigrams(words: Column) -> Column:
    """Distinct bigrams of an array of words; the word itself where there is one only."""
    pairs = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(F.when(F.size(words) == 1, words).otherwise(pairs))


def _template_grams(spark: SparkSession, templates: Mapping[str, str]) -> list[tuple[str, list[str], list[str]]]:
    """(name, distinct bigrams, words) of each template."""
    rows = spark.createDataFrame(sorted(templates.items()), "name string, body string").select("name", normal_words(F.col("body")).alias("words")).select("name", "words", bigrams(F.col("words")).alias("grams"))
    return [(r["name"], list(r["grams"]), list(r["words"])) for r in rows.collect() if r["grams"]]


def needed_words(known: list[tuple[str, list[str]]], least: float) -> set[str]:
    """Words of which every match has at least one.

    A match of a template of n bigrams shares at least i = least * n * (1 + low) / 2 of
    them, low being the size bound; so it has one of any n - i + 1 of them, and the
    longest word of that one. Those with the longest words are taken.
    """
    out = set()
    for _, grams in known:
        n = len(grams)
        shared = max(1, math.ceil(least * n * (1 + least / (2 - least)) / 2 - 1e-9))
        out |= set(sorted((max(g.split(" "), key=len) for g in grams), key=len, reverse=True)[: n - shared + 1])
    return out


def _any_of(words: set[str]) -> str:
    """Pattern of whole words, by first letter, so that few alternatives are tried at a place."""
    first = {}
    for w in sorted(words):
        first.setdefault(w[0], []).append(w[1:])
    tails = "|".join(rf"\Q{c}\E(?:{'|'.join(rf'\Q{t}\E' if t else '' for t in ts)})(?![a-z0-9])" for c, ts in first.items())
    return rf"(?<![a-z0-9])(?:{tails})" if words else "(?!)"


def gate_words(known: list[tuple[str, list[str]]], least: float) -> set[str]:
    """Words of which every match of each template has at least one, few for many long templates.

    As in needed_words, a match has one of any n - i + 1 of a template's bigrams; words of
    six letters or more are taken, the one that covers most of what is open first, until so
    many bigrams of each template have one (any words, where the long ones do not suffice).
    """
    open_, out = [], set()
    for _, grams in known:
        n = len(grams)
        open_.append([n - max(1, math.ceil(least * n * (1 + least / (2 - least)) / 2 - 1e-9)) + 1, set(grams)])
    for fewest in (6, 1):
        while any(need > 0 for need, _ in open_):
            gain = Counter()
            for need, grams in open_:
                if need > 0:
                    own = Counter([w for g in grams for w in set(g.split(" ")) if len(w) >= fewest])
                    gain.update({w: min(c, need) for w, c in own.items()})
            if not gain:
                break
            word = min(gain, key=lambda w: (-gain[w], w))
            out.add(word)
            for row in open_:
                hit = {g for g in row[1] if word in g.split(" ")}
                row[0] -= len(hit)
                row[1] -= hit
    return out


def _anchors(words: list[str]) -> dict[str, int]:
    """Bigrams that stand once in a template and their places: of each of ANCHORS stretches the one with the longest word."""
    pairs = [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]
    seen, out = Counter(pairs), {}
    step = max(1, -(-len(pairs) // ANCHORS))
    for at in range(0, len(pairs), step):
        once = [k for k in range(at, min(at + step, len(pairs))) if seen[pairs[k]] == 1]
        if once:
            k = max(once, key=lambda k: (max(map(len, pairs[k].split(" "))), -k))
            out[pairs[k]] = k
    return out


def _literals(values: list[str]) -> Column:
    """A literal array<string>, from one literal."""
    return F.split(F.lit("\t".join(values)), "\t")


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value computed once."""
    return F.transform(F.array(value), lambda x: f(x))[0]


def _windows(text: list[tuple[str, list[str]]], long: list[tuple[str, list[str], list[str]]], least: float) -> Column:
    """Windows (from the bigram s to e, both counted from 0) of _grams with a Dice of least or more: shared, dice, name, s, e, first and last line."""
    low, high = least / (2 - least), (2 - least) / least
    grams, lines, total = F.col("_grams"), F.col("_line"), F.size("_grams")

    def scored(s: Column, e: Column, name: str, own: Column, n: int) -> Column:
        def of(inside: Column) -> Column:
            return _let(F.size(F.array_intersect(inside, own)), lambda k: F.struct(k.alias("shared"), (2 * k / (F.size(inside) + n)).alias("dice"), F.lit(name).alias("name"), s.alias("s"), e.alias("e"), F.get(lines, s).alias("first"), F.get(lines, e + 1).alias("last")))

        return _let(F.array_distinct(F.slice(grams, s + 1, e - s + 1)), of)

    good = lambda w: w["dice"] >= least - 1e-12
    best = lambda ws: F.array_max(F.transform(ws, lambda w: F.struct(w["shared"].alias("shared"), w["dice"].alias("dice"), w.alias("w"))))["w"]
    out = []
    for name, own in text:
        n, list_ = len(own), _literals(own)
        fewest, most = math.ceil(n * low - 1e-9), math.floor(n * high + 1e-9)

        def every(hits: Column) -> Column:
            # The best window begins and ends with a bigram of the template: others only lengthen it.
            def ends(h: Column, i: Column) -> Column:
                to = F.filter(F.slice(hits, i + 1, most), lambda x: (x["k"] - h["k"] + 1).between(fewest, most))
                return best(F.filter(F.transform(to, lambda x: scored(h["k"], x["k"], name, list_, n)), good))

            return F.when(F.size(hits) >= fewest, F.filter(F.transform(hits, ends), lambda w: w.isNotNull()))

        out.append(_let(F.filter("_hits", lambda h: F.array_contains(list_, h["g"])), every))
    for name, own, words in long:
        n, list_, places = len(own), _literals(own), _anchors(words)
        anchors, place = _literals(list(places)), _literals([str(k) for k in places.values()]).cast("array<int>")
        starts = F.array_distinct(F.transform(F.filter("_hits", lambda h: F.array_contains(anchors, h["g"])), lambda h: F.greatest(F.lit(0), h["k"] - F.element_at(place, F.array_position(anchors, h["g"]).cast("int")))))
        length = len(words) - 1

        def at(found: Column) -> Column:
            tried = F.transform(found, lambda s: scored(s, F.least(s + length, total) - 1, name, list_, n))
            whole = F.when((F.size(found) > 0) & total.between(n * low, n * high), F.array(scored(F.lit(0), total - 1, name, list_, n)))
            return F.filter(F.concat(tried, F.coalesce(whole, F.slice(tried, 1, 0))), good)

        out.append(_let(starts, at))
    return F.flatten(F.filter(F.array(*out), lambda w: w.isNotNull()))


def scan(documents: DataFrame, templates: Mapping[str, str] | None = None, least: float = LEAST_DICE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, licence and dice of the best match, and all matched licences (sorted), with how many paragraphs and windows matched; by default against every_template()."""
    every = _template_grams(documents.sparkSession, every_template() if templates is None else templates)
    known, long = [(k, g) for k, g, _ in every if len(g) <= SHORT], [x for x in every if len(x[1]) > SHORT]
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    low, high = least / (2 - least), (2 - least) / least
    sizes = [len(g) for _, g in known]
    fewest, most = min(sizes, default=1) * low, max(sizes, default=0) * high
    needed = _any_of(needed_words(known, least))
    wanted = _any_of(needed_words(known, least) | gate_words([(k, g) for k, g, _ in long], least))
    nothing = F.array().cast("array<string>")

    def fits(g: Column) -> list[Column]:
        out = []
        for name, own in known:
            n = len(own)
            shared = F.size(F.array_intersect(g, F.array(*[F.lit(x) for x in own])))
            out.append(F.when(F.size(g).between(F.lit(n * low - 1e-9), F.lit(n * high + 1e-9)), _let(shared, lambda k: F.struct((-(2 * k / (F.size(g) + n))).alias("d"), F.lit(name).alias("name"), k.alias("shared")))))
        return out

    good = lambda g: F.array_sort(F.filter(F.array(*fits(g)), lambda m: m.isNotNull() & (m["d"] <= -least + 1e-12)))
    rows = documents.select(F.col(key).alias("doc_id"), body.alias("_body"))
    rows = rows.withColumn("_lines", F.when(F.lower("_body").rlike(wanted), F.split("_body", "\n")).otherwise(nothing))
    units = F.when(F.size("_lines") > 0, F.filter(F.array_distinct(F.concat("_lines", F.array("_body"))), lambda p: F.lower(p).rlike(needed))).otherwise(nothing)
    of = F.filter(F.transform(units, lambda p: F.struct(p.alias("p"), bigrams(normal_words(p)).alias("g"))), lambda u: F.size(u["g"]).between(int(fewest), int(most) + 1))
    matched = F.transform(of, lambda u: F.struct(u["p"].alias("p"), good(u["g"]).alias("m")))
    none = F.array().cast("array<struct<p:string,d:double,name:string,shared:int>>")
    unit = lambda u: F.struct(u["p"].alias("p"), u["m"][0]["d"].alias("d"), u["m"][0]["name"].alias("name"), u["m"][0]["shared"].alias("shared"))
    rows = rows.withColumn("_units", F.transform(F.filter(matched, lambda u: F.size(u["m"]) > 0), unit) if known else none)

    # Words with their lines, bigrams across line feeds, and the places of those that templates look for.
    rows = rows.withColumn("_words", F.flatten(F.transform("_lines", lambda p, j: F.transform(normal_words(p), lambda w: F.struct(w.alias("w"), j.alias("j"))))))
    pair = F.size("_words") - 1
    rows = rows.withColumn("_grams", F.when(pair > 0, F.zip_with(F.slice("_words", 1, F.greatest(pair, F.lit(0))), F.slice("_words", 2, F.greatest(pair, F.lit(0))), lambda a, b: F.concat_ws(" ", a["w"], b["w"]))).otherwise(nothing)).withColumn("_line", F.transform("_words", lambda w: w["j"]))
    looked = sorted({g for _, own in known for g in own} | {g for *_, w in long for g in _anchors(w)})
    rows = rows.withColumn("_hits", F.filter(F.transform("_grams", lambda g, k: F.when(g.isin(looked), F.struct(g.alias("g"), k.alias("k")))), lambda h: h.isNotNull()))
    some = F.array().cast("array<struct<shared:int,dice:double,name:string,s:int,e:int,first:int,last:int>>")
    rows = rows.withColumn("_windows", F.when(F.size("_hits") > 0, _windows(known, long, least)).otherwise(some) if every else some)

    # A paragraph keeps its place unless a window over it shares more; of windows that overlap, the one that shares most stays.
    whole = lambda u: (u["p"] == F.col("_body")) & (F.size("_lines") > 1)
    more = lambda w, u: (w["shared"] > u["shared"]) | (whole(u) & (w["shared"] == u["shared"]) & (w["dice"] > -u["d"]))
    over = lambda w, u: whole(u) | F.array_contains(F.slice("_lines", w["first"] + 1, w["last"] - w["first"] + 1), u["p"])
    left = F.filter("_windows", lambda w: ~F.exists("_units", lambda u: ~more(w, u) & over(w, u)))
    ranked = F.transform(left, lambda w: F.struct((-w["shared"]).alias("a"), (-w["dice"]).alias("b"), w["name"].alias("c"), w["s"].alias("d"), w.alias("w")))
    taken = F.aggregate(F.array_sort(ranked), some, lambda got, r: F.when(F.exists(got, lambda x: (x["s"] <= r["w"]["e"]) & (r["w"]["s"] <= x["e"])), got).otherwise(F.concat(got, F.array(r["w"]))))
    rows = rows.withColumn("_taken", F.when(F.size("_windows") > 0, taken).otherwise(some))
    free = lambda u: F.when(whole(u), ~F.exists("_taken", lambda w: more(w, u))).otherwise(
        F.exists(F.transform("_lines", lambda p, j: (p == u["p"]) & ~F.exists("_taken", lambda w: more(w, u) & j.between(w["first"], w["last"]))), lambda x: x)
    )
    named = lambda m, d: F.struct(d.alias("d"), m["name"].alias("name"))
    kept = F.when(F.size("_taken") > 0, F.filter("_units", free)).otherwise(F.col("_units"))
    rows = rows.withColumn("_found", F.array_sort(F.concat(F.transform(kept, lambda m: named(m, m["d"])), F.transform("_taken", lambda m: named(m, -m["dice"])))))
    return rows.select(
        "doc_id", F.get("_found", F.lit(0))["name"].alias("licence"), F.coalesce(-F.get("_found", F.lit(0))["d"], F.lit(0.0)).alias("dice"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("_found", lambda m: m["name"]))), ",").alias("licences"), F.size("_found").cast("long").alias("n_matches"),
    )


def op9_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def oracle() -> str:
    rows = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in TEMPLATES.items())
    words = lambda x: rf"list_filter(string_split_regex(regexp_replace(regexp_replace(lower({x}), '([^0-9]|^)\.', '\1 ', 'g'), '\.([^0-9]|$)|[^\p{{L}}\p{{N}}.]+', ' \1', 'g'), '[^\p{{L}}\p{{N}}.]+'), lambda w: w <> '')"
    grams = lambda w: f"list_distinct(CASE WHEN len({w}) = 1 THEN {w} ELSE list_transform(range(1, len({w})), lambda i: {w}[i] || ' ' || {w}[i + 1]) END)"
    return rf"""
WITH t AS (SELECT name, {grams("w")} AS g FROM (SELECT name, {words("body")} AS w FROM (VALUES {rows}) AS v(name, body))),
u AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(list_concat(string_split(coalesce(text, ''), chr(10)), [coalesce(text, '')])) AS p FROM documents)),
x AS (SELECT doc_id, p, {grams("w")} AS g FROM (SELECT doc_id, p, {words("p")} AS w FROM u)),
m AS (SELECT doc_id, p, name, 2 * len(list_intersect(x.g, t.g)) / (len(x.g) + len(t.g)) AS dice FROM x, t WHERE len(x.g) > 0),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, p ORDER BY dice DESC, name) AS k FROM m WHERE dice >= {LEAST_DICE} - 1e-12),
f AS (SELECT doc_id, first(name ORDER BY dice DESC, name) AS licence, max(dice) AS dice, string_agg(DISTINCT name, ',' ORDER BY name) AS licences, count(*) AS n_matches FROM b WHERE k = 1 GROUP BY doc_id)
SELECT doc_id, licence, coalesce(dice, 0.0) AS dice, coalesce(licences, '') AS licences, coalesce(n_matches, 0)::BIGINT AS n_matches FROM documents LEFT JOIN f USING (doc_id)
"""
