"""License scans by ordered signature rules (op9), in DataFrame functions only.

A text that holds none of a few phrases is done after one regex.  Every phrasing
and notice names the one it cannot do without, and the regex is made of these.
The words of the other texts are written out with single blanks, and each rule
whose own keyword begins one of them is matched.  Rules are ordered by priority;
a detection goes if another one contains it, or overlaps it with a better
priority.  Detections are sorted by their start and meet in blocks of ``BLOCK``:
only blocks whose places overlap are compared, so a list of thousands of
licenses costs little more than its length.

The rules come from a table of licenses and a table of phrasings: every license
name in every phrasing, several hundred rules in all.  A few base phrases are
looked up apart, word by word, and are never suppressed.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z in lower
case; places are word numbers from 0.

Defined cases: a null or wordless text has no words, no places (null first and
last word), empty labels and score 0.  Repeated rows get equal results.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANY_CASE_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]++"
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

# Base phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Label, keyword that begins a word of every match, name as it stands in normalised words.
LICENSES = [
    ("0bsd", "0bsd", "0bsd"),
    ("afl-3", "academic", "academic free(?: license)?(?: version)? 3"),
    ("agpl-3", "affero", "(?:gnu )?affero general public license(?: version)?(?: v?3)?"),
    ("agpl-3", "agpl", "agpl ?v?(?: ?3(?: 0)?)?"),
    ("apache-1.1", "apache", "apache(?: software)?(?: license)?(?: version)? 1 1"),
    ("apache-2", "apache", "apache(?: software)?(?: license)?(?: version)? 2(?: 0)?"),
    ("artistic-2", "artistic", "artistic(?: license)?(?: version)? 2(?: 0)?"),
    ("beerware", "beerware", "beerware"),
    ("bsd-2-clause", "bsd", "(?:bsd 2 clause|2 clause bsd|simplified bsd)"),
    ("bsd-2-clause", "freebsd", "freebsd"),
    ("bsd-3-clause", "bsd", "(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)"),
    ("bsd-4-clause", "bsd", "(?:bsd 4 clause|4 clause bsd|original bsd)"),
    ("bsl-1", "boost", "boost(?: software)?(?: license)?(?: version)?(?: 1(?: 0)?)?"),
    ("busl-1.1", "business", "business source(?: license)?(?: version)?(?: 1 1)?"),
    ("cc-by-nc-nd", "cc", "cc by nc nd(?: [1-4](?: [05])?)?"),
    ("cc-by-nc-sa", "cc", "cc by nc sa(?: [1-4](?: [05])?)?"),
    ("cc-by-nc", "cc", "cc by nc(?: [1-4](?: [05])?)?"),
    ("cc-by-nd", "cc", "cc by nd(?: [1-4](?: [05])?)?"),
    ("cc-by-sa", "cc", "cc by sa(?: [1-4](?: [05])?)?"),
    ("cc-by", "cc", "cc by(?: [1-4](?: [05])?)?"),
    ("cc-by", "creative", "creative commons attribution(?: [1-4](?: [05])?)?"),
    ("cc-by-sa", "creative", "creative commons attribution share ?alike(?: [1-4](?: [05])?)?"),
    ("cc-by-nc", "creative", "creative commons attribution non ?commercial(?: [1-4](?: [05])?)?"),
    ("cc0-1", "cc0", "cc0(?: 1(?: 0)?)?"),
    ("cddl-1", "cddl", "cddl(?: 1(?: [01])?)?"),
    ("cddl-1", "distribution", "common development and distribution license(?: version)?(?: 1(?: [01])?)?"),
    ("cecill-2.1", "cecill", "cecill(?: 2(?: 1)?)?"),
    ("cpl-1", "common", "common public license(?: version)?(?: 1(?: 0)?)?"),
    ("ecl-2", "educational", "educational community license(?: version)?(?: 2(?: 0)?)?"),
    ("elastic-2", "elastic", "elastic license(?: version)?(?: 2(?: 0)?)?"),
    ("epl-1", "eclipse", "eclipse public license(?: version)?(?: v)? 1(?: 0)?"),
    ("epl-2", "eclipse", "eclipse public license(?: version)?(?: v)? 2(?: 0)?"),
    ("eupl-1.2", "eupl", "eupl(?: v)?(?: 1 2)?"),
    ("gfdl-1", "documentation", "(?:gnu )?free documentation license(?: version)?(?: 1(?: [1-3])?)?"),
    ("gpl-2", "gpl", "(?:gnu )?gpl ?(?:version )?v? ?2(?: 0)?"),
    ("gpl-2", "general", "(?:gnu )?general public license(?: version)?(?: v)? ?2(?: 0)?"),
    ("gpl-2", "gplv2", "(?:gnu )?gplv2"),
    ("gpl-3", "gpl", "(?:gnu )?gpl ?(?:version )?v? ?3(?: 0)?"),
    ("gpl-3", "general", "(?:gnu )?general public license(?: version)?(?: v)? ?3(?: 0)?"),
    ("gpl-3", "gplv3", "(?:gnu )?gplv3"),
    ("gpl", "general", "(?:gnu )?general public license"),
    ("isc", "isc", "isc"),
    ("lgpl-2.1", "lesser", "(?:gnu )?lesser general public license(?: version)? 2(?: 1)?"),
    ("lgpl-3", "lesser", "(?:gnu )?lesser general public license(?: version)? 3(?: 0)?"),
    ("lgpl", "lgpl", "(?:gnu )?lgpl(?: v?[23](?: [01])?)?"),
    ("lppl-1.3", "latex", "latex project public license(?: version)?(?: 1(?: 3c?)?)?"),
    ("mit", "mit", "(?:mit|mit x11)"),
    ("mit", "expat", "expat"),
    ("mpl-1.1", "mozilla", "mozilla public license(?: version)? 1 1"),
    ("mpl-2", "mozilla", "mozilla public license(?: version)?(?: 2(?: 0)?)?"),
    ("mpl-2", "mpl", "mpl ?2(?: 0)?"),
    ("ms-pl", "microsoft", "microsoft public license"),
    ("ms-rl", "microsoft", "microsoft reciprocal license"),
    ("mulan-2", "mulan", "mulan(?: psl)?(?: v)?(?: 2)?"),
    ("ncsa", "ncsa", "(?:university of illinois )?ncsa(?: open source)?"),
    ("odbl-1", "odbl", "odbl(?: 1(?: 0)?)?"),
    ("ofl-1.1", "ofl", "(?:sil )?ofl(?: 1 1)?"),
    ("ofl-1.1", "font", "(?:sil )?open font license(?: version)?(?: 1 1)?"),
    ("osl-3", "open", "open software license(?: version)?(?: 3(?: 0)?)?"),
    ("php-3", "php", "php license(?: version)?(?: 3(?: 0[01]?)?)?"),
    ("postgresql", "postgresql", "postgresql"),
    ("psf-2", "python", "python software foundation(?: license)?(?: version)?(?: 2)?"),
    ("sspl-1", "server", "server side public license(?: version)?(?: 1)?"),
    ("unlicense", "unlicense", "unlicense"),
    ("upl-1", "universal", "universal permissive license(?: version)?(?: 1(?: 0)?)?"),
    ("w3c", "w3c", "w3c(?: software notice and)?"),
    ("wtfpl", "wtfpl", "wtfpl"),
    ("zlib", "zlib", "zlib(?: libpng)?"),
    ("zpl-2.1", "zope", "zope public license(?: version)?(?: 2(?: 1)?)?"),
]

# Priority (smaller is better), score, words that every match holds, phrasing.
PHRASINGS = [
    (1, 1.0, "licen[cs]", "spdx license identifier {name}"),
    (2, 0.95, "licen[cs]", "licen[cs]ed under (?:the )?(?:terms of (?:the )?)?{name}(?: licen[cs]e)?"),
    (2, 0.95, "(?:released|distributed|published|provided|available) under", "(?:released|distributed|published|provided|available) under (?:the )?(?:terms of (?:the )?)?{name}(?: licen[cs]e)?"),
    (3, 0.9, "licen[cs]", "(?:opensource org|choosealicense com) licen[cs]es {name}"),
    (4, 0.85, "licen[cs]", "under (?:the )?(?:terms of (?:the )?)?{name} licen[cs]e"),
    (5, 0.7, "licen[cs]", "{name} licen[cs]es?"),
]

# Notices that name no license of the table: label, keyword, priority, score, words that every match holds, words.
NOTICES = [
    ("all-rights-reserved", "reserved", 6, 0.6, "all rights", "all rights reserved"),
    ("public-domain", "domain", 4, 0.8, "public domain", "(?:released into|dedicated to|placed in|in) the public domain"),
    ("proprietary", "proprietary", 5, 0.7, "proprietary", "proprietary (?:and confidential|licen[cs]e|software)"),
    ("copyright", "copyright", 7, 0.4, "copyright", "copyright(?: c)? (?:19|20)[0-9]{2}"),
    ("gpl-3", "general", 1, 0.95, "licen[cs]", "licen[cs]ed under the (?:gnu )?general public license version 3"),
    ("gpl-2", "general", 1, 0.95, "licen[cs]", "licen[cs]ed under the (?:gnu )?general public license version 2"),
    ("mit", "permission", 1, 1.0, "permission (?:is|to)", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("isc", "permission", 1, 1.0, "permission (?:is|to)", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "redistribution", 1, 1.0, "redistribution and", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("apache-2", "contributor", 1, 1.0, "licen[cs]", "licen[cs]ed to the apache software foundation (?:asf )?under one or more contributor license agreements"),
    ("gpl", "free", 1, 1.0, "free software", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "free", 1, 1.0, "free software", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("agpl-3", "affero", 1, 1.0, "affero", "it under the terms of the gnu affero general public license"),
    ("mpl-2", "mozilla", 1, 1.0, "source code form", "this source code form is subject to the terms of the mozilla public license(?: version| v)? 2(?: 0)?"),
    ("epl-1", "eclipse", 1, 1.0, "accompanying materials", "the accompanying materials are made available under the terms of the eclipse public license(?: version| v)? 1(?: 0)?"),
    ("epl-2", "eclipse", 1, 1.0, "accompanying materials", "the accompanying materials are made available under the terms of the eclipse public license(?: version| v)? 2(?: 0)?"),
    ("bsl-1", "organization", 1, 1.0, "permission (?:is|to)", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software"),
    ("unlicense", "unencumbered", 1, 1.0, "unencumbered software", "this is free and unencumbered software released into the public domain"),
    ("ofl-1.1", "font", 1, 1.0, "font software", "this font software is licensed under the sil open font license(?: version)? 1 1"),
]


def rules() -> list[dict]:
    """Every license in every phrasing, then the notices; the regex stands between blanks."""
    out = [
        {"label": label, "keyword": keyword, "priority": priority, "score": score, "regex": phrase.replace("{name}", name)}
        for priority, score, _, phrase in PHRASINGS
        for label, keyword, name in LICENSES
    ]
    out += [
        {"label": label, "keyword": keyword, "priority": priority, "score": score, "regex": words} for label, keyword, priority, score, _, words in NOTICES
    ]
    return [r | {"regex": f"(?<= ){r['regex']}(?= )"} for r in out]


def _gate() -> str:
    """A regex for raw texts: what every phrasing, notice and base phrase cannot do without."""
    needed = dict.fromkeys([p[2] for p in PHRASINGS] + [n[4] for n in NOTICES] + [b for b in BASE if "license" not in b])
    return "(?i)" + "|".join(words.replace(" ", GAP) for words in needed)


GATE = _gate()
BLOCK = 128
RULE_TYPE = "array<struct<label:string,keyword:string,priority:int,score:double,regex:string>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def _n_words(piece: Column) -> Column:
    return F.size(F.filter(F.split(piece, F.lit(" ")), lambda w: w != ""))


def _blocks(values: Column) -> Column:
    """``values``, not empty, in runs of ``BLOCK``."""
    last = F.floor((F.size(values) - 1) / BLOCK).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(values, k * BLOCK + 1, BLOCK))


def _running(values: Column) -> Column:
    """Sums of ``values``, not empty, up to each of them: inside blocks, then over blocks."""
    kind = "struct<total:int,out:array<int>>"

    def sums(block: Column) -> Column:
        def step(state: Column, x: Column) -> Column:
            total = state["total"] + x
            return F.struct(total.alias("total"), F.concat(state["out"], F.array(total)).alias("out")).cast(kind)

        return F.aggregate(block, F.struct(F.lit(0).alias("total"), F.array().alias("out")).cast(kind), step, lambda s: s["out"])

    def joined(inside: Column) -> Column:
        before = sums(F.transform(inside, lambda b: F.element_at(b, -1)))
        shifted = lambda b, at: F.transform(b["own"], lambda x: x + F.when(b["k"] == 0, 0).otherwise(F.get(at, b["k"] - 1)))
        numbered = F.transform(inside, lambda b, k: F.struct(b.alias("own"), k.alias("k")))
        return _let(before, lambda at: F.flatten(F.transform(numbered, lambda b: shifted(b, at))))

    return _let(F.transform(_blocks(values), sums), joined)


def _occurrences(normal: Column, rule: Column) -> Column:
    """array<struct<start, stop, priority, score, label>> of a rule's matches, in word numbers."""
    kind = "array<struct<start:int,stop:int,priority:int,score:double,label:string>>"

    def place(matches: Column, gaps: Column) -> Column:
        lengths = F.transform(matches, _n_words)
        between = F.transform(F.slice(gaps, 1, F.size(matches)), _n_words)

        def hits(length: Column, stop: Column, gap: Column) -> Column:
            def one(n: Column, k: Column) -> Column:
                end = F.get(stop, k) + F.get(gap, k)
                return F.struct(
                    (end - n).alias("start"), end.alias("stop"), rule["priority"].alias("priority"), rule["score"].alias("score"), rule["label"].alias("label")
                )

            return F.transform(length, one).cast(kind)

        return _let(lengths, lambda n: _let(_running(n), lambda stop: _let(_running(between), lambda gap: hits(n, stop, gap))))

    return _let(
        F.regexp_extract_all(normal, rule["regex"], F.lit(0)),
        lambda m: F.when(F.size(m) == 0, F.array().cast(kind)).otherwise(_let(F.split(normal, rule["regex"], -1), lambda gaps: place(m, gaps))),
    )


def _base_places(words: Column) -> Column:
    """array<struct<start, label>>: every place where a base phrase's words stand one after another."""

    def places(phrase: list[str], label: str) -> Column:
        def here(i: Column) -> Column:
            match = F.get(words, i) == phrase[0]
            for k, word in enumerate(phrase[1:], 1):
                match = match & (F.get(words, i + k) == word)
            return match

        found = F.filter(F.sequence(F.lit(0), F.size(words) - 1), here)
        return F.transform(found, lambda i: F.struct(i.alias("start"), F.lit(label).alias("label")))

    return F.concat(*[places(phrase.split(), label) for phrase, label in BASE.items()])


def _suppressed(found: Column) -> Column:
    """Detections, by start, that no other one contains, or overlaps with a better priority."""

    def beaten(h: Column, near: Column) -> Column:
        def beats(g: Column) -> Column:
            contains = (g["start"] <= h["start"]) & (g["stop"] >= h["stop"]) & (g["stop"] - g["start"] > h["stop"] - h["start"])
            overlaps = (g["start"] < h["stop"]) & (h["start"] < g["stop"])
            within = (h["start"] <= g["start"]) & (h["stop"] >= g["stop"]) & (h["stop"] - h["start"] > g["stop"] - g["start"])
            return contains | (overlaps & ~within & (g["priority"] < h["priority"]))

        return F.exists(near, beats)

    def spanned(rows: Column) -> Column:
        return F.struct(rows.alias("rows"), F.get(rows["start"], 0).alias("low"), F.array_max(rows["stop"]).alias("end"))

    def left(blocks: Column) -> Column:
        def of_block(b: Column) -> Column:
            touching = F.filter(blocks, lambda other: (other["low"] < b["end"]) & (b["low"] < other["end"]))
            near = F.flatten(F.transform(touching, lambda other: other["rows"]))
            return _let(near, lambda rows: F.filter(b["rows"], lambda h: ~beaten(h, rows)))

        return F.flatten(F.transform(blocks, of_block))

    by_start = _let(F.sort_array(found), lambda rows: _let(F.transform(_blocks(rows), spanned), left))
    return F.when(F.size(found) == 0, found).otherwise(by_start)


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections) per row."""
    text = F.coalesce("text", F.lit(""))
    table = F.from_json(F.lit(json.dumps(rules())), RULE_TYPE)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = F.regexp_extract_all(F.translate("text", upper, lower), F.lit(WORD), F.lit(0))
    gated = docs.select("doc_id", text.alias("text")).withColumn("words", F.when(F.col("text").rlike(GATE), words))
    met = gated.withColumn("words", F.when(F.size("words") > 0, F.col("words")))

    def detections(normal: Column) -> Column:
        likely = F.filter(table, lambda r: F.contains(normal, F.concat(F.lit(" "), r["keyword"])))
        return _let(F.flatten(F.transform(likely, lambda r: _occurrences(normal, r))), _suppressed)

    found = met.select(
        "doc_id",
        F.regexp_count("text", F.lit(ANY_CASE_WORD)).cast("bigint").alias("n_words"),
        F.when(F.col("words").isNotNull(), _base_places(F.col("words"))).alias("base"),
        F.when(F.col("words").isNotNull(), _let(F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" ")), detections)).alias("detections"),
    )
    starts, labels = F.col("base.start"), lambda c: F.coalesce(F.col(f"{c}.label"), F.array().cast("array<string>"))
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    best = F.greatest(F.coalesce(F.array_max("detections.score"), F.lit(0.0)), F.when(F.size("base") > 0, 0.9).otherwise(0.0))
    return found.select(
        "doc_id",
        "n_words",
        F.coalesce(F.when(F.col("base").isNotNull(), F.size("base")), F.lit(0)).cast("bigint").alias("n_base"),
        F.array_min(starts).cast("bigint").alias("first_word"),
        F.array_max(starts).cast("bigint").alias("last_word"),
        joined(labels("base")).alias("base_labels"),
        joined(F.concat(labels("base"), labels("detections"))).alias("labels"),
        best.alias("score"),
        "detections",
    )
