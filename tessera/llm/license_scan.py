"""License scans with ordered signature rules, in DataFrame functions only.

A rule is a keyword, a pattern over the text's words and a priority. The rules are the ways of stating a license in short
of ``license_rules``, one by one, and the written names below in each form of a statement, denials among them, and texts.
A denial suppresses what stands in it and gives no label. Texts without any keyword are passed over by one cheap test; in
the others each rule whose keyword occurs is matched everywhere. A detection that lies within one of a better rule (or
within a longer one of the same priority) is suppressed. The cost of a text with n detections is that of sorting them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.license_rules import stated
from tessera.llm.quality_rules import let

#: What is no part of a word, in lower-cased text and in any text; the base phrases and labels.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
NO_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

#: Licenses as their words (lower case, other characters as one blank): label, name, short identifier, keyword.
#: The keyword stands in every form of the name; forms without it have a row of their own, without an identifier.
NAMES = (
    ("agpl-3.0", "gnu affero general public license( version)? (v ?)?3( 0)?|gnu agpl ?v?3", "agpl 3 0", "gnu"),
    ("agpl", "gnu affero general public license|gnu agpl", "agpl", "gnu"),
    ("lgpl-2.1", "gnu lesser general public license( version)? (v ?)?2 1|gnu lgpl ?v?2 1", "lgpl 2 1", "gnu"),
    ("lgpl-3.0", "gnu lesser general public license( version)? (v ?)?3( 0)?|gnu lgpl ?v?3", "lgpl 3 0", "gnu"),
    ("lgpl", "gnu (lesser|library) general public license|gnu lgpl", "lgpl", "gnu"),
    ("gpl-2.0", "gnu general public license( version)? (v ?)?2( 0)?|gnu gpl ?v?2", "gpl 2 0", "gnu"),
    ("gpl-3.0", "gnu general public license( version)? (v ?)?3( 0)?|gnu gpl ?v?3", "gpl 3 0", "gnu"),
    ("gpl", "gnu general public license|gnu gpl", "gpl", "gnu"),
    ("gfdl", "gnu free documentation license", "gfdl", "gnu"),
    ("apache-2.0", "apache license( version)? (v ?)?2( 0)?|apache 2 0( license)?", "apache 2 0", "apache"),
    ("apache-1.1", "apache (software )?license( version)? (v ?)?1 1", "apache 1 1", "apache"),
    ("apache", "apache (software )?license", "apache", "apache"),
    ("mit", "mit license|mit x11 license", "mit", "mit"),
    ("mit", "expat license", "", "expat"),
    ("bsd-2-clause", "(simplified|2 clause|two clause|freebsd) bsd license|bsd 2 clause( license)?", "bsd 2 clause", "bsd"),
    ("bsd-3-clause", "(modified|new|revised|3 clause|three clause) bsd license|bsd 3 clause( license)?", "bsd 3 clause", "bsd"),
    ("bsd-4-clause", "(original|4 clause) bsd license|bsd 4 clause( license)?", "bsd 4 clause", "bsd"),
    ("bsd", "bsd license|bsd style license", "bsd", "bsd"),
    ("isc", "isc license", "isc", "isc"),
    ("zlib", "zlib license|zlib libpng license", "zlib", "zlib"),
    ("mpl-1.1", "mozilla public license( version)? (v ?)?1 1", "mpl 1 1", "mozilla"),
    ("mpl-2.0", "mozilla public license( version)? (v ?)?2( 0)?", "mpl 2 0", "mozilla"),
    ("mpl", "mozilla public license", "mpl", "mozilla"),
    ("epl-1.0", "eclipse public license( version)? (v ?)?1( 0)?", "epl 1 0", "eclipse"),
    ("epl-2.0", "eclipse public license( version)? (v ?)?2( 0)?", "epl 2 0", "eclipse"),
    ("eupl", "european union public licen[cs]e", "eupl 1 2", "european"),
    ("cddl", "common development and distribution license", "cddl 1 0", "common"),
    ("cpl-1.0", "common public license", "cpl 1 0", "common"),
    ("artistic-2.0", "artistic license( version)? (v ?)?2( 0)?", "artistic 2 0", "artistic"),
    ("artistic", "artistic license", "artistic 1 0", "artistic"),
    ("bsl-1.0", "boost software license", "bsl 1 0", "boost"),
    ("unlicense", "the unlicense|unlicense org", "unlicense", "unlicense"),
    ("wtfpl", "do what the fuck you want to public license", "wtfpl", "fuck"),
    ("wtfpl", "wtfpl", "", "wtfpl"),
    ("postgresql", "postgresql license", "postgresql", "postgresql"),
    ("psf-2.0", "python software foundation license", "psf 2 0", "python"),
    ("psf-2.0", "psf license", "", "psf"),
    ("openssl", "openssl license", "openssl", "openssl"),
    ("ofl-1.1", "sil open font license", "ofl 1 1", "font"),
    ("odbl-1.0", "open database license", "odbl 1 0", "database"),
    ("odc-by-1.0", "open data commons attribution license", "odc by 1 0", "commons"),
    ("cc0-1.0", "cc0", "cc0 1 0", "cc0"),
    ("cc0-1.0", "creative commons zero", "", "zero"),
    ("cc-by-nc-nd", "cc by nc nd( [0-9] 0)?", "cc by nc nd 4 0", "cc by nc nd"),
    ("cc-by-nc-nd", "creative commons attribution non ?commercial no ?derivatives", "", "commercial"),
    ("cc-by-nc-sa", "cc by nc sa( [0-9] 0)?", "cc by nc sa 4 0", "cc by nc sa"),
    ("cc-by-nc-sa", "creative commons attribution non ?commercial share ?alike", "", "commercial"),
    ("cc-by-nc", "cc by nc( [0-9] 0)?", "cc by nc 4 0", "cc by nc"),
    ("cc-by-nc", "creative commons attribution non ?commercial", "", "commercial"),
    ("cc-by-sa", "cc by sa( [0-9] 0)?", "cc by sa 4 0", "cc by sa"),
    ("cc-by-sa", "creative commons attribution share ?alike", "", "alike"),
    ("cc-by-nd", "cc by nd( [0-9] 0)?", "cc by nd 4 0", "cc by nd"),
    ("cc-by-nd", "creative commons attribution no ?derivatives", "", "derivatives"),
    ("cc-by", "cc by( [0-9] 0)?", "cc by 4 0", "cc by"),
    ("cc-by", "creative commons attribution", "", "creative"),
    ("public-domain", "(dedicated to|released into) the public domain", "public domain", "domain"),
    ("proprietary", "all rights reserved", "licenseref proprietary", "reserved"),
    ("proprietary", "proprietary and confidential", "", "confidential"),
)
#: How a license is stated, best first: priority, weight, pattern around the name or the short identifier.
FORMS = (
    (0, 0.0, "(not|never|no longer) (being )?(re)?(licensed|released|distributed|available) under (the )?(terms of )?(the )?({name})"),
    (1, 1.0, "spdx license identifier {short}"),
    (2, 0.95, "(is |are )?(re)?licensed under (the )?(terms of )?(the )?({name})"),
    (2, 0.95, "(is |are )?released under (the )?(terms of )?(the )?({name})"),
    (2, 0.95, "(is |are )?(re)?distributed under (the )?(terms of )?(the )?({name})"),
    (2, 0.95, "(is |are )?(made )?available under (the )?(terms of )?(the )?({name})"),
    (3, 0.8, "(see|read) the ({name})( for (more )?details)?"),
    (4, 0.6, "({name})"),
)
#: Fixed phrases of license texts: label, pattern, keyword.
TEXTS = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", "hereby"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", "distribute"),
    ("gpl", "under the terms of the gnu general public license as published by the free software foundation", "gnu"),
    ("apache-2.0", "www apache org licenses license 2 0", "apache"),
    ("gpl", "www gnu org licenses gpl", "gnu"),
    ("cc-by", "creativecommons org licenses by [0-9] 0", "creativecommons"),
    ("cc-by-sa", "creativecommons org licenses by sa [0-9] 0", "creativecommons"),
    ("cc-by-nc", "creativecommons org licenses by nc [0-9] 0", "creativecommons"),
    ("cc0-1.0", "creativecommons org publicdomain zero 1 0", "creativecommons"),
)
#: A text that holds none of these in lower case has no detection and, but for "cc by", no base phrase.
ANY = ("licen", "copyright", "spdx", "rights", "confidential", "creative", "public", "redistribution", "permission", "cc0", "wtfpl", "gpl", "apache", "bsd")
#: What else hints at a statement: a short name behind "under", or one with a version, where the short name alone is in many words.
UNDER = r"under[^a-z0-9]+(?:(?:the|terms|of)[^a-z0-9]+)*(?:mit|mpl|isc|epl|cddl|zlib|sspl|gfdl|same)\b"
VERSIONED = {"mpl": r"\bmplv?[^a-z0-9]*v?[0-9]", "epl": r"\bepl[^a-z0-9]*v?[0-9]", "asl": r"\basl[^a-z0-9]+2", "bsl": r"\bbsl[^a-z0-9]+1", "ofl": r"\bofl[^a-z0-9]+1", "mit": r"\bmit[^a-z0-9]+or[^a-z0-9]+apache", "openrail": "openrail", "noninfringement": "noninfringement", "endorse": r"endorse[^a-z0-9]+or", "acknowledgement": r"following[^a-z0-9]+acknowledgement", "versions must be plainly": "altered"}
#: Above any start of a detection in a text.
START = (1 << 31) - 1
CC_BY = r"cc[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+(b|B)"


def rules() -> list[tuple[str, int, float, str, str]]:
    """All rules in order: label, priority, weight, keyword, pattern over blank-separated words."""
    made = [(label, 2, 0.9, keyword, pattern) for label, pattern, keyword in TEXTS] + stated()
    for priority, weight, form in FORMS:
        for label, name, short, keyword in NAMES:
            if "spdx" in form and not short:
                continue
            made.append((label if weight else "", priority, weight, "spdx" if "spdx" in form else keyword, form.format(name=name, short=short)))
    return sorted(made, key=lambda r: r[1])


def _rule_array() -> Column:
    return F.array(*(F.struct(F.lit(label).alias("label"), F.lit(p).alias("priority"), F.lit(w).alias("weight"), F.lit(k).alias("keyword"), F.lit(f"(?<= )(?:{rx})(?= )").alias("pattern")) for label, p, w, k, rx in rules()))


def scan(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """For each place of an array the combination of all values up to it, in as many passes as its size has binary digits."""
    steps = F.when(F.size(values) > 1, F.sequence(F.lit(0), F.floor(F.log2(F.size(values) - 1)).cast("int"))).otherwise(F.expr("cast(array() as array<int>)"))

    def further(sums: Column, k: Column) -> Column:
        reach = F.call_function("shiftleft", F.lit(1), k)
        return F.transform(sums, lambda x, i: F.when(i >= reach, combine(x, F.get(sums, i - reach))).otherwise(x))

    return F.aggregate(steps, values, further)


def _places(norm: Column, rule: Column) -> Column:
    """Every match of a rule in the padded words: s, less (minus e), priority, label, weight."""

    def walk(matches: Column) -> Column:
        sizes = let(F.split(norm, rule["pattern"], -1), lambda pieces: F.transform(matches, lambda m, i: F.length(F.get(pieces, i)) + F.length(m)))
        ends = let(sizes, lambda n: scan(n, lambda x, y: x + y))
        return let(ends, lambda e: F.transform(matches, lambda m, i: F.struct((F.get(e, i) - F.length(m)).alias("s"), (-F.get(e, i)).alias("less"), rule["priority"].alias("priority"), rule["label"].alias("label"), rule["weight"].alias("weight"))))

    return let(F.regexp_extract_all(norm, rule["pattern"], F.lit(0)), walk)


def _unsuppressed(found: Column) -> Column:
    """Of sorted detections those that no better one contains.

    What contains a detection comes before it in the order. A running maximum for each priority holds the furthest end
    so far and, of equal ones, the earliest start: one number, with the end above and what is left of START below.
    """
    reach = lambda d: -d["less"].cast("long") * (START + 1) + START - d["s"]
    priorities = sorted({r[1] for r in rules()})

    def furthest(priority: int) -> Column:
        own = F.transform(found, lambda d: F.when(d["priority"] == priority, reach(d)).otherwise(F.lit(-1).cast("long")))
        return let(own, lambda x: scan(x, F.greatest))

    def alive(all_of: Column) -> Column:
        def free(d: Column, i: Column) -> Column:
            out = F.lit(True)
            for k, p in enumerate(priorities):
                before = F.coalesce(F.get(all_of[k], i - 1), F.lit(-1).cast("long"))
                better = F.when(d["priority"] > p, before >= -d["less"].cast("long") * (START + 1)).when(d["priority"] == p, before > reach(d)).otherwise(False)
                out = out & ~better
            return out

        return F.filter(found, free)

    return let(F.array(*map(furthest, priorities)), alive)


def detections(norm: Column) -> Column:
    """The detections in padded words that no better one contains, by their start."""
    live = F.filter(_rule_array(), lambda r: F.contains(norm, r["keyword"]))
    found = F.sort_array(F.flatten(F.transform(live, lambda r: _places(norm, r))))
    once = let(found, lambda every: F.filter(every, lambda d, i: (i == 0) | (F.get(every, i - 1) != d)))
    return F.transform(let(once, _unsuppressed), lambda d: F.struct(d["label"].alias("label"), d["priority"].alias("priority"), d["weight"].alias("weight"), d["s"].alias("s"), (-d["less"]).alias("e")))


def _base_places(words: Column) -> Column:
    """label and first word of each place where a base phrase's words stand consecutively."""

    def at(phrase: str, label: str) -> Column:
        parts = phrase.split(" ")

        def here(i: Column) -> Column:
            same = F.get(words, i) == parts[0]
            for k, p in enumerate(parts[1:], 1):
                same = same & F.coalesce(F.get(words, i + k) == p, F.lit(False))
            return same

        return F.transform(F.filter(F.sequence(F.lit(0), F.size(words) - 1), here), lambda i: F.struct(F.lit(label).alias("label"), i.cast("long").alias("at")))

    return F.when(F.size(words) > 0, F.concat(*(at(p, label) for p, label in BASE))).otherwise(F.expr("cast(array() as array<struct<label:string,at:bigint>>)"))


def license_scan(docs: DataFrame) -> DataFrame:
    """License statements of every whole text.

    Returns doc_id, n_words, n_base, first_word, last_word (null without a base place), base_labels, labels (distinct,
    sorted, comma-joined; the rules' and the base phrases'), score (0 to 1: the best surviving detection's weight,
    at least 0.6 with a base phrase unless a license is denied) and detections (array of label, priority, weight, s, e: places among the
    blank-joined words). A null or empty text has no words and no labels. Repeated rows each give a row; other
    columns are not carried. One projection without a shuffle or a join.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    words = let(F.split(text, NO_WORD), lambda w: F.size(w) - F.when(w[0] == "", 1).otherwise(0) - F.when((F.size(w) > 1) & (F.element_at(w, -1) == ""), 1).otherwise(0))
    lower = F.lower(text)
    hint = lower.contains(ANY[0])
    for word in ANY[1:]:
        hint = hint | lower.contains(word)
    hint = hint | lower.contains("cc") & lower.rlike(CC_BY) | lower.contains("under") & lower.rlike(UNDER)
    for word, pattern in VERSIONED.items():
        hint = hint | lower.contains(word) & lower.rlike(pattern)
    some = docs.select("doc_id", words.cast("long").alias("n_words"), F.when(hint, text).alias("t"))
    norm = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.translate("t", UPPER, LOWER), GAP, " ")), F.lit(" "))
    nothing = F.expr("cast(array() as array<struct<label:string,at:bigint>>)")
    none = F.expr("cast(array() as array<struct<label:string,priority:int,weight:double,s:int,e:int>>)")
    both = some.select(
        "doc_id",
        "n_words",
        F.when(F.col("t").isNull(), F.struct(nothing.alias("base"), none.alias("found")))
        .otherwise(let(norm, lambda n: F.struct(let(F.filter(F.split(F.trim(n), " "), lambda w: w != ""), _base_places).alias("base"), detections(n).alias("found"))))
        .alias("both"),
    ).select("doc_id", "n_words", F.col("both.base").alias("base"), F.col("both.found").alias("detections"))
    base, found = F.col("base"), F.col("detections")
    names = F.array_distinct(F.transform(base, lambda x: x["label"]))
    stated_labels = F.filter(F.transform(found, lambda x: x["label"]), lambda x: x != "")
    denied = F.exists(found, lambda x: x["label"] == "")
    return both.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda x: x["at"])).alias("first_word"),
        F.array_max(F.transform(base, lambda x: x["at"])).alias("last_word"),
        F.array_join(F.array_sort(names), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(names, stated_labels)), ",").alias("labels"),
        F.greatest(F.when((F.size(base) > 0) & ~denied, 0.6).otherwise(0.0), F.coalesce(F.array_max(F.transform(found, lambda x: x["weight"])), F.lit(0.0))).alias("score"),
        "detections",
    )
