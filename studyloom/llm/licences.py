"""Licence recognition by sentence rules.

A text is cut into sentences; each is normalised and looked up among known licence sentences, which gives the text a sequence of
sentence identifiers. Licence rules are ordered: each names identifiers that must follow each other in that order (others may
stand between), and a rule takes all identifiers it matches, so that a later, more general rule cannot use them again.
Known sentences that no rule takes make the text an unknown licence.

All steps are column expressions inside one row: no shuffle, and only as much memory as the row itself.
"""
from pyspark.sql import functions as F

#: Identifier -> normalised sentences (fixed values: wording of public licences).
SENTENCES = {
    "apache2": ("licensed under the apache license version 2 0",),
    "apachewhere": ("you may obtain a copy of the license at",),
    "mit": ("released under the mit license", "licensed under the mit license", "this software is released under the mit license"),
    "mitgrant": ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software",),
    "mitnotice": ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",),
    "asis": ("the software is provided as is without warranty of any kind",),
    "gpl3": ("this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 3"),
    "gpl2": ("this work is licensed under the gnu general public license version 2", "licensed under the gnu general public license version 2"),
    "gpllater": ("or at your option any later version",),
    "lgpl3": ("licensed under the gnu lesser general public license version 3",),
    "bsdgrant": ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",),
    "bsdname": ("neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",),
    "ccby4": ("licensed under cc by 4 0", "licensed under the creative commons attribution 4 0 international license"),
    "ccbysa4": ("licensed under cc by sa 4 0",),
    "ccbync4": ("licensed under cc by nc 4 0",),
    "cc0": ("licensed under cc0 1 0", "released under cc0 1 0"),
    "mpl2": ("this source code form is subject to the terms of the mozilla public license v 2 0",),
    "reserved": ("all rights reserved",),
}
#: (licence, identifiers in order); the first rule that fits goes first.
RULES = (
    ("MIT", ("mitgrant", "mitnotice", "asis")),
    ("BSD-3-Clause", ("bsdgrant", "bsdname")),
    ("BSD-2-Clause", ("bsdgrant",)),
    ("Apache-2.0", ("apache2", "apachewhere")),
    ("Apache-2.0", ("apache2",)),
    ("GPL-3.0-or-later", ("gpl3", "gpllater")),
    ("GPL-2.0-or-later", ("gpl2", "gpllater")),
    ("GPL-3.0-only", ("gpl3",)),
    ("GPL-2.0-only", ("gpl2",)),
    ("LGPL-3.0-only", ("lgpl3",)),
    ("MIT", ("mit",)),
    ("CC-BY-4.0", ("ccby4",)),
    ("CC-BY-SA-4.0", ("ccbysa4",)),
    ("CC-BY-NC-4.0", ("ccbync4",)),
    ("CC0-1.0", ("cc0",)),
    ("MPL-2.0", ("mpl2",)),
    ("proprietary", ("reserved",)),
)
#: A sentence ends at a line end, or at ``.``, ``!``, ``?`` or ``;`` before white space or the end.
SENTENCE_END = r"\n|[.!?;]+(\s|$)"


def sequence(text, sentences=None):
    """Column: array of identifiers of the known sentences of a text, in order."""
    names = F.create_map(*[F.lit(x) for name, many in (sentences or SENTENCES).items() for s in many for x in (s, name)])
    plain = F.transform(F.split(text, SENTENCE_END), lambda s: F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " ")))
    known = F.filter(plain, lambda s: s.isin([s for many in (sentences or SENTENCES).values() for s in many]))
    return F.coalesce(F.transform(known, lambda s: names[s]), F.array().cast("array<string>"))


def matched(ids, rules=RULES):
    """Columns (licences, left): names of the licences in rule order, and the identifiers that no rule took.

    The sequence is a string of identifiers in angle brackets; a rule is a pattern over it, and taking is cutting.
    """
    left = F.concat_ws("", F.transform(ids, lambda i: F.concat(F.lit("<"), i, F.lit(">"))))
    found = []
    for name, need in rules:
        pattern = "(?s)" + "(.*?)".join(f"<{n}>" for n in need)
        kept = "".join(f"${i}" for i in range(1, len(need)))
        found.append(F.when(left.rlike(pattern), F.lit(name)))
        left = F.regexp_replace(left, pattern, kept)
    return F.array_distinct(F.array_compact(F.array(*found))), F.regexp_extract_all(left, F.lit("<([a-z0-9]+)>"), 1)


def scan(docs, id_col="doc_id", text_col="text", rules=RULES, sentences=None):
    """(doc_id, licences, sentences, unknown, verdict) for every row.

    licences: distinct names, comma-separated, in rule order; sentences: identifiers in text order; unknown: identifiers that no
    rule took; verdict: ``none``, ``unknown`` (known sentences, no licence), ``one`` or ``several``. NULL and empty texts: none.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), sequence(F.col(text_col), sentences).alias("ids"))
    names, left = matched(F.col("ids"), rules)
    out = rows.select("doc_id", "ids", F.when(F.size("ids") > 0, names).otherwise(F.array().cast("array<string>")).alias("l"), F.when(F.size("ids") > 0, left).otherwise(F.array().cast("array<string>")).alias("u"))
    verdict = F.when(F.size("l") > 1, "several").when(F.size("l") == 1, "one").when(F.size("u") > 0, "unknown").otherwise("none")
    return out.select("doc_id", F.concat_ws(",", "l").alias("licences"), F.concat_ws(",", "ids").alias("sentences"), F.concat_ws(",", "u").alias("unknown"), verdict.alias("verdict"))
