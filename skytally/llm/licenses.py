"""Licence scans by sentence rules; DataFrame functions throughout.

A text is cut into fragments at line ends, paragraph ends and sentence ends, without comment marks at the beginnings of lines, and
each is normalised. A sentence may begin with any fragment and goes on over line ends to the end of its sentence or paragraph, or
is the fragment alone (titles have no full stop). A fixed table maps normalised sentences to licence-sentence identifiers; sentences
with a variable part (years, holders) are mapped by their fixed beginning. Only fragments that begin with the first two words of a
sentence of the table are looked up, which loses none. A licence rule is a sequence of identifiers that must occur in this order,
with other licence sentences between allowed only where the rule says so; of the rules that match, longer ones take their
identifiers before shorter ones are tried. A rule for what is left counts only where no other one matches.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skytally.llm.common import blank_null


@dataclass(frozen=True)
class Sentence:
    """``text`` as it stands in licences; with ``prefix`` only the sentence's beginning must be like it."""

    id: str
    text: str
    prefix: bool = False


@dataclass(frozen=True)
class Rule:
    """``ids`` in order name ``licence``; ``gap`` more licence sentences at most may stand between two of them.

    With ``alone`` the rule counts only where no rule without it matches.
    """

    licence: str
    ids: tuple[str, ...]
    gap: int = 0
    alone: bool = False


# Published notices of well-known licences, sentence by sentence.
SENTENCES = (
    Sentence("mit-name", "Released under the MIT License."),
    Sentence("mit-name", "Licensed under the MIT License."),
    Sentence("mit-name", "MIT License"),
    Sentence("mit-name", "The MIT License (MIT)"),
    Sentence("mit-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", prefix=True),
    Sentence("mit-notice", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    Sentence("mit-notice", "The above copyright notice and this permission notice (including the next paragraph) shall be included in all copies or substantial portions of the Software."),
    Sentence("as-is", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND', prefix=True),
    Sentence("apache2-name", "Licensed under the Apache License, Version 2.0."),
    Sentence("apache2-name", 'Licensed under the Apache License, Version 2.0 (the "License")', prefix=True),
    Sentence("apache2-title", "Apache License Version 2.0, January 2004", prefix=True),
    Sentence("apache2-copy", "You may obtain a copy of the License at", prefix=True),
    Sentence("apache2-as-is", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS', prefix=True),
    Sentence("gpl3-name", "This work is licensed under the GNU General Public License, version 3."),
    Sentence("gpl3-name", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", prefix=True),
    Sentence("gpl2-name", "This work is licensed under the GNU General Public License, version 2."),
    Sentence("gpl2-name", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991", prefix=True),
    Sentence("lgpl3-name", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007", prefix=True),
    Sentence("lgpl21-name", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999", prefix=True),
    Sentence("agpl3-name", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007", prefix=True),
    Sentence("gpl3-free", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3", prefix=True),
    Sentence("gpl2-free", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2", prefix=True),
    *(
        Sentence(f"{family}{version.replace('.', '')}-free", f"This {thing} is free software; you can redistribute it and/or modify it under the terms of {text}", prefix=True)
        for family, title, things, versions in (
            ("gpl", "GNU General Public License", ("program", "file", "software"), ("2", "3")), ("lgpl", "GNU Lesser General Public License", ("library", "program", "file"), ("2", "2.1", "3")),
            ("lgpl", "GNU Library General Public License", ("library",), ("2",)), ("agpl", "GNU Affero General Public License", ("program", "software"), ("3",)),
        )
        for thing in things
        for version in versions
        for text in (
            f"the {title} as published by the Free Software Foundation; either version {version}", f"the {title} version {version}", f"the {title} v{version}",
            f"version {version} of the {title}", f"the {title} as published by the Free Software Foundation; version {version}",
        )
    ),
    Sentence("gpl-free", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License", prefix=True),
    Sentence("lgpl-free", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License", prefix=True),
    Sentence("agpl-free", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License", prefix=True),
    Sentence("gpl-hope", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY", prefix=True),
    Sentence("lgpl-hope", "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY", prefix=True),
    Sentence("cc-by-nc-4-name", "Licensed under CC BY-NC 4.0."),
    Sentence("cc-by-4-name", "Licensed under CC BY 4.0."),
    Sentence("cc-by-sa-4-name", "Licensed under CC BY-SA 4.0."),
    Sentence("cc-by-4-name", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    Sentence("cc-by-sa-4-name", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    Sentence("cc-by-nc-4-name", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    Sentence("cc0-name", "Released under CC0 1.0."),
    Sentence("cc0-name", "CC0 1.0 Universal"),
    Sentence("bsd-grant", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", prefix=True),
    Sentence("bsd-source", "Redistributions of source code must retain the above copyright notice", prefix=True),
    Sentence("bsd-binary", "Redistributions in binary form must reproduce the above copyright notice", prefix=True),
    Sentence("bsd-names", "Neither the name of", prefix=True),
    Sentence("isc-name", "ISC License"),
    Sentence("isc-grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    Sentence("zero-bsd-grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    Sentence("isc-as-is", 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE', prefix=True),
    Sentence("mpl2-name", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    Sentence("epl2-name", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", prefix=True),
    Sentence("epl1-name", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0", prefix=True),
    Sentence("bsl1-name", "Distributed under the Boost Software License, Version 1.0.", prefix=True),
    Sentence("bsl1-name", "Boost Software License - Version 1.0 - August 17th, 2003", prefix=True),
    Sentence("unlicense-free", "This is free and unencumbered software released into the public domain."),
    Sentence("zlib-as-is", "This software is provided 'as-is', without any express or implied warranty", prefix=True),
    Sentence("zlib-grant", "Permission is granted to anyone to use this software for any purpose, including commercial applications", prefix=True),
    Sentence("wtfpl-title", "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE", prefix=True),
    Sentence("rights", "All rights reserved."),
    Sentence("copyright", "Copyright (c)", prefix=True),
)
# Identifiers of the published short list of licences, by which a tag line names one.
TAGGED = (
    "0BSD", "AFL-3.0", "AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-1.1", "Apache-2.0", "Artistic-1.0", "Artistic-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSD-3-Clause-Clear", "BSD-4-Clause",
    "BSL-1.0", "BUSL-1.1", "CC-BY-3.0", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-NC-ND-4.0", "CC-BY-NC-SA-4.0", "CC-BY-ND-4.0", "CC-BY-SA-3.0", "CC-BY-SA-4.0", "CC0-1.0", "CDDL-1.0", "CDDL-1.1",
    "CECILL-2.1", "CPL-1.0", "ECL-2.0", "EFL-2.0", "EPL-1.0", "EPL-2.0", "EUPL-1.1", "EUPL-1.2", "FTL", "GFDL-1.3", "GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0-only",
    "GPL-3.0-or-later", "HPND", "ISC", "LGPL-2.0", "LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later", "LPPL-1.3c", "MIT", "MIT-0", "MPL-1.1",
    "MPL-2.0", "MS-PL", "MS-RL", "MulanPSL-2.0", "NCSA", "ODC-By-1.0", "ODbL-1.0", "OFL-1.1", "OSL-3.0", "PDDL-1.0", "PHP-3.01", "PostgreSQL", "PSF-2.0", "Python-2.0", "QPL-1.0", "Ruby", "SSPL-1.0",
    "UPL-1.0", "Unlicense", "Vim", "W3C", "WTFPL", "X11", "ZPL-2.1", "Zlib",
)
SENTENCES += tuple(Sentence(f"spdx-{name.lower()}", f"SPDX-License-Identifier: {name}") for name in TAGGED)
RULES = (
    Rule("MIT", ("mit-grant", "mit-notice", "as-is"), gap=1),
    Rule("MIT", ("mit-name",)),
    Rule("Apache-2.0", ("apache2-name", "apache2-copy", "apache2-as-is"), gap=1),
    Rule("Apache-2.0", ("apache2-name",)),
    Rule("Apache-2.0", ("apache2-title",)),
    Rule("GPL-3.0", ("gpl3-free", "gpl-hope"), gap=1),
    Rule("GPL-3.0", ("gpl3-name",)),
    Rule("GPL-2.0", ("gpl2-free", "gpl-hope"), gap=1),
    Rule("GPL-2.0", ("gpl2-name",)),
    *(Rule(f"LGPL-{version}", (f"lgpl{name}-free", hope), gap=1) for name, version in (("2", "2.0"), ("21", "2.1"), ("3", "3.0")) for hope in ("lgpl-hope", "gpl-hope")),
    Rule("AGPL-3.0", ("agpl3-free", "gpl-hope"), gap=1),
    # Notices that name no version.
    Rule("GPL", ("gpl-free", "gpl-hope"), gap=1),
    Rule("LGPL", ("lgpl-free", "lgpl-hope"), gap=1),
    Rule("LGPL-2.1", ("lgpl21-name",)),
    Rule("LGPL-3.0", ("lgpl3-name",)),
    Rule("AGPL", ("agpl-free", "gpl-hope"), gap=1),
    Rule("AGPL-3.0", ("agpl3-name",)),
    Rule("CC-BY-NC-4.0", ("cc-by-nc-4-name",)),
    Rule("CC-BY-4.0", ("cc-by-4-name",)),
    Rule("CC-BY-SA-4.0", ("cc-by-sa-4-name",)),
    Rule("CC0-1.0", ("cc0-name",)),
    Rule("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names"), gap=1),
    Rule("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary"), gap=1),
    Rule("ISC", ("isc-grant", "isc-as-is"), gap=1),
    Rule("ISC", ("isc-name",)),
    Rule("0BSD", ("zero-bsd-grant", "isc-as-is"), gap=1),
    Rule("Zlib", ("zlib-as-is", "zlib-grant"), gap=1),
    Rule("MPL-2.0", ("mpl2-name",)),
    Rule("EPL-2.0", ("epl2-name",)),
    Rule("EPL-1.0", ("epl1-name",)),
    Rule("BSL-1.0", ("bsl1-name",)),
    Rule("Unlicense", ("unlicense-free",)),
    Rule("WTFPL", ("wtfpl-title",)),
    *(Rule(name, (f"spdx-{name.lower()}",)) for name in TAGGED),
    Rule("Proprietary", ("rights",), alone=True),
)
#: The end of a sentence or paragraph, a fragment of its own.
END = "\x01"
_BLANK = "[ \\t\\f\\r\\x0b]"
#: In order: pattern, what stands before the first group's text if there is one, and after it. No look-around, so that SQL engines agree.
_STEPS = (
    (f"\\n{_BLANK}*(?://+|#+|\\*+|;+|--+|/\\*+|<!--|%+|>+)?{_BLANK}*", False, "\n"),
    ("\\n\\n+", False, f"\n{END}\n"),
    ("([^vV\\n])[.!?]+[ \\t\\f\\r\\x0b\\n]", True, f"\n{END}\n"),
)
_OTHER = f"[^\\p{{L}}\\p{{N}}\\n{END}]+"


def _plain(text: str) -> str:
    return " ".join("".join(c if c.isalnum() else " " for c in text.lower()).split())


def fragments(text: Column) -> Column:
    """Normalised fragments in order, with ``END`` where a sentence or paragraph ends."""
    out = F.concat(F.lit("\n"), F.translate(text, END, " "))
    for pattern, group, after in _STEPS:
        out = F.regexp_replace(out, pattern, ("$1" if group else "") + after)
    return F.array_remove(F.transform(F.split(F.regexp_replace(F.lower(out), _OTHER, " "), "\n"), lambda x: F.trim(x)), "")


@dataclass(frozen=True)
class Known:
    """The sentences of a table as they are looked up: whole ones, beginnings (longest first), first words, and words of the longest."""

    whole: dict[str, str]
    begins: list[tuple[str, str]]
    heads: list[str]
    singles: list[str]
    most: int

    @staticmethod
    def of(sentences: Sequence[Sentence]) -> Known:
        whole = {_plain(s.text): s.id for s in sentences if not s.prefix}
        begins = sorted({_plain(s.text): s.id for s in sentences if s.prefix}.items(), key=lambda x: (-len(x[0]), x[0]))
        plain = [*whole, *(p for p, _ in begins)]
        if not all(plain):
            raise ValueError("a sentence without letters or digits")
        words = [p.split(" ") for p in plain]
        # A fragment may be a sentence's first word alone, the rest on the next line.
        heads = sorted({x for w in words for x in (w[0], " ".join(w[:2]))})
        return Known(whole, begins, heads, sorted({w[0] for w in words if len(w) == 1}), max(map(len, words), default=1))


def sentence_ids(parts: str, sentences: Sequence[Sentence] = SENTENCES) -> Column:
    """Identifiers, in order, of the licence sentences in a column of ``fragments``; one that lies within an earlier one isn't named."""
    known = Known.of(sentences)
    table = F.create_map(*(F.lit(x) for kv in known.whole.items() for x in kv)) if known.whole else F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    answer = lambda name, text: F.struct(name.alias("id"), F.length(text).alias("size"))

    def named(at: Column) -> Column:
        # A fragment has a word at least, so so many fragments hold every sentence of the table.
        span = F.slice(parts, at, F.lit(known.most))
        joined, own = F.trim(F.substring_index(F.array_join(span, " "), END, 1)), F.element_at(parts, at)
        found = F.coalesce(*(F.when(F.try_element_at(table, x).isNotNull(), answer(F.try_element_at(table, x), x)) for x in (joined, own)), *(F.when(joined.startswith(p), answer(F.lit(i), F.lit(p))) for p, i in known.begins))
        count = lambda a, x: F.when(a["chars"] < found["size"], F.struct((a["chars"] + F.length(x) + F.when(a["n"] > 0, 1).otherwise(0)).alias("chars"), (a["n"] + 1).alias("n"))).otherwise(a)
        used = F.aggregate(span, F.struct(F.lit(0).alias("chars"), F.lit(0).alias("n")), count, lambda a: a["n"])
        return F.when(found.isNotNull(), F.struct(found["id"].alias("id"), at.alias("at"), (at + used - 1).alias("end")))

    looks = lambda x: F.substring_index(x, " ", 2).isin(known.heads) | (F.substring_index(x, " ", 1).isin(known.singles) if known.singles else F.lit(False))
    places = F.filter(F.transform(parts, lambda x, i: F.when(looks(x), i + 1)), lambda i: i.isNotNull())
    matches = F.filter(F.transform(places, named), lambda m: m.isNotNull())
    start = F.struct(F.lit(0).alias("end"), F.array().cast("array<string>").alias("ids"))
    fold = lambda a, m: F.struct(F.greatest(a["end"], m["end"]).alias("end"), F.when(m["at"] > a["end"], F.array_append(a["ids"], m["id"])).otherwise(a["ids"]).alias("ids"))
    return F.aggregate(matches, start, fold, lambda a: a["ids"])


def _pattern(rule: Rule) -> str:
    """For identifiers that stand each between spaces of its own."""
    return f"(?: [^ ]+ ){{0,{rule.gap}}}".join(f" {i} " for i in rule.ids)


def _longest_first(rules: Sequence[Rule]) -> list[int]:
    return sorted((k for k, r in enumerate(rules) if len(r.ids) > 1), key=lambda k: (-len(rules[k].ids), k))


def matched(ids: Column, rules: Sequence[Rule] = RULES) -> Column:
    """Distinct licences in the rules' order; a rule's identifiers are taken out where it matched, so shorter rules find only the rest."""
    rest, found = F.concat(F.lit(" "), F.array_join(ids, "  "), F.lit(" ")), []
    for k in _longest_first(rules):
        found.append(F.when(rest.rlike(_pattern(rules[k])), F.struct(F.lit(k).alias("k"), F.lit(rules[k].licence).alias("licence"))))
        rest = F.regexp_replace(rest, _pattern(rules[k]), "")
    single = [x for k, r in enumerate(rules) if len(r.ids) == 1 for x in (F.lit(r.ids[0]), F.struct(F.lit(k).alias("k"), F.lit(r.licence).alias("licence")))]
    if single:
        table = F.create_map(*single)
        found = F.concat(F.array(*found) if found else F.array().cast("array<struct<k:int,licence:string>>"), F.transform(F.split(rest, " +"), lambda i: F.try_element_at(table, i)))
    else:
        found = F.array(*found)
    found = F.array_compact(found)
    if left := [k for k, r in enumerate(rules) if r.alone]:
        others = F.filter(found, lambda x: ~x["k"].isin(left))
        found = F.when(F.size(others) > 0, others).otherwise(found)
    return F.array_distinct(F.transform(F.array_sort(found), lambda x: x["licence"]))


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sentences: Sequence[Sentence] = SENTENCES, rules: Sequence[Rule] = RULES) -> DataFrame:
    """doc_id, sentences (their identifiers, joined by spaces), licences (joined by commas) and n_licences for every row.

    Texts without licence sentences, null and empty ones have empty strings and 0. Texts are read whole; repeated rows and null
    ids keep their rows; an empty table gives no rows; other columns are ignored. Two rules of one identifier that is the same are
    one too many, as are two sentences of one text: the last counts. One pass, without a shuffle.
    """
    parts = docs.select(F.col(id_col).cast("long").alias("doc_id"), fragments(blank_null(F.col(text_col))).alias("parts"))
    found = parts.select("doc_id", sentence_ids("parts", sentences).alias("ids"))
    named = found.select("doc_id", F.array_join("ids", " ").alias("sentences"), F.when(F.size("ids") > 0, matched(F.col("ids"), rules)).otherwise(F.array().cast("array<string>")).alias("names"))
    return named.select("doc_id", "sentences", F.array_join("names", ",").alias("licences"), F.size("names").cast("long").alias("n_licences"))


def read_tables(spark: SparkSession, path: str) -> tuple[tuple[Sentence, ...], tuple[Rule, ...]]:
    """Sentences and rules from JSON lines: {"id", "text", "prefix"} and {"licence", "ids", "gap", "alone"}, rules in the order of ``rank``."""
    rows = spark.read.schema("id string, text string, prefix boolean, licence string, ids array<string>, gap int, alone boolean, rank long").json(path).collect()
    sentences = tuple(Sentence(r.id, r.text, bool(r.prefix)) for r in rows if r.id is not None)
    return sentences, tuple(Rule(r.licence, tuple(r.ids), r.gap or 0, bool(r.alone)) for r in sorted((r for r in rows if r.licence is not None), key=lambda r: (r.rank or 0, r.licence)))


def oracle(sentences: Sequence[Sentence] = SENTENCES, rules: Sequence[Rule] = RULES) -> str:
    """DuckDB SQL for ``scan`` over ``documents``."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    chars = lambda x: "concat(" + ", ".join(f"chr({ord(c)})" for c in x) + ", '')"
    known, cut = Known.of(sentences), "concat(chr(10), translate(coalesce(text, ''), chr(1), ' '))"
    for pattern, group, after in _STEPS:
        cut = f"regexp_replace({cut}, {quote(pattern)}, concat({quote(chr(92) + '1' if group else '')}, {chars(after)}), 'g')"
    listed = lambda xs: ", ".join(map(quote, xs))
    tables = f"whole AS (SELECT * FROM (VALUES {', '.join(f'({quote(t)}, {quote(i)})' for t, i in known.whole.items())}) AS w(t, id))"
    begins = " ".join(f"WHEN starts_with(joined, {quote(p)}) THEN {{}}" for p, _ in known.begins)
    rest, steps = "concat(' ', array_to_string(ids, '  '), ' ')", []
    for k in _longest_first(rules):
        steps.append(f"CASE WHEN regexp_matches({rest}, {quote(_pattern(rules[k]))}) THEN {k} END")
        rest = f"regexp_replace({rest}, {quote(_pattern(rules[k]))}, '', 'g')"
    single = ", ".join(f"({quote(r.ids[0])}, {k})" for k, r in enumerate(rules) if len(r.ids) == 1)
    names = ", ".join(f"({k}, {quote(r.licence)})" for k, r in enumerate(rules))
    left = ", ".join(str(k) for k, r in enumerate(rules) if r.alone) or "-1"
    other = _OTHER.replace(END, "\\x01")
    return f"""
WITH {tables}, parts AS (
  SELECT rid, doc_id, list_filter(list_transform(string_split(regexp_replace(lower(t), {quote(other)}, ' ', 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS parts
  FROM (SELECT row_number() OVER () AS rid, doc_id, {cut} AS t FROM documents)
), placed AS (
  SELECT rid, parts, place, parts[place] AS own, trim(string_split(array_to_string(parts[place:place + {known.most - 1}], ' '), chr(1))[1]) AS joined
  FROM (SELECT rid, parts, unnest(range(1, len(parts) + 1)) AS place FROM parts)
  WHERE array_to_string(string_split(parts[place], ' ')[1:2], ' ') IN ({listed(known.heads)}){f" OR string_split(parts[place], ' ')[1] IN ({listed(known.singles)})" if known.singles else ""}
), named AS (
  SELECT rid, parts, place, coalesce(a.id, b.id, CASE {begins.format(*(quote(i) for _, i in known.begins))} END) AS id,
    coalesce(length(a.t), length(b.t), CASE {begins.format(*(len(p) for p, _ in known.begins))} END) AS size
  FROM placed LEFT JOIN whole a ON joined = a.t LEFT JOIN whole b ON own = b.t
), sized AS (
  SELECT rid, place, id, place + (SELECT min(j) FROM unnest(range(1, {known.most + 1})) AS u(j) WHERE length(array_to_string(parts[place:place + j - 1], ' ')) >= size) - 1 AS last_place FROM named WHERE id IS NOT NULL
), fresh AS (
  SELECT rid, place, id FROM (SELECT *, max(last_place) OVER (PARTITION BY rid ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before_place FROM sized) WHERE before_place IS NULL OR place > before_place
), listed AS (
  SELECT rid, list(id ORDER BY place) AS ids FROM fresh GROUP BY rid
), found AS (
  SELECT rid, unnest([{", ".join(steps) or "NULL"}]) AS k FROM listed
  UNION ALL SELECT rid, s.k FROM (SELECT rid, unnest(string_split({rest}, ' ')) AS id FROM listed) AS r JOIN (VALUES {single}) AS s(id, k) ON r.id = s.id
), licences AS (
  SELECT rid, string_agg(licence, ',' ORDER BY k) AS licences, count(*) AS n FROM (SELECT rid, licence, min(k) AS k FROM (SELECT *, k IN ({left}) AS alone, min(CASE WHEN k IN ({left}) THEN 1 ELSE 0 END) OVER (PARTITION BY rid) AS only_alone FROM found WHERE k IS NOT NULL) AS f JOIN (VALUES {names}) AS n(k, licence) USING (k) WHERE NOT alone OR only_alone = 1 GROUP BY rid, licence) GROUP BY rid
)
SELECT doc_id, coalesce(array_to_string(listed.ids, ' '), '') AS sentences, coalesce(licences, '') AS licences, coalesce(n, 0) AS n_licences
FROM parts LEFT JOIN listed USING (rid) LEFT JOIN licences USING (rid)"""


ORACLE_SQL = oracle()
