import random
import re
import textwrap
import unicodedata
from collections import Counter
from math import comb

import duckdb
from pyspark.sql import functions as F

from skytally.llm import licenses, quality_rules

LABELS = "doc_id long, quality int"


def test_quality_sql(spark, tables, duck, same):
    docs, labels = (spark.read.parquet(f"{tables}/{t}.parquet") for t in ("documents", "labels"))
    same(quality_rules.judge(docs, labels), duck, quality_rules.ORACLE_SQL)


def measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    runs = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    often = Counter(runs)
    covered = {k + o for k, r in enumerate(runs) if often[r] > 1 for o in range(5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


TEXTS = ["", None, "a b c d e", "a b c d e f a b c d e", "x " * 50, "a\n\na\n \nb c\na", "# * $ % & | < >", "é\x0bü\x0cö\r\n", "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11", "\n".join(["same line of words here"] * 9), "a a a a a a b " * 30]


def test_measures_by_brute_force(spark, documents, docs_of):
    for docs in (documents, docs_of(TEXTS).withColumn("n_words", F.lit(-1)).withColumn("stratum", F.lit("x"))):
        rows = {r.doc_id: tuple(r[c] for c in quality_rules.MEASURES) for r in quality_rules.measured(docs).collect()}
        assert rows == {r.doc_id: measures(r.text) for r in docs.collect()}


def test_binomial_tail(spark):
    rows = spark.createDataFrame([(k, n) for n in (1, 10, 300) for k in (0, 1, 5, n) if k <= n], "k long, n long").withColumn("p", quality_rules.binomial_tail(F.col("k"), F.col("n"), 0.07)).collect()
    for r in rows:
        assert abs(r.p - sum(comb(r.n, j) * 0.07**j * 0.93 ** (r.n - j) for j in range(r.k + 1))) < 1e-9


def test_cutoffs_hold_their_risk(spark, docs_of):
    """Many clean documents and a few marked ones: the cutoff rejects no more good ones than the bound allows."""
    good = [f"the words of text number {k} go on and on without any end at all" + (" ###" if k % 400 == 0 else "") for k in range(4000)]
    bad = ["these ### words ### have ### far ### too ### many ### marks ### among ### them ### all"] * 20
    docs = docs_of(good + bad)
    labels = spark.createDataFrame([(k, 1) for k in range(4000)] + [(4000, 0), (1, 1), (None, 1)], LABELS)
    rows = quality_rules.judge(docs, labels).collect()
    kept = {r.doc_id for r in rows if r.kept}
    assert not kept & set(range(4000, 4020)) and len(kept) >= (1 - quality_rules.LIMIT) * 4000
    few = quality_rules.judge(docs, labels.where("doc_id < 50")).collect()
    assert all(r.kept for r in few)


def tail(k, n, p):
    return sum(comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1))


def test_settings_by_brute_force(spark):
    """The last level before the first that fails, by stratum, with the bound written out."""
    rng = random.Random(8)
    rows = [(k, s, rng.choices(range(1, 22), [w] * 20 + [1])[0], rng.random() < 0.1) for k, (s, w) in enumerate(x for x in (("a", 0.0005), ("b", 0.002), ("c", 0.02), ("d", 0.0)) for _ in range(700))]
    rows += [(k + 10_000, "few", 21, False) for k in range(200)]
    labels = spark.createDataFrame([(r[0], 1) for r in rows] + [(1, 1), (2, 0)], LABELS)
    got = {r.stratum: (r.n_good, r.passed, r.n_good_rejected) for r in quality_rules.settings(spark.createDataFrame(rows, "doc_id long, stratum string, level int, base_failed boolean"), labels).collect()}
    want = {}
    for s in {r[1] for r in rows}:
        levels = [r[2] for r in rows if r[1] == s and not r[3]]
        n, passed = len(levels), 0
        while passed < quality_rules.LEVELS and tail(sum(x <= passed + 1 for x in levels), n, quality_rules.LIMIT) <= quality_rules.RISK / 5:
            passed += 1
        want[s] = (n, passed, sum(x <= passed for x in levels))
    assert got == want and want["few"][1] == 0 and 0 < want["b"][1] < 20 and want["d"][1] == 20


def test_risk_holds_over_many_draws(spark):
    """Strata drawn with a true share of false rejections of 0.4 % a level: few may go beyond level 5, where the limit of 2 % lies."""
    rng, draws, n = random.Random(9), 300, 600
    rows = [(d * n + k, f"s{d}", min(21, 1 + int(rng.random() / 0.004)), False) for d in range(draws) for k in range(n)]
    labels = spark.createDataFrame([(r[0], 1) for r in rows], LABELS)
    got = quality_rules.settings(spark.createDataFrame(rows, "doc_id long, stratum string, level int, base_failed boolean"), labels, risk=0.05 * draws).collect()
    assert sum(r.passed > 5 for r in got) <= 0.05 * draws + 3 * (0.05 * 0.95 * draws) ** 0.5
    assert sum(r.passed > 0 for r in got) > 0.9 * draws


def test_verdict_differs_from_the_base(spark):
    """At sf0.1's labels a setting passes in every language, and rows go that the base rules keep."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = quality_rules.judge(docs, labels).join(labels, "doc_id").where("NOT base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    kept = {r.quality: r.kept for r in rows}
    assert kept[0] < 0.2 and kept[1] >= 1 - quality_rules.LIMIT


def test_quality_without_labels_or_rows(spark, docs_of):
    none = spark.createDataFrame([], LABELS)
    docs = docs_of([*TEXTS, TEXTS[8]])
    rows = quality_rules.judge(docs, none).collect()
    assert len(rows) == 12 and all(r.kept == (not r.base_failed) for r in rows)
    assert quality_rules.judge(docs.limit(0), none).count() == 0


def test_license_sql(spark, tables, duck, same, documents):
    same(licenses.scan(documents), duck, licenses.ORACLE_SQL)


def of(*ids):
    return [next(s.text for s in licenses.SENTENCES if s.id == i) for i in ids]


MIT, BSD = of("mit-grant", "mit-notice", "as-is"), of("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")


def test_license_sequences(docs_of):
    found = lambda t, **more: licenses.scan(docs_of([t]), **more).first()
    whole = found("Copyright (c) 2020 A. All\n" + f"{MIT[0]}, to deal.\n{MIT[1]}\n{MIT[2]}, express.\nplain end")
    assert whole.licences == "MIT" and whole.sentences == "copyright mit-grant mit-notice as-is"
    assert found("\n".join(f"{m}." for m in reversed(MIT))).licences == ""
    assert found("\n".join(f"{s} x." for s in BSD)).licences == "BSD-3-Clause"
    assert found("\n".join(f"{s} x." for s in BSD[:3])).licences == "BSD-2-Clause"
    assert found("Words. Released under the MIT License. Licensed under CC BY-NC 4.0.").licences == "MIT,CC-BY-NC-4.0"
    assert found("we talk of a licence and copyright as is common").licences == ""
    long = found("word " * 50_000 + "\nlicensed   under the APACHE license, version 2.0\n" + "word " * 50_000)
    assert long.licences == "Apache-2.0" and long.n_licences == 1
    own = found("Take it as it comes.", sentences=[licenses.Sentence("own", "take it as it comes")], rules=[licenses.Rule("OWN", ("own",))])
    assert own.licences == "OWN"


WRAPPED = {
    "MIT": f"MIT License\n\nCopyright (c) 2020 A\n\n{MIT[0]}, to deal in the Software.\n\n{MIT[1]}\n\n{MIT[2].replace('AS IS', 'AS-IS')}, EXPRESS OR IMPLIED.",
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\n'
    + of("apache2-as-is")[0] + ", WITHOUT WARRANTIES.",
    "GPL-3.0": of("gpl3-free")[0] + " of the License. " + of("gpl-hope")[0] + ".",
    "Apache-2.0 ": "Apache License\nVersion 2.0, January 2004\nhttp://x",
    "GPL-2.0 ": "GNU GENERAL PUBLIC LICENSE\nVersion 2, June 1991\n\nCopyright (C) 1989",
    "GPL-2.0": of("gpl2-free")[0] + " of the License, or any later version. " + of("gpl-hope")[0] + ".",
    "LGPL": of("lgpl-free")[0] + ". " + of("lgpl-hope")[0] + ".",
    "AGPL": of("agpl-free")[0] + ". " + of("gpl-hope")[0] + ".",
    "BSD-3-Clause": f"{BSD[0]}:\n\n1. {BSD[1]}, this list.\n\n2. {BSD[2]} too.\n\n3. {BSD[3]} the holder.",
    "ISC": f"{of('isc-grant')[0]}\n\n{of('isc-as-is')[0]}.",
    "MPL-2.0": of("mpl2-name")[0] + " If a copy was not distributed.",
    "Unlicense": of("unlicense-free")[0],
}


HOPE = "{} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY."
#: Notices as they stand in published sources, and what they name.
NOTICES = [
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation. " + HOPE.format("This program")),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of version 2 of the GNU General Public License as published by the Free Software Foundation.\n\n" + HOPE.format("This program")),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms and conditions of nothing. SPDX-License-Identifier: GPL-2.0"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, version 3, as published by X. " + HOPE.format("This program")),
    ("GPL", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation. " + HOPE.format("This program")),
    ("LGPL-3.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or any later version.\n" + HOPE.format("This library")),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License. " + HOPE.format("This library")),
    ("LGPL-2.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation; either version 2 of the License. " + HOPE.format("This library")),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License. " + HOPE.format("This program")),
    ("BSD-3-Clause", "Copyright (c) 2020, A Holder.\nAll rights reserved.\n\n" + WRAPPED["BSD-3-Clause"]),
    ("Proprietary", "Copyright (c) 2020, A Holder. All rights reserved."),
    ("MIT", "All rights reserved.\nReleased under the MIT License.\n"),
]


def test_versions_of_notices(spark, docs_of, same):
    docs = docs_of([t for _, t in NOTICES])
    rows = {r.doc_id: r.licences for r in licenses.scan(docs).collect()}
    assert [rows[k] for k in range(len(NOTICES))] == [name for name, _ in NOTICES]
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    same(licenses.scan(docs), con, licenses.ORACLE_SQL)


def test_wrapped_notices_behind_comment_marks(docs_of):
    """Real notices are broken at some width and stand in comments."""

    def wrapped(text, width, mark):
        return "\n".join(mark + x for part in text.split("\n") for x in (textwrap.wrap(part, width) or [""]))

    cases = [(name, wrapped(t, width, mark)) for name, t in WRAPPED.items() for width in (30, 72) for mark in ("", "# ", " * ", "// ", ";; ")]
    cases += [(name, f"#!/usr/bin/env x\n# SPDX-License-Identifier: {name}\nimport y") for name in licenses.TAGGED]
    rows = {r.doc_id: r.licences for r in licenses.scan(docs_of([t for _, t in cases])).collect()}
    assert {k: rows[k] for k in rows if cases[k][0].strip() != rows[k]} == {}


def sentences_by_force(text):
    """The rule stated plainly: at each fragment, the sentences of the table one by one."""
    text = "\n" + (text or "").replace("\x01", " ")
    text = re.sub(r"\n[ \t\f\r\v]*(?://+|#+|\*+|;+|--+|/\*+|<!--|%+|>+)?[ \t\f\r\v]*", "\n", text)
    text = re.sub(r"([^vV\n])[.!?]+[ \t\f\r\v\n]", "\\1\n\x01\n", re.sub(r"\n\n+", "\n\x01\n", text))
    parts = [x for x in (" ".join("".join(c if c.isalpha() or unicodedata.category(c)[0] in "LN" or c == "\x01" else " " for c in p).split()) for p in text.lower().split("\n")) if x]
    ids, reach = [], 0
    for k in range(len(parts)):
        end = parts.index("\x01", k) if "\x01" in parts[k:] else len(parts)
        joined = " ".join(parts[k:end])
        best = next(((s.id, p) for x in (joined, parts[k]) for s in reversed(licenses.SENTENCES) if not s.prefix and (p := licenses._plain(s.text)) == x), None)
        best = best or max(((s.id, p) for s in licenses.SENTENCES if s.prefix and joined.startswith(p := licenses._plain(s.text))), key=lambda x: len(x[1]), default=None)
        if best:
            if k >= reach:
                ids.append(best[0])
            reach = max(reach, next(j for j in range(k + 1, len(parts) + 1) if len(" ".join(parts[k:j])) >= len(best[1])))
    return " ".join(ids)


def test_sentences_by_brute_force(docs_of):
    rng, texts = random.Random(12), []
    for _ in range(150):
        parts = [rng.choice([s.text for s in licenses.SENTENCES] + ["plain words here", "and v. 3 of it", "x"]) + rng.choice(["", ".", ". ", ", and more", "!\n"]) for _ in range(rng.randint(1, 6))]
        words = rng.choice([" ", "\n", "\n\n", "\n# "]).join(parts).split(" ")
        texts.append("".join(w + rng.choice([" ", " ", " ", "\n", "\n// ", "  "]) for w in words))
    texts += ["", None, "MIT License", "\x01MIT License\x01", "MIT\nLicense", "\n\n\n", "all rights reserved!  all rights\nreserved."]
    rows = {r.doc_id: r.sentences for r in licenses.scan(docs_of(texts)).collect()}
    assert rows == {k: sentences_by_force(t) for k, t in enumerate(texts)} and any(" " in x for x in rows.values())


def test_license_sql_of_sequences(spark, docs_of, same):
    import duckdb

    con = duckdb.connect()
    texts = [*WRAPPED.values(), *(t.replace(" ", "\n", 9) for t in WRAPPED.values()), None, "", "Released under the MIT License.\nAll rights reserved."]
    con.register("documents", docs_of(texts).toPandas())
    same(licenses.scan(docs_of(texts)), con, licenses.ORACLE_SQL)


def test_tables_from_files(spark, tmp_path, docs_of):
    (tmp_path / "t.json").write_text('{"id": "a", "text": "one two"}\n{"id": "b", "text": "three", "prefix": true}\n{"licence": "L", "ids": ["a", "b"], "gap": 1, "rank": 1}\n{"licence": "M", "ids": ["b"], "rank": 2}\n')
    sentences, rules = licenses.read_tables(spark, f"file://{tmp_path}/t.json")
    rows = licenses.scan(docs_of(["One two.\nthree four", "three", "two"]), sentences=sentences, rules=rules).orderBy("doc_id").collect()
    assert [r.licences for r in rows] == ["L", "M", ""]


def test_license_edges(docs_of):
    docs = docs_of(["", None, "Released under the MIT License.", "Released under the MIT License."], [1, 2, 3, 3]).withColumn("ids", F.lit("clash"))
    rows = [(r.doc_id, r.licences, r.n_licences) for r in licenses.scan(docs).orderBy("doc_id").collect()]
    assert rows == [(1, "", 0), (2, "", 0), (3, "MIT", 1), (3, "MIT", 1)] and licenses.scan(docs.limit(0)).count() == 0
