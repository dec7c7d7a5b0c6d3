"""Operator 1 [native]: licence texts, found by the digest of their canonical form.

The canonical form lower-cases A-Z, drops copyright lines, makes one word break of
each run of other characters than a-z, 0-9, and writes one of several equivalent
spellings. A document as a whole, and each of its lines, is hash-joined to the digests
of the known texts. The known texts are a parameter; the join is a broadcast only
while their counted number is at most ``max_broadcast``.

Defined results: null and empty texts have the digest of the empty string and match
nothing. Rows are told apart by doc_id and text; each row of the input has one row in
the result, so an empty table gives an empty one. A null doc_id is a doc_id like any
other. Of known texts that agree the smallest id is given. Extra columns are left out,
whatever their names; texts of any length are read whole.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidestep.llm.common import UPPER, ascii_lower, stored, table

# Spellings that licence matching treats as the same word.
SPELLINGS = {
    "acknowledgment": "acknowledgement",
    "analog": "analogue",
    "analyze": "analyse",
    "artifact": "artefact",
    "authorization": "authorisation",
    "authorized": "authorised",
    "caliber": "calibre",
    "canceled": "cancelled",
    "capitalizations": "capitalisations",
    "catalog": "catalogue",
    "categorize": "categorise",
    "center": "centre",
    "emphasized": "emphasised",
    "favor": "favour",
    "favorite": "favourite",
    "fulfill": "fulfil",
    "fulfillment": "fulfilment",
    "initialize": "initialise",
    "judgment": "judgement",
    "labeling": "labelling",
    "labor": "labour",
    "licence": "license",
    "licenced": "licensed",
    "maximize": "maximise",
    "modeled": "modelled",
    "modeling": "modelling",
    "offense": "offence",
    "optimize": "optimise",
    "organization": "organisation",
    "organize": "organise",
    "practice": "practise",
    "program": "programme",
    "realize": "realise",
    "recognize": "recognise",
    "signaling": "signalling",
    "sublicence": "sublicense",
    "utilization": "utilisation",
    "while": "whilst",
    "wilfull": "wilful",
    "noninfringement": "non  infringement",
}

# A line that only states a copyright.
COPYRIGHT_LINE = r"(?m)^[^a-z0-9\n]*(?:copyright[^a-z0-9\n]*(?:c\)|©|[0-9]{4}|by |year|yyyy)|c\)[^a-z0-9\n]*[0-9]{4}|©|all rights reserved)[^\n]*"

# Known texts, by SPDX identifier; "-notice" marks a standard reference to a licence.
KNOWN = {
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "ISC": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "0BSD": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "MIT-notice": "Released under the MIT License.",
    "MIT-notice-2": "Licensed under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice-2": "Released under the Apache License, Version 2.0.",
    "GPL-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "BSD-3-Clause-notice": "Released under the BSD 3-Clause License.",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC0-1.0-notice": "This work is dedicated to the public domain under CC0 1.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "Unlicense-notice": "This is free and unencumbered software released into the public domain.",
    "Proprietary-notice": "All rights are reserved and no license is granted.",
}

# Full texts in files of this package, by SPDX identifier.
KNOWN |= {f.stem: f.read_text() for f in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}

# Titles that stand above the text of a short licence.
TITLES = {"MIT": ["MIT License", "The MIT License", "The MIT License (MIT)"], "ISC": ["ISC License"], "0BSD": ["BSD Zero Clause License"], "BSD-2-Clause": ["BSD 2-Clause License"], "BSD-3-Clause": ["BSD 3-Clause License"], "Zlib": ["zlib License"]}
KNOWN |= {f"{k}-titled-{i}": f"{t}\n\n{KNOWN[k]}" for k, titles in TITLES.items() for i, t in enumerate(titles, 1)}
# The conditions of these are also written as a list without numbers.
KNOWN |= {f"{k}-unnumbered": re.sub(r"(?m)^[1-3]\. ", "* ", KNOWN[k]) for k in ("BSD-2-Clause", "BSD-3-Clause")}


def _names() -> dict[str, list[str]]:
    """What notices call each licence, by SPDX identifier."""
    out = {
        "MIT": ["the MIT License"],
        "ISC": ["the ISC License"],
        "0BSD": ["the BSD Zero Clause License"],
        "Zlib": ["the zlib License"],
        "Unlicense": ["the Unlicense"],
        "BSD-2-Clause": ["the BSD 2-Clause License", "the Simplified BSD License", "the 2-Clause BSD License"],
        "BSD-3-Clause": ["the BSD 3-Clause License", "the New BSD License", "the 3-Clause BSD License"],
        "Apache-2.0": ["the Apache License, Version 2.0", "the Apache License 2.0", "the Apache 2.0 License"],
        "MPL-2.0": ["the Mozilla Public License, v. 2.0", "the Mozilla Public License, version 2.0", "the Mozilla Public License 2.0"],
        "CC0-1.0": ["CC0", "CC0 1.0 Universal"],
        "EPL-2.0": ["the Eclipse Public License 2.0", "the Eclipse Public License, version 2.0"],
        "BSL-1.0": ["the Boost Software License, Version 1.0", "the Boost Software License 1.0"],
        "Artistic-2.0": ["the Artistic License 2.0"],
    }
    for prefix, name, short, versions in (("GPL", "GNU General Public License", "GPL", ("2.0", "3.0")), ("LGPL", "GNU Lesser General Public License", "LGPL", ("2.1", "3.0")), ("AGPL", "GNU Affero General Public License", "AGPL", ("3.0",))):
        for v in versions:
            n = v.removesuffix(".0")
            out[f"{prefix}-{v}"] = [f"the {name}, version {n}", f"the {name} version {n}", f"the {name} v{n}", f"the {name} v{v}", f"the {short}v{n}", f"{short}v{n}", f"the GNU {short} v{n}"]
    full = {"BY": "Attribution", "SA": "ShareAlike", "NC": "NonCommercial", "ND": "NoDerivatives"}
    for kind in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND"):
        for v, law in (("1.0", "Generic"), ("2.0", "Generic"), ("2.5", "Generic"), ("3.0", "Unported"), ("4.0", "International")):
            name = "-".join(full[x] for x in kind.split("-"))
            out[f"CC-{kind}-{v}"] = [f"CC {kind} {v}", f"the CC {kind} {v} License", *(f"{a} Creative Commons {name} {v}{x} License" for a in ("a", "the") for x in (f" {law}", ""))]
    return out


FORMS = ["Licensed under {}.", "Released under {}.", "Distributed under {}.", "Available under {}.", "Published under {}."]
FORMS += [f"This {x} is {y} under {{}}." for x in ("work", "software", "project", "file", "document", "text", "program", "code") for y in ("licensed", "released", "distributed")]


def _notices() -> dict[str, str]:
    """Each name in each form and the SPDX line, but for what is known by another id."""
    seen, out = {*KNOWN.values()}, {}
    for spdx, names in _names().items():
        forms = [f"SPDX-License-Identifier: {spdx}", *(f.format(x) for x in dict.fromkeys([*names, spdx]) for f in FORMS)]
        for suffix in ("only", "or-later") if "GPL" in spdx else ():
            forms.append(f"SPDX-License-Identifier: {spdx}-{suffix}")
        out |= {f"{spdx}-notice-{i}": t for i, t in enumerate(forms, 10) if t not in seen}
    return out


KNOWN |= _notices()


def canonical_lines(text: Column) -> Column:
    """The canonical form of each line that has a word in it, as array<string>; words are two spaces apart."""
    c = F.regexp_replace(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), COPYRIGHT_LINE, "")
    other = F.create_map(*(F.lit(x) for pair in SPELLINGS.items() for x in pair))
    spelled = lambda w: F.when(w.isin(*SPELLINGS), F.element_at(other, w)).otherwise(w)
    words = lambda line: F.regexp_extract_all(line, F.lit("[a-z0-9]+"), 0)
    lines = F.transform(F.split(c, "\n", -1), lambda line: F.array_join(F.transform(words(line), spelled), "  "))
    return F.filter(lines, lambda x: x != "")


def digest(canonical: Column) -> Column:
    return F.sha2(canonical.cast("binary"), 256)


def known_digests(licenses: DataFrame) -> DataFrame:
    """``digest``, ``license_id`` and length ``n`` (of the canonical form) of each known text; of texts that agree, the smallest id."""
    d = licenses.select("license_id", F.array_join(canonical_lines(F.col("text")), "  ").alias("c")).where("c <> ''")
    return d.groupBy(digest(F.col("c")).alias("digest")).agg(F.min("license_id").alias("license_id"), F.min(F.char_length("c")).alias("n"))


def known_licenses(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([*KNOWN.items()], "license_id string, text string")


def scan(docs: DataFrame, licenses: DataFrame, key: str = "doc_id", text: str = "text", max_broadcast: int = 10_000) -> DataFrame:
    """``key``, ``digest``, ``license_id`` (of the whole text, or null), ``n_notices`` and ``notices`` (ids of its lines, sorted) for each row.

    Texts are read once: what is kept of each is the digest of the whole and those of the
    lines that are as long as some known text (of all lines, if more than ``max_broadcast`` texts are known).
    """
    known = stored(known_digests(licenses), "known-licences")
    lines, few = F.col("lines"), known.count() <= max_broadcast
    src = docs.select(F.col(key).alias("k"), F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("h"), canonical_lines(F.col(text)).alias("lines"))
    if few:
        sizes = [r.n for r in known.select("n").distinct().collect()]  # of max_broadcast texts at most
        lines = F.filter(lines, lambda x: F.char_length(x).isin(sizes))
    src = stored(src.select("k", "h", digest(F.array_join("lines", "  ")).alias("digest"), F.transform(lines, digest).alias("lines")), "licence-digests")
    known = F.broadcast(known.select("digest", "license_id")) if few else known.select("digest", "license_id")
    whole = src.select("k", "h", "digest").join(known, "digest", "left")
    hits = src.select("k", "h", F.explode("lines").alias("digest")).join(known, "digest").groupBy("k", "h", "license_id").agg(F.count(F.lit(1)).alias("n"))
    per = hits.groupBy("k", "h").agg(F.sum("n").alias("n_notices"), F.array_join(F.array_sort(F.collect_set("license_id")), ",").alias("notices"))
    per = per.withColumnsRenamed({"k": "k2", "h": "h2"})
    # Rows that repeat are in hits as often as in docs; a notice is counted once for each of its lines.
    copies = whole.groupBy("k", "h").agg(F.count(F.lit(1)).alias("copies"), F.first("digest").alias("digest"), F.first("license_id").alias("license_id"))
    out = copies.join(per, F.col("k").eqNullSafe(F.col("k2")) & (F.col("h") == F.col("h2")), "left")
    out = out.select(
        F.col("k").alias(key),
        "digest",
        "license_id",
        F.coalesce(F.col("n_notices") / F.col("copies"), F.lit(0)).cast("long").alias("n_notices"),
        F.coalesce("notices", F.lit("")).alias("notices"),
        F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy"),
    )
    return out.drop("_copy")


def op1_licenses(spark, sf_dir: str) -> DataFrame:
    """License scan over the whole of ``documents`` with the known texts."""
    return scan(table(spark, sf_dir, "documents"), known_licenses(spark))


def _sql_lines(text: str) -> str:
    c = f"regexp_replace(translate(coalesce({text}, ''), '{UPPER}', '{UPPER.lower()}'), '{COPYRIGHT_LINE}', '', 'g')"
    c = f"'  ' || replace(regexp_replace({c}, '[^a-z0-9\\n]+', '  ', 'g'), chr(10), '  ' || chr(10) || '  ') || '  '"
    for other, word in SPELLINGS.items():
        c = f"replace({c}, ' {other} ', ' {word} ')"
    return f"list_filter(list_transform(string_split({c}, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '')"


OP1_SQL = f"""
WITH raw(license_id, text) AS (VALUES {", ".join("('%s', '%s')" % (k, v.replace("'", "''")) for k, v in KNOWN.items())}),
known AS (
  SELECT sha256(array_to_string({_sql_lines("text")}, '  ')) AS digest, min(license_id) AS license_id
  FROM raw GROUP BY 1),
d AS (SELECT doc_id, {_sql_lines("text")} AS lines FROM documents),
w AS (SELECT doc_id, sha256(array_to_string(lines, '  ')) AS digest FROM d),
l AS (SELECT doc_id, sha256(unnest(lines)) AS digest FROM d),
n AS (
  SELECT doc_id, count(*) AS n_notices, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS notices
  FROM l JOIN known USING (digest) GROUP BY doc_id)
SELECT w.doc_id AS doc_id, w.digest AS digest, known.license_id AS license_id,
       coalesce(n.n_notices, 0) AS n_notices, coalesce(n.notices, '') AS notices
FROM w LEFT JOIN known USING (digest) LEFT JOIN n ON n.doc_id = w.doc_id
"""
