"""Licence scans by digest: texts are brought to one canonical form and looked up by its hash.

DataFrame functions only; nothing here runs Python on the executors.
"""

from __future__ import annotations

from importlib.resources import files

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlens.llm.texts import row_key

# Spellings that count as equal, as (pattern, replacement) over lower-case words.
EQUIVALENT = (
    (r"\blicenc(e|ed|es|ing)\b", "licens$1"),
    (r"\b(author|organ|recogn|real|util|custom|general|normal|optim|personal|summar|synchron)"
     r"is(e|ed|es|ing|ation|ations)\b", "$1iz$2"),
    (r"\b(fav|col|behavi|hon|lab)our(s|ed|ing|able|)\b", "$1or$2"),
    (r"\b(cent|met)re(s|)\b", "$1er$2"),
    (r"\backnowledgment(s|)\b", "acknowledgement$1"),
    (r"\b(fulfil|enrol)(s|ment|ments|)\b", "$1l$2"),
    (r"\bwhilst\b", "while"),
)
ANY_EQUIVALENT = "|".join(p for p, _ in EQUIVALENT)
# Fixed value: lines that name a holder and not a condition.
COPYRIGHT_LINE = r"^[^\p{L}\p{N}(©]*(copyright\s+(\(c\)|©|[0-9])|\(c\)\s|©|all rights reserved)"
PUNCTUATION = r"[^\p{L}\p{N}]+"

# Public licence texts and notices by their usual short names.
KNOWN = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including
without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies
of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following
conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions
of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED
TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL
THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF
CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE
INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY
SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA
OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN
CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE
INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY
SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA
OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN
CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the
authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and
to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original
software. If you use this software in a product, an acknowledgment in the product documentation would be
appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original
software.
3. This notice may not be removed or altered from any source distribution.""",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "MIT-notice": "Released under the MIT License.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-notice": "Licensed under CC BY-SA 4.0.",
}

# Titles that files put before texts which have none of their own.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "Expat License"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD", "Zero-Clause BSD License", "BSD-0-Clause License"),
    "Zlib": ("zlib License", "The zlib License", "The zlib/libpng License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The 2-Clause BSD License", 'BSD 2-Clause "Simplified" License'),
    "BSD-3-Clause": ("BSD 3-Clause License", "The 3-Clause BSD License", 'BSD 3-Clause "New" or "Revised" License'),
    "Unlicense": ("The Unlicense", "Unlicense"),
}
# Names in notices of one line.
NAMES = {
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"),
    "MIT": ("MIT License",), "ISC": ("ISC License",), "Zlib": ("zlib License",),
    "BSD-2-Clause": ("BSD 2-Clause License",), "BSD-3-Clause": ("BSD 3-Clause License",),
    "GPL-2.0": ("GNU General Public License, version 2", "GNU GPL v2"),
    "GPL-3.0": ("GNU General Public License, version 3", "GNU GPL v3"),
    "LGPL-2.1": ("GNU Lesser General Public License, version 2.1",),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3",),
    "AGPL-3.0": ("GNU Affero General Public License, version 3",),
    "MPL-2.0": ("Mozilla Public License, Version 2.0", "Mozilla Public License 2.0"),
    **{f"CC-{x}-4.0": (f"CC {x.replace('-', ' ', 1)} 4.0",) for x in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND")},
    "CC0-1.0": ("CC0 1.0",),
}
NOTICES = ("Licensed under {}", "Licensed under the {}", "Released under {}", "Released under the {}",
           "Distributed under the {}", "This work is licensed under {}", "This work is licensed under the {}",
           "This project is licensed under the {}", "This software is licensed under the {}")
END = "END OF TERMS AND CONDITIONS"


def common_texts(spark: SparkSession) -> DataFrame:
    """(license_id, text): KNOWN, the whole texts beside this module, and their usual forms and notices.

    Texts come with each of their titles and without, and up to their end of terms as well as
    with what follows it.
    """
    whole_texts = {k: t for k, t in KNOWN.items() if not k.endswith("-notice")}
    for file in files("claimlens.llm").joinpath("licence_texts").iterdir():
        whole_texts[file.name.removesuffix(".txt")] = file.read_text(encoding="utf-8")
    rows = list(KNOWN.items())
    for name, text in sorted(whole_texts.items()):
        rows += [(name, text), *((name, f"{title}\n\n{text}") for title in TITLES.get(name, ()))]
        if END in text:
            rows.append((name, text[:text.index(END) + len(END)]))
    rows += [(f"{k}-notice", notice.format(n)) for k, names in NAMES.items() for n in names for notice in NOTICES]
    return spark.createDataFrame(rows, "license_id string, text string")


def canonical_line(line: Column) -> Column:
    """Lower-case words of a line by single spaces; empty for copyright lines."""
    words = F.trim(F.regexp_replace(line, PUNCTUATION, " "))
    same = words
    for pattern, new in EQUIVALENT:
        same = F.regexp_replace(same, pattern, new)
    words = F.when(words.rlike(ANY_EQUIVALENT), same).otherwise(words)
    return F.when(line.rlike(COPYRIGHT_LINE), F.lit("")).otherwise(words)


def canonical_lines(text: Column) -> Column:
    lines = F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), "\n", -1)
    return F.transform(lines, canonical_line)


def digest(words: Column) -> Column:
    """Digest of a canonical text; null if nothing is left of it."""
    return F.when(words != "", F.sha2(words, 256))


def whole(lines: Column) -> Column:
    return F.array_join(F.filter(lines, lambda x: x != ""), " ")


def known_digests(spark: SparkSession, texts: DataFrame | None = None) -> DataFrame:
    """(digest, license_id) of known texts: rows of ``license_id`` and ``text``, default ``KNOWN``.

    Texts of equal digest are one entry under the name first in the alphabet; texts with nothing
    left, and rows without a name, are no entries.
    """
    rows = texts if texts is not None else spark.createDataFrame(
        list(KNOWN.items()), "license_id string, text string")
    rows = rows.select("license_id", digest(whole(canonical_lines(F.col("text")))).alias("digest"))
    return rows.where(F.col("digest").isNotNull() & F.col("license_id").isNotNull()).groupBy(
        "digest").agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, known: DataFrame | None = None, doc_id: str = "doc_id",
         text: str = "text") -> DataFrame:
    """Licences by digest: of each whole text, and of each of its lines taken as a text.

    Columns: the key, ``text_digest`` (null if only copyright lines, punctuation or nothing),
    ``license_id`` (known text equal to the whole text, else null), ``n_license_lines`` and
    ``line_licenses`` (sorted names, comma-joined, empty if none).  Repeated rows each give a
    row; other columns are not looked at.  ``known`` is (digest, license_id), by default of
    ``common_texts``.

    Digests are made in the map; only keys and digests move.  Line digests meet the known ones
    before they are grouped, and one document's lines are grouped by counts and a set of names.
    """
    spark = docs.sparkSession
    known = known if known is not None else known_digests(spark, common_texts(spark))
    rows = docs.select(F.col(doc_id).alias("id"), row_key(doc_id, F.col(text).cast("string")).alias("key"),
                       canonical_lines(F.col(text)).alias("lines"))
    lines = rows.select("key", F.posexplode("lines").alias("at", "words")).where("words != ''")
    found = lines.select("key", "at", digest(F.col("words")).alias("digest")).join(known, "digest")
    # repeated rows share their key, so a line counts once by its place
    found = found.groupBy("key", "at").agg(F.first("license_id").alias("license_id"))
    per_doc = found.groupBy("key").agg(
        F.count("*").alias("n_license_lines"),
        F.array_join(F.array_sort(F.collect_set("license_id")), ",").alias("line_licenses"))
    texts = rows.select("id", "key", digest(whole(F.col("lines"))).alias("text_digest"))
    texts = texts.join(known.withColumnRenamed("digest", "text_digest"), "text_digest", "left")
    return texts.join(per_doc, "key", "left").select(
        F.col("id").alias(doc_id), "text_digest", "license_id",
        F.coalesce("n_license_lines", F.lit(0).cast("long")).alias("n_license_lines"),
        F.coalesce("line_licenses", F.lit("")).alias("line_licenses"))


def scan_sql() -> str:
    """The same scan of ``documents`` as DuckDB SQL."""
    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    words = f"trim(regexp_replace(l, {quoted(PUNCTUATION)}, ' ', 'g'))"
    for pattern, new in EQUIVALENT:
        words = f"regexp_replace({words}, {quoted(pattern)}, {quoted(new.replace('$', chr(92)))}, 'g')"
    line = f"CASE WHEN regexp_matches(l, {quoted(COPYRIGHT_LINE)}) THEN '' ELSE {words} END"
    lines = f"list_transform(string_split(lower(coalesce(text, '')), chr(10)), lambda l: {line})"
    known = ", ".join(f"({quoted(k)}, {quoted(t)})" for k, t in KNOWN.items())
    return f"""
WITH own AS (SELECT doc_id, {lines} AS lines FROM documents),
given AS (SELECT license_id, {lines} AS lines FROM
  (VALUES {known}) v(license_id, text)),
known AS (SELECT sha256(array_to_string(list_filter(lines, lambda x: x != ''), ' ')) AS digest,
  min(license_id) AS license_id FROM given GROUP BY 1),
texts AS (SELECT doc_id, array_to_string(list_filter(lines, lambda x: x != ''), ' ') AS words FROM own),
each AS (SELECT doc_id, unnest(lines) AS words FROM own),
hit AS (SELECT doc_id, license_id FROM each JOIN known ON words != '' AND sha256(words) = digest),
per_doc AS (SELECT doc_id, count(*) AS n, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS ids
  FROM hit GROUP BY 1)
SELECT t.doc_id, CASE WHEN words != '' THEN sha256(words) END AS text_digest, k.license_id,
  coalesce(n, 0) AS n_license_lines, coalesce(ids, '') AS line_licenses
FROM texts t LEFT JOIN known k ON words != '' AND sha256(words) = k.digest
LEFT JOIN per_doc USING (doc_id)"""
