"""License scans: texts in a canonical form, looked up by digest among known licences.

The canonical form lower-cases, leaves out copyright lines, spells equivalent words one way, and keeps only letters
and digits with single blanks between. Its SHA-256 names the text; documents meet the known licences in a hash join on
it. Everything is Spark SQL.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spellings that count as equal, after the matching guidelines for licence lists.
EQUIVALENT = [
    ("licence", "license"),
    ("licences", "licenses"),
    ("licenced", "licensed"),
    ("sublicence", "sublicense"),
    ("sub license", "sublicense"),
    ("sub licence", "sublicense"),
    ("non commercial", "noncommercial"),
    ("copyright holder", "copyright owner"),
    ("copyright holders", "copyright owners"),
    ("favour", "favor"),
    ("authorisation", "authorization"),
    ("organisation", "organization"),
    ("percent", "per cent"),
    ("https", "http"),
    ("while", "whilst"),
    ("wilful", "willful"),
    ("acknowledgement", "acknowledgment"),
]

#: A line that states a copyright and nothing else: the word or sign at its start, then a year, a sign or a blank to fill.
#: Lines end at line feeds only.
COPYRIGHT_LINE = r"^[^a-z0-9\n]*(copyright[^a-z0-9\n]|\(c\)|©)[^\n]*([0-9]{4}|\(c\)|©|<|\[|all rights reserved)[^\n]*$"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words: all but digits, ASCII letters and characters from U+0080 on.
BETWEEN = r"[^0-9a-z\x{80}-\x{10FFFF}]+"

#: Licence notices and short licences.
NOTICES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be
held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter
it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If
you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not
required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original
software.
3. This notice may not be removed or altered from any source distribution.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted
provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF
THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
}

#: Where the full texts of longer licences lie, as their stewards and Debian's common-licenses give them.
FOLDER = Path(__file__).parent / "license_texts"
#: Lines that stand over the short licences in files.
TITLES = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "Expat License"],
    "ISC": ["ISC License", "The ISC License", "ISC License (ISC)"],
    "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD", "Zero-Clause BSD License", "0BSD"],
    "Zlib": ["zlib License", "The zlib License", "zlib/libpng License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The BSD 2-Clause License", "Simplified BSD License", "BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "The BSD 3-Clause License", "New BSD License", "Modified BSD License", "BSD License"],
    "Unlicense": ["The Unlicense", "Unlicense"],
}
#: First words of the long licences below their title.
BODIES = {
    "Apache-2.0": "TERMS AND CONDITIONS FOR USE",
    "Artistic-1.0-Perl": "Preamble",
    "BSD-3-Clause": "Redistribution and use",
    "BSL-1.0": "Permission is hereby granted",
    "CC0-1.0": "CREATIVE COMMONS CORPORATION IS NOT",
    "MPL-1.1": "1. Definitions",
    "MPL-2.0": "1. Definitions",
} | dict.fromkeys(["GFDL-1.2", "GFDL-1.3", "GPL-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0"], "Everyone is permitted")
END = "END OF TERMS AND CONDITIONS"


def known_texts() -> list[tuple[str, str]]:
    """(licence, text) of the notices, the short licences and the full texts, in the forms in which files hold them.

    These are: with and without the title; without what follows the end of the terms; short licences below ``All
    rights reserved.``, and with list items numbered, starred or bare.
    """
    texts = NOTICES | {f.stem: f.read_text("utf-8") for f in sorted(FOLDER.glob("*.txt"))}
    out = set()
    for name, text in texts.items():
        forms = {text}
        if name in BODIES:
            forms.add(text[text.index(BODIES[name]) :])
        if END in text:
            forms |= {x[: x.index(END) + k] for x in forms for k in (0, len(END))}
        if name in TITLES:
            body = text[text.index(BODIES[name]) :] if name in BODIES else text
            bare = re.sub(r"(?m)^(?:\*|[0-9]\.) ", "", body)
            count = iter(range(1, 10))
            numbered = re.sub(r"(?m)^\* ", lambda _: f"{next(count)}. ", body)
            forms |= {f"{t}\n\n{r}{x}" for x in (body, bare, numbered) for t in ("", *TITLES[name]) for r in ("", "All rights reserved.\n\n")}
        out |= {(name, x) for x in forms}
    return sorted(out)


def canonical(text: str | Column) -> Column:
    """The canonical form of a text; null for a null text."""
    c = F.col(text) if isinstance(text, str) else text
    c = F.regexp_replace(F.translate(c, UPPER, LOWER), "(?md)" + COPYRIGHT_LINE, " ")
    c = F.concat(F.lit(" "), F.regexp_replace(c, BETWEEN, "  "), F.lit(" "))  # each word has two blanks of its own
    for a, b in EQUIVALENT:
        c = F.replace(c, F.lit(_own(a)), F.lit(_own(b)))
    return F.trim(F.regexp_replace(c, " +", " "))


def _own(words: str) -> str:
    return " " + words.replace(" ", "  ") + " "


def canonical_sql(text: str) -> str:
    """The same as DuckDB SQL."""
    c = f"regexp_replace(translate({text}, '{UPPER}', '{LOWER}'), '(?m){COPYRIGHT_LINE}', ' ', 'g')"
    c = f"concat(' ', regexp_replace({c}, '{BETWEEN}', '  ', 'g'), ' ')"
    for a, b in EQUIVALENT:
        c = f"replace({c}, '{_own(a)}', '{_own(b)}')"
    return f"trim(regexp_replace({c}, ' +', ' ', 'g'))"


def scan_sql() -> str:
    """What ``scan`` finds of ``known_texts``, as DuckDB SQL that holds all of them."""
    rows = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in known_texts())
    return f"""
with known as (select sha256({canonical_sql('t')}) as canon_sha256, min(l) as license from (values {rows}) as x(l, t)
  where {canonical_sql('t')} <> '' group by 1),
docs as (select doc_id, case when text is null then null else sha256({canonical_sql('text')}) end as canon_sha256 from documents)
select doc_id, docs.canon_sha256, license from docs left join known on docs.canon_sha256 = known.canon_sha256"""


def digest(text: str | Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_licenses(spark: SparkSession, texts: dict[str, str] | None = None) -> DataFrame:
    """(license, license_text): ``texts`` as they are, or all of ``known_texts``."""
    rows = known_texts() if texts is None else sorted(texts.items())
    return spark.createDataFrame(rows, "license string, license_text string")


def scan(docs: DataFrame, known: DataFrame, *, text_col: str = "text", most_broadcast: int = 10_000) -> DataFrame:
    """``docs`` with canon_sha256 and license: the known licence whose canonical text equals the document's, or null.

    Null texts and texts without letters and digits match nothing; texts of any length are compared whole, and rows that
    repeat are labelled alike. An empty table gives an empty one. Other columns stay. Of known texts with one canonical form the name that
    sorts first counts. At most ``most_broadcast`` known licences are broadcast, which is checked; more are joined by
    shuffling digests. Columns of ``docs`` named like new ones are replaced.
    """
    names = known.select(digest("license_text").alias("canon_sha256"), "license", (canonical("license_text") != "").alias("some"))
    names = names.where("some").groupBy("canon_sha256").agg(F.min("license").alias("license"))
    if len(names.limit(most_broadcast + 1).collect()) <= most_broadcast:
        names = F.broadcast(names)
    docs = docs.drop("canon_sha256", "license")
    return docs.withColumn("canon_sha256", digest(text_col)).join(names, "canon_sha256", "left")
