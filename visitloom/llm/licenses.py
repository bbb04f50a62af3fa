"""Licence detection by canonical digest lookup.

A text is brought to canonical form (case, copyright lines, equivalent spellings, punctuation and
white space), and the SHA-256 of the whole canonical form is joined with the digests of known
licences. The units looked up are the whole document, each of its blocks (between empty lines) and
each of its lines, of any length. All of it is Spark SQL; only digests are joined.

A unit is brought to canonical form only if it holds one of a few words, chosen from the registry
in use so that no known text is without one (``cues``): others cannot have a known digest.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from visitloom.llm.common import as_text, only

# Equivalent spellings, as (pattern, replacement), applied in this order to lower-case words with one space between them.
SPELLINGS = [
    (r"\bhttps? ", ""),
    ("licence", "license"),
    ("sub license", "sublicense"),
    ("copyright owner", "copyright holder"),
    ("per cent", "percent"),
    ("organisation", "organization"),
    ("fulfil ", "fulfill "),
    ("judgement", "judgment"),
    ("whilst", "while"),
    ("wilful", "willful"),
    ("non commercial", "noncommercial"),
    ("version ([0-9])", "v$1"),
    ("gnu general public license", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("(creative commons|cc) by", "cc by"),
]
# A line that is a copyright notice: the word and a year, (c), "by" or a placeholder; or "all rights reserved" alone.
# Every line stands between two line ends of its own when these are looked for.
NOTICE_LINES = [
    r"\n[ \t#*/;-]*(portions )?copyright[ \t:,]*(\(c\)|©|&copy;|by |[<{\[]|[^\n]*(19|20)[0-9][0-9])[^\n]*\n",
    r"\n[ \t#*/;-]*(\(c\)|©)[ \t]*(copyright[ \t:,]*)?([<{\[]|(19|20)[0-9][0-9])[^\n]*\n",
    r"\n[ \t#*/;-]*all rights reserved[ \t\r.;*/#-]*\n",
]

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""

BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
BSD_ONE = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
BSD_TWO = "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
BSD_THREE = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
BSD_2 = "\n\n".join([BSD_HEAD, BSD_ONE, BSD_TWO, BSD_TAIL])
BSD_3 = "\n\n".join([BSD_HEAD, BSD_ONE, BSD_TWO, BSD_THREE, BSD_TAIL])

#: Known texts: (licence, form, text).
KNOWN: list[tuple[str, str, str]] = [
    ("MIT", "text", MIT),
    ("MIT", "text", "MIT License\n\n" + MIT),
    ("MIT", "text", "The MIT License (MIT)\n\n" + MIT),
    ("ISC", "text", ISC),
    ("ISC", "text", "ISC License\n\n" + ISC),
    ("BSD-2-Clause", "text", BSD_2),
    ("BSD-2-Clause", "text", "BSD 2-Clause License\n\n" + BSD_2),
    ("BSD-3-Clause", "text", BSD_3),
    ("BSD-3-Clause", "text", "BSD 3-Clause License\n\n" + BSD_3),
    ("Apache-2.0", "notice", APACHE_NOTICE),
    ("Apache-2.0", "line", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "line", "Released under the MIT License."),
    ("MIT", "line", "Licensed under the MIT License."),
    ("GPL-3.0", "line", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "line", "Licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "line", "Licensed under the GNU General Public License, version 2."),
    ("BSD-3-Clause", "line", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", "line", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "line", "Licensed under the BSD 2-Clause License."),
    ("MPL-2.0", "line", "Licensed under the Mozilla Public License, version 2.0."),
    ("CC-BY-4.0", "line", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "line", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "line", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "line", "Released under CC0 1.0."),
    ("Proprietary", "line", "All rights reserved."),
]


#: Whole texts kept as files beside this module, and where the part ends that is often given alone.
LONG_TEXTS = ["Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0"]
END_OF_TERMS = "END OF TERMS AND CONDITIONS"


def known_texts() -> list[tuple[str, str, str]]:
    """``KNOWN`` and the long texts, whole and, where they have an appendix, without it."""
    out = list(KNOWN)
    for name in LONG_TEXTS:
        body = (Path(__file__).parent / "license_texts" / f"{name}.txt").read_text("utf-8")
        out.append((name, "text", body))
        if END_OF_TERMS in body:
            terms = body[: body.index(END_OF_TERMS)]
            out += [(name, "text", terms), (name, "text", terms + END_OF_TERMS)]
    return out


def canonical(text: Column) -> Column:
    """The canonical form of a text. A text that is a copyright notice and nothing else keeps its words."""

    def words(c: Column) -> Column:
        c = F.regexp_replace(c, r"[^\p{L}\p{N}]+", " ")
        for pattern, to in SPELLINGS:
            c = F.regexp_replace(c, pattern, to)
        return F.trim(c)

    low = F.lower(text)
    bare = F.concat(F.lit("\n"), F.replace(low, F.lit("\n"), F.lit("\n\n")), F.lit("\n"))
    for pattern in NOTICE_LINES:
        bare = F.regexp_replace(bare, pattern, "\n")
    return F.when(words(bare) == "", words(low)).otherwise(words(bare))


def coded(spark: SparkSession, known: list[tuple[str, str, str]] | None = None) -> list[tuple[str, str]]:
    """(canonical form, license) of the known texts, the driver's small registry; of equal forms the first counts."""
    rows = spark.createDataFrame(known_texts() if known is None else known, "license string, form string, body string")
    out: dict[str, str] = {}
    for r in rows.coalesce(1).select("license", canonical(F.col("body")).alias("c")).filter("c <> ''").collect():
        out.setdefault(r["c"], r["license"])
    return list(out.items())


def cues(forms: list[str]) -> str:
    """A pattern that the lower-case form of every text with one of these canonical forms holds.

    A word of a canonical form stands letter by letter in the text it came from, unless an
    equivalent spelling made it. So each form gives its longest word that holds no such outcome, or
    the plain alternatives of one that does, unless an earlier form's cue covers it.
    """
    plain = [(p, to) for p, to in SPELLINGS if p.isalpha() and to.isalpha()]
    made = {w for _, to in SPELLINGS for w in re.findall("[a-z]+", to.replace("$1", ""))} - {to for _, to in plain} - {"sublicense"}
    chosen: list[str] = []

    def cue(word: str) -> str | None:
        if any(m in word for m in made if m != "v") or re.search("v[0-9]", word):
            return None
        for p, to in plain:
            if to in word or p in word:
                return f"(?:{p}|{to})"
        return re.escape(word)

    for form in sorted(forms, key=lambda f: (len(f), f)):
        words = set(form.split())
        options = {c: w for w in sorted(words) if (c := cue(w))}
        if not options:
            return ""  # such a form holds made words alone: every unit is coded
        if not any(c in options for c in chosen):
            chosen.append(max(options, key=lambda c: (len(options[c]), c)))
    return "|".join(chosen)


def scan_licenses(docs: DataFrame, known: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """Licences found: doc_id, unit ('document', 'block' or 'line'), unit_no (from 0, empty units counted), license.

    ``known``: (license, form, text) rows, ``known_texts()`` unless given. Units of more than one
    line that equal a single line's text are told by the smallest unit alone (a line before its
    block, a block before its document). Null and empty texts match nothing; rows repeated whole
    repeat their matches.
    """
    spark = docs.sparkSession
    forms = coded(spark, known)
    digests = spark.createDataFrame(forms, "c string, license string").select(F.sha2(F.col("c").cast("binary"), 256).alias("digest"), "license")
    gate = cues([c for c, _ in forms])
    base = only(docs, "doc_id", "text").select("doc_id", as_text("text").alias("body")).filter(F.lower("body").rlike(gate))
    blocks = F.transform(F.split("body", r"\n[ \t\r]*\n"), lambda b, i: F.struct(F.lit("block").alias("unit"), i.cast("long").alias("unit_no"), b.alias("body")))
    lines = F.transform(F.split("body", "\n"), lambda b, i: F.struct(F.lit("line").alias("unit"), i.cast("long").alias("unit_no"), b.alias("body")))
    whole = F.array(F.struct(F.lit("document").alias("unit"), F.lit(0).cast("long").alias("unit_no"), F.col("body").alias("body")))
    rest = F.filter(F.concat(whole, blocks), lambda u: F.instr(F.trim(u["body"]), "\n") > 0)
    units = F.filter(F.concat(rest, lines), lambda u: F.lower(u["body"]).rlike(gate))
    rows = base.select("doc_id", F.explode(units).alias("u")).select("doc_id", "u.unit", "u.unit_no", "u.body")
    found = rows.withColumn("digest", F.sha2(canonical(F.col("body")).cast("binary"), 256))
    return found.join(digests, "digest").select("doc_id", "unit", "unit_no", "license")


def op4_licenses(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return scan_licenses(docs)
