"""Licence scan by canonical digest lookup, in DataFrame operations only.

Whole texts, single lines (notices stand on lines of their own) and runs of
paragraphs are brought to a canonical form and hashed; the digests are joined to
those of the known licence texts, and a known text of several paragraphs is found
by its first one's digest and compared in all of them. Canonical form: lines that
name a rights holder go, letters are lower case, everything that is no letter or
digit is a single space (so comment marks go), equivalent spellings are one, as
are the ways to call the work and to begin a notice's sentence, and a licence's
title goes from the front.
"""

from __future__ import annotations

from importlib.resources import files

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import only

#: Public licence notices and short licence texts, by identifier.
KNOWN = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
]
#: Names by which notices call a licence.
NAMES = {
    "MIT": ("MIT License",),
    "MIT-0": ("MIT No Attribution License", "MIT-0 License"),
    "ISC": ("ISC License",),
    "0BSD": ("Zero-Clause BSD License", "0BSD License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License", "BSD-2-Clause License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "3-Clause BSD License", "New BSD License", "Modified BSD License", "Revised BSD License", "BSD-3-Clause License"),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache License v2.0", "Apache 2.0 License", "Apache 2 License", "Apache-2.0 License", "Apache Software License, Version 2.0"),
    "GPL-2.0": ("GNU General Public License, version 2", "GNU General Public License v2.0", "GNU GPL v2", "GNU GPLv2", "GPLv2", "GPL v2", "GPL-2.0 License", "GPLv2 License", "GPL version 2"),
    "GPL-3.0": ("GNU General Public License, version 3", "GNU General Public License v3.0", "GNU GPL v3", "GNU GPLv3", "GPLv3", "GPL v3", "GPL-3.0 License", "GPLv3 License", "GPL version 3"),
    "LGPL-2.1": ("GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v2.1", "GNU LGPL v2.1", "LGPLv2.1", "LGPL v2.1", "LGPL-2.1 License", "LGPL version 2.1"),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3.0", "GNU LGPL v3", "GNU LGPLv3", "LGPLv3", "LGPL v3", "LGPL-3.0 License", "LGPL version 3"),
    "AGPL-3.0": ("GNU Affero General Public License, version 3", "GNU Affero General Public License v3.0", "GNU AGPL v3", "GNU AGPLv3", "AGPLv3", "AGPL v3", "AGPL-3.0 License", "AGPL version 3"),
    "MPL-2.0": ("Mozilla Public License, Version 2.0", "Mozilla Public License 2.0", "Mozilla Public License v2.0", "MPL 2.0", "MPLv2", "MPL-2.0 License"),
    "EPL-2.0": ("Eclipse Public License, Version 2.0", "Eclipse Public License 2.0", "Eclipse Public License v2.0", "EPL 2.0", "EPL-2.0 License"),
    "EPL-1.0": ("Eclipse Public License, Version 1.0", "Eclipse Public License 1.0", "Eclipse Public License v1.0", "EPL 1.0", "EPL-1.0 License"),
    "BSL-1.0": ("Boost Software License, Version 1.0", "Boost Software License 1.0", "BSL-1.0 License"),
    "Unlicense": ("Unlicense",),
    "Zlib": ("zlib License",),
    "CC0-1.0": ("CC0 1.0", "CC0 1.0 Universal", "CC0 1.0 License", "Creative Commons Zero v1.0 Universal License"),
    "CC-BY-4.0": ("CC BY 4.0", "CC BY 4.0 License", "CC-BY 4.0", "Creative Commons Attribution 4.0 International License", "Creative Commons Attribution 4.0 License"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "CC BY-SA 4.0 License", "Creative Commons Attribution-ShareAlike 4.0 International License", "Creative Commons Attribution-ShareAlike 4.0 License"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "CC BY-NC 4.0 License", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC-BY-3.0": ("CC BY 3.0", "CC BY 3.0 License", "Creative Commons Attribution 3.0 Unported License"),
    "CC-BY-SA-3.0": ("CC BY-SA 3.0", "CC BY-SA 3.0 License", "Creative Commons Attribution-ShareAlike 3.0 Unported License"),
}
#: What notices call the work, as whole words in canonical form; they are one.
WORKS = "library|software|file|package|module|code|project"
#: How a notice's sentence begins, in canonical form; all say the same.
LEAD = "(?:(?:this (?:program|source code|repository|work)|the (?:code|source code|software|project|program)|it) is )?(?:licensed|released|distributed|available|made available|provided) under (?:the )?"
#: The notice that stands at the head of files under a GNU licence, its licences, versions and closing sentences.
GNU_FREE = "This program is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation{version}."
GNU_HOPE = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details."
GNU_COPY = "You should have received a copy of the {name} along with this program{end}."
GNU_LICENSES = (("GPL-1.0", "GNU General Public License", "1"), ("GPL-2.0", "GNU General Public License", "2"), ("GPL-3.0", "GNU General Public License", "3"), ("LGPL-2.0", "GNU Library General Public License", "2"), ("LGPL-2.1", "GNU Lesser General Public License", "2.1"), ("LGPL-3.0", "GNU Lesser General Public License", "3"), ("AGPL-3.0", "GNU Affero General Public License", "3"))
GNU_VERSIONS = (", either version {v} of the License, or (at your option) any later version", ", either version {v}, or (at your option) any later version", ", version {v} of the License", ", version {v}", " version {v} of the License", " version {v}")
GNU_ENDS = ("", ". If not, see <https://www.gnu.org/licenses/>", ". If not, see <https://gnu.org/licenses/>", "; if not, see <https://www.gnu.org/licenses/>", "; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA", "; if not, write to the Free Software Foundation, Inc., 59 Temple Place, Suite 330, Boston, MA 02111-1307 USA")
#: The notice at the head of files under the MPL.
MPL_HEADER = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
#: Spellings that licence matching treats as one, as whole words.
SPELLINGS = [("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("acknowledgement", "acknowledgment"), ("favour", "favor"), ("organisation", "organization"), ("merchantibility", "merchantability"), ("non commercial", "noncommercial"), ("non infringement", "noninfringement"), ("sub license", "sublicense"), ("copyright owner", "copyright holder"), ("copyright owners", "copyright holders"), ("https", "http")]
#: Titles that stand before a licence or are left out, in canonical form; a longer one first.
TITLES = ["the mit license mit", "the mit license", "mit license", "mit no attribution", "the isc license", "isc license", "bsd 3 clause new or revised license", "the bsd 3 clause license", "bsd 3 clause license", "bsd 2 clause simplified license", "the bsd 2 clause license", "bsd 2 clause license", "bsd zero clause license", "zero clause bsd license", "zlib license", "boost software license v1 0 august 17th 2003", "the unlicense"]
#: Lines that name a rights holder, by a year or a sign; they differ from file to file. A licence's own words about copyright stay.
COPYRIGHT_LINE = r"(?imd)^[^\p{L}\p{N}\n]*(?:(?:portions )?copyright[^\p{L}\p{N}\n]+(?:\(c\)|©|[<\[{(]?(?:[0-9]{4}|year|yyyy))[^\n]*|(?:\(c\)|©)[^\p{L}\n]*[0-9]{4}[^\n]*|copyright ©[^\n]*|all rights reserved[^\p{L}\p{N}\n]*)$"
#: Between paragraphs: a line break, nothing that is a letter or digit, and a line break.
GAP = r"\n[^\p{L}\p{N}]*\n"
#: Every known text holds one of these in its lower-case letters, so a text without any can't be one.
MARKS = ("licen", "permission", "released", "redistribut", "distributed under", "available under", "provided under")
_END = "END OF TERMS AND CONDITIONS"


def sentences() -> list[tuple[str, str]]:
    """(identifier, notice): a licence's names in one sentence each, the identifier lines, and the heads of files under GNU licences and the MPL.

    A GNU head is known by its first paragraph, and whole where no blank line parts it.
    """
    out = [(i, f"Licensed under the {n}.") for i, names in NAMES.items() for n in names]
    for i in sorted({*NAMES, *(k for k, _, _ in GNU_LICENSES), "MPL-1.1", "Artistic-1.0", "GFDL-1.2", "GFDL-1.3"}):
        ends = ("", "-only", "-or-later", "+") if "GPL" in i or "GFDL" in i else ("",)
        out += [(i, f"SPDX-License-Identifier: {i}{e}") for e in ends]
    for i, name, v in GNU_LICENSES:
        for version in GNU_VERSIONS:
            head, hope = GNU_FREE.format(name=name, version=version.format(v=v)), GNU_HOPE.format(name=name)
            out += [(i, head), (i, f"{head} {hope}")]
            out += [(i, f"{head} {hope} {GNU_COPY.format(name=name, end=e)}") for e in GNU_ENDS]
    return [*out, ("MPL-2.0", MPL_HEADER)]


def known_texts() -> list[tuple[str, str]]:
    """(identifier, text) of the notices above and of the standard texts beside this module; where an appendix follows the terms, also without it."""
    out = [*KNOWN, *sentences()]
    for f in sorted(files(__package__).joinpath("licenses").iterdir(), key=lambda f: f.name):
        name, text = f.name.removesuffix(".txt").removesuffix(".regents"), f.read_text(encoding="utf-8")
        out.append((name, text))
        if _END in text:
            out.append((name, text[: text.index(_END) + len(_END)]))
    return out


def canonical(text: Column) -> Column:
    """The canonical form of a text."""
    out = F.lower(F.regexp_replace(text, COPYRIGHT_LINE, " "))
    out = F.concat(F.lit(" "), F.regexp_replace(out, r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    for a, b in SPELLINGS * 2:  # twice, as neighbours share a blank
        out = F.replace(out, F.lit(f" {a} "), F.lit(f" {b} "))
    out = F.regexp_replace(out, f" this (?:{WORKS}) ", " this program ")
    out = F.trim(F.regexp_replace(out, " (?:version|v) ([0-9])", " v$1"))
    out = F.regexp_replace(out, f"^(?:{'|'.join(TITLES)}) ", "")
    return F.regexp_replace(out, f"^{LEAD}", "licensed under ")


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def paragraph_digests(text: Column) -> Column:
    """The digests of a text's paragraphs in order, without those that canonical form leaves empty."""
    return F.transform(F.filter(F.transform(F.split(text, GAP, -1), canonical), lambda c: c != ""), lambda c: F.sha2(c, 256))


def _marked(text: Column, marks: tuple[str, ...]) -> Column:
    low = F.lower(text)
    found = F.contains(low, F.lit(marks[0]))
    for m in marks[1:]:
        found = found | F.contains(low, F.lit(m))
    return found


def scan_licenses(docs: DataFrame, known: list[tuple[str, str]] | None = None, key: str = "doc_id", text: str = "text", marks: tuple[str, ...] = MARKS) -> DataFrame:
    """(doc_id, license_id, n_lines, n_paragraph_runs, whole_text): each licence of which the whole text, a line of it, or a run of its paragraphs is a known text.

    n_lines counts the lines that match, n_paragraph_runs the places where
    paragraphs one after the other are a known text's (a notice wrapped over lines,
    a licence before code), whole_text says whether the entire text is one (a text
    of one line matches as all three). Documents without a match have no row. A
    long text is brought to its canonical form as a whole, a few times its size. Null
    and empty texts match nothing; repeated rows add up under their key, rows with
    a null key under null. Other columns are not read, so names never clash; an
    empty table gives an empty one. `known` is a list, as it is broadcast; texts
    and lines without any of `marks` are passed over, which every known text must
    hold (else none are).
    """
    spark = docs.sparkSession
    known = known_texts() if known is None else known
    if not all(any(m in k.lower() for m in marks) for _, k in known):
        marks = ("",)
    rows = spark.createDataFrame(known, "license_id string, known_text string")
    whole = rows.select("license_id", digest(F.col("known_text")).alias("digest")).distinct()
    runs = rows.select("license_id", paragraph_digests(F.col("known_text")).alias("run")).distinct().select("license_id", "run", F.col("run")[0].alias("digest"))
    src = only(docs, doc_id=key, text=text).where(_marked(F.col("text"), marks))
    lines = F.filter(F.split("text", "\n", -1), lambda x: _marked(x, marks))
    units = src.select("doc_id", F.posexplode(F.concat(F.array("text"), lines)).alias("pos", "unit"))
    hits = units.select("doc_id", (F.col("pos") == 0).alias("is_whole"), digest(F.col("unit")).alias("digest")).join(F.broadcast(whole), "digest").select("doc_id", "license_id", F.when(F.col("is_whole"), "whole").otherwise("line").alias("kind"))
    paragraphs = src.select("doc_id", paragraph_digests(F.col("text")).alias("all")).select("doc_id", "all", F.posexplode("all").alias("pos", "digest"))
    found = paragraphs.join(F.broadcast(runs), "digest").where(F.slice("all", F.col("pos") + 1, F.size("run")) == F.col("run")).select("doc_id", "license_id", F.lit("run").alias("kind"))
    by = hits.unionByName(found).groupBy("doc_id", "license_id")
    return by.agg(F.count_if(F.col("kind") == "line").alias("n_lines"), F.count_if(F.col("kind") == "run").alias("n_paragraph_runs"), F.max(F.col("kind") == "whole").alias("whole_text"))


def sql_canonical(x: str) -> str:
    """The canonical form as DuckDB SQL."""
    pattern = COPYRIGHT_LINE.replace("(?imd)", "").replace("'", "''")
    out = f"lower(regexp_replace({x}, '{pattern}', ' ', 'gim'))"
    out = rf"' ' || regexp_replace({out}, '[^\p{{L}}\p{{N}}]+', ' ', 'g') || ' '"
    for a, b in SPELLINGS * 2:
        out = f"replace({out}, ' {a} ', ' {b} ')"
    out = f"regexp_replace({out}, ' this (?:{WORKS}) ', ' this program ', 'g')"
    out = rf"trim(regexp_replace({out}, ' (?:version|v) ([0-9])', ' v\1', 'g'), ' ')"
    out = f"regexp_replace({out}, '^(?:{'|'.join(TITLES)}) ', '')"
    return f"regexp_replace({out}, '^{LEAD}', 'licensed under ')"


def oracle() -> str:
    """The scan as DuckDB SQL, without marks."""
    quoted = ", ".join("('{}', '{}')".format(a, b.replace("'", "''")) for a, b in known_texts())
    digests = f"list_transform(list_filter(list_transform(string_split_regex(%s, '{GAP}'), lambda p: {sql_canonical('p')}), lambda c: c <> ''), lambda c: sha256(c))"
    return f"""
WITH texts(license_id, known_text) AS (VALUES {quoted}),
known AS (SELECT DISTINCT license_id, sha256({sql_canonical('known_text')}) AS digest FROM texts),
runs AS (SELECT DISTINCT license_id, {digests % 'known_text'} AS run FROM texts),
units AS (
  SELECT doc_id, text AS unit, 'whole' AS kind FROM documents WHERE text IS NOT NULL
  UNION ALL
  SELECT doc_id, unnest(string_split(text, chr(10))) AS unit, 'line' AS kind FROM documents WHERE text IS NOT NULL),
paragraphs AS (SELECT doc_id, {digests % 'text'} AS digests FROM documents WHERE text IS NOT NULL),
places AS (SELECT doc_id, digests, unnest(range(1, len(digests) + 1)) AS place FROM paragraphs),
hits AS (
  SELECT doc_id, license_id, kind FROM (SELECT doc_id, kind, sha256({sql_canonical('unit')}) AS digest FROM units) JOIN known USING (digest)
  UNION ALL
  SELECT doc_id, license_id, 'run' AS kind FROM places JOIN runs ON places.digests[place] = runs.run[1] WHERE list_slice(digests, place, place + len(run) - 1) = run)
SELECT doc_id, license_id, CAST(count(*) FILTER (kind = 'line') AS BIGINT) AS n_lines, CAST(count(*) FILTER (kind = 'run') AS BIGINT) AS n_paragraph_runs, bool_or(kind = 'whole') AS whole_text
FROM hits GROUP BY doc_id, license_id"""
