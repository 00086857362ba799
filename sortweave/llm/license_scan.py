"""License scans by canonical digests.

A text is brought to a canonical form (case, copyright lines, punctuation and spacing, equivalent spellings)
and its SHA-256 is looked up, by a hash join, among the digests of known licences and licence notices. Units are
the entire text, and each entire line of it, as notices often stand on a line of their own. All built-in functions.

Known are the notices and short licences below, the full texts in the folder ``licenses`` (file names are their SPDX ids), the same
under their usual titles, and the SPDX line of each; or whatever table the caller gives.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sortweave.llm.common import columns_free_of, keep

# Spellings that count as equal, as stems in canonical form (lower case, single blanks).
SPELLINGS = [
    ("licenc", "licens"), ("acknowledgement", "acknowledgment"), ("authoris", "authoriz"), ("cancelled", "canceled"), ("centre", "center"), ("favour", "favor"), ("fulfilment", "fulfillment"), ("initialis", "initializ"),
    ("judgement", "judgment"), ("labour", "labor"), ("organis", "organiz"), ("programme", "program"), ("recognis", "recogniz"), ("utilis", "utiliz"), ("whilst", "while"), ("wilful", "willful"),
    ("sub licens", "sublicens"), ("non commercial", "noncommercial"), ("non infring", "noninfring"), ("per cent", "percent"), ("copyright owner", "copyright holder"), ("http ", "https "),
]

#: So many characters at the beginning of a text are the same in all spellings.
_STEADY = 3
assert all(a[:_STEADY] == b[:_STEADY] for a, b in SPELLINGS)

# Known licences and notices.
_DISCLAIMER = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n"
_SHORT = [
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("BSD-2-Clause", _BSD + _DISCLAIMER),
    ("BSD-3-Clause", _BSD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n" + _DISCLAIMER),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n3. This notice may not be removed or altered from any source distribution."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\nhttp://www.apache.org/licenses/LICENSE-2.0\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.\nThis program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.\nYou should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
]

# Titles that stand over a licence's text.
TITLES = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)"],
    "ISC": ["ISC License", "The ISC License", "ISC License (ISC)"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The 2-Clause BSD License", "BSD-2-Clause", "Simplified BSD License", 'BSD 2-Clause "Simplified" License'],
    "BSD-3-Clause": ["BSD 3-Clause License", "The 3-Clause BSD License", "BSD-3-Clause", "New BSD License", "The BSD 3-Clause License", 'BSD 3-Clause "New" or "Revised" License'],
    "Zlib": ["zlib License", "The zlib License", "The zlib/libpng License"],
    "Unlicense": ["The Unlicense", "Unlicense"],
}
_END = "END OF TERMS AND CONDITIONS"


def full_texts(folder: str | Path | None = None) -> list[tuple[str, str]]:
    """(license, text) of each text file in a folder that the driver reads; the name without .txt is the licence. A text
    that goes on after its terms end, as with how to apply them, also counts up to there."""
    found = []
    for path in sorted(Path(folder or Path(__file__).parent / "licenses").glob("*.txt")):
        text = path.read_text(encoding="utf-8")
        found.append((path.stem, text))
        if _END in text and text.split(_END, 1)[1].strip():
            terms = text.split(_END, 1)[0]
            found += [(path.stem, terms + _END), (path.stem, terms)]
    return found


def _all() -> list[tuple[str, str]]:
    texts = _SHORT + full_texts()
    bodies = [(name, text) for name, text in texts if name in TITLES and len(text) > 400]
    titled = [(name, f"{title}\n{text}") for name, text in bodies for title in TITLES[name]]
    lines = [(name, f"SPDX-License-Identifier: {name}") for name in sorted({n for n, _ in texts})]
    return list(dict.fromkeys(texts + titled + lines))


LICENSES = _all()
#: A list of known texts up to this length goes to all tasks; a longer one is joined.
SENT = 5000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A line that names a holder: a copyright word or sign, then a sign, a year or a placeholder; or one that reserves all rights.
_HOLDER = r"^[ \x09*#/;-]*(?:copyright[ \x09]+(?:\(c\)|©|[0-9<\[])|©|\(c\)[ \x09]|all rights reserved)[^\x0A]*"
_COPYRIGHT = "(?m)" + _HOLDER
_APART = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _spelled(x: Column) -> Column:
    for a, b in SPELLINGS:
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def canonical(text: Column) -> Column:
    """Lower case (A-Z), no copyright lines, words apart by single blanks, one spelling. Null becomes the empty text."""
    x = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    x = F.regexp_replace(x, _COPYRIGHT, "")
    return _spelled(F.trim(F.regexp_replace(x, _APART, " ")))


def _plain(x: Column) -> Column:
    """The canonical form of one line without a line feed, in its own spelling."""
    ascii_only = F.octet_length(x) == F.char_length(x)
    x = F.when(ascii_only, F.lower(x)).otherwise(F.translate(x, _UPPER, _LOWER))
    named = x.contains("copyright") | x.contains("©") | x.contains("(c)") | x.contains("all rights")
    return F.trim(F.regexp_replace(F.when(named, F.regexp_replace(x, _HOLDER, "")).otherwise(x), _APART, " "))


def _joined(lines: Column) -> Column:
    """The canonical form of the text that has these plain lines."""
    return _spelled(F.array_join(F.filter(lines, lambda x: x != ""), " "))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text).cast("binary"), 256)


def _sha(x: Column) -> Column:
    return F.sha2(x.cast("binary"), 256)


def known(spark: SparkSession, licenses: list[tuple[str, str]] | DataFrame | None = None) -> DataFrame:
    """(digest, license, size, begins), one row for each digest; size and begins are the canonical text's, in bytes and characters. ``licenses``: rows of (license, text)."""
    rows = licenses if isinstance(licenses, DataFrame) else spark.createDataFrame(LICENSES if licenses is None else licenses, "license string, text string")
    forms = rows.where("text is not null").select("license", canonical(F.col("text")).alias("form")).where("form <> ''")
    return forms.groupBy(_sha(F.col("form")).alias("digest")).agg(F.min("license").alias("license"), F.min(F.octet_length("form")).alias("size"), F.min(F.substring("form", 1, _STEADY)).alias("begins"))


def scan(docs: DataFrame, licenses: list[tuple[str, str]] | DataFrame | None = None, sent: int = SENT) -> DataFrame:
    """(doc_id, text_digest, license, line_licenses) for each row of (doc_id, text).

    license: of the entire text, else null. line_licenses: those of entire lines, distinct, in order, comma-separated, empty if none. Null and
    blank texts match nothing; repeated rows are judged each; an empty table gives none; further columns are left out.

    Each line is made plain once, and the text's form is made of those. Up to ``sent`` known texts, counted first, go to all tasks:
    nothing is shuffled, and only lines that begin like a known text (no spelling changes that) and are as long as one are digested. A longer list is joined instead, by digests of
    entire texts and of lines; only a row's own hits are grouped, so no group grows with the corpus.
    """
    spark = docs.sparkSession
    table = keep(known(spark, licenses), "licenses")
    rows = columns_free_of(docs, ["doc_id", "text"]).select(F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("bigint").alias("doc_id"), F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), _plain).alias("lines"))
    names = table.select("digest", "license")
    if table.count() > sent:
        rows = keep(rows.select("row_id", "doc_id", _sha(_joined(F.col("lines"))).alias("text_digest"), F.transform(F.filter("lines", lambda x: x != ""), lambda x: _sha(_spelled(x))).alias("lines")), "license-digests")
        single = rows.select("row_id", F.explode(F.array_distinct("lines")).alias("digest")).join(names, "digest")
        hits = single.groupBy("row_id").agg(F.array_join(F.array_sort(F.collect_set("license")), ",").alias("found"))  # a row's own
        whole = rows.select("row_id", "doc_id", "text_digest").join(names, F.col("text_digest") == F.col("digest"), "left").join(hits, "row_id", "left")
        return whole.select("doc_id", "text_digest", "license", F.coalesce("found", F.lit("")).alias("line_licenses"))
    entries = table.collect()
    line_licenses = F.lit("")
    if entries:
        sizes, begins, digests = sorted({r["size"] for r in entries}), sorted({r["begins"] for r in entries}), [r["digest"] for r in entries]
        of = F.create_map(*(F.lit(x) for r in entries for x in (r["digest"], r["license"])))
        begun = F.transform(F.filter("lines", lambda x: F.substring(x, 1, _STEADY).isin(begins)), _spelled)
        as_long = F.transform(F.filter(begun, lambda x: F.octet_length(x).isin(sizes)), _sha)
        line_licenses = F.array_join(F.array_sort(F.array_distinct(F.transform(F.filter(as_long, lambda x: x.isin(digests)), lambda x: of[x]))), ",")
    looked = rows.select("doc_id", _sha(_joined(F.col("lines"))).alias("text_digest"), line_licenses.alias("line_licenses"))
    return looked.join(F.broadcast(names), F.col("text_digest") == F.col("digest"), "left").select("doc_id", "text_digest", "license", "line_licenses")


def op3_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, as entire texts and entire lines."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _canonical_sql(x: str) -> str:
    x = f"regexp_replace(translate(coalesce({x}, ''), '{_UPPER}', '{_LOWER}'), '{_COPYRIGHT}', '', 'g')"
    x = f"trim(regexp_replace({x}, '{_APART}', ' ', 'g'), ' ')"
    for a, b in SPELLINGS:
        x = f"replace({x}, '{a}', '{b}')"
    return x


def sql() -> str:
    values = ", ".join("('{}', '{}')".format(a, b.replace("'", "''")) for a, b in LICENSES)
    digest_of = lambda x: f"sha256({_canonical_sql(x)})"
    return f"""WITH k AS (SELECT {digest_of('text')} AS digest, min(license) AS license FROM (VALUES {values}) AS v(license, text) WHERE {_canonical_sql('text')} <> '' GROUP BY 1),
w AS (SELECT doc_id, {digest_of('text')} AS text_digest FROM documents),
l AS (SELECT doc_id, {digest_of('line')} AS digest FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents)),
h AS (SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS line_licenses FROM l JOIN k USING (digest) GROUP BY doc_id)
SELECT w.doc_id, w.text_digest, k.license, coalesce(h.line_licenses, '') AS line_licenses FROM w LEFT JOIN k ON w.text_digest = k.digest LEFT JOIN h ON w.doc_id = h.doc_id"""
