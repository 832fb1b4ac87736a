"""License scans: canonical texts are hash-joined to the digests of known licences, in Spark SQL functions only.

Canonical form: lower case, lines that only state a copyright or reserve all rights dropped, as are the numbers of list items,
everything but letters and digits a single space, equivalent spellings made one. A document's whole text is looked up, and so is each of its lines, for notices that
stand in other text. Long licences are known by the digests of their canonical texts alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread

# Published licence texts and the notices by which works are put under a licence.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD_3 = _BSD_2.replace("\n\nTHIS SOFTWARE", "\n\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\nTHIS SOFTWARE")
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""
_APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_0BSD = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
#: Full texts with the titles under which they stand; each is known bare and under each title.
TEXTS = (
    ("MIT", _MIT, ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "License: MIT", "The MIT License (MIT) =====")),
    ("ISC", _ISC, ("ISC License", "The ISC License", "ISC License (ISC)", "License: ISC")),
    ("0BSD", _0BSD, ("Zero-Clause BSD", "BSD Zero Clause License", "0BSD License", "Zero-Clause BSD (0BSD)")),
    ("BSD-2-Clause", _BSD_2, ("BSD 2-Clause License", "The BSD 2-Clause License", "BSD-2-Clause License", 'BSD 2-Clause "Simplified" License', "Simplified BSD License", "FreeBSD License", "The BSD License", "BSD License")),
    ("BSD-3-Clause", _BSD_3, ("BSD 3-Clause License", "The BSD 3-Clause License", "BSD-3-Clause License", 'BSD 3-Clause "New" or "Revised" License', "New BSD License", "Modified BSD License", "Revised BSD License", "The BSD License", "BSD License")),
    ("Zlib", _ZLIB, ("zlib License", "The zlib License", "zlib/libpng license", "The zlib/libpng License")),
    ("Unlicense", _UNLICENSE, ("The Unlicense", "Unlicense")),
    ("Unlicense", _UNLICENSE + "\n\nFor more information, please refer to <https://unlicense.org>", ("The Unlicense", "Unlicense")),
    ("Unlicense", _UNLICENSE + "\n\nFor more information, please refer to <https://unlicense.org/>", ()),
)
#: Notices by which a work is put under a licence.
NOTICES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", _APACHE_NOTICE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("all-rights-reserved", "All rights reserved."),
)
#: Licences that an SPDX line names.
IDENTIFIERS = ("MIT", "ISC", "0BSD", "BSD-2-Clause", "BSD-3-Clause", "Zlib", "Unlicense", "Apache-2.0", "MPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0")
KNOWN = (
    *((name, text) for name, text, _ in TEXTS),
    *((name, f"{title}\n\n{text}") for name, text, titles in TEXTS for title in titles),
    *NOTICES,
    *((name, f"SPDX-License-Identifier: {name}") for name in IDENTIFIERS),
)
#: First word and SHA-256 of the canonical texts of long licences as their publishers give them: whole, and without the part on how to apply them.
KNOWN_DIGESTS = (
    ("Apache-2.0", "apache", "51085de26d90e0558673739ebd868dc7d0474550fd6e4f2962eb702a1b4ac653"),
    ("Apache-2.0", "apache", "83b53f7b4c6dca95852ea0e4b5b9447bfd15c65c764ed048818607b024bd88ab"),
    ("Apache-2.0", "apache", "9cb66e97ff612a35e4f0097ae504463a5a127f95c7296d4d10f43ebc1683b083"),
    ("CC0-1.0", "creative", "877c00a42865ff0c2c3bc11b3a08fa1db220389d7885d8793171728e5964b240"),
    ("GPL-1.0", "gnu", "fbdaa6604a3a3d4d9333017936f43d7b509043ed72936cd27f6941e763258b13"),
    ("GPL-1.0", "gnu", "3d12c9dc2989c712c768ad3508b6abb2e530106d3b0abed71501eef41da8ec20"),
    ("GPL-1.0", "gnu", "52ad1d1b4e3456a70f304f7ad4847b66651c6c05ec9f23c43bff5202a5cc3a32"),
    ("GPL-2.0", "gnu", "ed4d4fd0c4fcd33b8e8a05d8391316b68d98e0bd40d2d1b8725dd95d2f301624"),
    ("GPL-2.0", "gnu", "9a4281e8772dd52ee5972b849c4123df96e36e4fb969206243d860f7cc3c5a40"),
    ("GPL-2.0", "gnu", "b61e7f8341a7d68e19143badf473eb4f02f72d02d3cda80a9093beddde98ac97"),
    ("GPL-3.0", "gnu", "ca0d5a7a35e23bc82a15550165118c444d6f9f5ede64b6210deef378cedad664"),
    ("GPL-3.0", "gnu", "502b5575da3de01064102ce458d87ef316cbb311442e5f94aa6436cd33641b68"),
    ("GPL-3.0", "gnu", "e6be321982b28297cd457b83c5b216763bd4d4ec6c069c098840f5fd60fc520e"),
    ("LGPL-2.0", "gnu", "757def95eaa0e47ad49580d84614690751e727ecbfd5a607ebc7ed6301c8307a"),
    ("LGPL-2.0", "gnu", "550e199da5eae25d6940603a484c31a0608bd18085e26630e3679c2562a45d02"),
    ("LGPL-2.0", "gnu", "328dad85228df27bf3da8b90bc2b58e800ad6eb0dcfbe11aba808087819a16df"),
    ("LGPL-2.1", "gnu", "3aa4039ab4fdedfb52d2c963c193c95b7864e4f2811bff69563fe394be9c2812"),
    ("LGPL-2.1", "gnu", "777be3aab6c8701494c2c830f14470212f7b7f53224af6e359b4f10e36fed873"),
    ("LGPL-2.1", "gnu", "4428669ad5511808eebca51e4f4c670e4195840cd525fc57342fad17a291cc9d"),
    ("LGPL-3.0", "gnu", "aa41693166276e63c9e71cfd7dc3663b36bc5fbc9ffb001af043cd6438ff0c48"),
    ("MPL-1.1", "mozilla", "5e41512795ef3335aa857b8dca76f2b71663ecec720fa8774dcae58c4216fbf2"),
    ("MPL-2.0", "mozilla", "7acfd5ba5d9a9d642a545a8180aaf499e2df4f526593ac56027999053bccc09a"),
    ("GFDL-1.2", "gnu", "c9ab9242d765e12183c6313d1caa46d1b64022bd74a8f9d2cb71bb25f416ef66"),
    ("GFDL-1.3", "gnu", "505109555591e4ce3a4618c2aeea12c032b26316f27d1601ea6e81331970c937"),
    ("Artistic-1.0", "the", "3b76f6618f28b83b2850718ba9fc1a5b0b48a39250a6bd9dfc613b7a78017ab9"),
)
#: Equivalent spellings (words, one form), applied to canonical words from left to right.
SPELLINGS = (
    ("licence", "license"), ("licenced", "licensed"), ("licences", "licenses"), ("sub license", "sublicense"), ("sublicence", "sublicense"), ("sub licence", "sublicense"), ("sub licensed", "sublicensed"), ("non infringement", "noninfringement"), ("non commercial", "noncommercial"),
    ("merchantibility", "merchantability"), ("acknowledgement", "acknowledgment"), ("acknowledgements", "acknowledgments"), ("judgement", "judgment"), ("favour", "favor"), ("labour", "labor"), ("centre", "center"), ("programme", "program"), ("offence", "offense"), ("practise", "practice"),
    ("organisation", "organization"), ("organisations", "organizations"), ("authorised", "authorized"), ("authorisation", "authorization"), ("recognise", "recognize"), ("utilisation", "utilization"), ("initialise", "initialize"), ("whilst", "while"), ("wilful", "willful"), ("per cent", "percent"),
    ("as is", "asis"), ("and or", "andor"), ("copyright owner", "copyright holder"), ("copyright owners", "copyright holders"), ("https", "http"),
)

#: Lines that only state a copyright (with a sign or a year) or only reserve all rights.
_DROPPED = r"^[^\p{L}\p{N}\n]*(copyright[^\n]*(\(c\)|©|\d{4}|all rights reserved)[^\n]*|(\(c\)|©)[^\p{L}\p{N}\n]*\d{4}[^\n]*|all rights reserved[^\p{L}\p{N}\n]*)$"
#: Numbers and letters that count the items of a list.
_BULLET = r"^[^\p{L}\p{N}\n]*(\d{1,2}|[a-z])[.)][ \t]"
_OTHER = r"[^\p{L}\p{N}]+"


def plain(text: F.Column, line: bool = False) -> F.Column:
    """The canonical form before spellings. ``line``: a single line, of which nothing is dropped."""
    out = F.lower(text)
    if not line:
        out = F.regexp_replace(F.regexp_replace(out, "(?dm)" + _DROPPED, ""), "(?dm)" + _BULLET, "")
    return F.trim(F.regexp_replace(out, _OTHER, " "))


def spelled(words: F.Column) -> F.Column:
    # Two blanks between words, so that neighbours don't share one and each is met by " word ".
    out = F.concat(F.lit(" "), F.replace(words, F.lit(" "), F.lit("  ")), F.lit(" "))
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(f" {old} ".replace(" ", "  ")[1:-1]), F.lit(f" {new} "))
    return F.trim(F.replace(out, F.lit("  "), F.lit(" ")))


def canonical(text: F.Column, line: bool = False) -> F.Column:
    return spelled(plain(text, line))


def digest(text: F.Column, line: bool = False) -> F.Column:
    return F.sha2(canonical(text, line).cast("binary"), 256)


def first_words(canonical_firsts: set[str]) -> list[str]:
    """Every word that a plain form may begin with if its canonical form begins with one of these."""
    out = set(canonical_firsts)
    while more := {old.split()[0] for old, new in SPELLINGS if new.split()[0] in out} - out:
        out |= more
    return sorted(out)


def scan(docs: DataFrame, known: tuple = KNOWN, known_digests: tuple = KNOWN_DIGESTS) -> DataFrame:
    """One row per document: doc_id, license (of the whole text, or null), n_notices, notices (distinct licences of its lines, sorted and comma-joined).

    A null or empty text has no licence and no notice, nor has a whole text of which only dropped lines are left. A text of several
    known lines counts each. Rows that repeat a doc_id each come back, with the notices of all of them together; a null doc_id gets
    no notices. Other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    docs = spread(docs)
    rows = spark.createDataFrame(list(known), "license string, text string")

    def looked_up(texts: DataFrame, text: str, line: bool, how: str) -> DataFrame:
        """``texts`` joined to the licence of each canonical text. Only those that begin as a known one does are spelled and digested."""
        found = rows.select("license", canonical(F.col("text"), line).alias("c")).where("c <> ''")
        starts = {r[0] for r in found.select(F.substring_index("c", " ", 1)).distinct().collect()}  # at most len(known)
        # A fixed table of at most len(known) + len(known_digests) rows.
        table = found.select("license", F.sha2(F.col("c").cast("binary"), 256).alias("digest"))
        table = table.unionByName(spark.createDataFrame([(k, d) for k, _, d in known_digests], "license string, digest string")).dropDuplicates(["digest"])
        words = plain(F.col(text), line)
        like = F.substring_index(words, " ", 1).isin(first_words(starts | {w for _, w, _ in known_digests}))
        return texts.select("doc_id", F.when(like, F.sha2(spelled(words).cast("binary"), 256)).alias("digest")).join(F.broadcast(table), "digest", how)

    whole = looked_up(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "text", False, "left").select("doc_id", "license")
    lines = looked_up(docs.select("doc_id", F.explode(F.split("text", "\n")).alias("line")), "line", True, "inner")
    notices = lines.groupBy("doc_id").agg(F.count("*").alias("n_notices"), F.array_join(F.array_sort(F.collect_set("license")), ",").alias("notices"))
    return whole.join(notices, "doc_id", "left").select("doc_id", "license", F.coalesce("n_notices", F.lit(0)).cast("long").alias("n_notices"), F.coalesce("notices", F.lit("")).alias("notices"))


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _canonical_sql(text: str, line: bool = False) -> str:
    out = f"lower({text})" if line else f"regexp_replace(regexp_replace(lower({text}), '(?m){_DROPPED}', '', 'g'), '(?m){_BULLET}', '', 'g')"
    out = rf"' ' || replace(trim(regexp_replace({out}, '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ', '  ') || ' '"
    for old, new in SPELLINGS:
        out = f"replace({out}, {_quoted(f' {old} '.replace(' ', '  ')[1:-1])}, {_quoted(f' {new} ')})"
    return f"trim(replace({out}, '  ', ' '))"


def oracle() -> str:
    """DuckDB SQL for ``scan`` over the table documents."""
    rows = ", ".join(f"({_quoted(k)}, {_quoted(t)})" for k, t in KNOWN)
    listed = ", ".join(f"({_quoted(k)}, {_quoted(d)})" for k, _, d in KNOWN_DIGESTS)

    def known(line: bool) -> str:
        return f"select any_value(license) as license, d from (select license, sha256({_canonical_sql('text', line)}) as d from (values {rows}) v(license, text) union all select * from (values {listed}) w(license, d)) where d <> sha256('') group by d"

    return f"""
with known as ({known(False)}), known_lines as ({known(True)}),
whole as (select doc_id, sha256({_canonical_sql("coalesce(text, '')")}) as d from documents),
lines as (select doc_id, sha256({_canonical_sql("line", True)}) as d from (select doc_id, unnest(string_split(text, chr(10))) as line from documents)),
notices as (select doc_id, count(*)::bigint as n_notices, array_to_string(list_sort(list(distinct license)), ',') as notices from lines join known_lines on lines.d = known_lines.d group by doc_id)
select whole.doc_id, known.license, coalesce(n_notices, 0)::bigint as n_notices, coalesce(notices, '') as notices
from whole left join known on whole.d = known.d left join notices on whole.doc_id = notices.doc_id
"""
