"""Canonical digest lookup: whole texts in a normal form, hash-joined to the digests of known licence texts."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlake.llm.common import join_sized, table

# ---- fixed values: public licence texts, and spellings that count as equal ------------------
DISCLAIMER_MIT = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
DISCLAIMER_ISC = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
BSD_TWO = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
BSD_NO_NAME = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
DISCLAIMER_BSD = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
LICENSES = {  # identifier: title line, text
    "MIT": ("MIT License", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

""" + DISCLAIMER_MIT),
    "ISC": ("ISC License", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

""" + DISCLAIMER_ISC),
    "0BSD": ("BSD Zero Clause License", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

""" + DISCLAIMER_ISC),
    "BSD-2-Clause": ("BSD 2-Clause License", BSD_TWO + "\n\n" + DISCLAIMER_BSD),
    "BSD-3-Clause": ("BSD 3-Clause License", BSD_TWO + "\n\n" + BSD_NO_NAME + "\n\n" + DISCLAIMER_BSD),
    "Zlib": ("zlib License", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""),
    "Apache-2.0-notice": ("Apache License", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    "MIT-0": ("MIT No Attribution", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.

""" + DISCLAIMER_MIT),
    "BSL-1.0": ("Boost Software License - Version 1.0 - August 17th, 2003", """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    "Unlicense": ("The Unlicense", """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <http://unlicense.org/>"""),
    "MIT-reference": ("", "Released under the MIT License."),
    "Apache-2.0-reference": ("", "Licensed under the Apache License, Version 2.0."),
    "GPL-3.0-reference": ("", "This work is licensed under the GNU General Public License, version 3."),
    "CC-BY-NC-4.0-reference": ("", "Licensed under CC BY-NC 4.0."),
}
SPELLINGS = {
    "licence": "license", "licenced": "licensed", "licences": "licenses", "sub license": "sublicense", "non infringement": "noninfringement", "organisation": "organization",
    "favour": "favor", "acknowledgement": "acknowledgment", "analogue": "analog", "authorised": "authorized", "copyright owner": "copyright holder",
    "copyright owners": "copyright holders", "fulfilment": "fulfillment", "initialise": "initialize", "judgement": "judgment", "merchantibility": "merchantability",
    "modelled": "modeled", "noncommercial": "non commercial", "per cent": "percent", "programme": "program", "recognise": "recognize", "redistributions": "redistribution",
    "utilisation": "utilization", "whilst": "while", "wilful": "willful", "https": "http",
}
COPYRIGHT = r"(?im)^[\t #*/;>-]*(copyright[\t ]*(\(c\)|©|[0-9<\[{]|by\b)|\(c\)[\t ]|©|all rights reserved).*$"
MARKS = r"[\p{P}\p{S}\s]+"
# ---- end of fixed values --------------------------------------------------------------------


def canonical(text: Column) -> Column:
    """Copyright lines cut, case, punctuation and blanks made equal, spellings replaced; words with one blank between and around.

    While spellings are replaced there are two blanks between words, so that neighbours do not share one.
    """
    flat = F.concat(F.lit(" "), F.replace(F.trim(F.regexp_replace(F.lower(F.regexp_replace(text, COPYRIGHT, "")), MARKS, " ")), F.lit(" "), F.lit("  ")), F.lit(" "))
    for old, new in SPELLINGS.items():
        flat = F.replace(flat, F.lit(f" {old} ".replace(" ", "  ")[1:-1]), F.lit(f" {new} ".replace(" ", "  ")[1:-1]))
    return F.replace(flat, F.lit("  "), F.lit(" "))


def known_licenses(spark: SparkSession) -> DataFrame:
    """(license, digest) of each fixed text, with and without its title line."""
    rows = [(k, t) for k, (title, text) in LICENSES.items() for t in ([text, f"{title}\n\n{text}"] if title else [text])]
    listed = F.array(*[F.struct(F.lit(k).alias("license"), F.lit(t).alias("text")) for k, t in rows])
    return spark.range(1).select(F.inline(listed)).select("license", F.sha2(canonical(F.col("text")), 256).alias("digest"))


def scan(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """One row per document: doc_id, digest of the whole canonical text, the licence it equals (NULL: none), counts of words and copyright lines.

    ``known(license, digest)`` may be any table; of several licences with one digest the smallest name counts. NULL, empty and mark-only
    texts have the digest of no words and no licence; repeated rows give repeated equal rows; an empty table gives no rows; other
    columns are ignored. A text is one licence only as a whole: a notice inside other prose is none.
    """
    known = (known_licenses(docs.sparkSession) if known is None else known).groupBy("digest").agg(F.min("license").alias("license"))
    text = F.coalesce(F.col("text"), F.lit(""))
    read = docs.select("doc_id", canonical(text).alias("canon"), F.regexp_count(text, F.lit(COPYRIGHT)).cast("long").alias("n_copyright_lines"))
    words = F.when(F.trim("canon") == "", 0).otherwise(F.length("canon") - F.length(F.replace("canon", F.lit(" "), F.lit(""))) - 1)
    read = read.select("doc_id", F.sha2("canon", 256).alias("digest"), words.cast("long").alias("n_words"), "n_copyright_lines")
    return join_sized(read, known, ["digest"], "left").select("doc_id", "digest", F.when(F.col("n_words") > 0, F.col("license")).alias("license"), "n_words", "n_copyright_lines")


def op3_digest_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _canonical_sql(text: str) -> str:
    flat = rf"' ' || replace(trim(regexp_replace(lower(regexp_replace({text}, '{COPYRIGHT}', '', 'g')), '[\p{{P}}\p{{S}}\s]+', ' ', 'g')), ' ', '  ') || ' '"
    for old, new in SPELLINGS.items():
        old, new = (f" {x} ".replace(" ", "  ")[1:-1] for x in (old, new))
        flat = f"replace({flat}, '{old}', '{new}')"
    return f"replace({flat}, '  ', ' ')"


def _known_sql() -> str:
    rows = [(k, t) for k, (title, text) in LICENSES.items() for t in ([text, f"{title}\n\n{text}"] if title else [text])]
    return ", ".join("('{}', '{}')".format(k, t.replace("'", "''")) for k, t in rows)


SQL = rf"""
WITH k AS (SELECT sha256({_canonical_sql('t')}) AS digest, min(l) AS license FROM (VALUES {_known_sql()}) v(l, t) GROUP BY 1),
d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
c AS (SELECT doc_id, {_canonical_sql('t')} AS canon, len(regexp_extract_all(t, '{COPYRIGHT}')) AS n FROM d),
e AS (SELECT doc_id, sha256(canon) AS digest, CASE WHEN trim(canon) = '' THEN 0 ELSE length(canon) - length(replace(canon, ' ', '')) - 1 END AS n_words, n FROM c)
SELECT doc_id, e.digest, CASE WHEN n_words > 0 THEN license END AS license, n_words::BIGINT AS n_words, n::BIGINT AS n_copyright_lines FROM e LEFT JOIN k ON k.digest = e.digest
"""
