"""License scans by canonical digests.

A text is brought to a canonical form: lower case, copyright lines out, equivalent spellings made one, anything but letters
and digits turned into single spaces. Its digest is looked up among those of known licence texts with a hash join; nothing
is matched in part. Three units of each document are looked up whole: the document, each paragraph (cut at blank lines) and
each line, so a notice that makes a line or a paragraph of its own is found as well.

The table of known digests is as long as the list of known texts, which bounds what is broadcast. Defined results: a null
or empty text has no licence; very long texts are looked up whole, like all others; units without a letter or digit are not looked up; repeated rows are reported alike; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Spellings that count as the same, as pattern and replacement, in order, after lower case.
SPELLINGS = (
    ("licence", "license"),
    ("sub-license", "sublicense"),
    ("non-commercial", "noncommercial"),
    ("non-infringement", "noninfringement"),
    ("per cent", "percent"),
    ("copyright owner", "copyright holder"),
    ("organisation", "organization"),
    ("https", "http"),
    ("&", " and "),
)
#: Fixed value: lines that state a copyright, after lower case.
COPYRIGHT = r"(?m)^[ \t#*/;-]*(?:copyright|\(c\)|©)[^\n]*$"
CUT = r"[^\p{L}\p{Nd}]+"

#: Licence texts and notices, by SPDX identifier (or a name of our own).
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
GPL3_NOTICE = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""
BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

"""
BSD_3 = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

"""
BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
KNOWN = (
    ("MIT", MIT),
    ("MIT", "MIT License\n\n" + MIT),
    ("MIT", "The MIT License (MIT)\n\n" + MIT),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("ISC", ISC),
    ("ISC", "ISC License\n\n" + ISC),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("Apache-2.0", APACHE_NOTICE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0-or-later", GPL3_NOTICE),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-3.0-or-later", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("BSD-2-Clause", BSD_2 + BSD_END),
    ("BSD-2-Clause", "BSD 2-Clause License\n\n" + BSD_2 + BSD_END),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", BSD_2 + BSD_3 + BSD_END),
    ("BSD-3-Clause", "BSD 3-Clause License\n\n" + BSD_2 + BSD_3 + BSD_END),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("LicenseRef-All-Rights-Reserved", "All rights reserved."),
)
#: Digests of the canonical forms of whole licence texts, as published.
KNOWN_DIGESTS = (
    ("Apache-2.0", "0d5838e6f6e5a374e58d608af5c01bc6a67cf18552dd7b346e5aef652b808ee9"),
    ("Artistic-1.0", "cc2cd6cccfacd5fb622fb0e9b9a373fa9dcb86a8c152213a2b856dfbe24fe304"),
    ("BSD-3-Clause", "3d151449461c0c776e892a4dc41cac0d251eb00c9fc49d2d48802d9bed818fe9"),
    ("BSD-3-Clause", "b6093f80a67d752fa17301d7c8f20fe906e6f11169f3a64f9a5816d148eb738f"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "37db86be8f16e9b8dfb0d63e1698ad2e07d54f312494c1cb2dbdb4fa37487f0f"),
    ("GFDL-1.3", "7befa86e5ee53162018d597eee81db6c727f3e64fab4641af93e19deab1807b4"),
    ("GPL-1.0", "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),
    ("GPL-2.0", "b866f5427b78991db8012466b32f51c907f5e974fde5129a47372d0d0552e3a1"),
    ("GPL-3.0", "010ce52b3b970c80b5447205f4afc3b42084811cda2d11b95178b1fd3940764f"),
    ("LGPL-2.0", "9b0b3105b96203f9d9e4b72d4b77951152156c88139302b5aedf6295e3ceaaa3"),
    ("LGPL-2.1", "cb225061bb71741fe8b31a2092e22fe05b1130438158ae5d16c48fd50186e345"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
)


def canonical(text: Column) -> Column:
    """The canonical form; empty if nothing is left."""
    out = F.regexp_replace(F.lower(text), COPYRIGHT, "")
    for pattern, better in SPELLINGS:
        out = F.replace(out, F.lit(pattern), F.lit(better))
    return F.trim(F.regexp_replace(out, CUT, " "))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text).cast("binary"), 256)


def known_digests(spark, known=KNOWN, digests=KNOWN_DIGESTS) -> DataFrame:
    """digest, license: one row for each known text or digest."""
    rows = spark.createDataFrame(list(known), "license string, text string")
    own = rows.select(digest(F.col("text")).alias("digest"), "license")
    return own.unionByName(spark.createDataFrame(list(digests), "license string, digest string")).distinct()


def scan(docs: DataFrame, known=KNOWN, digests=KNOWN_DIGESTS) -> DataFrame:
    """For each row of docs: doc_id, n_units (units whose text is a known one), licenses (sorted, comma-joined), whole (the document is one)."""
    spark = docs.sparkSession
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), text.alias("text"))
    by_digest = F.broadcast(known_digests(spark, known, digests))
    units = F.array_distinct(F.concat(F.array("text"), F.split("text", r"\n[ \t]*\n"), F.split("text", "\n")))
    found = rows.select("doc_id", "row", F.posexplode(units).alias("place", "unit")).select("doc_id", "row", digest(F.col("unit")).alias("digest"), (F.col("place") == 0).alias("whole"))
    return found.join(by_digest, "digest", "left").groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.count("license").alias("n_units"), F.array_join(F.array_sort(F.collect_set("license")), ",").alias("licenses"), F.coalesce(F.max(F.col("whole") & F.col("license").isNotNull()), F.lit(False)).alias("whole")
    ).drop("row")


def oracle_sql(known=KNOWN, digests=KNOWN_DIGESTS) -> str:
    """The same in DuckDB SQL."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    form = f"regexp_replace(lower(u), '{COPYRIGHT}', '', 'g')"
    for pattern, better in SPELLINGS:
        form = f"replace({form}, {quoted(pattern)}, {quoted(better)})"
    form = rf"sha256(trim(regexp_replace({form}, '{CUT}', ' ', 'g'), ' '))"
    rows = ", ".join(f"({quoted(name)}, {quoted(text)})" for name, text in known)
    whole = ", ".join(f"({quoted(name)}, {quoted(value)})" for name, value in digests)
    return rf"""
WITH k AS (SELECT name, {form} c FROM (VALUES {rows}) v(name, u) UNION SELECT * FROM (VALUES {whole}) w(name, c)),
d AS (SELECT row_number() OVER () r, doc_id, coalesce(text, '') t FROM documents),
x AS (SELECT r, t, unnest(list_distinct(list_concat([t], regexp_split_to_array(t, '
[ 	]*
'), string_split(t, chr(10))))) u FROM d),
f AS (SELECT r, u = t AS w, {form} c FROM x),
m AS (SELECT r, count(*) n, string_agg(DISTINCT name, ',' ORDER BY name) names, bool_or(w) w FROM f JOIN k USING (c) GROUP BY r)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) n_units, coalesce(names, '') licenses, coalesce(w, false) whole FROM d LEFT JOIN m USING (r)
"""
