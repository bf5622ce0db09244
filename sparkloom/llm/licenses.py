"""Licence scans by canonical digest lookup.

A text is put into a canonical form (case, punctuation, copyright lines and
equivalent spellings), digested as a whole, and the digest is joined with a
table of known licence digests. Lines that have the canonical length of some
known text are looked up in the same table, since notices stand as a line of
their own. The list of known texts is a parameter; its size is checked before
it is broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm._base import keep, lower_ascii, rows_of

# Parts of the public BSD licence texts.
_BSD_HEAD = (
    "Copyright (c) <year>, <holder>\n\nRedistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met:\n\n"
)
_BSD_CONDITIONS = (
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n2. Redistributions in "
    "binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials "
    "provided with the distribution."
)
_BSD_NAMES = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
    "without specific prior written permission."
)
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE '
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE "
    "LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS "
    "OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT "
    "LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
#: Public licence texts and the usual notices that name a licence.
KNOWN: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("Apache-2.0", "This project is licensed under the Apache License 2.0."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", "This project is licensed under the MIT License."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License v3.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("Proprietary", "All rights reserved."),
    (
        "MIT",
        "MIT License\n\nCopyright (c) <year> <holder>\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this "
        'software and associated documentation files (the "Software"), to deal in the Software without restriction, including without '
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice "
        "and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED "
        '"AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
        "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION "
        "WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "ISC",
        "ISC License\n\nCopyright (c) <year> <holder>\n\nPermission to use, copy, modify, and/or distribute this software for any purpose "
        "with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
        '\n\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED '
        "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR "
        "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
        "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "0BSD",
        "Zero-Clause BSD\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."
        '\n\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED '
        "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR "
        "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
        "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    ("BSD-2-Clause", "BSD 2-Clause License\n\n" + _BSD_HEAD + _BSD_CONDITIONS + "\n\n" + _BSD_END),
    ("BSD-3-Clause", "BSD 3-Clause License\n\n" + _BSD_HEAD + _BSD_CONDITIONS + "\n\n" + _BSD_NAMES + "\n\n" + _BSD_END),
    (
        "Zlib",
        "zlib License\n\nCopyright (c) <year> <holder>\n\nThis software is provided 'as-is', without any express or implied warranty. In no event will the "
        "authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any "
        "purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin "
        "of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an "
        "acknowledgment in the product documentation would be appreciated but is not required.\n\n2. Altered source versions must be plainly marked as "
        "such, and must not be misrepresented as being the original software.\n\n3. This notice may not be removed or altered from any source distribution.",
    ),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute "
        "this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\n\nIn "
        "jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the "
        "public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this "
        "dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\n\nTHE SOFTWARE "
        'IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A '
        "PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
        "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.\n\nFor more "
        "information, please refer to <https://unlicense.org>",
    ),
    (
        "BSL-1.0",
        "Boost Software License - Version 1.0 - August 17th, 2003\n\nPermission is hereby granted, free of charge, to any person or organization obtaining a "
        'copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and '
        "transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all "
        "subject to the following:\n\nThe copyright notices in the Software and this entire statement, including the above license grant, this restriction and "
        "the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such "
        "copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.\n\nTHE SOFTWARE IS "
        'PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A '
        "PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES "
        "OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN "
        "THE SOFTWARE.",
    ),
)

#: Equivalent spellings, as whole words of the canonical form.
SPELLINGS: tuple[tuple[str, str], ...] = (
    ("licence", "license"),
    ("licences", "licenses"),
    ("licenced", "licensed"),
    ("sublicence", "sublicense"),
    ("organisation", "organization"),
    ("favour", "favor"),
    ("acknowledgement", "acknowledgment"),
    ("noncommercial", "non commercial"),
    ("sub license", "sublicense"),
    ("per cent", "percent"),
    ("copyright holder", "copyright owner"),
)

#: Most known texts that are broadcast.
BROADCAST_ROWS = 100_000

_COPYRIGHT_LINE = r"(?m)^[^a-z0-9\n]*(copyright|\(c\)|©)[^\n]*$"


def canonical(text: Column) -> Column:
    """Canonical form; empty for a null text."""
    flat = F.regexp_replace(lower_ascii(F.coalesce(text, F.lit(""))), _COPYRIGHT_LINE, " ")
    flat = F.regexp_replace(flat, r"[\x00-\x2F\x3A-\x60\x7B-\x7F“”‘’–—]+", " ")
    flat = F.concat(F.lit(" "), F.trim(flat), F.lit(" "))
    for spelling, usual in SPELLINGS:
        flat = F.replace(flat, F.lit(f" {spelling} "), F.lit(f" {usual} "))
    return F.trim(flat)


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def scan_licenses(
    docs: DataFrame, known: Sequence[tuple[str, str]] = KNOWN, text: str = "text", doc_id: str = "doc_id"
) -> DataFrame:
    """One row per input row: doc_id, text_sha256, license, n_notices, notices.

    ``license`` is the licence whose text equals the whole document, else null.
    ``notices`` joins, in code-point order, the licences that have a notice as
    a line of the document (empty if none); ``n_notices`` counts such lines.
    Null and empty texts have the digest of the empty text and no licence.
    Repeated rows and null ids are rows like any other; rows of one id are told
    apart by their text. An empty table gives an empty result, an empty list of
    known texts no licence. Only the two named columns are read, so that others
    may have any name.
    """
    spark = docs.sparkSession
    form = rows_of(spark, known, "license string, body string").select(canonical(F.col("body")).alias("form"), "license").where("form <> ''")
    table = keep(form.groupBy(F.sha2("form", 256).alias("d")).agg(F.min("license").alias("license"), F.min(F.length("form")).alias("n")))
    lengths = sorted(r["n"] for r in table.select("n").distinct().collect())  # at most one for each known text
    near = F.broadcast if len(known) <= BROADCAST_ROWS else (lambda df: df)
    body = F.coalesce(F.col(text), F.lit(""))
    # Rows are named by their id and text; equal rows have equal results.
    base = docs.select(F.struct(F.col(doc_id).alias("doc_id"), F.xxhash64(body).alias("h")).alias("id"), body.alias("t"))
    # A spelling makes a text longer by one in thirteen at most, so that much shorter lines need no closer look.
    lines = F.filter(F.split("t", "\n"), lambda x: F.length(x) * 2 >= (lengths[0] if lengths else 0))
    forms = base.select("id", F.posexplode(F.transform(lines, lambda x: canonical(x))).alias("i", "form")).where(F.length("form").isin(*lengths) if lengths else F.lit(False))
    named = forms.withColumn("d", F.sha2("form", 256)).join(near(table.select("d", "license")), "d").select("id", "i", "license").distinct()
    found = named.groupBy(F.col("id").alias("found_id")).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("license")), ",").alias("notices"))
    read = base.select("id", digest(F.col("t")).alias("text_sha256"))
    whole = read.join(near(table.select("d", "license")), F.col("text_sha256") == F.col("d"), "left")
    return whole.join(found, F.col("id").eqNullSafe(F.col("found_id")), "left").select(
        "id.doc_id", "text_sha256", "license", F.coalesce("n", F.lit(0)).cast("long").alias("n_notices"), F.coalesce("notices", F.lit("")).alias("notices")
    )


def oracle(known: Sequence[tuple[str, str]] = KNOWN) -> str:
    """The same in DuckDB's SQL."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    line = _COPYRIGHT_LINE

    def form(x: str) -> str:
        x = f"translate(coalesce({x}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
        x = f"regexp_replace({x}, {quote(line)}, ' ', 'g')"
        x = rf"regexp_replace({x}, '[\x00-\x2F\x3A-\x60\x7B-\x7F“”‘’–—]+', ' ', 'g')"
        x = f"(' ' || trim({x}) || ' ')"
        for a, b in SPELLINGS:
            x = f"replace({x}, ' {a} ', ' {b} ')"
        return f"sha256(trim({x}))"

    values = ", ".join(f"({quote(a)}, {quote(b)})" for a, b in known)
    return f"""
WITH k AS (SELECT {form("body")} AS d, min(license) AS license FROM (VALUES {values}) AS t(license, body) GROUP BY 1 HAVING d <> sha256('')),
lines AS (SELECT doc_id, license FROM (SELECT doc_id, {form("l")} AS d FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents) WHERE length(l) > 0) JOIN k USING (d)),
found AS (SELECT doc_id, count(*) AS n, string_agg(DISTINCT license, ',' ORDER BY license) AS notices FROM lines GROUP BY 1)
SELECT doc_id, {form("text")} AS text_sha256, k.license, CAST(coalesce(n, 0) AS BIGINT) AS n_notices, coalesce(notices, '') AS notices
FROM documents LEFT JOIN k ON k.d = {form("text")} LEFT JOIN found USING (doc_id)
"""
