"""License scans: runs of words against licence templates by Dice coefficient over word bigrams, in the JVM."""

from __future__ import annotations

import json
from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A passage is a licence if the Dice coefficient reaches this.
THRESHOLD = 0.8

# The wording of public licence notices.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "MIT-notice-2": "This project is licensed under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-3.0-notice": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0-notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "All-rights-reserved": "All rights reserved.",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense-notice": "This is free and unencumbered software released into the public domain.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "MIT-condition": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "BSD-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISC-license": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
}


def _bigrams(text: str) -> list[str]:
    words = "".join(c if c.isalnum() else " " for c in text.lower()).split()
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def _sizes(n: int, t: float) -> tuple[int, int]:
    """The least number of a template's n bigrams that a passage must have, and the most bigrams it may have: with fewer or more
    no Dice coefficient of t is possible."""
    return ceil(n * t / (2 - t) - 1e-9), int(n * (2 - t) / t + 1e-9)


MATCH = "struct<dice:double,same:int,at:int,license:string,n:int>"
FOUND = f"array<{MATCH}>"


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Rows (id_col, license, dice, word_no, n_words, n_matches), one per row of docs.

    Normal form: lower case, what is no letter or number to one blank; so a licence that is wrapped over lines, or stands
    within a longer line or document, is a run of words like any other. Passages are all runs of successive words of the whole
    text whose bigrams are no more than a template's size bound lets. A passage A matches template B if
    2 |A and B| / (|A| + |B|) over sets of word bigrams reaches the threshold t. A template's match is its passage of largest
    coefficient, ties by least word, then shortest run. license, dice, word_no (from 1) and n_words are of the match that shares
    most bigrams with its template, so that a whole licence goes before one of its clauses; ties by coefficient, least word,
    shortest run, then name; null if there is none. n_matches counts templates with a match.

    Size bounds prune, and lose nothing: a match has at least |B| t / (2 - t) of the template's bigrams, so a text that has
    fewer is done with that template after one pass over its words, as nearly all texts are with nearly all templates; and at
    most |B| (2 - t) / t of any. The best run begins and ends with bigrams of the template, as without others at its ends it
    would be better; only runs between two of them, with enough of them inside, are compared.

    Null and empty texts, and texts of fewer than two words, match nothing. A text is handled by itself within its row: no
    shuffle, so no skew; very long ones take time in proportion to their words. Repeated rows give equal rows; an empty table
    none; other columns play no part.
    """
    t, known = threshold, templates or TEMPLATES
    grams = {k: g for k, v in sorted(known.items()) if (g := _bigrams(v))}
    every = sorted({g for v in grams.values() for g in v})
    firsts = sorted({g.split(" ")[0] for g in every})
    norm = F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(text_col), F.lit(""))), "[^\\p{L}\\p{N}]+", " "))
    words = docs.select(F.col(id_col).alias("id"), F.split(norm, " ").alias("w"))
    second = lambda i: F.get("w", i + 1)
    pair = lambda x, i: F.when(x.isin(firsts), F.struct(i.alias("at"), F.concat(x, F.lit(" "), second(i)).alias("g")))
    hits = F.filter(F.transform("w", pair), lambda p: p["g"].isin(every))
    rows = words.withColumn("hits", hits).withColumn("have", F.array_distinct(F.transform("hits", lambda p: p["g"])))

    # one expression for all templates, which are one constant: a plan of any number of them is as small
    rows_of = [{"name": k, "own": g, "size": len(g), "least": _sizes(len(g), t)[0], "most": _sizes(len(g), t)[1]} for k, g in grams.items()]
    constant = F.from_json(F.lit(json.dumps(rows_of)), "array<struct<name:string,own:array<string>,size:int,least:int,most:int>>")
    likely = F.filter(constant, lambda b: (F.size("have") >= b["least"]) & (F.size(F.array_intersect(F.col("have"), b["own"])) >= b["least"]))

    def passages(b: F.Column) -> F.Column:
        """A template's matches, of which there are few, in a text that has enough of its bigrams."""
        at = F.filter("hits", lambda p: F.array_contains(b["own"], p["g"]))
        runs = F.transform(F.array(at), lambda h: F.flatten(F.transform(F.sequence(F.lit(1), F.size(h)), lambda i: runs_from(h, i, b))))
        return F.filter(F.flatten(runs), lambda r: r["dice"] >= t - 1e-12)

    def runs_from(h: F.Column, i: F.Column, b: F.Column) -> F.Column:
        """Passages from the i-th bigram of the template's in the text to a later one: within reach, and with enough of them."""
        start = F.element_at(h, i)["at"]
        ends = F.filter(F.slice(h, i + b["least"] - 1, b["most"]), lambda e: e["at"] - start < b["most"])

        def made(e: F.Column, k: F.Column) -> F.Column:
            here = F.size(F.array_distinct(F.transform(F.slice(h, i, k + b["least"]), lambda p: p["g"])))
            n = F.size(F.array_distinct(F.transform(F.sequence(start, e["at"]), lambda j: F.concat(F.get("w", j), F.lit(" "), F.get("w", j + 1)))))
            return F.struct((2.0 * here / (n + b["size"])).alias("dice"), here.alias("same"), (start + 1).alias("at"), b["name"].alias("license"), (e["at"] - start + 2).alias("n"))

        return F.when(i + b["least"] - 1 <= F.size(h), F.transform(ends, made)).otherwise(F.array().cast(FOUND))

    def first(xs: F.Column, *by: str) -> F.Column:
        """The one of the largest numbers `by`, ties as told above."""
        key = lambda x: F.struct(*[-x[c] for c in by], x["at"], x["n"], x["license"])
        return F.aggregate(xs, F.lit(None).cast(MATCH), lambda a, x: F.when(a.isNull() | (key(x) < key(a)), x).otherwise(a))

    fewest = min(r["least"] for r in rows_of)
    found = F.when(F.size("have") >= fewest, F.filter(F.transform(likely, lambda b: first(passages(b), "dice")), lambda x: x.isNotNull())).otherwise(F.array().cast(FOUND))
    scored = rows.select("id", found.alias("found")).withColumn("top", first(F.col("found"), "same", "dice"))
    return scored.select(
        F.col("id").alias(id_col), F.col("top.license").alias("license"), F.round("top.dice", 9).alias("dice"), F.col("top.at").cast("long").alias("word_no"),
        F.col("top.n").cast("long").alias("n_words"), F.size("found").cast("long").alias("n_matches"),
    )


def license_sql(table: str = "documents", templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> str:
    """The same in DuckDB's SQL, by joins: every run between two bigrams of a template that is short enough, of texts that have
    enough of them."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ", ".join(f"({quoted(k)}, [{', '.join(map(quoted, g))}], {_sizes(len(g), threshold)[0]}, {_sizes(len(g), threshold)[1]})" for k, v in (templates or TEMPLATES).items() if (g := _bigrams(v)))
    return f"""
WITH templates(license, b, least, most) AS (VALUES {rows}),
tg AS MATERIALIZED (SELECT license, unnest(b) AS g, len(b) AS size, least, most FROM templates),
d AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS k, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ') AS w FROM {table}),
p AS MATERIALIZED (SELECT k, unnest(range(1, len(w))) AS pos, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM d WHERE len(w) > 1),
h0 AS (SELECT k, pos, g, license, size, least, most FROM p JOIN tg USING (g)),
ok AS (SELECT k, license FROM h0 GROUP BY k, license, least HAVING count(DISTINCT g) >= least),
h AS MATERIALIZED (SELECT h0.*, row_number() OVER (PARTITION BY k, license ORDER BY pos) AS i FROM h0 JOIN ok USING (k, license)),
r AS (SELECT a.k, a.license, a.size, a.pos AS s, b.pos AS e FROM h a JOIN h b ON a.k = b.k AND a.license = b.license AND b.i - a.i >= a.least - 1 AND b.pos >= a.pos AND b.pos - a.pos < a.most),
x AS (SELECT r.k, r.license, r.size, s, e, (SELECT count(DISTINCT g) FROM h WHERE h.k = r.k AND h.license = r.license AND h.pos BETWEEN s AND e) AS here, (SELECT count(DISTINCT g) FROM p WHERE p.k = r.k AND p.pos BETWEEN s AND e) AS n FROM r),
m AS (SELECT k, license, s, e, here, 2.0::DOUBLE * here / (n + size) AS dice FROM x),
b AS (SELECT *, row_number() OVER (PARTITION BY k, license ORDER BY dice DESC, s, e) AS q FROM m WHERE dice >= {threshold} - 1e-12),
g AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY here DESC, dice DESC, s, e, license) AS o FROM b WHERE q = 1),
c AS (SELECT k, count(DISTINCT license) AS n FROM g GROUP BY k)
SELECT d.doc_id, g.license, round(g.dice, 9) AS dice, g.s::BIGINT AS word_no, (g.e - g.s + 2)::BIGINT AS n_words, coalesce(c.n, 0)::BIGINT AS n_matches FROM d LEFT JOIN g ON g.k = d.k AND g.o = 1 LEFT JOIN c ON c.k = d.k
"""
