"""Licence scan: Dice coefficient over word bigrams between text units and licence templates."""

from __future__ import annotations

import re
from collections import Counter
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable

#: Well-known notices, titles and permission texts, as their licences publish them.
LICENCE_TEXTS = {
    "AGPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "AGPL-3.0-title": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "Apache-2.0-title": "Apache License Version 2.0, January 2004",
    "BSD-2-Clause-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "BSD-3-Clause-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "BSD-notice": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-SA-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "CC-BY-SA-3.0-text": "Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "GPL-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-2.0-title": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-3.0-title": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "GPL-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "ISC-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "LGPL-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "LGPL-2.1-title": "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
    "LGPL-3.0-title": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "MIT": "Released under the MIT License.",
    "MIT-disclaimer": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "MIT-full": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MIT-title": "The MIT License (MIT)",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "OFL-1.1": "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
    "PostgreSQL": "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "Unlicense-text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "WTFPL": "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
} | {
    f"SPDX-{name}": f"SPDX-License-Identifier: {name}"
    for name in ("AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC0-1.0", "EPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MPL-2.0", "Unlicense", "Zlib")
}
#: Words too common to tell which texts can hold a notice; only speed depends on them.
_COMMON = frozenset("a all and any are as at be by copy for form free general if in is it no not of on one or out public so that the this to use version with work you".split())


def _plain(text: str) -> str:
    return re.sub(r"[^\w]|_", " ", text.lower())


def _bigrams(text: str) -> Counter[str]:
    words = _plain(text).split()
    return Counter(f"{a} {b}" for a, b in zip(words, words[1:]))


def _telling_words(text: str, share: Fraction) -> set[str]:
    """Words of which any text holds one that has at least ``share`` of the bigrams: they stand in more of
    them than may be missing, counted once as well as with repeats. Uncommon and long words come first."""
    bigrams, chosen = _bigrams(text), set()
    for word in sorted(set(_plain(text).split()), key=lambda w: (w in _COMMON, -len(w), w)):
        hit = [b for b in bigrams if chosen.intersection(b.split())]
        if len(hit) > (1 - share) * len(bigrams) and sum(bigrams[b] for b in hit) > (1 - share) * sum(bigrams.values()):
            break
        chosen.add(word)
    return chosen


def scan_licences(df: DataFrame, texts: dict[str, str] = LICENCE_TEXTS, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, unit, pos, licence, dice): where a text's best template has a Dice coefficient of ``least`` or
    more over word bigrams.

    Text is lower-cased and everything but letters and digits separates words. The units are

    - ``line`` (ends at ``\\n``, counted from 0), ``paragraph`` of several lines (ends at lines without letters or
      digits, counted from 0) and ``document`` of several paragraphs (pos 0), over sets of bigrams;
    - ``passage``: as many words as the template has (fewer at the text's end), from a word on where one of its bigrams
      begins, over bags of bigrams. Of passages that overlap the one that shares most bigrams is reported, of
      those with the best coefficient; pos is its first word in the text, counted from 0. So a notice inside a line or over paragraphs is found.

    Size bounds come first: with b template bigrams, only units of b*least/(2-least) to b*(2-least)/least bigrams
    can reach ``least``; they are whole numbers, so none on a bound is lost. A text without any of the words that so much of a template needs is not looked at.
    Ties go to the first template by name. Null and empty texts give no row, other columns of
    the input are dropped; for passages rows equal in id and text are one. The texts looked at
    are written to the checkpoint folder when this is called.
    """
    names = sorted(texts)
    bags = {name: _bigrams(texts[name]) for name in names}
    p, q = Fraction(str(least)).as_integer_ratio()
    bounds = {name: (-(-len(b) * p // (2 * q - p)), len(b) * (2 * q - p) // p) for name, b in bags.items()}
    telling = sorted(set().union(*(_telling_words(texts[name], Fraction(p, 2 * q - p)) for name in names)))
    plain = F.regexp_replace(F.lower(F.col(f"`{text_col}`")), r"[^\p{L}\p{N}\n]+", " ")
    kept = df.select(F.col(f"`{id_col}`").alias("doc_id"), plain.alias("plain"))
    kept = kept.select("doc_id", "plain", F.split(F.trim(F.translate("plain", "\n", " ")), " +").alias("words"))
    kept = durable(kept.filter(F.arrays_overlap("words", F.array(*map(F.lit, telling)))))
    return _units(kept, bags, bounds, p, q).unionByName(_passages(kept, bags, p, q))


def _units(kept: DataFrame, bags: dict[str, Counter[str]], bounds: dict[str, tuple[int, int]], p: int, q: int) -> DataFrame:
    in_bounds = " OR ".join(f"size(u.pairs) BETWEEN {lo} AND {hi}" for lo, hi in sorted(set(bounds.values())))
    smallest = min(lo for lo, _ in bounds.values())
    none = "CAST(array() AS ARRAY<STRING>)"
    pairs = (
        r"transform(array(split(trim(translate(body, '\n', ' ')), ' +')), words -> "
        f"IF(size(words) - 1 < {smallest}, {none}, array_distinct(transform(slice(words, 2, size(words)), (w, i) -> concat(words[i], ' ', w)))))[0]"
    )
    found = F.expr(f"""filter(concat(
        transform(split(plain, '\\n', -1), (body, pos) -> named_struct('unit', 'line', 'pos', pos, 'pairs', {pairs})),
        transform(split(plain, '\\n ?\\n', -1), (body, pos) -> named_struct('unit', 'paragraph', 'pos', pos, 'pairs', IF(contains(body, '\\n'), {pairs}, {none}))),
        transform(array(plain), (body, pos) -> named_struct('unit', 'document', 'pos', pos, 'pairs', IF(body RLIKE '\\n ?\\n', {pairs}, {none})))), u -> {in_bounds})""")
    units = kept.select("doc_id", F.inline(found)).withColumn("n", F.size("pairs"))

    def fit(name: str, order: int) -> Column:
        (lo, hi), other = bounds[name], sorted(bags[name])
        shared = F.when(F.col("n").between(lo, hi), F.size(F.array_intersect("pairs", F.array(*map(F.lit, other)))))
        return F.transform(F.array(shared), lambda s: F.when(s * (2 * q) >= (F.col("n") + len(other)) * p, F.struct((s * 2 / (F.col("n") + len(other))).alias("dice"), F.lit(-order).alias("order"), F.lit(name).alias("licence"))))[0]

    best = F.array_max(F.array(*(fit(name, i) for i, name in enumerate(bags))))
    return units.withColumn("best", best).filter("best IS NOT NULL").select("doc_id", "unit", "pos", F.col("best.licence").alias("licence"), F.col("best.dice").alias("dice"))


def _passages(kept: DataFrame, bags: dict[str, Counter[str]], p: int, q: int) -> DataFrame:
    rows = [(pair, name, sum(bag.values()), times) for name, bag in bags.items() for pair, times in bag.items()]
    # A template's own bigrams: of fixed, small number.
    templates = F.broadcast(kept.sparkSession.createDataFrame(rows, "pair string, licence string, width int, times int"))
    key = [F.xxhash64(F.coalesce("plain", F.lit("")), F.lit(1)).alias("k1"), F.xxhash64(F.lit(2), F.coalesce("plain", F.lit(""))).alias("k2")]
    pairs = F.expr("transform(slice(words, 2, size(words)), (w, i) -> concat(words[i], ' ', w))")
    hits = kept.select("doc_id", *key, F.size("words").alias("n_words"), F.posexplode(pairs).alias("at", "pair")).join(templates, "pair")
    hits = hits.groupBy("doc_id", "k1", "k2", "n_words", "licence", "width").agg(F.sort_array(F.collect_set(F.struct("at", "pair", "times"))).alias("hits"))
    # Bags share at most the places that hit; with fewer than a size bound allows, the template is out.
    needed = f"width * {p} <= {2 * q - p} *"
    window = "filter(slice(hits, i + 1, width), y -> y.at < h.at + width)"
    starts = F.expr(f"""filter(transform(hits, (h, i) -> named_struct('at', h.at, 'n', least(width, n_words - 1 - h.at), 'near', IF({needed} size({window}), {window}, NULL))), w -> w.near IS NOT NULL)""")
    inter = F.expr("aggregate(array_distinct(transform(near, y -> struct(y.pair AS pair, y.times AS times))), 0, (a, y) -> a + least(y.times, size(filter(near, z -> z.pair = y.pair))))")
    found = hits.filter(f"{needed} size(hits)").select("doc_id", "k1", "k2", "licence", "width", F.inline(starts)).withColumn("shared", inter)
    found = found.filter(f"shared * {2 * q} >= (n + width) * {p}").select("doc_id", "k1", "k2", "licence", "at", "shared", (F.col("at") + F.col("n")).alias("end"), (F.col("shared") * 2 / (F.col("n") + F.col("width"))).alias("dice"))
    doc = Window.partitionBy("doc_id", "k1", "k2").orderBy("at", "end", "licence")
    apart = F.coalesce(F.col("at") > F.max("end").over(doc.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    found = found.withColumn("apart", apart.cast("int")).withColumn("island", F.sum("apart").over(doc))
    best = found.groupBy("doc_id", "k1", "k2", "island").agg(F.min(F.struct((-F.col("shared")).alias("s"), (-F.col("dice")).alias("d"), "licence", "at", "dice")).alias("b"))
    return best.select("doc_id", F.lit("passage").alias("unit"), F.col("b.at").alias("pos"), "b.licence", "b.dice")


def licence_sql(texts: dict[str, str] = LICENCE_TEXTS, least: float = 0.8) -> str:
    """The same in DuckDB, without size bounds and telling words."""
    p, q = Fraction(str(least)).as_integer_ratio()
    rows = ", ".join("('{}', '{}')".format(name, x.replace("'", "''")) for name, x in texts.items())
    pairs = "[words[i] || ' ' || words[i + 1] for i in range(1, len(words))]"
    plain = "regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g')"
    words = "regexp_split_to_array(trim(translate({}, chr(10), ' ')), ' +')"
    return f"""
WITH t AS (SELECT licence, {pairs} AS bag FROM (SELECT licence, {words.format(plain.format("body"))} AS words FROM (VALUES {rows}) v(licence, body))),
ts AS (SELECT licence, list_distinct(bag) AS b FROM t),
d0 AS (SELECT doc_id, {plain.format("text")} AS plain FROM documents),
l AS (SELECT doc_id, 'line' AS unit, string_split(plain, chr(10)) AS parts FROM d0
      UNION ALL SELECT doc_id, 'paragraph', regexp_split_to_array(plain, '\\n ?\\n') FROM d0
      UNION ALL SELECT doc_id, 'document', [plain] FROM d0 WHERE regexp_matches(plain, '\\n ?\\n')),
u AS (SELECT doc_id, unit, unnest(range(0, len(parts))) AS pos, unnest(parts) AS body FROM l),
w AS (SELECT doc_id, unit, pos, {words.format("body")} AS words FROM u WHERE unit <> 'paragraph' OR contains(body, chr(10))),
g AS (SELECT doc_id, unit, pos, list_distinct({pairs}) AS b FROM w WHERE len(words) >= 2),
d AS (SELECT doc_id, unit, pos, licence, len(list_intersect(g.b, ts.b)) AS s, len(g.b) + len(ts.b) AS n FROM g JOIN ts ON len(list_intersect(g.b, ts.b)) > 0),
units AS (SELECT doc_id, unit, pos, licence, s * 2 / n AS dice, row_number() OVER (PARTITION BY doc_id, unit, pos ORDER BY s * 2 / n DESC, licence) AS k
  FROM d WHERE {2 * q} * s >= {p} * n),
tb AS (SELECT licence, len(bag) AS width, pair, count(*) AS times FROM (SELECT licence, bag, unnest(bag) AS pair FROM t) GROUP BY ALL),
dw AS (SELECT doc_id, {words.format("plain")} AS words FROM d0),
dp AS (SELECT doc_id, len(words) AS n_words, unnest(range(0, len(words) - 1)) AS beg, unnest({pairs}) AS pair FROM dw),
h AS (SELECT doc_id, n_words, beg, licence, width, times, pair FROM dp JOIN tb USING (pair)),
c AS (SELECT a.doc_id, a.licence, a.beg, least(a.width, a.n_words - 1 - a.beg) AS n, a.width, z.pair, least(count(*), any_value(z.times)) AS s
  FROM h a JOIN h z ON a.doc_id = z.doc_id AND a.licence = z.licence AND z.beg >= a.beg AND z.beg < a.beg + a.width GROUP BY ALL),
f AS (SELECT doc_id, licence, beg, beg + n AS stop, sum(s) AS s, sum(s) * 2 / (n + width) AS dice FROM c GROUP BY doc_id, licence, beg, n, width HAVING {2 * q} * sum(s) >= {p} * (n + width)),
i AS (SELECT *, coalesce(beg > max(stop) OVER (PARTITION BY doc_id ORDER BY beg, stop, licence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS apart FROM f),
k AS (SELECT *, sum(CAST(apart AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY beg, stop, licence ROWS UNBOUNDED PRECEDING) AS island FROM i),
passages AS (SELECT *, row_number() OVER (PARTITION BY doc_id, island ORDER BY s DESC, dice DESC, licence, beg) AS k FROM k)
SELECT doc_id, unit, CAST(pos AS INTEGER) AS pos, licence, CAST(dice AS DOUBLE) AS dice FROM units WHERE k = 1
UNION ALL SELECT doc_id, 'passage', CAST(beg AS INTEGER), licence, CAST(dice AS DOUBLE) FROM passages WHERE k = 1
"""
