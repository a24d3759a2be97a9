"""Licence scan: lines and passages against licence templates by Dice's coefficient of word bigrams (operator 8).

SQL functions only.  A text's lines, and the whole text if it has several, are normalised (A-Z folded,
runs of anything but a-z and 0-9 to one blank).  Dice at least LEAST forces the two bigram sets' sizes
within a factor of each other, which leaves few templates to compare, and no line of other length is
tokenised at all.  Everything is an expression of the row: no shuffle, no explode.

Notices inside a longer line or wrapped over lines, and the texts in BODIES, are found as passages: windows
of the whole text's words that begin and end with a bigram of the template and have at most (2 - LEAST) / LEAST
times its bigrams.  A window at LEAST shares at least LEAST / (2 - LEAST) of the template's bigrams, so a text
without that many, or without any of the words that these must touch, is not searched; nothing else is left
out.  From a start on, the ends are tried one by one with running counts of distinct bigrams, over whole numbers;
starts inside a passage found are not tried.  A passage counts once, from its first matching start on (its end is
the first of the best), and a line (or text) that matches a template as a unit is no passage of it again.

Defined results: null and empty texts match nothing; a unit of one word has no bigrams and matches nothing; equal best
scores go to the first licence in alphabetical order; repeated rows give repeated rows; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST = 0.8
_BUCKETS = 64

#: Short licence notices as they appear in texts, by identifier.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "bsd-3-clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "lgpl-2.1": "This library is licensed under the GNU Lesser General Public License, version 2.1.",
    "mit": "Released under the MIT License.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}

#: Longer licence texts, found as passages only (they span lines).
BODIES = {
    "apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing,
software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and limitations under the License.""",
    "bsd-2-clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
and/or other materials provided with the distribution. {as_is}""",
    "bsd-3-clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software
without specific prior written permission. {as_is}""",
    "gpl-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it
will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General
Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see
<https://www.gnu.org/licenses/>.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO
THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT,
OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER
TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the
"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute,
sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN
THE SOFTWARE.""",
}
_AS_IS = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO,
THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE
LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS
OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
BODIES = {k: v.replace("{as_is}", _AS_IS) for k, v in BODIES.items()}

#: Words that say little about a licence; a choice among all words, it changes no result.
_COMMON = frozenset("a an and any are as at be but by can for from found have if in including is it its may more not of on or other see such that the this to under use used way whom with without work you".split())


def words(text: str) -> list[str]:
    return [w for w in re.split("[^a-z0-9]+", re.sub("[A-Z]", lambda m: m.group().lower(), text)) if w]


def bigrams(text: str) -> list[str]:
    w = words(text)
    return sorted({f"{a} {b}" for a, b in zip(w, w[1:], strict=False)})


def _bounds(least: float) -> tuple[int, int]:
    """Fewest and most distinct bigrams of a unit that can match any template."""
    sizes = [len(bigrams(t)) for t in TEMPLATES.values()]
    return int(-(-min(sizes) * least // (2 - least))), int(max(sizes) * (2 - least) / least)


def _touching(text: str, need: int) -> list[str]:
    """Words of which any ``need`` bigrams of the template have at least one."""
    grams, out = set(bigrams(text)), []
    total = len(grams)
    while total - len(grams) < total - need + 1:
        count = {}
        for g in sorted(grams):
            for w in set(g.split()):
                count[w] = count.get(w, 0) + 1
        best = min(count, key=lambda w: (w in _COMMON, -count[w], w))
        out.append(best)
        grams = {g for g in grams if best not in g.split()}
    return out


def _let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` evaluated once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def bucketed(grams: list[str]) -> list[list[str]]:
    """Bigrams by a hash, so that a text's are looked up among few."""
    out: list[list[str]] = [[] for _ in range(_BUCKETS)]
    for g in grams:
        out[zlib.crc32(g.encode()) % _BUCKETS].append(g)
    return out


def _passages(least: float) -> str:
    """Array of (dice, name), one per passage, of a text with normal words ``w``, ``lines`` (words of each line)."""
    quoted = lambda xs: f"array({', '.join(map(repr, xs))})" if xs else "cast(array() as array<string>)"
    rows, every = [], set()
    for unit, texts in ((True, TEMPLATES), (False, BODIES)):
        for k, t in texts.items():
            grams = bigrams(t)
            need, span = math.ceil(len(grams) * least / (2 - least) - 1e-9), int(len(grams) * (2 - least) / least + 1e-9)
            touch = _touching(t, need)
            every.update(touch)
            rows.append(f"struct('{k}' as name, {quoted(grams)} as grams, array({', '.join(map(quoted, bucketed(grams)))}) as buckets, {quoted(touch)} as touch, {need} as need, {span} as span, {str(unit).lower()} as unit)")
    dice = lambda g: f"2.0D * size(array_intersect({g}, t.grams)) / (size(array_distinct({g})) + size(t.grams))"
    of = lambda x: f"transform(sequence(1, size({x}) - 1), i -> concat({x}[i - 1], ' ', {x}[i]))"
    alike = lambda x: f"(t.unit and size({x}) > 1 and {_let(of(x), 'lg', dice('lg'))} >= {least})"
    # Of each place of g: whether its bigram is the template's, and where that bigram stood before.
    hit = f"transform(g, y -> array_contains(t.buckets[cast(crc32(cast(y as binary)) % {_BUCKETS} as int)], y))"
    ranked = "array_sort(transform(g, (y, k) -> struct(y as y, k as k)))"
    before = "transform(array_sort(transform(o, (r, k) -> struct(r.k as k, if(get(o, k - 1).y = r.y, get(o, k - 1).k, -1) as before))), r -> coalesce(r.before, -1))"
    # Ends are tried one by one: what is new since the start is counted, nothing is cut out or compared again.
    new = "if(b[k] < p[a], 1, 0)"
    score = f"if(h[k], 2.0D * (z.hits + {new}) / (z.grams + {new} + size(t.grams)), 0D)"
    window = f"""aggregate(sequence(p[a], least(p[a] + t.span, size(g)) - 1), struct(0 as grams, 0 as hits, 0D as dice, -1 as last),
        (z, k) -> struct(z.grams + {new} as grams, z.hits + if(h[k], {new}, 0) as hits, greatest(z.dice, {score}) as dice, if({score} > z.dice, k, z.last) as last))"""
    none = "cast(array() as array<struct<dice: double, name: string>>)"
    taken = _let(window, "m", f"if(m.dice >= {least}, struct(m.last as last, concat(z.found, array(struct(m.dice as dice, t.name as name))) as found), z)")
    greedy = f"""aggregate(filter(sequence(0, size(p) - t.need), a -> p[a + t.need - 1] - p[a] < t.span), struct(-1 as last, {none} as found),
        (z, a) -> if(p[a] > z.last, {taken}, z), z -> z.found)"""
    searched = _let(_let(ranked, "o", before), "b", greedy)
    placed = _let(of("x"), "g", _let(hit, "h", _let("filter(sequence(0, size(g) - 1), k -> h[k])", "p", f"if(size(p) < t.need, {none}, {searched})")))
    # A line found as a unit becomes a gap that no window spans.
    rest = f"flatten(transform(lines, l -> if({alike('l')}, array_repeat('|', t.span + 2), l)))"
    one = f"if({alike('w')}, {none}, {_let(rest, 'x', f'if(size(x) > 1, {placed}, {none})')})"
    near = f"filter(array({', '.join(rows)}), t -> arrays_overlap(w, t.touch))"
    near = _let(f"array_distinct({of('w')})", "b", f"filter({near}, t -> size(array_intersect(b, t.grams)) >= t.need)")
    return f"if(size(w) > 2 and arrays_overlap(w, array({', '.join(map(repr, sorted(every)))})), flatten(transform({near}, t -> {one})), {none})"


def scan(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """doc_id, n_matches, licenses (distinct, comma-joined), best_license, best_dice of every document."""
    low, high = _bounds(least)
    templates = ", ".join(f"struct('{k}' as name, array({', '.join(repr(b) for b in bigrams(t))}) as grams)" for k, t in TEMPLATES.items())
    lines = r"split(coalesce(text, ''), '\n', -1)"
    normal = "trim(regexp_replace(translate(u, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' '))"
    # A bigram needs two letters or digits and their gaps: shorter units cannot reach the least number of bigrams.
    passages = _let(f"split({normal.replace('translate(u,', 'translate(text,')}, ' ')", "w", _let(f"filter(transform({lines}, u -> split({normal}, ' ')), l -> l[0] != '')", "lines", _passages(least)))
    units = docs.select("doc_id", F.expr(f"if(text is null, null, {passages})").alias("passages"), F.expr(f"filter(if(size({lines}) > 1, concat({lines}, array(text)), {lines}), u -> length(u) >= {2 * low + 1})").alias("units"))
    worded = units.select("doc_id", "passages", F.expr(f"transform(units, u -> split({normal}, ' '))").alias("units"))
    # Words may repeat, so only the distinct bigrams are bounded from above.
    pairs = worded.select(
        "doc_id",
        "passages",
        F.expr(
            f"filter(transform(filter(units, w -> size(w) > {low}), w -> array_distinct(transform(sequence(1, size(w) - 1), i -> concat(w[i - 1], ' ', w[i])))), g -> size(g) between {low} and {high})"
        ).alias("units"),
    )
    matched = pairs.select(
        "doc_id",
        "passages",
        F.expr(
            f"""flatten(transform(units, g -> filter(transform(array({templates}), t -> struct(
                if(size(g) * {2 - least} >= {least} * size(t.grams) and size(t.grams) * {2 - least} >= {least} * size(g),
                   2.0D * size(array_intersect(g, t.grams)) / (size(g) + size(t.grams)), 0D) as dice, t.name as name)), m -> m.dice >= {least})))"""
        ).alias("m"),
    )
    none = "cast(array() as array<struct<dice: double, name: string>>)"
    matched = matched.select("doc_id", F.expr(f"concat(m, coalesce(passages, {none}))").alias("m"))
    best = "array_min(transform(m, x -> struct(-x.dice as d, x.name as n)))"
    return matched.select(
        "doc_id",
        F.size("m").cast("long").alias("n_matches"),
        F.expr("array_join(array_sort(array_distinct(transform(m, x -> x.name))), ',')").alias("licenses"),
        F.expr(f"{best}.n").alias("best_license"),
        F.expr(f"round(-{best}.d, 6)").alias("best_dice"),
    )


def _oracle() -> str:
    low, high = _bounds(LEAST)
    quoted = lambda t: f"[{', '.join(repr(b) for b in bigrams(t))}]"
    every = ", ".join(f"('{k}', {quoted(t)}, {unit})" for unit, texts in (("true", TEMPLATES), ("false", BODIES)) for k, t in texts.items())
    normal = lambda x: rf"string_split(trim(regexp_replace(translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g')), ' ')"
    grams = lambda w: f"list_transform(range(1, len({w})), lambda i: {w}[i] || ' ' || {w}[i + 1])"
    dice = lambda g: f"2.0::DOUBLE * len(list_intersect({g}, grams)) / (len(list_distinct({g})) + len(grams))"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
u AS (SELECT r, unnest(CASE WHEN contains(text, chr(10)) THEN list_append(string_split(text, chr(10)), text) ELSE [text] END) AS u FROM d),
w AS (SELECT r, {normal('u')} AS w FROM u),
g AS (SELECT r, list_distinct({grams('w')}) AS g FROM w WHERE len(w) > {low}),
t AS (SELECT *, ceil(len(grams) * {LEAST} / {2 - LEAST} - 1e-9) AS need, floor(len(grams) * {2 - LEAST} / {LEAST} + 1e-9)::INT AS span FROM (VALUES {every}) AS v(name, grams, unit)),
m AS (SELECT r, name, 2.0::DOUBLE * len(list_intersect(g, grams)) / (len(g) + len(grams)) AS dice FROM g, t WHERE unit AND len(g) BETWEEN {low} AND {high}),
whole AS (SELECT r, g FROM (SELECT r, {grams('w')} AS g FROM (SELECT r, {normal('text')} AS w FROM d))),
near AS (SELECT r, t.* FROM whole, t WHERE len(list_intersect(g, grams)) >= need AND NOT (unit AND {dice('g')} >= {LEAST})),
lines AS (SELECT r, i, w, {grams('w')} AS g FROM (SELECT r, i, {normal('u')} AS w FROM (SELECT r, unnest(string_split(text, chr(10))) AS u, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d)) WHERE w[1] <> ''),
x AS (
  SELECT r, name, unit, grams, span, flatten(list(CASE WHEN unit AND len(w) > 1 AND {dice('g')} >= {LEAST} THEN list_transform(range(span + 2), lambda k: '|') ELSE w END ORDER BY i)) AS x
  FROM near JOIN lines USING (r) GROUP BY ALL
),
placed AS (SELECT r, name, unit, grams, span, {grams('x')} AS g FROM x),
hits AS (SELECT * FROM (SELECT r, name, unit, grams, g, span, unnest(range(1, len(g) + 1)) AS k FROM placed) WHERE list_contains(grams, g[k])),
windows AS (
  SELECT a.r, a.name, a.unit, a.k AS first, b.k AS last, {dice('a.g[a.k:b.k]').replace('grams', 'a.grams')} AS dice
  FROM hits a JOIN hits b ON a.r = b.r AND a.name = b.name AND a.unit = b.unit AND b.k >= a.k AND b.k - a.k < a.span
),
best AS (SELECT r, name, unit, first, first(last ORDER BY dice DESC, last) AS last, max(dice) AS dice FROM windows GROUP BY ALL HAVING max(dice) >= {LEAST}),
taken AS (
  SELECT r, name, unit, list_reduce(list({{'first': first, 'last': last, 'found': [dice]}} ORDER BY first),
    lambda z, s: CASE WHEN s.first > z.last THEN {{'first': s.first, 'last': s.last, 'found': list_concat(z.found, s.found)}} ELSE z END, {{'first': 0::BIGINT, 'last': 0::BIGINT, 'found': []::DOUBLE[]}}).found AS found
  FROM best GROUP BY ALL
),
k AS (SELECT * FROM m WHERE dice >= {LEAST} UNION ALL SELECT r, name, unnest(found) FROM taken)
SELECT doc_id, count(name)::BIGINT AS n_matches, coalesce(string_agg(DISTINCT name, ',' ORDER BY name), '') AS licenses,
       first(name ORDER BY dice DESC, name) AS best_license, round(max(dice), 6) AS best_dice
FROM d LEFT JOIN k USING (r) GROUP BY r, doc_id
"""


ORACLE = _oracle()
