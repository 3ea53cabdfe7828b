"""Licence scan: word bigrams of every line, paragraph, window and text against licence templates.

Native column expressions over each row; no shuffle and no join. A unit is a
line of the text, a paragraph (between blank lines), the whole text, or a window of as many words as a
template has, across line breaks: windows lie where one of the template's anchor words stands
at its place in the template. Every match of a window holds an anchor word, as pairs without
them are too few; so notices that are wrapped, marked as comments or amid prose are found. Its words are the runs of ASCII letters,
digits and non-ASCII characters after lower-casing A-Z; its features are the
distinct pairs of neighbouring words. A unit matches a template when the Dice
coefficient of the two sets is at least ``threshold``. Templates whose size lies
outside ``threshold / (2 - threshold)`` and its inverse times the unit's size
cannot reach it and are not compared; units that share too few pairs with all
templates together are not either. A match holds at least
``threshold / (2 - threshold)`` of the template's pairs, so texts and lines
without any of a few words that touch the other pairs of every template are
left out before they are cut into words. All these bounds are exact.

Null and empty texts match nothing. Ties go to the template named first in
alphabetical order; of a text's windows that match one licence the best is reported, the first one
on ties, unless a better window of another licence overlaps it. Repeated rows are reported each, null keys are kept, an empty table gives no rows, other
columns do not matter, and texts of any length are read whole.
"""

from __future__ import annotations

import re
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Public licence notices and whole licence texts.
BSD_TERMS = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution. "
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from "
    "this software without specific prior written permission.")
BSD_DISCLAIMER = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, "
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
    "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
    "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
    "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
    "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, "
    "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:")
MIT_REST = (
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, "
    "DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE "
    "USE OR OTHER DEALINGS IN THE SOFTWARE.")
ISC_GRANT = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
    "copyright notice and this permission notice appear in all copies.")
ISC_DISCLAIMER = (
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF "
    "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
    "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
    "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.")
TEMPLATES = {
    "AGPL-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
                 "This work is licensed under the GNU Affero General Public License, version 3."],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.",
                   "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
                   "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
                   "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
                   "See the License for the specific language governing permissions and limitations under the License."],
    "BSD-3-Clause": ["Released under the BSD 3-Clause License.",
                     BSD_TERMS + " " + BSD_DISCLAIMER,
                     "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.",
                "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.",
                "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "ISC": [ISC_GRANT, ISC_GRANT + " " + ISC_DISCLAIMER],
    "MIT": ["Released under the MIT License.", MIT_GRANT, MIT_GRANT + " " + MIT_REST],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}
WORD = r"[0-9a-z\x{80}-\x{10ffff}]+"
A_Z, a_z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def template_words(text: str) -> list[str]:
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", text.translate(str.maketrans(A_Z, a_z)))


def template_bigrams(templates: dict[str, list[str]]) -> list[tuple[str, list[str]]]:
    """(template name, sorted distinct bigrams), one entry per wording."""
    out = []
    for name, texts in sorted(templates.items()):
        for text in texts:
            words = template_words(text)
            out.append((name, sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})))
    return out


def ratio(threshold: float) -> tuple[int, int]:
    """The threshold as it is written, in whole numbers: bounds on sets of words are exact with these."""
    exact = Fraction(str(threshold))
    return exact.numerator, exact.denominator


def needed_words(templates: list[tuple[str, list[str]]], threshold: float) -> list[str]:
    """Words of which every match of any template holds at least one (as part of a word).

    Pairs free of these words are too few for a match, in every template. Chosen
    greedily: the word that brings most templates furthest; words of up to four letters
    only where no longer one helps, those found in few templates first.
    """
    top, base = ratio(threshold)
    open_ = [(set(bs), Fraction(top * len(bs), 2 * base - top)) for _, bs in templates]
    words = sorted({w for _, bs in templates for b in bs for w in b.split(" ")}, key=lambda w: (-len(w), w))
    common = {w: sum(any(w in b.split(" ") for b in bs) for _, bs in templates) for w in words}
    chosen: list[str] = []
    while any(len(free) >= most for free, most in open_):
        gain = lambda w: sum(min(sum(w in b for b in free), len(free) - most + 1) for free, most in open_ if len(free) >= most)
        best = max(words, key=lambda w: (gain(w) * (len(w) > 4), gain(w), -common[w]))
        chosen.append(best)
        open_ = [({b for b in free if best not in b}, most) for free, most in open_]
    return chosen


def anchors(templates: dict[str, list[str]], threshold: float) -> list[tuple[str, int, int, int]]:
    """(word, template number, place in it, words of it): the anchor words of each template.

    Taken greedily, the word of most pairs first, until the template's pairs without any of them are too few for a
    match; words of up to four letters, which stand in any text, only where no longer one helps.
    """
    top, base = ratio(threshold)
    out = []
    for number, text in enumerate(t for _, texts in sorted(templates.items()) for t in texts):
        words = template_words(text)
        free = {(a, b) for a, b in zip(words, words[1:], strict=False)}
        most = Fraction(top * len(free), 2 * base - top)
        chosen: set[str] = set()
        while free and len(free) >= most:
            gain = lambda w: sum(w in pair for pair in free)
            best = max(sorted(set(words) - chosen), key=lambda w: (gain(w) * (len(w) > 4), gain(w), len(w)))
            chosen.add(best)
            free = {pair for pair in free if best not in pair}
        out += [(w, number, n, len(words)) for n, w in enumerate(words) if w in chosen and len(words) > 1]
    return out


def window_hits(text: Column, templates: dict[str, list[str]], wording: list[tuple[str, list[str]]], threshold: float) -> Column:
    """Structs (rank, start, name, stop) of the best matching window for each licence, but for those
    that a better one of another licence overlaps."""
    top, base = ratio(threshold)
    places = anchors(templates, threshold)
    table = F.array(*[F.struct(F.lit(w).alias("w"), F.lit(t).alias("t"), F.lit(n).alias("n"), F.lit(size).alias("size")) for w, t, n, size in places])
    known = F.array(*[F.lit(w) for w in sorted({p[0] for p in places})])
    grams = F.array(*[F.array(*[F.lit(b) for b in bs]) for _, bs in wording])
    names = F.array(*[F.lit(name) for name, _ in wording])
    once = lambda value, fn: F.element_at(F.transform(F.array(value), fn), 1)  # noqa: E731 - a value that is computed once

    def with_words(words: Column) -> Column:
        pairs = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.size(words)), lambda a, b: F.concat_ws(" ", a, b))
        spots = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda s: F.array_contains(known, s["w"]))
        starts = F.flatten(F.transform(spots, lambda s: F.transform(
            F.filter(table, lambda a: (a["w"] == s["w"]) & (s["i"] >= a["n"]) & (s["i"] - a["n"] + a["size"] <= F.size(words))),
            lambda a: F.struct(a["t"].alias("t"), (s["i"] - a["n"]).alias("start"), a["size"].alias("size")))))
        return once(pairs, lambda p: F.filter(F.transform(F.array_distinct(starts), lambda s: scored(p, s)), lambda h: h["rank"].isNotNull()))

    def scored(pairs: Column, s: Column) -> Column:
        def dice(own: Column) -> Column:
            wanted = F.element_at(grams, s["t"] + 1)
            shared, both = F.size(F.array_intersect(own, wanted)), F.size(own) + F.size(wanted)
            return F.struct(F.when(shared * 2 * base >= both * top, -2.0 * shared / both).alias("rank"), s["start"].alias("start"), F.element_at(names, s["t"] + 1).alias("name"),
                            (s["start"] + s["size"]).alias("stop"))
        # place by place: a slice would copy the whole text's pairs for every window
        return once(F.array_distinct(F.transform(F.sequence(s["start"], s["start"] + s["size"] - 2), lambda i: F.get(pairs, i))), dice)

    best = lambda hits: F.transform(F.array_distinct(F.transform(hits, lambda h: h["name"])),
                                    lambda name: F.array_min(F.filter(hits, lambda h: h["name"] == name)))
    better = lambda g, h: (g["rank"] < h["rank"]) | (g["rank"] == h["rank"]) & (g["name"] < h["name"])
    alone = lambda hits: F.filter(hits, lambda h: ~F.exists(hits, lambda g: (g["start"] < h["stop"]) & (h["start"] < g["stop"]) & better(g, h)))
    return once(once(once(words_of_text(text), with_words), best), alone)


def words_of_text(text: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(F.translate(text, A_Z, a_z), r"[^0-9a-z\x{80}-\x{10ffff}]+", " ")), " ")


def holds_any(text: Column, words: list[str]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | F.contains(text, F.lit(w))
    return found


def bigrams(text: Column) -> Column:
    """Distinct pairs of neighbouring words."""
    words = words_of_text(text)
    return F.when(F.size(words) > 1, F.array_distinct(F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.size(words)), lambda a, b: F.concat_ws(" ", a, b)))).otherwise(F.array().cast("array<string>"))


def match_bigrams(own: Column, templates: list[tuple[str, list[str]]], threshold: float) -> Column:
    """Best (name, dice) struct for a set of bigrams, or null."""
    everything = F.array(*[F.lit(b) for b in sorted({b for _, bs in templates for b in bs})])
    top, base = ratio(threshold)  # the sizes of a match are within top to other of each other
    other = 2 * base - top

    def scored(own_: Column) -> Column:
        common, n = F.array_intersect(own_, everything), F.size(own_)
        hits = []
        for name, bs in templates:
            m = len(bs)
            fits = (n * other >= top * m) & (n * top <= other * m) & (F.size(common) * 2 * base >= (n + m) * top)
            shared = F.size(F.array_intersect(common, F.array(*[F.lit(b) for b in bs])))
            dice = 2.0 * shared / (n + m)
            hits.append(F.when(fits & (shared * 2 * base >= (n + m) * top), F.struct((-dice).alias("rank"), F.lit(name).alias("name"))))
        return F.array_min(F.array_compact(F.array(*hits)))

    sizes = [len(bs) for _, bs in templates]
    return F.when((F.size(own) * other >= top * min(sizes)) & (F.size(own) * top <= other * max(sizes)) & F.arrays_overlap(own, everything), scored(own))


def license_lines(docs: DataFrame, *, key: str = "doc_id", text: str = "text", threshold: float = 0.8,
                  templates: dict[str, list[str]] | None = None) -> DataFrame:
    """(key, kind, unit, license, dice) of every match. Kinds: ``line`` and ``paragraph`` (numbered from
    0; paragraphs of texts that have several), ``text`` (unit -1, of several lines), ``window`` (unit: its first word)."""
    templates = templates or TEMPLATES
    wording = template_bigrams(templates)
    words = needed_words(wording, threshold)
    # explode_outer of one value: the filter stays above it, so the text is lower-cased once.
    docs = docs.select(F.col(key).alias(key), F.col(text).alias("text"), F.explode_outer(F.array(F.lower(F.coalesce(F.col(text), F.lit(""))))).alias("low"))
    docs = docs.filter(holds_any(F.col("low"), words)).select(key, "text")
    whole = F.coalesce(F.col("text"), F.lit(""))
    lines = F.split(whole, "\n", -1)
    parts = F.split(whole, r"\n[ \t\r]*\n", -1)
    none = F.array().cast("array<struct<kind:string,unit:int,s:string>>")
    numbered = lambda pieces, kind: F.transform(pieces, lambda s, i: F.struct(F.lit(kind).alias("kind"), i.alias("unit"), s.alias("s")))
    units = F.concat(numbered(lines, "line"), F.when(F.size(parts) > 1, numbered(parts, "paragraph")).otherwise(none),
                     F.when(F.size(lines) > 1, F.array(F.struct(F.lit("text").alias("kind"), F.lit(-1).alias("unit"), whole.alias("s")))).otherwise(none))
    exploded = docs.select(key, F.explode_outer(units).alias("u")).filter(holds_any(F.lower(F.col("u.s")), words))
    exploded = exploded.select(key, "u.kind", "u.unit", bigrams(F.col("u.s")).alias("own"))
    # explode_outer keeps the filter above the match, which is then computed once.
    found = exploded.select(key, "kind", "unit", F.explode_outer(F.array(match_bigrams(F.col("own"), wording, threshold))).alias("hit")).filter("hit is not null")
    found = found.select(key, "kind", "unit", F.col("hit.name").alias("license"), (-F.col("hit.rank")).alias("dice"))
    windows = docs.select(key, F.explode(window_hits(whole, templates, wording, threshold)).alias("hit"))
    windows = windows.select(key, F.lit("window").alias("kind"), F.col("hit.start").alias("unit"), F.col("hit.name").alias("license"), (-F.col("hit.rank")).alias("dice"))
    every = found.unionByName(windows)
    return every.select(key, "kind", "unit", "license", F.round("dice", 6).alias("dice"))
