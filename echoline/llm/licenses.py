"""Licence scans by a trained paragraph classifier, run as DataFrame expressions only.

A multinomial logistic regression over sparse word n-grams (one to three words) is trained on variants of licence notices
and of some paragraphs of licence texts: words dropped, cut and framed by other words. Everyday sentences train the
unknown class. A temperature fitted on notices of other wordings, which training never sees, calibrates the
probabilities, and a prediction below MIN_PROBABILITY counts as unknown. A prediction is confirmed when the
paragraph covers a template of its family. The training set is fixed and small, so the fit runs at planning time; the
scan of the corpus is one narrow pass of built-in functions, without a join or a shuffle.

Paragraphs come from blocks of lines up to a blank one. A block is read as a whole, as its runs of neighbouring anchor lines
and as its runs of other neighbouring lines that hold a key word; all readings are classified and compared with all their words. The
whole block is the paragraph where it is confirmed for a family that no run of it is, or where it has a known family and no run
has; runs confirmed for themselves stay paragraphs beside it. Otherwise the runs are the paragraphs. Their numbers rise, with gaps
where runs were joined. What holds an anchor is a paragraph whatever it is judged to be; what holds none is one where it is
confirmed. So blocks without an anchor need only be classified where they cover a template (`Covered`), which is tested on
every text and loses none of them.

Defined results: null and empty texts, texts that neither hold an anchor nor are confirmed and empty tables give no rows; a paragraph without known n-grams is
unknown; of families of equal probability the first of TEMPLATES counts; rows without an id keep their rows under a null id; repeated
rows give repeated results; other columns, whatever their names, are left behind.
"""

from __future__ import annotations

import functools
import random
import re
import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN, SEED, VARIANTS, BUCKETS, ITERATIONS, RIDGE = "unknown", 11, 24, 1 << 13, 300, 2e-4
MIN_PROBABILITY, MIN_COVERAGE, LEAST_SEEN = 0.6, 0.7, 5

# Notices by family and the paragraphs of their full texts, as they stand in public sources.
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. See the NOTICE file distributed with this work for additional information regarding copyright ownership. The ASF licenses this file to you under the Apache License, Version 2.0",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        "SPDX-License-Identifier: MIT",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file", "SPDX-License-Identifier: BSD-3-Clause", "SPDX-License-Identifier: BSD-2-Clause",
    ],
    "gpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see http://www.gnu.org/licenses/",
        "SPDX-License-Identifier: GPL-3.0-or-later", "SPDX-License-Identifier: GPL-2.0-only",
    ],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
        "You should have received a copy of the GNU Lesser General Public License along with this library",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "agpl": [
        "You can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Affero General Public License along with this program. If not, see http://www.gnu.org/licenses/",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "epl": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
        "SPDX-License-Identifier: EPL-2.0",
    ],
    "cc-by": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/",
        "Available under the Creative Commons Attribution License", "SPDX-License-Identifier: CC-BY-4.0",
    ],
    "cc-by-sa": [
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by-sa/4.0/",
        "Text is available under the Creative Commons Attribution-ShareAlike License", "SPDX-License-Identifier: CC-BY-SA-4.0",
    ],
    "cc-by-nc": [
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by-nc/4.0/",
        "Text is available under the Creative Commons Attribution-NonCommercial License", "SPDX-License-Identifier: CC-BY-NC-4.0",
    ],
    "cc0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work, under CC0 1.0 Universal",
        "SPDX-License-Identifier: CC0-1.0",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
        "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS",
        "SPDX-License-Identifier: ISC",
    ],
    "unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means, under the Unlicense into the public domain",
        "SPDX-License-Identifier: Unlicense",
    ],
    "proprietary": [
        "All rights reserved. No part of this publication may be reproduced without prior written permission of the copyright holder",
        "Proprietary and confidential. Unauthorized copying of this file is strictly prohibited. Copyright. All rights reserved",
    ],
}
# Names of licences, and short notices that training sets them into.
NAMES = {
    "apache-2.0": ["Apache License, Version 2.0", "Apache 2.0 license"], "mit": ["MIT License"], "bsd": ["BSD license", "BSD 3-Clause License"],
    "gpl": ["GNU General Public License, version 3", "GPL version 2", "GNU GPL v3 or later"], "lgpl": ["GNU Lesser General Public License, version 3", "LGPL version 2.1"], "agpl": ["GNU Affero General Public License, version 3", "AGPL version 3"],
    "mpl": ["Mozilla Public License, version 2.0", "MPL 2.0"], "epl": ["Eclipse Public License, version 2.0", "EPL 2.0"],
    "cc-by": ["Creative Commons Attribution 4.0 License", "CC BY 4.0"], "cc-by-sa": ["Creative Commons Attribution-ShareAlike 4.0 License", "CC BY-SA 4.0"], "cc-by-nc": ["Creative Commons Attribution-NonCommercial 4.0 License", "CC BY-NC 4.0"],
    "cc0": ["CC0 1.0", "CC0 public domain dedication"], "isc": ["ISC License"], "unlicense": ["Unlicense"], "proprietary": ["proprietary license of the company, all rights reserved"],
}
FRAMES = ["Licensed under the {}", "Distributed under the terms of the {}", "This project is covered by the {}"]
TEMPLATES = {family: [*texts, *[frame.format(name) for name in NAMES[family] for frame in FRAMES]] for family, texts in TEMPLATES.items()}
OTHERS = ["He lost his driving license last year and had to take the bus", "The license plate of the car was covered with mud", "Please accept the licence agreement to go on", "A fishing licence is required at this lake", "The council gave permission to build a new school", "You need permission to enter the building", "The copyright office is closed on Sundays", "The warranty covers parts and labour for two years", "The company sells its software licenses by the seat", "A pilot must renew the licence every five years", "Redistribution of wealth was the topic of the debate", "Spring brought rain and the river rose", "The band played until the public domain park closed", "An apache helicopter landed near the village", "Students at MIT built a small robot", "Sublicense fees were discussed by the board", "Distributed systems need careful clocks", "The film was released under another title", "Released in March under the old version number", "Materials are made available at the front desk"]
# Notices of other wordings, which training never sees; they calibrate the probabilities.
HELD_OUT = {
    "apache-2.0": ["Released under the Apache License 2.0", "This work may be used under Apache License v2.0"],
    "mit": ["Released under the MIT License", "Use of this source code is governed by an MIT license"],
    "bsd": ["Released under the 3-clause BSD license", "All rights are granted under the 2-clause BSD license"],
    "gpl": ["This work is licensed under the GNU General Public License, version 3", "Released under GNU GPL v2"],
    "lgpl": ["Released under the GNU Lesser General Public License", "You may copy this library under the LGPL 3"],
    "agpl": ["Released under the GNU Affero General Public License"],
    "mpl": ["Released under the Mozilla Public License 2.0"],
    "epl": ["Made available under the Eclipse Public License 1.0"],
    "cc-by": ["Released under a Creative Commons Attribution 4.0 licence"],
    "cc-by-sa": ["Released under CC BY-SA 3.0", "Shared under a Creative Commons Attribution-ShareAlike 3.0 license"],
    "cc-by-nc": ["Released under CC BY-NC 3.0", "Shared under a Creative Commons Attribution-NonCommercial license"],
    "cc0": ["Dedicated to the public domain with CC0 1.0 Universal"],
    "isc": ["Released under an ISC license"],
    "unlicense": ["Released into the public domain by the Unlicense"],
    "proprietary": ["This document is confidential and proprietary. All rights reserved"],
    UNKNOWN: ["A hunting licence costs forty euros a season", "Their permission slip was signed by both parents", "The warranty of the old car had expired", "She holds the copyright of three novels", "The redistribution of seats followed the census", "The gnu grazed behind the fence"],
}
ANCHOR = re.compile(r"(?i)licen[sc]|spdx|copyright|warrant|redistribut|permission|permitted|unencumbered|public domain|all rights reserved|gnu|gpl|apache|mozilla|creative commons|\bcc[ -]by|cc0|bsd|eclipse public")
#: What each match of ANCHOR holds in lower case: found by plain search, which is much cheaper than the expression.
ANCHOR_TEXTS = ["licens", "licenc", "spdx", "copyright", "warrant", "redistribut", "permission", "permitted", "unencumbered", "public domain", "all rights reserved", "gnu", "gpl", "apache", "mozilla", "creative commons", "cc by", "cc-by", "cc0", "bsd", "eclipse public"]
WORD = r"[a-z0-9]+(?:\.[0-9]+)*"
NO_LINE = "\x00"
#: Words of templates that stand in most prose; only costs depend on them.
COMMON = {"a", "an", "and", "any", "as", "at", "be", "by", "for", "from", "have", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "under", "with", "you"}


def words_of(text: str) -> list[str]:
    return re.findall(WORD, text.lower())


def ngrams_of(words: list[str]) -> list[str]:
    """Distinct n-grams, in order."""
    grams = [" ".join(words[k : k + n]) for n in (1, 2, 3) for k in range(len(words) - n + 1)]
    return list(dict.fromkeys(grams))


def variants(text: str, n: int, rng: random.Random, frame: list[str]) -> list[str]:
    out = [text]
    for _ in range(n - 1):
        words = text.split()
        if len(words) > 5 and rng.random() < 0.6:
            start = rng.randrange(0, max(1, len(words) // 4))
            words = words[start : len(words) - rng.randrange(0, max(1, len(words) // 4))]
        words = [w for w in words if len(words) < 6 or rng.random() > 0.08]
        if rng.random() < 0.4:
            words = rng.sample(frame, rng.randrange(1, 8)) + words
        if rng.random() < 0.4:
            words = words + rng.sample(frame, rng.randrange(1, 8))
        out.append(" ".join(words))
    return out


class Model:
    """families: class names, the unknown one last; vocabulary: bucket -> n-gram; weights: bucket x class."""

    def __init__(self, families: list[str], vocabulary: list[str], weights: np.ndarray, bias: np.ndarray, temperature: float):
        self.families, self.vocabulary, self.weights, self.bias, self.temperature = families, vocabulary, weights, bias, temperature

    def probabilities(self, text: str) -> np.ndarray:
        """The same computation in plain Python, for tests."""
        z = self.bias.copy()
        for gram in ngrams_of(words_of(text)):
            bucket = zlib.crc32(gram.encode()) % BUCKETS
            if self.vocabulary[bucket] == gram:
                z += self.weights[bucket]
        z = np.exp((z - z.max()) / self.temperature)
        return z / z.sum()


def examples(notices: dict[str, list[str]], families: list[str], rng: random.Random, frame: list[str]) -> list[tuple[str, int]]:
    return [(v, families.index(f)) for f, texts in notices.items() for t in texts for v in variants(t, VARIANTS, rng, frame)]


@functools.lru_cache(maxsize=1)
def train() -> Model:
    rng = random.Random(SEED)
    frame = [w for s in OTHERS for w in s.split() if not ANCHOR.search(w)]
    families = [*TEMPLATES, UNKNOWN]
    known, held = examples(TEMPLATES | {UNKNOWN: OTHERS}, families, rng, frame), examples(HELD_OUT, families, rng, frame)
    seen: dict[str, int] = {}
    for text, _ in known:
        for gram in ngrams_of(words_of(text)):
            seen[gram] = seen.get(gram, 0) + 1
    vocabulary = [""] * BUCKETS
    for gram in sorted(seen, key=lambda g: (-seen[g], g)):
        bucket = zlib.crc32(gram.encode()) % BUCKETS
        if seen[gram] >= LEAST_SEEN and not vocabulary[bucket]:
            vocabulary[bucket] = gram
    used = [b for b, g in enumerate(vocabulary) if g]
    column = {vocabulary[b]: k for k, b in enumerate(used)}

    def features(rows: list[tuple[str, int]]) -> tuple[np.ndarray, np.ndarray]:
        x = np.zeros((len(rows), len(used)), np.float32)
        for r, (text, _) in enumerate(rows):
            x[r, [column[g] for g in ngrams_of(words_of(text)) if g in column]] = 1
        return x, np.array([c for _, c in rows])

    x, y = features(known)
    target = np.eye(len(families), dtype=np.float32)[y]
    pull = (1 / np.bincount(y, minlength=len(families)))[y, None].astype(np.float32) / len(families)
    w, b = np.zeros((len(used), len(families)), np.float32), np.zeros(len(families), np.float32)
    seen_w, seen_b = np.full_like(w, 1e-8), np.full_like(b, 1e-8)
    for _ in range(ITERATIONS):
        z = x @ w + b
        p = np.exp(z - z.max(1, keepdims=True))
        g = (p / p.sum(1, keepdims=True) - target) * pull
        gw, gb = x.T @ g + RIDGE * w, g.sum(0)
        seen_w, seen_b = seen_w + gw * gw, seen_b + gb * gb
        w, b = w - 0.3 * gw / np.sqrt(seen_w), b - 0.3 * gb / np.sqrt(seen_b)
    held_x, held_y = features(held)
    z = (held_x @ w + b).astype(np.float64)

    def loss(t: float) -> float:
        s = z / t
        return float(-(s - s.max(1, keepdims=True) - np.log(np.exp(s - s.max(1, keepdims=True)).sum(1, keepdims=True)))[np.arange(len(s)), held_y].mean())

    temperature = min((0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0), key=loss)
    weights = np.zeros((BUCKETS, len(families)))
    weights[used] = w
    return Model(families, vocabulary, np.round(weights, 4), np.round(b.astype(np.float64), 4), temperature)


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def words_in(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def anchored(text: Column) -> Column:
    held = once(F.lower(text), lambda t: functools.reduce(lambda a, b: a | b, [F.contains(t, F.lit(x)) for x in ANCHOR_TEXTS]))
    return F.coalesce(held & text.rlike(ANCHOR.pattern), F.lit(False))


class Covered:
    """Exact tests of whether words can cover a template: least[k] of its words have to be there for a coverage of
    min_coverage. keys holds, of each template, as many words as may be missing and one more (long words and none of COMMON
    as far as they suffice, so rare ones), so who covers it holds a key word. Both grow with the words: a part of a text holds what the text does at most."""

    def __init__(self, min_coverage: float):
        self.templates = [list(dict.fromkeys(words_of(t))) for texts in TEMPLATES.values() for t in texts]
        self.least = [next((h for h in range(len(w) + 1) if round(h / len(w), 6) >= min_coverage), len(w) + 1) for w in self.templates]
        self.all = 0 in self.least
        reachable = [(w, n) for w, n in zip(self.templates, self.least, strict=True) if n <= len(w)]
        self.keys = sorted({x for w, n in reachable for x in sorted(w, key=lambda x: (x in COMMON, -len(x), x))[: len(w) - n + 1]})

    def key(self, words: Column) -> Column:
        return F.size(words) > 0 if self.all else F.arrays_overlap(words, F.split(F.lit(" ".join(self.keys)), " "))

    def test(self, words: Column) -> Column:
        if self.all or not self.keys:
            return self.key(words) if self.all else F.lit(False)
        known = F.split(F.lit(" ".join(sorted({x for w in self.templates for x in w}))), " ")
        each = F.array(*[F.struct(F.split(F.lit(" ".join(w)), " ").alias("w"), F.lit(n).alias("n")) for w, n in zip(self.templates, self.least, strict=True)])
        return self.key(words) & once(F.array_intersect(known, words), lambda held: F.exists(each, lambda t: F.size(F.array_intersect(t["w"], held)) >= t["n"]))


def numbers(values) -> Column:
    """A literal array of doubles; one string in the plan instead of thousands of literals."""
    return F.split(F.lit(" ".join(f"{v:g}" for v in values)), " ").cast("array<double>")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_probability: float = MIN_PROBABILITY, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """(doc_id, paragraph, family, probability, best_family, template, coverage, confirmed, n_words): a row for each licence-like paragraph."""
    model = train()
    n = len(model.families)
    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    can = Covered(min_coverage)
    read = lambda text: anchored(text) | once(words_in(text), can.test)
    texts = texts.where(read(F.col("text")))
    blocks = F.filter(F.split("text", "\n(?:[ \t\r]*\n)+"), read)

    def runs_of(block: Column, kept: Callable[[Column], Column]) -> Column:
        lines = F.transform(F.split(block, "\n"), lambda line: F.when(kept(line), line).otherwise(F.lit(NO_LINE)))
        return F.filter(F.split(F.array_join(lines, "\n"), f"(?:^|\n)(?:{NO_LINE}(?:\n|$))+"), lambda b: F.length(F.trim(b)) > 0)

    def readings(block: Column) -> Column:
        """The whole block, its runs of anchor lines, its runs of other lines with key words that can cover a template."""
        runs = runs_of(block, anchored)
        free = F.filter(runs_of(block, lambda line: ~anchored(line) & can.key(words_in(line))), lambda run: once(words_in(run), can.test))
        return once(runs, lambda runs: F.struct(F.size(runs).alias("m"), F.concat(F.array(block), runs, free).alias("r")))

    # outer: before a plain explode the optimizer filters by the array, for which all that leads to it is computed again and again
    # a block without an anchor is no run of itself, but may be a paragraph
    size = lambda a: F.size(a["r"]) - F.when(a["m"] > 0, 1).otherwise(0)
    rows = texts.select("doc_id", F.transform(blocks, readings).alias("all")).select("doc_id", F.transform("all", size).alias("sizes"), F.posexplode_outer("all").alias("k", "a")).where("k IS NOT NULL")
    rows = rows.select("doc_id", F.aggregate(F.slice("sizes", 1, F.col("k")), F.lit(0), lambda n, size: n + size).alias("before"), F.col("a.m").alias("m"), F.col("a.r").alias("r"))

    def each(step: Callable[[Column], Column]) -> DataFrame:
        return rows.withColumn("r", F.transform("r", step))

    rows = each(words_in)

    def grams(words: Column, size: int) -> Column:
        found = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - size + 1, F.lit(1))), lambda k: F.array_join(F.slice(words, k, size), " "))
        return F.when(F.size(words) >= size, found).otherwise(F.array().cast("array<string>"))

    vocabulary = F.split(F.lit("|".join(model.vocabulary)), r"\|", -1)
    def hits(words: Column) -> Column:
        known = F.transform(F.array_distinct(F.concat(grams(words, 1), grams(words, 2), grams(words, 3))), lambda g: F.struct(g.alias("g"), F.pmod(F.crc32(g.cast("binary")), F.lit(BUCKETS)).cast("int").alias("h")))
        return F.transform(F.filter(known, lambda s: F.get(vocabulary, s["h"]) == s["g"]), lambda s: s["h"])

    rows = each(lambda w: F.struct(w.alias("words"), hits(w).alias("hits")))
    weights, bias = numbers(model.weights.ravel()), numbers(model.bias)
    total = lambda h, c: F.aggregate(h, F.get(bias, c), lambda acc, k: acc + F.get(weights, k * n + c))
    rows = each(lambda r: F.struct(r["words"].alias("words"), (F.size(r["hits"]) > 0).alias("hit"), F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda c: total(r["hits"], c)).alias("z")))
    rows = each(lambda r: F.struct(r["words"].alias("words"), r["hit"].alias("hit"), F.array_max(r["z"]).alias("top"), r["z"].alias("z")))
    rows = each(lambda r: F.struct(r["words"].alias("words"), r["hit"].alias("hit"), F.transform(r["z"], lambda v: F.exp((v - r["top"]) / model.temperature)).alias("e")))
    families = F.array(*[F.lit(f) for f in model.families])
    best = lambda e: F.get(families, (F.array_position(e, F.array_max(e)) - 1).cast("int"))
    share = lambda e: F.round(F.array_max(e) / F.aggregate(e, F.lit(0.0), lambda a, v: a + v), 6)
    rows = each(lambda r: F.struct(r["words"].alias("words"), F.when(r["hit"], share(r["e"])).otherwise(F.lit(1.0)).alias("probability"), F.when(r["hit"], best(r["e"])).otherwise(F.lit(UNKNOWN)).alias("best_family")))
    flat = [(f, t) for f, texts_ in TEMPLATES.items() for t in texts_]
    templates = F.array(*[F.struct(F.lit(f).alias("f"), F.lit(t).alias("t"), F.split(F.lit(" ".join(dict.fromkeys(words_of(t)))), " ").alias("w")) for f, t in flat])
    covered = lambda r: F.array_max(F.transform(F.filter(templates, lambda t: t["f"] == r["best_family"]), lambda t: F.struct(F.round(F.size(F.array_intersect(t["w"], r["words"])) / F.size(t["w"]), 6).alias("coverage"), F.size(t["w"]).alias("n"), t["t"].alias("template"))))
    rows = each(lambda r: F.struct(F.when(r["probability"] >= min_probability, r["best_family"]).otherwise(F.lit(UNKNOWN)).alias("family"), r["probability"].alias("probability"), r["best_family"].alias("best_family"), covered(r).alias("top"), F.size(r["words"]).alias("n_words")))
    confirmed = lambda r: (F.coalesce(r["top"]["coverage"], F.lit(0.0)) >= min_coverage) & (r["family"] != UNKNOWN)
    m = F.col("m")
    rows = rows.select("doc_id", "before", "m", F.get("r", F.lit(0)).alias("block"), F.slice("r", 2, m).alias("runs"), F.filter(F.slice("r", m + 2, F.size("r") - 1 - m), confirmed).alias("free"))
    ours = lambda r: confirmed(r) & (r["family"] == F.col("block.family"))
    own = F.exists("runs", ours) | F.exists("free", ours)
    as_block = F.when(confirmed(F.col("block")), ~own & (F.exists("runs", lambda r: ~confirmed(r)) | (m == 0)))
    as_block = as_block.otherwise((m > 0) & (F.col("block.family") != UNKNOWN) & ~F.exists("runs", lambda r: (r["family"] != UNKNOWN) | confirmed(r)) & (F.size("free") == 0))
    rows = rows.withColumn("as_block", as_block)
    rows = rows.withColumn("runs", F.concat(F.when(F.col("as_block"), F.concat(F.filter("runs", confirmed), F.array("block"))).otherwise(F.col("runs")), F.col("free")))
    rows = rows.select("doc_id", "before", F.posexplode_outer("runs").alias("k", "p")).where("k IS NOT NULL").select("doc_id", (F.col("before") + F.col("k")).alias("paragraph"), "p.*")
    coverage = F.coalesce("top.coverage", F.lit(0.0))
    return rows.select("doc_id", "paragraph", "family", "probability", "best_family", F.col("top.template").alias("template"), coverage.alias("coverage"), (coverage >= min_coverage).alias("confirmed"), "n_words")
