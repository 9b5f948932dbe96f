from __future__ import annotations

import pytest
from conftest_llm import make_docs

from echoline.llm import licenses as lic

CASES = [
    ("Licensed under CC BY-NC 4.0.", "cc-by-nc"), ("Licensed under the Apache License, Version 2.0.", "apache-2.0"), ("This work is licensed under the GNU General Public License, version 3.", "gpl"), ("Released under the MIT License.", "mit"),
    ("SPDX-License-Identifier: BSD-3-Clause", "bsd"), ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mpl"), ("You can redistribute it under the GNU Lesser General Public License", "lgpl"), ("Licensed under the GNU Affero General Public License, version 3", "agpl"),
    ("Licensed under CC BY-SA 4.0", "cc-by-sa"), ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "isc"),
]


@pytest.mark.parametrize(("text", "family"), CASES)
def test_families(text, family):
    model = lic.train()
    p = model.probabilities(text)
    assert model.families[int(p.argmax())] == family
    assert p.max() > 0.6


@pytest.mark.parametrize("text", ["He has a driving licence since May", "The copyright of that song is old", "Permission was asked and given by the mayor", "license", "gnu"])
def test_unknown(text):
    model = lic.train()
    p = model.probabilities(text)
    assert model.families[int(p.argmax())] == lic.UNKNOWN or p.max() < 0.6


def test_held_out_variants():
    import random

    model, rng, right, n = lic.train(), random.Random(99), 0, 0
    frame = [w for s in lic.OTHERS for w in s.split() if not lic.ANCHOR.search(w)]
    for family, texts in lic.TEMPLATES.items():
        for t in texts:
            for v in lic.variants(t, 10, rng, frame):
                right += model.families[int(model.probabilities(v).argmax())] == family
                n += 1
    assert right / n > 0.93


def test_scan_equals_plain_python(spark, awkward):
    rows = [(100 + k, f"Some prose here.\nAnd more.\n{t}\nIt goes on\n\nThe licence plate was bent.") for k, (t, _) in enumerate(CASES)] + awkward
    docs = make_docs(spark, rows, extra=True)
    got = lic.scan(docs).collect()
    model = lic.train()
    assert len(got) == 2 * len(CASES)
    for r in got:
        text = CASES[r["doc_id"] - 100][0] if r["paragraph"] == 0 else "The licence plate was bent."
        p = model.probabilities(text)
        assert r["best_family"] == model.families[int(p.argmax())]
        assert r["probability"] == pytest.approx(p.max(), abs=2e-5)
        if r["paragraph"] == 0:
            assert r["family"] == CASES[r["doc_id"] - 100][1]
            assert r["confirmed"] == (r["coverage"] >= lic.MIN_COVERAGE)
        else:
            assert r["family"] == lic.UNKNOWN
    assert sum(r["confirmed"] for r in got) >= len(CASES) - 1
    assert lic.scan(docs.limit(0)).count() == 0


def test_wrapped_notice_is_one_paragraph(spark):
    text = "intro\nLicensed under the Apache License,\nVersion 2.0 (the License); you may not use this file except in compliance with the License.\nbye"
    got = lic.scan(make_docs(spark, [(1, text)])).collect()
    assert [(r["family"], r["paragraph"]) for r in got] == [("apache-2.0", 0)]


def test_plan_is_native(spark, capsys):
    lic.scan(make_docs(spark, [(1, "x")])).explain()
    plan = capsys.readouterr().out
    assert "Python" not in plan
    assert "Arrow" not in plan
    assert "Join" not in plan


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:"""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies."""


def test_wrapped_notices_are_read_whole(spark):
    mixed = f"SPDX-License-Identifier: Apache-2.0\nand then\n{ISC}"
    texts = [f"A file.\n\n{MIT}\n\nThe end.", f"{ISC}\n\nThe end.", f"One.\n \n{ISC}\n\nThe licence plate was bent.", mixed]
    got = {}
    for r in lic.scan(make_docs(spark, list(enumerate(texts)))).collect():
        got.setdefault(r["doc_id"], []).append(r)
    model = lic.train()
    for k, notice, family in ((0, MIT, "mit"), (1, ISC, "isc"), (2, ISC, "isc")):
        r = min(got[k], key=lambda r: r["paragraph"])
        assert (r["family"], r["confirmed"], r["n_words"]) == (family, True, len(lic.words_of(notice)))
        assert r["probability"] == pytest.approx(model.probabilities(notice).max(), abs=2e-5)
    assert [len(got[k]) for k in (0, 1, 2)] == [1, 1, 2]
    assert len({r["paragraph"] for r in got[2]}) == 2
    assert ("apache-2.0", True) in {(r["family"], r["confirmed"]) for r in got[3]}


APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice,
   this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE
ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE
LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
CONSEQUENTIAL DAMAGES (INCLUDING LOSS OF USE, DATA, OR PROFITS) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, EVEN IF ADVISED OF THE POSSIBILITY OF
SUCH DAMAGE."""
GPL = """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details."""


@pytest.mark.parametrize(("text", "family", "paragraphs"), [(APACHE, "apache-2.0", 2), (BSD, "bsd", 3), (GPL, "gpl", 2), (MIT, "mit", 1)])
@pytest.mark.parametrize("mark", ["", " * ", "# "])
def test_wrapped_headers_are_confirmed(spark, text, family, paragraphs, mark):
    body = "\n".join(mark + line if line else "" for line in text.split("\n"))
    got = lic.scan(make_docs(spark, [(1, f"Some file\n\n{body}\n\nint main")])).collect()
    assert [(r["family"], r["confirmed"]) for r in got if r["confirmed"]] == [(family, True)] * paragraphs


def test_held_out_notices():
    """Notices of wordings that training never saw, as they stand and altered."""
    import random

    model, rng = lic.train(), random.Random(5)
    frame = [w for s in lic.OTHERS for w in s.split() if not lic.ANCHOR.search(w)]
    known = {" ".join(lic.words_of(t)) for texts in lic.TEMPLATES.values() for t in texts}
    plain = [(t, f) for f, texts in lic.HELD_OUT.items() for t in texts]
    assert not known & {" ".join(lic.words_of(t)) for t, _ in plain}
    right = lambda rows: sum(model.families[int(model.probabilities(t).argmax())] == f for t, f in rows) / len(rows)
    assert right(plain) > 0.95
    assert right([(v, f) for t, f in plain for v in lic.variants(t, 10, rng, frame)]) > 0.88


def test_probabilities_are_calibrated():
    """On altered held-out notices, the mean probability of the predictions is near the share of right ones."""
    import random

    model, rng = lic.train(), random.Random(17)
    frame = [w for s in lic.OTHERS for w in s.split() if not lic.ANCHOR.search(w)]
    rows = [(v, f) for f, texts in lic.HELD_OUT.items() for t in texts for v in lic.variants(t, 10, rng, frame)]
    p = [model.probabilities(t) for t, _ in rows]
    right = sum(model.families[int(x.argmax())] == f for x, (_, f) in zip(p, rows, strict=True)) / len(rows)
    assert abs(sum(x.max() for x in p) / len(rows) - right) < 0.08


def plain_readings(text):
    """Blocks of lines up to a blank line that hold an anchor, each with its runs of anchor lines."""
    blocks, block = [], []
    for line in [*text.split("\n"), ""]:
        if line.strip(" \t\r"):
            block.append(line)
        elif block:
            blocks.append(block)
            block = []
    out = []
    for lines in blocks:
        if any(lic.ANCHOR.search(x) for x in lines):
            runs, run = [], []
            for x in [*lines, None]:
                if x is not None and lic.ANCHOR.search(x):
                    run.append(x)
                elif run:
                    runs.append(run)
                    run = []
            out.append(("\n".join(lines), ["\n".join(r) for r in runs]))
    return out


def test_scan_equals_plain_paragraphs(spark):
    """Every paragraph that the scan reports, against the same rules in plain Python over whole texts."""
    import random

    rng, model = random.Random(23), lic.train()
    pool = [*MIT.split("\n"), *BSD.split("\n"), *GPL.split("\n"), "Released under the MIT License", "plain prose here", "more of it", "", "", "He lost his driving license", "SPDX-License-Identifier: MPL-2.0"]
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 14))) for _ in range(120)] + [MIT, BSD, f"{MIT}\n\n{GPL}"]

    def judged(t):
        words = lic.words_of(t)
        hit = any(model.vocabulary[lic.zlib.crc32(g.encode()) % lic.BUCKETS] == g for g in lic.ngrams_of(words))
        p = model.probabilities(t)
        best, share = (model.families[int(p.argmax())], float(p.max())) if hit else (lic.UNKNOWN, 1.0)
        cover = max((len(set(lic.words_of(x)) & set(words)) / len(set(lic.words_of(x))) for x in lic.TEMPLATES.get(best, [])), default=0.0)
        family = best if share >= lic.MIN_PROBABILITY else lic.UNKNOWN
        return family, best, len(words), cover >= lic.MIN_COVERAGE, cover >= lic.MIN_COVERAGE and family != lic.UNKNOWN

    wanted = []
    for doc, text in enumerate(texts):
        for whole, runs in plain_readings(text):
            block, parts = judged(whole), [judged(r) for r in runs]
            sure = [p for p in parts if p[4]]
            if block[4]:
                as_block = not any(p[0] == block[0] for p in sure) and len(sure) < len(parts)
            else:
                as_block = block[0] != lic.UNKNOWN and not any(p[0] != lic.UNKNOWN for p in parts)
            wanted += [(doc, *p[:4]) for p in ([*sure, block] if as_block else parts)]
    got = [(r["doc_id"], r["family"], r["best_family"], r["n_words"], r["confirmed"]) for r in lic.scan(make_docs(spark, list(enumerate(texts)))).collect()]
    assert sorted(got) == sorted(wanted)


def test_notices_without_an_anchor(spark):
    texts = ["Some prose.\nDistributed under the terms of the MPL 2.0\nIt goes on", "This project is covered by the EPL 2.0", "The project was covered by snow, under the terms of winter", "The licence plate was bent.\n\nThis project is covered by the MPL 2.0\n\nThe licence plate was bent."]
    got = {}
    for r in lic.scan(make_docs(spark, list(enumerate(texts)))).collect():
        got.setdefault(r["doc_id"], []).append((r["paragraph"], r["family"], r["confirmed"]))
    assert all(len({n for n, *_ in rows}) == len(rows) for rows in got.values())
    assert {k: [tuple(rest) for _, *rest in sorted(rows)] for k, rows in got.items()} == {0: [("mpl", True)], 1: [("epl", True)], 3: [(lic.UNKNOWN, False), ("mpl", True), (lic.UNKNOWN, False)]}


def test_no_confirmed_block_is_passed_over(spark):
    import random

    rng, model = random.Random(5), lic.train()
    frame = [w for s in lic.OTHERS for w in s.split() if not lic.ANCHOR.search(w)]
    texts = [v for notices in lic.TEMPLATES.values() for t in notices for v in lic.variants(lic.ANCHOR.sub("", t), 6, rng, frame)] + [f for f in lic.OTHERS if not lic.ANCHOR.search(f)]
    texts = [t for t in texts if not lic.ANCHOR.search(t)]
    wanted = set()
    for k, text in enumerate(texts):
        p, words = model.probabilities(text), set(lic.words_of(text))
        family = model.families[int(p.argmax())]
        shares = [len(words & set(lic.words_of(t))) / len(set(lic.words_of(t))) for t in lic.TEMPLATES.get(family, [])]
        if round(p.max(), 6) >= lic.MIN_PROBABILITY and max(shares, default=0) >= lic.MIN_COVERAGE:
            wanted.add((k, family))
    assert len({f for _, f in wanted}) > 3
    assert {(r["doc_id"], r["family"]) for r in lic.scan(make_docs(spark, list(enumerate(texts)))).collect()} == wanted
