import random
import zlib

import numpy as np
import pandas as pd
import pytest

from brute import WORD, smallest_reachable, word_set

from textyard.llm import attribution, licences, line_dedup, mixing, ngram_join, packing, quality, toxicity
from textyard.llm.components import components
from textyard.llm.setjoin import Likeness


def variants(seed, n):
    """Documents of several families, edited more or less, with shared lines."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    families = [[rng.choice(words) for _ in range(rng.randint(20, 80))] for _ in range(6)]
    common = " ".join(rng.choice(words) for _ in range(12))
    rows = []
    for i in range(n):
        mine = list(rng.choice(families))
        for _ in range(rng.choice((0, 0, 1, 1, 2, 4, 9))):
            mine[rng.randrange(len(mine))] = rng.choice(words)
        cut = rng.randrange(len(mine))
        if rng.random() < 0.3:
            mine[cut:cut] = ["\nSubscribe now please\n", "\nEnd\n"][: rng.randrange(3)]
        rows.append((i * 7 % 1009, " ".join(mine[:cut]) + "\n" + " ".join(mine[cut:]) + ("\n" + common if rng.random() < 0.4 else "")))
    return rows


@pytest.mark.parametrize("words, percent", [(3, 90), (5, 80)])
def test_document_join_equals_brute_force(spark, words, percent):
    rows = variants(words, 150)
    sets = {i: word_set(t, words) for i, t in rows}
    ids = sorted(sets)
    edges = [(a, b) for a in ids for b in ids if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    got = ngram_join.similar_documents(spark.createDataFrame(rows, "doc_id bigint, text string"), Likeness(words, percent)).toPandas()
    want = smallest_reachable(ids, edges)
    assert dict(zip(got.doc_id, got.component_id)) == want and len(got) == len(rows)
    assert dict(zip(got.doc_id, got.n_shingles)) == {i: len(s) for i, s in sets.items()}
    kept = ngram_join.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string"), Likeness(words, percent)).toPandas()
    assert sorted(kept.doc_id) == sorted(set(want.values()))


def test_line_dedup_equals_brute_force(spark):
    rows = variants(11, 120)
    lines = {(i, j): word_set(line, 5) for i, t in rows for j, line in enumerate(t.split("\n"))}
    order = sorted(k for k in lines if lines[k])
    want = {b for n, b in enumerate(order) if any(lines[a] == lines[b] or 100 * len(lines[a] & lines[b]) >= 80 * len(lines[a] | lines[b]) for a in order[:n])}
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {(r.doc_id, r.line) for r in line_dedup.repeated_lines(docs).collect()}
    assert got == want
    cut = {r.doc_id: r.text for r in line_dedup.without_repeated_lines(docs).collect()}
    for i, t in rows:
        left = "\n".join(line for j, line in enumerate(t.split("\n")) if (i, j) not in want)
        assert cut.get(i) == (left if WORD.search(left) else None)


def test_awkward_rows(spark, awkward):
    found = ngram_join.similar_documents(awkward).toPandas()
    by_id = found.dropna(subset="doc_id").set_index("doc_id").component_id
    assert len(found) == 13 and by_id[2].max() == 1 and by_id[3] == 1 and by_id[7] == 6 and by_id[4] == 4 and by_id[5] == 5 and by_id[8] == 8
    assert found[found.doc_id.isna()].component_id.isna().all()
    assert ngram_join.keep_one(awkward).columns == awkward.columns
    gone = {(r.doc_id, r.line) for r in line_dedup.repeated_lines(awkward).collect()}
    assert gone == {(2, 0), (3, 0), (7, 0), (10, 0), (10, 1)}
    cut = line_dedup.without_repeated_lines(awkward).toPandas()
    assert 2 not in set(cut.doc_id) and cut[cut.doc_id == 10].text.item() == "last line of its own kind here" and len(cut) == 9
    packed = packing.pack(awkward).toPandas()
    assert packed.groupby("sequence_id").length.sum().max() <= 2048 and (packed.doc_id == 5).sum() == 1
    plan = mixing.plan(awkward, block=4, shard=64).toPandas()
    assert len(plan) == 13 and (plan.taken <= 3 * plan["size"]).all()
    mixed = mixing.mixed(awkward, block=4, shard=64)
    words = sum(len(WORD.findall(r.text or "")) for r in mixed.collect())
    assert words == plan.taken.sum() and mixed.columns == awkward.columns
    sections = attribution.tokens_by_line(awkward).toPandas()
    assert (sections[sections.doc_id == 5].n_tokens == 0).all() and len(sections[sections.doc_id == 10]) == 3
    assert licences.scan(awkward).count() == 0
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(12)] + [(None, 1, None)], "doc_id bigint, quality int, toxic int")
    for scored in (quality.score_quality(awkward, labels), toxicity.score_toxicity(awkward, labels)):
        scored = scored.toPandas()
        assert len(scored) == 13 and scored.score.between(0, 1).all()


def test_empty_tables(spark, awkward):
    none = awkward.where("false")
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    frames = [ngram_join.similar_documents(none), line_dedup.repeated_lines(none), packing.pack(none), mixing.plan(none), mixing.mixed(none), attribution.tokens_by_line(none), licences.scan(none), quality.score_quality(none, labels), toxicity.score_toxicity(none, labels), quality.keep_good(none, labels)]
    assert [f.count() for f in frames] == [0] * len(frames)


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(200, 200), (300, 301), (301, 300)]
    got = components(spark.createDataFrame(edges, "a bigint, b bigint")).toPandas().groupby("root").node.apply(set)
    assert sorted(map(min, got)) == [0, 100, 300] and sorted(map(len, got)) == [2, 30, 41]


def test_mix_meets_targets_and_apportions_by_highest_quotients(spark):
    rng = random.Random(3)
    rows = [(i, " ".join("w" for _ in range(rng.randint(0, 300))), rng.choice(["a", "b", "c", "dd", None])) for i in range(300)]
    rows += [(1000 + i, "w " * 40, "tiny") for i in range(2)]
    plan = mixing.plan(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).toPandas()
    size = {r[0]: len(r[1].split()) for r in rows}
    assert dict(zip(plan.doc_id, plan["size"])) == size
    per = plan.groupby("source", dropna=False).agg(size=("size", "sum"), target=("target", "first"), taken=("taken", "sum"))
    weights = dict(zip(["a", "b", "c", "dd", "tiny", None], [1, 2, 3, 1, 2, 3]))
    want, open_ = {}, dict(weights)
    left = total = sum(size.values())
    own = {s: sum(size[r[0]] for r in rows if r[2] == s) for s in weights}
    while True:
        level = left / sum(open_.values())
        over = [s for s, w in open_.items() if w * level > 3 * own[s]]
        if not over:
            break
        for s in over:
            want[s] = 3 * own[s]
            left -= want[s]
            del open_[s]
    want |= {s: w * level for s, w in open_.items()}
    for s, r in per.iterrows():
        s = None if pd.isna(s) else s
        assert r.target == pytest.approx(want[s]) and abs(r.taken - want[s]) <= 3 * mixing.BLOCK
    assert (plan.taken <= 3 * plan["size"]).all() and per.target.sum() == pytest.approx(total)

    for votes, house in (([53, 24, 23], 7), ([1000, 9, 9, 9, 9, 9], 40), ([5, 5, 5], 2), ([7, 0, 3], 5)):
        seats = [0] * len(votes)
        for _ in range(house):
            best = max(range(len(votes)), key=lambda i: (votes[i] / (2 * seats[i] + 1), -i))
            seats[best] += 1
        frame = spark.createDataFrame([(0, i, v, sum(votes), house) for i, v in enumerate(votes)], "g int, i int, v bigint, t bigint, h bigint")
        got = {r.i: r.seats for r in mixing.sainte_lague(frame, ["g"], "i", "v", "t", "h").collect()}
        assert [got[i] for i in range(len(votes))] == seats


def test_packing_round_trip(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(9)
    words = ["Straße", "İstanbul", "don't", "x1y2", "éte", "ΣΑΣ", "a-b", "naïve,", "…ok", "日本語", "🙂🙂", "co op", "THE", "the!!"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 3000))) for _ in range(60)] + ["", None, "one\x0btwo\x1cthree"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    packed = packing.pack(docs, with_ids=True).toPandas().sort_values(["doc_id", "start"])
    for i, text in enumerate(texts):
        want = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        mine = packed[packed.doc_id == i]
        assert [x for ids in mine.ids for x in ids] == want and (mine.doc_tokens == len(want)).all()
        assert [zlib.crc32(np.array(ids, dtype="<u4").tobytes()) for ids in mine.ids] == list(mine.ids_crc32)
    for _, s in packed.sort_values("offset").groupby("sequence_id"):
        assert list(s.offset) == list(s.length.cumsum() - s.length) and s.length.sum() <= 2048


def test_patterns_meet_demand_within_the_size_bound():
    rng = np.random.default_rng(1)
    for n in (0, 1, 40, 5000):
        demand = np.bincount(rng.integers(1, 65, n), minlength=65)[1:]
        made = packing.patterns(demand, 64)
        assert (sum((p * t for p, t in made), np.zeros(64, int)) == demand).all()
        assert all(p @ np.arange(1, 65) <= 64 for p, _ in made)
        least = np.ceil(demand @ np.arange(1, 65) / 64)
        assert sum(t for _, t in made) <= 1.02 * least + 8


def test_tokens_of_sections_sum_up(spark):
    texts = ["first line\nsecond  line\n\n\n   indented", "no break", "", "a\n\n", "été\nnaïve 🙂\n"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    tokens = attribution.ByteTokens()
    for rule in attribution.RULES:
        got = attribution.tokens_by_line(docs, rule).toPandas()
        for i, text in enumerate(texts):
            mine = got[got.doc_id == i].sort_values("section")
            assert len(mine) == text.count("\n") + 1 and mine.n_tokens.sum() == len(tokens.encoding.encode_ordinary(text))
    assert list(attribution.allot(np.array([3, 7, 8]), np.array([0, 4]), "first")[0]) == [2, 1]
    assert list(attribution.allot(np.array([3, 7, 8]), np.array([0, 4]), "last")[0]) == [1, 2]
    assert list(attribution.allot(np.array([3, 7, 8]), np.array([0, 4]), "most")[0]) == [1, 2]
    fields = attribution.tokens_by_field(spark.createDataFrame([(1, "title", None, "the body")], "k bigint, a string, b string, c string"), "k", ["a", "b", "c"]).toPandas()
    assert fields.n_tokens.sum() == len(tokens.encoding.encode_ordinary("title\n\nthe body")) and list(fields.field) == ["a", "b", "c"]


def test_licence_rules(spark):
    apache = "Licensed under the Apache License, Version 2.0.\n# You may not use this file except in compliance\n# with the License.\nYou may obtain a copy of the License at\n\n  http://www.apache.org/licenses/LICENSE-2.0\n\nsomething"
    full = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.\n\nThis program is distributed in the hope that it will be useful,\nbut WITHOUT ANY WARRANTY; without even the implied warranty of\nMERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the\nGNU General Public License for more details.\n"
    texts = ["Junk | junk\nReleased under the MIT License.", apache, "talk about the MIT License here.", "Licensed under CC BY-NC 4.0. This work is licensed under the GNU General Public License, version 3.", full]
    got = licences.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).toPandas()
    assert set(zip(got.doc_id, got.licence, got.kind)) == {(0, "MIT", "notice"), (1, "Apache-2.0", "notice"), (3, "CC-BY-NC-4.0", "notice"), (3, "GPL-3.0", "notice"), (4, "GPL-3.0", "header")}
    assert all(any(a in licences.SENTENCES[s] for s in rule for a in licences.ANCHORS) for _, _, rule in licences.RULES)
    assert set(licences.SENTENCES) == {s for _, _, rule in licences.RULES for s in rule}


MIT = """MIT License

Copyright (c) 2024 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
APACHE = """Copyright 2024 Someone

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""
BSD = """Copyright (c) 2024, Someone

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""
GNU = """This {thing} is free software: you can redistribute it and/or modify
it under the terms of the GNU {kind}General Public License as published by
the Free Software Foundation, either version {version} of the License, or
(at your option) any later version.

This {thing} is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU {kind}General Public License for more details.
"""
GNU_TITLE = """                    GNU {kind}GENERAL PUBLIC LICENSE
                       Version {date}

 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>
 Everyone is permitted to copy and distribute verbatim copies
 of this license document, but changing it is not allowed.

                            Preamble
"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.
"""
UNLICENSE = "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or\ndistribute this software.\n"
BOOST = "// Distributed under the Boost Software License, Version 1.0.\n// (See accompanying file LICENSE_1_0.txt or copy at\n// http://www.boost.org/LICENSE_1_0.txt)\n"
EPL = "This program and the accompanying materials are made available under the\nterms of the Eclipse Public License 2.0 which is available at\nhttps://www.eclipse.org/legal/epl-2.0/\n"
ZLIB = "This software is provided 'as-is', without any express or implied\nwarranty. In no event will the authors be held liable for any damages\narising from the use of this software.\n"


def test_licence_texts_in_every_form(spark):
    gnu = [("program", "", "3", "GPL-3.0"), ("program", "", "2", "GPL-2.0"), ("program", "Lesser ", "3", "LGPL-3.0"), ("library", "Lesser ", "2.1", "LGPL-2.1"), ("program", "Affero ", "3", "AGPL-3.0")]
    titles = [("", "3, 29 June 2007", "GPL-3.0"), ("", "2, June 1991", "GPL-2.0"), ("LESSER ", "3, 29 June 2007", "LGPL-3.0"), ("LESSER ", "2.1, February 1999", "LGPL-2.1"), ("AFFERO ", "3, 19 November 2007", "AGPL-3.0")]
    two = BSD[: BSD.index("3. Neither")] + BSD[BSD.index("THIS SOFTWARE") :]
    cases = [(MIT, "MIT", "text"), (APACHE, "Apache-2.0", "header"), (BSD, "BSD-3-Clause", "text"), (two, "BSD-2-Clause", "text"), (MPL, "MPL-2.0", "notice"), (ISC, "ISC", "text"), (UNLICENSE, "Unlicense", "text"), (BOOST, "BSL-1.0", "notice"), (EPL, "EPL-2.0", "notice"), (ZLIB, "Zlib", "text")]
    cases += [(GNU.format(thing=t, kind=k, version=v), name, "header") for t, k, v, name in gnu]
    cases += [(GNU_TITLE.format(kind=k, date=d), name, "text") for k, d, name in titles]
    cases.append(("                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n", "Apache-2.0", "text"))
    rows, want = [], set()
    for text, licence, kind in cases:
        hashed = "".join(f"# {line}".rstrip() + "\n" for line in text.splitlines())
        starred = "/*\n" + "".join(f" * {line}".rstrip() + "\n" for line in text.splitlines()) + " */\nint x;\n"
        rewrapped = "\n\n".join(" ".join(p.split()) for p in text.split("\n\n"))
        forms = [text, "import os\n" + hashed, starred, "prose before. " + text, text.replace("\n", "\r\n")]
        # a title that is one line with its date is no title
        for form in forms if "PUBLIC LICENSE\n" in text or "January" in text else [*forms, rewrapped]:
            want.add((len(rows), licence, kind))
            rows.append((len(rows), form))
    near = [MIT.replace("free of charge", "for a charge"), APACHE.replace("may not use", "may use"), BSD.replace("must retain", "need not retain"), MPL.replace("subject to", "not subject to"), GNU.format(thing="program", kind="", version="9"), ISC.replace("without fee", "without a fee"), "the MIT License and the BSD license are licenses of software"]
    rows += [(1_000 + i, t) for i, t in enumerate(near)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {(r.doc_id, r.licence, r.kind) for r in licences.scan(docs).collect()}
    assert {f for f in found if f[0] < 1_000} == want, (sorted(want - found), sorted(f for f in found - want if f[0] < 1_000))
    assert not {f for f in found if f[0] >= 1_000}
    plan = licences.scan(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_classifiers_learn(spark):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(400):
        words = ["".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 7))) for _ in range(60)]
        junk, toxic = rng.random() < 0.3, rng.random() < 0.3
        if toxic:
            words[rng.randrange(60)] = rng.choice(["vilewretch", "vilewretches", "vileness"])
        rows.append((i, " | ".join(words) if junk else " ".join(words)))
        labels.append((i, int(not junk), int(toxic)))
    docs, marks = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    truth = pd.DataFrame(labels, columns=["doc_id", "quality", "toxic"])
    for scored, label in ((quality.score_quality(docs, marks), "quality"), (toxicity.score_toxicity(docs, marks), "toxic")):
        both = scored.toPandas().merge(truth)
        test = both[both.held_out]
        assert (both.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in both.doc_id]).all() and len(test) > 40
        assert (test.predicted == test[label]).mean() > 0.95
    good = {r.doc_id for r in quality.keep_good(docs, marks).collect()}
    assert len(good & {i for i, q, _ in labels if q}) >= 0.97 * sum(q for _, q, _ in labels)
