"""Operators against brute force, exact round trips and held-out accuracy."""

import collections
import itertools
import math
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidewake.llm import components, exact_dedup, hmm, licenses, media, packing, pieces, simhash, toxicity, url_filter
from tidewake.llm.common import fold, looked_up, table


# -- simhash --------------------------------------------------------------


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("n_chars < 4000")
    want = {r["doc_id"]: brute_fingerprint(r["text"]) for r in docs.collect()}
    assert {r["doc_id"]: r["fp"] % 2**64 for r in simhash.fingerprints(docs).collect()} == want


def brute_roots(fps):
    to = list(range(len(fps)))

    def find(i):
        while to[i] != i:
            i = to[i]
        return i

    for i, j in itertools.combinations(range(len(fps)), 2):
        if int(fps[i] ^ fps[j]).bit_count() <= 4:
            to[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(fps))]


def clustered(n, seed):
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 2**63, 12, dtype=np.uint64)
    fps = centres[rng.integers(0, 12, n)]
    for _ in range(3):
        fps ^= np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)
    return np.unique(fps)


@pytest.mark.parametrize("n", [1, 2, 9, 400])
def test_hierarchical_index(n):
    fps = clustered(n, n)
    fps = fps[np.argsort(simhash.gray_rank(fps))]
    root = simhash.spanning_links(fps, np.zeros(len(fps), int), chunk=64)
    assert len(set(zip(root, brute_roots(fps), strict=True))) == len(set(root)) == len(set(brute_roots(fps)))


def test_distributed_links_with_split_patterns(spark):
    fps = clustered(500, 7)
    nodes = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    found = components.components(simhash.links(nodes, len(fps), block=8)).collect()  # every crowded pattern is split
    root = {r["node"]: r["root"] for r in found}
    got = [root.get(int(x), int(x)) for x in fps.view(np.int64)]
    want = brute_roots(fps)
    assert len(set(zip(got, want, strict=True))) == len(set(got)) == len(set(want))


def test_masks_cover_every_distance_of_four():
    for count in (10, 10**5, 10**9):
        for bits in itertools.combinations(range(0, 64, 5), 4):
            assert any(not any(a <= b < e for a, e in choice for b in bits) for choice in simhash.masks(count))


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "src long, dst long")
    root = {r["node"]: r["root"] for r in components.components(links).collect()}
    assert root == {**{i: 0 for i in range(1, 41)}, 101: 100}


def test_components_of_a_star_and_a_hub_without_head(spark):
    """A hub's links are looked up by a broadcast, or with a head of one key by the join; neither changes the result."""
    star = spark.range(1, 100_001).select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst"))
    roots = components.components(star)
    assert roots.count() == 100_000 and roots.where("root != 0 or node = 0").count() == 0
    small = star.where("dst <= 300").unionByName(spark.createDataFrame([(7, 1000), (1000, 1001), (2000, 2001)], "src long, dst long"))
    for head in (1, 4096):
        got = {r["node"]: r["root"] for r in components.components(small, head).collect()}
        assert got == {**{i: 0 for i in [*range(1, 301), 1000, 1001]}, 2001: 2000}


def test_component_ids(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("n_chars < 4000")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    roots = brute_roots([np.uint64(brute_fingerprint(t)) for _, t in rows])
    want = {k: rows[r][0] for (k, _), r in zip(rows, roots, strict=True)}
    assert {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs).collect()} == want


# -- look-ups -------------------------------------------------------------


@pytest.mark.parametrize("head", [1, 2, 100])
def test_looked_up_is_the_whole_inner_join(spark, head):
    rows = spark.createDataFrame([(i, k) for i, k in enumerate("aaaaabbbcxz")], "i int, k string")
    facts = spark.createDataFrame([("a", 1, 5), ("b", 2, 3), ("c", 3, 1), ("y", 4, 0)], "k string, v int, n int")
    got = sorted((r["i"], r["k"], r["v"]) for r in looked_up(rows, facts, ["k"], "n", head).collect())
    assert got == [(i, k, "abc".index(k) + 1) for i, k in enumerate("aaaaabbbc")]


# -- exact dedup ----------------------------------------------------------


def test_cuckoo_index_inserts_deletes_and_resizes():
    index, keys = exact_dedup.CuckooIndex(2), [exact_dedup.content_key(str(i).encode()) for i in range(3000)]
    for i, (digest, length) in enumerate(keys):
        assert index.get(digest, length) is None
        index.put([digest, length, i])
    assert len(index) == 3000 and index.mask >= 511
    assert all(index.get(*k)[2] == i for i, k in enumerate(keys))
    for k in keys[::2]:
        assert index.delete(*k) and index.delete(*k) is None
    assert [index.get(*k) is None for k in keys] == [i % 2 == 0 for i in range(3000)]
    digest, length = keys[1]
    assert index.get(digest, length + 1) is None and index.get(digest[:-1] + b"?", length) is None  # the tag alone is no proof


def test_groups_when_tasks_hand_on_early(spark):
    rows = [(i, f"text {i % 17}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.deduplicate(docs, live=3).collect()}
    for i, t in rows:
        same = [j for j, u in rows if u == t]
        assert got[i] == (max(same), len(same), i == max(same))


# -- licences -------------------------------------------------------------


@pytest.mark.parametrize("text, labels", [
    ("Released under the MIT License.", "mit,mit-named"), ("gnu general public license, version 3", "gpl,gpl-3.0"), ("GNU General Public-License v2", "gpl,gpl-2.0"),
    ("Licensed under the Apache License, Version 2.0", "apache,apache-2.0"), ("apache license 1.0", "apache"), ("CC BY-NC 4.0", "cc-by,cc-by-nc,cc-by-nc-4.0"), ("gnu lesser general public license", "lgpl"),
    ("gnu general public licenses", ""), ("SPDX-License-Identifier: MIT", "spdx,spdx-mit"), ("", ""),
])
def test_templates(text, labels):
    automata = tuple(licenses.compile_template(*t) for t in licenses.TEMPLATES)
    assert licenses.scan(text.encode(), licenses.BASE, automata)[5] == labels


_BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_3 = _BSD_2 + "{n}Neither the name of {name} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
_ADVERTISING = "3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the organization.\n"
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.
IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_GRANT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction'
_MIT = _GRANT + """, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_FEE = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_USE = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC = _USE + ", provided that the above copyright notice and this permission notice appear in all copies.\n" + _FEE
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
    http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_UNLICENSE = """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_AS_PUBLISHED = "General Public License as published by the Free Software Foundation, either version {v} of the License, or (at your option) any later version."


def labels_of(text):
    return licenses.scan(text.encode(), licenses.BASE, tuple(licenses.compile_template(*t) for t in licenses.TEMPLATES))[5]


@pytest.mark.parametrize("label, text", [
    ("bsd-2-clause", _BSD_2 + _BSD_END), ("bsd-3-clause", _BSD_3.format(n="3. ", name="the copyright holder") + _BSD_END), ("bsd-3-clause", _BSD_3.format(n="* ", name="the copyright holder") + _BSD_END),
    ("bsd-3-clause", _BSD_3.format(n="3. ", name="the Regents of the University of California, Lawrence Berkeley National Laboratory, U.S. Dept. of Energy,") + _BSD_END),
    ("bsd-3-clause", _BSD_2 + "3. The name of the author may not be used to endorse or promote products derived from this software without specific prior written permission.\n" + _BSD_END),
    ("mit", "Copyright (c) 2020 Some One\n\n" + _MIT), ("mit", _MIT.replace("THE AUTHORS OR COPYRIGHT HOLDERS", "THE X CONSORTIUM")), ("isc", _ISC), ("0bsd", _USE + ".\n" + _FEE), ("zlib", _ZLIB), ("unlicense", _UNLICENSE), ("apache-2.0-notice", _APACHE),
    ("apache-2.0", "Apache License\nVersion 2.0, January 2004\nhttp://www.apache.org/licenses/"), ("gpl-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU " + _AS_PUBLISHED.format(v=3)),
    ("mpl-2.0", "Mozilla Public License Version 2.0\n1. Definitions"), ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("agpl-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE\nVersion 3, 19 November 2007"), ("agpl-3.0", "GNU Affero " + _AS_PUBLISHED.format(v=3)),
    ("gpl-2.0", "GNU GENERAL PUBLIC LICENSE\nVersion 2, June 1991"), ("gpl-2.0", "GNU " + _AS_PUBLISHED.format(v=2)), ("gpl-3.0", "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007"), ("gpl-3.0", "GNU " + _AS_PUBLISHED.format(v=3)),
    ("lgpl", "GNU LESSER GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007"), ("cc0-1.0", "CC0 1.0 Universal"), ("cc-by-4.0", "Creative Commons Attribution 4.0 International Public License"), ("reserved", "Copyright 2019 Some One. All rights reserved."),
])
def test_published_wording(label, text):
    assert label in labels_of(text).split(",")


@pytest.mark.parametrize("text", [
    _GRANT + ", but never for commercial use.", _MIT.replace("subject to the following conditions", "unless they are a bank, subject to the following conditions"), _MIT.replace("without limitation", "with limitation"),
    _MIT[: _MIT.index("THE SOFTWARE IS PROVIDED")], _USE + " unless you are a bank.", _ISC.replace("or without fee", "fee"), _ISC[: _ISC.index("IN NO EVENT")], _ZLIB.replace("commercial applications", "no commercial applications"),
    _ZLIB[: _ZLIB.index("3. This")], _UNLICENSE[: _UNLICENSE.index("THE SOFTWARE")], _BSD_2, _BSD_2 + _BSD_END.replace("EVEN IF", "EXCEPT IF"), _BSD_3.format(n="", name="x"), "All rights reserved for the prize", "SPDX licence", "This is free and unencumbered software released into the public domain.",
    _BSD_3.format(n=_ADVERTISING + "4. ", name="the organization") + _BSD_END,  # the four-clause licence
])
def test_altered_wording_is_not_accepted(text):
    assert labels_of(text) == ""


def test_automata_and_regular_expressions_agree():
    import random
    import re

    rng = random.Random(5)
    for label, template in licenses.TEMPLATES:
        automaton = licenses.compile_template(label, template)
        pattern = re.compile(licenses.as_regex(template))
        vocabulary = re.findall(r"[a-z0-9]+", template) + ["x"]
        for _ in range(300):
            words = re.sub(r"\{\{(\d+)-(\d+)\}\}", lambda m: "x " * rng.randint(int(m[1]), int(m[2])), re.sub(r"\(([^)]*)\)", lambda m: rng.choice(m[1].split("|")), re.sub(r"\[\[(.*?)\]\]", lambda m: m[1] if rng.random() < 0.5 else "", template))).split()
            if rng.random() < 0.5:
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            tokens = [w.encode() for w in words]
            assert any(automaton.accepts(tokens, i) for i in range(len(tokens))) == bool(pattern.search(" " + "  ".join(words) + " "))


# -- language model -------------------------------------------------------


def small_model(states=3, size=7, seed=0):
    rng = np.random.default_rng(seed)
    norm = lambda x, axis: x / x.sum(axis=axis, keepdims=True)
    return hmm.HMM(norm(rng.random(states), 0), norm(rng.random((states, states)), 1), norm(rng.random((size, states)), 0))


def all_paths(model, symbols):
    for path in itertools.product(range(len(model.start)), repeat=len(symbols)):
        p = model.start[path[0]] * model.emit[symbols[0], path[0]]
        for a, b, s in zip(path[:-1], path[1:], symbols[1:], strict=True):
            p *= model.step[a, b] * model.emit[s, b]
        yield path, p


def test_forward_recursion_sums_over_all_paths():
    model, parts = small_model(), [np.array(x, np.uint16) for x in ([1, 2, 3, 0, 6], [4], [5, 5, 1])]
    want = [math.log(sum(p for _, p in all_paths(model, x))) for x in parts]
    assert np.allclose(hmm.log_likelihoods(model, parts), want)


def test_expected_counts_weigh_all_paths():
    model, parts = small_model(), [np.array(x, np.uint16) for x in ([1, 2, 3, 0, 6, 1], [4], [5, 5], [2, 0, 1])]
    start, steps, emit = np.zeros(3), np.zeros((3, 3)), np.zeros((7, 3))
    for x in parts:
        total = sum(p for _, p in all_paths(model, x))
        for path, p in all_paths(model, x):
            start[path[0]] += p / total
            for a, b in zip(path[:-1], path[1:], strict=True):
                steps[a, b] += p / total
            for s, a in zip(x, path, strict=True):
                emit[s, a] += p / total
    for held in (1, 3, 5, 1000):  # blocks of one step, of several, and no cut at all
        got = hmm.expected_counts(model, parts, held)
        assert all(np.allclose(a, b) for a, b in zip(got, (start, steps, emit), strict=False))
        assert got[3] == pytest.approx(hmm.log_likelihoods(model, parts).sum())


def test_language_model_scores(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = {r["doc_id"]: r for r in hmm.score(docs, ~fold(2, 7, docs["doc_id"]), head=2500).collect()}  # rare words take the join
    counts, texts = collections.Counter(), {r["doc_id"]: r["text"].encode().lower().split() + [None] for r in docs.collect()}
    for k, words in texts.items():
        if zlib.crc32(str(k).encode()) % 7 != 2:
            counts.update(words)
    n, v = sum(counts.values()), len(counts)
    held = [k for k in texts if zlib.crc32(str(k).encode()) % 7 == 2]
    for k, words in texts.items():
        r = rows[k]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(words), sum(counts[w] > 0 for w in words), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words))
    assert sum(rows[k]["score"] for k in held) > sum(rows[k]["base_score"] for k in held)  # better on texts it has not seen


def test_trained_scores_against_all_paths(spark):
    """Three rounds of training and the scores of whole texts, by enumerating every state path."""
    texts = ["a b a", "b c", "a", "c c b", "a b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(2)
    got = {r["doc_id"]: r["score"] for r in hmm.score(docs, F.col("doc_id") != 4).collect()}
    place = {w: k for k, (w, _) in enumerate(sorted(collections.Counter(" ".join(texts[:4]).split()).items(), key=lambda x: (-x[1], x[0])))}
    size, end = hmm.SYMBOLS + hmm.CLASSES + 1, hmm.SYMBOLS + hmm.CLASSES
    parts = [[*(place[w] for w in t.split()), end] for t in texts]
    freq = np.bincount(sum(parts[:4], []), minlength=size).astype(float)
    model = hmm.HMM.first(freq)
    for _ in range(hmm.ROUNDS):
        start, steps, emit = np.zeros(hmm.STATES), np.zeros((hmm.STATES, hmm.STATES)), np.zeros((size, hmm.STATES))
        for x in parts[:4]:
            paths = list(all_paths(model, x))
            total = sum(p for _, p in paths)
            for path, p in paths:
                start[path[0]] += p / total
                for a, b in zip(path[:-1], path[1:], strict=True):
                    steps[a, b] += p / total
                for s, a in zip(x, path, strict=True):
                    emit[s, a] += p / total
        model = hmm.HMM.of_counts(start, steps, emit)
    for k, x in enumerate(parts):
        assert got[k] == pytest.approx(math.log10(sum(p for _, p in all_paths(model, x))))


# -- toxicity -------------------------------------------------------------


def test_toxicity_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    rows = toxicity.toxicity(table(spark, sf, "documents"), table(spark, sf, "labels")).where("held_out").join(table(spark, sf, "labels"), "doc_id").collect()
    hit = sum(r["predicted"] and r["toxic"] for r in rows)
    assert hit / sum(r["predicted"] for r in rows) > 0.9 and hit / sum(r["toxic"] for r in rows) > 0.85


@pytest.mark.parametrize("text, share", [("YOU IDIOT", 8 / 9), ("Anouble thwh.", 1 / 13), ("aaaaaaB" * 5, 1 / 7), ("Baaaaaa" * 5, 1 / 7), ("ÉA é", 0.5), ("A", 1.0), ("", 0.0)])
def test_shouting_is_a_share_of_the_whole_text(text, share):
    assert toxicity.shape(text, 1)[0] == pytest.approx(share)


def test_label_model_finds_good_voters():
    rng = np.random.default_rng(3)
    y = rng.random(4000) < 0.2
    votes = np.stack([np.where(rng.random(4000) < a, y, ~y).astype(int) for a in (0.95, 0.9, 0.55)] + [np.full(4000, -1)], 1)
    model = toxicity.LabelModel().fit(votes, rounds=8)
    assert ((model.posterior(votes) > 0.5) == y).mean() > 0.93
    assert [g.tolist() for g in model.groups] == [[0], [1], [2], [3]]
    odds = [t[1, 2] / t[0, 2] for t in model.tables]  # of voting toxic
    assert odds[0] > odds[2] and odds[1] > odds[2]


def test_label_model_counts_copied_voters_once():
    rng = np.random.default_rng(4)
    y = rng.random(3000) < 0.25
    votes = np.stack([np.where(rng.random(3000) < a, y, ~y).astype(int) for a in (0.9, 0.85, 0.85, 0.9)], 1)
    copied = np.column_stack([votes, *[votes[:, 1]] * 5])
    plain, more = toxicity.LabelModel().fit(votes), toxicity.LabelModel().fit(copied)
    assert sorted(map(len, more.groups)) == [1, 1, 1, 6]
    assert np.abs(plain.posterior(votes) - more.posterior(copied)).mean() < 0.02


def test_label_model_posterior_against_bayes():
    """The posterior of every vote pattern from the model's own tables, worked out state by state."""
    votes = np.array(list(itertools.product((-1, 0, 1), repeat=3)))
    model = toxicity.LabelModel(0.3, [np.array([0, 2]), np.array([1])], [np.random.default_rng(k).dirichlet(np.ones(18), 2) for k in range(2)])
    for row, got in zip(votes, model.posterior(votes), strict=True):
        both = [0.7, 0.3]
        for group, table in zip(model.groups, model.tables, strict=True):
            state = 2 * sum(row[k] == 1 for k in group) + any(row[k] == 0 for k in group)
            both = [p * table[label, state] for label, p in enumerate(both)]
        assert got == pytest.approx(both[1] / sum(both))


def test_group_states_tell_small_counts_apart():
    assert [int(toxicity.group_states(np.array([[1] * n + [-1] * (200 - n)]))[0]) // 2 for n in (0, 1, 2, 3, 5, 6, 11, 12, 23, 24, 200)] == [0, 1, 2, 3, 3, 4, 4, 5, 5, 6, 8]


def test_toxicity_scores_are_calibrated(spark):
    sf = "/root/testdata/sf0.1"
    rows = toxicity.toxicity(table(spark, sf, "documents"), table(spark, sf, "labels")).where("held_out").join(table(spark, sf, "labels"), "doc_id").collect()
    assert np.mean([(r["score"] - r["toxic"]) ** 2 for r in rows]) < 0.03 < 0.09  # always the base rate: about 0.09


# -- packing --------------------------------------------------------------


def test_bounds_are_optimal():
    rng = np.random.default_rng(0)

    def padding(lengths, counts, bounds):
        upper = np.array(bounds)[np.searchsorted(bounds, lengths)]
        return int(((upper - lengths) * counts).sum())

    for _ in range(150):
        n = int(rng.integers(1, 9))
        lengths, counts, k = np.sort(rng.choice(60, n, replace=False)) + 1, rng.integers(1, 9, n), int(rng.integers(1, 5))
        got = packing.best_bounds(lengths, counts, k)
        want = min(padding(lengths, counts, sorted({*c, lengths[-1]})) for r in range(min(k, n)) for c in itertools.combinations(lengths[:-1], r))
        assert len(got) <= k and padding(lengths, counts, got) == want


def test_batches_keep_the_budget(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = packing.pack(docs, tokens=4000, shard=7).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(r[0] for r in docs.select("doc_id").collect())
    batches = collections.defaultdict(list)
    for r in rows:
        batches[r["batch_id"]].append(r)
        assert r["n_tokens"] <= r["bucket_tokens"]
    partial = collections.Counter()
    for members in batches.values():
        first = members[0]
        assert len({m["bucket"] for m in members}) == 1 and sorted(m["slot"] for m in members) == list(range(len(members)))
        assert len(members) * first["bucket_tokens"] <= max(4000, first["bucket_tokens"])
        partial[first["bucket"]] += len(members) < first["batch_rows"]
    assert set(batches) == set(range(len(batches))) and max(partial.values()) <= 1


def test_a_bucket_is_as_long_as_its_longest_row(spark):
    lengths = [3, 5, 2048, 2049, 4097, 4098, 9001, 20001, 20001, 33333]
    docs = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "doc_id int, n int")
    for buckets in (1, 4, 16):
        rows = packing.pack(docs, length=F.col("n"), text_col="doc_id", buckets=buckets).collect()
        longest = collections.defaultdict(int)
        for r in rows:
            longest[r["bucket"]] = max(longest[r["bucket"]], r["n_tokens"])
        assert sorted(r["n_tokens"] for r in rows) == sorted(lengths)
        for r in rows:
            assert r["bucket_tokens"] == longest[r["bucket"]] and r["batch_rows"] == max(1, packing.TOKENS // longest[r["bucket"]])


# -- segmentation ---------------------------------------------------------


@pytest.fixture(scope="module")
def vocab():
    return pieces.Vocabulary.of(pieces.load_model())


def segmentations(text, vocab):
    byte_id = {t: i for i, t in enumerate(vocab.texts) if len(t) == 1 and i < 259}
    by_text = {vocab.texts[i]: i for i in vocab.ids.tolist()}
    raw = (" " + text).encode()
    chars = (" " + text) if text else ""

    def from_(i):
        if i == len(chars):
            yield (), 0.0
            return
        for k in range(1, min(vocab.longest, len(chars) - i) + 1):
            found = by_text.get(chars[i : i + k].encode())
            if found is not None:
                for rest, log in from_(i + k):
                    yield (found, *rest), log + vocab.logs[found]
        if chars[i].encode() not in by_text:
            ids = tuple(byte_id[bytes([b])] for b in chars[i].encode())
            for rest, log in from_(i + 1):
                yield (*ids, *rest), log + vocab.byte_log * len(ids)

    assert raw
    return dict(from_(0))


@pytest.mark.parametrize("text", ["the cat", "a  b", "É日\n", "x", ""])
def test_samples_without_replacement(text, vocab):
    every = segmentations(text, vocab)
    total = math.log(sum(map(math.exp, every.values())))
    n = 1500
    found = pieces.sample_texts([text] * n, [pieces.row_key(i) for i in range(n)], vocab, 3)
    first = collections.Counter()
    for rows in found:
        ids = [tuple(r[0].tolist()) for r in rows]
        assert len(set(ids)) == len(ids) == min(3, len(every))
        assert all(r[1] == pytest.approx(every[i] - total, abs=1e-6) for r, i in zip(rows, ids, strict=True))
        assert [r[2] for r in rows] == sorted((r[2] for r in rows), reverse=True)
        assert all(pieces.joined(r[0], vocab) == text.encode() for r in rows)
        first[ids[0]] += 1
    for ids, log in every.items():
        p = math.exp(log - total)
        assert abs(first[ids] / n - p) < 4 * math.sqrt(p / n) + 2 / n
    if len(every) > 3:  # inclusion scores make sums over samples unbiased
        weighed = np.mean([sum(math.exp(r[1]) / r[3] for r in rows) for rows in found])
        assert weighed == pytest.approx(1, abs=0.05)


def test_samples_do_not_depend_on_neighbours(vocab):
    alone = pieces.sample_texts(["one two three"], [5], vocab, 2)[0]
    among = pieces.sample_texts(["zero", "one two three", "four five"], [1, 5, 9], vocab, 2)[1]
    assert [(a[0].tolist(), a[2]) for a in alone] == [(b[0].tolist(), b[2]) for b in among]


def test_encode_decode_round_trip(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    back = {r["doc_id"]: r["text"] for r in pieces.decode(pieces.encode(docs)).collect()}
    assert back == {r["doc_id"]: r["text"] for r in docs.collect()}


# -- media ----------------------------------------------------------------


def test_codecs():
    rng = np.random.default_rng(1)
    for h, w, c in ((1, 1, 1), (3, 5, 1), (4, 7, 3)):
        image = rng.integers(0, 256, (h, w, c), dtype=np.uint8)
        assert (media.decode(media.encode_pnm(image)) == image).all()
        assert (media.decode(media.encode_bmp(image)) == np.repeat(image, 3, 2)[:, :, :3] if c == 1 else media.decode(media.encode_bmp(image)) == image).all()
    assert media.decode(b"P2 # grey\n2 1\n15\n0 15")[..., 0].tolist() == [[0, 255]]
    assert media.decode(b"P1\n2 2\n10\n01")[..., 0].tolist() == [[0, 255], [255, 0]]


def test_area_resize_against_brute_force():
    image = np.random.default_rng(2).integers(0, 256, (7, 5, 1), dtype=np.uint8)
    fine = np.repeat(np.repeat(image, 3, 0), 2, 1)[..., 0].astype(float)  # 21 x 10 into 3 x 2: whole cells
    want = np.floor(fine.reshape(3, 7, 2, 5).mean((1, 3)) + 0.5)
    assert (media.resize(image, 3, 2)[..., 0] == want).all()


def naive_means(image, height, width):
    """Area means cell by cell and pixel by pixel."""
    h, w, c = image.shape
    out = np.zeros((height, width, c))
    for i, j in itertools.product(range(height), range(width)):
        top, bottom, left, right = i * h / height, (i + 1) * h / height, j * w / width, (j + 1) * w / width
        for y, x in itertools.product(range(int(top), min(h, math.ceil(bottom))), range(int(left), min(w, math.ceil(right)))):
            share = max(0, min(bottom, y + 1) - max(top, y)) * max(0, min(right, x + 1) - max(left, x))
            out[i, j] += share * image[y, x] * (height * width / (h * w))
    return out


@pytest.mark.parametrize("h, w, c", [(1, 24, 1), (7, 5, 3), (40, 24, 3), (33, 24, 1)])
def test_resizing_with_cut_pixels_against_brute_force(h, w, c, monkeypatch):
    monkeypatch.setattr(media, "BAND", 4)
    image = np.random.default_rng(h).integers(0, 256, (h, w, c), dtype=np.uint8)
    assert np.allclose(media.area_means(image, 16, 16), naive_means(image, 16, 16))


def test_media_files_and_features_against_other_readers(spark):
    """The stored bytes by their formats' definitions and the features by naive means, for every format."""
    import hashlib
    import io
    import struct

    texts = {i: f"text {i} " * (5 + 40 * i) for i in range(12)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id int, text string")
    files = {r["doc_id"]: bytes(r["media"]) for r in media.media_columns(docs).collect()}
    kinds = set()
    for r in media.media_features(docs).collect():
        data = files[r["doc_id"]]
        raw = texts[r["doc_id"]].encode()
        raw += b"\xff" * (-len(raw) % 576)
        kinds.add(data[:2])
        if data[:2] == b"BM":
            w, h = struct.unpack_from("<ii", data, 18)
            body = np.frombuffer(data, np.uint8, offset=struct.unpack_from("<I", data, 10)[0]).reshape(h, w, 3)[::-1, :, ::-1]  # 72 bytes a row: no padding
        else:
            head, size, most, body = data.split(b"\n", 3)
            w, h = map(int, size.split())
            assert most == b"255"
            body = np.frombuffer(body, np.uint8).reshape(h, w, 1 if head == b"P5" else 3)
        assert body.tobytes() == raw and r["media_bytes"] == len(data) and r["media_sha256"] == hashlib.sha256(data).hexdigest()
        tile = io.BytesIO()
        np.save(tile, np.floor(naive_means(body, 16, 16) + 0.5 + 1e-9).astype(np.uint8))
        grey = np.floor(naive_means(body, 8, 9).mean(2) + 0.5 + 1e-9)
        bits = "".join("1" if b > a else "0" for row in grey for a, b in zip(row[:-1], row[1:], strict=True))
        assert r["feature"] == f"{int(bits, 2):016x}:{hashlib.sha256(tile.getvalue()).hexdigest()[:16]}"
    assert kinds == {b"BM", b"P5", b"P6"}


# -- URLs -----------------------------------------------------------------


@pytest.mark.parametrize("url, host, path, rule", [
    ("http://A.example.COM/en/7x?q#f", "a.example.com", "/en/7x", "example.com/en/7"), ("https://x.com/en/1", "x.com", "/en/1", "com/en/"), ("http://notexample.com/en/7", "notexample.com", "/en/7", "com/en/"),
    ("http://example.net/de/8", "example.net", "/de/8", "example.net/de/8"), ("http://a.net/de/", "a.net", "/de/", "net/de/"), ("http://net?x", "net", "", None), ("no scheme", "", "", None), (None, "", "", None),
])
def test_rules(spark, url, host, path, rule):
    (r,) = url_filter.judge(spark.createDataFrame([(1, url)], "page_id int, url string")).collect()
    assert (r["host"], r["path"], r["rule"]) == (host, path, rule)


def test_pipeline_against_brute_force(spark, tmp_path):
    import corpus_pipeline

    docs = table(spark, "/root/testdata/sf0.001", "documents")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    table(spark, "/root/testdata/sf0.001", "labels").write.parquet(str(tmp_path / "labels.parquet"))
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    model = toxicity.train(docs, table(spark, str(tmp_path), "labels").where(~fold(1, 3, F.col("doc_id"))))
    rows = {k: t for k, t in rows.items() if model.score(t) < toxicity.CUT}
    last = {}
    for k, t in sorted(rows.items()):
        last[t.encode().lower()] = k
    rows = {k: rows[k] for k in last.values()}
    keys = list(rows)
    roots = brute_roots([np.uint64(brute_fingerprint(rows[k])) for k in keys])
    groups = collections.defaultdict(set)
    for k, r in zip(keys, roots, strict=True):
        groups[r].add(k)
    got = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert len(got) == len(groups) and all(len(got & g) == 1 for g in groups.values())
