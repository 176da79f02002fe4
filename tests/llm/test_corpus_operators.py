"""Filter audit, Merkle manifest and decontamination against brute force."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tidewake.llm import decontaminate, filter_audit, merkle, queries
from tidewake.llm.common import table


# -- filter audit ---------------------------------------------------------


def brute_audit(docs, labels):
    """docs: (id, text, part); labels: (id, quality, toxic)."""
    good, toxic = {k for k, q, _ in labels if q == 1}, {k for k, _, t in labels if t == 1}
    fails, texts = [], [(k, t or "") for k, t, _ in docs]
    for k, t, part in docs:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        copy = k is not None and any(j is not None and j < k and u == t for j, u in texts)
        bad = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": copy}
        fails.append((part or "", {x for x in bad if bad[x]}, k is not None and k in good, k is not None and k in toxic))
    out, shapley = {}, {}
    for order in itertools.permutations("ABCDE"):
        for step, x in enumerate(order, 1):
            for part in {f[0] for f in fails}:
                own = [f for f in fails if f[0] == part]
                gone = [f for f in own if x in f[1] and not f[1] & set(order[: step - 1])]
                shapley[part, x] = shapley.get((part, x), 0) + len(gone)
                out[part, "".join(order), step] = [
                    sum(not f[1] & set(order[:step]) for f in own), len(gone), sum(x in f[1] for f in own) - len(gone), sum(f[1] == {x} for f in own), sum(f[2] for f in gone), sum(f[3] for f in gone),
                ]
    return {key: tuple(v + [shapley[key[0], key[1][key[2] - 1]]]) for key, v in out.items()}


def audited(docs, labels):
    return {tuple(r[:3]): tuple(r[3:]) for r in filter_audit.interactions(docs, labels).collect()}


LABELS = "doc_id long, quality int, toxic int"


def test_audit_against_brute_force(spark):
    rng = random.Random(5)
    words = ["alpha", "Beta", "GAMMA", "delta", "x$", "émile", "|", "zz", *[f"w{k}" for k in range(60)]]
    docs = [(k, " ".join(rng.choices(words[: rng.choice([3, 8, 68])], k=rng.choice([3, 49, 50, 80]))), rng.choice(["a", "b", None])) for k in range(60)]
    docs += [(60 + k, docs[k][1], "b") for k in range(12)]
    labels = [(k, rng.randint(0, 1), rng.randint(0, 1)) for k in range(0, 72, 2)]
    got = audited(spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(4), spark.createDataFrame(labels, LABELS))
    assert got == brute_audit(docs, labels)


def test_audit_of_odd_rows(odd_docs, no_docs, spark):
    labels = [(1, 1, 0), (2, None, 1), (None, 1, 1), (2, 1, None), (3, 0, 0)]
    docs = [(r["doc_id"], r["text"], r["source"]) for r in odd_docs.collect()]
    merged = [(1, 1, 0), (2, 1, 1), (3, 0, 0)]
    assert audited(odd_docs, spark.createDataFrame(labels, LABELS)) == brute_audit(docs, merged)
    assert audited(no_docs, spark.createDataFrame(labels, LABELS)) == {}


def test_audit_on_words_never_shuffles_them(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").selectExpr("doc_id AS id", "coalesce(text, '') AS text")
    plan = filter_audit.word_counts(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1  # the texts


# -- merkle ---------------------------------------------------------------


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_tree(leaves):
    """The root and, for each leaf, its siblings from the leaf up."""
    proofs, at, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        for k in range(len(leaves)):
            first = at[k] // 3 * 3
            run = level[first : first + 3]
            proofs[k].append((run[: at[k] - first], run[at[k] - first + 1 :]))
            at[k] //= 3
        level = [H(*level[k : k + 3]) for k in range(0, len(level), 3)]
    return level[0], proofs


def brute_manifest(rows):
    """rows: (doc_id, source, lang, n_chars, text) -> sorted (doc_id, leaf, subroot, root, proof, folded)."""
    field = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    groups = {}
    for r in rows:
        cut = r if zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 2 else (*r[:4], r[4] and r[4].replace("\n", ""))
        groups.setdefault(r[1], []).append(((r[0] is not None, r[0] or 0), H(*map(field, r)), H(*map(field, cut)), r[0]))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: (sorted(groups[s]), brute_tree([x[1] for x in sorted(groups[s])])) for s in names}
    root, above = brute_tree([trees[s][1][0] for s in names])
    out = []
    for s, top in zip(names, above, strict=True):
        for x, own in zip(trees[s][0], trees[s][1][1], strict=True):
            at = x[2]
            for left, right in own + top:
                at = H(*left, at, *right)
            out.append((x[3], x[1], trees[s][1][0], root, H(*itertools.chain.from_iterable(a + b for a, b in own + top)), at))
    return sorted(out, key=repr)


def manifested(docs):
    tampered = F.when(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 2 == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    rows = merkle.verify(merkle.manifest(docs, found={"text": tampered}))
    text = [merkle.as_text(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")]
    rows = rows.select("doc_id", *text, merkle.proof_digest(F.col("proof")).alias("proof"), merkle.as_text(F.col("folded_root")).alias("folded"), "verified").collect()
    assert all(r["verified"] == (r["folded"] == r["root"]) for r in rows)
    return sorted((tuple(r)[:6] for r in rows), key=repr)


@pytest.mark.parametrize("sizes", [[1], [2], [3], [4], [1, 1], [1, 9, 10], [28, 1, 3, 5, 2]])
def test_merkle_against_brute_force(spark, sizes):
    rows = [(k * 7 % 101 * 1000 + s, None if s == 1 else f"s{s}", "é" if k % 2 else None, k, None if k % 5 == 4 else f"a\nb{k}" if k % 3 else "ab") for s, n in enumerate(sizes) for k in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    assert manifested(docs) == brute_manifest(rows)


def test_merkle_of_odd_rows(odd_docs, no_docs):
    rows = [(r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"]) for r in odd_docs.collect()]
    assert manifested(odd_docs) == brute_manifest(rows)
    assert manifested(no_docs) == []


def test_merkle_on_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = [(r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"]) for r in docs.collect()]
    assert manifested(docs) == brute_manifest(rows)


# -- decontamination ------------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def word_list(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_hits(text, items, window=10):
    words = word_list(text)
    hit, named = set(), set()
    for item, body in items:
        own = word_list(body)
        for k in range(max(1, len(own) - window + 1) if own else 0):
            pattern = own[k : k + window]
            for i in range(len(words) - len(pattern) + 1):
                if words[i : i + len(pattern)] == pattern:
                    hit |= set(range(i, i + len(pattern)))
                    named.add("" if item is None else str(item))
    return len(words), len(hit), sorted(named)


def decontaminated(docs, items, **more):
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in decontaminate.contamination(docs, items, **more).collect()), key=repr)


@pytest.mark.parametrize("more", [{}, {"listed": 1}, {"most_bits": 1}, {"block": 3}, {"window": 4, "block": 1}])
def test_decontamination_against_brute_force(spark, more):
    rng = random.Random(9)
    vocabulary = ["a", "b", "c", "é", "x1"]
    text = lambda n: " ".join(rng.choices(vocabulary, k=n))
    items = [(k, text(rng.choice([1, 2, 5, 9, 10, 11, 14]) if k > 3 else 16)) for k in range(14)] + [(3, "q r s"), (20, "Long, shared: passage of MORE than ten words that many items hold!"), (21, "long shared passage of more than ten words that many items hold"), (22, None), (23, " .. "), (None, "q r s")]
    docs = [(k, text(rng.randint(0, 120))) for k in range(30)] + [(30, "x " + items[15][1] + " y"), (31, items[0][1] + " " + items[0][1]), (32, None), (33, ""), (34, "Q-R-S")]
    got = decontaminated(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"), **more)
    assert got == sorted(((k, *brute_hits(t, items, more.get("window", 10))) for k, t in docs), key=repr)


def test_decontamination_of_odd_rows(odd_docs, no_docs, spark):
    items = [(1, "hello world token abcdef0123456789 mit license"), (2, "no id"), (3, "日本")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(((r["doc_id"], *brute_hits(r["text"], items)) for r in odd_docs.collect()), key=repr)
    assert decontaminated(odd_docs, benchmark) == want
    assert decontaminated(no_docs, benchmark) == []
    assert all(x[2:] == (0, []) for x in decontaminated(odd_docs, benchmark.limit(0)))
    assert all(x[2:] == (0, []) for x in decontaminated(odd_docs.drop("text").withColumn("text", F.lit(None).cast("string")), benchmark))


def test_search_skips_and_finds_every_pattern():
    t = decontaminate.Tables(3, 2, 0, bytes([0]), bytes([1]))  # a full table: every window is a candidate
    found = [b"a", b"b", b"c", b"d"]
    assert list(decontaminate.search(found, t)) == [(0, b"a b c"), (1, b"b c d")]
    assert list(decontaminate.search(found[:2], t)) == []


def test_digests_of_the_registered_queries(spark, sf_dir):
    items = [(r["item_id"], r["text"]) for r in table(spark, sf_dir, "benchmark").collect()]
    texts = {r["doc_id"]: r["text"] for r in table(spark, sf_dir, "documents").where("n_chars < 3000").collect()}
    for r in queries.op13_decontaminate(spark, sf_dir).where("n_words < 300 AND doc_id % 4 = 0").collect():
        if r["doc_id"] in texts:
            n_words, n_hit, named = brute_hits(texts[r["doc_id"]], items)
            assert tuple(r)[1:] == (n_words, n_hit, len(named), hashlib.sha256(",".join(named).encode()).hexdigest(), n_hit > 0)


# -- repairs --------------------------------------------------------------


def test_secrets_in_one_unbroken_run_take_linear_time(spark):
    import time

    from tidewake.llm import secrets

    schema = "doc_id int, text string, source string, lang string"
    secrets.find_secrets(spark.createDataFrame([(0, "x", "s", "l")], schema)).collect()  # warm up
    for k, part in enumerate(("eyJ", "-----BEGIN ", "://", "eyJaaaaaaaa.", "token", "bearer ", "a:b@", "AKIA")):
        docs = spark.createDataFrame([(k, part * (1_000_000 // len(part)), "s", "l")], schema)
        began = time.time()
        assert len(secrets.find_secrets(docs).collect()) == 1
        assert time.time() - began < 30, part


def test_a_token_begins_where_its_run_begins(spark):
    from tidewake.llm import secrets

    token = "eyJhbGciOiJI.eyJzdWIiOiIx.abcdefghijkl"
    texts = [token, f"x {token}.{token}", f"xeyJ{token}", f"é{token}", f"-{token}", f"a.{token} eyJshort.b.c"]
    docs = spark.createDataFrame([(i, t, f"s{i}", "l") for i, t in enumerate(texts)], "doc_id int, text string, source string, lang string")
    found = {r["doc_id"]: [(s["start"], s["end"]) for s in r["spans"] if s["kind"] == "jwt"] for r in secrets.find_secrets(docs, copied=99, spread=99).collect()}
    n = len(token)
    assert found == {0: [(0, n)], 1: [(2, 2 + n), (3 + n, 3 + 2 * n)], 2: [], 3: [(1, 1 + n)], 4: [], 5: [(2, 2 + n)]}


def test_repositories_decide_of_one_owner(spark):
    from tidewake.llm import secrets

    rows = [(i, "token = 'spreadspreadspread1'", "s1", f"l{i}") for i in range(4)] + [(9, "token = 'keptinonerepository2'", "s1", "l0"), (10, "token = 'twoownersfewrepos33'", "s1", "l0"), (11, "token = 'twoownersfewrepos33'", "s2", "l0")]
    docs = spark.createDataFrame(rows, "doc_id int, text string, source string, lang string")
    live = {r["doc_id"]: [s["live"] for s in r["spans"]] for r in secrets.find_secrets(docs).collect()}
    assert live == {0: [False], 1: [False], 2: [False], 3: [False], 9: [True], 10: [True], 11: [True]}


def test_links_where_one_pattern_holds_half_the_rows_and_broadcasts_are_off(spark):
    import numpy as np

    from tidewake.llm import components, simhash

    rng = np.random.default_rng(3)
    low = rng.integers(0, 2**10, 400, dtype=np.uint64)  # equal upper bits: one crowd under most masks
    fps = np.unique(np.r_[low, rng.integers(0, 2**63, 400, dtype=np.uint64)])
    nodes = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        root = {r["node"]: r["root"] for r in components.components(simhash.links(nodes, len(fps), block=16, head=3)).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    to = list(range(len(fps)))

    def find(i):
        while to[i] != i:
            i = to[i]
        return i

    for i, j in itertools.combinations(range(len(fps)), 2):
        if int(fps[i] ^ fps[j]).bit_count() <= 4:
            to[max(find(i), find(j))] = min(find(i), find(j))
    got, want = [root.get(int(x), int(x)) for x in fps.view(np.int64)], [find(i) for i in range(len(fps))]
    assert len(set(zip(got, want, strict=True))) == len(set(got)) == len(set(want))


def test_decode_leaves_out_foreign_ids(spark):
    from tidewake.llm import pieces

    rows = spark.createDataFrame([(0, [300, 10**6, -1, None, 301]), (1, [300, 301]), (2, [10**6]), (3, None)], "doc_id int, ids array<int>")
    got = {r["doc_id"]: r["text"] for r in pieces.decode(rows).collect()}
    assert got[0] == got[1] and got[2] == got[3] == ""


def license_labels(text):
    from tidewake.llm import licenses

    automata = tuple(licenses.compile_template(*t) for t in licenses.TEMPLATES)
    return licenses.scan(text, licenses.BASE, automata)[5].split(",")


@pytest.mark.parametrize("label, file", [("apache-2.0-text", "Apache-2.0"), ("gpl-2.0-text", "GPL-2"), ("gpl-3.0-text", "GPL-3"), ("lgpl-2.1-text", "LGPL-2.1"), ("lgpl-3.0-text", "LGPL-3"), ("mpl-2.0-text", "MPL-2.0")])
def test_published_licences_are_accepted_whole_only(label, file):
    from tidewake.llm import licenses

    text = licenses.published(file)
    found = license_labels(b"Preface.\n\n" + text.replace(b"\n", b"\r\n * ") + b"\nAfterword")
    assert label in found and not {x for x in found if x.endswith("-text")} - {label}
    words, n = text.split(), len(text.split())
    assert n > 900
    middle = next(k for k in range(n // 2, n) if words[k].isalpha())
    for altered in (words[:middle] + words[middle + 1 :], words[:middle] + [b"never"] + words[middle:], words[: n * 2 // 3]):
        assert label not in license_labels(b" ".join(altered))


@pytest.mark.parametrize("text, label", [
    ("SPDX-License-Identifier: GPL-3.0-only", "spdx-gpl-3.0-only"), ("// SPDX-License-Identifier: LGPL-2.1-or-later", "spdx-lgpl-2.1-or-later"), ("SPDX-License-Identifier: (MIT)", "spdx-mit"),
    ("redistribute it: it is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.", "gpl-or-later"),
    ('Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:\n\nThe copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.', "bsl-1.0"),
])
def test_identifiers_minor_versions_and_whole_notices(text, label):
    assert label in license_labels(text.encode())
    assert "spdx-mit" not in license_labels(b"SPDX-License-Identifier: MITRE")


def brute_toxicity(model, text):
    """A text's score from the returned model alone, by plain loops."""
    import math

    found, word = [], b""
    for c in text.lower().encode() + b" ":
        if c >= 0x80 or chr(c).isalnum():
            word += bytes([c])
        elif word:
            if word not in found:
                found.append(word)
            word = b""
    fired = set(found)
    for k in (5, 6, 7, 8):
        for w in found:
            n = sum(v[:k] == w[:k] for v in found if len(v) >= k) if len(w) >= k else 0
            fired |= {w[:k] + b"*" * stars for stars in range(1, min(n, 3) + 1)}
    hits = [f for f in fired if f in model.lexicon]
    upper, marks = sum(c.isupper() for c in text), sum(c == "!" for c in text)
    insult = re.search(r"\byou (?:are|re) (?:a |an |so |such |all )?\w+|\bshut up\b|\bgo away\b", text.lower())
    share = len(hits) / max(1, len(found))
    dense = [math.log(1 + len(hits)), min(share, 0.2) * 20, float(not hits), upper / max(1, len(text)), marks / max(1, len(found)), float(insult is not None)]
    z = model.intercept + sum(model.lexicon[h] for h in hits) + sum(a * b for a, b in zip(dense, model.dense, strict=True))
    return 1 / (1 + math.exp(-model.scale * (z - model.cut) - math.log(0.7 / 0.3)))


def test_toxicity_scores_against_plain_loops(spark, sf_dir):
    from tidewake.llm import toxicity
    from tidewake.llm.common import fold

    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    model = toxicity.train(docs, labels.where(~fold(1, 3, F.col("doc_id"))))
    assert model.lexicon
    texts = {r["doc_id"]: r["text"] or "" for r in docs.where("n_chars < 4000").collect()} | {-1: "", -2: "É! you are so x", -3: "SHUT UP!!"}
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in toxicity.score(rows, model).collect()}
    assert len(got) == len(texts) > 300
    for k, text in texts.items():
        assert got[k] == pytest.approx(brute_toxicity(model, text), abs=1e-9), k
