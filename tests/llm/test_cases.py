"""Every operator on odd rows and on an empty table."""

import hashlib
import re
import zlib

import pytest

from tidewake.llm import exact_dedup, hmm, licenses, media, packing, pieces, secrets, simhash, toxicity, url_filter
from tidewake.llm.common import fold

CASES = {
    "simhash": lambda d: simhash.near_duplicates(d),
    "licenses": lambda d: licenses.scan_licenses(d),
    "exact_dedup": lambda d: exact_dedup.deduplicate(d),
    "secrets": lambda d: secrets.find_secrets(d),
    "redact": lambda d: secrets.redact(d),
    "hmm": lambda d: hmm.score(d, ~fold(2, 7, d["doc_id"]), rounds=1),
    "toxicity": lambda d: toxicity.toxicity(d, d.selectExpr("doc_id", "cast(id % 2 as int) as toxic")),
    "packing": lambda d: packing.pack(d),
    "media": lambda d: media.media_features(d),
    "urls": lambda d: url_filter.judge(d, "doc_id", "text"),
    "urls_clashing": lambda d: url_filter.judge(d.withColumn("url", d["id"]).withColumn("key", d["id"]), "doc_id", "text"),
    "fingerprints": lambda d: simhash.fingerprints(d),
    "encode": lambda d: pieces.encode(d),
    "decode": lambda d: pieces.decode(d.selectExpr("doc_id", "id", "if(id % 3 = 0, null, array(cast(id as int), 300, 31999)) as ids")),
}


@pytest.mark.parametrize("name", CASES)
def test_one_row_per_row(name, odd_docs):
    rows = CASES[name](odd_docs).collect()
    key = lambda x: (x is None, x or 0)
    assert sorted((r["doc_id"] for r in rows), key=key) == sorted((r["doc_id"] for r in odd_docs.collect()), key=key)


@pytest.mark.parametrize("name", CASES)
def test_empty_table(name, no_docs):
    assert CASES[name](no_docs).collect() == []


def test_samples_of_odd_rows(odd_docs, no_docs):
    rows = pieces.sample(odd_docs).collect()
    assert all(r["round_trip"] for r in rows)
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in odd_docs.collect()}
    assert pieces.sample(no_docs).collect() == []


def test_exact_groups(odd_docs):
    got = {}
    for r in exact_dedup.deduplicate(odd_docs).collect():
        got.setdefault(bytes(r["digest"]), []).append(r)
    for r in odd_docs.collect():
        assert hashlib.sha256(((r["text"] or "").encode()).lower()).digest() in got
    for rows in got.values():
        assert sum(r["kept"] for r in rows) == 1 and all(r["group_size"] == len(rows) for r in rows)
        known = [r["doc_id"] for r in rows if r["doc_id"] is not None]
        assert all(r["keep_id"] == max(known, default=None) for r in rows)


def test_secret_positions_against_brute_force(odd_docs):
    kinds = [
        ("assign", re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 12, 1),
        ("access", re.compile(r"AKIA[A-Z0-9]+"), 18, 0), ("hex", re.compile(r"[0-9a-f]+"), 16, 0),
    ]
    texts = {}
    for r in odd_docs.collect():
        texts.setdefault(r["doc_id"], set()).add(r["text"] or "")
    for r in secrets.find_secrets(odd_docs).collect():
        if len(texts[r["doc_id"]]) > 1:
            continue
        (text,) = texts[r["doc_id"]]
        want = sorted((m.start(), k, m.end(), name) for k, (name, p, least, g) in enumerate(kinds) for m in p.finditer(text) if len(m[g]) >= least)
        assert [(s["start"], s["rank"], s["end"], s["kind"]) for s in r["spans"] if s["base"]] == want


def test_secret_patterns_on_tricky_texts(spark):
    texts = ["token=secret:abcdefghijklmnop", "AKIAAKIA12 AKIA123456789012345 x", "0123456789abcdef0123 e 0123456789abcde", "é😀 password : 'abcdefghijkl'", "api_key==aaaaaaaaaaaaaaa token=short"]
    want = []
    for t in texts:
        want.append([(m.start(), m.end()) for m in re.finditer(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A) if len(m[1]) >= 12])
    rows = secrets.find_secrets(spark.createDataFrame([(i, t, "s", "l") for i, t in enumerate(texts)], "doc_id int, text string, source string, lang string")).orderBy("doc_id").collect()
    assert [[(s["start"], s["end"]) for s in r["spans"] if s["kind"] == "assign"] for r in rows] == want
    assert [[(s["start"], s["end"]) for s in r["spans"] if s["kind"] == "access"] for r in rows][1] == [(11, 30)]


def test_ownership_separates_examples(spark):
    shared, own = "token = 'ggggggggggggggg1'", "token = 'zzzzzzzzzzzzzzzz9'"
    rows = [(i, shared, f"s{i}", "l") for i in range(4)] + [(9, own, "s1", "l")]
    docs = spark.createDataFrame(rows, "doc_id int, text string, source string, lang string")
    live = {r["doc_id"]: [s["live"] for s in r["spans"]] for r in secrets.find_secrets(docs).collect()}
    assert live == {0: [False], 1: [False], 2: [False], 3: [False], 9: [True]}
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(docs).collect()}
    assert clean[9] == "[SECRET]'" and clean[0] == shared


def test_media_round_trip(odd_docs):
    for r, f in zip(sorted(media.media_columns(odd_docs, "id").collect()), sorted(media.media_features(odd_docs, "id").collect()), strict=True):
        payload, _, _ = media.described(bytes(r["media"]))
        text = {x["id"]: x["text"] for x in odd_docs.collect()}[r["id"]] or ""
        assert payload == media.padded(text.encode()) and len(payload) % 576 == 0 and payload
        assert f["n_bytes"] == len(text.encode()) and f["tail_crc32"] == zlib.crc32(payload[-32:])
        assert f["payload_sha256"] == hashlib.sha256(payload).hexdigest()
