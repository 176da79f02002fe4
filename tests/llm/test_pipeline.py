"""Every stage of the corpus pipeline: odd rows, empty tables, clashing names, and results against brute force."""

import collections

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidewake.llm import packing, secrets
from tidewake.llm.common import table

SF = "/root/testdata/sf0.001"
KEPT = corpus_pipeline.STAGES[:-1]


def counted(df):
    return collections.Counter(tuple(r) for r in df.collect())


@pytest.mark.parametrize("name, stage", KEPT)
def test_stages_keep_columns_and_only_drop_rows(spark, name, stage, odd_docs):
    out = stage(spark, odd_docs, SF)
    assert out.columns == odd_docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in odd_docs.schema]
    if name != "secrets":
        assert not counted(out) - counted(odd_docs)
    else:
        assert out.count() == odd_docs.count()


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_on_an_empty_table(spark, name, stage, no_docs):
    assert stage(spark, no_docs, SF).collect() == []


@pytest.mark.parametrize("name, stage", KEPT)
def test_clashing_names(spark, name, stage, no_docs):
    odd = [*no_docs.columns, "row_", "Row__", "number", "key", "doc", "spans", "hits", "owner", "bad.name", "text__scored", "score__"]
    rows = [(i, f"text {i} password = 'abcdefghijklmnop{i}'", "en", "s", 5, *range(len(odd) - 5)) for i in range(4)]
    kinds = ["long", "string", "string", "string", "long", *["long"] * (len(odd) - 5)]
    docs = spark.createDataFrame(rows, ", ".join(f"`{n}` {k}" for n, k in zip(odd, kinds, strict=True)))
    out = stage(spark, docs, SF)
    assert out.columns == odd
    rest = [f"`{c}`" for c in odd if c not in ("text", "n_chars")]
    assert not counted(out.select(*rest)) - counted(docs.select(*rest))


def test_copies(spark, odd_docs):
    got = counted(corpus_pipeline.drop_copies(spark, odd_docs, SF).select("doc_id", "text"))
    best = {}
    for r in odd_docs.collect():
        key = (r["text"] or "").encode().lower()
        best[key] = max(best.get(key, -1), -1 if r["doc_id"] is None else r["doc_id"])
    assert sorted(-1 if k is None else k for k, _ in got.elements()) == sorted(best.values())


@pytest.mark.parametrize("stage", [corpus_pipeline.drop_copies, corpus_pipeline.drop_near_copies])
def test_row_numbers_hold_when_the_cluster_changes(spark, stage, monkeypatch, tmp_path):
    """Between writing a stage's numbers and reading them again the file splits change."""
    table(spark, SF, "documents").repartition(5).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    want = counted(stage(spark, docs, SF).select("text"))
    plain = corpus_pipeline.saved

    def changed(df, tag):
        out = plain(df, tag)
        spark.conf.set("spark.sql.files.minPartitionNum", "64")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        return out

    monkeypatch.setattr(corpus_pipeline, "saved", changed)
    try:
        assert counted(stage(spark, docs, SF).select("text")) == want
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def masked(text, spans, mark="[SECRET]"):
    out, at = "", 0
    for a, b in sorted(spans):
        if a >= at:
            out += text[at:a] + mark
        at = max(at, b)
    return out + text[at:]


def test_masked_texts(spark):
    docs = table(spark, SF, "documents").unionByName(table(spark, SF, "documents").limit(1).withColumn("doc_id", F.lit(-1).cast("long")).withColumn(
        "text", F.lit("é password='abcdefghij0123456789abcd' and https://user:pa55word0123456789abcdef@host 😀 tail token: 0123456789abcdef01234567"))
    )
    live = {r["doc_id"]: [(s["start"], s["end"]) for s in r["spans"] if s["live"]] for r in secrets.find_secrets(docs).collect()}
    before = {r["doc_id"]: r for r in docs.collect()}
    rows = corpus_pipeline.mask_secrets(spark, docs, SF).collect()
    assert len(rows) == len(before) and sum(len(x) for x in live.values()) > 5
    for r in rows:
        assert r["text"] == masked(before[r["doc_id"]]["text"], live[r["doc_id"]]) and r["n_chars"] == len(r["text"])
        assert (r["lang"], r["source"]) == (before[r["doc_id"]]["lang"], before[r["doc_id"]]["source"])


def test_many_spans_are_masked_alike(spark):
    text = " ".join(f"{i * 0x9E3779B97F4A7C15 % 2**96:024x}é{'x' * (i % 3)}" for i in range(3000))
    docs = spark.createDataFrame([(1, text, "en", "s", len(text))], "doc_id long, text string, lang string, source string, n_chars long")
    spans = [(s["start"], s["end"]) for s in secrets.find_secrets(docs).first()["spans"] if s["live"]]
    assert len(spans) == 3000
    assert corpus_pipeline.mask_secrets(spark, docs, SF).first()["text"] == masked(text, spans)


def test_batches_of_the_last_stage(spark, odd_docs):
    rows = corpus_pipeline.pack(spark, odd_docs, SF).collect()
    want = sorted(len((r["text"] or "").encode().split()) + 1 for r in odd_docs.collect())
    assert sorted(r["n_tokens"] for r in rows) == want
    batches = collections.defaultdict(list)
    for r in rows:
        batches[r["batch_id"]].append(r)
    for members in batches.values():
        assert len({m["bucket"] for m in members}) == 1 and sorted(m["slot"] for m in members) == list(range(len(members)))
        assert len(members) * members[0]["bucket_tokens"] <= max(packing.TOKENS, members[0]["bucket_tokens"])
