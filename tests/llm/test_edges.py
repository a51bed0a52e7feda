"""Odd rows, no rows and very long texts through the whole pipeline and every operator."""

import hashlib

import corpus_pipeline as P
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from scriptorium.llm.common import shared_dir, stored
from scriptorium.llm.licenses import TEMPLATES, license_report
from scriptorium.llm.matroska import media_report
from scriptorium.llm.mixing import mix_report
from scriptorium.llm.near_dup import near_dup_report
from scriptorium.llm.packing import pack_documents
from scriptorium.llm.quality import quality_report
from scriptorium.llm.secrets import secret_report
from scriptorium.llm.suffix_dedup import suffix_dedup_report
from scriptorium.llm.token_codec import token_file_report
from scriptorium.llm.toxicity import toxicity_report

WORDS, BYTES = (public_tokenizers.path(x) for x in ("word_bpe_49k.json", "byte_bpe_50k.json"))


def through(spark, docs):
    names = docs.columns
    for name, stage in P.STAGES[:-1]:
        docs = stored(stage(spark, docs, ""))
        assert docs.columns == names, name
    return docs, P.STAGES[-1][1](spark, docs, "").collect()


def test_pipeline_of_odd_rows(spark, edges):
    kept, pieces = through(spark, edges)
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    # blank and short texts fail the base rules, and so does the text of one repeated line
    assert not ids & {1, 2, 3, 4, 5, 12} and {r.doc_id for r in pieces} == ids
    assert all(r.length >= 1 for r in pieces)


def test_pipeline_of_nothing(spark, empty):
    kept, pieces = through(spark, empty)
    assert kept.count() == 0 and pieces == []


@pytest.fixture(scope="module")
def long(spark):
    """A text of over a million characters that holds a secret and a notice, its copy, and a short one."""
    words = " ".join(f"word{(i * 7919) % 50021} of{i % 97}" for i in range(75_000))
    text = words[:600_000] + " password: Zk3vQ9xT1bLw7RfY " + TEMPLATES["mit-notice"] + "\n" + words[600_000:]
    rows = [(1, text, "en", "a"), (2, text, "en", "b"), (3, "short text", "en", "a")]
    return stored(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")), text


def test_long_texts(spark, long):
    docs, text = long
    by_id = lambda df: {r.doc_id: r for r in df.collect()}
    data = text.encode()
    assert len(data) > 1_000_000
    n = len(text.split())
    assert by_id(quality_report(docs))[1].n_words == n
    found = by_id(secret_report(docs))[1]
    at = text.index("password")
    assert found.n_assign == 1 and f"assign:{at}:{at + 26}" in found.spans.split(",")
    assert by_id(mix_report(docs))[2].size == n
    gone = by_id(suffix_dedup_report(docs))
    assert gone[1].n_removed == gone[2].n_removed == len(data) and gone[3].n_removed == 0 and gone[2].n_later == len(data)
    near = by_id(near_dup_report(docs))
    assert near[1].class_id == near[2].class_id == 1 and near[3].class_id == 3
    assert by_id(license_report(docs))[1].licenses == "mit-notice"
    ids = by_id(token_file_report(docs, WORDS))
    assert ids[1].n_tokens == ids[2].n_tokens == ids[2].start and ids[1].ids_crc32 == ids[2].ids_crc32
    assert by_id(media_report(docs))[1].payload_sha256 == hashlib.sha256(data + b"\xff" * (-len(data) % 576)).hexdigest()
    pieces = [r for r in pack_documents(docs, BYTES).collect() if r.doc_id == 1]
    assert sum(r.length for r in pieces) == pieces[0].doc_tokens
    labels = spark.createDataFrame([(1, 0), (3, 1)], "doc_id long, toxic int")
    scores = by_id(toxicity_report(docs, labels))
    assert scores[1].score == scores[2].score


def test_shared_folder(spark):
    assert shared_dir(spark).startswith(spark.conf.get("spark.checkpoint.dir").rstrip("/"))


def test_outcome_of_all_stages_agrees(spark, edges):
    a, b = (sorted(map(str, through(spark, edges.withColumn("k", F.lit(1)))[1])) for _ in range(2))
    assert a == b
