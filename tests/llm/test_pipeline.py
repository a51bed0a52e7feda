"""The pipeline's stages on a small folder, each against what it promises of its own input."""

from collections import Counter, defaultdict

import corpus_pipeline as P
from pyspark.sql import functions as F

from scriptorium.llm.common import stored
from scriptorium.llm.quality import quality_report
from scriptorium.llm.secrets import secret_report

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    seen = [docs]
    for name, stage in P.STAGES[:-1]:
        docs = stored(stage(spark, docs, SF))
        assert docs.columns == names, name
        seen.append(docs)
    raw, good, unique, masked, mix = ({r.doc_id: r for r in d.collect()} for d in seen)
    assert set(good) == {r.doc_id for r in quality_report(seen[0]).where("kept").collect()}
    assert set(unique) <= set(good) and len({r.text for r in unique.values()}) == len(unique)
    assert set(masked) == set(unique)
    assert secret_report(seen[3]).where("n_hex > 0 or n_access > 0").count() == 0
    changed = [k for k in masked if masked[k].text != unique[k].text]
    assert all("[secret]" in masked[k].text and masked[k].n_chars == len(masked[k].text) for k in changed)
    copies = Counter(r.doc_id for r in seen[4].collect())
    assert max(copies.values()) <= 2 and set(mix) <= set(masked)
    pieces = defaultdict(int)
    for r in P.STAGES[-1][1](spark, seen[4], SF).collect():
        pieces[r.doc_id] += r.length
    assert set(pieces) == set(copies)


def test_run(spark):
    out = P.run(spark, SF)
    assert out.count() > 0 and out.agg(F.max("length")).first()[0] <= 2048
