"""Each stage of the pipeline on what the stage before kept, against plain rules."""

import corpus_pipeline
from tests.llm.conftest import BASE
from tests.llm.test_near_copies import plain_copies
from tests.llm.test_packing import check
from tests.llm.test_substrings import plain
from tidemark.llm.common import stored
from tidemark.llm.quality import judge


def test_every_stage(spark):
    docs = spark.read.parquet(f"{BASE}/documents.parquet")
    columns, held = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        held.append(stored(stage(spark, held[-1], BASE), name))
        assert held[-1].columns == columns and held[-1].dtypes == docs.dtypes
    texts = [{r.doc_id: r.text for r in x.collect()} for x in held]
    raw, good, single, short, clean = texts
    kept = {r.doc_id for r in judge(docs, spark.read.parquet(f"{BASE}/labels.parquet")).collect() if r.kept}
    assert set(good) == kept and all(raw[i] == t for i, t in good.items())
    groups = plain_copies(good)
    assert single == {i: t for i, t in good.items() if groups[i] == i}
    want = plain(single.items())
    assert set(short) == set(single)
    assert all(len((t or "").split()) == want[i][0] - want[i][1] for i, t in short.items())
    assert all(short[i] == t for i, t in single.items() if not want[i][1])
    assert clean.items() <= short.items()
    check(corpus_pipeline.STAGES[-1][1](spark, held[-1], BASE).collect(), list(clean.items()))


def test_run_gives_the_last_stage(spark):
    rows = corpus_pipeline.run(spark, BASE)
    assert rows.columns[:2] == ["doc_id", "start"] and rows.count() > 0
