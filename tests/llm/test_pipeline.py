"""The pipeline's stages on the smallest tables, each against what its operator decides."""

import re

import pytest

import corpus_pipeline
from weftgraph.llm import entry
from weftgraph.llm.shared import table, written


@pytest.fixture(scope="module")
def stages(spark, sf):
    out = [table(spark, sf, "documents")]
    for name, f in corpus_pipeline.STAGES:
        out.append(written(f(spark, out[-1], sf), name))
    return out


def test_stages(stages, spark, sf):
    docs = stages[0]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "minhash_dedup", "decontamination", "mixing", "token_output"]
    for before, after in zip(stages[:3], stages[1:4]):
        assert after.columns == docs.columns
        assert after.join(before, "doc_id", "left_anti").count() == 0 and 0 < after.count() <= before.count()
    assert stages[2].count() == entry.neardup.classes(stages[1]).select("class_id").distinct().count()
    gone = {r.doc_id for r in entry.decontamination.overlaps(stages[2], table(spark, sf, "benchmark")).collect()}
    assert {r.doc_id for r in stages[3].collect()} == {r.doc_id for r in stages[2].collect()} - gone
    assert stages[4].columns == docs.columns
    assert stages[5].count() == stages[4].count()


def test_run_and_registration(stages, spark, sf):
    key = lambda r: tuple(r)
    assert sorted(map(key, corpus_pipeline.run(spark, sf).collect())) == sorted(map(key, stages[-1].collect()))
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert {"pipeline"} | set(entry.queries()) <= names
    assert sorted(int(m[1]) for n in names if (m := re.match(r"op(\d+)_", n))) == list(range(1, 11))


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_oracles(spark, sf, name):
    import os

    import duckdb

    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(sf, t)}.parquet'")
    df = entry.queries()[name](spark, sf)
    cols = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, (tuple(r) for r in df.select(*cols).collect()))) == sorted(map(repr, want))
