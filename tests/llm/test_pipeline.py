"""The registered corpus queries against DuckDB, and the pipeline stage by stage."""

from __future__ import annotations

import pytest
from conftest import SF

import corpus_pipeline
from logdistill.checks import compare
from logdistill.llm import queries as Q
from logdistill.llm.common import table

from .conftest import words
from .test_documents import leaks_brute, lines_brute, near_brute


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_query(spark, monkeypatch, name):
    monkeypatch.setattr(compare, "UNWANTED", ("CartesianProduct", "BroadcastNestedLoopJoin"))
    result = compare.check(spark, compare.connect(SF), Q.QUERIES[name], Q.ORACLES[name], SF)
    assert result["ok"], result


def test_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert [n for i in range(1, 14) for n in names if n.startswith(f"op{i}_")] and "pipeline" in names
    assert all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 14))


NATIVE = ("op1_licenses", "op3_decontamination", "op7_mixing", "op8_secrets", "op10_line_dedup")


@pytest.mark.parametrize("name", NATIVE)
def test_native_plans(spark, name):
    plan = Q.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop"))


def test_stages(spark, odd):
    docs = table(spark, SF, "documents")
    for frame in (docs, odd):
        steps = dict(corpus_pipeline.STAGES)
        rows = frame.collect()
        known = steps["language"](spark, frame, SF)
        lean = steps["lines"](spark, frame, SF)
        single = steps["near_duplicates"](spark, frame, SF)
        clean = steps["leaks"](spark, frame, SF)
        assert all(set(x.columns) == {"doc_id", "text", "lang", "source", "n_chars"} for x in (known, lean, single, clean))
        lettered = sorted((r.doc_id for r in rows if any(c.isalpha() for c in r.text or "")), key=repr)
        assert sorted((r.doc_id for r in known.collect()), key=repr) == lettered
        left = {(r[0], r[3]) for r in lines_brute(rows, 1, 10)}
        import hashlib

        assert left == {(r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in lean.collect()}
        classes = near_brute(rows)
        assert {c for _, c, _ in classes} == {r.doc_id for r in single.collect()}
        items = table(spark, SF, "benchmark").collect()
        hit = {r[0] for r in leaks_brute(rows, items) if r[5]}
        assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in rows} - hit
    mixed = dict(corpus_pipeline.STAGES)["mixture"](spark, docs, SF)
    per = mixed.groupBy("doc_id").count()
    assert per.where("count > 2").count() == 0
    assert sum(len(words(r.text)) for r in mixed.collect()) > sum(len(words(r.text)) for r in docs.collect())


def test_run(spark):
    first = sorted(corpus_pipeline.run(spark, SF).select("doc_id", "copy").collect())
    assert first and first == sorted(corpus_pipeline.run(spark, SF).select("doc_id", "copy").collect())
