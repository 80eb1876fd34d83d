"""Plan-shape checks: the properties the design relies on at scale, read from the
physical plans of every catalogue query at sf0.001."""

import pytest

import __spark_entry__ as E
from vellum.plans import catalog

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_no_cartesian_or_nested_loop_join(spark, name):
    plan = _plan(E.queries()[name](spark, SF))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_scans_are_pruned(spark):
    plan = _plan(E.queries()["fingerprint_md5"](spark, SF))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
    plan = _plan(E.queries()["changed_files"](spark, SF))
    assert "NOT (lang" in plan and "DataFilters" in plan  # the lang filter reaches the scan


def test_topk_limits_before_the_exchange(spark):
    plan = _plan(E.queries()["topk_similarity"](spark, SF))
    assert "WindowGroupLimit" in plan and "Partial" in plan
    assert "MapInArrow" in plan


def test_chunk_ids_never_gather_a_source(spark):
    """The numbering has no exchange or window by source alone."""
    plan = _plan(E.queries()["chunk_ids"](spark, SF))
    assert "hashpartitioning(source" not in plan


def test_semantic_chunks_move_no_sentence(spark):
    assert "Exchange hashpartitioning" not in _plan(E.queries()["chunk_semantic"](spark, SF))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_single_partition_exchanges_are_bounded(spark, name):
    """A single-partition exchange may only follow a partial aggregate (one row per task),
    carry one row per partition (``_pid``) or sit under the peek's fixed limit."""
    lines = _plan(E.queries()[name](spark, SF)).split("\n")
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            below = lines[i + 1] if i + 1 < len(lines) else ""
            assert "partial_" in below or "_pid" in below, (name, below)
