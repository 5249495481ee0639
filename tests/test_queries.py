import pytest

from lorekeep.plans.registry import FLAGSHIP, QUERIES, SQL

from .conftest import SF, same


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, name):
    same(spark, name, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_spelled_pairs(spark):
    """Brute force over all pairs of distinct texts."""
    from lorekeep.operators.fold import Probe
    from lorekeep.sources import synth

    texts = sorted(r[0] for r in synth.messages(spark, SF).select("text").distinct().collect())
    probes = [Probe(x) for x in texts]
    want = {(texts[i], texts[j]) for j in range(len(texts)) for i in range(j) if probes[i].spelled(probes[j])}
    assert {tuple(r) for r in QUERIES["p6_spelled_pairs"](spark, SF).collect()} == want and want


def test_documents_search_messages_once(spark, monkeypatch):
    """Neither run goes back to the events: projects are found once."""
    from lorekeep.operators import reconcile

    plans = []
    monkeypatch.setattr(reconcile, "cut", lambda df, tag, _own=reconcile.cut: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or _own(df, tag))
    out = QUERIES["x7_documents"](spark, SF)
    assert len(plans) == 2 and not any("user_id" in x for x in [*plans, out._jdf.queryExecution().optimizedPlan().toString()])


def test_entry():
    import __spark_entry__ as e

    assert FLAGSHIP in e.queries() and set(e.oracle_sql()) <= set(e.queries())
