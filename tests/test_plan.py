"""The whole plan, from the harvest to an audited and priced submission."""

from pyspark.sql import functions as F

from haulgrid.functions.lineage import cut
from haulgrid.params import Params
from haulgrid.plans import bindings as b
from haulgrid.plans.supply_chain import plan_supply_chain
from haulgrid.schemas import FLOWS, FORECAST


def test_plan_passes_its_audit(spark, sf):
    history = cut(b.history(spark, sf), "history")
    plan = plan_supply_chain(b.arcs(spark, sf), lambda ids: b.arcs(spark, sf, 150.0, ids), history, Params(years=b.YEARS), n_clusters=3)
    assert plan.audit.filter(~F.col("ok")).isEmpty()
    assert [(f.name, f.dataType) for f in plan.flows.schema] == [(f.name, f.dataType) for f in FLOWS]
    assert plan.flows.filter(F.col("data_type") == FORECAST).count() == 200
    costs = plan.cost.collect()
    assert {r.yr for r in costs} == set(b.YEARS)
    for r in costs:
        assert abs(r.cost - (r.transport + r.mae + r.underuse)) < 1e-6


def test_the_registered_plan_clusters_over_all_pairs(spark, sf, matrix, monkeypatch):
    from haulgrid.operators import clustering as cl
    from haulgrid.plans import catalog

    made = []
    monkeypatch.setattr(catalog, "plan_supply_chain", lambda *a, **k: made.append(plan_supply_chain(*a, **k)) or made[0])
    catalog.supply_chain_plan(spark, sf)
    labels = made[0].labels
    want = cl.average_linkage(matrix, 3, radius=catalog.REACH)
    assert {tuple(r) for r in labels.select("idx", "cluster").collect()} == {tuple(r) for r in want.select("idx", "cluster").collect()}
    inner = {r.cluster: r.max_inner for r in cl.intra_max(matrix, labels).collect()}
    got = {r.cluster: r.max_inner for r in made[0].profile.collect()}
    assert len(got) == 3 and got == {c: inner[c] for c in got} and max(got.values()) > catalog.REACH
    assert made[0].audit.filter(~F.col("ok")).isEmpty()
