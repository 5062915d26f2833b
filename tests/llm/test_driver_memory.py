import re

from shelfmark.llm import components


def test_a_half_round_of_components_is_a_plan_of_its_own(spark, monkeypatch):
    shuffles = []

    def noted(df, name, *more, cut=components.cut):
        shuffles.append(len(re.findall(r"Exchange hashpartitioning", df._jdf.queryExecution().executedPlan().toString())))
        return cut(df, name, *more)

    monkeypatch.setattr(components, "cut", noted)
    chain = spark.range(40).selectExpr("id as u", "id + 1 as v")
    assert {r.component for r in components.connected_components(chain).collect()} == {0}
    assert len(shuffles) > 3 and max(shuffles) <= 6
