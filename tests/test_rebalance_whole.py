from __future__ import annotations

import inspect

from sparkyard.operators import rebalance
from sparkyard.plans import rebalance_queries


def test_registered_with_all_restarts(spark, data, monkeypatch):
    full, seen = rebalance.rebalance, []

    def spy(*args, **more):
        call = inspect.signature(full).bind(*args, **more)
        call.apply_defaults()
        seen.append(call.arguments["restarts"])
        return full(*args, **more)

    monkeypatch.setattr(rebalance, "rebalance", spy)
    assert rebalance_queries.queries()["rebalance_plan"](spark, f"{data}/sf0.001").columns
    assert seen == [80]
