"""What one hot block costs: its sets are counted by partial aggregates, never in one window."""

import gridloom.llm.jaccard_join as jj
from pyspark.sql import DataFrame


def test_no_window_by_block(make_docs, monkeypatch):
    plans = []

    def recorded(df: DataFrame, name: str) -> DataFrame:
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return real(df, name)

    real = jj.stage
    monkeypatch.setattr(jj, "stage", recorded)
    words = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join([*words, f"x{i}"]), "en", "s") for i in range(6)]
    docs = make_docs(rows)
    kept = {r.key: r.component for r in jj.near_duplicates(docs).collect()}
    assert set(kept.values()) == {0}
    windows = [line for plan in plans for line in plan.splitlines() if "Window [" in line]
    assert windows and not any("], [block#" in line for line in windows)
    assert any("Aggregate [block#" in plan for plan in plans)
