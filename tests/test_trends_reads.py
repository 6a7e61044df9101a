"""How often a trends query reads the events."""

import re

from clickloom.operators.trends import Breakdown, Series, TrendsQuery, trends


def _reads(frame):
    return len(re.findall(r"Relation \[[^\]]*created_at", frame._jdf.queryExecution().optimizedPlan().toString()))


def test_cells_are_read_once(spark, demo, tmp_path):
    path = str(tmp_path / "events")
    demo.stream().write.parquet(path)
    events = spark.read.parquet(path)
    series = (Series("$pageview", "dau"), Series("click"), Series("click", "per_actor_avg"), Series("purchase", "unique_sessions"))
    query = TrendsQuery(series, "2024-01-10", "2024-01-20", breakdown=Breakdown("path", limit=3), compare=True)
    out = trends(events, query)
    assert _reads(out) == 0  # all from the cells, which were written out
    assert {(r.compare_label, r.series_index) for r in out.select("compare_label", "series_index").distinct().collect()} == {(w, i) for w in ("current", "previous") for i in range(4)}
    assert _reads(trends(events, TrendsQuery(series[:1], "2024-01-10", "2024-01-20"))) == 1
