import duckdb
import pytest

from tracelab.operators import balance
from tracelab.plans import catalogue, faults, features, registry, rules, tables  # noqa: F401
from tracelab.sources.staging import staged

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SLOW = {"assignment_plan", "assignment_counts", "assignment_apply", "derivative_diff", "review_queue"}


def compare(spark, name, query, sql):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    df = query(spark, D)
    got = con.execute(sql)
    names = [x[0] for x in got.description]
    assert sorted(names) == sorted(df.columns)
    order = [names.index(c) for c in sorted(names)]
    want = sorted((tuple(r[i] for i in order) for r in got.fetchall()), key=repr)
    assert sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=repr) == want


@pytest.mark.parametrize("name", [n for n in registry.SQL if n not in SLOW])
def test_query_equals_sql(spark, name):
    compare(spark, name, registry.QUERIES[name], registry.SQL[name])


def test_assignments_equal_sql(spark):
    compare(spark, "assignment_plan", registry.QUERIES["assignment_plan"], registry.SQL["assignment_plan"])


def test_entry_module_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 3
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("table", ["traces", "candidates", "planning"])
def test_lines_of_an_order_are_dealt_once(spark, table):
    """One shuffle of narrow line rows, one of orders: nothing is grouped by the text of an id again."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for orders of any size
    try:
        plan = getattr(tables, table)(spark, D)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange ") == 2


def test_a_derivative_reads_its_lines_twice(spark):
    """Once as they were and once as changed; the assignments are written tables."""
    plan = registry.QUERIES["derivative_diff"](spark, D)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [l_orderkey") == 2


def test_a_join_by_id_leaves_traces_where_they_are(spark):
    """Exchanges of lines, orders and assignments, and of the counts; none of traces with their texts."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assigned = spark.range(9).selectExpr("cast(id AS string) AS example_id", "'reuse' AS source", "'1' AS candidate_id", "'Question' AS target_strategy")
        after = balance.apply_reuse(tables.traces(spark, D), assigned).groupBy("final_selection.selected_strategy").count()
        plan = after._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange ") == 4


def test_the_planner_reads_lines_once_and_writes_no_digests(spark, monkeypatch):
    written = []
    monkeypatch.setattr(balance, "staged", lambda df, tag: written.append(df) or staged(df, tag))
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    catalogue._plan(spark, D)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    ran = store.executionsList(before, 10_000)
    assert sum("lineitem.parquet" in ran.apply(i).physicalPlanDescription() for i in range(ran.length())) == 1
    assert not [df.columns for df in written if "_h" in df.columns or "candidates" in df.columns]


def test_rules_over_traces_are_evaluated_once(spark):
    """Traces are made once for both kinds of rows, and what a rule reads is a column by then, not the expressions behind it."""
    plan = registry.QUERIES["trace_breaks"](spark, D)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [l_orderkey") == 1
    assert plan.count("what about supplier") == 1


def test_exports_deal_lines_of_their_splits_only(spark):
    plan = registry.QUERIES["export_sft"](spark, D)._jdf.queryExecution().optimizedPlan().toString()
    assert "% 10) < 7" in plan[plan.index("RepartitionByExpression") : plan.index("Relation [l_orderkey")]


def test_a_round_trip_reads_its_lines_once(spark):
    plan = registry.QUERIES["lines_round_trip"](spark, D)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("] json") == 1
