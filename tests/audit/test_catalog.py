"""Every registered query with SQL returns what DuckDB returns."""

import duckdb
import pytest

from folioscan.plans import catalog

SF = "/root/testdata/sf0.001"


def norm(v):
    if v is None or v != v:
        return "NULL"
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "pages", "orders", "lineitem"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got = catalog.queries()[name](spark, SF)
    want = duck.sql(catalog.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    pick = lambda rows, names: sorted(tuple(norm(r[names.index(c)]) for c in columns) for r in rows)
    assert pick([tuple(r) for r in got.collect()], got.columns) == pick(want.fetchall(), want.columns)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_runs(spark, name):
    catalog.queries()[name](spark, SF).collect()


def test_the_full_audit_has_every_kind_of_finding(spark):
    got = {(r.rule_id, r.level) for r in catalog.full_audit(spark, SF).select("rule_id", "level").distinct().collect()}
    missing = {f"R{k:02}" for k in range(1, 34)} - {r for r, _ in got}
    assert missing <= {"R24", "R28", "R30"}, missing


def test_the_full_audit_gathers_no_table_on_the_driver(spark):
    """Stored tables compress to a hundredth of their rows; by the size of the files Spark broadcast whole ones, 100 MB of references on check_s."""
    store = spark._jsparkSession.sharedState().statusStore()

    def plans() -> dict[int, str]:
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        own = store.executionsList()
        return {own.apply(k).executionId(): own.apply(k).physicalPlanDescription() for k in range(own.size())}

    before = max(plans(), default=-1)
    catalog.full_audit(spark, SF).write.format("noop").mode("overwrite").save()
    ran = [p for i, p in plans().items() if i > before]
    assert sum("SortMergeJoin" in p for p in ran) > 5 and not [p for p in ran if "Broadcast" in p]
