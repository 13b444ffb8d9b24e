"""Free SQL that is safe by plan and by user; tools as table functions with grants."""

import os

import pytest

from spendlake.operators import analyst, cash, spending
from spendlake.sources import tables as t

TABLES = "/root/testdata/sf0.001"
NAMES = {"v_transactions", "v_cash_ledger", "v_budgets", "v_forecasts"}

GOOD = [
    "SELECT 1", "select * from V_Transactions where amount_rupees > 5 order by 1 limit 3", "table v_budgets",
    "with x as (select category, sum(amount_rupees) s from v_transactions group by 1 having count(*) > 1) select * from x", "select * from (select * from v_cash_ledger) t union all select * from v_cash_ledger",
    "select a.category, row_number() over (partition by a.user_id order by a.amount_rupees) r from v_transactions a left join v_budgets b using (user_id)", "select * from v_budgets where category in (select category from v_transactions)",
    "select case when 1 = 1 then 2 else 3 end, cast('1' as int), category like 'x%', id is null, -1 + 2, txn_time_ist between '2024-01-01' and '2024-02-01' from v_transactions",
]
BAD = {
    "": "empty", "select 1; select 2": "syntax", "selec 1": "syntax", "select * from parquet.`/etc`": "relation:parquet./etc", "select * from users": "relation:users", "select * from db.v_budgets": "relation:db.v_budgets",
    "drop view v_budgets": "node:DropView", "insert into v_budgets select 1, 2": "node:InsertIntoStatement", "create table x as select 1": "node:CreateTableAsSelect", "set x=1": "node:SetCommand", "show tables": "node:ShowTables",
    "select reflect('java.lang.System', 'exit', 1)": "function:reflect", "select input_file_name() from v_budgets": "function:input_file_name", "select explode(array(1))": "function:explode", "select * from range(3)": "node:UnresolvedTableValuedFunction",
    "select * from v_budgets b where exists (select 1 from secret)": "relation:secret", "select (select max(x) from other)": "relation:other", "select * from v_budgets where user_id in (select u from other)": "relation:other", "with x as (select * from other) select * from x": "relation:other",
    "select * from v_budgets tablesample (10 percent)": "node:Sample", "select * from v_budgets lateral view explode(array(1)) t": "node:Generate", "select * from identifier('secret')": "node:PlanWithUnresolvedIdentifier",
    "select sum(x) over (order by reflect('a', 'b')) from v_budgets": "function:reflect", "select * from v_budgets order by (select max(x) from other)": "relation:other",
}


def test_what_may_run(spark):
    assert {s: analyst.refusal(spark, s, NAMES) for s in GOOD} == dict.fromkeys(GOOD)
    assert {s: analyst.refusal(spark, s, NAMES) for s in BAD} == BAD


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="the test tables are not here")
def test_statements_like_duckdb_for_each_user(spark):
    import duckdb

    from spendlake.plans import live

    views = live.analysts_views(spark, TABLES)
    con = duckdb.connect()
    for name, view in views.items():
        rows = view.toPandas()  # noqa: F841
        con.execute(f"CREATE TABLE all_{name} AS SELECT * FROM rows")
    users = [r.user_id for r in t.transactions(spark, TABLES).select("user_id").distinct().orderBy("user_id").limit(3).collect()]
    statements = ["SELECT count(*) AS n, max(user_id) AS u FROM v_transactions", "SELECT category, sum(amount_rupees) AS s FROM v_transactions WHERE direction = 'DEBIT' GROUP BY category ORDER BY s DESC, category LIMIT 4", "SELECT DISTINCT user_id FROM v_transactions WHERE user_id > 0 OR 1 = 1", "SELECT coalesce(t.merchant, '?') AS m, count(*) AS n FROM v_transactions t JOIN v_budgets b ON t.category = b.category GROUP BY 1"]
    for user in users:
        for name in views:
            con.execute(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM all_{name} WHERE user_id = {user}")
        for statement in statements:
            got = analyst.run(spark, statement, views, user).collect()
            assert sorted(map(tuple, got)) == sorted(con.execute(statement).fetchall()), statement
    with pytest.raises(ValueError, match="relation:users"):
        analyst.run(spark, "SELECT * FROM users", views, users[0])
    assert not spark.catalog.tableExists("v_transactions")
    assert analyst.run(spark, "SELECT id FROM v_transactions", views).count() <= analyst.MOST_ROWS


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="the test tables are not here")
def test_tools(spark):
    payments, ledger = t.transactions(spark, TABLES), t.cash_ledger(spark, TABLES)
    results = {"cash_balance": cash.balances(ledger), "weekly_summary": spending.weekly_summary(payments), "list_transactions": spending.recent(payments, 20).drop("k")}
    analyst.register_tools(spark, results, analyst.grants(spark))
    user = payments.select("user_id").first().user_id
    for name, rows in results.items():
        want = sorted(map(str, rows.where(f"user_id = {user}").collect()))
        for agent, tools in analyst.GRANTS.items():
            got = sorted(map(str, spark.sql(f"SELECT * FROM {name}('{agent}', {user})").collect()))
            assert got == (want if name in tools else [])
        assert spark.sql(f"SELECT * FROM {name}('nobody', {user})").count() == spark.sql(f"SELECT * FROM {name}('coach', NULL)").count() == 0
    every = spark.sql("SELECT b.* FROM (SELECT DISTINCT user_id AS u FROM tool_cash_balance) c, LATERAL cash_balance('coach', c.u) b")
    assert sorted(map(str, every.collect())) == sorted(map(str, results["cash_balance"].collect()))
    assert "NestedLoop" not in every._jdf.queryExecution().executedPlan().toString()
