"""Free SQL over a user's own views, and named tools as table functions with grants.

Statements are parsed by Spark's own parser; what the parsed plan may hold is a list of nodes, functions and
views. The views are filtered by user beneath the statement, so that no statement, right or wrong, sees another
user's rows.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlake.functions.categories import is_essential

MOST_ROWS = 500
NODES = {"Project", "Filter", "Aggregate", "Sort", "GlobalLimit", "LocalLimit", "Offset", "Distinct", "Union", "Intersect", "Except", "Join", "SubqueryAlias", "UnresolvedSubqueryColumnAliases", "UnresolvedRelation", "UnresolvedWith", "UnresolvedHaving", "WithWindowDefinition", "OneRowRelation"}
FUNCTIONS = set(
    """abs avg between ceil ceiling coalesce concat concat_ws contains count count_if current_date date_add date_format date_sub date_trunc datediff day dayofmonth dayofweek dense_rank extract first floor greatest
    hour if ifnull lag last last_day lead least left length lower lpad ltrim max max_by median min min_by mod month months_between nullif nvl percent_rank percentile quarter rank regexp_like replace right
    round row_number rpad rtrim sign split_part stddev substr substring sum to_date trim trunc upper variance weekday weekofyear year""".split()
)


def views(payments: DataFrame, merchants: DataFrame, ledger: DataFrame, budgets: DataFrame, forecasts: DataFrame) -> dict[str, DataFrame]:
    """The analysts' views: times in IST, amounts in rupees, no texts of messages and no account hints.

    A payment's merchant is a scalar subquery on merchants (id, name), which Spark plans as a join.
    """
    ist = lambda c: (F.col(c) + F.expr("INTERVAL 330 MINUTES"))
    rupees = lambda c: (F.col(c) / 100).cast("decimal(12,2)")
    name = merchants.where(F.col("id") == F.col("merchant_id").outer()).select(F.min("name")).scalar()
    kinds = ["direction", "kind", "status", "category", is_essential(F.col("category")).alias("is_essential"), "merchant_raw"]
    return {
        "v_transactions": payments.select("id", "user_id", ist("txn_time").alias("txn_time_ist"), rupees("amount_paise").alias("amount_rupees"), *kinds, name.alias("merchant")),
        "v_cash_ledger": ledger.select("id", "user_id", "entry_type", rupees("amount_paise").alias("amount_rupees"), "category", ist("occurred_at").alias("occurred_at_ist")),
        "v_budgets": budgets.select("user_id", "category", rupees("monthly_limit_paise").alias("monthly_limit_rupees")),
        "v_forecasts": forecasts.select("id", "user_id", ist("computed_at").alias("computed_at_ist"), "broke_p50"),
    }


def seq(scala) -> list:
    return [scala.apply(i) for i in range(scala.size())]


def kind_of(node) -> str:
    return node.getClass().getSimpleName().rstrip("$")


def refusal(spark: SparkSession, statement: str, names: set[str]) -> str | None:
    """Why a statement must not run; null if it is one SELECT over `names` with allowed nodes and functions only."""
    if not statement or not statement.strip():
        return "empty"
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(statement)
    except Exception:  # the parser's errors are of many kinds
        return "syntax"
    holds_plan = spark._jvm.java.lang.Class.forName("org.apache.spark.sql.catalyst.expressions.PlanExpression")
    waiting, known = [("plan", plan)], {n.lower() for n in names}
    found: list[tuple[str, object]] = []
    while waiting:
        what, node = waiting.pop()
        kind = kind_of(node)
        found.append((what, node))
        if what == "plan":
            if kind == "UnresolvedWith":
                for cte in seq(node.cteRelations()):
                    known.add(cte._1().lower())
                    waiting.append(("plan", cte._2()))
            waiting += [("expression", e) for e in seq(node.expressions())]
        elif holds_plan.isInstance(node):
            waiting.append(("plan", node.plan()))
        if not (what == "plan" and kind == "UnresolvedRelation"):
            waiting += [(what, c) for c in seq(node.children())]
    for what, node in found:
        kind = kind_of(node)
        if what == "plan":
            if kind not in NODES:
                return f"node:{kind}"
            if kind == "UnresolvedRelation":
                parts = [str(p) for p in seq(node.multipartIdentifier())]
                if len(parts) != 1 or parts[0].lower() not in known:
                    return f"relation:{'.'.join(parts)}"
        elif kind == "UnresolvedFunction":
            name = ".".join(str(p) for p in seq(node.nameParts())).lower()
            if name not in FUNCTIONS:
                return f"function:{name}"
        elif kind.startswith("Unresolved") and kind not in ("UnresolvedAttribute", "UnresolvedStar", "UnresolvedAlias", "UnresolvedOrdinal", "UnresolvedWindowExpression", "UnresolvedSubqueryColumnAliases", "UnresolvedExtractValue"):
            return f"expression:{kind}"
    return None


def run(spark: SparkSession, statement: str, own_views: dict[str, DataFrame], user=None, most: int = MOST_ROWS) -> DataFrame:
    """The rows of a statement over the views of a user (of all users where user is None), at most `most`.

    A statement that is refused raises ValueError with the reason; one that Spark can't resolve raises Spark's
    own error. The views live in a session of their own while the statement is planned.
    """
    reason = refusal(spark, statement, set(own_views))
    if reason:
        raise ValueError(reason)
    for name, view in own_views.items():
        (view if user is None else view.where(F.col("user_id") == F.lit(user))).createOrReplaceTempView(name)
    try:
        return spark.sql(statement).limit(most)
    finally:
        for name in own_views:
            spark.catalog.dropTempView(name)


# Which agent may call which of the tools here.
GRANTS = {
    "coach": ("weekly_summary", "list_transactions", "cash_balance"),
    "cash_detective": ("weekly_summary", "list_transactions", "cash_balance"),
    "refund_advocate": ("list_transactions",),
    "analyst": ("weekly_summary", "list_transactions", "cash_balance"),
    "external": ("list_transactions", "cash_balance"),
}


def grants(spark: SparkSession) -> DataFrame:
    """agent and tool of each grant."""
    return spark.createDataFrame([(agent, tool) for agent, tools in GRANTS.items() for tool in tools], "agent string, tool string")


def register_tools(spark: SparkSession, results: dict[str, DataFrame], granted: DataFrame) -> None:
    """Each result (which has user_id) as a table function of its name: `SELECT * FROM name(agent, user)` gives the user's rows if the agent has a grant (agent, tool), else none.

    The functions are Spark's own, so a call is planned with what stands around it: called for each of many
    users by LATERAL, it is a join. Grants are a row for an agent and tool; they become part of the functions, so
    that a call is checked before any row is read.
    """
    agents: dict[str, set[str]] = {}
    for r in granted.where("agent IS NOT NULL").distinct().collect():
        agents.setdefault(r.tool, set()).add(r.agent)
    for name, rows in results.items():
        rows.createOrReplaceTempView(f"tool_{name}")
        returns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        quoted = ", ".join("'" + a.replace("\\", "\\\\").replace("'", "\\'") + "'" for a in sorted(agents.get(name, ())))
        spark.sql(
            f"""CREATE OR REPLACE TEMPORARY FUNCTION {name}(who_asks STRING, whose {rows.schema["user_id"].dataType.simpleString()}) RETURNS TABLE ({returns})
            RETURN SELECT r.* FROM tool_{name} r WHERE r.user_id = whose AND {f"who_asks IN ({quoted})" if quoted else "false"}"""
        )
