"""Every operator of the engine as a query over the driver's tables, with SQL that gives the same rows."""

from __future__ import annotations

import statistics
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import workload as K
from .functions.expr import c, call
from .functions.kernels import gathers, n_distinct, rowwise
from .functions.types import DataType
from .operators import relational as R
from .operators.column import Column
from .operators.frame import Frame
from .operators.storage import new_path
from .plans.pipeline import Pipeline, aggregate, derive, exclude, groupBy, keep, remove, select, ungroup
from .sources.readers import read_csv, write_csv
from .streaming.streams import windowed

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def source(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def query(sql: str | None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def verbs(name: str, table: str, pipeline: Pipeline, sql: str, prepare: Callable[[DataFrame], DataFrame] = lambda d: d) -> None:
    """Registers a pipeline over one table."""
    QUERIES[name] = lambda spark, sf_dir: pipeline.execute(Frame(prepare(source(spark, sf_dir, table)))).sdf
    SQL[name] = sql


def holes(d: DataFrame) -> DataFrame:
    """Orders with missing values: prices below 50,000 and priorities of every seventh order."""
    return d.select(
        "o_orderkey",
        F.when(F.col("o_totalprice") >= 50000, F.col("o_totalprice")).alias("price"),
        F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderpriority")).alias("priority"),
        F.when(F.col("o_orderkey") % 5 != 0, F.col("o_custkey")).alias("cust"),
        "o_orderstatus",
    )


HOLES = """(SELECT o_orderkey, CASE WHEN o_totalprice >= 50000 THEN o_totalprice END AS price,
    CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END AS priority, CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey END AS cust,
    o_orderstatus FROM orders)"""

# Projections and filters

verbs("select_cols", "orders", select("o_totalprice", "o_orderkey"), "SELECT o_totalprice, o_orderkey FROM orders")
verbs("exclude_cols", "orders", exclude("o_orderdate", "unknown"), "SELECT * EXCLUDE (o_orderdate) FROM orders")
for _name, _symbol, _sql in (("eq", "==", "="), ("ne", "!=", "<>"), ("lt", "<", "<"), ("le", "<=", "<="), ("gt", ">", ">"), ("ge", ">=", ">=")):
    _p = {"==": c("l_quantity") == 25, "!=": c("l_quantity") != 25, "<": c("l_quantity") < 25, "<=": c("l_quantity") <= 25, ">": c("l_quantity") > 25, ">=": c("l_quantity") >= 25}[_symbol]
    verbs(f"keep_{_name}", "lineitem", select("l_orderkey", "l_linenumber", "l_quantity") >> keep(_p), f"SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity {_sql} 25")
verbs("keep_and", "lineitem", keep((c("l_quantity") > 45) & (c("l_discount") >= 0.05)) >> select("l_orderkey", "l_linenumber"), "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 45 AND l_discount >= 0.05")
_STRICT = "CASE WHEN price IS NOT NULL AND cust IS NOT NULL THEN price > 200000 OR cust > 900 END"
_either = (c("price") > 200000) | (c("cust") > 900)
verbs("keep_or_strict", "orders", keep(_either) >> select("o_orderkey"), f"SELECT o_orderkey FROM {HOLES} WHERE {_STRICT}", holes)
verbs("remove_or_strict", "orders", remove(_either) >> select("o_orderkey"), f"SELECT o_orderkey FROM {HOLES} WHERE NOT coalesce({_STRICT}, false)", holes)
verbs("remove_null", "orders", remove(c("price") > 200000), f"SELECT * FROM {HOLES} WHERE NOT coalesce(price > 200000, false)", holes)
verbs("keep_not_none", "orders", keep(c("priority") != None), f"SELECT * FROM {HOLES} WHERE priority IS NOT NULL", holes)  # noqa: E711
verbs("remove_not_none", "orders", remove(c("priority") != None), f"SELECT * FROM {HOLES} WHERE priority IS NULL", holes)  # noqa: E711
verbs("keep_truthy", "lineitem", keep(c("l_discount")) >> select("l_orderkey", "l_linenumber"), "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount <> 0")
verbs("keep_negated", "orders", keep(~(c("price") > 200000)), f"SELECT * FROM {HOLES} WHERE NOT (price > 200000)", holes)
verbs("keep_constant", "nation", keep(c("n_nationkey") >= 0) >> keep(1), "SELECT * FROM nation")
verbs("keep_mismatch", "nation", keep(c("n_name") != 1), "SELECT * FROM nation")

# Derived columns

_key = ("l_orderkey", "l_linenumber")
verbs("derive_arith", "lineitem", derive(v=c("l_quantity") * 2 + 1 - c("l_tax"), w=10 - c("l_linenumber")) >> select(*_key, "v", "w"), "SELECT l_orderkey, l_linenumber, l_quantity * 2 + 1 - l_tax AS v, CAST(10 - l_linenumber AS BIGINT) AS w FROM lineitem")
verbs("derive_chain", "lineitem", derive(gross=c("l_extendedprice") * (1 - c("l_discount")), net=c("gross") * 0.5) >> select(*_key, "gross", "net"), "SELECT l_orderkey, l_linenumber, gross, gross * 0.5 AS net FROM (SELECT *, l_extendedprice * (1 - l_discount) AS gross FROM lineitem)")
verbs("derive_replace", "nation", derive(n_nationkey=c("n_nationkey") + 100, n_name=c("n_name") + "!"), "SELECT CAST(n_nationkey + 100 AS BIGINT) AS n_nationkey, n_name || '!' AS n_name, n_regionkey FROM nation")
verbs("derive_div_ieee", "lineitem", derive(q=c("l_quantity") / (c("l_quantity") - 25), z=(c("l_quantity") - 25) / (c("l_quantity") - 25)) >> select(*_key, "q", "z"), "SELECT l_orderkey, l_linenumber, l_quantity / (l_quantity - 25) AS q, (l_quantity - 25) / (l_quantity - 25) AS z FROM lineitem")
verbs("derive_pow_int", "lineitem", derive(p=c("l_linenumber") ** 3) >> select(*_key, "p"), "SELECT l_orderkey, l_linenumber, CAST(l_linenumber AS BIGINT) * l_linenumber * l_linenumber AS p FROM lineitem")
verbs("derive_pow_float", "lineitem", derive(p=c("l_quantity") ** 2.0) >> select(*_key, "p"), "SELECT l_orderkey, l_linenumber, l_quantity * l_quantity AS p FROM lineitem")
verbs("derive_bool_null", "orders", derive(b=(c("price") > 200000) & (c("cust") > 900), o=_either) >> select("o_orderkey", "b", "o"), f"SELECT o_orderkey, CASE WHEN price IS NOT NULL AND cust IS NOT NULL THEN price > 200000 AND cust > 900 END AS b, {_STRICT} AS o FROM {HOLES}", holes)
verbs("derive_none", "orders", derive(e=c("priority") == None, n=c("priority") != None) >> select("o_orderkey", "e", "n"), f"SELECT o_orderkey, CASE WHEN priority IS NOT NULL THEN false END AS e, CASE WHEN priority IS NOT NULL THEN true END AS n FROM {HOLES}", holes)  # noqa: E711
verbs("derive_const", "region", derive(one=1, name="x", half=0.5, yes=True), "SELECT *, CAST(1 AS BIGINT) AS one, 'x' AS name, CAST(0.5 AS DOUBLE) AS half, true AS yes FROM region")

# Called functions

_x = c("l_quantity") - 25
_functions = {"root": np.sqrt, "log": np.log, "size": np.abs, "low": np.floor, "high": np.ceil, "even": np.rint, "sgn": np.sign}
verbs(
    "call_ufunc", "lineitem", derive(**{k: call(f, _x / 4) if f not in (np.sqrt, np.log) else call(f, c("l_quantity") - 1) for k, f in _functions.items()}) >> select(*_key, *_functions),
    """SELECT l_orderkey, l_linenumber, sqrt(l_quantity - 1) AS root, CASE WHEN l_quantity = 1 THEN CAST('-Infinity' AS DOUBLE) ELSE ln(l_quantity - 1) END AS log,
    abs((l_quantity - 25) / 4) AS size, floor((l_quantity - 25) / 4) AS low, ceil((l_quantity - 25) / 4) AS high, round_even((l_quantity - 25) / 4, 0) AS even,
    CAST(sign(l_quantity - 25) AS DOUBLE) AS sgn FROM lineitem""",
)
verbs("call_mod", "orders", derive(m=call(np.mod, 0 - c("o_custkey"), 7), d=call(np.floor_divide, 0 - c("o_custkey"), 7)) >> select("o_orderkey", "m", "d"), "SELECT o_orderkey, CAST((7 - o_custkey % 7) % 7 AS BIGINT) AS m, CAST(floor(-o_custkey / 7.0) AS BIGINT) AS d FROM orders")
verbs("call_extremes", "orders", derive(a=call(np.maximum, c("price"), c("cust") * 100), b=call(np.minimum, c("price"), c("cust") * 100)) >> select("o_orderkey", "a", "b"), f"SELECT o_orderkey, CASE WHEN price IS NOT NULL AND cust IS NOT NULL THEN greatest(price, cust * 100) END AS a, CASE WHEN price IS NOT NULL AND cust IS NOT NULL THEN least(price, cust * 100) END AS b FROM {HOLES}", holes)
verbs("call_logical_not", "orders", derive(n=call(np.logical_not, c("price") > 200000)) >> select("o_orderkey", "n"), f"SELECT o_orderkey, NOT (price > 200000) AS n FROM {HOLES}", holes)


@rowwise
def banded(x):
    return (np.floor(np.asarray(x, dtype=float) / 10) * 10).astype(int)


verbs("call_rowwise", "lineitem", derive(band=call(banded, c("l_quantity"), returns="long")) >> select(*_key, "band"), "SELECT l_orderkey, l_linenumber, CAST(floor(l_quantity / 10) * 10 AS BIGINT) AS band FROM lineitem")
verbs("call_traced", "lineitem", derive(t=call(lambda x, y: abs(x - 25) * 2 + y, c("l_quantity"), c("l_tax"))) >> select(*_key, "t"), "SELECT l_orderkey, l_linenumber, abs(l_quantity - 25) * 2 + l_tax AS t FROM lineitem")
_MEAN = f"(SELECT avg(cust) FROM {HOLES})"
verbs("call_reducer_broadcast", "orders", derive(m=call(np.mean, c("cust"))) >> select("o_orderkey", "m"), f"SELECT o_orderkey, CASE WHEN cust IS NOT NULL THEN {_MEAN} END AS m FROM {HOLES}", holes)
verbs("call_fill_missing", "orders", derive(m=call(np.mean, c("cust"), fill_missing=0)) >> select("o_orderkey", "m"), f"SELECT o_orderkey, CASE WHEN cust IS NOT NULL THEN (SELECT avg(coalesce(cust, 0)) FROM {HOLES}) END AS m FROM {HOLES}", holes)
_demean = call(lambda x: x - np.mean(x), c("l_quantity"))
verbs("call_demean", "lineitem", derive(z=_demean) >> select(*_key, "z"), "SELECT l_orderkey, l_linenumber, l_quantity - (SELECT avg(l_quantity) FROM lineitem) AS z FROM lineitem")
verbs("keep_after_demean", "lineitem", derive(z=_demean) >> keep(c("l_returnflag") == "A") >> select(*_key, "z"), "SELECT l_orderkey, l_linenumber, z FROM (SELECT *, l_quantity - (SELECT avg(l_quantity) FROM lineitem) AS z FROM lineitem) WHERE l_returnflag = 'A'")

# Groups

_D = "CAST({} AS DOUBLE)"
for _name, _function, _sql in (
    ("mean", statistics.mean, "avg(l_quantity)"), ("sum", sum, "sum(l_quantity)"), ("min", min, "min(l_quantity)"), ("max", max, "max(l_quantity)"),
    ("count", len, "count(l_quantity)"), ("median", np.median, "median(l_quantity)"), ("distinct", n_distinct, "count(DISTINCT l_quantity)"),
):
    verbs(f"group_agg_{_name}", "lineitem", groupBy("l_returnflag") >> aggregate(v=("l_quantity", _function)), f"SELECT l_returnflag, {_sql} AS v FROM lineitem GROUP BY l_returnflag")
verbs("group_agg_spread", "lineitem", groupBy("l_linestatus") >> aggregate(s=("l_linenumber", np.std), v=("l_linenumber", statistics.variance)) >> derive(s=call(np.rint, c("s") * 1e6), v=call(np.rint, c("v") * 1e6)), "SELECT l_linestatus, round_even(stddev_pop(l_linenumber) * 1e6, 0) AS s, round_even(var_samp(l_linenumber) * 1e6, 0) AS v FROM lineitem GROUP BY l_linestatus")
verbs("group_agg_all_missing", "orders", derive(gone=c("price") * 1) >> keep(c("o_orderkey") >= 0) >> groupBy("o_orderkey") >> aggregate(n=("gone", len), m=("gone", np.mean)), f"SELECT o_orderkey, CASE WHEN count(price) > 0 THEN count(price) END AS n, avg(price) AS m FROM {HOLES} GROUP BY o_orderkey", holes)
verbs("group_null_key", "orders", groupBy("priority") >> aggregate(n=("o_orderkey", len), p=("price", max)), f"SELECT priority, count(*) AS n, max(price) AS p FROM {HOLES} GROUP BY priority", holes)
verbs("group_multi_key", "lineitem", groupBy("l_returnflag", "l_linestatus") >> aggregate(n=("l_orderkey", len), q=("l_quantity", sum)), "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY ALL")
verbs("group_global", "lineitem", groupBy() >> aggregate(n=("l_orderkey", len), q=("l_quantity", max)), "SELECT count(*) AS n, max(l_quantity) AS q FROM lineitem")
verbs("group_global_empty", "lineitem", keep(c("l_quantity") < 0) >> groupBy() >> aggregate(n=("l_orderkey", len)), "SELECT count(*) AS n FROM lineitem WHERE l_quantity < 0 HAVING count(*) > 0")
verbs("group_lambda", "lineitem", groupBy("l_returnflag") >> aggregate(span=("l_quantity", lambda v: max(v) - min(v))), "SELECT l_returnflag, max(l_quantity) - min(l_quantity) AS span FROM lineitem GROUP BY l_returnflag")
verbs("group_stale_key", "lineitem", groupBy("l_returnflag") >> derive(l_returnflag="same") >> aggregate(n=("l_returnflag", len)), "SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY l_returnflag")
verbs("group_keep_clears", "lineitem", groupBy("l_returnflag") >> keep(c("l_quantity") > 49) >> groupBy("l_linestatus") >> aggregate(n=("l_orderkey", len)), "SELECT l_linestatus, count(*) AS n FROM lineitem WHERE l_quantity > 49 GROUP BY l_linestatus")
verbs("group_ungroup", "region", groupBy("r_name") >> ungroup() >> select("r_name"), "SELECT r_name FROM region")
verbs("group_key_overwritten", "lineitem", groupBy("l_returnflag", "l_linestatus") >> aggregate(l_linestatus=("l_quantity", sum)), "SELECT l_returnflag, sum(l_quantity) AS l_linestatus FROM lineitem GROUP BY l_returnflag, lineitem.l_linestatus")


@query("SELECT l_orderkey, CAST(sum(l_linenumber * l_linenumber) AS BIGINT) AS v FROM lineitem GROUP BY l_orderkey")
def group_udaf(spark, sf_dir):
    """A callable that nothing native expresses, on the list of each group's values: an order has few lines."""
    p = groupBy("l_orderkey") >> aggregate(v=("l_linenumber", gathers(lambda v: sum(x * x for x in v))))
    return p.execute(Frame(source(spark, sf_dir, "lineitem"))).sdf


@query("SELECT l_returnflag AS flag, avg(l_quantity) AS q FROM lineitem GROUP BY l_returnflag")
def group_rename(spark, sf_dir):
    grouped = groupBy("l_returnflag").execute(Frame(source(spark, sf_dir, "lineitem"))).rename_col("l_returnflag", "flag")
    return (Pipeline(grouped) >> aggregate(q=("l_quantity", np.mean))).execute().sdf


# Edits


@query("SELECT *, 'x' AS tag FROM region")
def set_col_scalar(spark, sf_dir):
    return Frame(source(spark, sf_dir, "region")).set_col("tag", "x").sdf


@query("SELECT r_regionkey, r_name, CAST(r_regionkey * 10 AS BIGINT) AS v FROM region")
def set_col_list(spark, sf_dir):
    f = Frame(source(spark, sf_dir, "region"))
    keys = f.get_col("r_regionkey")  # five rows
    return f.set_col("v", [10 * k for k in keys]).sdf


@query("SELECT r_regionkey, CASE WHEN r_regionkey = (SELECT r_regionkey FROM region LIMIT 1 OFFSET 2) THEN 'new' ELSE r_name END AS r_name FROM region")
def set_value(spark, sf_dir):
    return Frame(source(spark, sf_dir, "region")).set_value("r_name", 2, "new").sdf


@query("SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS DOUBLE) AS o_custkey FROM orders")
def retype_int_string(spark, sf_dir):
    f = Frame(source(spark, sf_dir, "orders")).select("o_orderkey", "o_custkey")
    return f.retype_col("o_orderkey", DataType.STRING).retype_col("o_custkey", DataType.FLOAT64).sdf


@query("SELECT o_orderkey FROM orders")
def retype_string_int(spark, sf_dir):
    f = Frame(source(spark, sf_dir, "orders")).select("o_orderkey")
    return f.retype_col("o_orderkey", DataType.STRING).retype_col("o_orderkey", DataType.INT64).sdf


@query("SELECT * EXCLUDE (o_orderdate) FROM orders")
def drop_col(spark, sf_dir):
    return Frame(source(spark, sf_dir, "orders")).drop_col("o_orderdate").sdf


@query("SELECT n_nationkey, n_name AS name, n_regionkey FROM nation")
def rename_col(spark, sf_dir):
    return Frame(source(spark, sf_dir, "nation")).rename_col("n_name", "name").sdf


@query("SELECT * FROM orders LIMIT 40 OFFSET 100")
def slice_rows(spark, sf_dir):
    return Frame(source(spark, sf_dir, "orders")).slice(100, 140).sdf


@query("SELECT l_orderkey, l_extendedprice * 0.9 AS net FROM lineitem WHERE l_quantity > 45 AND l_returnflag = 'R'")
def optimized_pipeline(spark, sf_dir):
    p = derive(net=c("l_extendedprice") * 0.9) >> select("l_orderkey", "net", "l_quantity", "l_returnflag") >> keep(c("l_quantity") > 45) >> keep(c("l_returnflag") == "R") >> select("l_orderkey", "net")
    return (Frame(source(spark, sf_dir, "lineitem")) >> p).optimize().execute().sdf


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def csv_round_trip(spark, sf_dir):
    """A file of delimited text, written and read again, with types inferred from all of it."""
    at = new_path(spark, "nation")
    write_csv(Frame(source(spark, sf_dir, "nation")), at)
    return read_csv(at).sdf.select(F.col("n_nationkey").cast("int"), "n_name", F.col("n_regionkey").cast("int"))


@query("SELECT count(*) AS n, sum(n_nationkey) AS keys, max(n_name) AS last FROM nation")
def column_from_strings(spark, sf_dir):
    """Texts read as the types that hold them all, in memory."""
    nation = Frame(source(spark, sf_dir, "nation"))
    keys = Column.from_strings([f"{k}" for k in nation.get_col("n_nationkey")] + ["na", ""])
    names = Column.from_strings([*nation.get_col("n_name"), "null", "."])
    f = Frame.from_columns({"k": keys, "name": names})
    return f.sdf.agg(F.count("k").alias("n"), F.sum("k").alias("keys"), F.max("name").alias("last"))


@query("SELECT r_regionkey, r_name FROM region WHERE r_regionkey IN (SELECT r_regionkey FROM region LIMIT 1 OFFSET 3)")
def get_value(spark, sf_dir):
    """Two cells by position."""
    f = Frame(source(spark, sf_dir, "region"))
    return Frame.from_list([[f.get_value("r_regionkey", 3)], [f.get_value(1, 3)]], ["r_regionkey", "r_name"]).sdf.select(F.col("r_regionkey").cast("int"), "r_name")


@query("SELECT CASE WHEN n_nationkey = 7 THEN 'seventh' ELSE n_name END AS n_name FROM nation WHERE n_nationkey IN (3, 7, 24)")
def column_edits(spark, sf_dir):
    """A column in memory with one value changed, and some of its rows."""
    nation = Frame(source(spark, sf_dir, "nation"))
    keys, names = list(nation.get_col("n_nationkey")), nation.get_col("n_name")
    names = names.with_value(keys.index(7), "seventh").take([keys.index(k) for k in (24, 7, 3)])
    return Frame.from_columns({"n_name": names}).sdf


# Beyond the verbs


@query("""SELECT c_custkey, n_name, o_orderkey FROM (SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey % 3 = 0)
    FULL JOIN (SELECT n_nationkey AS c_nationkey, n_name FROM nation WHERE n_regionkey < 2) USING (c_nationkey)
    LEFT JOIN (SELECT o_orderkey, o_custkey AS c_custkey FROM orders WHERE o_totalprice > 300000) USING (c_custkey)""")
def join_full(spark, sf_dir):
    t = lambda n: Frame(source(spark, sf_dir, n))
    customers = t("customer").keep(call(np.mod, c("c_custkey"), 3) == 0).select("c_custkey", "c_nationkey")
    nations = t("nation").keep(c("n_regionkey") < 2).select("n_nationkey", "n_name")
    orders = t("orders").keep(c("o_totalprice") > 300000).select("o_orderkey", "o_custkey")
    out = R.join(R.join(customers, nations, {"c_nationkey": "n_nationkey"}, "full"), orders, {"c_custkey": "o_custkey"}, "left")
    return out.select("c_custkey", "n_name", "o_orderkey").sdf


@query("SELECT n_name, s_name FROM (SELECT s_name, s_nationkey FROM supplier WHERE s_acctbal > 5000) RIGHT JOIN nation ON s_nationkey = n_nationkey")
def join_right(spark, sf_dir):
    rich = Frame(source(spark, sf_dir, "supplier")).keep(c("s_acctbal") > 5000).select("s_name", "s_nationkey")
    return R.join(rich, Frame(source(spark, sf_dir, "nation")), {"s_nationkey": "n_nationkey"}, "right").select("n_name", "s_name").sdf


@query("""SELECT c_custkey, true AS ordered FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')
    UNION ALL SELECT c_custkey, false FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""")
def join_semi_anti(spark, sf_dir):
    customers, orders = (Frame(source(spark, sf_dir, n)) for n in ("customer", "orders"))
    pending = orders.keep(c("o_orderstatus") == "P")
    with_, without = (R.join(customers, pending, {"c_custkey": "o_custkey"}, how).select("c_custkey") for how in ("semi", "anti"))
    return R.union(with_.derive(ordered=True), without.derive(ordered=False)).sdf


@query("""(SELECT DISTINCT 'both' AS of, s_nationkey AS nation FROM supplier INTERSECT SELECT 'both', c_nationkey FROM customer WHERE c_acctbal < 0)
    UNION ALL (SELECT 'rest', c_nationkey FROM customer EXCEPT SELECT 'rest', s_nationkey FROM supplier WHERE s_acctbal > 9000)""")
def row_sets(spark, sf_dir):
    t = lambda n, key: Frame(source(spark, sf_dir, n)).rename_col(key, "nation")
    suppliers, customers = t("supplier", "s_nationkey"), t("customer", "c_nationkey")
    both = R.intersect(R.distinct(suppliers.select("nation")), customers.keep(c("c_acctbal") < 0).select("nation"))
    rest = R.subtract(customers.select("nation"), suppliers.keep(c("s_acctbal") > 9000).select("nation"))
    return R.union(both.derive(of="both"), rest.derive(of="rest")).sdf


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 25")
def top_rows(spark, sf_dir):
    return R.top(Frame(source(spark, sf_dir, "orders")), 25, "o_totalprice", "o_orderkey").select("o_orderkey", "o_totalprice").sdf


@query("""SELECT l_returnflag, l_linestatus, count(l_quantity) AS n, max(l_quantity) AS top, CAST(grouping(l_returnflag, l_linestatus) AS BIGINT) AS level
    FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""")
def cube_subtotals(spark, sf_dir):
    return R.cube(Frame(source(spark, sf_dir, "lineitem")), ["l_returnflag", "l_linestatus"], n=("l_quantity", len), top=("l_quantity", max)).sdf


@query("""SELECT l_returnflag, l_linestatus, avg(l_quantity) AS mean, CAST(grouping(l_returnflag, l_linestatus) AS BIGINT) AS level
    FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""")
def rollup_subtotals(spark, sf_dir):
    return R.rollup(Frame(source(spark, sf_dir, "lineitem")), ["l_returnflag", "l_linestatus"], mean=("l_quantity", np.mean)).sdf


@query("SELECT n_regionkey, count(*) AS n FROM nation WHERE n_name > 'F' GROUP BY n_regionkey")
def sql_text(spark, sf_dir):
    return R.sql("SELECT n_regionkey, count(*) AS n FROM {nation} WHERE n_name > 'F' GROUP BY n_regionkey", nation=Frame(source(spark, sf_dir, "nation"))).sdf


# The analysis


@query(f"SELECT count(*) - count(price) AS price, count(*) - count(priority) AS priority, count(*) - count(cust) AS cust FROM {HOLES}")
def null_profile(spark, sf_dir):
    return K.null_counts(holes(source(spark, sf_dir, "orders")).select("price", "priority", "cust"))


@query(f"SELECT o_orderkey, CASE WHEN price IS NULL THEN 1 WHEN priority IS NULL THEN 2 WHEN cust IS NULL THEN 3 ELSE 0 END AS status FROM {HOLES}")
def cond_status(spark, sf_dir):
    d = holes(source(spark, sf_dir, "orders"))
    status = K.first_match((F.col("price").isNull(), 1), (F.col("priority").isNull(), 2), (K.any_null(d), 3), otherwise=0)
    return d.select("o_orderkey", status.alias("status"))


@query("""SELECT l_returnflag, l_linestatus, count(*) AS total, median(CASE WHEN l_quantity >= 15 THEN l_quantity END) AS mid,
    avg(CAST(l_quantity >= 15 AS INT)) AS large, avg(CAST(l_linenumber IN (1, 2) AS INT)) AS early FROM lineitem GROUP BY ALL""")
def route_summary(spark, sf_dir):
    q = F.col("l_quantity")
    return source(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("total"), F.median(K.filtered(q, q >= 15)).alias("mid"), K.share(q >= 15).alias("large"), K.share(F.col("l_linenumber").isin(1, 2)).alias("early")
    ).orderBy(F.desc_nulls_first("total"))


@query(f"""SELECT o_orderkey, price FROM {HOLES} WHERE ((priority IN ('1-URGENT') AND o_orderstatus IN ('O', 'F')) OR (priority IN ('2-HIGH') AND o_orderstatus IN ('P')))
    AND (price > 300000 OR cust > 700)""")
def is_in_filter(spark, sf_dir):
    d = holes(source(spark, sf_dir, "orders"))
    a = F.col("priority").isin("1-URGENT") & F.col("o_orderstatus").isin("O", "F") | F.col("priority").isin("2-HIGH") & F.col("o_orderstatus").isin("P")
    return d.where(a).where((F.col("price") > 300000) | (F.col("cust") > 700)).select("o_orderkey", "price").orderBy(F.desc_nulls_first("price"))


@query("SELECT l_orderkey, l_linenumber, l_quantity >= 40 AND l_discount < 0.03 AS flag FROM lineitem")
def bool_flag(spark, sf_dir):
    return source(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", ((F.col("l_quantity") >= 40) & (F.col("l_discount") < 0.03)).alias("flag"))


@query(f"""SELECT o_orderkey, CASE WHEN price IS NULL THEN NULL WHEN price < 100000 THEN 'none' WHEN price < 200000 THEN 'minor' ELSE 'major' END AS severity,
    CASE WHEN price IS NULL THEN NULL WHEN price < 100000 THEN 1 WHEN price < 200000 THEN 2 ELSE 3 END AS rank FROM {HOLES}""")
def cond_severity(spark, sf_dir):
    p = F.col("price")
    kind = K.first_match((p.isNull(), F.lit(None).cast("string")), (p < 100000, "none"), (p < 200000, "minor"), otherwise="major")
    d = holes(source(spark, sf_dir, "orders")).select("o_orderkey", kind.alias("severity"))
    strict, rank = K.ordered_category(F.col("severity"), ["none", "minor", "major"])
    return d.select("o_orderkey", strict.alias("severity"), rank.cast("int").alias("rank"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_discount > 0 THEN l_extendedprice / l_discount * 60 END AS speed FROM lineitem")
def guarded_ratio(spark, sf_dir):
    return source(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_discount") > 0, F.col("l_extendedprice") / F.col("l_discount") * 60).alias("speed"))


@query("SELECT o_orderpriority, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY o_orderpriority")
def mean_by_key(spark, sf_dir):
    return source(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.round(F.avg("o_totalprice"), 4).alias("mean")).orderBy(F.desc_nulls_first("mean"))


@query("SELECT p_brand, p_type, p_size, count(*) AS n, avg(l_quantity) AS q FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL")
def join_inner(spark, sf_dir):
    parts = source(spark, sf_dir, "part").withColumnRenamed("p_partkey", "l_partkey")
    return source(spark, sf_dir, "lineitem").join(parts, "l_partkey").groupBy("p_brand", "p_type", "p_size").agg(F.count("*").alias("n"), F.avg("l_quantity").alias("q"))


@query("SELECT CAST(month(o_orderdate) AS INT) AS month, o_orderstatus, count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY ALL")
def monthly(spark, sf_dir):
    return source(spark, sf_dir, "orders").groupBy(F.month("o_orderdate").alias("month"), "o_orderstatus").agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean")).orderBy(F.desc_nulls_first("n"))


@query("SELECT s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def join_names(spark, sf_dir):
    nations = source(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "s_nationkey")
    return source(spark, sf_dir, "supplier").join(nations, "s_nationkey").select("s_name", "n_name")


@query("""SELECT l_orderkey, l_linenumber, cn.n_name AS buyer, sn.n_name AS seller FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN supplier ON l_suppkey = s_suppkey
    LEFT JOIN nation cn ON c_nationkey = cn.n_nationkey AND cn.n_regionkey < 3 LEFT JOIN nation sn ON s_nationkey = sn.n_nationkey AND sn.n_regionkey < 3""")
def join_role_play(spark, sf_dir):
    t = lambda n: source(spark, sf_dir, n)
    nations = t("nation").where("n_regionkey < 3").select("n_nationkey", "n_name")
    d = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    d = K.left_lookup(d, t("customer"), "o_custkey", "c_custkey")
    d = K.left_lookup(d, t("supplier"), "l_suppkey", "s_suppkey")
    d = K.left_lookup(d, nations.select(F.col("n_nationkey").alias("k1"), F.col("n_name").alias("buyer")), "c_nationkey", "k1")
    d = K.left_lookup(d, nations.select(F.col("n_nationkey").alias("k2"), F.col("n_name").alias("seller")), "s_nationkey", "k2")
    return d.select("l_orderkey", "l_linenumber", "buyer", "seller")


_FIVE = "l_returnflag, l_linestatus, l_linenumber, l_shipmonth, l_suppkey"


@query(f"""WITH l AS (SELECT *, month(l_shipdate) AS l_shipmonth FROM lineitem),
    w AS (SELECT {_FIVE}, max(l_quantity) AS top FROM l WHERE l_quantity > 30 GROUP BY ALL)
    SELECT l_orderkey, l_linenumber, top FROM l LEFT JOIN w USING ({_FIVE})""")
def join_left_composite(spark, sf_dir):
    keys = _FIVE.split(", ")
    d = source(spark, sf_dir, "lineitem").withColumn("l_shipmonth", F.month("l_shipdate"))
    w = d.where("l_quantity > 30").groupBy(*keys).agg(F.max("l_quantity").alias("top"))
    return d.join(w, keys, "left").select("l_orderkey", "l_linenumber", "top")


@query("SELECT l_returnflag, avg(CASE WHEN l_linestatus = 'F' THEN l_quantity END) AS F, avg(CASE WHEN l_linestatus = 'O' THEN l_quantity END) AS O FROM lineitem GROUP BY l_returnflag")
def pivot_mean(spark, sf_dir):
    return K.pivot_mean(source(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus", "l_quantity", ["F", "O"])


_Q = "(SELECT {v} FROM (SELECT {v}, row_number() OVER (ORDER BY {v}) - 1 AS r, count(*) OVER () AS n FROM {t} WHERE {w}) WHERE r = floor((n - 1) * {q} + 0.5))"


@query(f"""SELECT p_partkey, coalesce(p_size >= {_Q.format(v='p_size', t='part', w='p_size > 5', q=0.9)}, false) AS big,
    coalesce(p_retailprice >= {_Q.format(v='p_retailprice', t='part', w='true', q=0.95)}, false) AS dear,
    coalesce(p_size <= {_Q.format(v='p_size', t='part', w='true', q=0.05)}, false) AS small FROM part""")
def quantile_flag(spark, sf_dir):
    d = source(spark, sf_dir, "part")
    big, dear, low = K.nearest_quantiles(d, [("p_size", 0.9, F.col("p_size") > 5), ("p_retailprice", 0.95, None), ("p_size", 0.05, None)])
    flags = {"big": F.col("p_size") >= big, "dear": F.col("p_retailprice") >= dear, "small": F.col("p_size") <= low}
    return d.select("p_partkey", *[F.coalesce(v, F.lit(False)).alias(k) for k, v in flags.items()])


@query(f"""WITH w AS (SELECT n_nationkey, n_regionkey IN (0, 1) AS rough, CASE WHEN n_nationkey % 3 > 0 THEN n_nationkey % 2 = 0 END AS gust FROM nation)
    SELECT CAST(month(o_orderdate) AS INT) AS month, count(*) AS n, avg(CAST(price IS NULL AS INT)) AS gone, avg(CAST(coalesce(price >= 200000, true) AS INT)) AS bad,
    avg(CASE WHEN rough THEN CAST(coalesce(price >= 200000, true) AS INT) END) AS bad_rough, avg(CASE WHEN gust THEN CAST(coalesce(price >= 200000, true) AS INT) END) AS bad_gust,
    CAST(coalesce(sum(CAST(rough AS INT)), 0) AS BIGINT) AS n_rough, CAST(coalesce(sum(CAST(gust AS INT)), 0) AS BIGINT) AS n_gust
    FROM (SELECT h.*, o_orderdate, o_custkey FROM {HOLES} h JOIN orders USING (o_orderkey)) LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN w ON c_nationkey = n_nationkey
    WHERE c_acctbal < 5000 GROUP BY 1""")
def west_by_month(spark, sf_dir):
    t = lambda n: source(spark, sf_dir, n)
    n = F.col("n_nationkey")
    weather = t("nation").select("n_nationkey", F.col("n_regionkey").isin(0, 1).alias("rough"), F.when(n % 3 > 0, n % 2 == 0).alias("gust"))
    d = t("orders").withColumn("price", F.when(F.col("o_totalprice") >= 50000, F.col("o_totalprice")))
    d = K.left_lookup(d, t("customer"), "o_custkey", "c_custkey").where("c_acctbal < 5000")
    d = K.left_lookup(d, weather, "c_nationkey", "n_nationkey")
    bad = F.coalesce(F.col("price") >= 200000, F.lit(True))
    total = lambda x: F.coalesce(F.sum(F.col(x).cast("long")), F.lit(0).cast("long"))
    return d.groupBy(F.month("o_orderdate").alias("month")).agg(
        F.count("*").alias("n"), K.share(F.col("price").isNull()).alias("gone"), K.share(bad).alias("bad"), K.share(K.filtered(bad, F.col("rough"))).alias("bad_rough"),
        K.share(K.filtered(bad, F.col("gust"))).alias("bad_gust"), total("rough").alias("n_rough"), total("gust").alias("n_gust"),
    ).orderBy("month")


@query("SELECT o_orderkey, coalesce(price, 0) AS price, coalesce(priority, 'none') AS priority FROM " + HOLES)
def fill_null(spark, sf_dir):
    return holes(source(spark, sf_dir, "orders")).select("o_orderkey", F.coalesce("price", F.lit(0.0)).alias("price"), F.coalesce("priority", F.lit("none")).alias("priority"))


@query(f"SELECT o_orderkey, price FROM {HOLES} ORDER BY price DESC NULLS FIRST")
def sort_desc_nulls_first(spark, sf_dir):
    return holes(source(spark, sf_dir, "orders")).select("o_orderkey", "price").orderBy(F.desc_nulls_first("price"))


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events WHERE value > 10 GROUP BY ALL")
def windowed_events(spark, sf_dir):
    """The batch form of the streaming window."""
    kept = keep(c("value") > 10).execute(Frame(source(spark, sf_dir, "events")))
    out = windowed(kept, "ts", "1 day", "1 hour", ("event_type",))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue and quantities by return flag and line status."""
    p = (
        derive(revenue=c("l_extendedprice") * (1 - c("l_discount")))
        >> groupBy("l_returnflag", "l_linestatus")
        >> aggregate(n=("l_orderkey", len), quantity=("l_quantity", sum), revenue=("revenue", sum), mean=("l_quantity", np.mean))
    )
    return (Frame(source(spark, sf_dir, "lineitem")) >> p).execute().sdf


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS quantity, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, avg(l_quantity) AS mean FROM lineitem GROUP BY ALL")
def pricing_summary(spark, sf_dir):
    return flagship(spark, sf_dir).withColumn("revenue", F.round("revenue", 2))
