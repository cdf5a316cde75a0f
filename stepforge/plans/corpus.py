"""A corpus of worked solutions and candidate answers derived from orders and their lines.

Every order becomes a solution that adds up its quantities step by step; candidates vary it by simple rules of id and
candidate number. The same text can be built in SQL (see SQL below), which the checks against another engine use.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stepforge.session import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text(x) -> F.Column:
    return x.cast("string")


def solutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, op (2..20), solution, ans and the number of steps."""
    ship(spark)
    order = Window.partitionBy("k").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", F.col("l_quantity").cast("long").alias("q"))
    lines = lines.select("k", "q", F.row_number().over(order).alias("i"), F.sum("q").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("t"))
    v = lambda x: F.concat(F.lit("v"), text(x))
    i, t, q = F.col("i"), F.col("t"), F.col("q")
    sum_ = F.when(i == 1, text(q)).otherwise(F.concat(v(i - 1), F.lit(" + "), text(q), F.lit(" = "), text(t - q), F.lit(" + "), text(q), F.lit(" = "), text(t)))
    step = F.concat(F.lit("Define total after line "), text(i), F.lit(" as "), v(i), F.lit("; so "), v(i), F.lit(" = "), sum_, F.lit("."))
    grouped = lines.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("i", step.alias("st")))).alias("steps"), F.max("t").alias("ans"))
    joined = F.array_join(F.transform("steps", lambda x: x["st"]), " ")
    return grouped.select(F.col("k").alias("id"), (2 + F.col("k") % 19).alias("op"), F.concat(F.lit("We read the order. "), joined, F.lit(" Answer: "), text(F.col("ans"))).alias("solution"), "ans", F.size("steps").cast("long").alias("n"))


def problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """solutions with problem and question texts; every third id has no question."""
    s = solutions(spark, sf_dir)
    return s.select("id", "op", F.concat(F.lit("  Order "), text(F.col("id")), F.lit(" has\n"), text(F.col("n")), F.lit(" lines. ")).alias("problem"), F.when(F.col("id") % 3 != 0, F.lit(" What is\tthe total? ")).alias("question"), "solution", "ans")


def candidates(spark: SparkSession, sf_dir: str, k: int = 4) -> DataFrame:
    """id, op, j (0..k-1), solution and txt of k candidates a solution."""
    s = solutions(spark, sf_dir).select("id", "op", "ans", "solution", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("j"))
    offset = (F.col("id") * 31 + F.col("j") * 17) % 5
    answer = F.concat(F.lit("Answer: "), text(F.col("ans") + offset))
    changed = F.replace(F.col("solution"), F.concat(F.lit("Answer: "), text(F.col("ans"))), answer)
    kind = (F.col("id") + 3 * F.col("j")) % 4
    txt = F.when(kind == 1, F.replace(changed, F.lit("Define total after line 2 as v2; "), F.lit(""))).when(kind == 2, F.replace(changed, F.lit(" + "), F.lit(" - "))).when(kind == 3, answer).otherwise(changed)
    return s.select("id", "op", F.col("j").cast("long").alias("j"), "solution", txt.alias("txt"))


def _sql(k: int) -> str:
    return f"""
ln as (select l_orderkey k, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) i,
              cast(l_quantity as bigint) q from lineitem),
cum as (select k, i, q, cast(sum(q) over (partition by k order by i rows between unbounded preceding and current row) as bigint) t from ln),
step as (select k, i, t, concat('Define total after line ', i, ' as v', i, '; so v', i, ' = ',
           case when i = 1 then cast(q as varchar) else concat('v', i - 1, ' + ', q, ' = ', t - q, ' + ', q, ' = ', t) end, '.') st from cum),
sol as (select k id, 2 + k % 19 op, concat('We read the order. ', string_agg(st, ' ' order by i), ' Answer: ', max(t)) solution, max(t) ans, count(*) n
        from step group by k),
prob as (select id, op, concat('  Order ', id, ' has', chr(10), n, ' lines. ') problem,
                case when id % 3 <> 0 then concat(' What is', chr(9), 'the total? ') end question, solution, ans from sol),
c0 as (select id, op, ans, solution, j, replace(solution, concat('Answer: ', ans), concat('Answer: ', ans + (id * 31 + j * 17) % 5)) t0
       from sol cross join (select unnest(range(0, {k})) j) jj),
cand as (select id, op, j, solution,
                case (id + 3 * j) % 4 when 1 then replace(t0, 'Define total after line 2 as v2; ', '') when 2 then replace(t0, ' + ', ' - ')
                  when 3 then concat('Answer: ', ans + (id * 31 + j * 17) % 5) else t0 end txt from c0)"""


#: The same corpus as common table expressions: ln, cum, step, sol, prob, cand.
SQL = _sql(4)
