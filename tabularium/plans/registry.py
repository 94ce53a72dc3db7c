"""The registered queries and their SQL: every operator on the given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabularium.operators import aggregates as A
from tabularium.operators import bootstrap as B
from tabularium.operators import combine as J
from tabularium.operators import cube as U
from tabularium.operators import entities as E
from tabularium.operators import findings as K
from tabularium.operators import inference as I
from tabularium.operators import quality as Q
from tabularium.operators import relations as R
from tabularium.operators import series as S
from tabularium.operators import text as X
from tabularium.plans import report
from tabularium.sources.tables import flatten, read_table, write_table

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles to a few digits: sums differ in the last bits from one engine, and one run, to another. -0.0 becomes 0.0."""
    return df.select(*((F.round(F.col(f"`{f.name}`"), digits) + F.lit(0.0)).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`") for f in df.schema))


def query(sql: str | None = None, digits: int = 4):
    """Registers a query under its function's name."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        _QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(spark, sf_dir), digits)
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet", "parquet")


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with brand and type, revenue, cost and a profit of both signs."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_retailprice")
    items = table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    out = items.withColumn("revenue", F.col("l_extendedprice") * (1 - F.col("l_discount"))).withColumn("cost", F.col("l_quantity") * F.col("p_retailprice"))
    return out.withColumn("profit", F.col("revenue") - F.col("cost")).drop("p_partkey")


SALES = """sales as (select l.*, p_brand, p_type, p_retailprice, l_extendedprice * (1 - l_discount) as revenue, l_quantity * p_retailprice as cost,
  l_extendedprice * (1 - l_discount) - l_quantity * p_retailprice as profit from lineitem l join part on l_partkey = p_partkey)"""
MAPPING = {"date": "l_shipdate", "revenue": "revenue", "profit": "profit", "quantity": "l_quantity", "customer": "l_suppkey"}


def orders_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with their order's priority and customer's segment."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return table(spark, sf_dir, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).withColumn("revenue", F.col("l_extendedprice") * (1 - F.col("l_discount")))


def monthly_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.trend(table(spark, sf_dir, "orders"), "o_orderdate", "o_totalprice")


MONTHLY = "series as (select strftime(o_orderdate, '%Y-%m') as month, sum(o_totalprice) as value from orders group by 1)"

# sources


@query("select l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_returnflag from lineitem")
def read_parquet(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag")


@query("""select o_orderkey, cast(o_totalprice as double) as price, cast(case when o_orderkey % 20 = 0 then null else o_custkey end as double) as cust, o_orderpriority as priority from orders""")
def coerce_numeric(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").cast("string").alias("price"), F.when(F.col("o_orderkey") % 20 == 0, "n/a").otherwise(F.col("o_custkey").cast("string")).alias("cust"), F.col("o_orderpriority").alias("priority"))
    return Q.coerce_numeric(o)


@query(f"""with {SALES} select l_orderkey, l_linenumber, l_shipdate, round(revenue, 4) as revenue, round(cost, 4) as cost, l_discount * 100 / 100.0 as pct, round(revenue - cost, 4) as _derived_profit from sales""")
def prepare(spark, d):
    s = sales(spark, d).select("l_orderkey", "l_linenumber", F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss").alias("l_shipdate"), F.col("revenue").cast("string").alias("revenue"), "cost", (F.col("l_discount") * 100).alias("pct"))
    return Q.prepare(s, {"date": "l_shipdate", "revenue": "revenue", "cost": "cost", "discount": "pct"})[0].withColumn("l_shipdate", F.col("l_shipdate").cast("timestamp_ntz"))


def _round_trip(spark: SparkSession, df: DataFrame, fmt: str) -> DataFrame:
    """df written in a format to the warehouse, which all executors share, and read again."""
    path = f"{spark.conf.get('spark.sql.warehouse.dir')}/tabularium-{uuid.uuid4().hex}.{fmt}"
    write_table(df, path, fmt)
    return read_table(spark, path, fmt)


@query("select s_suppkey, s_name, s_nationkey, round(s_acctbal, 4) as s_acctbal from supplier")
def csv_round_trip(spark, d):
    return _round_trip(spark, table(spark, d, "supplier"), "csv")


@query("select s_suppkey, s_name, s_nationkey, round(s_acctbal, 4) as s_acctbal from supplier")
def tsv_round_trip(spark, d):
    return _round_trip(spark, table(spark, d, "supplier"), "tsv")


@query("""select s_suppkey as key, s_name as "who.name", s_nationkey as "who.nation" from supplier""")
def json_round_trip(spark, d):
    nested = table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.struct(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation")).alias("who"))
    path = f"{spark.conf.get('spark.sql.warehouse.dir')}/tabularium-{uuid.uuid4().hex}.json"
    write_table(nested, path, "json")
    return flatten(spark.read.json(path))


@query("""select 'halves' as name, 1.0::double as jaccard from orders limit 1""")
def match_snapshot(spark, d):
    o = table(spark, d, "orders")
    old = J.snapshot(o, ["o_totalprice"]).select(F.lit("halves").alias("name"), "columns").unionByName(J.snapshot(o.withColumn("extra", F.lit(1)), ["o_totalprice"]).select(F.lit("wider").alias("name"), "columns"))
    return J.match_snapshot(old, o.columns)


# profiling and quality


@query("""select 'o_orderkey' as "column", 'bigint' as type, count(*) as rows, count(o_orderkey) as non_null, count(distinct o_orderkey) as "distinct", min(o_orderkey)::double as min, max(o_orderkey)::double as max, null::double as avg_length, true as all_integer, round((count(distinct o_orderkey) - 1) / (max(o_orderkey) - min(o_orderkey))::double, 4) as sequential, null::double as date_rate from orders
union all select 'o_custkey', 'bigint', count(*), count(o_custkey), count(distinct o_custkey), min(o_custkey), max(o_custkey), null, true, round((count(distinct o_custkey) - 1) / (max(o_custkey) - min(o_custkey))::double, 4), null from orders
union all select 'o_orderstatus', 'string', count(*), count(o_orderstatus), count(distinct o_orderstatus), null, null, round(avg(length(o_orderstatus)), 4), false, null, null from orders
union all select 'o_totalprice', 'double', count(*), count(o_totalprice), count(distinct o_totalprice), round(min(o_totalprice), 4), round(max(o_totalprice), 4), null, false, null, null from orders
union all select 'o_orderdate', 'timestamp_ntz', count(*), count(o_orderdate), count(distinct o_orderdate), null, null, null, false, null, null from orders
union all select 'o_orderpriority', 'string', count(*), count(o_orderpriority), count(distinct o_orderpriority), null, null, round(avg(length(o_orderpriority)), 4), false, null, 0.0 from orders""")
def column_profile(spark, d):
    return Q.profile_columns(table(spark, d, "orders"))


@query("""with t as (select count(*) as rows, count(case when event_id % 20 = 0 then value end) as a, count(case when event_id % 2 = 0 then value end) as b from events)
select 'event_id' as "column", rows as non_null, rows, true as usable from t union all select 'rare', a, rows, a >= 5 and a >= 0.1 * rows from t union all select 'often', b, rows, b >= 5 and b >= 0.1 * rows from t""")
def usable_columns(spark, d):
    e = table(spark, d, "events")
    return Q.usable_columns(e.select("event_id", F.when(F.col("event_id") % 20 == 0, F.col("value")).alias("rare"), F.when(F.col("event_id") % 2 == 0, F.col("value")).alias("often")))


#: The keyword and domain tables as SQL rows.
KEYWORD_ROWS = ", ".join(f"({i}, '{role}', '{w}', '{Q.normal_name(w)}')" for i, (role, w) in enumerate((role, w) for role, words in Q.ROLE_KEYWORDS.items() for w in words))
DOMAIN_ROWS = ", ".join(f"({i}, '{domain}', '{role}', {w})" for i, (domain, roles) in enumerate(Q.DOMAINS.items()) for role, w in roles.items())
HINT_ROWS = ", ".join(f"('{role}', '{Q.normal_name(w)}', {i})" for i, (role, w) in enumerate((role, w) for role, words in Q.HINTS.items() for w in words))
BY_NAME = f"""keywords(place, role, keyword, norm) as (values {KEYWORD_ROWS}),
named as (select c, role, keyword from (select c, k.role, k.keyword, row_number() over (partition by c order by (n = k.norm) desc, length(k.norm) desc, place) as r from cols join keywords k on contains(n, k.norm)) where r = 1)"""
NORMAL = "trim(regexp_replace(lower(c), '[^a-z0-9]+', ' ', 'g'))"
SALES_COLS = f"""cols as (select c, {NORMAL} as n from (select column_name as c from (describe lineitem) union all select * from (values ('p_brand'), ('p_type'), ('p_retailprice'), ('revenue'), ('cost'), ('profit')) v(c)))"""
# what the data say of text columns that no keyword names
TEXT_SHARES = """shares as (select 'l_returnflag' as c, count(distinct l_returnflag) as d, count(*) as n from sales union all select 'l_linestatus', count(distinct l_linestatus), count(*) from sales union all select 'p_brand', count(distinct p_brand), count(*) from sales union all select 'p_type', count(distinct p_type), count(*) from sales)"""
BY_SHARE = "case when d < 0.5 * n then 'CATEGORY' when d > 0.8 * n then 'IDENTIFIER' else 'TEXT' end"


@query(f"""with cols as (select c, {NORMAL} as n from (select column_name as c from (describe orders))), {BY_NAME}, p as (select count(distinct o_orderpriority) as d, count(*) as n from orders)
select c as "column", case when c = 'o_orderstatus' then 'CATEGORY' when role is not null then role else (select {BY_SHARE} from p) end as role, case when c = 'o_orderstatus' then 'manual' when role is not null then 'name' else 'inferred' end as confidence, case when c <> 'o_orderstatus' then keyword end as matched_keyword
from cols left join named using (c)""")
def classify_roles(spark, d):
    return Q.classify_roles(table(spark, d, "orders"), overrides={"o_orderstatus": "CATEGORY"})


@query(f"""with {SALES}, {SALES_COLS}, {TEXT_SHARES}, hints(role, hint, place) as (values {HINT_ROWS}),
hit as (select role, c, n = hint as same, row_number() over (partition by role order by (n = hint) desc, length(hint) desc, place) as r from cols join hints on contains(n, hint)),
taken as (select role, c as "column", case when same then 'exact' else 'substring' end as how from hit where r = 1),
cats as (select c, row_number() over (order by c = 'l_returnflag' desc, c) as r from shares where d < 0.5 * n)
select * from taken union all select 'category', c, 'inferred' from cats where r = 1 union all select 'other', c, 'leftover' from cats where r > 1""")
def detect_columns(spark, d):
    return Q.detect_columns(sales(spark, d))


DOMAIN_SCORES = f"""domains(place, domain, role, weight) as (values {DOMAIN_ROWS}), scores as (select domain, place, sum(weight)::bigint as score from named join domains using (role) group by 1, 2)"""


@query(f"""with {SALES_COLS}, {BY_NAME}, {DOMAIN_SCORES} select domain, score, round(score / (select sum(score) from scores), 2) as confidence, row_number() over (order by score desc, place) = 1 and score >= 3 as chosen from scores""")
def score_domains(spark, d):
    return Q.score_domains(Q.classify_roles(sales(spark, d)))


MEASURE_ROWS = ", ".join(f"({i}, '{role}', '{how}')" for i, (role, how) in enumerate(Q.MEASURES.items()))


@query(f"""with {SALES}, {SALES_COLS}, {BY_NAME}, {DOMAIN_SCORES}, {TEXT_SHARES}, m(place, role, how) as (values {MEASURE_ROWS})
select 'measure' as kind, c as subject, coalesce(how, 'sum') as aggregation, null::bigint as n from named left join m using (role) where c not in (select c from shares) and role not in ('IDENTIFIER', 'DATE')
union all select 'measure', c, 'sum', null from cols where c in ('l_linenumber', 'l_tax') and c not in (select c from named)
union all select 'dimension', c, null, d from shares where d < 0.5 * n and c not in (select c from named)
union all select 'dimension', c, null, d from named join shares using (c) where role in ('CATEGORY', 'LOCATION')
union all select 'date', c, null, null from named where role = 'DATE' union all select 'domain', (select domain from scores where score >= 3 order by score desc, place limit 1), null, (select count(*) from sales)""")
def dataset_profile(spark, d):
    p = Q.understand(sales(spark, d))
    rows = [("measure", c, how, None) for c, how in p.measures] + [("dimension", c, None, n) for c, n, _ in p.dimensions] + [("date", p.date, None, None), ("domain", p.domain, None, p.rows)]
    return spark.createDataFrame(rows, "kind string, subject string, aggregation string, n long")


HOLES = "select o_orderkey, case when o_orderkey % 7 = 0 then null else o_totalprice end as a, case when o_orderkey % 3 = 0 then null else o_orderpriority end as b from orders"


def _holes(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).alias("a"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")).alias("b"))


@query(f"""with t as ({HOLES}) select 'a' as "column", round(100.0 * avg((a is null)::int), 4) as missing_pct from t union all select 'b', round(100.0 * avg((b is null)::int), 4) from t""")
def missing_by_column(spark, d):
    return Q.missing_by_column(_holes(spark, d))


@query("""with g as (select count(*) as n from events group by user_id, event_type) select sum(n)::bigint as rows, sum(n - 1)::bigint as duplicate_rows, round(100.0 * sum(n - 1) / sum(n), 4) as duplicate_pct from g""")
def duplicate_stats(spark, d):
    return Q.duplicate_stats(table(spark, d, "events").select("user_id", "event_type"))


@query("""select 'k' as "column", min('x') as value from orders""")
def constant_columns(spark, d):
    return Q.constant_columns(table(spark, d, "orders").withColumn("k", F.lit("x")))


@query("""select 'c_name' as "column", count(distinct c_name) as "distinct", count(*) as rows from customer""")
def high_cardinality(spark, d):
    return Q.high_cardinality_columns(table(spark, d, "customer"))


@query("""with q as (select quantile_cont(value, 0.25) as a, quantile_cont(value, 0.75) as b from events)
select 'value' as "column", count(*) filter (where value < a - 1.5 * (b - a) or value > b + 1.5 * (b - a)) as outliers, round(100.0 * count(*) filter (where value < a - 1.5 * (b - a) or value > b + 1.5 * (b - a)) / count(value), 4) as outlier_pct from events, q having count(*) filter (where value < a - 1.5 * (b - a) or value > b + 1.5 * (b - a)) > 0""")
def outlier_summary(spark, d):
    return Q.outlier_summary(table(spark, d, "events"), ["value"])


@query(f"""with t as ({HOLES}), m as (select (avg((o_orderkey is null)::int) + avg((a is null)::int) + avg((b is null)::int)) / 3 as m from t),
dup as (select round(100.0 * sum(n - 1) / sum(n), 2) as p from (select count(*) as n from t group by o_orderkey, a, b))
select round(100 * m, 4) as missing_pct, p as duplicate_pct, 0::bigint as constant_columns, 3 as columns, round(greatest(100 - 40 * m - 20 * p / 100, 0), 1) as score from m, dup""")
def quality_score(spark, d):
    return Q.quality_score(_holes(spark, d))


CLEAN = """pts as (select distinct l_orderkey, l_linenumber, l_quantity, l_extendedprice from lineitem),
mo as (select avg(l_quantity) as mx, avg(l_extendedprice) as my, var_samp(l_quantity) as sxx, var_samp(l_extendedprice) as syy, covar_samp(l_quantity, l_extendedprice) as sxy from pts),
dist as (select pts.*, (syy * (l_quantity - mx) ** 2 - 2 * sxy * (l_quantity - mx) * (l_extendedprice - my) + sxx * (l_extendedprice - my) ** 2) / (sxx * syy - sxy * sxy) as d2 from pts, mo)"""


@query(f"with {CLEAN} select l_orderkey, l_linenumber, l_quantity, round(l_extendedprice, 4) as l_extendedprice, d2 > 9.210340371976184 as flagged_as_unusual from dist")
def clean_table(spark, d):
    t = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    return Q.clean_table(t.unionByName(t.where("l_linenumber = 1")), ["l_quantity", "l_extendedprice"])


# filters and aggregates


@query("select strftime(l_shipdate, '%Y-%m-%d') as l_shipdate, l_returnflag, l_quantity from lineitem")
def analysis_slice(spark, d):
    return A.analysis_slice(table(spark, d, "lineitem"), "l_shipdate", ["l_returnflag"], ["l_quantity"])


@query("select l_orderkey, l_linenumber, l_returnflag from lineitem where l_shipdate >= timestamp '1996-03-01' and l_shipdate < timestamp '1997-04-01' and l_returnflag in ('A', 'R')")
def filter_rows(spark, d):
    return A.filter_rows(table(spark, d, "lineitem"), "l_shipdate", "1996-03-01", "1997-03-31", {"l_returnflag": ["A", "R"], "l_linestatus": []}).select("l_orderkey", "l_linenumber", "l_returnflag")


@query("select o_orderpriority as level, count(*) as rows from orders group by 1")
def level_counts(spark, d):
    return A.level_counts(table(spark, d, "orders"), "o_orderpriority")


@query("select strftime(min(o_orderdate), '%Y-%m-%d') as first_day, strftime(max(o_orderdate), '%Y-%m-%d') as last_day from orders")
def date_range(spark, d):
    return A.date_range(table(spark, d, "orders"), "o_orderdate")


@query("select l_shipmode_like as label, round(sum(l_extendedprice), 4) as value from (select l_returnflag as l_shipmode_like, l_extendedprice from lineitem) group by 1 order by 2 desc limit 15")
def ad_hoc(spark, d):
    return A.ad_hoc(table(spark, d, "lineitem"), "sum", "l_extendedprice", "l_returnflag")


@query("select strftime(o_orderdate, '%Y-%m') as month, round(sum(o_totalprice), 4) as value from orders group by 1")
def trend(spark, d):
    return monthly_orders(spark, d)


@query("""with s as (select min(o_totalprice) as a, max(o_totalprice) as b from orders), g as (select range as bin from range(10)),
c as (select least(floor((o_totalprice - a) / ((b - a) / 10.0)), 9)::int as bin, count(*) as n from orders, s group by 1)
select g.bin::int as bin, round(a + g.bin * ((b - a) / 10.0), 4) as low, round(a + (g.bin + 1) * ((b - a) / 10.0), 4) as high, coalesce(n, 0) as n from g cross join s left join c on g.bin = c.bin""")
def histogram(spark, d):
    return A.histogram(table(spark, d, "orders"), "o_totalprice")


@query("select p_brand as label, count(*) as rows from part group by 1 order by 2 desc, 1 limit 15")
def distribution_count(spark, d):
    return A.distribution_count(table(spark, d, "part"), "p_brand")


@query("select p_type as label, round(avg(p_retailprice), 4) as value from part group by 1 order by 2 desc, 1 limit 15")
def distribution_avg(spark, d):
    return A.distribution_sum(table(spark, d, "part"), "p_type", "p_retailprice", "avg")


@query(f"""with {SALES}, a as (select p_brand from sales group by 1 order by count(*) desc, 1 limit 8), b as (select p_type from sales group by 1 order by count(*) desc, 1 limit 8),
c as (select p_brand, p_type, sum(revenue) as v from sales group by 1, 2) select a.p_brand as dim1, b.p_type as dim2, round(v, 2) as value from a cross join b left join c on c.p_brand = a.p_brand and c.p_type = b.p_type""", 2)
def pivot(spark, d):
    return A.pivot(sales(spark, d), "p_brand", "p_type", "revenue")


@query()
def scatter(spark, d):
    return A.scatter(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice", "l_returnflag")


@query("select count(*) as n, round(corr(p_partkey, p_retailprice), 4) as r, case when abs(corr(p_partkey, p_retailprice)) >= 0.7 then 'strong' when abs(corr(p_partkey, p_retailprice)) >= 0.4 then 'moderate' when abs(corr(p_partkey, p_retailprice)) >= 0.15 then 'weak' else 'none' end as strength from part")
def scatter_correlation(spark, d):
    return A.correlation(table(spark, d, "part"), "p_partkey", "p_retailprice")


@query(f"""with {SALES}, r as (select corr(l_quantity, revenue) as a, corr(l_quantity, profit) as b, corr(revenue, profit) as c from sales)
select col1, col2, round(r, 4) as r from (select 'l_quantity' as col1, 'l_quantity' as col2, 1.0 as r union all select 'revenue', 'revenue', 1.0 union all select 'profit', 'profit', 1.0
union all select 'l_quantity', 'revenue', a from r union all select 'revenue', 'l_quantity', a from r union all select 'l_quantity', 'profit', b from r union all select 'profit', 'l_quantity', b from r union all select 'revenue', 'profit', c from r union all select 'profit', 'revenue', c from r)""")
def correlation_matrix(spark, d):
    return A.correlation_matrix(sales(spark, d), ["l_quantity", "revenue", "profit"])


@query("""with q as (select count(value) as n, min(value) as mi, quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.5) as med, quantile_cont(value, 0.75) as q3, max(value) as ma from events),
f as (select *, greatest(mi, q1 - 1.5 * (q3 - q1)) as low, least(ma, q3 + 1.5 * (q3 - q1)) as high from q)
select n, round(mi, 4) as min, round(q1, 4) as q1, round(med, 4) as median, round(q3, 4) as q3, round(ma, 4) as max, round(low, 4) as low, round(high, 4) as high, (select count(*) from events where value < low or value > high) as outliers from f""")
def boxplot(spark, d):
    return A.boxplot(table(spark, d, "events"), "value").drop("examples")


@query(f"""with {SALES}, c as (select l_suppkey, sum(revenue) as r from sales group by 1)
select round(sum(revenue), 2) as total_revenue, round(sum(profit), 2) as total_profit, count(*) as order_count, round(avg(revenue), 2) as avg_order_value, round(sum(l_quantity), 2) as total_units, strftime(min(l_shipdate), '%Y-%m-%d') as first_day, strftime(max(l_shipdate), '%Y-%m-%d') as last_day,
100.0::double as completeness_pct, round(sum(profit) * 100 / sum(revenue), 2) as margin_pct, 17 as column_count, (select count(*) from c) as unique_customers, round((select avg(r) from c), 2) as revenue_per_customer from sales""", 2)
def kpis(spark, d):
    return A.kpis(sales(spark, d), MAPPING)


@query(f"with {SALES} select strftime(l_shipdate, '%Y-%m') as month, round(sum(revenue), 2) as revenue, round(sum(profit), 2) as profit from sales group by 1", 2)
def monthly_revenue(spark, d):
    return A.monthly_revenue(sales(spark, d), MAPPING)


@query(f"with {SALES} select p_brand as label, round(sum(revenue), 2) as revenue, round(sum(profit), 2) as profit, round(sum(profit) * 100 / sum(revenue), 2) as margin_pct from sales group by 1 order by sum(revenue) desc, 1 limit 15", 2)
def breakdown(spark, d):
    return A.breakdown(sales(spark, d), "p_brand", MAPPING)


@query(f"""with {SALES}, x as (select 'p_type' as "column", p_type as label, sum(revenue) as r, sum(profit) as p from sales group by 2 union all select 'l_returnflag', l_returnflag, sum(revenue), sum(profit) from sales group by 2 union all select 'p_brand', p_brand, sum(revenue), sum(profit) from sales group by 2),
k as (select *, row_number() over (partition by "column" order by r desc, label) as k from x) select "column", label, round(r, 2) as revenue, round(p, 2) as profit, round(p * 100 / r, 2) as margin_pct from k where k <= 15""", 2)
def all_breakdowns(spark, d):
    return A.all_breakdowns(sales(spark, d), MAPPING, ["p_type", "l_returnflag", "p_brand", "l_orderkey"])


@query("""with y as (select year(o_orderdate) as y, sum(o_totalprice) as v from orders group by 1)
select min(y)::int as first_year, round(arg_min(v, y), 2) as first_value, max(y)::int as last_year, round(arg_max(v, y), 2) as last_value, round((arg_max(v, y) - arg_min(v, y)) * 100 / abs(arg_min(v, y)), 2) as change_pct from y""", 2)
def yearly_change(spark, d):
    return A.yearly_change(table(spark, d, "orders"), "o_orderdate", "o_totalprice")


# combining and comparing


@query("""with x as (select lower(trim(o_custkey::varchar)) as v, count(*) as n from orders group by 1), y as (select lower(trim(c_custkey::varchar)) as v, count(*) as n from customer group by 1)
select 'custkey' as left_column, 'custkey' as right_column, round((select count(*) / sum(n) from x), 4) as left_uniqueness, round((select count(*) / sum(n) from y), 4) as right_uniqueness,
round((select count(*) from x join y using (v)) / least((select count(*) from x), (select count(*) from y))::double, 4) as overlap, true as chosen""")
def detect_join_key(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("custkey"), "o_totalprice")
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("custkey"), "c_mktsegment")
    return J.detect_join_key(o, c, whole=True)


@query("select o_orderkey, o_custkey as custkey, c_mktsegment as segment, round(o_totalprice, 2) as amount from orders left join customer on o_custkey = c_custkey and c_custkey % 2 = 0", 2)
def relational_join(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("custkey"), F.col("o_totalprice").alias("amount"))
    c = table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("segment"))
    return J.relational_join(o, c, "custkey", "key")[0]


@query("""select 'a' as fact, count(*) as rows, count(c_custkey) as matched, count(*) - count(c_custkey) as unmatched, round(count(c_custkey) * 100.0 / count(*), 4) as match_rate_pct, count(c_custkey) as fact_rows_matched from orders left join customer on o_custkey = c_custkey and c_custkey % 2 = 0""")
def join_report(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("custkey"))
    c = table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("key"), "c_mktsegment")
    return J.relational_join(o, c, "custkey", "key")[1]


@query("""select o_orderdate as date, round(o_totalprice, 2) as revenue, o_orderstatus as category, 'orders' as _source_file from orders union all select l_shipdate, round(l_extendedprice, 2), null, 'items' from lineitem""", 2)
def combine_tables(spark, d):
    o, items = table(spark, d, "orders"), table(spark, d, "lineitem")
    return J.combine([o, items], [{"date": "o_orderdate", "revenue": "o_totalprice", "category": "o_orderstatus"}, {"date": "l_shipdate", "revenue": "l_extendedprice"}], ["orders", "items"])


def _halves(spark, d):
    s = sales(spark, d)
    return s.where(F.year("l_shipdate") < 1998), s.where(F.year("l_shipdate") >= 1998)


@query(f"""with {SALES}, h as (select year(l_shipdate) < 1998 as a, sum(revenue) as total_revenue, sum(profit) as total_profit, sum(profit) * 100 / sum(revenue) as margin_pct, count(*)::double as order_count, avg(revenue) as avg_order_value, sum(l_quantity) as total_units, 100.0::double as completeness_pct from sales group by 1),
l as (unpivot h on total_revenue, total_profit, margin_pct, order_count, avg_order_value, total_units, completeness_pct into name metric value v)
select x.metric, round(x.v, 2) as value_a, round(y.v, 2) as value_b, round(y.v - x.v, 2) as delta, round((y.v - x.v) * 100 / abs(x.v), 2) as change_pct from l x join l y using (metric) where x.a and not y.a""", 2)
def compare_kpis(spark, d):
    return J.compare_kpis(*_halves(spark, d), {k: v for k, v in MAPPING.items() if k != "customer"})


@query(f"""with {SALES}, r as (select year(l_shipdate) < 1998 as a, corr(l_quantity, revenue) as q, corr(l_quantity, profit) as p, corr(profit, revenue) as s from sales group by 1), l as (select a, 'l_quantity' as col1, 'revenue' as col2, q as r from r union all select a, 'l_quantity', 'profit', p from r union all select a, 'profit', 'revenue', s from r)
select x.col1, x.col2, round(x.r, 4) as r_a, round(y.r, 4) as r_b, round(y.r - x.r, 4) as delta, sign(x.r) <> sign(y.r) and abs(x.r) > 0.1 and abs(y.r) > 0.1 as sign_flip, null::varchar as only_in from l x join l y using (col1, col2) where x.a and not y.a""")
def compare_correlations(spark, d):
    cols = ["l_quantity", "revenue", "profit"]
    return J.compare_correlations(*(A.correlation_matrix(x, cols) for x in _halves(spark, d)))


@query(f"""with {SALES}, h as (select year(l_shipdate) < 1998 as a, count(*) as n, sum(revenue) as revenue, sum(profit) as profit from sales group by 1), l as (unpivot h on revenue, profit into name measure value v)
select x.measure, round(x.v, 2) as old_sum, round(y.v, 2) as new_sum, round((y.v - x.v) * 100 / abs(x.v), 2) as change_pct, y.n - x.n as row_change from l x join l y using (measure) where x.a and not y.a""", 2)
def snapshot_drift(spark, d):
    old, new = _halves(spark, d)
    return J.drift(J.snapshot(old, ["revenue", "profit"]), J.snapshot(new, ["revenue", "profit"])).drop("added", "removed")


# relationships

MEASURES = ["l_quantity", "revenue", "profit"]


def _area(density: str, upto: str) -> str:
    """SQL for the integral of a density, an expression in $x, from 0 to `upto` by Simpson's rule."""
    at = density.replace("$x", f"(i * ({upto}) / 4000.0)")
    return f"list_sum(list_transform(range(4001), lambda i: (case when i in (0, 4000) then 1 when i % 2 = 1 then 4 else 2 end) * ({at}))) * ({upto}) / 12000.0"


def t_tail(t: str, v: str) -> str:
    """SQL for the two-sided tail of Student's t, integrated from its density; nothing is left beyond 40."""
    area = _area(f"pow(1 + $x * $x / ({v}), -(({v}) + 1) / 2.0)", f"least(abs({t}), 40.0)")
    return f"greatest(0.0, 1 - 2 * exp(lgamma((({v}) + 1) / 2.0) - lgamma(({v}) / 2.0)) / sqrt(({v}) * pi()) * {area})"


def f_tail(f: str, a: str, b: str) -> str:
    """SQL for the upper tail of F, integrated from its density."""
    area = _area(f"pow($x, ({a}) / 2.0 - 1) * pow(1 + ({a}) * $x / ({b}), -(({a}) + ({b})) / 2.0)", f)
    scale = f"pow(({a}) / ({b}), ({a}) / 2.0) * exp(lgamma((({a}) + ({b})) / 2.0) - lgamma(({a}) / 2.0) - lgamma(({b}) / 2.0))"
    return f"greatest(0.0, 1 - {scale} * {area})"


def r_tail(r: str, v: str) -> str:
    """SQL for the two-sided tail of a correlation with v degrees of freedom."""
    return t_tail(f"({r}) * sqrt(({v}) / (1 - ({r}) * ({r})))", v)


@query(f"""with {SALES}, x as (select count(*) as n, corr(l_quantity, revenue) as a, corr(l_quantity, profit) as b, corr(revenue, profit) as c from sales),
l as (select 'l_quantity' as col1, 'revenue' as col2, n, a as r from x union all select 'l_quantity', 'profit', n, b from x union all select 'revenue', 'profit', n, c from x),
p as (select *, {r_tail("r", "n - 2.0")} as p from l)
select col1, col2, n, round(r, 4) as r, round(p, 4) as p_value, p < 0.05 as significant, case when abs(r) >= 0.7 then 'strong' when abs(r) >= 0.5 then 'moderate' else 'weak' end as strength, n < 30 as small_sample, abs(r) >= 0.3 as reported from p""")
def correlation_tests(spark, d):
    return R.correlations(sales(spark, d), MEASURES)


VIF3 = """select corr(l_quantity, revenue) as a, corr(l_quantity, l_tax) as b, corr(revenue, l_tax) as c from sales"""


@query(f"""with {SALES}, x as ({VIF3}), r as (select 'l_quantity' as "column", (a * a + b * b - 2 * a * b * c) / (1 - c * c) as r2 from x union all select 'revenue', (a * a + c * c - 2 * a * b * c) / (1 - b * b) from x union all select 'l_tax', (b * b + c * c - 2 * a * b * c) / (1 - a * a) from x)
select "column", round(r2, 4) as r_squared, round(1 / (1 - r2), 4) as vif, case when 1 / (1 - r2) >= 10 then 'severe' when 1 / (1 - r2) >= 5 then 'moderate' else 'ok' end as severity from r""")
def vif(spark, d):
    return R.vif(sales(spark, d), ["l_quantity", "revenue", "l_tax"])


@query(f"""with {SALES}, o as (select corr(revenue, profit) as r from sales), g as (select 'l_returnflag' as dimension, l_returnflag as level, count(*) as n, corr(revenue, profit) as r from sales group by 2 union all select 'p_type', p_type, count(*), corr(revenue, profit) from sales group by 2)
select 'revenue' as col1, 'profit' as col2, dimension, round(o.r, 4) as overall_r, count(*) as groups, count(*) filter (where n >= 15 and abs(g.r) >= 0.15) as usable_groups, coalesce(count(*) filter (where n >= 15 and abs(g.r) >= 0.15) >= 2 and bool_and(sign(g.r) = -sign(o.r)) filter (where n >= 15 and abs(g.r) >= 0.15), false) as reversed from g, o group by dimension, o.r""")
def simpsons(spark, d):
    return R.simpsons(sales(spark, d), [("revenue", "profit")], ["l_returnflag", "p_type"])


@query(f"""with {SALES}, n as (select count(*) as n, corr(revenue, profit) as xy, corr(revenue, l_quantity) as xz, corr(profit, l_quantity) as yz from sales), gm as (select p_type, avg(revenue) as mx, avg(profit) as my from sales group by 1), w as (select corr(revenue - mx, profit - my) as r from sales join gm using (p_type)),
l as (select 'l_quantity' as control, 'numeric' as control_type, n, n - 3.0 as v, xy, (xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)) as p from n
  union all select 'p_type', 'category', n, n - (select count(*) from gm) - 1.0, xy, r from n, w)
select 'revenue' as col1, 'profit' as col2, control, control_type, n, round(xy, 4) as overall_r, round(p, 4) as partial_r, round({r_tail("p", "v")}, 4) as p_value, round(abs(xy) - abs(p), 4) as "drop", case when sign(p) <> sign(xy) and abs(p) >= 0.15 then 'reverses' when abs(xy) - abs(p) >= 0.15 and abs(p) < 0.3 then 'mostly_explained' when abs(xy) - abs(p) >= 0.15 then 'partially_explained' else 'none' end as effect from l""")
def partial_correlations(spark, d):
    return R.partial_correlations(sales(spark, d), [("revenue", "profit")], ["l_quantity"], ["p_type"])


@query(f"with {CLEAN} select l_orderkey, l_linenumber, round(d2, 4) as distance from dist where d2 > 9.210340371976184 order by d2 desc, 1, 2 limit 50")
def anomalies(spark, d):
    t = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    return R.anomalies(t, ["l_quantity", "l_extendedprice"], ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "distance")


@query()
def segments(spark, d):
    return R.segments(sales(spark, d), ["l_quantity", "revenue", "profit"])[1]


@query("""with v as (select abs(value) as v from events where value <> 0), c as (select greatest(1, least(9, floor(v / pow(10, floor(log10(v))))))::int as digit, count(*) as n from v group by 1), t as (select count(*) as t from v where (select max(v) / min(v) >= 100 from v)), g as (select range::int as digit from range(1, 10)), x as (select digit, coalesce(n, 0) as n, t, log10(1 + 1.0 / digit) as e from g left join c using (digit), t where t >= 100),
y as (select *, sum((n - e * t) ** 2 / (e * t)) over () as chi2 from x), z as (select *, exp(-chi2 / 2) * (1 + chi2 / 2 + chi2 ** 2 / 8 + chi2 ** 3 / 48) as p from y)
select 'value' as "column", digit, n, round(n / t::double, 4) as share, round(e, 4) as expected, round(chi2, 4) as chi2, round(p, 4) as p_value, p < 0.05 as deviates from z""")
def benford(spark, d):
    return R.benford(table(spark, d, "events"), ["value"])


@query("""with q as (select quantile_cont(value, 0.25) as a, quantile_cont(value, 0.75) as b from events), f as (select a - 1.5 * (b - a) as lo, b + 1.5 * (b - a) as hi from q), x as (select sum(value) as fu, sum(value) filter (where value between lo and hi) as tr, count(*) filter (where not value between lo and hi) * 100.0 / count(value) as o from events, f)
select 'value' as measure, 'sum' as agg, round(fu, 2) as "full", round(tr, 2) as trimmed, round((tr - fu) * 100 / abs(fu), 2) as change_pct, round(o, 2) as outside_pct, abs((tr - fu) * 100 / abs(fu)) >= 20 as material, o > 5 as skewed from x""", 2)
def robust_kpis(spark, d):
    return R.robust_kpis(table(spark, d, "events"), [("value", "sum")])


@query(f"""with {SALES}, q as (select quantile_cont(revenue, 0.25) as a, quantile_cont(revenue, 0.75) as b, quantile_cont(profit, 0.25) as c, quantile_cont(profit, 0.75) as e from sales), i as (select revenue, profit, revenue between a - 1.5 * (b - a) and b + 1.5 * (b - a) and profit between c - 1.5 * (e - c) and e + 1.5 * (e - c) as inside from sales, q),
c as (select corr(revenue, profit) as r, count(*) as n, corr(revenue, profit) filter (where inside) as ir, count(*) filter (where inside) as ni from i),
p as (select *, {r_tail("r", "n - 2.0")} as p, {r_tail("ir", "ni - 2.0")} as ip from c)
select 'revenue' as col1, 'profit' as col2, round(r, 4) as r, n, round(ir, 4) as inside_r, ni as inside_n, round(p, 4) as p_value, round(ip, 4) as inside_p,
  case when sign(r) <> sign(ir) and abs(r) >= 0.1 and abs(ir) >= 0.1 then 'flips' when p < 0.05 and ip >= 0.05 then 'lost_significance'
    when abs(ir) - abs(r) <= -0.15 then 'weakens' when abs(ir) - abs(r) >= 0.15 then 'strengthens' else 'holds' end as effect from p""")
def robust_correlations(spark, d):
    return R.robust_correlations(sales(spark, d), [("revenue", "profit")])


# intervals and tests


BOOTSTRAP = f"""hashed as (select cell, draw, md5(cell || '|' || draw) as h from range(0, {B.CELLS}) c(cell), range(-1, DRAWS) d(draw)),
numbers as (select cell, draw, ('0x' || substr(h, 1, 8))::bigint as ua, ('0x' || substr(h, 9, 8))::bigint as ub from hashed),
weights as (select cell, draw,
  case when draw < 0 then 1 else {" + ".join(f"(ua >= {p * 2**32!r})::int" for p in B.UPTO)} end as wa,
  case when draw < 0 then 1 else {" + ".join(f"(ub >= {p * 2**32!r})::int" for p in B.UPTO)} end as wb from numbers)"""


@query(f"""with {BOOTSTRAP.replace("DRAWS", "200")},
cells as (select ('0x' || substr(md5(event_id::varchar), 1, 8))::bigint % {B.CELLS} as cell,
  sum(value) as s1, count(value) as n1, sum(user_id) as s2, count(user_id) as n2 from events group by 1),
draws as (select draw, sum(wa * s1) / sum(wa * n1) as x1, sum(wa * s2) / sum(wa * n2) as x2 from cells join weights using (cell) where draw >= 0 group by 1),
band as (select quantile_cont(x1, 0.025) as l1, quantile_cont(x1, 0.975) as h1, quantile_cont(x2, 0.025) as l2, quantile_cont(x2, 0.975) as h2 from draws)
select 'value' as measure, 'sum' as agg, count(value) as n, round(sum(value), 2) as point,
  round(any_value(l1) * count(value), 2) as low, round(any_value(h1) * count(value), 2) as high from events, band
union all
select 'user_id', 'avg', count(user_id), round(avg(user_id), 2), round(any_value(l2), 2), round(any_value(h2), 2) from events, band""", 2)
def kpi_intervals(spark, d):
    got = I.kpi_intervals(table(spark, d, "events"), [("value", "sum"), ("user_id", "avg")], 200, ["event_id"])
    return got.select("measure", "agg", "n", "point", "low", "high")


@query()
def bootstrap_claim(spark, d):
    return I.bootstrap_claim(sales(spark, d), "share", "revenue", "l_returnflag", "R", reference=30.0, key=["l_orderkey", "l_linenumber"])


@query(f"""with {SALES}, {BOOTSTRAP.replace("DRAWS", "100")},
cells as (select ('0x' || substr(md5(l_orderkey || '|' || l_linenumber), 1, 8))::bigint % {B.CELLS} as cell,
  sum(revenue) filter (where l_returnflag = 'R') as ra, count(revenue) filter (where l_returnflag = 'R') as na,
  sum(revenue) filter (where l_returnflag <> 'R') as rb, count(revenue) filter (where l_returnflag <> 'R') as nb,
  sum(revenue) filter (where l_returnflag = 'A') as rc, count(revenue) filter (where l_returnflag = 'A') as nc,
  sum(profit) filter (where l_linestatus = 'O') as po, count(profit) filter (where l_linestatus = 'O') as no from sales group by 1),
sums as (select draw, coalesce(sum(wa * ra), 0) as ra, sum(wa * coalesce(na, 0)) as na, coalesce(sum(wb * rb), 0) as rb, sum(wb * coalesce(nb, 0)) as nb,
  coalesce(sum(wb * rc), 0) as rc, sum(wb * coalesce(nc, 0)) as nc, coalesce(sum(wa * po), 0) as po, sum(wa * coalesce(no, 0)) as no from cells join weights using (cell) group by 1),
stats as (select draw, unnest([{{'name': 'share', 'x': ra * 100 / (ra + rb), 'reference': 30.0}}, {{'name': 'gap', 'x': ra / na - rb / nb, 'reference': 0.0}},
  {{'name': 'change', 'x': (ra / na - rc / nc) * 100 / abs(rc / nc), 'reference': 0.0}}, {{'name': 'mean', 'x': po / no, 'reference': 0.0}}], recursive := true) from sums),
bands as (select name, any_value(reference) as reference, max(x) filter (where draw < 0) as point, quantile_cont(x, 0.025) filter (where draw >= 0) as low,
  quantile_cont(x, 0.975) filter (where draw >= 0) as high, count(x) filter (where draw >= 0) as valid from stats group by 1)
select name, name as kind, round(point, 3) as point, round(low, 3) as low, round(high, 3) as high, valid,
  case when name = 'mean' then high < reference else low > reference or high < reference end as significant from bands""", 3)
def bootstrap_claims(spark, d):
    """A claim of each kind, the last one one-sided, from one pass."""
    claims = [
        B.Claim("share", "share", "revenue", "l_returnflag", "R", reference=30.0),
        B.Claim("gap", "gap", "revenue", "l_returnflag", "R"),
        B.Claim("change", "change", "revenue", "l_returnflag", "R", other="A"),
        B.Claim("mean", "mean", "profit", where=F.col("l_linestatus") == "O", side="below"),
    ]
    return B.bootstrap(sales(spark, d), claims, ["l_orderkey", "l_linenumber"], 100)


@query("""with p as (select l_returnflag, case l_returnflag when 'A' then 0 when 'N' then 100 else 40 end + l_discount * 10 as height,
  case l_returnflag when 'A' then 0 when 'N' then 30 else 90 end + l_quantity / 25 as width from lineitem),
m as (select count(*) as n, avg(height) as mh, stddev_pop(height) as sh, avg(width) as mw, stddev_pop(width) as sw from p),
g as (select row_number() over (order by count(*) desc) - 1 as segment, count(*) as size, avg(height) as h, avg(width) as w from p group by l_returnflag),
z as (select segment, size, 'height' as measure, h as mean, (h - mh) / sh as z from g, m union all select segment, size, 'width', w, (w - mw) / sw from g, m)
select segment::int as segment, size, measure, round(mean, 4) as mean, round(z, 4) as z, abs(z) >= 0.35 as trait from z""")
def segments_planted(spark, d):
    """Three groups that lie well apart, each of a return flag."""
    flag = F.col("l_returnflag")
    height = F.when(flag == "A", 0).when(flag == "N", 100).otherwise(40) + F.col("l_discount") * 10
    width = F.when(flag == "A", 0).when(flag == "N", 30).otherwise(90) + F.col("l_quantity") / 25
    return R.segments(table(spark, d, "lineitem").select(height.alias("height"), width.alias("width")), ["height", "width"])[1]


@query("""with x as (select event_type = 'click' as a, value as v from events where event_type in ('click', 'purchase')), m as (select a, count(*) as n, avg(v) as m, var_samp(v) as s from x group by 1), r as (select a, rank() over (order by v) + (count(*) over (partition by v) - 1) / 2.0 as r from x)
select p.n as n_a, q.n as n_b, round(p.m, 4) as mean_a, round(q.m, 4) as mean_b, round(q.m - p.m, 4) as difference, round((q.m - p.m) / sqrt(p.s / p.n + q.s / q.n), 4) as t, round((p.s / p.n + q.s / q.n) ** 2 / ((p.s / p.n) ** 2 / (p.n - 1) + (q.s / q.n) ** 2 / (q.n - 1)), 2) as df, round((select sum(r) from r where not a) - q.n * (q.n + 1) / 2.0, 1) as u from m p, m q where p.a and not q.a""")
def ab_test(spark, d):
    out = I.ab_test(table(spark, d, "events"), "event_type", "click", "purchase", "value")
    return out.select("n_a", "n_b", "mean_a", "mean_b", "difference", "t", F.round("df", 2).alias("df"), F.round("u", 1).alias("u"))


@query("""with x as (select lang, toxic::varchar as level from labels join documents using (doc_id) where lang in ('en', 'fr')), c as (select level, count(*) filter (where lang = 'en') as a, count(*) filter (where lang = 'fr') as b from x group by 1), t as (select sum(a) as na, sum(b) as nb from c)
select level, a as count_a, b as count_b, round(a / na, 4) as rate_a, round(b / nb, 4) as rate_b, round(b / nb - a / na, 4) as difference, round(sum((a - (a + b) * na / (na + nb)) ** 2 / ((a + b) * na / (na + nb)) + (b - (a + b) * nb / (na + nb)) ** 2 / ((a + b) * nb / (na + nb))) over (), 4) as chi2 from c, t""")
def ab_rate_test(spark, d):
    x = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    return I.ab_rate_test(x, "lang", "en", "fr", "toxic").select("level", "count_a", "count_b", "rate_a", "rate_b", "difference", "chi2")


@query("""select count(value) as "values", count(value) as numbers, count(distinct value) as "distinct", 0::bigint as infinite, 'numeric' as kind from events""")
def outcome_kind(spark, d):
    return I.outcome_kind(table(spark, d, "events"), "value")


# series


@query(f"""with m as (select strftime(l_shipdate, '%Y-%m') as month, count(*) as n, sum(l_extendedprice) as v, avg(l_extendedprice) as m, var_samp(l_extendedprice) as s from lineitem group by 1 order by 1 desc limit 2), r as (select *, row_number() over (order by month desc) as k from m),
w as (select (a.m - b.m) / sqrt(a.s / a.n + b.s / b.n) as t, (a.s / a.n + b.s / b.n) ** 2 / ((a.s / a.n) ** 2 / (a.n - 1) + (b.s / b.n) ** 2 / (b.n - 1)) as v from r a, r b where a.k = 1 and b.k = 2),
p as (select {t_tail("t", "v")} as p from w)
select a.month, b.month as previous_month, round(a.v, 2) as value, round(b.v, 2) as previous_value, round((a.v - b.v) * 100 / abs(b.v), 2) as change_pct, round((a.m - b.m) / sqrt(a.s / a.n + b.s / b.n), 2) as t, round((a.s / a.n + b.s / b.n) ** 2 / ((a.s / a.n) ** 2 / (a.n - 1) + (b.s / b.n) ** 2 / (b.n - 1)), 2) as df,
  round(p.p, 2) as p_value, p.p < 0.05 as significant
from r a, r b, p where a.k = 1 and b.k = 2 and a.n >= 5 and b.n >= 5""", 2)
def period_comparison(spark, d):
    return S.period_comparison(table(spark, d, "lineitem"), "l_shipdate", "l_extendedprice")


@query(f"""with {MONTHLY}, x as (select month, value, row_number() over (order by month) - 1 as i, count(*) over () as n, (avg(value) over (order by month rows between 6 preceding and 5 following) + avg(value) over (order by month rows between 5 preceding and 6 following)) / 2 as t from series),
y as (select *, case when i >= 6 and i < n - 6 then t end as tr, month[6:7]::int as moy from x), o as (select moy, avg(value - tr) as m, count(value - tr) as k, var_pop(value - tr) * count(*) as within from y where tr is not null group by 1 having count(*) >= 2),
g as (select sum(m * k) / sum(k) as grand, avg(m) as centre, count(*) as groups, sum(k) as n_all, sum(within) as within, arg_max(moy, m) as peak_month, arg_min(moy, m) as trough_month from o),
a as (select g.*, groups - 1.0 as a, n_all - groups + 0.0 as b, (select sum(k * (m - grand) ** 2) from o, g) / (groups - 1) / (within / (n_all - groups)) as f from g),
p as (select *, {f_tail("f", "a", "b")} as p from a),
s as (select month, n, value, tr, o.m - centre as season, value - tr - (o.m - centre) as residual from y left join o using (moy), p),
strength as (select greatest(0.0, 1 - var_pop(residual) / var_pop(residual + season)) as ss, greatest(0.0, 1 - var_pop(residual) / var_pop(residual + tr)) as ts from s)
select month, round(value, 3) as value, n, round(tr, 3) as trend, round(season, 3) as season, round(residual, 3) as residual, round(f, 3) as f, round(p, 3) as p_value,
  p < 0.05 as seasonal, round(ss, 3) as season_strength, round(ts, 3) as trend_strength, peak_month, trough_month from s, p, strength where n >= 36""", 3)
def seasonality(spark, d):
    return S.seasonality(monthly_orders(spark, d))


GROWING = "series as (select strftime(o_orderdate, '%Y-%m') as month, count(*) * (year(min(o_orderdate)) - 1990.0) as value from orders where o_orderdate < timestamp '2001-01-01' group by 1)"


def growing(spark, d):
    """Orders of a month times years since 1990: a series with a trend."""
    o = table(spark, d, "orders").where("o_orderdate < timestamp_ntz'2001-01-01'")
    return o.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg((F.count(F.lit(1)) * (F.year(F.min("o_orderdate")) - 1990.0)).alias("value"))


@query(f"""with {GROWING}, x as (select value, row_number() over (order by month) - 1 as i, month from series), f as (select regr_slope(value, i) as s, regr_intercept(value, i) as b, regr_r2(value, i) as r2, count(*) as n, max(month) as last from x)
select strftime((last || '-01')::date + to_months(k::int), '%Y-%m') as month, round(b + s * (n + k - 1), 4) as value, round(s, 4) as slope, round(b, 4) as intercept, round(r2, 4) as r_squared, n as months from f, (select range as k from range(1, 4)) where r2 >= 0.3""")
def forecast(spark, d):
    return S.forecast(growing(spark, d)).select("month", "value", "slope", "intercept", "r_squared", "months")


@query(f"""with o as (select o_orderpriority, strftime(o_orderdate, '%Y-%m') as month, o_totalprice * (year(o_orderdate) - 1990) as v from orders where o_orderdate < timestamp '2001-01-01' and o_orderpriority is not null and o_totalprice is not null),
top as (select o_orderpriority from (select o_orderpriority, sum(v) as s, count(*) as k, count(distinct month) as months from o group by 1 order by 2 desc, 1 limit 4) where k >= 20 and months >= 6),
series as (select o_orderpriority, month, sum(v) as value from o join top using (o_orderpriority) group by 1, 2),
x as (select o_orderpriority, month, value, month[6:7]::int as moy, row_number() over (partition by o_orderpriority order by month) - 1 as i, count(*) over (partition by o_orderpriority) as n, (avg(value) over (partition by o_orderpriority order by month rows between 6 preceding and 5 following) + avg(value) over (partition by o_orderpriority order by month rows between 5 preceding and 6 following)) / 2 as t from series),
c as (select o_orderpriority, moy, avg(value - t) as m, count(*) as k, var_pop(value - t) * count(*) as within from x where n >= 36 and i >= 6 and i < n - 6 group by 1, 2 having count(*) >= 2),
g as (select o_orderpriority, sum(m * k) / sum(k) as grand, avg(m) as centre, count(*) as groups, sum(k) as n_all, sum(within) as within from c group by 1),
a as (select o_orderpriority, any_value(groups) - 1.0 as a, any_value(n_all - groups) + 0.0 as b, sum(k * (m - grand) ** 2) / nullif(any_value(groups) - 1, 0) / nullif(any_value(g.within) / nullif(any_value(n_all - groups), 0), 0) as f from c join g using (o_orderpriority) group by 1),
p as (select o_orderpriority, {f_tail("f", "a", "b")} as p from a), seasons as (select o_orderpriority, moy, m - centre as season from c join g using (o_orderpriority) join p using (o_orderpriority) where p < 0.05),
y as (select x.*, value - coalesce(season, 0) as y from x left join seasons using (o_orderpriority, moy) where n >= 6),
e as (select o_orderpriority, regr_slope(y, i) as s, regr_intercept(y, i) as b, min(y) as least from y where i < n - 1 group by 1),
z as (select y.*, bool_or(i = n - 1 and n >= 7 and y < 0.25 * (b + s * i) and y < least) over (partition by o_orderpriority) as dropped from y join e using (o_orderpriority)),
f as (select o_orderpriority, regr_slope(y, i) as slope, regr_intercept(y, i) as base, case when var_pop(y) > 0 then regr_r2(y, i) else 0 end as r2, count(*) as n, max(month) as last, arg_max(value, month) as last_value, any_value(dropped) as dropped from z where i < n - 1 or not dropped group by 1 having count(*) >= 6),
h as (select f.*, k, (last || '-01')::date + to_months(k::int + dropped::int) as day from f, (select range as k from range(1, 4)) where r2 >= 0.3),
q as (select h.*, base + slope * (n + k - 1) + coalesce(season, 0) as value from h left join seasons on h.o_orderpriority = seasons.o_orderpriority and moy = month(day))
select o_orderpriority, strftime(day, '%Y-%m') as month, round(value, 2) as value, round(slope, 2) as slope, round(base, 2) as intercept, round(r2, 4) as r_squared, n as months, round(last_value, 2) as last_value,
round((max(value) filter (where k = 3) over (partition by o_orderpriority) - last_value) * 100 / nullif(abs(last_value), 0), 2) as projected_change_pct from q""")
def segment_forecast_lines(spark, d):
    """The segments' lines, without the bootstrapped band: seasons that are significant are taken out before and put back after, a partial last month is left out."""
    o = table(spark, d, "orders").where("o_orderdate < timestamp_ntz'2001-01-01'").withColumn("grown", F.col("o_totalprice") * (F.year("o_orderdate") - 1990))
    lines = S.segment_forecast(o, "o_orderpriority", "o_orderdate", "grown")
    money = ("value", "slope", "intercept", "last_value", "projected_change_pct")
    return lines.select("o_orderpriority", "month", "r_squared", "months", *(F.round(c, 2).alias(c) for c in money))


@query()
def segment_forecast(spark, d):
    o = table(spark, d, "orders").where("o_orderdate < timestamp_ntz'2001-01-01'").withColumn("grown", F.col("o_totalprice") * (F.year("o_orderdate") - 1990))
    return S.segment_forecast(o, "o_orderpriority", "o_orderdate", "grown")


@query(f"""with {MONTHLY}, x as (select month, value, row_number() over (order by month) - 1 as i, count(*) over () as n from series), s as (select a.i, a.month, a.n, regr_slope(b.value, b.i) filter (where b.i < a.i) as s1, regr_intercept(b.value, b.i) filter (where b.i < a.i) as b1, regr_slope(b.value, b.i) filter (where b.i >= a.i) as s2, regr_intercept(b.value, b.i) filter (where b.i >= a.i) as b2,
var_pop(b.value) filter (where b.i < a.i) * (1 - regr_r2(b.value, b.i) filter (where b.i < a.i)) / (a.i - 1) + var_pop(b.value) filter (where b.i >= a.i) * (1 - regr_r2(b.value, b.i) filter (where b.i >= a.i)) / (a.n - a.i - 1) as v from x a, x b where a.i >= 4 and a.n - a.i >= 4 group by 1, 2, 3)
select month, i, round(abs(b2 + s2 * i - b1 - s1 * (i - 1)) / sqrt(v), 4) as score from s""")
def split_scores(spark, d):
    return S.split_scores(monthly_orders(spark, d)).select("month", F.col("i").cast("long").alias("i"), "score")


@query(f"""with {MONTHLY}, x as (select month, value + case when month >= '1998-06' then (select 0.6 * avg(value) from series) else 0 end as value, row_number() over (order by month) - 1 as i, count(*) over () as n from series),
s as (select a.i, a.month, regr_slope(b.value, b.i) filter (where b.i < a.i) as s1, regr_intercept(b.value, b.i) filter (where b.i < a.i) as b1, regr_slope(b.value, b.i) filter (where b.i >= a.i) as s2, regr_intercept(b.value, b.i) filter (where b.i >= a.i) as b2, avg(b.value) filter (where b.i < a.i) as m1, avg(b.value) filter (where b.i >= a.i) as m2,
var_pop(b.value) filter (where b.i < a.i) * (1 - regr_r2(b.value, b.i) filter (where b.i < a.i)) / (a.i - 1) + var_pop(b.value) filter (where b.i >= a.i) * (1 - regr_r2(b.value, b.i) filter (where b.i >= a.i)) / (a.n - a.i - 1) as v from x a, x b where a.i >= 4 and a.n - a.i >= 4 group by a.i, a.month, a.n)
select month, round(abs(b2 + s2 * i - b1 - s1 * (i - 1)) / sqrt(v), 2) as score, round(m1, 2) as before_mean, round(m2, 2) as after_mean, round((m2 - m1) * 100 / abs(m1), 2) as shift_pct, abs((m2 - m1) * 100 / abs(m1)) >= 15 as is_break from s order by 2 desc, 1 limit 1""", 2)
def changepoint_planted(spark, d):
    """A step of 60 % of the mean in June 1998 is the break."""
    m = monthly_orders(spark, d)
    step = m.agg((F.avg("value") * 0.6).alias("step"))
    return S.changepoint(m.crossJoin(F.broadcast(step)).select("month", F.when(F.col("month") >= "1998-06", F.col("value") + F.col("step")).otherwise(F.col("value")).alias("value"))).drop("p_value")


@query()
def changepoint(spark, d):
    return S.changepoint(monthly_orders(spark, d))


DRIVER_DIMS = ["l_returnflag", "c_mktsegment", "o_orderpriority"]
DRIVERS = """f as (select strftime(l_shipdate, '%Y-%m') as month, l_extendedprice * (1 - l_discount) as v, l_returnflag, c_mktsegment, o_orderpriority from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey),
w as (select month, row_number() over (order by month desc) as k from (select distinct strftime(l_shipdate, '%Y-%m') as month from lineitem)), r as (select f.*, k = 1 as after from f join w using (month) where k <= 2),
l as (select 'l_returnflag' as dimension, l_returnflag as segment, after, v from r union all select 'c_mktsegment', c_mktsegment, after, v from r union all select 'o_orderpriority', o_orderpriority, after, v from r),
s as (select dimension, segment, coalesce(sum(v) filter (where not after), 0) as b, coalesce(sum(v) filter (where after), 0) as a from l group by 1, 2),
g as (select *, a - b as change, sum(a - b) over (partition by dimension) as net, sum(abs(a - b)) over (partition by dimension) as gross, max(abs(a - b)) over (partition by dimension) as most, count(*) over (partition by dimension) as k from s),
c as (select *, most * 100 / gross - 100.0 / k as concentration from g), rk as (select dimension, row_number() over (order by max(concentration) desc, dimension) as dimension_rank from c group by 1)"""


@query(f"""with {DRIVERS} select dimension, segment, round(b, 2) as before_value, round(a, 2) as after_value, round(change, 2) as change, round(change * 100 / net, 2) as net_share, round(abs(change) * 100 / gross, 2) as gross_share, abs(net) < 0.2 * gross as offsetting, round(concentration, 2) as concentration, dimension_rank::int as dimension_rank from c join rk using (dimension)""", 2)
def drivers(spark, d):
    x = orders_full(spark, d)
    return S.drivers(x, "l_shipdate", "revenue", "sum", DRIVER_DIMS, *S.last_two_months(table(spark, d, "lineitem"), "l_shipdate"))


@query()
def driver_drill(spark, d):
    x = orders_full(spark, d)
    return S.drill(x, "l_shipdate", "revenue", "sum", DRIVER_DIMS, *S.last_two_months(table(spark, d, "lineitem"), "l_shipdate"))


# entities

ENTITY = """seen as (select distinct o_custkey as e, year(o_orderdate) * 12 + month(o_orderdate) as m from orders), f as (select e, m, min(m) over (partition by e) as c from seen), cells as (select c, m - c as k, count(*) as active from f group by 1, 2),
z as (select c, active as size from cells where k = 0 and active >= 5), r as (select *, row_number() over (order by c desc) as r, count(*) over () as n from z), u as (select * from r where r <= 12 and n >= 2)"""


@query(f"""with {ENTITY}, g as (select c, size, unnest(range(0, (select least(max(k), 11) from cells where c in (select c from u)) + 1)) as k from u)
select lpad(((g.c - 1) // 12)::varchar, 4, '0') || '-' || lpad(((g.c - 1) % 12 + 1)::varchar, 2, '0') as cohort, size, g.k::int as month_number, coalesce(active, 0) as active, round(coalesce(active, 0) / size::double, 4) as retention, g.c + g.k <= (select max(c + k) from cells) as observed from g left join cells on cells.c = g.c and cells.k = g.k""")
def cohorts(spark, d):
    return E.cohorts(table(spark, d, "orders"), "o_custkey", "o_orderdate")


@query("""with s as (select distinct o_custkey as e, o_orderdate as t from orders), g as (select floor((epoch(t) - epoch(lag(t) over (partition by e order by t))) / 86400) as gap from s), ty as (select quantile_cont(gap, 0.5) as typical, count(*) as n from g where gap > 0), l as (select e, max(t) as last from s group by 1), x as (select e, last, floor((epoch((select max(last) from l)) - epoch(last)) / 86400) as days, typical, (select count(*) from l) as entities from l, ty where n >= 10), y as (select *, days / typical as ratio from x where days / typical >= 1.5)
select e as entity, strftime(last, '%Y-%m-%d') as last_seen, days::bigint as days_since, typical as typical_gap, round(ratio, 4) as ratio, case when round(ratio, 2) >= 3 then 'high' else 'medium' end as level, (select count(*) from y) as flagged, entities from y order by y.ratio desc, e limit 20""")
def retention_risk(spark, d):
    return E.retention_risk(table(spark, d, "orders"), "o_custkey", "o_orderdate")


@query("""with c as (select o_custkey, sum(o_totalprice) as r from orders group by 1), n as (select count(*) as n, greatest(1, floor(0.1 * count(*)))::bigint as k, sum(r) as total from c), t as (select sum(r) as top from (select r, row_number() over (order by r desc, o_custkey) as i from c), n where i <= k)
select n as customers, k as top_customers, round(top * 100 / total, 4) as share_pct, top * 100 / total > 20 as reported from n, t where n >= 10""")
def customer_concentration(spark, d):
    return E.customer_concentration(table(spark, d, "orders"), "o_custkey", "o_totalprice")


# findings: each rule's facts

FACT = "null::varchar as priority"


@query("""with c as (select 'l_returnflag' as subject, l_returnflag as label, count(*) as n from lineitem group by 2 union all select 'l_linestatus', l_linestatus, count(*) from lineitem group by 2), r as (select *, row_number() over (partition by subject order by n desc, label) as k, sum(n) over (partition by subject) as t from c)
select 'most_common' as kind, subject, label as value_label, round(n * 100.0 / t, 4) as value from r where k = 1""")
def most_common_value(spark, d):
    return K.most_common(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"]).select("kind", "subject", "value_label", "value")


@query("select 'average' as kind, 'l_quantity' as subject, round(avg(l_quantity), 4) as value, count(l_quantity)::double as reference from lineitem union all select 'average', 'l_tax', round(avg(l_tax), 4), count(l_tax) from lineitem")
def measure_averages(spark, d):
    return K.measure_averages(table(spark, d, "lineitem"), ["l_quantity", "l_tax"]).select("kind", "subject", "value", "reference")


@query(f"with {SALES} select 'top_segment' as kind, 'p_brand' as subject, p_brand as value_label, round(sum(revenue), 2) as value from sales group by 3 order by sum(revenue) desc limit 1", 2)
def top_segment(spark, d):
    return K.top_segment(sales(spark, d), "p_brand", "revenue").select("kind", "subject", "value_label", "value")


@query(f"""with {SALES}, x as (select corr(l_quantity, revenue) as a, corr(l_quantity, profit) as b, corr(profit, revenue) as c from sales), l as (select 'l_quantity' as s, 'revenue' as v, a as r from x union all select 'l_quantity', 'profit', b from x union all select 'profit', 'revenue', c from x) select 'correlation' as kind, s as subject, v as value_label, round(r, 4) as value, abs(r) >= 0.4 as significant from l order by abs(r) desc limit 1""")
def strongest_correlation(spark, d):
    return K.strongest_correlation(sales(spark, d), MEASURES).select("kind", "subject", "value_label", "value", "significant")


@query(f"""with {SALES}, g as (select p_type as label, sum(revenue) as v from sales group by 1) select 'concentration' as kind, arg_max(label, v) as value_label, round(max(v) * 100 / sum(v), 4) as value, round(100.0 / count(*), 4) as reference, max(v) * 100 / sum(v) > 150.0 / count(*) as significant from g""")
def segment_concentration(spark, d):
    return K.concentration(sales(spark, d), "p_type", "revenue").select("kind", "value_label", "value", "reference", "significant")


@query(f"""with {SALES}, g as (select p_brand as label, sum(profit) * 100 / sum(revenue) as m from sales group by 1) select 'losing_segment' as kind, label as value_label, round(m, 4) as value, m < 0 as significant from g order by m, label limit 2""")
def losing_segments(spark, d):
    return K.losing_segments(sales(spark, d), "p_brand", "revenue", "profit").select("kind", "value_label", "value", "significant")


@query(f"""with {SALES}, g as (select case when l_discount <= 0 then '0' when l_discount <= 0.2 then '0-20%' end as label, sum(profit) * 100 / sum(revenue) as m from sales group by 1) select 'discount_band' as kind, label as value_label, round(m, 4) as value, m < 0 as significant from g""")
def discount_bands(spark, d):
    return K.discount_bands(sales(spark, d), "l_discount", "revenue", "profit").select("kind", "value_label", "value", "significant")


@query("""with y as (select year(o_orderdate) as y, sum(o_totalprice) as v from orders group by 1), c as (select (arg_max(v, y) - arg_min(v, y)) * 100 / abs(arg_min(v, y)) as c from y) select 'declining' as kind, round(c, 4) as value, case when c <= -30 then 'high' when c <= -15 then 'medium' else 'low' end as priority, c < -5 as significant from c""")
def declining_trend(spark, d):
    return K.declining(table(spark, d, "orders"), "o_orderdate", "o_totalprice").select("kind", "value", "priority", "significant")


@query(f"""with t as ({HOLES}) select 'missing' as kind, 'b' as subject, round(100.0 * avg((b is null)::int), 4) as value, case when 100.0 * avg((b is null)::int) > 50 then 'high' when 100.0 * avg((b is null)::int) > 30 then 'medium' else 'low' end as priority from t having avg((b is null)::int) > 0.15""")
def missing_data(spark, d):
    return K.missing_data(_holes(spark, d), ["a", "b"]).select("kind", "subject", "value", "priority")


@query("""with q as (select quantile_cont(value, 0.25) as a, quantile_cont(value, 0.75) as b from events), x as (select sum(value) filter (where value > b + 1.5 * (b - a)) * 100 / sum(value) as share, count(*) filter (where value > b + 1.5 * (b - a)) * 100.0 / count(value) as pct from events, q) select 'high_outliers' as kind, round(coalesce(share, 0), 4) as value, round(pct, 4) as reference, pct < 8 and coalesce(share, 0) > 20 as significant from x""")
def high_outliers(spark, d):
    return K.high_outliers(table(spark, d, "events"), "value").select("kind", "value", "reference", "significant")


@query("""with g as (select event_type as label, avg(value) as m from events group by 1), o as (select avg(value) as o from events) select 'under_performing' as kind, arg_min(label, m) as value_label, round(min(m), 4) as value, round(o, 4) as reference, (o - min(m)) * 100 / abs(o) >= 15 as significant from g, o group by o""")
def under_performing(spark, d):
    return K.under_performing(table(spark, d, "events"), "event_type", "value").select("kind", "value_label", "value", "reference", "significant")


@query()
def ranked_findings(spark, d):
    s = sales(spark, d)
    facts = K.concentration(s, "p_type", "revenue").unionByName(K.losing_segments(s, "p_brand", "revenue", "profit")).unionByName(K.strongest_correlation(s, MEASURES)).unionByName(K.high_outliers(s, "revenue"))
    return K.ranked(facts)


# text and personal data


@query(f"""with t as (select doc_id, text from documents where trim(text) <> ''), w as (select doc_id, unnest(list_filter(regexp_extract_all(lower(text), '[a-z]{{3,}}'), lambda x: x not in ({', '.join(repr(w) for w in X.STOP_WORDS if "'" not in w)}))) as word from t)
select word, count(*) as n, round(count(distinct doc_id) * 100.0 / (select count(*) from t), 4) as entries_pct from w group by 1 order by 2 desc, 1 limit 15""")
def keywords(spark, d):
    return X.keywords(table(spark, d, "documents"), "text")


@query("""select 'user_id' as "column", 'person_id' as kind, false as by_value, true as by_header, 'medium' as confidence from events limit 1""")
def scan_sensitive(spark, d):
    return X.scan_sensitive(table(spark, d, "events")).select("column", "kind", "by_value", "by_header", "confidence")


@query(f"""select 'text' as "column", 'email' as kind, count(*) filter (where regexp_matches(text, '{X.EMAIL}')) as rows from documents union all select 'text', 'ssn', count(*) filter (where regexp_matches(text, '(^|[^0-9-]){X.SSN}($|[^0-9-])')) from documents union all select 'text', 'card', 0 from documents limit 3""")
def scan_text_leaks(spark, d):
    return X.scan_text_leaks(table(spark, d, "documents"), ["text"])


@query("""select 'user_id' as "column", 'person_id' as kind, 'header' as source, 'medium' as confidence, true as blocks from events limit 1""")
def publish_guard(spark, d):
    return X.publish_findings(table(spark, d, "events"))


@query("select c_custkey, count(*) over (partition by c_mktsegment) as same from customer")
def mask_columns(spark, d):
    from pyspark.sql.window import Window

    m = X.mask_columns(table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_nationkey"), ["c_mktsegment", "c_nationkey"])
    return m.select("c_custkey", F.count(F.lit(1)).over(Window.partitionBy("c_mktsegment")).alias("same"))


# the same operators on planted rows, so that their rules have something to find


PLANTED = """pts as (select l_orderkey, l_linenumber, l_quantity, case when l_orderkey % 500 = 0 then l_extendedprice + 300000 else l_extendedprice end as price from lineitem),
mo as (select avg(l_quantity) as mx, avg(price) as my, var_samp(l_quantity) as sxx, var_samp(price) as syy, covar_samp(l_quantity, price) as sxy, stddev_pop(l_quantity) as dx, stddev_pop(price) as dy from pts),
dist as (select pts.*, (syy * (l_quantity - mx) ** 2 - 2 * sxy * (l_quantity - mx) * (price - my) + sxx * (price - my) ** 2) / (sxx * syy - sxy * sxy) as d2, (l_quantity - mx) / dx as zx, (price - my) / dy as zy from pts, mo)"""


@query(f"""with {PLANTED} select l_orderkey, l_linenumber, round(d2, 4) as distance, round(exp(-d2 / 2), 4) as p_value, round(zx, 4) as z_quantity, round(zy, 4) as z_price,
case when abs(zx) >= 0.5 and abs(zy) >= 0.5 then (case when abs(zy) >= abs(zx) then 'price,l_quantity' else 'l_quantity,price' end) when abs(zx) >= 0.5 then 'l_quantity' when abs(zy) >= 0.5 then 'price' else '' end as traits
from dist where d2 > 9.210340371976184 order by d2 desc, 1, 2 limit 50""")
def anomalies_planted(spark, d):
    t = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", F.when(F.col("l_orderkey") % 500 == 0, F.col("l_extendedprice") + 300000).otherwise(F.col("l_extendedprice")).alias("price"))
    got = R.anomalies(t, ["l_quantity", "price"], ["l_orderkey", "l_linenumber"])
    return got.select("l_orderkey", "l_linenumber", "distance", "p_value", F.col("z")["l_quantity"].alias("z_quantity"), F.col("z")["price"].alias("z_price"), F.concat_ws(",", "traits").alias("traits"))


@query("""with s(name, columns) as (values ('halves', ['o_orderkey', 'o_custkey', 'o_totalprice']), ('narrow', ['o_orderkey', 'o_custkey', 'o_orderstatus', 'o_totalprice', 'o_orderdate']), ('wider', ['o_orderkey', 'o_custkey', 'o_orderstatus', 'o_totalprice', 'o_orderdate', 'o_orderpriority', 'extra', 'more'])),
n as (select array_agg(column_name) as now from (describe orders)), j as (select name, len(list_intersect(columns, now))::double / len(list_distinct(list_concat(columns, now))) as jaccard from s, n)
select name, round(jaccard, 4) as jaccard from j where jaccard >= 0.6 order by 2 desc, 1 limit 1""")
def match_snapshot_closest(spark, d):
    o = table(spark, d, "orders")
    older = {"halves": o.select("o_orderkey", "o_custkey", "o_totalprice"), "narrow": o.drop("o_orderpriority"), "wider": o.withColumns({"extra": F.lit(1), "more": F.lit(2)})}
    out = None
    for name, df in older.items():
        part = J.snapshot(df, ["o_totalprice"]).select(F.lit(name).alias("name"), "columns")
        out = part if out is None else out.unionByName(part)
    return J.match_snapshot(out, o.columns)


@query("""select 'o_orderstatus' as "column", min(o_orderstatus) as value from orders where o_orderstatus = 'O' union all select 'year', strftime(min(o_orderdate), '%Y') from orders where o_orderdate >= timestamp '1996-01-01' and o_orderdate < timestamp '1997-01-01'""")
def constant_columns_filtered(spark, d):
    o = table(spark, d, "orders")
    one = o.where("o_orderstatus = 'O'").select("o_orderkey", "o_orderstatus", F.lit(None).cast("string").alias("year"))
    two = o.where("o_orderdate >= timestamp_ntz'1996-01-01' and o_orderdate < timestamp_ntz'1997-01-01'").select("o_orderkey", F.lit(None).cast("string").alias("o_orderstatus"), F.date_format("o_orderdate", "yyyy").alias("year"))
    return Q.constant_columns(one.unionByName(two))


PERSONAL = """people as (select c_custkey, 'user' || c_custkey || '@mail.example.org' as contact, case when c_custkey % 4 = 0 then 'none' else '+1 555 ' || lpad((c_custkey % 900 + 100)::varchar, 3, '0') || ' ' || lpad((c_custkey % 9000 + 1000)::varchar, 4, '0') end as tel,
 lpad((c_custkey % 899 + 100)::varchar, 3, '0') || '-12-' || lpad((c_custkey % 9000 + 1000)::varchar, 4, '0') as ssn, 'Ann ' || chr((65 + c_custkey % 26)::int) || chr((97 + c_custkey % 25)::int) || chr((97 + c_custkey // 25 % 25)::int) || chr((97 + c_custkey // 625 % 25)::int) as customer_name,
 '10.0.' || (c_custkey % 250) || '.' || (c_custkey // 250 % 250) as last_seen, c_mktsegment as address_type, c_nationkey as zip_code from customer)"""


def _people(spark, d):
    k = F.col("c_custkey")
    three, four = lambda a: F.lpad((k % a + 100).cast("string"), 3, "0"), F.lpad((k % 9000 + 1000).cast("string"), 4, "0")
    letter = lambda base, x: F.chr((base + x).cast("long"))
    name = F.concat(F.lit("Ann "), letter(65, k % 26), letter(97, k % 25), letter(97, F.floor(k / 25) % 25), letter(97, F.floor(k / 625) % 25))
    return table(spark, d, "customer").select(
        "c_custkey", F.concat(F.lit("user"), k, F.lit("@mail.example.org")).alias("contact"), F.when(k % 4 == 0, "none").otherwise(F.concat(F.lit("+1 555 "), three(900), F.lit(" "), four)).alias("tel"),
        F.concat(three(899), F.lit("-12-"), four).alias("ssn"), name.alias("customer_name"), F.concat(F.lit("10.0."), k % 250, F.lit("."), F.floor(k / 250) % 250).alias("last_seen"), F.col("c_mktsegment").alias("address_type"), F.col("c_nationkey").alias("zip_code"),
    )


PERSONAL_RATES = f"""{PERSONAL}, r as (select avg(regexp_full_match(contact, '{X.EMAIL}')::int) as contact, avg((regexp_full_match(tel, '{X.PHONE}') and length(regexp_replace(tel, '[^0-9]', '', 'g')) between 7 and 15)::int) as tel, avg(regexp_full_match(ssn, '{X.SSN}')::int) as ssn,
 avg(regexp_full_match(customer_name, '{X.NAME.replace("'", "''")}')::int) as names, count(distinct customer_name) / count(*)::double as share, avg(regexp_full_match(last_seen, '{X.IPV4}')::int) as ip from people)"""


@query(f"""with {PERSONAL_RATES} select * from (select 'contact' as "column", 'email' as kind, true as by_value, false as by_header, round(contact, 4) as rate, case when contact >= 0.8 then 'high' else 'medium' end as confidence from r where contact >= 0.5
union all select 'tel', 'phone', true, false, round(tel, 4), 'medium' from r where tel >= 0.5 union all select 'ssn', 'gov_id', true, true, round(ssn, 4), 'high' from r where ssn >= 0.5
union all select 'customer_name', 'person_name', true, true, round(names, 4), 'high' from r where names >= 0.6 and share >= 0.4 union all select 'last_seen', 'ip', true, false, round(ip, 4), 'medium' from r where ip >= 0.5
union all select 'zip_code', 'address', false, true, null, 'low' from r)""")
def scan_sensitive_planted(spark, d):
    return X.scan_sensitive(_people(spark, d))


@query(f"""with {PERSONAL_RATES} select * from (select 'contact' as "column", 'email' as kind, 'value' as source, case when contact >= 0.8 then 'high' else 'medium' end as confidence, true as blocks from r where contact >= 0.5
union all select 'tel', 'phone', 'value', 'medium', true from r where tel >= 0.5 union all select 'ssn', 'gov_id', 'value', 'high', true from r where ssn >= 0.5 union all select 'customer_name', 'person_name', 'value', 'high', true from r where names >= 0.6 and share >= 0.4
union all select 'last_seen', 'ip', 'value', 'medium', true from r where ip >= 0.5 union all select 'note', 'email', 'text', 'medium', true from people where c_custkey % 100 = 7 having count(*) > 0)""")
def publish_guard_planted(spark, d):
    p = _people(spark, d).withColumn("note", F.when(F.col("c_custkey") % 100 == 7, F.concat(F.lit("write to "), F.col("contact"))).otherwise("nothing to see here"))
    return X.publish_findings(p, masked=["zip_code"])


@query("""with c as (select c_mktsegment as v, count(*) as n from customer group by 1) select a.c_mktsegment as value, count(*) as rows, 1::bigint as names, true as named, true as hidden, 2::bigint as columns from customer a group by 1""")
def mask_columns_names(spark, d):
    """Each value has one name of its own, which doesn't show it."""
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment", F.col("c_nationkey").alias("secret"), F.col("c_mktsegment").alias("plain"))
    m = X.mask_columns(c, ["c_mktsegment", "secret"]).drop("c_custkey")
    by = m.groupBy("plain").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("c_mktsegment").alias("names"), F.bool_and(F.rlike("c_mktsegment", F.lit("^c_mktsegment [0-9]+$"))).alias("named"), F.bool_and(~F.contains("c_mktsegment", "plain")).alias("hidden"))
    alone = m.groupBy("c_mktsegment").agg(F.count_distinct("plain").alias("k")).agg(F.max("k").alias("k")).where("k = 1")
    return by.crossJoin(F.broadcast(alone)).select(F.col("plain").alias("value"), "rows", "names", "named", "hidden", F.lit(len(m.columns)).cast("long").alias("columns"))


@query("""with o as (select count(*) as n from orders), l as (select count(*) as n from (select * from orders where o_orderpriority = '1-URGENT')) select aspect, a as value_a, b as value_b, a <> b as differs from (
select 'rows' as aspect, (select n from o)::varchar as a, (select n from l)::varchar as b union all select 'columns', '6', '6' union all select 'quality_score', '100.0', '97.5' union all select 'domain', 'generic', 'generic')""")
def compare_tables(spark, d):
    o = table(spark, d, "orders")
    return J.compare_tables(o, o.where("o_orderpriority = '1-URGENT'"))


def _misses(spark, d, k):
    o = table(spark, d, "orders")
    gone = {"o_totalprice": k % 2, "o_orderpriority": 3 + 5 * (k % 2), "o_orderstatus": 2 if k == 1 else None, "o_custkey": 3 if k == 2 else None}
    return K.missing_data(o.select("o_orderkey", *(F.when(F.col("o_orderkey") % m >= (1 if m < 6 else 3), F.col(c)).alias(c) if m and m > 1 else F.col(c) for c, m in gone.items())), list(gone), 9)


@query("""with m as (select avg((o_orderkey % 8 < 3)::int) as p8, avg((o_orderkey % 2 < 1)::int) as p2, avg((o_orderkey % 3 < 1)::int) as p3 from orders), l as (select *, case when p8 > 0.5 then 'high' when p8 > 0.3 then 'medium' else 'low' end as a, case when p2 > 0.5 then 'high' when p2 > 0.3 then 'medium' else 'low' end as b, case when p3 > 0.5 then 'high' when p3 > 0.3 then 'medium' else 'low' end as c from m)
select 'missing' as kind, 'o_orderpriority' as subject, a as old_priority, c as new_priority, case when a = c then 'same' when c = 'high' or (c = 'medium' and a = 'low') then 'worse' else 'better' end as change from l union all select 'missing', 'o_orderstatus', b, null, 'resolved' from l union all select 'missing', 'o_custkey', null, c, 'new' from l""")
def issue_drift(spark, d):
    return J.issue_drift(_misses(spark, d, 1), _misses(spark, d, 2))


@query()
def weak_points(spark, d):
    return K.weak_points(sales(spark, d), "l_shipdate", "revenue", "sum", ["p_type", "p_brand", "l_returnflag"], "profit", key=["l_orderkey", "l_linenumber"])


DRILLED = """f as (select strftime(l_shipdate, '%Y-%m') as month, l_extendedprice * (1 - l_discount) * case when o_orderpriority = '1-URGENT' and strftime(l_shipdate, '%Y-%m') = '1998-06' then 8 else 1 end as v, c_mktsegment, o_orderpriority from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey where strftime(l_shipdate, '%Y-%m') in ('1998-05', '1998-06')),
l as (select c_mktsegment as segment, month = '1998-06' as after, v from f where o_orderpriority = '1-URGENT'), s as (select segment, coalesce(sum(v) filter (where not after), 0) as b, coalesce(sum(v) filter (where after), 0) as a from l group by 1),
c as (select *, a - b as change, sum(a - b) over () as net, sum(abs(a - b)) over () as gross, max(abs(a - b)) over () as most, count(*) over () as k from s)"""


@query(f"""with {DRILLED} select 'c_mktsegment' as dimension, segment, round(b, 2) as before_value, round(a, 2) as after_value, round(change, 2) as change, round(change * 100 / net, 2) as net_share, round(abs(change) * 100 / gross, 2) as gross_share, abs(net) < 0.2 * gross as offsetting, round(most * 100 / gross - 100.0 / k, 2) as concentration, 1 as dimension_rank from c""", 2)
def driver_drill_planted(spark, d):
    """Urgent orders sold eight times as much in June 1998: the drill goes inside them."""
    x = orders_full(spark, d)
    rose = (F.col("o_orderpriority") == "1-URGENT") & (F.date_format("l_shipdate", "yyyy-MM") == "1998-06")
    x = x.withColumn("revenue", F.when(rose, F.col("revenue") * 8).otherwise(F.col("revenue")))
    return S.drill(x, "l_shipdate", "revenue", "sum", ["c_mktsegment", "o_orderpriority"], ["1998-05"], ["1998-06"])


@query("""with v as (select abs(value) as v from events where value <> 0), c as (select greatest(1, least(9, floor(v / pow(10, floor(log10(v))))))::int as digit, count(*) as n from v group by 1), t as (select count(*) as t from v), g as (select range::int as digit from range(1, 10)),
x as (select sum((coalesce(n, 0) - log10(1 + 1.0 / digit) * t) ** 2 / (log10(1 + 1.0 / digit) * t)) as chi2 from g left join c using (digit), t), h as (select chi2, chi2 / 2 as h from x)
select 'value' as "column", round(chi2, 2) as chi2, round(exp(-h) * (1 + h + h ** 2 / 2 + h ** 3 / 6), 4) as p_value, exp(-h) * (1 + h + h ** 2 / 2 + h ** 3 / 6) < 0.05 as deviates from h""")
def benford_test(spark, d):
    """The test of all digits; its tail has a closed form for eight degrees of freedom."""
    b = R.benford(table(spark, d, "events"), ["value"])
    return b.select("column", F.round("chi2", 2).alias("chi2"), "p_value", "deviates").distinct()


@query("""with n as (select count(*) as rows, count(distinct o_orderkey) as keys from orders) select kind, rows, share from (select 'all' as kind, (select count(*) from orders) as rows, 1.0::double as share union all select 'low', (select count(*) from orders where o_totalprice < (select quantile_cont(o_totalprice, 0.25) from orders)), round((select count(*) from orders where o_totalprice < (select quantile_cont(o_totalprice, 0.25) from orders)) / (select count(*) from orders)::double, 4)
union all select 'top', (select count(*) from orders where o_totalprice > (select quantile_cont(o_totalprice, 0.999) from orders)), round((select count(*) from orders where o_totalprice > (select quantile_cont(o_totalprice, 0.999) from orders)) / (select count(*) from orders)::double, 4))""")
def exact_quantiles(spark, d):
    """Rows beyond exact quantiles: the bracketing search hits the very rank."""
    from tabularium.operators.common import quantiles

    o = table(spark, d, "orders")
    n, (low, high) = quantiles(o, ["o_totalprice"], [0.25, 0.999])["o_totalprice"]
    kinds = F.array(F.lit("all"), F.when(F.col("o_totalprice") < low, "low"), F.when(F.col("o_totalprice") > high, "top"))
    return o.select(F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("rows")).withColumn("share", F.col("rows") / F.lit(float(n)))


@query(f"""with x as (select * from lineitem where l_shipdate >= timestamp '1995-01-01' and l_shipdate < timestamp '2001-01-01' and l_returnflag in ('A', 'R')), j as (select x.*, l_extendedprice * (1 - l_discount) as revenue, c_mktsegment, o_orderpriority from x join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey),
m as (select strftime(l_shipdate, '%Y-%m') as month, sum(revenue) as v, count(*) as n from j group by 1), k as (select *, row_number() over (order by month desc) as k from m), r as (select j.*, k = 1 as after, revenue as v from j join k on strftime(l_shipdate, '%Y-%m') = month where k <= 2),
l as (select 'c_mktsegment' as dimension, c_mktsegment as segment, after, v from r union all select 'o_orderpriority', o_orderpriority, after, v from r), s as (select dimension, segment, coalesce(sum(v) filter (where after), 0) - coalesce(sum(v) filter (where not after), 0) as change from l group by 1, 2),
q as (select quantile_cont(revenue, 0.25) as a, quantile_cont(revenue, 0.75) as b from j), f as (select sum(revenue) as fu, sum(revenue) filter (where revenue between a - 1.5 * (b - a) and b + 1.5 * (b - a)) as tr from j, q)
select 'trend' as analysis, 'revenue' as subject, month as label, null as other, round(v, 1) as value from m union all select 'period', 'revenue', a.month, b.month, round((a.v - b.v) * 100 / abs(b.v), 1) from k a, k b where a.k = 1 and b.k = 2
union all select 'driver', 'revenue', dimension, segment, round(change, 1) from s union all select 'robust', 'revenue', null, null, round((tr - fu) * 100 / abs(fu), 1) from f""", 1)
def filtered_report_tables(spark, d):
    """The filtered report without its seasons, which have SQL of their own."""
    x = A.filter_rows(orders_full(spark, d), "l_shipdate", "1995-01-01", "2000-12-31", {"l_returnflag": ["A", "R"]})
    return report.filtered_report(x, "l_shipdate", "revenue", "sum", ["c_mktsegment", "o_orderpriority"]).where("analysis <> 'season'")


@query("""with x as (select event_type = 'purchase' as b, value as v from events where event_type in ('click', 'purchase')), m as (select b, count(*) as n, avg(v) as m, var_samp(v) as s from x group by 1), r as (select b, rank() over (order by v) + (count(*) over (partition by v) - 1) / 2.0 as r from x),
u as (select sum(r) - count(*) * (count(*) + 1) / 2.0 as u from r where b)
select round((q.m - p.m) / sqrt((p.s + q.s) / 2) * (1 - 3.0 / (4 * (p.n + q.n) - 9)), 4) as hedges_g, round(u / (p.n * q.n), 4) as p_b_greater, round(2 * u / (p.n * q.n) - 1, 4) as rank_biserial, 'welch' as primary_test from m p, m q, u where not p.b and q.b and p.n >= 30 and q.n >= 30""")
def ab_test_effects(spark, d):
    return I.ab_test(table(spark, d, "events"), "event_type", "click", "purchase", "value").where("n_a >= 30 and n_b >= 30").select("hedges_g", "p_b_greater", "rank_biserial", "primary_test")


@query("""with x as (select o_orderpriority = '1-URGENT' as b, o_orderstatus as level from orders where o_orderpriority in ('1-URGENT', '5-LOW')), c as (select level, count(*) filter (where not b) as a, count(*) filter (where b) as b from x group by 1), t as (select sum(a) as na, sum(b) as nb, 1.959963984540054 as z from c),
w as (select level, a / na as p, b / nb as q, (a / na + z ** 2 / (2 * na)) / (1 + z ** 2 / na) as pm, z / (1 + z ** 2 / na) * sqrt(a / na * (1 - a / na) / na + z ** 2 / (4 * na ** 2)) as ph, (b / nb + z ** 2 / (2 * nb)) / (1 + z ** 2 / nb) as qm, z / (1 + z ** 2 / nb) * sqrt(b / nb * (1 - b / nb) / nb + z ** 2 / (4 * nb ** 2)) as qh,
 (a - (a + b) * na / (na + nb)) ** 2 / ((a + b) * na / (na + nb)) + (b - (a + b) * nb / (na + nb)) ** 2 / ((a + b) * nb / (na + nb)) as part, na + nb as n from c, t)
select level, round(q - p - sqrt((q - (qm - qh)) ** 2 + (pm + ph - p) ** 2), 4) as low, round(q - p + sqrt((qm + qh - q) ** 2 + (p - (pm - ph)) ** 2), 4) as high, round(q / p, 4) as relative_risk, round(sqrt(sum(part) over () / n), 4) as cramers_v, round(exp(-sum(part) over () / 2), 4) as p_value from w""")
def ab_rate_effects(spark, d):
    """Three levels, so the chi-square tail has two degrees of freedom and a closed form."""
    return I.ab_rate_test(table(spark, d, "orders"), "o_orderpriority", "5-LOW", "1-URGENT", "o_orderstatus").select("level", "low", "high", "relative_risk", "cramers_v", "p_value")


@query("""select 'table' as kind, 'rows' as subject, null::varchar as label, count(*)::double as value from customer union all select 'table', 'columns', null, 2 union all select 'table', 'completeness_pct', null, 100.0 union all (select 'frequency', 'c_mktsegment', c_mktsegment, count(*) from customer group by 3 order by 4 desc, 3 limit 15) union all (select 'frequency', 'c_nationkey', c_nationkey::varchar, n from (select c_nationkey, count(*) as n from customer group by 1 order by 2 desc, 1 limit 15))""")
def no_metric_customers(spark, d):
    return A.no_metric_report(table(spark, d, "customer").select("c_mktsegment", "c_nationkey"), ["c_mktsegment", "c_nationkey"])


# report jobs


REPORT = f"""{SALES}, ends as (select 'l_quantity' as m, min(l_quantity) as a, max(l_quantity) as b, least(count(distinct l_quantity), 10) as k from sales union all select 'revenue', min(revenue), max(revenue), least(count(distinct revenue), 10) from sales union all select 'profit', min(profit), max(profit), least(count(distinct profit), 10) from sales),
vals as (select 'l_quantity' as m, l_quantity as v from sales union all select 'revenue', revenue from sales union all select 'profit', profit from sales), hist as (select m, least(floor((v - a) / ((b - a) / k)), k - 1)::int as bin, count(*) as n from vals join ends using (m) group by 1, 2),
dim as (select 'p_type' as c, p_type as label, count(*)::double as n, sum(revenue) as v from sales group by 2 union all select 'l_returnflag', l_returnflag, count(*), sum(revenue) from sales group by 2),
cor as (select corr(revenue, profit) as rp, corr(revenue, l_quantity) as rq, corr(profit, l_quantity) as pq from sales)"""


@query(f"""with {REPORT} select analysis, subject, label, round(value, 2) as value, importance, top from (
select 'histogram' as analysis, m as subject, g.range::varchar as label, coalesce(n, 0)::double as value, case when m = 'revenue' then 60 else 50 end as importance, false as top from ends cross join range(10) g left join hist using (m) where g.range < k and (hist.bin = g.range or not exists (select 1 from hist h where h.m = ends.m and h.bin = g.range))
union all select 'trend', 'revenue', strftime(l_shipdate, '%Y-%m'), sum(revenue), 85, true from sales group by 3
union all select 'count', c, label, n, 75, true from dim union all select 'by', c, label, v, 55, false from dim
union all select 'matrix', 'measures', x, r, 40, false from (select unnest(['revenue profit', 'profit revenue', 'revenue l_quantity', 'l_quantity revenue', 'profit l_quantity', 'l_quantity profit', 'revenue revenue', 'profit profit', 'l_quantity l_quantity']) as x, unnest([rp, rp, rq, rq, pq, pq, 1, 1, 1]) as r from cor)
union all select 'pivot', 'l_returnflag x p_type', l_returnflag || ' ' || p_type, sum(revenue), 45, false from sales group by 3)
where (analysis, subject, label) not in (select 'histogram', m, '' from ends)""", 2)
def full_report_tables(spark, d):
    """The report without its sampled points and box plot."""
    x = report.full_report(sales(spark, d).select("l_shipdate", "p_type", "l_returnflag", "l_quantity", "revenue", "profit"), overrides={"l_shipdate": "DATE", "l_returnflag": "CATEGORY"})
    label = F.when(F.col("analysis").isin("matrix", "pivot"), F.concat_ws(" ", "label", "other")).otherwise(F.col("label"))
    return x.where(~F.col("analysis").isin("scatter", "box")).select("analysis", "subject", label.alias("label"), "value", "importance", "top")


@query()
def full_report(spark, d):
    return report.full_report(sales(spark, d).select("l_shipdate", "p_type", "l_returnflag", "l_quantity", "revenue", "profit"), overrides={"l_shipdate": "DATE", "l_returnflag": "CATEGORY"})


@query()
def filtered_report(spark, d):
    x = A.filter_rows(orders_full(spark, d), "l_shipdate", "1995-01-01", "2000-12-31", {"l_returnflag": ["A", "R"]})
    return report.filtered_report(x, "l_shipdate", "revenue", "sum", ["c_mktsegment", "o_orderpriority"])


@query("""select 'table' as kind, 'rows' as subject, null::varchar as label, count(*)::double as value from nation union all select 'table', 'columns', null, 1 union all select 'table', 'completeness_pct', null, 100.0 union all (select 'frequency', 'n_name', n_name, count(*) from nation group by 3 order by 4 desc, 3 limit 15)""")
def no_metric_report(spark, d):
    return A.no_metric_report(table(spark, d, "nation").select("n_name"), ["n_name"])


# filters answered from a cube's cells
def sales_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.build(sales(spark, sf_dir), "l_shipdate", ["l_returnflag", "l_linestatus", "p_brand"], ["revenue", "profit"])


PICKED = """picked as (select *, strftime(l_shipdate, '%Y-%m') as month from sales where l_returnflag in ('A', 'R') and strftime(l_shipdate, '%Y-%m') >= '1995-06')"""


def picked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.pick(sales_cube(spark, sf_dir), {"l_returnflag": ["A", "R"]}, "1995-06")


@query(f"with {SALES}, {PICKED} select month, round(avg(profit), 4) as value from picked group by 1")
def cube_trend(spark, d):
    return U.trend(picked(spark, d), "profit", "avg")


@query(f"""with {SALES}, {PICKED} select p_brand as label, count(*) as rows, round(sum(revenue), 2) as value,
round(count(*) * 100.0 / sum(count(*)) over (), 2) as share_pct from picked group by 1""", 2)
def cube_breakdown(spark, d):
    return U.breakdown(picked(spark, d), "p_brand", "revenue")


@query(f"""with {SALES}, {PICKED}
select 'revenue' as measure, count(revenue) as n, round(sum(revenue), 2) as total, round(avg(revenue), 2) as mean, round(stddev_samp(revenue), 2) as sd, round(min(revenue), 2) as min, round(max(revenue), 2) as max from picked
union all
select 'profit', count(profit), round(sum(profit), 2), round(avg(profit), 2), round(stddev_samp(profit), 2), round(min(profit), 2), round(max(profit), 2) from picked""", 2)
def cube_summary(spark, d):
    return U.summary(picked(spark, d))


@query(f"""with {SALES}, {PICKED}, m as (select month, row_number() over (order by month desc) as k from picked group by 1),
l as (select m.k, p.revenue, unnest([{{'dimension': 'l_returnflag', 'segment': l_returnflag}}, {{'dimension': 'l_linestatus', 'segment': l_linestatus}}, {{'dimension': 'p_brand', 'segment': p_brand}}], recursive := true)
  from picked p join m using (month) where m.k <= 2)
select dimension, segment, round(coalesce(sum(revenue) filter (where k = 2), 0), 2) as before_value, round(coalesce(sum(revenue) filter (where k = 1), 0), 2) as after_value,
round(coalesce(sum(revenue) filter (where k = 1), 0) - coalesce(sum(revenue) filter (where k = 2), 0), 2) as change from l group by 1, 2""", 2)
def cube_drivers(spark, d):
    return U.drivers(picked(spark, d), "revenue")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
