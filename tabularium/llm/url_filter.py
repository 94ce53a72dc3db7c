"""URL allow and block rules as a sort-merge range join (DataFrame functions only)."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabularium.llm.common import hash_sample

#: Keys sampled for each range, to find where ranges are cut; ranges are cut in two levels of at most so many each.
SAMPLE, LEVEL = 16, 64
#: Rows of a range on average, up to LEVEL * LEVEL ranges; beyond, ranges get longer (a sweep streams them).
RANGE_ROWS = 50_000

PRODUCTION_RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    return F.coalesce(F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ? # or the end; empty without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    """Labels in reverse, each followed by a dot: a domain's key is a prefix of its subdomains' keys."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def _cuts(keys: DataFrame, n: int, key: str) -> list[list[str]]:
    """Borders of ranges of about RANGE_ROWS keys, in groups of up to LEVEL; from a sample by hash of at most SAMPLE keys a range."""
    ranges = min(LEVEL * LEVEL, -(-n // RANGE_ROWS))
    if ranges < 2:
        return []
    got = sorted((r[0] for r in hash_sample(keys, n, SAMPLE * ranges, *keys.columns).select(key).collect()), key=lambda s: s.encode())
    cuts = [got[len(got) * i // ranges] for i in range(1, ranges)] if got else []
    return [cuts[i : i + LEVEL] for i in range(0, len(cuts), LEVEL)]


def _range_of(cuts: list[list[str]], key: Column) -> Column:
    """How many borders are not above key."""
    if not cuts:
        return F.lit(0)
    heads = F.array(*(F.lit(c[0]) for c in cuts))
    group = F.size(F.filter(heads, lambda s: s <= key))
    inside = F.element_at(F.array(*(F.array(*map(F.lit, c)) for c in cuts)), F.greatest(group, F.lit(1)))
    return F.when(group == 0, 0).otherwise((group - 1) * LEVEL + F.size(F.filter(inside, lambda s: s <= key))).cast("int")


def _nested(starts: DataFrame) -> DataFrame:
    """Adds stack to rules (key, given): those whose key is a prefix of this one's, itself included - the intervals that are open where this one begins.

    Rules meet by their keys' prefixes of the lengths that rules have; a stack is no longer than a key.
    """
    keys = starts.select("key")
    lengths = keys.agg(F.array_sort(F.collect_set(F.length("key"))).alias("lengths"))
    prefixes = keys.crossJoin(F.broadcast(lengths)).select("key", F.explode(F.filter("lengths", lambda n: n <= F.length("key"))).alias("n")).select("key", F.expr("left(key, n)").alias("above"))
    outer = starts.select(F.col("key").alias("above"), F.struct("key", "given").alias("open"))
    return prefixes.join(outer, "above").groupBy("key").agg(F.sort_array(F.collect_list("open")).alias("stack"))


def sweep(rows: DataFrame, starts: DataFrame, key: str) -> DataFrame:
    """Adds open to rows: [(key, given), ...] of the rules whose key is a prefix of the row's, shortest first.

    A rule's key is the interval of all strings that begin with it; intervals nest or are apart. Rows and rule starts are sorted together in ranges of keys, and the
    latest start that the sweep has met carries the stack of intervals that were open there; those that a row's key has left are popped. A range also gets the start that is
    the latest before it. starts: key (each once), given.
    """
    cuts = _cuts(rows, rows.count(), key)
    place = _range_of(cuts, F.col("key"))
    rules = _nested(starts).withColumn("range", place)
    # the latest start before each range: that of the last range with any before it
    latest = rules.groupBy("range").agg(F.max(F.struct("key", "stack")).alias("last"))
    ranges = rows.sparkSession.range(sum(map(len, cuts)) + 1).select(F.col("id").cast("int").alias("range"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # over the ranges, LEVEL * LEVEL at most
    carried = ranges.join(latest, "range", "left").select("range", F.last("last", ignorenulls=True).over(before).alias("last")).where("last is not null").select(F.col("last.key").alias("key"), F.col("last.stack").alias("stack"), "range", F.lit(0).alias("kind"))
    starts = rules.select("key", "stack", "range", F.lit(1).alias("kind")).unionByName(carried)
    both = rows.withColumn("range", _range_of(cuts, F.col(key))).withColumn("at", F.col(key)).withColumn("kind", F.lit(2)).unionByName(starts.withColumnRenamed("key", "at"), allowMissingColumns=True)
    along = Window.partitionBy("range").orderBy(F.when(F.col("kind") > 0, F.col("at")).asc_nulls_first(), "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = both.withColumn("stack", F.last("stack", ignorenulls=True).over(along)).where("kind = 2")
    fits = F.filter(F.coalesce("stack", F.array().cast(swept.schema["stack"].dataType)), lambda r: F.startswith(F.col(key), r["key"]))
    return swept.select(*rows.columns, fits.alias("open"))


def judge(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """Adds host, path, rule and verdict to pages.

    rules: columns host, path, verdict. A rule fits its host and all subdomains if the url's path starts with the
    rule's path; of those that fit, the one with the longest host + path wins (ties: the greater string, then
    `block`). No fit: rule null, verdict `default`.

    Two sweeps over the different hosts and paths. The first sorts reversed-host keys and finds the rules' hosts that each host lies in (at most as many as
    it has labels); the second sorts those hosts' keys with the url's path behind and finds the rules whose path begins the url's. A url that
    a large share of rows has is judged once, and a host with many urls is cut into several ranges.

    Null urls and urls without :// have empty host and path, and no rule fits them unless its host is empty. Repeated rows each
    get their verdict, null ids too; urls may be of any length; an empty table or no rules at all are fine. Further columns pass through;
    host, path, rule and verdict of pages are replaced.
    """
    pages = pages.drop("host", "path", "rule", "verdict")
    urls = pages.select(host_of(F.col(f"`{url_col}`")).alias("host"), path_of(F.col(f"`{url_col}`")).alias("path")).distinct()
    mark = F.struct(F.length(F.concat("host", "path")).alias("n"), F.concat("host", "path").alias("rule"), "verdict")
    rules = rules.where("host is not null and path is not null and verdict is not null").select(host_key(F.col("host")).alias("zone"), "path", mark.alias("mark"))
    hosts = urls.select("host").distinct().withColumn("key", host_key(F.col("host")))
    zones = rules.select(F.col("zone").alias("key")).distinct().withColumn("given", F.col("key"))
    inside = sweep(hosts, zones, "key").select("host", F.explode("open").alias("zone")).select("host", "zone.key")
    # "/" can't be in a host, so no host's key goes on into another's path
    asked = urls.join(inside, "host").select("host", "path", F.concat("key", F.lit("/"), "path").alias("key"))
    full = rules.groupBy(F.concat("zone", F.lit("/"), "path").alias("key")).agg(F.max("mark").alias("given"))
    best = sweep(asked, full, "key").select("host", "path", F.array_max(F.transform("open", lambda r: r["given"])).alias("best")).where("best is not null")
    best = best.groupBy("host", "path").agg(F.max("best").alias("best"))
    names = pages.columns
    keyed = pages.toDF(*(f"c{i}" for i in range(len(names))))
    url = F.col(f"c{names.index(url_col)}")
    out = keyed.withColumns({"host": host_of(url), "path": path_of(url)}).join(best, ["host", "path"], "left")
    out = out.select(*keyed.columns, "host", "path", F.col("best.rule").alias("rule"), F.coalesce(F.col("best.verdict"), F.lit(default)).alias("verdict"))
    return out.toDF(*names, "host", "path", "rule", "verdict")


def op3_url_filter(spark, sf_dir: str) -> DataFrame:
    """The verdict on every page's url under the five production rules."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    rules = spark.createDataFrame(list(PRODUCTION_RULES), "host string, path string, verdict string")
    return judge(pages, rules).select("page_id", "host", "path", "rule", "verdict")


OP3_SQL = """
with u as (
  select page_id, coalesce(case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end, '') as rest from pages
), p as (
  select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u
), r(rhost, rpath, verdict) as (
  values ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), m as (
  select p.page_id, max_by(rhost || rpath, length(rhost || rpath)) as rule, max_by(verdict, length(rhost || rpath)) as verdict
  from p join r on (p.host = rhost or ends_with(p.host, '.' || rhost)) and starts_with(p.path, rpath)
  group by p.page_id
)
select p.page_id, p.host, p.path, m.rule, coalesce(m.verdict, 'allow') as verdict from p left join m using (page_id)
"""
