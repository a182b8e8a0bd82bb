"""URL filters by a sort-merge range join.

A rule ``(host, path)`` becomes the interval of keys that start with ``reversed host + '/' + path``; a URL gets one key
for its host and one for each parent domain. Intervals of prefixes are nested or apart, so the rules that are active at a key form a
stack. Where an interval begins, its rule is pushed; where it ends, the rule below it comes back. A sweep over the sorted ends of all intervals
finds the depth of the stack at each, hence the rule below each, and a second one, over the ends and the URL keys, finds the top of the
stack at each key: the longest rule that fits. Both sweeps run in range partitions, and what is active at the end of a
partition is carried into the next ones. Only DataFrame expressions run here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, lower_ascii

#: allow and block rules of the registered query, as (host, path, verdict).
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
#: What a URL gets that no rule fits.
DEFAULT_VERDICT = "allow"


def rules_frame(spark: SparkSession, rules=RULES) -> DataFrame:
    """``rules`` as a DataFrame (host, path, verdict), built on the JVM."""
    rows = [F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in rules]
    empty = F.expr("CAST(array() AS array<struct<host:string,path:string,verdict:string>>)")
    return spark.range(1).select(F.explode(F.array(*rows) if rows else empty).alias("r")).select("r.*")


def host_of(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def _reversed(labels: Column) -> Column:
    return F.array_join(F.reverse(labels), ".")


#: A rule on the stack; the longer one is the larger one, and of two of the same length that of the longer host.
RULE = "struct<len:int,host_len:int,verdict:string,rule:string>"


def _ranged(rows: DataFrame, n: int, order: list[str]) -> DataFrame:
    """``rows`` in ranges of ``order``, with the number of their range (``part``), written once."""
    return cut(rows.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()))


def _earlier_parts(rows: DataFrame, n: int, value: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """(part, by, carried): the last ``value`` of an aggregate over ``rows`` that some earlier range has. One row a range, and for each of ``by``, at most."""
    ends = rows.groupBy("part", *by).agg(value.alias("end"))
    groups = ends.select(*by).distinct() if by else rows.sparkSession.range(1).select()
    grid = groups.select(*by, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("part"))
    sweep = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return grid.join(ends, ["part", *by], "left").select("part", *by, F.last("end", True).over(sweep).alias("carried"))


def _interval_ends(rules: DataFrame, n: int) -> DataFrame:
    """(key, kind, top): both ends of the interval of each rule (kind 0 and 2), and the rule that is on top of the stack behind it, if any."""
    host = lower_ascii(F.col("host"))
    rule = F.struct((F.length("host") + F.length("path")).alias("len"), F.length("host").alias("host_len"), "verdict", F.concat("host", "path").alias("rule"))
    keyed = (
        rules.where("host IS NOT NULL AND path IS NOT NULL")
        .select(F.concat(_reversed(F.split(host, r"\.")), F.lit("/"), F.col("path")).cast("binary").alias("key"), rule.alias("rule"))
        .groupBy("key")
        .agg(F.max("rule").alias("rule"))  # of equal keys, block before allow
    )
    # No text holds the byte FF, so it comes after all that a key can go on with.
    begin = keyed.select("key", F.lit(0).alias("kind"), F.lit(1).alias("step"), "rule")
    end = keyed.select(F.concat("key", F.unhex(F.lit("FF"))).alias("key"), F.lit(2).alias("kind"), F.lit(-1).alias("step"), F.lit(None).cast(RULE).alias("rule"))
    order = ["key", "kind"]
    ends = _ranged(begin.unionByName(end), n, order)
    # The depth of the stack: a running sum in each range, on top of what earlier ranges leave open.
    opened = ends.groupBy("part").agg(F.sum("step").alias("open"))
    before = opened.select("part", F.coalesce(F.sum("open").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    running = F.sum("step").over(Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # At most n rows, so the broadcast is bounded by the number of partitions.
    deep = cut(ends.withColumn("depth", running).join(F.broadcast(before), "part").withColumn("depth", (F.col("depth") + F.col("before")).cast("int")).drop("before"))
    # Behind the end of an interval the stack is as deep as before its beginning; on top is the last rule that was pushed at that depth.
    pushed = deep.where("kind = 0").select("part", "key", "kind", F.col("depth").alias("level"), F.struct("rule").alias("pushed"))
    asked = deep.where("kind = 2").select("part", "key", "kind", F.col("depth").alias("level"), F.lit(None).cast(f"struct<rule:{RULE}>").alias("pushed"))
    here = F.last("pushed", True).over(Window.partitionBy("part", "level").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    below = pushed.unionByName(asked).withColumn("here", here).where("kind = 2")
    carried = _earlier_parts(pushed, n, F.max_by("pushed", "key"), ("level",))
    # At the depth 0 nothing is active, whatever was pushed last at any other one.
    popped = below.join(carried, ["part", "level"], "left").select("key", "kind", F.when(F.col("level") > 0, F.coalesce("here", "carried")["rule"]).alias("top"))
    return deep.where("kind = 0").select("key", "kind", F.col("rule").alias("top")).unionByName(popped)


def judge_urls(pages: DataFrame, rules: DataFrame, *, id_col: str = "page_id", url_col: str = "url", default: str = DEFAULT_VERDICT, partitions: int | None = None) -> DataFrame:
    """Each row of ``pages`` with host, path, and rule and verdict of the longest rule that fits.

    A null URL, or one without ``://``, has an empty host and path: no rule fits, and ``default`` is its verdict.
    Repeated rows and null ids are kept as they are; an empty table gives no rows, no rules give ``default`` everywhere.
    Of rules with the same host and path, block wins; of two fitting rules as long as each other, the one of the longer host.
    Only ``id_col`` and ``url_col`` are read, so other columns may have any name.
    """
    spark = pages.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    url = F.col(url_col)
    parsed = cut(pages.select(F.col(id_col).alias("page_id"), F.monotonically_increasing_id().alias("row"), host_of(url).alias("host"), path_of(url).alias("path")))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.concat(_reversed(F.slice(labels, -k, k)), F.lit("/"), F.col("path")).cast("binary"))
    keys = parsed.where("host <> ''").select("row", F.explode(suffixes).alias("key")).select("row", "key", F.lit(1).alias("kind"), F.lit(None).cast(f"struct<top:{RULE}>").alias("state"))
    ends = _interval_ends(rules, n).select(F.lit(None).cast("long").alias("row"), "key", "kind", F.struct("top").alias("state"))
    order = ["key", "kind", "row"]
    ranged = _ranged(keys.unionByName(ends), n, order)
    sweep = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = ranged.withColumn("here", F.last("state", True).over(sweep)).where("kind = 1")
    # At most n rows, so the broadcast is bounded by the number of partitions.
    carried = _earlier_parts(ranged.where("state IS NOT NULL"), n, F.max_by("state", F.struct("key", "kind")))
    top = F.coalesce("here", "carried")["top"]
    hits = swept.join(F.broadcast(carried), "part", "left").select("row", top.alias("top")).where("top IS NOT NULL").groupBy("row").agg(F.max("top").alias("top"))
    return parsed.join(hits, "row", "left").select("page_id", "host", "path", F.col("top.rule").alias("rule"), F.coalesce("top.verdict", F.lit(default)).alias("verdict"))
