"""URL filters by a sort-merge range join.

A host's canonical key is its labels in reverse, each with an end mark; all
hosts below a rule's host are one interval of that order, and such intervals
nest or are disjoint. Urls and rule hosts are sorted together and dealt into
contiguous ranges. The stack of nested rule hosts that is active at a url is the
stack of the last rule host before it, less those whose interval has ended
(those whose key isn't a prefix of the url's). Each rule host carries its stack,
so a running last value is the whole sweep; a range begins with the stack that
the ranges before it leave.

The url then meets the path rules of each host on its stack. These are
intervals again: rules and urls of a rule host are sorted by path, and each rule
carries the stack of rules whose path is a prefix of its own.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ascii_lower, cut, shuffle_width

#: Rules of the contract: (action, host, path).
DEFAULT_RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: The verdict where no rule fits: a filter blocks only what it names.
DEFAULT_VERDICT = "allow"
#: Ends each label of a key; it sorts before all that a host may hold.
END = "\u0001"
#: Rows of counts by rule host up to which they are broadcast.
BROADCAST_HOSTS = 100_000


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url; both empty where it is null or has no ``://``."""
    start = F.locate("://", url)
    rest = F.when(start > 0, F.substring(url, start + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    raw = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return ascii_lower(raw), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def reversed_key(host: Column) -> Column:
    """``www.example.com`` as ``com|example|www|``, with END for the bars (where a host itself holds that character, the next one stands for it)."""
    return F.concat(F.array_join(F.reverse(F.split(F.translate(host, END, "\u0002"), r"\.")), END), F.lit(END))


def _host_of(rkey: Column) -> Column:
    """The host of a key."""
    return F.array_join(F.reverse(F.split(F.substring(rkey, F.lit(1), F.length(rkey) - 1), END)), ".")


def rule_table(spark, rules: Iterable[tuple[str, str, str]]) -> DataFrame:
    """``rules`` (action, host, path) as a table of constants."""
    rows = [F.struct(F.lit(a).alias("action"), F.lit(h).alias("host"), F.lit(p).alias("path")) for a, h, p in rules]
    kind = "array<struct<action: string, host: string, path: string>>"
    return spark.range(1).select(F.inline(F.array(*rows).cast(kind) if rows else F.from_json(F.lit("[]"), kind)))


def _stacks(rules: DataFrame) -> DataFrame:
    """Each distinct rule with the rules of its host that contain it, outermost first, itself last.

    Where the same host and path is both allowed and blocked, it is blocked.
    The work is the summed length of the rules' paths: prefixes meet rules by
    equality.
    """
    own = rules.groupBy("rkey", "path").agg(F.max("action").alias("action"))  # "block" sorts after "allow"
    lengths = F.transform(F.sequence(F.lit(0), F.length("path")), lambda n: n)
    prefixes = own.select("rkey", "path", F.explode(lengths).alias("_n")).select("rkey", "path", F.substring("path", F.lit(1), F.col("_n")).alias("_outer"))
    outer = own.select("rkey", F.col("path").alias("_outer"), F.col("action").alias("_action"))
    return (
        prefixes.join(outer, ["rkey", "_outer"])
        .groupBy("rkey", "path")
        .agg(F.sort_array(F.collect_list(F.struct(F.length("_outer").alias("n"), F.col("_outer").alias("path"), F.col("_action").alias("action")))).alias("_stack"))
    )


def _host_stacks(hosts: DataFrame) -> DataFrame:
    """Each rule host (rkey) with the rule hosts that contain it, outermost first, itself last: ``_hosts``.

    The work is the rules' labels: a host's own ancestors meet rule hosts by equality.
    """
    labels = F.split(F.substring("rkey", F.lit(1), F.length("rkey") - 1), END)
    ancestors = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.concat(F.array_join(F.slice(labels, F.lit(1), n), END), F.lit(END)))
    outer = hosts.select("rkey", F.explode(ancestors).alias("_outer")).join(hosts.select(F.col("rkey").alias("_outer")), "_outer")
    return outer.groupBy("rkey").agg(F.transform(F.sort_array(F.collect_list(F.struct(F.length("_outer").alias("n"), "_outer"))), lambda r: r["_outer"]).alias("_hosts"))


def _active_hosts(urls: DataFrame, hosts: DataFrame, width: int) -> DataFrame:
    """``urls`` (host, path) with ``rkey``, once for each rule host whose interval holds theirs, and ``_depth``, its place on the stack."""
    kind = "array<string>"
    lookups = urls.select(reversed_key(F.col("host")).alias("key"), "path", "host", F.lit(None).cast(kind).alias("_hosts"))
    rules = _host_stacks(hosts).select(F.col("rkey").alias("key"), F.lit("").alias("path"), F.lit(None).cast("string").alias("host"), "_hosts")
    # Contiguous ranges of the order, written so that a range is the same in all that follows.
    ranged = cut(lookups.unionByName(rules).repartitionByRange(width, "key", "path").withColumn("_range", F.spark_partition_id()))
    # The last rule host of each range, and so the stack with which the next one begins: one row for each range.
    ends = ranged.where("_hosts IS NOT NULL").groupBy("_range").agg(F.max_by("_hosts", "key").alias("_end"))
    ranges = ranged.select("_range").distinct().join(ends, "_range", "left")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    begins = ranges.select("_range", F.last("_end", ignorenulls=True).over(before).alias("_begin"))
    # A host's rule comes before its urls, all of which have the same key.
    sweep = Window.partitionBy("_range").orderBy("key", F.col("host").isNotNull(), "path").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stack = F.coalesce(F.last("_hosts", ignorenulls=True).over(sweep), F.col("_begin"))
    active = F.filter("_stack", lambda k: F.startswith(F.col("key"), k))
    swept = ranged.join(F.broadcast(begins), "_range").withColumn("_stack", stack).where("host IS NOT NULL")
    return swept.select("host", "path", F.posexplode(active).alias("_depth", "rkey"))


def filter_urls(
    pages: DataFrame,
    rules: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = DEFAULT_VERDICT,
) -> DataFrame:
    """One row per row of ``pages``: ``<id_col>, host, path, rule, verdict``.

    ``rules`` has action ('allow' or 'block'), host and path. A rule fits its
    host and all subdomains where the url's path starts with the rule's; the
    longest wins: the longest host, and within it the longest path. ``rule`` is
    host and path together, null where none fits and ``default`` decides. A null
    url or one without ``://`` has an empty host and path and fits no rule.
    Repeated rows and ids each get their verdict. Empty tables give no rows; with
    no rules ``default`` decides everything.
    """
    spark = pages.sparkSession
    host, path = split_url(F.col(url_col))
    urls = pages.select(F.col(id_col).alias("_id"), host.alias("host"), path.alias("path"))
    keyed = rules.select(
        F.lower("action").alias("action"),
        reversed_key(ascii_lower(F.col("host"))).alias("rkey"),
        F.coalesce(F.col("path"), F.lit("")).alias("path"),
    ).where((F.col("host") != "") & F.col("action").isin("allow", "block"))
    stacks = _stacks(keyed)

    # What is looked up is a distinct (host, path); a hot pair so costs one row.
    width = 4 * shuffle_width(spark)
    distinct = urls.where(F.col("host") != "").groupBy("host", "path").agg(F.count(F.lit(1)).alias("_c"))
    hosts = keyed.select("rkey").distinct()
    few = hosts.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS
    probes = _active_hosts(distinct.select("host", "path"), hosts, shuffle_width(spark))

    # A host's urls are dealt over as many cells as its share of all lookups asks for; its rules go to each of them.
    fair = max(64, -(-pages.count() // width))
    ways = probes.groupBy("rkey").agg(F.ceil(F.count(F.lit(1)) / F.lit(fair)).cast("int").alias("_ways"))
    # One row for each rule host at most, as in ``hosts``: where they are few, the lookups stay where they are.
    ways = F.broadcast(ways) if few else ways
    dealt = probes.join(ways, "rkey").select(
        "rkey", F.pmod(F.xxhash64("host", "path"), F.col("_ways")).cast("int").alias("_cell"), "path", "host", "_depth", F.lit(None).cast(stacks.schema["_stack"].dataType).alias("_stack")
    )
    copies = stacks.join(ways, "rkey").select(
        "rkey", F.explode(F.sequence(F.lit(0), F.col("_ways") - 1)).alias("_cell"), "path", F.lit(None).cast("string").alias("host"), F.lit(-1).alias("_depth"), "_stack"
    )
    sweep = Window.partitionBy("rkey", "_cell").orderBy("path", F.col("_stack").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    active = F.filter(F.last("_stack", ignorenulls=True).over(sweep), lambda r: F.startswith(F.col("path"), r["path"]))
    found = (
        dealt.unionByName(copies)
        .withColumn("_last", F.try_element_at(active, F.lit(-1)))
        .where(F.col("host").isNotNull() & F.col("_last").isNotNull())
        .groupBy("host", "path")
        .agg(F.max(F.struct("_depth", _host_of(F.col("rkey")).alias("h"), F.col("_last.path").alias("p"), F.col("_last.action").alias("a"))).alias("_best"))
    )
    return urls.join(found, ["host", "path"], "left").select(
        F.col("_id").alias(id_col),
        "host",
        "path",
        F.concat(F.col("_best.h"), F.col("_best.p")).alias("rule"),
        F.coalesce(F.col("_best.a"), F.lit(default)).alias("verdict"),
    )
