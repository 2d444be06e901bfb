"""URL filters as a sort-merge range join, by DataFrame functions alone.

A rule is a host and a path; it fits its host and all subdomains if the URL's path starts with the rule's. Hosts are keyed by
their reversed labels (net, example, www), each ended by a separator, so the keys that a rule's host fits are one interval, and
two hosts' intervals are nested or apart. An interval opens at its key and closes where the next sibling could begin; these
boundaries and the URLs are swept in one order. The sweep keeps a stack of the hosts whose intervals are open: an opening is
pushed onto the slot of its depth, a closing takes the depth down by one, and what lies above the depth is off the stack. A URL
takes the stack as the last boundary before it left it; of its rules that fit by path, the longest decides.

The sweep runs in ranges of keys (host, then path). Their bounds are quantiles of bounded random samples of the URLs and of the
rules; any bounds give the same result. A range begins with the depth and the stack that the ranges before leave: sums and last
openings by range, carried along as many rows as there are ranges. A key that fills several quantiles, such as one very frequent
URL, gives a range as many shares, each with the boundaries repeated, so neither a frequent host nor a frequent URL is left to
one task. URLs are shuffled once, alone with their ids; the driver gets the samples, of SAMPLE keys each, and the greatest depth.

Cases: a null URL and one without `://` have empty host and path; an empty rule host fits every host; of two longest rules the
one with the longer host decides, then block before allow; without rules every verdict is the default; repeated rows are judged
each; URLs of any length are read whole; an empty table gives no rows. Only the id and URL columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bomweave.llm.common import materialize, rank_in, shuffle_partitions

#: Keys drawn to choose the bounds between ranges.
SAMPLE = 20_000
#: Ranges for each shuffle partition, by the URLs and again by the rules.
RANGES = 2
_SEPARATOR, _AFTER = "\x01", "\x02"


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (lower-cased) and path of a URL; both empty for a null one and one without `://`."""
    at = F.coalesce(F.locate("://", url), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return lower_ascii(F.regexp_extract(rest, "\\A([^/?#]*)", 1)), F.regexp_extract(rest, "\\A[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    """The reversed labels, each ended by the separator; empty for an empty host."""
    return F.when(host == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split(host, "\\.")), _SEPARATOR), F.lit(_SEPARATOR)))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules given as (host, path, verdict), as literals of a plan."""
    own = [F.struct(*(F.lit(v).alias(n) for n, v in zip(("host", "path", "verdict"), rule, strict=True))) for rule in rules]
    empty = F.array().cast("array<struct<host:string,path:string,verdict:string>>")
    return spark.range(1).select(F.inline(F.array(*own) if own else empty))


def boundaries(rules: DataFrame) -> DataFrame:
    """(place, step, entries): where each rule host's interval opens (1, with its rules) and closes (-1); that of no host never closes."""
    host = lower_ascii(F.coalesce("host", F.lit("")))
    path = F.coalesce("path", F.lit(""))
    size = F.length(F.concat(host, path))
    entry = F.struct(size.alias("size"), F.length(host).alias("host_size"), (F.col("verdict") == "block").alias("block"), host.alias("host"), path.alias("path"), F.concat(host, path).alias("rule"), F.col("verdict").alias("verdict"))
    hosts = rules.select(host_key(host).alias("key"), entry.alias("entry")).groupBy("key").agg(F.collect_set("entry").alias("entries"))
    opens = F.struct(F.col("key").alias("place"), F.lit(1).alias("step"), F.col("entries").alias("entries"))
    end = F.concat(F.expr("left(key, length(key) - 1)"), F.lit(_AFTER))
    closes = F.struct(end.alias("place"), F.lit(-1).alias("step"), F.lit(None).cast(hosts.schema["entries"].dataType).alias("entries"))
    return hosts.select(F.inline(F.when(F.col("key") == "", F.array(opens)).otherwise(F.array(opens, closes))))


def _quantiles(places: DataFrame, n: int) -> list[str]:
    """n - 1 quantiles of a sample of at most about SAMPLE places, repeated where a place is frequent."""
    rows = places.count()
    drawn = sorted(r.place for r in places.select("place").sample(min(1.0, SAMPLE / max(rows, 1)), 7).limit(2 * SAMPLE).collect())
    return [drawn[len(drawn) * i // n] for i in range(1, n)] if drawn else []


def swept_rules(events: DataFrame, n_ranges: int) -> DataFrame:
    """(range, place, step, stack): the stack after each boundary of events (range, place, step, entries), and at the start of each range.

    The start of a range stands at the empty place, with step -2.
    """
    spark = events.sparkSession
    ranges = spark.range(n_ranges).select(F.col("id").cast("int").alias("range"))
    so_far = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # over as many rows as ranges
    steps = ranges.join(events.groupBy("range").agg(F.sum("step").alias("net")), "range", "left")
    base = materialize(steps.select("range", F.coalesce(F.sum("net").over(so_far), F.lit(0)).cast("int").alias("base")), "depths")
    sweep = Window.partitionBy("range").orderBy("place", "step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    deep = materialize(events.join(base, "range").withColumn("depth", (F.col("base") + F.sum("step").over(sweep)).cast("int")), "boundaries")
    slots = range(1, (deep.agg(F.max("depth")).first()[0] or 0) + 1)
    pushed = [F.when((F.col("step") == 1) & (F.col("depth") == d), F.col("entries")) for d in slots]
    order = F.struct("place", "step")
    last = deep.groupBy("range").agg(F.count("*").alias("n"), *(F.max_by(p, F.when(p.isNotNull(), order)).alias(f"slot{d}") for d, p in zip(slots, pushed, strict=True)))
    carried = base.join(last, "range", "left").select("range", "base", *(F.last(f"slot{d}", True).over(so_far).alias(f"slot{d}") for d in slots))
    carried = materialize(carried, "carried")
    stack = lambda found, depth: F.flatten(F.slice(F.array(*found), F.lit(1), depth)) if found else F.lit(None)
    kind = deep.schema["entries"].dataType.simpleString()
    starts = carried.select("range", F.lit("").alias("place"), F.lit(-2).alias("step"), stack([F.col(f"slot{d}") for d in slots], F.col("base")).cast(kind).alias("stack"))
    inner = deep.drop("base").join(carried, "range")
    own = [F.coalesce(F.last(p, True).over(sweep), F.col(f"slot{d}")).alias(f"own{d}") for d, p in zip(slots, pushed, strict=True)]
    swept = inner.select("range", "place", "step", "depth", *own)
    return starts.unionByName(swept.select("range", "place", "step", stack([F.col(f"own{d}") for d in slots], F.col("depth")).cast(kind).alias("stack")))


def judge(urls: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """id, host, path, rule and verdict of each URL, by rules with columns host, path and verdict (allow or block)."""
    host, path = host_and_path(F.col("url"))
    rows = urls.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url")).select("id", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("place", F.concat(host_key(F.col("host")), F.lit(_AFTER), "path"))
    events = materialize(boundaries(rules), "rule-boundaries")

    parts = RANGES * shuffle_partitions(urls.sparkSession)
    often = _quantiles(rows, parts)
    bounds = sorted({*often, *_quantiles(events, parts)})
    shares = F.lit([1, *(1 + often.count(b) for b in bounds)])  # of each range
    cuts = F.lit(bounds) if bounds else F.array().cast("array<string>")
    in_range = rank_in(cuts, len(bounds), F.col("place"))

    states = materialize(swept_rules(events.withColumn("range", in_range), len(bounds) + 1), "rule-stacks")
    salt = F.explode(F.sequence(F.lit(0), F.get(shares, F.col("range")) - 1)).alias("salt")
    nothing = {"id": rows.schema["id"].dataType, "host": "string", "path": "string"}
    states = states.select("range", salt, "place", "step", "stack", *(F.lit(None).cast(t).alias(c) for c, t in nothing.items()))
    dealt = rows.withColumn("range", in_range).withColumn("salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.get(shares, F.col("range"))).cast("int"))
    swept = states.unionByName(dealt.select("range", "salt", "place", F.lit(2).alias("step"), "id", "host", "path"), allowMissingColumns=True)

    sweep = Window.partitionBy("range", "salt").orderBy("place", "step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    active = swept.withColumn("stack", F.last("stack", True).over(sweep)).where("step = 2")
    fits = lambda e: ((e["host"] == "") | (F.col("host") == e["host"]) | F.col("host").endswith(F.concat(F.lit("."), e["host"]))) & F.col("path").startswith(e["path"])
    best = F.array_max(F.filter("stack", fits))
    return active.select("id", "host", "path", best.alias("best")).select(
        F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )
