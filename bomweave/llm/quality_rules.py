"""Quality rules with adaptive thresholds, by DataFrame functions alone.

Fixed rules fail a document of too few words or of mostly repeated three-word windows. The others compare a document with
those of its own language and source: each measure (integers, in thousandths) goes into a quantile sketch of its group, a
log-linear histogram whose buckets keep the 7 leading bits of a value, so a quantile is right within 1/64. Such sketches merge
by adding counts: those of a language's sources into that of the language, those of the languages into one. A group's quartiles
are drawn towards its language's by as much as `weight` documents weigh beside its own, and a language's in the same way towards
those of all documents, so there is no size at which the rule changes; words are of a length of their own in every language, so
no language's word lengths are drawn towards those of others. A measure is out of bounds if it is further from the median than
`reach` times the quartile distance on the median's other side (so that junk, which lies on one side, doesn't widen its own
bound), or than `reach` times the measure's smallest distance. Bounds are a small table, joined to the documents by language and
source.

The measures are computed once, in one narrow pass over whole texts, and written to the shared folder. The sketch is a count
with map-side sums. The bounds are written too, so the join broadcasts them where their size is known to be small and else
shuffles, where Spark splits a frequent group.

Cases: a null text has no words; a text without words fails; null language or source is a group of its own; repeated rows are
judged each and count each; an empty table gives no rows; column names may hold any character. Windows of a text are told apart
by 64-bit hashes. Texts of any length are read whole, and as arrays in memory: the longest text has to fit a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bomweave.llm.common import materialize, quoted, words

#: Smallest distance from the median, in thousandths, that counts as one quartile distance; lower and upper bound or upper only.
MEASURES = {"word_length": (300, True), "symbols": (25, False), "dup_lines": (80, False), "repeats": (80, False)}
#: Measures whose quartiles are a language's own.
OWN_OF_LANGUAGE = ("word_length",)
#: Documents that the quartiles of a group's parent weigh as much as.
WEIGHT = 200
REACH = 5
LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50


def measured(docs: DataFrame, text: Column, *others: Column) -> DataFrame:
    """The other columns and, of each row's whole text, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    names = [f"_other{i}" for i in range(len(others))]
    kept = [c.alias(n) for c, n in zip(others, names, strict=True)]
    own = docs.select(*kept, words(text).alias("w"), lines.alias("l"))
    window = lambda x, i: F.xxhash64(x, F.get("w", i + 1), F.get("w", i + 2))
    own = own.select(
        *names, F.size("w").cast("long").alias("n_words"), F.array_join("w", "").alias("joined"), F.size("l").cast("long").alias("n_lines"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("w") >= 3, F.transform(F.slice("w", F.lit(1), F.greatest(F.size("w") - 2, F.lit(0))), window)).otherwise(F.array().cast("array<bigint>")).alias("h"),
    )
    counts = ["n_words", "n_lines", "n_dup_lines"]
    own = own.select(
        *names, *counts, F.length("joined").cast("long").alias("word_chars"), F.length(F.regexp_replace("joined", "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"), "h",
        (F.size(F.array_distinct("h")) < F.size("h")).alias("again"), (F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(F.size("h").cast("long")))) - 1).alias("low"),
    )
    counts += ["word_chars", "n_symbols"]
    # places of windows that occur again: each hash gives its low bits to the place, so the rest is compared by a sort of numbers;
    # what then looks equal is compared once more by the hash turned by half, whose low bits are others
    dealt = lambda h, i: h.bitwiseAND(F.bitwise_not("low")).bitwiseOR(i)
    same = lambda x, y: x.bitwiseXOR(y).bitwiseAND(F.bitwise_not("low")) == 0
    twice = lambda s: F.filter(s, lambda x, k: same(x, F.get(s, k - 1)) | same(x, F.get(s, k + 1)))
    turned = lambda h: F.shiftleft(h, 32).bitwiseOR(F.shiftrightunsigned(h, 32))
    place = lambda x: x.bitwiseAND(F.col("low"))
    packed = F.sort_array(F.transform("h", lambda h, i: dealt(h, i.cast("long"))))
    own = own.select(*names, *counts, "low", "h", F.when(F.col("again"), packed).otherwise(F.array().cast("array<bigint>")).alias("s"))
    own = own.select(*names, *counts, "low", "h", twice(F.col("s")).alias("s"))
    own = own.select(*names, *counts, "low", F.sort_array(F.transform("s", lambda x: dealt(turned(F.get("h", place(x).cast("int"))), place(x)))).alias("s"))
    twice = twice(F.col("s"))
    starts = F.sort_array(F.transform(twice, lambda x: x.bitwiseAND(F.col("low"))))
    own = own.select(*names, *counts, starts.alias("p"))
    zero = F.struct(F.lit(-3).cast("long").alias("last"), F.lit(0).cast("long").alias("n"))
    step = lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3).cast("long"), p - a["last"])).alias("n"))
    return own.select(*(F.col(n) for n in names), *counts, F.aggregate("p", zero, step)["n"].alias("n_repeat_words"))


def _floor_div(a: Column, b: Column) -> Column:
    return F.when(b > 0, F.floor(F.lit(1000) * a / b)).otherwise(0).cast("long")


def _bucket(value: Column) -> Column:
    """The least value with the same 7 leading bits and the same length in bits."""
    drop = F.greatest(F.lit(0), F.length(F.bin(value)) - 7)
    return value.bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("long"), drop) - 1))


def measures() -> dict[str, Column]:
    return {
        "word_length": _floor_div(F.col("word_chars"), F.col("n_words")), "symbols": _floor_div(F.col("n_symbols"), F.col("n_words")),
        "dup_lines": _floor_div(F.col("n_dup_lines"), F.col("n_lines")), "repeats": _floor_div(F.col("n_repeat_words"), F.col("n_words")),
    }


def sketches(rows: DataFrame, groups: list[str]) -> DataFrame:
    """(groups, measure, bucket, n): the sketch of each measure over the rows of each group."""
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), _bucket(c).alias("bucket")) for m, c in measures().items())))
    return rows.select(*groups, each.alias("e")).groupBy(*groups, "e.measure", "e.bucket").agg(F.count("*").alias("n"))


def merged(sketch: DataFrame, groups: list[str]) -> DataFrame:
    """Sketches merged to coarser groups."""
    return sketch.groupBy(*groups, "measure", "bucket").agg(F.sum("n").alias("n"))


def quartiles(sketch: DataFrame, groups: list[str]) -> DataFrame:
    """(groups, measure, total, q1, q2, q3) of sketches; a window holds the buckets of one sketch, under 4,000."""
    own = Window.partitionBy(*groups, "measure")
    ordered = own.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = sketch.withColumn("upto", F.sum("n").over(ordered)).withColumn("total", F.sum("n").over(own))
    at = lambda k: F.min(F.when(4 * F.col("upto") >= k * F.col("total"), F.col("bucket"))).alias(f"q{k}")
    return summed.groupBy(*groups, "measure").agg(F.max("total").alias("total"), *map(at, (1, 2, 3)))


def _drawn(own: Column, parent: Column, weight: int) -> Column:
    """Quartiles drawn towards the parent's, which weigh as much as `weight` documents; in whole numbers."""

    def one(q: str) -> Column:
        x, y = own[q], parent[q]
        by = lambda d: F.floor(d * weight / (own["total"] + weight)).cast("long")
        return F.when(x >= y, x - by(x - y)).otherwise(x + by(y - x)).alias(q)

    return F.struct(own["total"].alias("total"), *map(one, ("q1", "q2", "q3")))


def bounds(rows: DataFrame, weight: int = WEIGHT, reach: int = REACH) -> DataFrame:
    """(lang, source, <measure>_least, <measure>_most) for every group of rows that are in the table `rows`."""
    fine = materialize(sketches(rows, ["lang", "source"]), "sketches")
    by_lang = merged(fine, ["lang"])
    levels = [quartiles(fine, ["lang", "source"]), quartiles(by_lang, ["lang"]), quartiles(merged(by_lang, []), [])]
    for i, keys in enumerate((["lang", "source"], ["lang"], [])):
        levels[i] = levels[i].select(*(F.col(k).alias(f"k{i}_{k}") for k in keys), F.col("measure").alias(f"m{i}"), F.struct("total", "q1", "q2", "q3").alias(f"s{i}"))
    joined = levels[0].join(levels[1], F.col("k0_lang").eqNullSafe(F.col("k1_lang")) & (F.col("m0") == F.col("m1"))).join(levels[2], F.col("m0") == F.col("m2"))
    of_lang = F.when(F.col("m0").isin(*OWN_OF_LANGUAGE), F.col("s1")).otherwise(_drawn(F.col("s1"), F.col("s2"), weight))
    joined = joined.withColumn("s1", of_lang)
    chosen = joined.select(F.col("k0_lang").alias("lang"), F.col("k0_source").alias("source"), F.col("m0").alias("measure"), _drawn(F.col("s0"), F.col("s1"), weight).alias("s"))
    out = []
    for m, (least, both) in MEASURES.items():
        here = F.col("measure") == m
        if both:
            out.append(F.max(F.when(here, F.col("s.q2") - reach * F.greatest(F.lit(least), F.col("s.q3") - F.col("s.q2")))).alias(f"{m}_least"))
        out.append(F.max(F.when(here, F.col("s.q2") + reach * F.greatest(F.lit(least), F.col("s.q2") - F.col("s.q1")))).alias(f"{m}_most"))
    return chosen.groupBy("lang", "source").agg(*out)


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))


def judge(docs: DataFrame, *others: Column, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", weight: int = WEIGHT, reach: int = REACH) -> DataFrame:
    """The other columns (named _other0, ...), the counts of measured(), base_failed and kept for each row of docs.

    Bounds come from the rows that pass the fixed rules.
    """
    carried = [*others, F.col(lang_col).cast("string"), F.col(source_col).cast("string")]
    rows = measured(docs, F.col(text_col).cast("string"), *carried).withColumnsRenamed({f"_other{len(others)}": "lang", f"_other{len(others) + 1}": "source"})
    rows = materialize(rows.withColumn("base_failed", base_failed()), "measures")
    limits = materialize(bounds(rows.where("not base_failed"), weight, reach), "bounds")
    limits = limits.withColumnsRenamed({"lang": "b_lang", "source": "b_source"})
    joined = rows.join(limits, F.col("lang").eqNullSafe(F.col("b_lang")) & F.col("source").eqNullSafe(F.col("b_source")), "left")
    good = F.lit(True)
    for m, value in measures().items():
        good &= value <= F.col(f"{m}_most")
        if MEASURES[m][1]:
            good &= value >= F.col(f"{m}_least")
    return joined.withColumn("kept", ~F.col("base_failed") & F.coalesce(good, F.lit(False))).drop("b_lang", "b_source")


def keep(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that the rules keep."""
    whole = F.struct(*(docs[quoted(c)] for c in docs.columns))
    return judge(docs, whole).where("kept").select("_other0.*")
