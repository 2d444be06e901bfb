"""SimHash document fingerprints, by DataFrame functions alone.

Terms are the pairs of neighbouring words of the lower-cased text (and its last word), each occurrence weighted by its length
in code points up to a bound, so that pairs of stop words count less. Every term's two 64-bit hashes vote on 128 signed bits.
The likeness of two fingerprints is the cosine that their differing bits stand for, cos(pi d / 128), and 0 where negative.

The votes of bits i and i + 32 of a hash are summed in the two halves of one long, so a term costs 64 additions inside
generated code, and the exploded terms are summed without leaving the task: the rows of a document are already together.

Fingerprints within a Hamming radius are found through permuted block tables (links()).

Cases: a null text counts as empty; a text without words has fingerprint zero, like only to itself (likeness 1) and to nothing
else (0); equal texts have equal fingerprints; texts of any length are read whole; an empty table gives no rows. Rows are
ordered by descending id, null ids last, repeated ids by text. Only the id and text columns are read.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations, pairwise
from math import pi

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bomweave.llm.common import materialize, rank_in, shuffle_partitions, words

#: Most that one occurrence of a term weighs.
MAX_WEIGHT = 24
BITS = 128
#: Differing bits up to which fingerprints are near, and queries of one block key that a task compares.
RADIUS, SHARE = 3, 32
_LANES = (1 << 32) | 1
_SEEDS = ("", "b")


def _terms(text: Column) -> Column:
    """Pairs of neighbouring words as structs (x, y); the last word's y is null."""
    own = words(F.lower(text))
    return F.arrays_zip(own.alias("x"), F.slice(own, 2, F.greatest(F.size(own), F.lit(1))).alias("y"))


def _votes(weight: Column, hashed: Column, bit: int) -> Column:
    """The weight in the low half if the bit is set, in the high half if bit + 32 is."""
    return F.sum(F.shiftrightunsigned(hashed, bit).bitwiseAND(F.lit(_LANES)) * weight)


def _word_of_bits(prefix: str, total: Column) -> Column:
    """64 signed bits from their 32 packed sums: a bit is set if over half the weight voted for it."""
    bits = []
    for bit in range(32):
        both = F.col(f"{prefix}{bit}")
        for half, place in ((both.bitwiseAND(F.lit(0xFFFFFFFF)), bit), (F.shiftrightunsigned(both, 32), bit + 32)):
            bits.append(F.when(2 * half > total, F.lit(1 << place if place < 63 else -(1 << 63))).otherwise(F.lit(0).cast("long")))
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def fingerprint_rows(rows: DataFrame, keys: list[str], texts: dict[str, str]) -> DataFrame:
    """keys and, for every text column named in texts, its fingerprint as two longs in <name>_hi and <name>_lo.

    keys tell the rows apart; where rows is dealt by some of them, nothing is shuffled.
    """
    names = [*texts.items()]
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("which"), F.col(c).alias("text")) for i, (c, _) in enumerate(names))))
    one = rows.select(*keys, each.alias("e")).select(*keys, "e.which", _terms(F.col("e.text")).alias("terms"))
    terms = one.select(*keys, "which", F.explode_outer("terms").alias("t")).select(*keys, "which", "t.x", "t.y")
    weighed = terms.select(
        *keys, "which", F.when(F.col("x").isNull(), 0).otherwise(F.least(F.lit(MAX_WEIGHT), F.length("x") + F.coalesce(F.length("y"), F.lit(0)))).cast("long").alias("w"),
        *(F.xxhash64("x", "y", *map(F.lit, filter(None, [seed]))).alias(f"h{i}") for i, seed in enumerate(_SEEDS)),
    )
    summed = weighed.groupBy(*keys, "which").agg(F.sum("w").alias("w"), *(_votes(F.col("w"), F.col(f"h{i}"), bit).alias(f"v{i}_{bit}") for i in range(2) for bit in range(32)))
    own = summed.select(*keys, "which", _word_of_bits("v0_", F.col("w")).alias("hi"), _word_of_bits("v1_", F.col("w")).alias("lo"))
    pick = [F.max(F.when(F.col("which") == i, F.col(half))).alias(f"{name}_{half}") for i, (_, name) in enumerate(names) for half in ("hi", "lo")]
    return own.groupBy(*keys).agg(*pick)


def as_text(hi: Column, lo: Column) -> Column:
    """128 bits as 32 lower-case hex digits."""
    return F.concat(*(F.lpad(F.lower(F.hex(x)), 16, "0") for x in (hi, lo)))


def _bits_apart(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    return F.bit_count(a[0].bitwiseXOR(b[0])) + F.bit_count(a[1].bitwiseXOR(b[1]))


def likeness(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """0 to 1 for two fingerprints given as (hi, lo)."""
    empty = [(x[0] == 0) & (x[1] == 0) for x in (a, b)]
    apart = _bits_apart(a, b)
    return F.when(apart == 0, 1.0).when(empty[0] | empty[1], 0.0).otherwise(F.greatest(F.lit(0.0), F.cos(apart * (pi / BITS))))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, hi and lo of each row's text. Repeated ids get one row for each text of theirs."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    keyed = rows.withColumn("row", F.monotonically_increasing_id())
    own = fingerprint_rows(keyed, ["id", "row"], {"text": "f"})
    return own.select(F.col("id").alias(id_col), F.col("f_hi").alias("hi"), F.col("f_lo").alias("lo"))


def beside_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_partition: int = 4) -> DataFrame:
    """Each row beside the next one by descending id (after the last: the first), whose opening replaces its second half.

    Gives id, n_chars, the edited text's SHA-256 and the fingerprints of the text, the edited text and the next text.

    Whole texts are shuffled once, to buckets that are ranges of ids between ids that a quantile sketch gives. The row at a
    bucket's upper end also goes to the bucket above it, as its last row's next, so no row looks outside its bucket, and windows
    and sums reuse that one shuffle. The sketch's answer, a few bounds a shuffle partition, is all that reaches the driver.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    n = max(1, per_partition * shuffle_partitions(spark))
    sketch = rows.agg(
        F.max("id").cast("long").alias("top"), F.count_if(F.col("id").isNull()).alias("nulls"),
        F.percentile_approx(F.col("id").cast("long"), [i / n for i in range(1, n)] or [0.5], 100 * n).alias("cut"),
    ).first()
    uppers = [] if sketch.top is None else sorted({*(sketch.cut or []), sketch.top})
    # bucket 0 holds null ids, the last in order; bucket b > 0 those over uppers[b - 2] up to uppers[b - 1]
    cuts = F.lit(uppers) if uppers else F.array().cast("array<bigint>")
    own = F.when(F.col("id").isNull(), 0).otherwise(rank_in(cuts, len(uppers), F.col("id"), strict=True) + 1)
    # where a row's copy goes: the first row of a bucket to the one above; after the lowest ids come the null ones, and after
    # the last row of all the top one
    lowest = 1 if uppers else 0
    after_all = 0 if sketch.nulls else lowest
    top = F.lit(sketch.top).cast("bigint")
    copy = F.when(F.col("id").isNull(), lowest).when(F.col("id") == top, after_all).when(F.array_contains(cuts, F.col("id")), F.col("bucket") + 1)
    place = F.explode(F.when(F.col("copy").isNull(), F.array(F.struct(F.col("bucket"), F.lit(False).alias("tail")))).otherwise(
        F.array(F.struct(F.col("bucket"), F.lit(False).alias("tail")), F.struct(F.col("copy").alias("bucket"), F.lit(True).alias("tail")))
    ))
    dealt = rows.withColumn("bucket", own).withColumn("copy", copy).select("id", "text", place.alias("p")).select("id", "text", "p.*")
    order = Window.partitionBy("bucket").orderBy("tail", F.col("id").desc_nulls_last(), "text")
    beside = dealt.withColumn("next", F.lead("text").over(order)).withColumn("seq", F.row_number().over(order))
    n_chars = F.length("text").cast("long")
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.when(F.col("tail"), "").otherwise(F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("next", F.lit(1), half)))
    changed = beside.withColumn("n_chars", n_chars).withColumn("edited", edited).withColumn("edited_sha256", F.sha2("edited", 256))
    keys = ["bucket", "seq", "tail", "id", "n_chars", "edited_sha256"]
    marked = fingerprint_rows(changed.select(*keys, "text", "edited"), keys, {"text": "f", "edited": "e"})
    again = Window.partitionBy("bucket").orderBy("seq")
    return (
        marked.withColumns({f"n_{half}": F.lead(f"f_{half}").over(again) for half in ("hi", "lo")})
        .where(~F.col("tail")).select(F.col("id").alias(id_col), "n_chars", "edited_sha256", "f_hi", "f_lo", "e_hi", "e_lo", "n_hi", "n_lo")
    )


def links(queries: DataFrame, classes: DataFrame, radius: int = RADIUS, extra: int = 1) -> DataFrame:
    """(q_hi, q_lo, t_hi, t_lo, apart): every query fingerprint with each of classes at `radius` or fewer differing bits, once.

    Both have columns hi and lo, each fingerprint in one row. The 128 bits are cut into radius + extra blocks; a pair within the
    radius agrees on some `extra` of them, so there is one table for every choice of `extra` blocks, permuted to the front as its
    key. All tables meet in one join, which holds candidates against all bits and takes a pair from the first table that it
    agrees in. A key of many queries, as a group of near copies has, is split by the classes' bits into shares, each with all its
    queries.
    """
    blocks = radius + extra
    bounds = [round(BITS * i / blocks) for i in range(blocks + 1)]
    block = [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in pairwise(bounds)]
    signed = lambda x: F.lit(x - (1 << 64) if x >> 63 else x)
    masks = [(signed(m >> 64), signed(m & (1 << 64) - 1)) for m in (sum(chosen) for chosen in combinations(block, extra))]
    tables = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), hi.alias("hi"), lo.alias("lo")) for i, (hi, lo) in enumerate(masks))))

    def keyed(df: DataFrame, name: str) -> DataFrame:
        key = F.xxhash64("m.i", F.col("m.hi").bitwiseAND(F.col("hi")), F.col("m.lo").bitwiseAND(F.col("lo")))
        return df.select("hi", "lo", tables.alias("m")).select(key.alias("key"), F.col("hi").alias(f"{name}_hi"), F.col("lo").alias(f"{name}_lo"), F.col("m.i").alias(f"{name}_i"))

    asked = materialize(keyed(queries, "q"), "block-keys")
    shares = materialize(asked.groupBy("key").agg(F.ceil(F.count("*") / SHARE).alias("shares")).where("shares > 1"), "hot-blocks")
    spread = asked.join(shares, "key", "left").withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("shares", F.lit(1)) - 1))).drop("shares")
    held = keyed(classes, "t").join(shares, "key", "left").withColumn("share", F.pmod(F.xxhash64("t_hi", "t_lo"), F.coalesce("shares", F.lit(1)))).drop("shares")
    q, t = (F.col("q_hi"), F.col("q_lo")), (F.col("t_hi"), F.col("t_lo"))
    agree = lambda m: (q[0].bitwiseXOR(t[0]).bitwiseAND(m[0]) == 0) & (q[1].bitwiseXOR(t[1]).bitwiseAND(m[1]) == 0)
    first = F.lit(len(masks))
    for i in reversed(range(len(masks))):
        first = F.when(agree(masks[i]), i).otherwise(first)
    a, b = spread.alias("a"), held.alias("b")
    meet = (F.col("a.key") == F.col("b.key")) & (F.col("a.share") == F.col("b.share")) & (F.col("q_i") == F.col("t_i")) & (_bits_apart(q, t) <= radius) & (first == F.col("q_i"))
    return a.join(b, meet).select("q_hi", "q_lo", "t_hi", "t_lo", _bits_apart(q, t).alias("apart"))


def count_within(queries: DataFrame, table: DataFrame, radius: int = RADIUS) -> DataFrame:
    """hi, lo and n of each distinct fingerprint of queries: how many rows of table (hi, lo) are within the radius.

    Rows of equal fingerprints are one class; links between classes are counted where they are found, so no pair of rows is made.
    """
    classes = materialize(table.groupBy("hi", "lo").agg(F.count("*").alias("rows")), "classes")
    found = links(queries.select("hi", "lo").distinct(), classes, radius)
    sizes = classes.select(F.col("hi").alias("t_hi"), F.col("lo").alias("t_lo"), "rows")
    return found.join(sizes, ["t_hi", "t_lo"]).groupBy(F.col("q_hi").alias("hi"), F.col("q_lo").alias("lo")).agg(F.sum("rows").alias("n"))


def with_near_rows(marked: DataFrame, asked: Column, radius: int = RADIUS) -> DataFrame:
    """marked (f_hi, f_lo, ...) with n_near: for rows that are asked, how many other rows have a fingerprint within the radius; else null."""
    table = marked.select(F.col("f_hi").alias("hi"), F.col("f_lo").alias("lo"))
    is_asked = F.coalesce(asked, F.lit(False))
    near = materialize(count_within(marked.where(is_asked).select(F.col("f_hi").alias("hi"), F.col("f_lo").alias("lo")), table, radius), "near")
    rows = marked.where(is_asked).join(near, (F.col("f_hi") == F.col("hi")) & (F.col("f_lo") == F.col("lo"))).select(*marked.columns, (F.col("n") - 1).alias("n_near"))
    return marked.where(~is_asked).withColumn("n_near", F.lit(None).cast("long")).unionByName(rows)


def within(queries: DataFrame, table: DataFrame, radius: int = RADIUS, extra: int = 1) -> DataFrame:
    """(q, t, apart): the ids of all pairs of a query row and a table row (id, hi, lo) within the radius: for queries whose answers are few."""
    found = links(queries.select("hi", "lo").distinct(), table.select("hi", "lo").distinct(), radius, extra)
    of = lambda df, name: df.select(F.col("id").alias(name), F.col("hi").alias(f"{name}_hi"), F.col("lo").alias(f"{name}_lo"))
    return found.join(of(queries, "q"), ["q_hi", "q_lo"]).join(of(table, "t"), ["t_hi", "t_lo"]).select("q", "t", "apart")
