"""SpotSigs fingerprints with DataFrame functions only.

An anchor is a common word; its signature is the anchor and the chain of the
next content words (words that are no anchors).  The start of a text is an
anchor too, so that texts without common words have a signature.  A document's
fingerprint is its set of signatures; sets are compared by Jaccard, pruned by
their sizes, within partitions by set length.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Common words of English, German, French and Spanish.
ANCHORS = """
a an and are as at be but by for from in is it of on or that the this to was with
als auf das dem den der des die ein eine er es im ist mit nicht sich sie und von zu
au aux ce dans du elle en est et il la le les mais ou par pas pour que qui sur un une
al como con de del el ella las lo los no o para pero por se su y
""".split()
START = "^"
CHAIN = 2
#: Rows of a bucket in which neighbours are found.
BUCKET_ROWS = 2000
#: Below that Jaccard a likeness may be 0: sets two partitions by length apart are not compared.
LEAST = 0.1
#: Documents of a signature that meet in one task; more are dealt in blocks.
BLOCK_SETS = 256


def signatures(text: Column, chain: int = CHAIN) -> Column:
    """Sorted distinct signatures (array<int>) of a text.

    A text without content words has its white-space separated parts instead; null and blank texts have none.
    """
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+")
    words = F.concat(F.array(F.lit(START)), F.filter(words, lambda w: w != ""))
    is_anchor = lambda w: w.isin(START, *ANCHORS)
    content = F.filter(words, lambda w: ~is_anchor(w))
    anchors = F.filter(F.transform(words, lambda w, i: F.when(is_anchor(w), F.struct(w.alias("w"), i.alias("i")))), lambda x: x.isNotNull())
    packed = F.struct(content.alias("content"), anchors.alias("anchors"))
    # an anchor at position i with j anchors before it is followed by content word i - j
    made = F.transform(
        F.array(packed),
        lambda p: F.transform(
            p["anchors"],
            lambda a, j: F.when(
                F.get(p["content"], a["i"] - j + F.when(a["w"] == START, 0).otherwise(chain - 1)).isNotNull(),
                F.hash(a["w"], *(F.get(p["content"], a["i"] - j + k) for k in range(chain))),
            ),
        ),
    )
    chains = F.filter(F.get(made, F.lit(0)), lambda h: h.isNotNull())
    plain = F.transform(F.filter(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != ""), lambda w: F.hash(w))
    return F.transform(F.array(chains), lambda c: F.array_sort(F.array_distinct(F.when(F.size(c) > 0, c).otherwise(plain))))[0]


def as_string(signatures_: Column) -> Column:
    """A fingerprint: eight hexadecimal digits for each signature."""
    return F.array_join(F.transform(signatures_, lambda h: F.lpad(F.lower(F.hex(h.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")), "")


def length_partition(size: Column, least: float) -> Column:
    """Partition of a set; sets with a Jaccard of ``least`` are in one or in neighbouring partitions."""
    return F.floor(F.log(F.greatest(size, F.lit(1)).cast("double")) / math.log(1 / least) + 1e-9).cast("int")


def likeness(a: Column, b: Column, least: float = LEAST) -> Column:
    """Jaccard of two sets of signatures; two empty sets are alike.

    It is 0 without a comparison where the sets' lengths rule ``least`` out:
    they are not in neighbouring partitions, or the smaller has less than that
    share of the larger.  A common part too small for ``least`` gives 0, too.
    """
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    common = F.size(F.array_intersect(a, b))
    exact = common / (F.size(a) + F.size(b) - common)
    apart = length_partition(large, least) - length_partition(small, least) > 1
    return F.when(large == 0, 1.0).when((small == 0) | apart | (small < least * large), 0.0).otherwise(F.when(exact >= least, exact).otherwise(0.0))


def similar_pairs(docs: DataFrame, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(a, b, likeness) between documents with different fingerprints, each the least id of its fingerprint.

    Two sets that are alike share one of their rarest signatures, so only those
    meet, within neighbouring partitions by length.  Sets that meet in a
    signature of many sets are dealt in blocks, block against block, so no task
    holds all of them.  Documents without signatures have no pair; null ids are
    left out; rows that repeat count once.
    """
    sets = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), signatures(F.col(text_col)).alias("s")).groupBy("s").agg(F.min("id").alias("id")).where(F.size("s") > 0)
    each = sets.select("id", F.explode("s").alias("sig"))
    often = each.groupBy("sig").agg(F.count(F.lit(1)).alias("n"))
    ordered = each.join(often, "sig").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("n", "sig"))).alias("s"))
    size = F.size("s")
    sets = ordered.withColumn("part", length_partition(size, least)).withColumn("first", F.slice("s", 1, (size - F.ceil(size * least) + 1).cast("int")))
    sets = sets.withColumn("s", F.transform("s", lambda x: x["sig"]))
    met_in = sets.select("id", "s", "part", F.explode("first").alias("x")).select("id", "s", "part", F.col("x.sig").alias("sig"), F.ceil(F.col("x.n") / BLOCK_SETS).cast("int").alias("blocks"))
    met_in = met_in.withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    left = met_in.select(F.col("id").alias("a"), "s", "part", "sig", F.col("block").alias("i"), F.col("other").alias("j"))
    right = met_in.select(F.col("id").alias("b"), F.col("s").alias("t"), F.col("part").alias("part_b"), "sig", F.col("other").alias("i"), F.col("block").alias("j"), F.explode(F.array("part", F.col("part") - 1)).alias("part"))
    met = left.join(right, ["sig", "part", "i", "j"]).where((F.col("part_b") > F.col("part")) | (F.col("a") < F.col("b")))
    met = met.where(F.least(F.size("s"), F.size("t")) >= least * F.greatest(F.size("s"), F.size("t")))
    found = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), likeness(F.col("s"), F.col("t"), least).alias("likeness")).where(F.col("likeness") >= least)
    return found.distinct()


def with_next(rows: DataFrame, columns: list[str], id_col: str = "id", bucket_rows: int | None = None) -> DataFrame:
    """Adds next_<column>: the value in the row with the next smaller id, of the largest id after the smallest.

    Rows go to buckets by ranges of the id, the largest row of each bucket also
    to the bucket above as the one that follows its smallest.  Null ids come
    after all others, rows of one id follow each other in the order of a hash.
    ``bucket_rows`` (BUCKET_ROWS unless given) is to be chosen such that a
    bucket suits a task; the driver holds one id for each bucket.
    """
    stats = rows.agg(F.count(F.lit(1)).alias("n"), F.max(id_col).alias("last")).first()
    buckets = max(1, stats.n // (bucket_rows or BUCKET_ROWS))
    bounds = []
    if stats.last is not None:
        if buckets > 1:
            shares = F.array(*(F.lit(k / buckets) for k in range(1, buckets)))
            bounds = rows.agg(F.percentile_approx(id_col, shares, max(10_000, 5 * buckets))).first()[0] or []
        bounds = sorted({*bounds, stats.last})
    key = F.col(id_col)
    if bounds:
        limits = F.array(*(F.lit(b) for b in bounds))
        steps = F.array(*(F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))))
        found = F.aggregate(steps, F.lit(0), lambda low, step: F.when((low + step <= len(bounds)) & (F.get(limits, low + step - 1) < key), low + step).otherwise(low))
        bucket = F.when(key.isNull(), 0).otherwise(found)
        rows = rows.withColumn("bucket", bucket)
        place = lambda b, ghost, wrap: F.struct(b.alias("bucket"), F.lit(ghost).alias("ghost"), F.lit(wrap).alias("wrap"))
        own = place(F.col("bucket"), False, False)
        is_limit = F.get(limits, F.col("bucket")) == key
        places = F.when(key == bounds[-1], F.array(own, place(F.lit(0), True, True))).when(is_limit, F.array(own, place(F.col("bucket") + 1, True, False))).otherwise(F.array(own))
        rows = rows.withColumn("place", F.explode(places)).drop("bucket").select("*", "place.*").drop("place")
    else:
        rows = rows.withColumns({"bucket": F.lit(0), "ghost": F.lit(False), "wrap": F.lit(False)})
    order = Window.partitionBy("bucket").orderBy("wrap", F.col(id_col).desc_nulls_last(), "tie")
    nexts = {f"next_{c}": F.lead(c).over(order) for c in columns}
    if not bounds:  # no row has an id: the last is followed by the first
        whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        nexts = {k: F.coalesce(v, F.first(k[5:]).over(whole)) for k, v in nexts.items()}
    return rows.withColumns(nexts).where("not ghost").drop("bucket", "ghost", "wrap")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last third replaced by the beginning of the next
    document's text, by descending id.  Null texts count as empty; an only row is
    its own next.  Equal texts have equal fingerprints; rows that repeat an id
    are rows of their own.  Likenesses below LEAST are 0 (see ``likeness``).
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("tie"), signatures(F.col(text_col)).alias("sigs"))
    rows = with_next(rows, ["text", "sigs"])
    n = F.char_length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - third), F.substring("next_text", F.lit(1), third))
    rows = rows.select("id", n.cast("long").alias("n_chars"), "sigs", "next_sigs", edited.alias("edited"))
    rows = rows.select("id", "n_chars", "sigs", "next_sigs", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), signatures(F.col("edited")).alias("edited_sigs"))
    return rows.select(
        F.col("id").alias(id_col),
        "n_chars",
        "edited_sha256",
        as_string(F.col("sigs")).alias("fingerprint"),
        as_string(F.col("edited_sigs")).alias("edited_fingerprint"),
        likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"),
        likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
    )
