"""Order MinHash fingerprints, with DataFrame functions only.

A text's k-mers are runs of words, numbered by how often they occurred before.
Their hashes fall into bins; each bin selects its least few, puts them back into
text order and hashes the tuple. A changed word changes the tuples that its
k-mers are in, and moved words change tuples whose order turns round, so the
share of equal bins follows edit distance rather than shared content alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize

#: Words in a k-mer, k-mers in a bin's tuple (fixed by the expressions below), and the bits of a bin's number.
WORDS, TUPLE, BIN_BITS = 3, 2, 6


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also where it is used inside other lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _long(x: int) -> Column:
    return F.lit(x).cast("bigint")


def kmers(text: Column, words: int = WORDS) -> Column:
    """Hashes of all word k-mers in text order; of all words if there are fewer, none without words."""

    def of(w: Column) -> Column:
        every = F.transform(F.sequence(F.lit(0), F.size(w) - words), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(words)]))
        return F.when(F.size(w) >= words, every).when(F.size(w) > 0, F.array(F.xxhash64(F.concat_ws(" ", w)))).otherwise(F.array().cast("array<bigint>"))

    return _let(F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), ""), of)


def numbered(hashes: Column) -> Column:
    """Each k-mer's place (low 32 bits) under a hash of the k-mer and its occurrence number (high 32 bits)."""

    def pack(h: Column, occurrence: Column, place: Column) -> Column:
        return F.shiftleft(F.xxhash64(h, occurrence), 32).bitwiseOR(place.cast("bigint"))

    def repeats(s: Column) -> Column:
        # Equal k-mers stand together in text order once sorted; a run's n-th one has number n.
        first = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda j: (j == 0) | (F.get(s, j)["h"] != F.get(s, j - 1)["h"]))

        def runs(starts: Column) -> Column:
            def run(start: Column, k: Column) -> Column:
                end = F.coalesce(F.get(starts, k + 1), F.size(s)) - 1
                return F.transform(F.sequence(start, end), lambda j: pack(F.get(s, j)["h"], j - start, F.get(s, j)["i"]))

            return F.flatten(F.transform(starts, run))

        return _let(first, runs)

    def of(h: Column) -> Column:
        unique = F.transform(h, lambda x, i: pack(x, F.lit(0), i))
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), unique).otherwise(_let(ordered, repeats))

    return _let(hashes, of)


def _bin(packed: Column) -> Column:
    return F.shiftrightunsigned(packed, 64 - BIN_BITS)


def signature(text: Column) -> Column:
    """Sorted array of ints, one for each bin that has a k-mer: the bin's number above its tuple's hash."""

    def select(p: Column) -> Column:
        return F.filter(p, lambda x, j: (j < TUPLE) | (_bin(F.get(p, j - TUPLE)) != _bin(x)))

    def tuples(f: Column) -> Column:
        def one(x: Column, j: Column) -> Column:
            after = F.get(f, j + 1)
            pair = after.isNotNull() & (_bin(after) == _bin(x))
            low = _long(0xFFFFFFFF)
            a, b = F.shiftrightunsigned(x, 32), F.shiftrightunsigned(after, 32)
            ordered = F.when(x.bitwiseAND(low) < after.bitwiseAND(low), F.xxhash64(a, b)).otherwise(F.xxhash64(b, a))
            digest = F.shiftrightunsigned(F.when(pair, ordered).otherwise(F.xxhash64(a)), 32 + BIN_BITS)
            value = F.shiftleft(_bin(x), 32 - BIN_BITS).bitwiseOR(digest)
            fresh = (j == 0) | (_bin(F.get(f, j - 1)) != _bin(x))
            return F.when(fresh, value)

        return F.filter(F.transform(f, one), lambda v: v.isNotNull())

    values = _let(F.sort_array(numbered(kmers(text))), lambda p: _let(select(p), tuples))
    # Signed 32-bit values take half the room.
    return F.transform(values, lambda v: F.when(v >= _long(1 << 31), v - _long(1 << 32)).otherwise(v).cast("int"))


def as_text(sign: Column) -> Column:
    """A signature as lowercase hex, eight digits a bin; "" without k-mers."""
    return F.lower(F.concat_ws("", F.transform(sign, lambda v: F.lpad(F.hex(v.cast("bigint").bitwiseAND(_long(0xFFFFFFFF))), 8, "0"))))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bins among those that either has; 1 if neither has any."""
    number = lambda v: F.shiftrightunsigned(v, 32 - BIN_BITS)
    either = F.size(F.array_union(F.transform(a, number), F.transform(b, number)))
    return F.when(either == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)).cast("double") / either)


def ring(rows: DataFrame) -> DataFrame:
    """(id, h, prev_id, prev_h, prev_n) of distinct (id, h, n): the row before each in descending id (NULL last, then by h), the last before the first.

    Rows are range-sorted; only each partition's last row meets the others', and
    partitions are as many as the session shuffles to.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col("id").desc_nulls_last(), F.col("h")]
    ordered = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    ordered = materialize(ordered.select("id", "h", "n", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), "order")
    row = F.struct("id", "h", "n")
    last = ordered.groupBy("part").agg(F.max_by(row, "at").alias("last"))
    by_part = Window.orderBy("part")
    whole = by_part.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    edges = last.select(F.col("part").alias("p"), F.coalesce(F.lag("last").over(by_part), F.last("last").over(whole)).alias("edge"))
    inside = ordered.select("*", F.lag(row).over(Window.partitionBy("part").orderBy("at")).alias("before"))
    # One row a partition: bounded by the number of shuffle partitions.
    joined = inside.join(F.broadcast(edges), F.col("part") == F.col("p")).withColumn("before", F.coalesce("before", "edge"))
    return joined.select("id", "h", F.col("before.id").alias("prev_id"), F.col("before.h").alias("prev_h"), F.col("before.n").alias("prev_n"))


def fingerprint_with_edits(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every whole text and of its edited text, and their likenesses.

    The edited text has its last third of code points replaced by as many (or
    all) of the next document's first ones; the next document is the one after
    it in descending id, after the last the first. Columns: the id, n_chars,
    edited (text), sign and edited_sign (signatures), near_edited, near_next.

    NULL texts are empty ones. Rows that repeat an id follow each other by a hash
    of their text, and equal rows are one document whose result each of them
    gets. NULL ids come last. Texts without words have an empty signature, like
    each other and unlike all else. An empty table gives an empty one. Texts of
    any length count whole; only the two columns named are read, so others may
    have any name.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    base = df.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))
    sizes = base.select("id", "h", F.char_length("text").cast("bigint").alias("n"))
    sizes = materialize(sizes.groupBy("id", "h").agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("copies")), "keys")
    before = materialize(ring(sizes.select("id", "h", "n")), "ring")
    signed = base.withColumn("sign", signature(F.col("text")))
    # Both joins read one shuffle of the texts: keys are unique on one side, so merging is even.
    b = before.select(F.col("id").alias("i"), F.col("h").alias("g"), "prev_id", "prev_h", "prev_n").hint("merge")
    heads = signed.join(b, F.col("id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("g")))
    third = F.floor(F.col("prev_n") / 3).cast("int")
    heads = heads.select("prev_id", "prev_h", F.substring("text", F.lit(1), third).alias("head"), F.col("sign").alias("next_sign"))
    if sizes.where("copies > 1").limit(1).count():
        heads = heads.dropDuplicates(["prev_id", "prev_h"])
    both = signed.join(heads.hint("merge"), F.col("id").eqNullSafe(F.col("prev_id")) & (F.col("h") == F.col("prev_h")))
    n = F.char_length("text")
    edited = F.concat(F.substring("text", F.lit(1), (n - F.floor(n / 3)).cast("int")), F.col("head"))
    both = both.select("id", n.cast("bigint").alias("n_chars"), edited.alias("edited"), "sign", "next_sign")
    both = both.select("*", signature(F.col("edited")).alias("edited_sign"))
    near = both.select("*", likeness(F.col("sign"), F.col("edited_sign")).alias("near_edited"), likeness(F.col("sign"), F.col("next_sign")).alias("near_next"))
    return near.select(F.col("id").alias(id_col), "n_chars", "edited", "sign", "edited_sign", "near_edited", "near_next")


def op6_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and likenesses of all documents and their edited texts."""
    out = fingerprint_with_edits(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_chars", F.sha2(F.encode("edited", "utf-8"), 256).alias("edited_sha256"), as_text(F.col("sign")).alias("fingerprint"), as_text(F.col("edited_sign")).alias("edited_fingerprint"), "near_edited", "near_next")
