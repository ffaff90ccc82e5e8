"""Document fingerprints: one-permutation MinHash in DataFrame functions only.

Each word shingle is hashed once; the hash's top bits choose a bin and each bin keeps its smallest
hash. Empty bins are filled by optimal densification: a bin walks its own pseudorandom cycle over
all bins until it meets a filled one, so the donor depends on the set of filled bins alone. Of each
bin the low-order bits are kept, packed as hexadecimal text, and likeness is the share of equal bins
corrected for the equality that chance gives to so few bits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import words_of

SHINGLE_WORDS = 5
BINS_LOG2 = 7
BITS = 8  #: a multiple of 4: each bin takes whole hexadecimal digits
#: Text bytes that one bucket of neighbouring documents aims at, and the most buckets.
BUCKET_BYTES, MAX_BUCKETS = 8 << 20, 1 << 14


def _sum(array: Column) -> Column:
    return F.aggregate(array, F.lit(0), lambda a, x: a + x)


def with_fingerprint(df: DataFrame, text: str, out: str, words: int = SHINGLE_WORDS, bins_log2: int = BINS_LOG2, bits: int = BITS) -> DataFrame:
    """``df`` plus ``out``, the packed fingerprint of the column ``text``.

    A text of fewer words than a shingle is one shingle; a null or wordless text is the empty
    shingle. Equal word sequences have equal fingerprints. Everything happens within the row.
    """
    bins, shift, digits = 1 << bins_log2, 64 - bins_log2, bits // 4
    half, one = bins // 2, 1 << bits
    w, h, s, f, b = (f"_{out}_{x}" for x in ("words", "hashes", "sorted", "first", "bin"))
    bin_of = lambda x: F.shiftright(x, shift)  # noqa: E731  signed: -bins/2 .. bins/2 - 1, rising with the hash
    tagged = lambda i, x: i * one + x.bitwiseAND(F.lit(one - 1))  # noqa: E731  a bin and its low bits in one number
    df = df.withColumn(w, F.transform(words_of(F.col(text)), lambda x: F.xxhash64(x)))
    shingle = lambda i: F.xxhash64(F.slice(F.col(w), i, F.lit(words)))
    df = df.withColumn(h, F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (words - 1), F.lit(1))), shingle))
    df = df.withColumn(s, F.sort_array(h))
    df = df.withColumn(f, F.filter(s, lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get(F.col(s), i - 1)))))
    df = df.withColumn(b, F.transform(f, bin_of))
    every = F.sequence(F.lit(-half).cast("bigint"), F.lit(half - 1).cast("bigint"))

    def filled(i: Column) -> Column:
        """An empty bin with the low bits of its donor, the first filled bin on its walk."""
        start, stride = F.xxhash64(i, F.lit(1)).bitwiseAND(F.lit(0xFFFF)), F.xxhash64(i, F.lit(2)).bitwiseAND(F.lit(0xFFFF)).bitwiseOR(F.lit(1))
        place = lambda step: F.array_position(F.col(b), F.pmod(start + stride * step, F.lit(bins)) - half)
        # the walk in stretches, most of which are never entered
        first = lambda a, step: F.when(a > 0, a).otherwise(place(step))
        none = F.lit(0).cast("bigint")
        ends = F.array(*(F.array(F.lit(x), F.lit(y)) for x, y in ((1, 3), (4, 12), (13, 40), (41, bins))))
        donor = F.aggregate(ends, none, lambda a, e: F.when(a > 0, a).otherwise(F.aggregate(F.sequence(F.get(e, 0), F.get(e, 1)), none, first)))
        return tagged(i, F.get(F.col(f), donor.cast("int") - 1))

    own = F.transform(f, lambda x: tagged(bin_of(x), x))
    both = F.when(F.size(f) == bins, own).otherwise(F.sort_array(F.concat(own, F.transform(F.array_except(every, b), filled))))
    names = F.array(*(F.lit(f"{x:0{digits}x}") for x in range(one)))
    low = lambda x: F.get(names, x.bitwiseAND(F.lit(one - 1)).cast("int"))
    return df.withColumn(out, F.array_join(F.transform(both, low), "")).drop(w, h, s, f, b)


def likeness(a: str, b: str, bins_log2: int = BINS_LOG2, bits: int = BITS) -> Column:
    """Estimated Jaccard similarity of two packed fingerprints, 0 to 1; null if either is null."""
    bins, digits, chance = 1 << bins_log2, bits // 4, 2.0**-bits
    parts = lambda x: F.regexp_extract_all(F.col(x), F.lit("." * digits), F.lit(0))
    same = _sum(F.zip_with(parts(a), parts(b), lambda x, y: (x == y).cast("int")))
    return F.greatest(F.lit(0.0), (same / bins - chance) / (1 - chance))


def with_next(df: DataFrame, key: str, columns: list[str], size: str) -> DataFrame:
    """``df`` plus next_<c> for each of ``columns``: the value in the next row by ``key``, the first
    row's after the last; equal keys follow each other by ``columns``, a null key comes first.

    Rows go to buckets of neighbouring keys, cut at quantiles of the key so that no bucket grows with
    the table; each bucket also receives the rows that open the next one. One shuffle, whose tasks
    hold no more than a bucket each; ``size`` is the column that says how large a row is.
    """
    facts = df.agg(F.sum(F.col(size)).alias("bytes"), F.min(key).alias("low")).first()
    if facts["low"] is None and facts["bytes"] is None:
        for c in columns:
            df = df.withColumn(f"next_{c}", F.col(c))
        return df
    parts = max(1, min(MAX_BUCKETS, -(-int(facts["bytes"] or 0) // BUCKET_BYTES)))
    cuts = sorted({x for x in df.agg(F.percentile_approx(key, [i / parts for i in range(1, parts)] or [0.5], 100 * parts).alias("q")).first()["q"] or [] if x != facts["low"]}) if parts > 1 else []
    if cuts:
        steps = [1 << i for i in range(len(cuts).bit_length() - 1, -1, -1)]
        table = F.array(*map(F.lit, cuts))
        df = df.withColumn("_cuts", table)
        take = lambda p, s: F.when((p + s <= len(cuts)) & (F.get(F.col("_cuts"), p + s - 1) <= F.coalesce(F.col(key), F.lit(cuts[0] - 1))), p + s).otherwise(p)
        df = df.withColumn("_bucket", F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), take))
        opens = (F.col("_bucket") > 0) & (F.get(F.col("_cuts"), F.col("_bucket") - 1) == F.col(key))
        before = F.when(opens, F.col("_bucket") - 1)
    else:
        df = df.withColumns({"_cuts": F.lit(None), "_bucket": F.lit(0)})
        before = F.lit(None).cast("int")
    # where a null key exists it is the first row of all, else the smallest key is
    nulls = df.filter(F.col(key).isNull()).limit(1).count() > 0
    first = F.col(key).isNull() if nulls else F.col(key) == F.lit(facts["low"])
    copies = F.filter(F.array(F.struct(F.col("_bucket").alias("bucket"), F.lit(0).alias("turn")), F.struct(before.alias("bucket"), F.lit(1).alias("turn")), F.struct(F.when(first, F.lit(len(cuts))).alias("bucket"), F.lit(2).alias("turn"))), lambda x: x["bucket"].isNotNull())
    dealt = df.withColumn("_copy", F.explode(copies)).withColumns({"_bucket": F.col("_copy.bucket"), "_turn": F.col("_copy.turn")})
    order = Window.partitionBy("_bucket").orderBy("_turn", F.col(key).asc_nulls_first(), *columns)
    for c in columns:
        dealt = dealt.withColumn(f"next_{c}", F.lead(c).over(order))
    return dealt.filter("_turn = 0").drop("_cuts", "_bucket", "_copy", "_turn")


def edited_fingerprints(documents: DataFrame) -> DataFrame:
    """Each text against an edited one whose last quarter comes from the next document, and against
    the next document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next. Null texts count as empty; documents of equal doc_id follow each other by text."""
    docs = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("n_chars", F.length("text").cast("bigint"))
    docs = with_next(with_fingerprint(docs, "text", "fingerprint"), "doc_id", ["text", "fingerprint"], "n_chars")
    moved = F.floor(F.col("n_chars") / 4).cast("int")
    docs = docs.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - moved), F.substring(F.col("next_text"), F.lit(1), moved)))
    docs = with_fingerprint(docs.drop("text", "next_text"), "edited", "edited_fingerprint")
    return docs.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", likeness("fingerprint", "edited_fingerprint").alias("near_edited"), likeness("fingerprint", "next_fingerprint").alias("near_next"))
