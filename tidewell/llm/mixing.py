"""Mixing sources to target weights.

Each source's words, packed in a pseudorandom order of its documents, are cut into blocks of a
fixed number of words. Every output shard draws its source counts from a multinomial distribution;
a source's slots, numbered over all shards, are mapped through pseudorandom permutations of the
source's block numbers, one permutation for each pass over the source, and joined to the blocks by
number. Draws beyond a source's quota are given to sources below theirs, so that totals are exact
to a block and no block is used more often than a source may be repeated.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, word_count

BLOCK_WORDS = 32
SHARD_BLOCKS = 4096
MAX_REPEATS = 3
SEED = 20240229
#: Rows, and shards, of one prefix-sum bucket.
BUCKET_ROWS, SHARD_GROUP = 4096, 1024
#: Sources up to which facts of theirs are broadcast.
BROADCAST_SOURCES = 100_000


def cyclic_weights(sources: list[str | None]) -> dict[str | None, int]:
    """Weights 1, 2, 3, repeating, for sources by code point, null last."""
    order = sorted((s for s in sources if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sources else [])
    return {s: i % 3 + 1 for i, s in enumerate(order)}


def capped_targets(sizes: dict, weights: dict, most: float = MAX_REPEATS) -> dict:
    """Shares of the total by weight, none above ``most`` times its size; the excess is shared again
    by weight among the rest until none is above."""
    total, held, free = float(sum(sizes.values())), {}, set(sizes)
    while free:
        left, weight = total - sum(held.values()), sum(weights[s] for s in free)
        over = {s for s in free if left * weights[s] / weight > most * sizes[s]}
        if not over:
            return held | {s: left * weights[s] / weight for s in free}
        held |= {s: float(most * sizes[s]) for s in over}
        free -= over
    return held


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """The images of ``index`` under a pseudorandom permutation of 0 .. n-1 named by ``key``: a
    Feistel network over the next even power of two, walked until the image is below n."""
    if n <= 1:
        return np.zeros_like(index)
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for turn in range(4):
            with np.errstate(over="ignore"):
                v = (right + np.uint64((key * 0x9E3779B97F4A7C15 + turn * 0xD1B54A32D192ED03) & (2**64 - 1))) * np.uint64(0xBF58476D1CE4E5B9)
                v ^= v >> np.uint64(29)
                v *= np.uint64(0x94D049BB133111EB)
                v ^= v >> np.uint64(32)
            left, right = right, left ^ (v & mask)
        return left << np.uint64(half) | right

    out = once(index.astype(np.uint64))
    while (over := out >= n).any():
        out[over] = once(out[over])
    return out.astype(np.int64)


def _key(*parts: object) -> int:
    text = "\x1f".join("\x00" if p is None else str(p) for p in parts).encode()
    return zlib.crc32(text) << 32 | zlib.crc32(b"x" + text)


def sized(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("digest"))


def packed(docs: DataFrame, n_docs: int, seed: int = SEED) -> DataFrame:
    """``docs`` (doc_id, source, size) plus ``start``, the document's first word within its source.

    Documents are dealt to buckets by a hash of their id; a source's order is by bucket, then by
    hash and id. A window within (source, bucket) and another over the bucket sums give the running
    total: no task holds a source, however much of the table that is.
    """
    buckets = max(1, -(-n_docs // BUCKET_ROWS))
    docs = docs.withColumn("_hash", F.xxhash64(F.col("doc_id"), F.lit(seed))).withColumn("_bucket", F.pmod(F.col("_hash"), F.lit(buckets)).cast("int"))
    sums = docs.groupBy("source", "_bucket").agg(F.sum("size").alias("n"))
    base = sums.select(F.col("source").alias("_source"), F.col("_bucket").alias("_b"), (F.sum("n").over(Window.partitionBy("source").orderBy("_bucket")) - F.col("n")).alias("_base"))
    inner = Window.partitionBy("source", "_bucket").orderBy("_hash", "doc_id", "size", "digest").rowsBetween(Window.unboundedPreceding, -1)
    docs = docs.withColumn("_before", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    return docs.join(base, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_bucket") == F.col("_b"))).select("doc_id", "source", "size", "digest", (F.col("_base") + F.col("_before")).alias("start"))


def block_quotas(sizes: dict, targets: dict, block: int) -> dict:
    """Whole blocks that each source gives: its target in blocks of its own mean length, and never
    more than the repeats that its target allows."""
    out = {}
    for s, size in sizes.items():
        n = -(-size // block)
        out[s] = min(MAX_REPEATS * n, round(targets[s] / (size / n))) if n else 0
    return out


def draw_shards(spark: SparkSession, quotas: list[int], shard_blocks: int = SHARD_BLOCKS, seed: int = SEED) -> DataFrame:
    """shard, source_no, n: the multinomial draw of each output shard, each from its own generator."""
    total = sum(quotas)
    shards = max(1, -(-total // shard_blocks))
    share = np.array(quotas, float) / max(1, total)
    share /= share.sum() or 1.0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for shard in b["id"]:
                size = min(shard_blocks, total - int(shard) * shard_blocks)
                n = np.random.default_rng([seed, int(shard)]).multinomial(size, share)
                yield pd.DataFrame({"shard": int(shard), "source_no": np.arange(len(share)), "n": n})

    if not total:
        return spark.createDataFrame([], "shard long, source_no long, n long")
    return spark.range(0, shards, 1, max(1, min(shards, 4 * spark.sparkContext.defaultParallelism))).mapInPandas(run, "shard long, source_no long, n long")


def slots(draws: DataFrame, quotas: list[int]) -> DataFrame:
    """shard, source_no, low, high: runs of slot numbers of a source, each number below its quota once.

    A source's draws are numbered over the shards, first within groups of SHARD_GROUP shards and then
    over the groups, so that no task holds all runs of a large source. Numbers from its quota on are
    excess; the excess of all sources, numbered in turn, falls to the sources that drew too few: the
    needs it meets are found in a sorted array of their bounds, not by comparing all with all.
    """
    spark = draws.sparkSession
    runs = draws.filter("n > 0").withColumn("_group", F.floor(F.col("shard") / SHARD_GROUP))
    sums = runs.groupBy("source_no", "_group").agg(F.sum("n").alias("_n"))
    sums = sums.withColumn("_base", F.sum("_n").over(Window.partitionBy("source_no").orderBy("_group")) - F.col("_n"))
    by = Window.partitionBy("source_no", "_group").orderBy("shard")
    runs = runs.withColumn("_within", F.sum("n").over(by)).join(sums.select("source_no", "_group", "_base"), ["source_no", "_group"])
    runs = runs.withColumn("_end", F.col("_base") + F.col("_within")).withColumn("_start", F.col("_end") - F.col("n"))
    totals = {r["source_no"]: r["t"] for r in draws.groupBy("source_no").agg(F.sum("n").alias("t")).collect()}
    over, under, at = {}, [], 0
    for s, q in enumerate(quotas):
        if (t := totals.get(s, 0)) > q:
            over[s] = at
            at += t - q
    gap = 0
    for s, q in enumerate(quotas):
        if (t := totals.get(s, 0)) < q:
            under.append((s, gap, gap + q - t, t))
            gap += q - t
    limits = spark.createDataFrame([(s, q, over.get(s, 0)) for s, q in enumerate(quotas)], "source_no long, quota long, first long")
    runs = runs.join(F.broadcast(limits) if len(quotas) <= BROADCAST_SOURCES else limits, "source_no")
    kept = runs.select("shard", "source_no", F.col("_start").alias("low"), F.least("_end", "quota").alias("high")).filter("low < high")
    excess = runs.filter("_end > quota").select("shard", (F.col("first") + F.greatest(F.col("_start") - F.col("quota"), F.lit(0))).alias("a"), (F.col("first") + F.col("_end") - F.col("quota")).alias("b"))
    if not under:
        return kept
    meets = partial(_met, under)
    given = excess.mapInPandas(meets, "shard long, source_no long, low long, high long")
    return kept.unionByName(given)


def _met(needs: list[tuple[int, int, int, int]], batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs of excess [a, b) cut at the bounds of the needs (source, from, to, drawn) that they meet."""
    source, low, high, drawn = (np.array(x, np.int64) for x in zip(*needs, strict=True))
    for b in batches:
        first, last = np.searchsorted(high, b["a"], side="right"), np.searchsorted(low, b["b"], side="left")
        size = np.maximum(last - first, 0)
        row = np.repeat(np.arange(len(b)), size)
        need = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first, size)
        begin, end = np.maximum(b["a"].to_numpy()[row], low[need]), np.minimum(b["b"].to_numpy()[row], high[need])
        yield pd.DataFrame({"shard": b["shard"].to_numpy()[row], "source_no": source[need], "low": drawn[need] + begin - low[need], "high": drawn[need] + end - low[need]})


def slot_blocks(runs: DataFrame, counts: list[int], keys: list[int]) -> DataFrame:
    """shard, slot, source_no, block: each slot's block by its pass's permutation. Runs, of one shard
    each, are dealt evenly before they are told slot by slot."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for shard, s, low, high in zip(b["shard"], b["source_no"], b["low"], b["high"], strict=True):
                slot = np.arange(low, high)
                n = counts[s]
                turn, inside = slot // n, slot % n
                block = np.empty_like(slot)
                for t in np.unique(turn):
                    at = turn == t
                    block[at] = permuted(inside[at], n, keys[s] + int(t))
                yield pd.DataFrame({"shard": shard, "slot": slot, "source_no": s, "block": block})

    return runs.select("shard", "source_no", "low", "high").repartition("shard", "source_no", "low").mapInPandas(run, "shard long, slot long, source_no long, block long")


class Mix:
    """The mix of a table of documents: ``plan`` (per source), ``pieces`` (which words of which
    block a document holds) and ``slots`` (which block stands where in the output).

    Source facts (one row a source) come to the driver; documents, blocks and slots do not. A null
    source is a source of its own; null texts have no words; repeated doc_ids are documents of their
    own.
    """

    def __init__(self, documents: DataFrame, weights=cyclic_weights, block_words: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS, seed: int = SEED) -> None:
        spark = documents.sparkSession
        docs = sized(documents)
        facts = docs.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("docs")).collect()
        self.sizes = {r["source"]: int(r["size"]) for r in facts}
        self.n_docs = sum(r["docs"] for r in facts)
        given = weights(list(self.sizes)) if callable(weights) else weights
        self.targets = capped_targets(self.sizes, given)
        order = list(given)
        quotas = block_quotas(self.sizes, self.targets, block_words)
        self.quotas = [quotas[s] for s in order]
        counts = [-(-self.sizes[s] // block_words) for s in order]
        names = spark.createDataFrame([(s, i, self.sizes[s], self.targets[s]) for i, s in enumerate(order)], "_name string, source_no long, source_size long, target double")
        self.docs = packed(docs, self.n_docs, seed).join(F.broadcast(names) if len(order) <= BROADCAST_SOURCES else names, F.col("source").eqNullSafe(F.col("_name"))).drop("_name")
        self.slots = slot_blocks(slots(draw_shards(spark, self.quotas, shard_blocks, seed), self.quotas), counts, [_key(seed, s) for s in order])
        block = F.explode(F.sequence(F.floor(F.col("start") / block_words), F.floor((F.col("start") + F.col("size") - 1) / block_words)))
        first = F.col("block") * block_words
        self.pieces = self.docs.filter("size > 0").withColumn("block", block).select(
            "doc_id", "digest", "source_no", "block", "start", "size",
            F.greatest(first - F.col("start"), F.lit(0)).alias("low"),
            F.least(first + block_words - F.col("start"), F.col("size")).alias("high"),
        )

    def taken(self) -> DataFrame:
        """doc_id, size, source_size, target, taken: the words of each document that the mix takes."""
        uses = self.slots.groupBy("source_no", "block").agg(F.count(F.lit(1)).alias("uses"))
        got = self.pieces.join(uses, ["source_no", "block"]).groupBy("doc_id", "source_no", "start").agg(F.sum((F.col("high") - F.col("low")) * F.col("uses")).alias("got"))
        joined = self.docs.alias("d").join(got.alias("g"), F.col("d.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("d.source_no") == F.col("g.source_no")) & (F.col("d.start") == F.col("g.start")) & (F.col("d.size") > 0), "left")
        return joined.select("d.doc_id", "d.size", "d.source_size", "d.target", F.coalesce("g.got", F.lit(0)).cast("bigint").alias("taken"), F.col("d.source").alias("source"))

    def assembled(self) -> DataFrame:
        """shard, slot, source_no, doc_id, low, high: the words of the output in order."""
        return self.slots.join(self.pieces, ["source_no", "block"]).select("shard", "slot", "source_no", "doc_id", "low", "high")


def mixed(documents: DataFrame) -> DataFrame:
    """One row per document; see :class:`Mix`. Null and blank texts have the size 0 and nothing taken,
    repeated rows are packed one after the other, a null source is a source of its own, an empty table
    gives an empty result; other columns are not read."""
    return Mix(documents).taken()


_WORDS = re.compile(WORD)


def taken_texts(text: str, pieces: list[tuple[int, int, int]]) -> list[str]:
    """For (low, high, uses) ranges of a text's words the texts that are taken: the r-th holds the
    ranges used r times or more, neighbouring ones with the blanks between them as they stand."""
    spans = [m.span() for m in _WORDS.finditer(text)]
    out = []
    for r in range(1, max((u for _, _, u in pieces), default=0) + 1):
        runs: list[list[int]] = []
        for low, high, uses in sorted(pieces):
            if uses < r:
                continue
            if runs and runs[-1][1] == low:
                runs[-1][1] = high
            else:
                runs.append([low, high])
        whole = runs == [[0, len(spans)]]
        out.append(text if whole else "\n".join(text[spans[a][0] : spans[b - 1][1]] for a, b in runs))
    return out


def mixed_documents(documents: DataFrame, **options) -> DataFrame:
    """The mix as rows of ``documents``: as many rows of a document as its most used block has uses,
    each with the words that are taken that often; documents of which nothing is taken go. n_chars,
    where there is such a column, is counted anew. Rows that agree in id, source and text are taken
    alike."""
    mix = Mix(documents, **options)
    uses = mix.slots.groupBy("source_no", "block").agg(F.count(F.lit(1)).alias("uses"))
    got = mix.pieces.join(uses, ["source_no", "block"]).groupBy("doc_id", "digest", "source_no", "start").agg(F.collect_list(F.struct("low", "high", "uses")).alias("pieces"))
    got = got.groupBy("doc_id", "digest", "source_no").agg(F.min_by("pieces", "start").alias("_pieces"))
    names = mix.docs.select("source", "source_no").distinct()
    got = got.join(names, "source_no").select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"), F.col("source").alias("_source"), "_pieces")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_source")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("_digest"))
    rows = documents.join(got, same).drop("_id", "_digest", "_source")

    @F.pandas_udf("array<string>")
    def cut(text: pd.Series, pieces: pd.Series) -> pd.Series:
        return pd.Series([taken_texts(t, [(p["low"], p["high"], p["uses"]) for p in ps]) for t, ps in zip(text, pieces, strict=True)])

    rows = rows.withColumn("text", F.explode(cut("text", "_pieces")))
    if "n_chars" in documents.columns:
        rows = rows.withColumn("n_chars", F.length("text").cast(documents.schema["n_chars"].dataType))
    return rows.select(*documents.columns)
