"""Exact n-gram Jaccard join by vertical partitioning.

Documents with equal sets of word n-grams are one class. A class whose n-grams are mostly held by no
other document cannot have a partner; what remains is ordered rare n-grams first, and classes that
share an n-gram within their prefixes become candidates, if their lengths and the positions of the
shared n-gram allow the threshold. For candidates the global n-gram order is cut into fragments;
each fragment's overlap is counted on its own and the counts are summed per pair.

Within a bucket of classes that share an n-gram, everyone is first compared with the bucket's most
typical member only. Once those links are joined into components, what is left are pairs across
components, which are then compared in full. So a group of many near copies costs links in
proportion to its members, and no link that could join two components is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, free_shuffles, materialize, words_of
from .components import components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FRAGMENTS = 4
#: Classes (four numbers each) up to this number are broadcast to select texts; beyond it they are joined.
BROADCAST_IDS = 500_000


def ngram_set(text: Column, words: int) -> Column:
    """Sorted distinct 64-bit hashes of the word n-grams; a shorter text is one n-gram, a wordless
    or null one has none."""
    w = words_of(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER))
    return w, lambda a: F.when(F.size(a) == 0, F.array().cast("array<bigint>")).otherwise(
        F.sort_array(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size(a) - (words - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(a, i, F.lit(words))))))
    )


def _with_sets(docs: DataFrame, words: int) -> DataFrame:
    w, of = ngram_set(F.col("text"), words)
    return docs.withColumn("_w", w).withColumn("tokens", of(F.col("_w"))).drop("_w", "text")


class JaccardJoin:
    """Classes, links and components of a table of (doc_id, text).

    ``num``/``den`` is the least similarity. Null and empty texts have no n-grams and no partner;
    rows of equal doc_id are allowed and share a class if their texts agree.
    """

    def __init__(self, documents: DataFrame, words: int = 5, num: int = 4, den: int = 5, fragments: int = FRAGMENTS) -> None:
        self.docs = documents.select("doc_id", "text")
        self.words, self.num, self.den, self.fragments = words, num, den, fragments
        #: Share of the hash space whose n-grams are counted for all documents: more than 1 - similarity.
        self.zone = min(1.0, 1.6 * (den - num) / den)
        self._run()

    def _spare(self, n: Column) -> Column:
        """How many of a class's n-grams a partner may lack at most: n - ceil(similarity * n)."""
        return n - F.floor((n * self.num + (self.den - 1)) / self.den).cast("int")

    def _run(self) -> None:
        top = F.lit(-(2**63) + int(self.zone * (2**64 - 1)))
        sets = _with_sets(self.docs, self.words)
        facts = sets.select("doc_id", F.size("tokens").alias("n"), F.xxhash64("tokens").alias("k1"), F.xxhash64("tokens", F.lit(1)).alias("k2"), F.filter("tokens", lambda x: x <= top).alias("zone"))
        zones = materialize(facts, "ngram-zones")
        #: doc_id, n, k1, k2: one row a document.
        self.facts = materialize(zones.drop("zone"), "ngram-facts")
        classes = self.facts.filter("n > 0 and doc_id is not null").groupBy("k1", "k2").agg(F.min("doc_id").alias("doc_id"), F.min("n").alias("n"))
        #: cid, doc_id (the smallest), n, k1, k2: one row a set, with a number of its own that is fixed
        #: when the table is written, as one id may stand for several sets.
        self.classes = materialize(classes.withColumn("cid", F.monotonically_increasing_id()), "ngram-classes")
        # n-grams of the zone that no other row holds, counted for their only holder
        alone = zones.filter("n > 0").select(F.explode("zone").alias("token"), "k1").groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.min("k1").alias("k1"))
        lonely = alone.filter("df = 1").groupBy("k1").agg(F.count(F.lit(1)).alias("u"))
        kept = self.classes.join(lonely, "k1", "left").filter(F.coalesce("u", F.lit(0)) <= self._spare(F.col("n"))).select("cid", "k1", "k2", F.col("doc_id").alias("_id"))
        kept = materialize(kept, "ngram-kept")
        discard(zones)
        # both carry a few numbers a class; within the bound no text or set is shuffled to meet them
        few = kept.count() <= BROADCAST_IDS
        chosen = self.docs.join(F.broadcast(kept.select("_id")) if few else kept.select("_id"), F.col("doc_id") == F.col("_id"), "left_semi")
        # rows may repeat a doc_id, and an id several sets: one row for each class
        own = _with_sets(chosen, self.words).withColumns({"k1": F.xxhash64("tokens"), "k2": F.xxhash64("tokens", F.lit(1))})
        own = own.join(F.broadcast(kept) if few else kept, ["k1", "k2"]).filter("doc_id = _id").select("cid", F.size("tokens").alias("n"), "tokens").dropDuplicates(["cid"])
        self.sets = materialize(own, "ngram-sets")
        free_shuffles(self.docs.sparkSession)
        rows = self.sets.select(F.explode("tokens").alias("token"), "cid", "n")
        shared = rows.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
        ranked = rows.join(shared, "token").groupBy("cid", "n").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("held"))
        u = F.col("n") - F.size("held")
        ranked = ranked.withColumn("u", u).filter(F.col("u") <= self._spare(F.col("n"))).withColumn("held", F.slice("held", F.lit(1), self._spare(F.col("n")) + 1 - F.col("u")))
        prefix = ranked.select("cid", "n", "u", F.posexplode("held").alias("at", "x")).select(F.col("x.token").alias("token"), "cid", "n", (F.col("u") + F.col("at")).alias("pos"))
        # lengths in steps of the least ratio: partners lie in the same step or the next
        self.rows = materialize(prefix.withColumn("band", F.floor(F.log(F.col("n")) / F.log(F.lit(self.den / self.num))).cast("int")), "ngram-prefixes")
        links = materialize(self.verified(self._typical()), "ngram-links")
        labels = components(links)
        more = materialize(self.verified(self._across(labels)), "ngram-links")
        discard(kept, self.sets, self.rows)
        #: a < b: pairs of classes whose similarity was found to reach the threshold.
        self.links = links.unionByName(more).distinct()
        self.labels = components(self.links) if more.limit(1).count() else labels

    def _possible(self, x: str, y: str) -> Column:
        """Can the pair reach the threshold, given lengths and the places of one shared n-gram."""
        n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
        most = F.least(n - F.col(f"{x}.pos"), m - F.col(f"{y}.pos"))
        return (F.least(n, m) * self.den >= F.greatest(n, m) * self.num) & (most * (self.num + self.den) >= (n + m) * self.num)

    def _typical(self) -> DataFrame:
        """Candidate pairs of each class with the most typical class of its bucket, the one with the
        fewest rarer n-grams for its length, of its own and of the next smaller length step."""
        hubs = self.rows.groupBy("token", "band").agg(F.min(F.struct((F.col("pos") / F.col("n")).alias("r"), "cid", "n", "pos")).alias("hub"))
        hubs = hubs.select("token", "band", "hub.cid", "hub.n", "hub.pos")
        hubs = hubs.unionByName(hubs.withColumn("band", F.col("band") + 1))
        x, y = self.rows.alias("x"), hubs.alias("y")
        pairs = x.join(y, ["token", "band"]).filter((F.col("x.cid") != F.col("y.cid")) & self._possible("x", "y"))
        return pairs.select(F.least("x.cid", "y.cid").alias("a"), F.greatest("x.cid", "y.cid").alias("b")).distinct()

    def _across(self, labels: DataFrame) -> DataFrame:
        """Every possible candidate pair of different components. Of a bucket's pairs one side is
        always outside the component that holds most of it."""
        named = self.rows.join(labels.select(F.col("node").alias("cid"), "component"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
        sizes = named.groupBy("token", "component").agg(F.count(F.lit(1)).alias("size"))
        main = sizes.groupBy("token").agg(F.max(F.struct("size", "component")).alias("top"), F.count(F.lit(1)).alias("k")).filter("k > 1").select("token", F.col("top.component").alias("main"))
        mixed = named.join(main, "token")
        x, y = mixed.filter("component <> main").alias("x"), mixed.alias("y")
        apart = (F.col("x.component") != F.col("y.component")) & (F.abs(F.col("x.band") - F.col("y.band")) <= 1) & ((F.col("y.component") == F.col("y.main")) | (F.col("x.cid") < F.col("y.cid")))
        pairs = x.join(y, (F.col("x.token") == F.col("y.token")) & apart & self._possible("x", "y"))
        return pairs.select(F.least("x.cid", "y.cid").alias("a"), F.greatest("x.cid", "y.cid").alias("b")).distinct()

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that reach the threshold: overlaps counted by fragment, summed per pair."""
        width = 2**64 // self.fragments
        cut = [(-(2**63) + i * width, 2**63 - 1 if i + 1 == self.fragments else -(2**63) + (i + 1) * width - 1) for i in range(self.fragments)]
        part = lambda low, high: F.filter("tokens", lambda x: (x >= low) & (x <= high))
        parts = F.array(*(F.struct(F.lit(i).alias("fragment"), part(*ends).alias("part")) for i, ends in enumerate(cut)))
        pieces = self.sets.select("cid", "n", F.explode(parts).alias("f")).select("cid", "n", "f.fragment", "f.part")
        left = pairs.join(pieces.select(F.col("cid").alias("a"), F.col("n").alias("na"), "fragment", F.col("part").alias("pa")), "a")
        both = left.join(pieces.select(F.col("cid").alias("b"), F.col("n").alias("nb"), "fragment", F.col("part").alias("pb")), ["b", "fragment"])
        summed = both.groupBy("a", "b", "na", "nb").agg(F.sum(F.size(F.array_intersect("pa", "pb"))).alias("o"))
        return summed.filter(F.col("o") * self.den >= (F.col("na") + F.col("nb") - F.col("o")) * self.num).select("a", "b")

    def membership(self) -> DataFrame:
        """doc_id, n_shingles, component_id for every row of the input."""
        named = self.classes.join(self.labels.select(F.col("node").alias("cid"), "component"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
        least = named.groupBy("component").agg(F.min("doc_id").alias("least"))
        comps = named.join(least, "component").select("k1", "k2", F.col("least").alias("component"))
        docs = self.facts.select("doc_id", "n", "k1", "k2")
        held = docs.join(comps, ["k1", "k2"], "left")
        return held.select("doc_id", F.col("n").cast("bigint").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component")).alias("component_id"))


def ngram_components(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id at 3-word shingles and a similarity of 90 %.

    Every row keeps a row. Null, empty and blank texts have the size 0 and their own id as component;
    rows without an id have no partner and a null component, or that of a row with the same set. An id
    with several texts counts for each of them. An empty table gives none; other columns are not read."""
    return JaccardJoin(documents, words=3, num=9, den=10).membership()


def keep_representatives(documents: DataFrame, words: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """The documents less near duplicates: of each component the row of the smallest doc_id stays, of
    several rows with one doc_id the one whose text comes first. Rows without an id all stay."""
    found = JaccardJoin(documents, words, num, den).membership()
    gone = found.filter("doc_id <> component_id").select("doc_id").distinct()
    kept = documents.join(gone, "doc_id", "left_anti")
    twice = materialize(found.filter("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id"), "ngram-twice")
    if twice.limit(1).count() == 0:
        return kept
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_last(), F.xxhash64(*(c for c in documents.columns if c != "text"))))
    first = kept.join(twice, "doc_id", "left_semi").withColumn("_rank", rank).filter("_rank = 1").drop("_rank")
    return kept.join(twice, "doc_id", "left_anti").unionByName(first).select(*documents.columns)
