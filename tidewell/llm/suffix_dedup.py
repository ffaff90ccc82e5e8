"""Removal of repeated byte strings by enhanced suffix arrays.

A byte goes if it lies in a string of ``least`` bytes that also starts earlier. The corpus is cut
into buckets so that equal strings of that length always meet: every window of ``least`` bytes
belongs to the smallest hash among its k-grams, neighbouring windows of one hash form a stretch, and
stretches of one hash form a bucket. Equal stretches are settled by an aggregate; large buckets are
cut again by longer k-grams. For the different stretches of a bucket a suffix
array with its common-prefix table is built; a stack scan walks the tree of common-prefix intervals,
and intervals whose occurrences differ in the byte before them are the maximal repeats, given with
all their occurrences.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, free_shuffles, materialize, trim

LEAST = 100
KGRAM = 32
#: Windows of one stretch at most; longer (periodic) ones are cut.
STRETCH = 256
#: Bytes hashed at a time, and stretches of one bucket that one suffix array takes; the stretches of
#: larger buckets are cut again by longer k-grams until they fit.
CHUNK, BUCKET = 1 << 18, 1024
#: Bits of the prefilters, which only spare work: what they let through is compared exactly.
FILTER_BITS = 1 << 26
#: Spreads the starts of a document's stretches over a prefilter.
SPREAD = 2654435761
#: Rows up to which the spans to remove are broadcast; beyond it documents are joined by id.
BROADCAST_ROWS = 500_000

_rng = np.random.default_rng(20240311)
_TABLE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def _powers(n: int, base: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n - 1, base, np.uint64))]) if n > 1 else np.ones(n, np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * _MIX
        return x ^ (x >> np.uint64(30))


def _sliding(x: np.ndarray, w: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over every ``w`` neighbours."""
    step, out = 1, x
    while step * 2 <= w:
        out = pick(out[:-step], out[step:])
        step *= 2
    return pick(out[: len(x) - w + 1], out[w - step : w - step + len(x) - w + 1]) if step < w else out


class Hasher:
    """Stretches of a run of texts: see :meth:`stretches`."""

    def __init__(self, least: int = LEAST, kgram: int = KGRAM, longest: int = STRETCH) -> None:
        self.least, self.kgram, self.wide, self.longest = least, kgram, least - kgram + 1, longest
        self.up = self.down = np.ones(0, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.up) < n:
            self.up, self.down = _powers(n, _BASE), _powers(n, pow(_BASE, -1, 2**64))

    def stretches(self, texts: list[bytes]) -> dict[str, np.ndarray]:
        """For texts of at least ``least`` bytes: text (its number), start, length, key (the smallest
        k-gram hash), same (a hash of the whole stretch), ties (how often the smallest k-gram
        stands in it), and marks (the hashes of all chosen k-gram places)."""
        buf = np.frombuffer(b"".join(texts), np.uint8)
        sizes = np.array([len(t) for t in texts], np.int64)
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        n, k, w, least = len(buf), self.kgram, self.wide, self.least
        self._grow(n + 1)
        with np.errstate(over="ignore"):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_TABLE[buf] * self.up[:n])])
            grams = _mixed((sums[k:] - sums[:-k]) * self.down[: n - k + 1])
        lows = _sliding(grams, w, np.minimum)  # one for each window start
        inside = np.ones(len(lows), bool)
        for end in offsets[1:-1]:
            inside[end - least + 1 : end] = False
        starts = np.flatnonzero(inside)
        value = lows[starts]
        new = np.ones(len(starts), bool)
        new[1:] = (value[1:] != value[:-1]) | (starts[1:] != starts[:-1] + 1)
        first = np.flatnonzero(new)
        run = np.cumsum(new) - 1
        cut = (np.arange(len(starts)) - first[run]) % self.longest == 0
        first = np.flatnonzero(cut)
        count = np.diff(np.append(first, len(starts)))
        begin, key = starts[first], value[first]
        length = count + least - 1
        with np.errstate(over="ignore"):
            same = _mixed((sums[begin + length] - sums[begin]) * self.down[begin]) ^ length.astype(np.uint64)
        top = _sliding(np.concatenate([np.zeros(w - 1, np.uint64), np.where(inside, lows, np.uint64(0)), np.zeros(w - 1, np.uint64)]), w, np.maximum)
        chosen = np.flatnonzero(top == grams)
        marks = grams[chosen]
        # how many chosen places of a stretch bear its key
        a, b = np.searchsorted(chosen, begin), np.searchsorted(chosen, begin + length - k + 1)
        number = np.repeat(np.arange(len(first)), b - a)
        at = np.arange(len(number)) - np.repeat(np.cumsum(b - a) - (b - a), b - a) + np.repeat(a, b - a)
        ties = np.bincount(number[marks[at] == key[number]], minlength=len(first)) if len(first) else np.zeros(0, int)
        text = np.searchsorted(offsets, begin, side="right") - 1
        return {"text": text, "start": begin - offsets[text], "length": length, "key": key.view(np.int64), "same": same.view(np.int64), "ties": ties, "marks": marks.view(np.int64)}


def chunked(ids: Iterable, texts: Iterable[bytes], least: int, chunk: int = CHUNK) -> Iterator[tuple[list, list[int], list[bytes]]]:
    """Runs of about ``chunk`` bytes: ids, offsets within their texts, pieces. Longer texts are cut
    into pieces that overlap by one byte less than a window."""
    held: tuple[list, list, list] = ([], [], [])
    size = 0
    for i, t in zip(ids, texts, strict=True):
        for at in range(0, max(1, len(t) - least + 1), chunk):
            piece = t[at : at + chunk + least - 1]
            if len(piece) < least:
                continue
            for x, y in zip(held, (i, at, piece), strict=True):
                x.append(y)
            size += len(piece)
            if size >= chunk:
                yield held
                held, size = ([], [], []), 0
    if size:
        yield held


def suffix_array(texts: list[bytes], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sorted suffixes of at least ``least`` bytes: text number and start by row, and the length of
    the prefix that each row has in common with the next one.

    Prefix doubling: ranks of the first 1, 2, 4, ... bytes, each from the pair before. A mark of its
    own ends every text, so nothing is equal across an end. The ranks kept from every round give the
    common prefixes of neighbours by halving."""
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes + 1) - 1
    n = int(ends[-1]) + 1 if len(texts) else 0
    rank = np.empty(n, np.int64)
    body = np.ones(n, bool)
    body[ends] = False
    rank[body] = np.frombuffer(b"".join(texts), np.uint8).astype(np.int64) + len(texts)
    rank[ends] = np.arange(len(texts))
    levels, most, base = [rank], max(sizes.tolist(), default=0), 256 + len(texts)
    while (step := 1 << (len(levels) - 1)) < most:
        pair = rank * base
        pair[:-step] += rank[step:]
        if base * base <= 1 << 31:
            rank, base = pair, base * base  # pairs are their own ranks while they are small
        else:
            order = np.argsort(pair)
            sorted_ = pair[order]
            new = np.ones(n, bool)
            new[1:] = sorted_[1:] != sorted_[:-1]
            rank, base = np.empty(n, np.int64), n
            rank[order] = np.cumsum(new) - 1
            if new.all():
                levels.append(rank)
                break
        levels.append(rank)
    place = np.arange(n)
    text = np.searchsorted(ends, place)
    long = body & (ends[text] - place >= least)
    rows = place[long][np.argsort(rank[long])]
    one, two = rows[:-1].copy(), rows[1:].copy()
    common = np.zeros(len(rows), np.int64)
    for i in range(len(levels) - 1, -1, -1):
        equal = np.flatnonzero((one < n) & (two < n))
        equal = equal[levels[i][one[equal]] == levels[i][two[equal]]]
        for x in (one, two, common):
            x[equal] += 1 << i
    return text[rows], rows - np.concatenate([[0], ends + 1])[text[rows]], common


def intervals(texts: list[bytes], least: int, rank=None) -> Iterator[tuple[int, int, int, bool, list[int]]]:
    """The tree of common-prefix intervals of the texts' suffixes, children before parents.

    Yields (length, first row, last row, left-diverse, losers) over the suffix array that the first
    item, a list of (text number, start) by row, gives. ``rank`` orders rows; of each interval the
    least row goes on to the parent, and the others that came from its children are its losers, so
    that every row loses once: in the longest common prefix that another, lesser row shares.
    """
    number, start, common_ = suffix_array(texts, least)
    rows = list(zip(number.tolist(), start.tolist(), strict=True))
    yield 0, 0, -1, False, rows  # type: ignore[misc]
    # rows whose prefix of ``least`` bytes stands alone open no interval
    with_next = common_ >= least
    member = with_next.copy()
    member[1:] |= with_next[:-1]
    # open intervals: common prefix, first row, the byte before (None: several), least rows of what closed within
    stack: list[list] = []
    key: dict[int, object] = {}
    for row in np.flatnonzero(member).tolist():
        n, i = rows[row]
        common = int(common_[row])
        key[row] = rank(rows[row]) if rank else row
        # a text's first byte differs from every other
        left, best, before = row, row, texts[n][i - 1] if i else -1 - row
        while stack and stack[-1][0] > common:
            length, left, came, mins = stack.pop()
            mins.append(best)
            before = before if came == before else None
            best = min(mins, key=key.__getitem__)
            yield length, left, row, before is None, [m for m in mins if m != best]
        if common < least:
            continue
        if stack and stack[-1][0] == common:
            stack[-1][3].append(best)
            if stack[-1][2] != before:
                stack[-1][2] = None
        else:
            stack.append([common, left, before, [best]])


def maximal_repeats(texts: list[bytes], least: int) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """(length, [(text number, start), ...]) of every maximal repeat of at least ``least`` bytes:
    strings with all their occurrences, two or more, that no byte extends to the left or right
    without losing one. Matches do not cross texts; overlapping occurrences count."""
    tree = intervals(texts, least)
    rows = next(tree)[4]
    for length, first, last, diverse, _ in tree:
        if diverse:
            yield length, rows[first : last + 1]


def repeated_spans(places: list[tuple], texts: list[bytes], least: int) -> list[list[tuple[int, int]]]:
    """For each text the (start, end) covered by repeats that occur earlier; ``places`` order the
    texts, as (document key..., offset). Only maximal repeats mark: an interval whose occurrences all
    follow one byte is marked with that byte, by the interval that begins there."""
    tree = intervals(texts, least, lambda x: (*places[x[0]][:-1], places[x[0]][-1] + x[1]))
    rows = next(tree)[4]
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    for length, _, _, diverse, losers in tree:
        if diverse:
            for j in losers:
                n, i = rows[j]
                out[n].append((i, i + length))
    return [merged(x) for x in out]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _filter_of(df: DataFrame, column: str, bits: int) -> np.ndarray:
    """A bit table of fixed size with the places of the column's hashes set; combined before the
    shuffle and gathered as words."""
    place = F.col(column).bitwiseAND(F.lit(bits - 1))
    words = df.select(place.alias("p")).select(F.shiftright("p", 6).alias("w"), F.expr("shiftleft(1L, cast(p & 63 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    out = np.zeros(bits // 64, np.int64)
    for batch in words.toArrow().to_batches():
        out[batch.column("w").to_numpy()] = batch.column("b").to_numpy()
    return out


def _passes(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = hashes & np.int64(len(table) * 64 - 1)
    return (table[place >> 6] >> (place & 63)) & 1 == 1


_STRETCH_SCHEMA = "id long, digest long, start long, length int, key long, same long, ties int"


class SuffixDedup:
    """Spans to remove from a table of (doc_id, text).

    Documents are ordered by doc_id, nulls first, rows of equal id by a digest of their text; equal
    rows are one document and lose the same spans. Null texts are empty. ``least`` is at least twice
    the k-gram's length.
    """

    def __init__(self, documents: DataFrame, least: int = LEAST, kgram: int = KGRAM, bucket: int = BUCKET) -> None:
        self.documents, self.least, self.kgram, self.bucket = documents, least, kgram, bucket
        self.spark = documents.sparkSession
        text = F.coalesce("text", F.lit(""))
        docs = documents.select(F.coalesce("doc_id", F.lit(-(2**63))).alias("id"), F.xxhash64(text, F.lit(3)).alias("digest"), text.cast("binary").alias("bytes"))
        self.long = docs.filter(F.octet_length("bytes") >= least)
        self._run()

    def _scan(self, table: np.ndarray | None, what: str) -> DataFrame:
        """Stretches (those whose key passes the filter) or marks of all documents but later copies."""
        least, kgram = self.least, self.kgram
        shared = self.spark.sparkContext.broadcast(table) if table is not None else None
        schema = "mark long" if what == "marks" else _STRETCH_SCHEMA

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hasher = Hasher(least, kgram)
            for b in batches:
                ids, digests = b.column("id").to_numpy(), b.column("digest").to_numpy()
                for rows, offsets, pieces in chunked(range(len(ids)), (x.as_py() for x in b.column("bytes")), least):
                    s = hasher.stretches(pieces)
                    if what == "marks":
                        yield pa.RecordBatch.from_arrays([pa.array(s["marks"])], ["mark"])
                        continue
                    ok = np.flatnonzero(_passes(shared.value, s["key"]))
                    row = np.array(rows)[s["text"][ok]]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x) for x in (ids[row], digests[row], s["start"][ok] + np.array(offsets, np.int64)[s["text"][ok]], s["length"][ok].astype(np.int32), s["key"][ok], s["same"][ok], s["ties"][ok].astype(np.int32))],
                        ["id", "digest", "start", "length", "key", "same", "ties"],
                    )
            trim()

        return self.first.mapInArrow(run, schema)

    def _texts_of(self, wanted: DataFrame) -> DataFrame:
        """id, digest, start, length, key and the bytes of the wanted stretches: a scan by which only
        their own documents' places pass, then an exact join."""
        place = F.col("digest").bitwiseXOR(F.col("start") * F.lit(SPREAD))
        places = _filter_of(wanted.select(place.alias("p")), "p", FILTER_BITS)
        docs, keys = _filter_of(wanted, "digest", FILTER_BITS), _filter_of(wanted, "key", FILTER_BITS)
        shared = self.spark.sparkContext.broadcast((docs, keys, places))
        least, kgram = self.least, self.kgram

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hasher = Hasher(least, kgram)
            of_docs, of_keys, of_places = shared.value
            for b in batches:
                ids, digests = b.column("id").to_numpy(), b.column("digest").to_numpy()
                at = np.flatnonzero(_passes(of_docs, digests)).tolist()
                column = b.column("bytes")
                for rows, offsets, pieces in chunked(at, (column[i].as_py() for i in at), least):
                    s = hasher.stretches(pieces)
                    start = s["start"] + np.array(offsets, np.int64)[s["text"]]
                    places = digests[np.array(rows)[s["text"]]] ^ (start * SPREAD)
                    hit = np.flatnonzero(_passes(of_keys, s["key"]) & _passes(of_places, places))
                    row, start = np.array(rows)[s["text"][hit]], start[hit]
                    cut = [pieces[t][a : a + n] for t, a, n in zip(s["text"][hit].tolist(), s["start"][hit].tolist(), s["length"][hit].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(digests[row]), pa.array(start), pa.array(cut, pa.binary())], ["id", "digest", "start", "bytes"])

        found = self.first.mapInArrow(run, "id long, digest long, start long, bytes binary")
        return found.join(wanted, ["id", "digest", "start"])

    def _run(self) -> None:
        heads = self.long.select("id", "digest", F.sha2("bytes", 256).alias("sha"))
        first = heads.groupBy("sha").agg(F.min(F.struct("id", "digest")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("sha", "first")
        later = heads.join(first, "sha").filter((F.col("id") != F.col("first.id"))).select("id", "digest").distinct()
        #: id, digest of documents that are whole copies of an earlier one.
        self.copies = materialize(later, "suffix-copies")
        n = self.copies.count()
        self.first = self.long.join(F.broadcast(self.copies) if n <= BROADCAST_ROWS else self.copies, ["id", "digest"], "left_anti") if n else self.long
        # equal rows are one document: two would be each other's repeat and lose the first occurrence too
        equal = materialize(heads.groupBy("id", "digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("id", "digest"), "suffix-equal")
        n = equal.count()
        single = None
        if n:
            few = F.broadcast(equal) if n <= BROADCAST_ROWS else equal
            single = materialize(self.first.join(few, ["id", "digest"], "left_semi").dropDuplicates(["id", "digest"]), "suffix-single")
            self.first = self.first.join(few, ["id", "digest"], "left_anti").unionByName(single)
        marks = self._scan(None, "marks").groupBy("mark").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("mark")
        table = _filter_of(marks, "mark", FILTER_BITS)
        free_shuffles(self.spark)
        rows = materialize(self._scan(table, "stretches"), "suffix-stretches")
        place = F.struct("id", "digest", "start")
        kinds = materialize(rows.groupBy("key", "same", "length").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"), F.max("ties").alias("ties")), "suffix-kinds")
        # later ones among equal stretches go as a whole
        again = kinds.filter("n > 1").select("key", "same", "length", "first")
        whole = rows.join(again, ["key", "same", "length"]).filter(place != F.col("first")).select("id", "digest", "start", (F.col("start") + F.col("length")).alias("end"))
        wanted = materialize(self._shared(kinds).select("first.id", "first.digest", "first.start", "length", "key"), "suffix-wanted")
        texts = materialize(self._texts_of(wanted).select("key", "id", "digest", "start", "bytes"), "suffix-texts")
        parts = [materialize(whole, "suffix-whole")]
        done = [parts[0]]
        discard(rows, kinds, wanted, equal, *([single] if single is not None else []))
        # large buckets are cut again by longer k-grams until they fit
        for kgram in self.finer:
            sizes = materialize(texts.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > self.bucket).select("key"), "suffix-large")
            done += [sizes, texts]
            n = sizes.count()
            if not n:
                break
            large = F.broadcast(sizes) if n <= BROADCAST_ROWS else sizes
            parts.append(self._by_suffix_array(texts.join(large, "key", "left_anti")))
            again, texts = self._recut(texts.join(large, "key", "left_semi"), kgram)
            parts.append(again)
            done.append(again)
        else:
            done.append(texts)
        parts.append(self._by_suffix_array(texts))
        spans = parts[0]
        for p in parts[1:]:
            spans = spans.unionByName(p)
        by_doc = spans.groupBy("id", "digest").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
        #: id, digest, spans: merged (start, end) byte spans of documents that lose some but are no whole copies.
        self.spans = materialize(self._merged(by_doc), "suffix-spans")
        discard(*done)

    @property
    def finer(self) -> list[int]:
        """Lengths of the k-grams by which buckets of over ``bucket`` stretches are cut, one after the
        other. The last is a byte less than a window, with a window a stretch: no more than 512
        different windows share it, so the loop ends there."""
        least, k = self.least, self.kgram
        return [k + (least - k) * 7 // 10, k + (least - k) * 9 // 10, least - 1]

    @staticmethod
    def _shared(kinds: DataFrame) -> DataFrame:
        """The kinds that another kind may share a window with, or that may repeat one within."""
        buckets = kinds.groupBy("key").agg(F.count(F.lit(1)).alias("_kinds"), F.max("ties").alias("_most")).filter("_kinds > 1 or _most > 1").select("key")
        return kinds.join(buckets, "key")

    def _recut(self, texts: DataFrame, kgram: int) -> tuple[DataFrame, DataFrame]:
        """Stretches cut again by a longer k-gram: the spans of later ones among equal pieces, and the
        pieces (key, id, digest, start, bytes) that may still share a window with another. Equal
        windows have equal smallest k-grams, so they meet again; keys that stand once go first."""
        least, longest = self.least, 1 if kgram == self.least - 1 else STRETCH

        def cut(table: np.ndarray | None):
            shared = self.spark.sparkContext.broadcast(table) if table is not None else None

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                hasher = Hasher(least, kgram, longest)
                for b in batches:
                    column = b.column("bytes")
                    ids, digests, begins = (b.column(c).to_numpy() for c in ("id", "digest", "start"))
                    for rows, _, pieces in chunked(range(b.num_rows), (x.as_py() for x in column), least):
                        s = hasher.stretches(pieces)
                        if shared is None:
                            yield pa.RecordBatch.from_arrays([pa.array(s["key"]), pa.array(s["ties"].astype(np.int32))], ["key", "ties"])
                            continue
                        ok = np.flatnonzero(_passes(shared.value, s["key"]))
                        row = np.array(rows)[s["text"][ok]]
                        bytes_ = [pieces[t][a : a + n] for t, a, n in zip(s["text"][ok].tolist(), s["start"][ok].tolist(), s["length"][ok].tolist(), strict=True)]
                        yield pa.RecordBatch.from_arrays(
                            [*(pa.array(x) for x in (ids[row], digests[row], begins[row] + s["start"][ok], s["key"][ok], s["same"][ok], s["ties"][ok].astype(np.int32))), pa.array(bytes_, pa.binary())],
                            ["id", "digest", "start", "key", "same", "ties", "bytes"],
                        )

            return run

        keys = texts.mapInArrow(cut(None), "key long, ties int").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("ties").alias("ties")).filter("n > 1 or ties > 1")
        rows = texts.mapInArrow(cut(_filter_of(keys, "key", FILTER_BITS)), "id long, digest long, start long, key long, same long, ties int, bytes binary")
        rows = materialize(rows, "suffix-pieces")
        place = F.struct("id", "digest", "start")
        kinds = rows.groupBy("key", "same", F.length("bytes").alias("length")).agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"), F.max("ties").alias("ties"), F.first("bytes").alias("bytes"))
        kinds = materialize(kinds, "suffix-kinds")
        again = kinds.filter("n > 1").select("key", "same", "length", "first")
        spans = rows.withColumn("length", F.length("bytes")).join(again, ["key", "same", "length"]).filter(place != F.col("first")).select("id", "digest", "start", (F.col("start") + F.col("length")).alias("end"))
        spans = materialize(spans, "suffix-whole")
        out = materialize(self._shared(kinds).select("key", "first.id", "first.digest", "first.start", "bytes"), "suffix-texts")
        discard(rows, kinds)
        return spans, out

    def _by_suffix_array(self, texts: DataFrame) -> DataFrame:
        least = self.least

        def solved(group: list[dict]) -> list[tuple[int, int, int, int]]:
            group.sort(key=lambda r: (r["id"], r["digest"], r["start"]))
            spans = repeated_spans([(r["id"], r["digest"], r["start"]) for r in group], [r["bytes"] for r in group], least)
            return [(r["id"], r["digest"], r["start"] + a, r["start"] + b) for r, s in zip(group, spans, strict=True) for a, b in s]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def out(rows: list) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], ["id", "digest", "start", "end"])

            held: list[dict] = []
            for b in batches:
                rows: list = []
                for r in b.to_pylist():
                    if held and held[0]["key"] != r["key"]:
                        rows += solved(held)
                        held = []
                    held.append(r)
                yield out(rows)
            if held:
                yield out(solved(held))
            trim()

        sorted_ = texts.select("key", "id", "digest", "start", "bytes").repartition("key").sortWithinPartitions("key")
        return sorted_.mapInArrow(run, "id long, digest long, start long, end long")

    @staticmethod
    def _merged(by_doc: DataFrame) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                b["spans"] = [[{"start": x, "end": y} for x, y in merged([(s["start"], s["end"]) for s in spans])] for spans in b["spans"]]
                yield b

        return by_doc.mapInPandas(run, by_doc.schema)

    def attached(self) -> DataFrame:
        """Every row of the input with ``_spans``, the byte spans to remove (null: none)."""
        size = F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint")
        whole = F.array(F.struct(F.lit(0).cast("bigint").alias("start"), size.alias("end")))
        found = self.spans.select("id", "digest", "spans").unionByName(self.copies.select("id", "digest", F.lit(None).cast("array<struct<start:bigint,end:bigint>>").alias("spans")))
        found = found.select(F.col("id").alias("_id"), F.col("digest").alias("_digest"), F.struct("spans").alias("_found"))
        n = self.spans.agg(F.sum(F.size("spans"))).first()[0] or 0
        few = n + self.copies.count() <= BROADCAST_ROWS
        key = (F.coalesce("doc_id", F.lit(-(2**63))) == F.col("_id")) & (F.xxhash64(F.coalesce("text", F.lit("")), F.lit(3)) == F.col("_digest"))
        joined = self.documents.join(F.broadcast(found) if few else found, key, "left")
        spans = F.when(F.col("_found").isNull(), F.lit(None)).otherwise(F.coalesce("_found.spans", whole))
        return joined.withColumn("_spans", spans).drop("_id", "_digest", "_found")


def removal_digest(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of the whole table. Null texts are empty and keep
    their row, a null id comes first, equal rows are one document and lose the same bytes, an empty table
    gives none; other columns are not read."""
    rows = SuffixDedup(documents.select("doc_id", "text")).attached().select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("bytes"), "_spans")
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, gone, count, sha = [], [], [], []
            for x, spans in zip(b.column("bytes"), b.column("_spans").to_pylist(), strict=True):
                data, digest, at = x.as_py(), hashlib.sha256(), 0
                for s in spans or ():
                    digest.update(data[at : s["start"]])
                    at = s["end"]
                digest.update(data[at:])
                size.append(len(data))
                gone.append(sum(s["end"] - s["start"] for s in spans or ()))
                count.append(len(spans or ()))
                sha.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(v, pa.int64()) for v in (size, gone, count)), pa.array(sha, pa.string())], names)

    kind = documents.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(documents: DataFrame, least: int = LEAST) -> DataFrame:
    """``documents`` with repeated strings cut out of the texts and n_chars, where there is such a
    column, counted anew. A code point goes only if all its bytes do; null texts stay null."""
    rows = SuffixDedup(documents, least).attached()
    columns = documents.columns

    def cut(text: str, spans: list[dict]) -> str:
        data, out, at = text.encode(), [], 0
        for s in spans:
            a, b = s["start"], s["end"]
            while a < len(data) and data[a] & 0xC0 == 0x80:
                a += 1
            while b < len(data) and b > a and data[b] & 0xC0 == 0x80:
                b -= 1
            if a < b:
                out.append(data[at:a])
                at = b
        return b"".join([*out, data[at:]]).decode()

    @F.pandas_udf("string")
    def shortened(text: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else cut(t, s) for t, s in zip(text, spans, strict=True)])

    rows = rows.withColumn("text", F.when(F.col("_spans").isNull(), F.col("text")).otherwise(shortened("text", F.coalesce("_spans", F.array().cast("array<struct<start:bigint,end:bigint>>")))))
    if "n_chars" in columns:
        rows = rows.withColumn("n_chars", F.when(F.col("_spans").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(documents.schema["n_chars"].dataType))
    return rows.select(*columns)
