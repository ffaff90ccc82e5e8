"""SentencePiece encoding and decoding over a relational lattice.

Each distinct word is taken once: its substrings up to the longest piece are exploded and joined to
the piece table, the matches are grouped by word as the edges of a lattice, and a fold over the edges
with ``aggregate`` gives the segmentation: Viterbi's best path for unigram models, rank-ordered merging for BPE models,
whose scores are ranks and not probabilities. Words then meet their documents block by block.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .common import discard, materialize, trim

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Words of more code points are folded by the same rules in Python, as a fold over an array costs its square.
LONG_WORD = 60
#: Text bytes of one block of documents.
BLOCK_BYTES = 16 << 20
#: Words that one task segments, on average.
WORDS_A_TASK = 50_000
UNIGRAM, BPE = 1, 2
#: The word of a model whose pieces reach across spaces.
ANY_TEXT = r"[\s\S]+"
#: Text bytes that a task takes at once to tell their words.
HELD_BYTES = 24 << 20
#: Pairs of a word and a block that a task gathers before it packs them by block.
HELD_PAIRS = 2_000_000


def _class(points: list[int]) -> str:
    """Sorted code points as the inside of a character class, the same in Java's and Python's patterns."""
    spans: list[list[int]] = []
    for c in points:
        if spans and spans[-1][1] == c - 1:
            spans[-1][1] = c
        else:
            spans.append([c, c])
    name = lambda c: "".join(f"\\{x}" if x.isascii() and not x.isalnum() and x.isprintable() else x for x in chr(c)) if chr(c).isprintable() else f"\\x{c:02x}"
    return "".join(name(a) if a == b else f"{name(a)}-{name(b)}" for a, b in spans)


@dataclass
class PieceModel:
    """The piece table: piece -> (id, score), ids of the 256 byte pieces (or None), the unknown id."""

    kind: int
    pieces: dict[str, tuple[int, float]]
    byte_ids: list[int] | None
    unk_id: int
    names: list[str]

    @classmethod
    def load(cls, path: str = MODEL_PATH) -> PieceModel:
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        n = proto.normalizer_spec
        if n.precompiled_charsmap or n.remove_extra_whitespaces or not n.add_dummy_prefix or not n.escape_whitespaces:
            raise ValueError("only models that leave the text as it is, but for a leading space, are handled")
        pieces, by_byte, unk = {}, {}, 0
        for i, p in enumerate(proto.pieces):
            if p.type in (1, 4):
                pieces[p.piece] = (i, p.score)
            elif p.type == 6:
                by_byte[int(p.piece[3:5], 16)] = i
            elif p.type == 2:
                unk = i
        return cls(proto.trainer_spec.model_type, pieces, [by_byte[b] for b in range(256)] if len(by_byte) == 256 else None, unk, [p.piece for p in proto.pieces])

    @cached_property
    def longest(self) -> int:
        return max(map(len, self.pieces))

    @cached_property
    def pattern(self) -> str:
        """Words: a run of spaces with a run of characters that pieces may join, or with one character
        that no piece joins to another. Characters are of one kind if a chain of pieces holds them side
        by side; no piece reaches across a cut between kinds, so words can be segmented one by one."""
        if any(SPACE in p.lstrip(SPACE) for p in self.pieces):
            return ANY_TEXT
        up: dict[str, str] = {}

        def root(c: str) -> str:
            while up.setdefault(c, c) != c:
                c = up[c]
            return c

        for p in self.pieces:
            body = p.lstrip(SPACE)
            for x, y in zip(body, body[1:], strict=False):
                up[root(x)] = root(y)
        kinds: dict[str, list[int]] = {}
        for c in list(up):
            kinds.setdefault(root(c), []).append(ord(c))
        runs = [f"{SPACE}*[{_class(sorted(k))}]+" for k in sorted(kinds.values(), key=lambda k: (-len(k), min(k)))]
        return "|".join([*runs, f"{SPACE}*[^{SPACE}]", f"{SPACE}+"])

    @cached_property
    def unk_score(self) -> float:
        return min((s for _, s in self.pieces.values()), default=0.0) - 10.0

    def single(self, char: str) -> list[int]:
        """Ids of a code point that no piece covers: its bytes, or the unknown id."""
        return [self.byte_ids[b] for b in char.encode()] if self.byte_ids else [self.unk_id]

    def encode_word(self, word: str) -> list[int]:
        """The fold's result for one word, by a heap (BPE) or a table (unigram): for long words, and
        to hold the folds against."""
        return self._merge(word) if self.kind == BPE else self._best_path(word)

    def _ids(self, parts: list[str]) -> list[int]:
        out: list[int] = []
        for p in parts:
            out += [self.pieces[p][0]] if p in self.pieces else self.single(p)
        return out

    def _merge(self, word: str) -> list[int]:
        n = len(word)
        size, before, after = [1] * n, list(range(-1, n - 1)), list(range(1, n + 1))
        heap: list[tuple[float, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i] if 0 <= i < n else n
            if 0 <= i and j < n and (hit := self.pieces.get(word[i : j + size[j]])):
                heapq.heappush(heap, (-hit[1], i, size[i], size[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if size[i] != a or j >= n or size[j] != b:
                continue
            size[i], size[j], after[i] = a + b, 0, after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(before[i])
            offer(i)
        return self._ids([word[i : i + s] for i, s in enumerate(size) if s])

    def _best_path(self, word: str) -> list[int]:
        n, best, come = len(word), [0.0], [0]
        for end in range(1, n + 1):
            top = (best[end - 1] + self.pieces.get(word[end - 1], (0, self.unk_score))[1], 1 - end)
            for start in range(max(0, end - self.longest), end - 1):
                if hit := self.pieces.get(word[start:end]):
                    top = max(top, (best[start] + hit[1], -start))
            best.append(top[0])
            come.append(-top[1])
        parts, at = [], n
        while at:
            parts.append(word[come[at] : at])
            at = come[at]
        return self._ids(parts[::-1])

    def decode(self, ids: list[int]) -> str:
        """The text of a sequence of ids; invalid bytes become U+FFFD, an unknown id " ⁇ "."""
        return Speller(self.names, self.byte_ids, self.unk_id).decode(ids)


class Speller:
    """Decodes ids: what each stands for, as bytes."""

    def __init__(self, names: list[str], byte_ids: list[int] | None, unk_id: int) -> None:
        self.raw = [n.replace(SPACE, " ").encode() for n in names]
        for byte, i in enumerate(byte_ids or ()):
            self.raw[i] = bytes([byte])
        self.raw[unk_id] = " ⁇ ".encode()

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text

    def texts(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        """The texts of the sequences ids[ends[i] : ends[i + 1]], as :meth:`decode` gives them."""
        at = ids.copy()
        at[ends[:-1][np.diff(ends) > 0]] += len(self.raw)
        lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), self.table.take(pa.array(at)))
        try:
            return pc.binary_join(lists, b"").cast(pa.string())
        except pa.ArrowInvalid:  # bytes that are no text
            return pa.array([self.decode(ids[a:b].tolist()) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.string())

    @cached_property
    def table(self) -> pa.Array:
        """What each id stands for, then the same for ids that begin a text."""
        return pa.array([*self.raw, *(x.removeprefix(b" ") for x in self.raw)], pa.binary())


def ranks(model: PieceModel) -> dict[float, int]:
    """Places of the scores, best first; equal scores share one."""
    return {x: i for i, x in enumerate(sorted({s for _, s in model.pieces.values()}, reverse=True))}


def table(spark: SparkSession, model: PieceModel) -> DataFrame:
    """piece, id, rank: one row a piece, as many as the vocabulary has."""
    place = ranks(model)
    return spark.createDataFrame(pa.table({"piece": pa.array(list(model.pieces)), "id": pa.array([i for i, _ in model.pieces.values()], pa.int64()), "rank": pa.array([place[s] for _, s in model.pieces.values()], pa.int64())}))


# An edge is one number: rank, start, end and id from its high bits to its low ones.
def _rank(e: Column) -> Column:
    return F.shiftright(e, 36)


def _start(e: Column) -> Column:
    return F.shiftright(e, 30).bitwiseAND(F.lit(63)).cast("int")


def _end(e: Column) -> Column:
    return F.shiftright(e, 24).bitwiseAND(F.lit(63)).cast("int")


def _id(e: Column) -> Column:
    return e.bitwiseAND(F.lit(0xFFFFFF)).cast("int")


def lattice(words: DataFrame, model: PieceModel, key: str = "key") -> DataFrame:
    """``words`` (key, word; at most LONG_WORD code points) to key, n (code points) and edges: the pieces
    of the table among the word's substrings, a number each. A word without pieces gives no row. The key
    stays the key throughout, so beyond the words' own partitioning nothing is shuffled."""
    n = F.length("word")
    starts = words.select(key, "word", n.alias("n"), F.explode(F.sequence(F.lit(0), n - 1)).alias("start"))
    rest = starts.select(key, "n", "start", F.substring(F.col("word"), F.col("start") + 1, F.lit(model.longest)).alias("rest"))
    cut = rest.select(key, "n", "start", "rest", F.explode(F.sequence(F.lit(1), F.length("rest"))).alias("size"))
    cut = cut.select(key, "n", "start", "size", F.substring(F.col("rest"), F.lit(1), F.col("size")).alias("piece"))
    hits = cut.join(F.broadcast(table(words.sparkSession, model)), "piece")  # the vocabulary's size is the model's
    long = lambda c, bits: F.call_function("shiftleft", F.col(c).cast("bigint"), F.lit(bits))
    edge = long("rank", 36) + long("start", 30) + F.call_function("shiftleft", (F.col("start") + F.col("size")).cast("bigint"), F.lit(24)) + F.col("id")
    return hits.select(key, "n", edge.alias("edge")).groupBy(key, "n").agg(F.collect_list("edge").alias("edges"))


def _let(value: Column, body) -> Column:
    """body(value), the value worked out once."""
    return F.get(F.transform(F.array(value), body), 0)


def _bit(i: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), i)


def fold_merges(edges: Column, n: Column) -> Column:
    """The state after BPE: each step joins the two neighbouring symbols whose union has the best score,
    the leftmost of equals, until no union is a piece.

    The state is one number, a bit for each place where a symbol starts or the word ends. A union
    fits if its two ends are such places and exactly one lies between."""

    def masks(e: Column) -> Column:
        return F.struct((_bit(_start(e)) + _bit(_end(e))).alias("ends"), (_bit(_end(e)) - _bit(_start(e) + 1)).alias("between"))

    # by rank, then by start
    ranked = F.transform(F.sort_array(F.filter(edges, lambda e: _end(e) - _start(e) > 1)), masks)

    def all_steps(longer: Column) -> Column:
        fits = lambda state: lambda e: (state.bitwiseAND(e["ends"]) == e["ends"]) & (F.bit_count(state.bitwiseAND(e["between"])) == 1)
        joined = lambda state: lambda e: F.when(e.isNull(), -state).otherwise(state.bitwiseAND(F.bitwise_not(e["between"])))
        # below zero: nothing more fits
        step = lambda state, _: F.when(state < 0, state).otherwise(_let(F.get(F.filter(longer, fits(state)), 0), joined(state)))
        return F.abs(F.aggregate(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), _bit(n + 1) - F.lit(1).cast("bigint"), step))

    return _let(ranked, all_steps)


def fold_best_path(edges: Column, n: Column, scores: list[float], unk_score: float) -> Column:
    """The state (see :func:`fold_merges`) of the best path: Viterbi as a fold over the positions, then a
    fold back over the places that the best scores came from; of equal paths the one whose last
    piece is longest. ``scores`` are those of the ranks."""
    of_rank = F.from_json(F.lit(json.dumps(scores)), "array<double>")

    def step(state: Column, end: Column) -> Column:
        here = F.filter(edges, lambda e: _end(e) == end)
        come = F.transform(here, lambda e: F.struct((F.get(state, _start(e))["score"] + F.get(of_rank, _rank(e).cast("int"))).alias("score"), (-_start(e)).alias("left")))
        known = F.exists(here, lambda e: _start(e) == end - 1)
        plain = F.struct((F.get(state, end - 1)["score"] + F.lit(unk_score)).alias("score"), (F.lit(1) - end).alias("left"))
        every = F.when(known, come).otherwise(F.concat(come, F.array(plain)))
        return F.concat(state, F.array(F.array_max(every)))

    first = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("left")))
    table_ = F.aggregate(F.sequence(F.lit(1), n), first, step)

    def walked(best: Column) -> Column:
        # the state, and the place that the walk has reached
        start = F.struct(_bit(n).alias("state"), n.alias("at"))

        def back(x: Column, _: Column) -> Column:
            left = -F.get(best, x["at"])["left"]
            return F.when(x["at"] == 0, x).otherwise(F.struct((x["state"] + _bit(left)).alias("state"), left.alias("at")))

        return F.aggregate(F.sequence(F.lit(1), n), start, back, lambda x: x["state"])

    return _let(table_, walked)


def segmented(words: DataFrame, model: PieceModel) -> DataFrame:
    """``words`` plus ids (array of int): every word by the lattice, those of over LONG_WORD code points,
    whose fold would cost the square of their length, by the same rules in Python (:meth:`encode_word`;
    tests hold both against each other). One row a word is expected.

    Words are numbered and dealt to tasks of at most WORDS_A_TASK by their numbers, so that the edges of
    a task's words fit in memory whatever the size of the lexicon."""
    others = [c for c in words.columns if c != "word"]
    numbered = materialize(words.withColumn("key", F.monotonically_increasing_id()), "pieces-words")
    parts = max(1, -(-numbered.count() // WORDS_A_TASK))
    short = numbered.filter(F.length("word") <= LONG_WORD).repartition(parts, "key")
    n = F.col("n")
    state = fold_merges(F.col("edges"), n) if model.kind == BPE else fold_best_path(F.col("edges"), n, list(ranks(model)), model.unk_score)
    folded = lattice(short.select("key", "word"), model).withColumn("state", state)
    ends = lambda e: _bit(_start(e)) + _bit(_end(e))
    within = lambda e: F.col("state").bitwiseAND(_bit(_end(e)) - _bit(_start(e) + 1)) == 0
    taken = F.filter("edges", lambda e: (F.col("state").bitwiseAND(ends(e)) == ends(e)) & within(e))
    # by start: one number each of start and id
    folded = folded.select("key", "state", F.sort_array(F.transform(taken, lambda e: F.call_function("shiftleft", _start(e).cast("bigint"), F.lit(24)) + _id(e))).alias("taken"))
    size = F.length("word")
    joined = short.join(folded, "key", "left").withColumns({"state": F.coalesce("state", _bit(size + 1) - F.lit(1).cast("bigint")), "taken": F.coalesce("taken", F.array().cast("array<bigint>"))})
    every = F.transform("taken", lambda t: t.bitwiseAND(F.lit(0xFFFFFF)).cast("int"))
    bytes_of = lambda c: F.transform(F.sequence(F.lit(1), F.octet_length(c)), lambda i: F.conv(F.hex(F.substring(c.cast("binary"), i, F.lit(1))), 16, 10).cast("int"))

    def mixed(start: Column) -> Column:
        """The piece taken at a place, or what stands for a code point that no piece covers."""
        hit = F.get(F.filter("taken", lambda t: F.shiftright(t, 24).cast("int") == start), 0)
        if model.byte_ids:
            other = F.transform(bytes_of(F.substring(F.col("word"), start + 1, F.lit(1))), lambda b: F.get(F.array(*map(F.lit, model.byte_ids)), b))
        else:
            other = F.array(F.lit(model.unk_id))
        return F.when(hit.isNotNull(), F.array(hit.bitwiseAND(F.lit(0xFFFFFF)).cast("int"))).otherwise(other)

    places = F.filter(F.sequence(F.lit(0), size - 1), lambda i: F.col("state").bitwiseAND(_bit(i)) != 0)
    ids = F.when(F.size("taken") == F.bit_count("state") - 1, every).otherwise(F.flatten(F.transform(places, mixed)))
    done = joined.select("word", ids.alias("ids"), *others)

    schema = numbered.drop("key", "word").schema
    schema = StructType([StructField("word", StringType()), StructField("ids", ArrayType(IntegerType())), *schema.fields])

    def folded_long(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = pa.array([model.encode_word(w.as_py()) for w in b.column("word")], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column("word"), ids, *(b.column(c) for c in others)], schema.names)

    out = done.unionByName(numbered.filter(F.length("word") > LONG_WORD).select("word", *others).mapInArrow(folded_long, schema))
    out._table_path = numbered._table_path
    return out


_TOKENS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


def coded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Texts cut before every run of spaces, which no word of :attr:`PieceModel.pattern` reaches across:
    the order in which rows are told, the tokens of each, their numbers row by row, and what the numbers
    stand for, spaces written as the model does and one put before each text.

    Texts whose spaces stand one by one between other characters are split by Arrow; the others, told
    last, by a pattern. An empty text has no token."""
    odd = pc.or_(pc.or_(pc.match_substring(texts, "  "), pc.match_substring(texts, SPACE)), pc.or_(pc.starts_with(texts, " "), pc.equal(texts, "")))
    first, last = (np.flatnonzero(x.to_numpy(zero_copy_only=False)) for x in (pc.invert(odd), odd))
    lists = pc.split_pattern(texts.take(pa.array(first)), " ")
    told = lists.flatten().dictionary_encode()
    names = pc.binary_join_element_wise(SPACE, told.dictionary, "")
    number: dict[str, int] = {}
    more, sizes = [], []
    for i in last.tolist():
        t = texts[i].as_py()
        found = _TOKENS.findall(SPACE + t.replace(" ", SPACE)) if t else []
        more += [number.setdefault(x, len(names) + len(number)) for x in found]
        sizes.append(len(found))
    counts = np.concatenate([pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64), np.array(sizes, np.int64)])
    codes = np.concatenate([told.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.array(more, np.int64)])
    return np.concatenate([first, last]), counts, codes, pa.concat_arrays([names, pa.array(list(number), pa.string())])


def _whole(column: pa.ChunkedArray) -> pa.Array:
    """A column as one array."""
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def _gathered(flat: np.ndarray, ends: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The stretches flat[ends[i] : ends[i + 1]] for each i of ``at``, one after the other."""
    size = ends[at + 1] - ends[at]
    total = np.cumsum(size)
    return flat[np.arange(total[-1] if len(total) else 0) + np.repeat(ends[at] - total + size, size)]


def _distinct(x: np.ndarray) -> np.ndarray:
    """The numbers of ``x``, each once, in order; ``x`` is sorted in place."""
    x.sort()
    return x[np.diff(x, prepend=-1) != 0]


def _words_in(tokens: pa.Array, pattern: str) -> tuple[pa.Array, np.ndarray]:
    """The words of all ``tokens``, one token after the other, and how many each has. Every token begins with
    a space and holds none behind another character, so words are found in all of them at once."""
    find = re.compile(pattern).findall
    blank = pc.match_substring_regex(tokens, f"^{SPACE}+$").to_numpy(zero_copy_only=False) if len(tokens) else np.zeros(0, bool)
    if pattern == ANY_TEXT or blank.any():
        lists = [find(x) for x in tokens.to_pylist()]
        return pa.array([w for x in lists for w in x], pa.string()), np.array([len(x) for x in lists], np.int64)
    words = pa.array(find("".join(tokens.to_numpy(zero_copy_only=False))), pa.string())
    return words, np.diff(np.append(np.flatnonzero(pc.starts_with(words, SPACE).to_numpy(zero_copy_only=False)), len(words))).astype(np.int64)


def words_of_blocks(docs: DataFrame, model: PieceModel) -> DataFrame:
    """``docs`` (block, text) to word and masks, an array of (group, mask): bit b of a group's mask says
    that block 64 * group + b holds the word. Each task tells a word once for what it has at hand."""
    pattern = model.pattern

    def told(blocks: np.ndarray, texts: pa.Array) -> pa.RecordBatch:
        order, counts, codes, names = coded(texts)
        width = int(blocks.max()) + 1
        # each token and block once
        tokens, held = np.divmod(_distinct(codes * width + np.repeat(blocks[order].astype(np.int64), counts)), width)
        del codes
        found, sizes = _words_in(names, pattern)
        found, ends = found.dictionary_encode(), np.concatenate([[0], np.cumsum(sizes)])
        words = _gathered(found.indices.to_numpy().astype(np.int64), ends, tokens)
        # each word and block once, then a mask for each word and group
        words, held = np.divmod(_distinct(words * width + np.repeat(held, sizes[tokens])), width)
        groups = width // 64 + 1
        key = words * groups + held // 64
        first = np.flatnonzero(np.diff(key, prepend=-1))
        masks = np.bitwise_or.reduceat(np.left_shift(np.uint64(1), (held % 64).astype(np.uint64)), first) if len(first) else np.zeros(0, np.uint64)
        word, group = np.divmod(key[first], groups)
        return pa.RecordBatch.from_arrays([found.dictionary.take(pa.array(word)), pa.array(group.astype(np.int32)), pa.array(masks.view(np.int64))], ["word", "group", "mask"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            upto = np.cumsum(pc.binary_length(b.column("text")).to_numpy(), dtype=np.int64) // HELD_BYTES
            for part in np.split(np.arange(b.num_rows), np.flatnonzero(np.diff(upto)) + 1):
                if len(part):
                    rows = b.slice(part[0], len(part))
                    yield told(rows.column("block").to_numpy(), rows.column("text"))
        trim()

    found = docs.select("block", "text").filter("text <> ''").mapInArrow(run, "word string, group int, mask long")
    masks = found.groupBy("word", "group").agg(F.bit_or("mask").alias("mask"))
    return masks.groupBy("word").agg(F.collect_list(F.struct("group", "mask")).alias("masks"))


def words_to_blocks(lexicon: DataFrame, vocabulary: int) -> DataFrame:
    """``lexicon`` (word, ids, masks of :func:`words_of_blocks`) to block and frame: the words of a block
    among those at hand with their ids, as one compressed string of bytes, so that what is dealt to
    the blocks is a few rows each and not one a word."""
    kind = "<u2" if vocabulary <= 1 << 16 else "<u4"

    def frames(held: list[pa.RecordBatch], pairs: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        words, ids = (pa.concat_arrays([b.column(c) for b in held]) for c in ("word", "ids"))
        before = np.cumsum([0, *(b.num_rows for b in held)])
        block = np.concatenate([x for x, _ in pairs])
        row = np.concatenate([y + n for (_, y), n in zip(pairs, before, strict=False)])
        order = np.argsort(block, kind="stable")
        parts = np.split(order, np.flatnonzero(np.diff(block[order])) + 1)
        return pa.RecordBatch.from_arrays([pa.array([block[p[0]] for p in parts], pa.int32()), pa.array([pack(words.take(r), ids.take(r), kind) for r in (pa.array(row[p]) for p in parts)], pa.binary())], ["block", "frame"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, pairs, count = [], [], 0
        for b in (whole.slice(i, 5_000) for whole in batches for i in range(0, whole.num_rows, 5_000)):
            masks = b.column("masks")
            row = np.repeat(np.arange(b.num_rows), pc.list_value_length(masks).to_numpy())
            flat = masks.flatten()
            at, bit = np.nonzero(np.unpackbits(flat.field("mask").to_numpy().astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            held.append(b)
            pairs.append((flat.field("group").to_numpy()[at] * 64 + bit, row[at]))
            count += len(at)
            if count >= HELD_PAIRS:
                yield frames(held, pairs)
                held, pairs, count = [], [], 0
        if count:
            yield frames(held, pairs)
        del held, pairs
        trim()

    return lexicon.select("word", "ids", "masks").mapInArrow(run, "block int, frame binary")


def pack(words: pa.StringArray, ids: pa.ListArray, kind: str) -> bytes:
    """Words and their ids as bytes: how long each is, how many ids it has, the ids, the words."""
    sizes = np.concatenate([[len(words)], pc.binary_length(words).to_numpy(), pc.list_value_length(ids).to_numpy()]).astype("<u4")
    raw = sizes.tobytes() + ids.flatten().to_numpy().astype(kind).tobytes() + b"".join(words.cast(pa.binary()).to_numpy(zero_copy_only=False))
    return np.array([len(raw), np.dtype(kind).itemsize], "<i8").tobytes() + pa.Codec("zstd", compression_level=3).compress(raw, asbytes=True)


def unpack(frames: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The words of all frames, their ids one after the other, and where each word's begin and end."""
    lengths, counts, ids, texts = [np.zeros(0, "<u4")], [np.zeros(0, "<u4")], [np.zeros(0, np.int32)], []
    for f in frames:
        size, width = np.frombuffer(f, "<i8", 2).tolist()
        raw = pa.Codec("zstd").decompress(memoryview(f)[16:], decompressed_size=size, asbytes=True)
        n = int(np.frombuffer(raw, "<u4", 1)[0])
        lengths.append(np.frombuffer(raw, "<u4", n, 4))
        counts.append(np.frombuffer(raw, "<u4", n, 4 + 4 * n))
        ids.append(np.frombuffer(raw, f"<u{width}", int(counts[-1].sum()), 4 + 8 * n).astype(np.int32))
        texts.append(memoryview(raw)[4 + 8 * n + width * len(ids[-1]) :])
    ends = np.concatenate([[0], np.cumsum(np.concatenate(lengths), dtype=np.int64)])
    words = pa.StringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(b"".join(texts)))
    return words, np.concatenate(ids), np.concatenate([[0], np.cumsum(np.concatenate(counts), dtype=np.int64)])


def encode_documents(documents: DataFrame, model: PieceModel, block_bytes: int = BLOCK_BYTES, decoded: bool = False) -> DataFrame:
    """doc_id, ids for every row: the ids that the model's own encoder gives for the whole text; with
    ``decoded`` also text, what decoding those ids gives.

    Documents are dealt to blocks by a hash of their id; each distinct word remembers its blocks as a
    bit mask, is segmented once, and goes back to those blocks, where the documents are put together.
    A word that a third of all documents hold costs a row a block. Texts travel compressed. Null and
    empty texts give no ids; rows of equal id stay rows.
    """
    spark = documents.sparkSession
    docs = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    docs = docs.withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(blocks)).cast("int"))
    words = segmented(words_of_blocks(docs, model), model)
    # the edges of a task's words are gathered in memory, which WORDS_A_TASK bounds, and not by sorting
    name = "spark.sql.objectHashAggregate.sortBased.fallbackThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, str(4 * WORDS_A_TASK))
    try:
        lexicon = materialize(words, "pieces-lexicon")
    finally:
        spark.conf.set(name, before)
    discard(words)
    spread = words_to_blocks(lexicon, len(model.names))
    kind = documents.schema["doc_id"].dataType
    pattern, speller = model.pattern, Speller(model.names, model.byte_ids, model.unk_id)
    result = pa.schema([("doc_id", to_arrow_type(kind)), ("ids", pa.list_(pa.int32()))] + [("text", pa.string())] * decoded)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))
        for b in batches:
            block = b.column("block").to_numpy()
            order = np.argsort(block, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(block[order])) + 1):
                if len(part):
                    sink = pa.BufferOutputStream()
                    rows = b.select(["doc_id", "text"]).take(pa.array(part))
                    with pa.ipc.new_stream(sink, rows.schema, options=options) as w:
                        w.write_batch(rows)
                    yield pa.RecordBatch.from_arrays([pa.array([block[part[0]]], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "frame"])

    def assembled(left: pa.Table, right: pa.Table) -> pa.Table:
        frames = [pa.ipc.open_stream(x.as_py()).read_all() for x in left.column("frame")]
        if not frames:
            return result.empty_table()
        rows = pa.concat_tables(frames).combine_chunks()
        del frames
        order, counts, codes, names = coded(_whole(rows.column("text")))
        doc_ids = _whole(rows.column("doc_id")).take(pa.array(order))
        del rows
        lexicon, flat, ends = unpack(right.column("frame").to_pylist())
        # a token's words, then a token's ids: most tokens are one word
        at = pc.index_in(names, value_set=lexicon)
        sizes, whole = np.ones(len(names), np.int64), at.is_valid().to_numpy(zero_copy_only=False)
        found, sizes[~whole] = _words_in(names.filter(at.is_null()), pattern)
        words = np.zeros(sizes.sum(), np.int64)
        mine = np.repeat(whole, sizes)
        words[mine] = at.drop_null().to_numpy()
        words[~mine] = pc.index_in(found, value_set=lexicon).to_numpy()
        del lexicon, names, found, at, mine
        by_token = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        flat, token_ends = _gathered(flat, ends, words), np.concatenate([[0], np.cumsum(ends[words + 1] - ends[words])])[by_token]
        upto = np.concatenate([[0], np.cumsum(counts)])
        out, lengths, texts = [], [], []
        for first in range(0, len(counts), 64):
            ids = _gathered(flat, token_ends, codes[upto[first] : upto[min(first + 64, len(counts))]]).astype(np.int32)
            of_token = np.concatenate([[0], np.cumsum(token_ends[codes[upto[first] : upto[min(first + 64, len(counts))]] + 1] - token_ends[codes[upto[first] : upto[min(first + 64, len(counts))]]])])
            cut = of_token[upto[first : first + 65] - upto[first]]
            out.append(ids)
            lengths.append(np.diff(cut))
            if decoded:
                texts.append(speller.texts(ids, cut))
        offsets = pa.array(np.concatenate([[0], np.cumsum(np.concatenate(lengths))]).astype(np.int32) if lengths else np.zeros(1, np.int32))
        columns = [doc_ids, pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(out) if out else np.zeros(0, np.int32), pa.int32()))]
        done = pa.table(columns + [pa.chunked_array(texts, pa.string())] * decoded, names=result.names)
        del out, texts, words, codes, flat
        trim()
        return done

    frames = docs.select("block", "doc_id", "text").mapInArrow(packed, "block int, frame binary")
    return frames.groupBy("block").cogroup(spread.groupBy("block")).applyInArrow(assembled, f"doc_id {kind.simpleString()}, ids array<int>" + ", text string" * decoded)


def decode_documents(encoded: DataFrame, model: PieceModel) -> DataFrame:
    """Every column of ``encoded`` but ids, n_pieces and the decoded text; null ids decode as empty."""
    keep = [c for c in encoded.columns if c not in ("ids", "text", "n_pieces")]
    schema = StructType(list(encoded.select(*keep).schema.fields)).add("ids", encoded.schema["ids"].dataType).add("n_pieces", "long").add("text", "string")
    shared = encoded.sparkSession.sparkContext.broadcast((model.names, model.byte_ids, model.unk_id))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        speller = Speller(*shared.value)
        for b in (whole.slice(i, 256) for whole in batches for i in range(0, whole.num_rows, 256)):
            texts, counts = [], []
            for x in b.column("ids"):
                ids = x.values.to_numpy().tolist() if x.is_valid else ()
                counts.append(len(ids))
                texts.append(speller.decode(ids))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), b.column("ids"), pa.array(counts, pa.int64()), pa.array(texts, pa.string())], [*keep, "ids", "n_pieces", "text"])

    return encoded.select(*keep, "ids").mapInArrow(run, schema)


def round_trip(documents: DataFrame, path: str = MODEL_PATH) -> DataFrame:
    """doc_id, n_pieces, ids_sha256 (of the ids joined by blanks), n_chars and text_sha256 of the
    text that decoding the ids gives. Null and empty texts have no ids and decode as empty; repeated rows
    each give a row, a null id is kept, an empty table gives none, other columns are not read."""
    decoded = encode_documents(documents.select("doc_id", "text"), PieceModel.load(path), decoded=True)
    return decoded.select("doc_id", F.size("ids").cast("bigint").alias("n_pieces"), F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"), F.length("text").cast("bigint").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))
