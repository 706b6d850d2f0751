"""Language-model scoring by cross-entropy difference.

Two bigram models, of a target set and of the whole corpus, share one
vocabulary, one order and one smoothing, and the corpus's counts are scaled to
the target's size, so that their losses can be compared token by token. A
document's score is the mean loss under the background model less the mean loss
under the target model: the higher, the more it is like the target. The
background holds the target and each scored document of the corpus as well.

The vocabulary is open: every word counts as itself, by a hash. Counts live in a
table that is dealt out by word, so both models grow with the corpus and no
process holds more than a part. Texts stay where they are: blocks of documents
send each part the bigrams that end in its words, as sorted arrays, and get sums
back. A word's part knows all that its tokens need, since

    -log p(w | a) = -log(c(a, w) + S p(w)) + log(c(a) + S)

splits into one term for the bigram, held where w is, and one for a's turn as a
context, held where a is.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held_out, kept, materialize, release, ship, slices

#: Words that count as themselves (None: all; else the corpus's commonest so many), and classes of the other words by their ends.
VOCABULARY: int | None = None
CLASSES = 256
#: Pseudo-counts of the lower order at each order.
SMOOTHING = 16.0
#: Words counted before a task's counts leave it.
FLUSH = 100_000
#: Characters of text for each part of the table, blocks that meet in one task at most, and bigrams of a part that do.
PART_CHARS, FAN_IN, PART_TOKENS = 16_000_000, 512, 2_000_000
#: Target ids that are broadcast at most (8 bytes each); beyond, texts and ids meet in a merge.
BROADCAST_IDS = 1_000_000
#: What stands for a text's start and end among the contexts of a word.
START, END = 0, 0xFFFFFFFF

WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


class Keys:
    """64-bit keys of words: a hash, or with a vocabulary its numbers from 1 on and then those of the classes."""

    def __init__(self, vocabulary: Sequence[str] | None = None):
        self.known = None if vocabulary is None else {w: i for i, w in enumerate(vocabulary, 1)}

    def __call__(self, words: Iterable[str]) -> np.ndarray:
        if self.known is None:
            return np.fromiter((xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64)
        other = len(self.known) + 1
        return np.fromiter((self.known.get(w) or other + zlib.crc32(w[-3:].encode("utf-8", "surrogatepass")) % CLASSES for w in words), np.uint64)

    def contexts(self, keys: np.ndarray) -> np.ndarray:
        """32 bits by which the contexts of one word are told apart."""
        low = keys if self.known is not None else keys >> np.uint64(32)
        return np.clip(low, 1, END - 1).astype(np.uint32)


@dataclass
class Block:
    """The bigrams of some documents, by part, word and context.

    words, and how many bigrams end in each; each bigram's context, and how many
    documents have it; those documents' places in the block, and how often each has it.
    """

    words: np.ndarray
    per_word: np.ndarray
    context: np.ndarray
    per_bigram: np.ndarray
    doc: np.ndarray
    times: np.ndarray


def _cuts(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values start."""
    return np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if len(x) else np.zeros(0, np.int64)


def _lengths(starts: np.ndarray, total: int) -> np.ndarray:
    return np.diff(np.append(starts, total))


def blocks(texts: Sequence[str | None], keys: Keys, parts: int) -> tuple[np.ndarray, dict[int, Block]]:
    """(tokens of each text, block of each part) of some texts; a text's end is a bigram of its last word."""
    number: dict[str, int] = defaultdict(count().__next__)
    look = number.__getitem__
    rows, sizes = [], np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        found = words_of(t)
        sizes[i] = len(found)
        rows.append(np.fromiter(map(look, found), np.int64, len(found)))
    if not number:
        return sizes, {}
    keyed = keys(number)
    # Words of one key (classes) are one word; ranks go by part and key.
    distinct, same = np.unique(keyed, return_inverse=True)
    part = (distinct % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    distinct, part = distinct[order], part[order]
    tokens = rank[same[np.concatenate(rows)]]
    doc = np.repeat(np.arange(len(texts)), sizes)
    n = len(distinct)
    ends = np.cumsum(sizes)[sizes > 0] - 1
    before = np.concatenate(([n], tokens[:-1]))
    before[np.concatenate(([0], ends[:-1] + 1))] = n
    # One number for word, context (n: start, n + 1: end) and document sorts them all.
    wide, many = n + 2, max(1, len(texts))
    code = np.concatenate(((tokens * wide + before) * many + doc, (tokens[ends] * wide + n + 1) * many + doc[ends]))
    code.sort()
    at = _cuts(code)
    times, code = _lengths(at, len(code)), code[at]
    bigram, place = code // many, code % many
    at = _cuts(bigram)
    per_bigram, bigram = _lengths(at, len(bigram)), bigram[at]
    context = np.concatenate((keys.contexts(distinct), np.array([START, END], np.uint32)))[bigram % wide]
    word = bigram // wide
    first = _cuts(word)
    per_word, word = _lengths(first, len(word)), word[first]
    entries = np.concatenate(([0], np.cumsum(per_bigram)))
    bigrams = np.concatenate(([0], np.cumsum(per_word)))
    out = {}
    starts = _cuts(part[word])
    for a, b in zip(starts, np.append(starts[1:], len(word))):
        c, d = bigrams[a], bigrams[b]
        out[int(part[word[a]])] = Block(distinct[word[a:b]], per_word[a:b], context[c:d], per_bigram[c:d], place[entries[c] : entries[d]], times[entries[c] : entries[d]])
    return sizes, out


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers or floats as bytes, whole numbers in as few as hold them."""
    out = []
    for x in arrays:
        if x.dtype.kind in "iu":
            x = x.astype(np.min_scalar_type(int(x.max()) if len(x) else 0))
        out.append(np.array([ord(x.dtype.char), len(x)], np.int64).tobytes() + x.tobytes())
    return b"".join(out)


def unpack(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        kind, n = np.frombuffer(data, np.int64, 2, at)
        out.append(np.frombuffer(data, np.dtype(chr(kind)), n, at + 16))
        at += 16 + out[-1].nbytes
    return out


def _bigram_keys(words: np.ndarray, context: np.ndarray) -> np.ndarray:
    """One hash of a word's key and a context."""
    x = words ^ (context.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


@dataclass
class Counts:
    """Counts of a part: its words in order, how many contexts each has, those in order, and their counts in the background and the target."""

    words: np.ndarray
    per_word: np.ndarray
    context: np.ndarray
    counts: np.ndarray

    def pack(self) -> bytes:
        return pack(self.words, self.per_word, self.context, *self.counts)

    @classmethod
    def unpack(cls, data: bytes) -> Counts:
        words, per_word, context, b, t = unpack(data)
        return cls(words.astype(np.uint64), per_word.astype(np.int64), context.astype(np.uint32), np.stack((b, t)).astype(np.uint64 if max(b.itemsize, t.itemsize) > 4 else np.uint32))

    @classmethod
    def merged(cls, parts: Sequence[Counts]) -> Counts:
        words = np.concatenate([np.zeros(0, np.uint64), *[np.repeat(p.words, p.per_word) for p in parts]])
        context = np.concatenate([np.zeros(0, np.uint32), *[p.context for p in parts]])
        order = np.lexsort((context, words))
        words, context = words[order], context[order]
        if not len(order):
            return cls(words, np.zeros(0, np.int64), context, np.zeros((2, 0), np.int64))
        at = np.flatnonzero(np.concatenate(([True], (words[1:] != words[:-1]) | (context[1:] != context[:-1]))))
        counts = np.add.reduceat(np.concatenate([p.counts for p in parts], axis=1)[:, order], at, axis=1, dtype=np.uint64)
        words, context = words[at], context[at]
        first = _cuts(words)
        return cls(words[first], _lengths(first, len(words)), context, counts)

    @classmethod
    def of(cls, block: Block, wanted: np.ndarray) -> Counts:
        """Counts of a block, its target documents being ``wanted``."""
        each = np.stack((block.times, block.times * wanted[block.doc]))
        return cls(block.words, block.per_word, block.context, np.add.reduceat(each, np.cumsum(block.per_bigram) - block.per_bigram, axis=1))

    def by_word(self) -> tuple[np.ndarray, np.ndarray]:
        """Counts of each word, and of its turns as a text's last one."""
        if not len(self.words):
            return np.zeros((2, 0), np.int64), np.zeros((2, 0), np.int64)
        first, ends = np.cumsum(self.per_word) - self.per_word, self.context == END
        return tuple(np.add.reduceat(np.where(own, self.counts, 0), first, axis=1, dtype=np.int64) for own in (~ends, ends))

    def index(self) -> tuple[tuple, tuple, tuple]:
        """Sorted keys with their counts: bigrams, words, words that end texts."""
        keys = _bigram_keys(np.repeat(self.words, self.per_word), self.context)
        order, by_word = np.argsort(keys), np.argsort(self.words)
        one, ends = self.by_word()
        return (keys[order], self.counts[:, order]), (self.words[by_word], one[:, by_word]), (self.words[by_word], ends[:, by_word])


def _found(table: np.ndarray, counts: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Counts of keys in a sorted table, 0 for those that it doesn't have."""
    if not len(table):
        return np.zeros((2, len(keys)), np.int64)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, counts[:, at], 0)


@dataclass
class Models:
    """The table of counts (part, counts) and what all parts share; background first, target second."""

    vocabulary: list[str] | None
    parts: int
    spread: list[int]
    counts: DataFrame
    size: int
    scale: np.ndarray
    totals: np.ndarray
    starts: np.ndarray

    def shared(self) -> tuple:
        return self.size, self.scale, self.totals * self.scale, self.starts * self.scale


def losses(block: Block, index: tuple[tuple, tuple, tuple], shared: tuple, smoothing: float = SMOOTHING) -> tuple[np.ndarray, np.ndarray]:
    """(documents, their losses under both models): what a part adds to the documents of a block."""
    size, scale, totals, _ = shared
    words = np.repeat(block.words, block.per_word)
    one, ending = (_found(*table, block.words) * scale[:, None] for table in index[1:])
    turn = np.repeat(np.log(one - ending + smoothing), block.per_word, axis=1)
    p1 = np.repeat((one + smoothing / size) / (totals[:, None] + smoothing), block.per_word, axis=1)
    pair = _found(*index[0], _bigram_keys(words, block.context)) * scale[:, None]
    value = np.where(block.context == END, -turn, turn - np.log(pair + smoothing * p1))
    each = np.repeat(value, block.per_bigram, axis=1) * block.times
    docs = np.unique(block.doc)
    return docs, np.stack([np.bincount(block.doc, x, block.doc.max() + 1)[docs] for x in each])


def count_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n) over all whole texts; each task adds up before the shuffle."""
    ship(docs.sparkSession)
    token = uuid.uuid4().hex

    def run(batches: Iterable[pa.RecordBatch]):
        seen: Counter = kept(token, Counter)
        seen.clear()

        def out():
            batch = pa.RecordBatch.from_arrays([pa.array(list(seen)), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])
            seen.clear()
            return batch

        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in slices(texts):
                for t in texts[a:b]:
                    seen.update(words_of(t))
                if len(seen) > FLUSH:
                    yield out()
        if seen:
            yield out()

    return docs.select(F.col(f"`{text_col}`")).mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


#: Sums of a part: its words, their tokens in the background and in the target, texts that they end.
SUMS = ("words", "b", "t", "start_b", "start_t")


def _merging(counted: DataFrame, blocks_total: int) -> DataFrame:
    """(part, salt, counts, SUMS) from (part, salt, counts): merged in rounds, so that no task takes more than FAN_IN tables of a part at once."""

    def merge(table: pa.Table) -> pa.Table:
        whole = Counts.merged([Counts.unpack(x.as_py()) for x in table["counts"]])
        sums = [len(whole.words), *[int(n) for which in whole.by_word() for n in which.sum(axis=1)]]
        out = [table["part"].slice(0, 1), table["salt"].slice(0, 1), pa.array([whole.pack()], pa.binary()), *[pa.array([n], pa.int64()) for n in sums]]
        del whole
        release()
        return pa.table(out, names=["part", "salt", "counts", *SUMS])

    n = max(1, blocks_total)
    while True:
        n = -(-n // FAN_IN)
        counted = counted.select("part", F.pmod("salt", F.lit(n)).alias("salt"), "counts").groupBy("part", "salt").applyInArrow(merge, "part int, salt bigint, counts binary, " + ", ".join(f"{c} bigint" for c in SUMS))
        if n == 1:
            return counted


def count_bigrams(docs: DataFrame, vocabulary: Sequence[str] | None, parts: int, chars: int, text_col: str = "text", flag_col: str = "is_target") -> DataFrame:
    """The written table (part, counts, words, b, t, start_b, start_t): counts over all whole texts and over the flagged ones."""
    ship(docs.sparkSession)
    shared, token = docs.sparkSession.sparkContext.broadcast(vocabulary), uuid.uuid4().hex

    def run(batches: Iterable[pa.RecordBatch]):
        from pyspark import TaskContext

        keys = kept(token, lambda: Keys(shared.value))
        # The same in every attempt of a task.
        salt = TaskContext.get().partitionId() << 20
        for batch in batches:
            texts, flags = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in slices(texts):
                wanted = np.array([bool(f) for f in flags[a:b]], np.int64)
                found = blocks(texts[a:b], keys, parts)[1]
                salt += 1
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([salt] * len(found), pa.int64()), pa.array([Counts.of(x, wanted).pack() for x in found.values()], pa.binary())], names=["part", "salt", "counts"])

    counted = docs.select(F.col(f"`{text_col}`"), F.col(f"`{flag_col}`")).mapInArrow(run, "part int, salt bigint, counts binary")
    return materialize(_merging(counted, -(-chars // (1 << 22))).drop("salt"), "counts")


def fit(docs: DataFrame, text_col: str = "text", flag_col: str = "is_target", vocabulary: int | None = None) -> Models:
    """Both models from all texts, the target's from those that ``flag_col`` marks.

    Every word counts as itself unless ``vocabulary`` names a number: then the
    corpus's commonest so many words do (ties by code point). The driver holds
    sums of parts only; NULL texts are empty, repeated rows count each, texts of
    any length count whole.
    """
    top = VOCABULARY if vocabulary is None else vocabulary
    names = None if top is None else [r[0] for r in count_words(docs, text_col).orderBy(F.desc("n"), "word").limit(top).collect()]
    chars = docs.agg(F.sum(F.length(F.col(f"`{text_col}`")))).first()[0] or 0
    parts = max(1, -(-chars // PART_CHARS))
    counts = count_bigrams(docs, names, parts, chars, text_col, flag_col)
    sums = counts.select("part", *SUMS).collect()
    words, b, t, start_b, start_t = (sum(r[k] for r in sums) for k in SUMS)
    size = 1 + (words if names is None else len(names) + CLASSES)
    spread = [1] * parts
    for r in sums:
        spread[r["part"]] = max(1, -(-r["b"] // PART_TOKENS))
    return Models(names, parts, spread, counts.select("part", "counts"), size, np.array([t / b if t else 1.0, 1.0]), np.array([b, t], float), np.array([start_b, start_t], float))


FIELDS = [T.StructField(n, t) for n, t in (("n_tokens", T.LongType()), ("target_loss", T.DoubleType()), ("background_loss", T.DoubleType()), ("lm_score", T.DoubleType()))]


def score(df: DataFrame, models: Models, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Append ``n_tokens``, mean losses under both models in nats, and their difference ``lm_score``.

    NULL texts and texts without words have 0 tokens, losses and score 0. Texts
    aren't shuffled: blocks of rows send their bigrams, the other columns and
    their sums meet again by block. Repeated rows each get their result; an
    empty table gives an empty one; input columns named like an output give way
    to it. A part that holds a hot word is several tasks, each with the counts.
    """
    ship(df.sparkSession)
    taken = {f.name.lower() for f in FIELDS}
    names = [c for c in (df.columns if keep is None else keep) if c.lower() not in taken]
    rows = df.select(F.col(f"`{text_col}`").alias("text"), F.struct(F.lit(0).alias("k"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)]).alias("row"))
    context = df.sparkSession.sparkContext
    shared, token, every = context.broadcast((models.vocabulary, models.parts, models.spread, models.shared())), uuid.uuid4().hex, ["part", "salt", "block", "sums", "place", "n", "row"]
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("salt", T.LongType()), T.StructField("block", T.LongType()), T.StructField("sums", T.BinaryType()), T.StructField("place", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("row", rows.schema["row"].dataType)])

    def send(batches: Iterable[pa.RecordBatch]):
        """One row for each part's bigrams in a block, and one, of part -1, for each document."""
        from pyspark import TaskContext

        vocabulary, parts, spread, _ = shared.value
        keys = kept(token, lambda: Keys(vocabulary))
        task, seq = TaskContext.get().partitionId(), 0
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in slices(texts):
                sizes, found = blocks(texts[a:b], keys, parts)
                seq += 1
                block = task << 32 | seq
                n, m = b - a, len(found)
                out = [
                    pa.array([-1] * n + list(found), pa.int32()),
                    # Documents go block by block, a part's blocks to its tasks in turn.
                    pa.array([block] * n + [(task + seq) % spread[p] for p in found], pa.int64()),
                    pa.array([block] * (n + m), pa.int64()),
                    pa.array([None] * n + [pack(x.words, x.per_word, x.context, x.per_bigram, x.doc, x.times) for x in found.values()], pa.binary()),
                    pa.array([*range(n), *[None] * m], pa.int32()),
                    pa.array([*sizes.tolist(), *[None] * m], pa.int64()),
                    pa.concat_arrays([batch.column(1).slice(a, n), pa.nulls(m, batch.column(1).type)]),
                ]
                yield pa.RecordBatch.from_arrays(out, names=every)

    def meet(held: pa.Table, asking: pa.Table) -> pa.Table:
        """What a part adds to each block's documents; documents pass through."""
        if not asking.num_rows or asking["part"][0].as_py() < 0:
            return asking.select(every)
        index = (Counts.unpack(held["counts"][0].as_py()) if held.num_rows else Counts.merged([])).index()
        sums = []
        for data in asking["sums"]:
            x = unpack(data.as_py())
            block = Block(x[0].astype(np.uint64), x[1].astype(np.int64), x[2].astype(np.uint32), x[3].astype(np.int64), x[4].astype(np.int64), x[5].astype(np.int64))
            docs, (b, t) = losses(block, index, shared.value[3])
            sums.append(pack(docs, b.astype(np.float32), t.astype(np.float32)))
        del index
        release()
        return asking.select(every).set_column(3, "sums", pa.array(sums, pa.binary()))

    def finish(table: pa.Table) -> pa.Table:
        """A block's documents with the sums that all parts added."""
        own = table.filter(pa.compute.is_valid(table["place"])).combine_chunks()
        place, n = own["place"].to_numpy(), own["n"].to_numpy().astype(float)
        loss = np.zeros((2, int(place.max(initial=-1)) + 1))
        for data in table["sums"]:
            if data.is_valid:
                docs, b, t = unpack(data.as_py())
                loss[0, docs] += b
                loss[1, docs] += t
        start = np.log(shared.value[3][3] + SMOOTHING)
        b, t = (np.where(n > 0, (x[place] + s) / np.maximum(n, 1), 0.0) for x, s in zip(loss, start))
        return pa.table([own["row"], own["n"], pa.array(t), pa.array(b), pa.array(b - t)], names=["row", *[f.name for f in FIELDS]])

    sent = rows.mapInArrow(send, schema)
    # Few parts, each with its counts as one row; hot ones once for each of their tasks.
    spread = F.array(*[F.lit(x) for x in models.spread]) if len(set(models.spread)) > 1 else None
    salts = F.lit(1) if spread is None else F.get(spread, F.col("part"))
    held = models.counts.select("part", F.explode(F.sequence(F.lit(0).cast("bigint"), (salts - 1).cast("bigint"))).alias("salt"), "counts")
    met = held.groupBy("part", "salt").cogroup(sent.groupBy("part", "salt")).applyInArrow(meet, schema)
    done = met.groupBy("block").applyInArrow(finish, T.StructType([T.StructField("row", rows.schema["row"].dataType), *FIELDS]))
    return done.select(*[F.col("row")[f"c{i}"].alias(c) for i, c in enumerate(names)], *[f.name for f in FIELDS])


def flag_targets(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(text, is_target): whether the document's id is in ``ids`` (one column, ``id``); NULL ids never are.

    Up to BROADCAST_IDS ids, counted first, go to where the texts are; more are
    merged with the texts, rows without an id being spread by their text.
    """
    wanted = ids.select(F.col("id").alias("__wanted")).where("__wanted is not null").distinct()
    own = F.col(f"`{id_col}`")
    rows = docs.select(own.alias("__id"), F.col(f"`{text_col}`").alias("text"))
    if wanted.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        joined = rows.join(F.broadcast(wanted), F.col("__id") == F.col("__wanted"), "left")
    else:
        rows = rows.withColumn("__key", F.coalesce(F.col("__id"), F.xxhash64("text")))
        joined = rows.join(wanted.hint("merge"), (F.col("__key") == F.col("__wanted")) & F.col("__id").isNotNull(), "left")
    return joined.select("text", F.col("__wanted").isNotNull().alias("is_target"))


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, losses and score of all documents; the target is the documents of good quality outside the held-out fold."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where((F.col("quality") == 1) & ~held_out(F.col("doc_id")))
    models = fit(flag_targets(docs, labels.select(F.col("doc_id").alias("id"))))
    out = score(docs, models, keep=["doc_id"])
    return out.select("doc_id", "n_tokens", "target_loss", "background_loss", F.col("lm_score").alias("score"))
