"""Trigram language model with Katz backoff over words, counted in tables that are partitioned by n-gram.

Texts are packed into blocks. A block asks for each of its distinct n-grams once, with its own training count; buckets, each
a range of n-gram hashes, add the counts up and answer every block that asked, so a frequent n-gram is one row a block, and
no table of words goes to the driver or to all workers. From the answers, blocks make each history's sums of discounted counts,
an n-gram at one block alone, which buckets add up likewise. Then a block has all that its texts' probabilities need, and
works them out order by order: that of a seen n-gram is its discounted share of the history, that of another the history's
backoff weight times the shorter n-gram's. Weights make the probabilities after each history sum to one exactly.

Small counts are discounted by Good-Turing at all three orders. Discounted counts are whole multiples of 1 / UNIT, so sums of
them don't depend on the order of adding.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, forgotten, memory_returned, remainder, removed, shared_folder, small_batches, text_or_empty

#: Keys of the start, which is only ever a history, and of the end of a text.
START, END = 1, 2
#: Counts up to this are discounted.
DISCOUNTED = 5
UNIT = 1 << 16
#: Words whose keys a worker keeps; tokens of a block; bytes of a text that are taken at once; n-grams that a bucket should get.
KEPT, BLOCK, SLICE, BUCKET = 300_000, 1_800_000, 4_000_000, 2_000_000
#: Bytes of input for a partition of blocks.
PARTITION = 4_000_000
#: A key of two or three words has so many bits more than the number of tokens: another n-gram has the same with chance 2 ** -24.
SPARE = 24
#: Numbers that a bucket reports by order: types, tokens, and types of each count from one on.
REPORTED = 2 + DISCOUNTED + 1
SPACES = re.compile(rb"[\x20\x09-\x0D]+")


def learns_from(id_col: str = "doc_id") -> Column:
    return remainder(id_col, 7) != 2


class WordKeys(dict):
    """word -> 64-bit key; for a bounded number of short words."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > KEPT:
            self.clear()
        key = xxhash.xxh3_64_intdigest(word)
        if len(word) < 100:
            self[word] = key
        return key


def mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def longer(history: np.ndarray, word: np.ndarray, order: int, idle: int) -> np.ndarray:
    """Keys of the n-grams of an order from those of their histories and last words, with ``idle`` low bits of zero."""
    with np.errstate(over="ignore"):
        return mixed(mixed(history ^ np.uint64(0x9E3779B97F4A7C15 * order % (1 << 64))) + word) >> np.uint64(idle) << np.uint64(idle)


def idle_bits(tokens: int) -> int:
    return max(0, 64 - SPARE - max(1, tokens).bit_length())


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct keys, the place among them of each key, an example's position for each)."""
    order = np.argsort(keys)
    keys = keys[order]
    new = np.r_[True, keys[1:] != keys[:-1]] if len(keys) else np.zeros(0, bool)
    place = np.empty(len(keys), np.int32)
    place[order] = np.cumsum(new, dtype=np.int32) - 1
    return keys[new], place, order[new].astype(np.int32)


def _packed(x: np.ndarray) -> bytes:
    """Compressed byte planes: of small numbers most planes are empty."""
    import zstandard

    return zstandard.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes(), 1)


def _unpacked(x: bytes, kind) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.decompress(x), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


# Blocks


def words_of(text: str) -> Iterator[list[bytes]]:
    """The words of a text, in lists of bounded size."""
    data, at = text.encode().lower(), 0  # of bytes: A-Z and ASCII white space alone
    while len(data) - at > SLICE and (cut := SPACES.search(data, at + SLICE)):
        yield data[at : cut.start()].split()
        at = cut.end()
    yield data[at:].split()


BLOCKS = "block long, rows array<long>, words binary, tokens binary, lengths array<int>, contexts array<int>, learned array<boolean>"


def blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Packed texts: sorted word keys of a block, and its tokens as places among them; a segment is a text or a slice of one.

    A segment begins with its context, which is not predicted: the start, or the last two tokens of the slice before.
    """

    def run(batches):
        keys, number = WordKeys(), TaskContext.get().partitionId() << 33
        held: list[tuple] = []
        size = 0

        def row():
            ids, rows, parts, contexts, learned = zip(*held)
            words, tokens, _ = distinct(np.concatenate(parts))
            values = [number, rows, _packed(words), _packed(tokens), [*map(len, parts)], contexts, learned, ids]
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.bool_()), pa.list_(kind)]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=[*(c.split()[0] for c in BLOCKS.split(", ")), "ids"])

        for batch in batches:
            kind = batch.column(0).type
            for own, at, learned, text in zip(*(c.to_pylist() for c in batch.columns)):
                tail, slices = np.array([START], np.uint64), words_of(text)
                words = next(slices)
                while words is not None:
                    after = next(slices, None)
                    if words or after is None:
                        part = np.r_[tail, np.fromiter(map(keys.__getitem__, words), np.uint64, len(words)), np.array([END] if after is None else [], np.uint64)]
                        held.append((own, at, part, len(tail), learned))
                        tail = part[-2:]
                        size += len(part)
                    if size > BLOCK:
                        yield row()
                        number += 1
                        held.clear()
                        size = 0
                        memory_returned()
                    words = after
        if held:
            yield row()

    source = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), learns_from(id_col).alias("learned"), text_or_empty(text_col).alias("text"))
    return source.mapInArrow(run, f"{BLOCKS}, ids array<{docs.schema[id_col].dataType.simpleString()}>")


class Grams:
    """The distinct n-grams of a block and their own training counts.

    ``keys``, ``counts``: by order. ``first``, ``last``: words of each bigram; ``history``, ``suffix``: bigrams of each trigram;
    ``of``: at each token, the n-gram of each order that ends there.
    """

    def __init__(self, words: bytes, tokens: bytes, lengths: list[int], contexts: list[int], learned: list[bool], idle: int):
        keys, token, size = _unpacked(words, np.uint64), _unpacked(tokens, np.int32), np.array(lengths, np.int32)
        self.segment = np.repeat(np.arange(len(size), dtype=np.int32), size)
        place = np.arange(len(token), dtype=np.int32) - (np.cumsum(size, dtype=np.int32) - size)[self.segment]
        context, learns = np.array(contexts, np.int32)[self.segment], np.array(learned, bool)[self.segment]
        self.idle, self.predicted = idle, place >= context
        counted = learns & self.predicted
        at2, at3 = (np.flatnonzero(place >= n).astype(np.int32) for n in (1, 2))
        word, pair = keys[token], np.zeros(len(token), np.uint64)
        pair[1:] = longer(word[:-1], word[1:], 2, idle)
        keys2, place2, example2 = distinct(pair[at2])
        keys3, place3, example3 = distinct(longer(pair[at3 - 1], word[at3], 3, idle))
        self.keys, self.of = [keys, keys2, keys3], [token, *(np.full(len(token), -1, np.int32) for _ in range(2))]
        self.of[1][at2], self.of[2][at3] = place2, place3
        example2, example3 = at2[example2], at3[example3]
        self.first, self.last = token[example2 - 1], token[example2]
        self.history, self.suffix = self.of[1][example3 - 1], self.of[1][example3]
        starts = learns & (place == 0) & (context == 1)
        taken = (counted | starts, counted & (place >= 1), counted & (place >= 2))
        self.counts = [np.bincount(self.of[o][taken[o]], minlength=len(self.keys[o])).astype(np.uint64) for o in range(3)]


def _edges(buckets: int) -> np.ndarray:
    return np.array([(i << 64) // buckets for i in range(1, buckets)], np.uint64)


def _dealt(keys: list[np.ndarray], columns: list[list[np.ndarray]], edges: np.ndarray, idle: int) -> Iterator[tuple]:
    """(bucket, sizes by order, packed keys, packed columns) of sorted keys by order, and of columns beside them.

    Keys are packed as differences, those of more than a word without their idle bits."""
    cuts = [np.r_[0, np.searchsorted(k, edges), len(k)] for k in keys]
    for bucket in np.flatnonzero(sum(np.diff(c) for c in cuts)):
        parts = [slice(c[bucket], c[bucket + 1]) for c in cuts]
        steps = np.concatenate([np.diff(k[p], prepend=np.uint64(0)) >> np.uint64(idle if o else 0) for o, (k, p) in enumerate(zip(keys, parts))])
        yield int(bucket), [p.stop - p.start for p in parts], _packed(steps), *(_packed(np.concatenate([c[p] for c, p in zip(column, parts)])) for column in columns)


def _gathered(packets: list, sizes: int, column: int, keys: bool = False) -> tuple[list[np.ndarray], list[list[int]]]:
    """A column of packets by order, and the packets' sizes by order."""
    out: list[list[np.ndarray]] = [[] for _ in packets[0][sizes]]
    for packet in packets:
        values, at = _unpacked(packet[column], np.uint64), 0
        for o, n in enumerate(packet[sizes]):
            part = values[at : at + n]
            out[o].append(np.cumsum(part, dtype=np.uint64) if keys else part)  # without idle bits; only their order counts
            at += n
    return [np.concatenate(x) for x in out], [list(x) for x in zip(*(p[sizes] for p in packets))]


def _by_packet(values: list[np.ndarray], sizes: list[list[int]]) -> Iterator[bytes]:
    """The inverse of _gathered: each packet's part."""
    ends = [np.cumsum(s) for s in sizes]
    for i in range(len(sizes[0])):
        yield _packed(np.concatenate([v[e[i] - s[i] : e[i]] for v, e, s in zip(values, ends, sizes)]))


def _rows(names: str, rows: list[list]) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}
    schema = [c.split() for c in names.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(x, kinds[k]) for x, (_, k) in zip(zip(*rows), schema)], names=[n for n, _ in schema])


def _by_bucket(packets: DataFrame, buckets: int, answer, schema: str) -> DataFrame:
    """The rows that ``answer`` makes of all packets of a bucket."""

    def run(batches):
        held: list[list] = []
        for batch in batches:
            for packet in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held[0][0] != packet[0]:
                    yield _rows(schema, answer(held))
                    held = []
                    memory_returned()
                held.append(packet)
        if held:
            yield _rows(schema, answer(held))
            held.clear()
            memory_returned()

    return packets.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(run, schema)


# First exchange: counts

ASKED = "bucket int, block long, sizes array<int>, keys binary, counts binary"
COUNTED = "block long, bucket int, sizes array<int>, totals binary, report array<long>"


def asked(packed: DataFrame, buckets: int, idle: int) -> DataFrame:
    edges = _edges(buckets)

    def run(batches):
        for batch in batches:
            for block, *row in zip(*(c.to_pylist() for c in batch.columns)):
                grams = Grams(*row, idle)
                for bucket, sizes, keys, counts in _dealt(grams.keys, [grams.counts], edges, idle):
                    yield _rows(ASKED, [[bucket, block, sizes, keys, counts]])
                del grams
                memory_returned()

    return packed.select("block", "words", "tokens", "lengths", "contexts", "learned").mapInArrow(run, ASKED)


def added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(answers in the order of the keys, totals, distinct keys): total << 2, 2 if one block alone asked, 1 for the block that
    sums are left to, the first with a count of its own."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    new = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    if not len(new):
        return counts, counts, keys
    size = np.diff(np.r_[new, len(keys)])
    totals = np.add.reduceat(counts, new)
    group = np.repeat(np.arange(len(new)), size)
    value = (totals << np.uint64(2) | (size == 1).astype(np.uint64) << np.uint64(1))[group]
    own = np.flatnonzero(counts)
    value[own[np.r_[True, group[own][1:] != group[own][:-1]]] if len(own) else own] |= np.uint64(1)
    out = np.empty_like(value)
    out[order] = value
    return out, totals, keys[new]


def _count(packets: list) -> list[list]:
    (keys, sizes), (counts, _) = _gathered(packets, 2, 3, keys=True), _gathered(packets, 2, 4)
    answers, report = [], []
    for k, n in zip(keys, counts):
        answer, totals, k = added(k, n)
        answers.append(answer)
        totals = totals[(totals > 0) & (k != np.uint64(START))]
        report += [len(totals), int(totals.sum()), *np.bincount(totals[totals <= DISCOUNTED + 1].astype(np.int64), minlength=DISCOUNTED + 2)[1:].tolist()]
    rows = [[p[1], p[0], p[2], x, None] for p, x in zip(packets, _by_packet(answers, sizes))]
    return [*rows, [None, packets[0][0], None, None, report]]


# Discounts


def discounts(numbers: list[int]) -> list[int]:
    """Discounted counts 0..DISCOUNTED, in units, from the numbers of types by count, from one on.

    Good-Turing in Katz's form; where the numbers are too few or irregular for it (a discount outside of (0, 1]), a count r
    loses a half instead, which too leaves something for what was never seen.
    """
    k, n = DISCOUNTED, [0, *numbers]
    common, out = (k + 1) * n[k + 1] / n[1] if n[1] else 1.0, [0]
    for r in range(1, k + 1):
        d = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) if n[r] and common != 1 else 0.0
        d = d if 0 < d <= 1 and (r > 1 or d < 1) else 1 - 1 / (2 * r)
        out.append(max(1, round(r * d * UNIT)))
    return out


@dataclass(frozen=True)
class Model:
    """What all blocks need: training tokens and their types, discounted counts by order, the probability of a word that was
    never seen, and what those of others are multiplied by so that something is left for it."""

    tokens: int
    types: int
    discounted: tuple[tuple[int, ...], ...]
    unseen: float
    scale: float

    def kept(self, order: int, n: np.ndarray) -> np.ndarray:
        """Discounted counts in units."""
        small = np.array(self.discounted[order], np.int64)
        return np.where(n <= DISCOUNTED, small[np.minimum(n, DISCOUNTED)], n * UNIT)


def fit(report: list[int]) -> Model:
    """The model's numbers from the buckets' reports, added up: a few dozen, whatever the corpus."""
    by_order = [report[i : i + REPORTED] for i in range(0, 3 * REPORTED, REPORTED)]
    small = tuple(tuple(discounts(r[2:])) for r in by_order)
    types, tokens, *numbers = by_order[0]
    lost = sum(n * (r * UNIT - small[0][r]) for r, n in enumerate(numbers[:DISCOUNTED], 1))
    if not tokens:
        return Model(0, 0, small, 0.5, 1.0)
    unseen, scale, least = lost / (UNIT * tokens), 1.0, 1 / (tokens + 1)  # something is left for words that were never seen
    if unseen < least:
        unseen, scale = least, (1 - least) / (1 - unseen)
    return Model(tokens, types, small, unseen, scale)


# Second exchange: sums of histories

SUMMED = "bucket int, block long, sizes array<int>, keys binary, kept binary, covered binary"
TOLD = "block long, bucket int, sizes array<int>, kept binary, covered binary"


class Counts:
    """A block's n-grams with their counts in all training texts; and the sums of histories (words, then bigrams) over the
    successors that are left to this block: of their discounted counts, and of those of the same words after the shorter history."""

    def __init__(self, grams: Grams, answers: list, model: Model):
        values, _ = _gathered(sorted(answers), 1, 2)
        self.grams, self.model = grams, model
        self.n = [(v >> np.uint64(2)).astype(np.int64) for v in values]
        self.alone = [(v & np.uint64(2)) > 0 for v in values]
        own2, own3 = ((v & np.uint64(1)) > 0 for v in values[1:])
        self.sums = [[np.zeros(len(self.n[o]), np.int64) for _ in range(2)] for o in range(2)]
        np.add.at(self.sums[0][0], grams.first[own2], model.kept(1, self.n[1][own2]))
        np.add.at(self.sums[0][1], grams.first[own2], model.kept(0, self.n[0][grams.last[own2]]))
        np.add.at(self.sums[1][0], grams.history[own3], model.kept(2, self.n[2][own3]))
        np.add.at(self.sums[1][1], grams.history[own3], model.kept(1, self.n[1][grams.suffix[own3]]))
        #: Histories that other blocks share.
        self.shared = [np.flatnonzero((self.n[o] > 0) & ~self.alone[o]) for o in range(2)]

    def packets(self, edges: np.ndarray) -> Iterator[tuple]:
        keys = [self.grams.keys[o][at] for o, at in enumerate(self.shared)]
        yield from _dealt(keys, [[self.sums[o][i][at].astype(np.uint64) for o, at in enumerate(self.shared)] for i in range(2)], edges, self.grams.idle)

    def hear(self, told: list) -> None:
        """Put the sums over all blocks in place of this block's."""
        if told:
            for i in range(2):
                for o, values in enumerate(_gathered(sorted(told), 1, 2 + i)[0]):
                    self.sums[o][i][self.shared[o]] = values.astype(np.int64)

    def weights(self, order: int, covered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(what a successor's share is multiplied by, backoff weight) of each history of an order; ``covered``: the
        probability, after the shorter history, of all words that follow it."""
        n = np.maximum(self.n[order], 1).astype(float)
        kept, room, least = self.sums[order][0] / (UNIT * n), 1 - covered, 1 / (n + 1)  # something is left for other successors
        with np.errstate(divide="ignore", invalid="ignore"):
            full = room < 1e-12
            scale = np.where(full, 1 / kept, np.where(1 - kept < least, (1 - least) / kept, 1.0))
            backoff = np.where(full, 0.0, (1 - scale * kept) / np.maximum(room, 1e-12))
        known = self.n[order] > 0
        return np.where(known, scale, 1.0), np.where(known, backoff, 1.0)

    def probabilities(self, order: int) -> tuple[np.ndarray, np.ndarray]:
        """(probability of the last word of each n-gram of an order, the histories' scale of the order below): by recursion."""
        g, m, n = self.grams, self.model, self.n[order]
        if order == 0:
            share = m.kept(0, n) / (UNIT * max(m.tokens, 1)) * m.scale
            return np.where(n > 0, share, m.unseen), np.ones(len(n))
        shorter, scale = self.probabilities(order - 1)
        history, suffix = (g.first, g.last) if order == 1 else (g.history, g.suffix)
        if order == 1:
            covered = self.sums[0][1] / (UNIT * max(m.tokens, 1)) * m.scale
        else:
            covered = scale[g.last] * (self.sums[1][1] / (UNIT * np.maximum(self.n[0][g.last], 1)))
        scale, backoff = self.weights(order - 1, covered)
        seen = scale[history] * (m.kept(order, n) / (UNIT * np.maximum(self.n[order - 1][history], 1)))
        return np.where(n > 0, seen, backoff[history] * shorter[suffix]), scale


def _with_answers(packed: DataFrame, answers: list[DataFrame], run, schema: str) -> DataFrame:
    """``run(row, answers)`` of each block's row and its answers of each kind, which meet by block."""
    columns = [c.split()[0] for c in TOLD.split(", ")]
    right, kinds = None, len(answers)
    for i, table in enumerate(answers):
        part = table.where("block is not null").withColumnRenamed("totals", "kept").withColumn("covered", F.lit(None).cast("binary") if "covered" not in table.columns else F.col("covered"))
        part = part.select(*columns, F.lit(i).alias("kind"))
        right = part if right is None else right.unionByName(part)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        by_kind: list[list] = [[] for _ in range(kinds)]
        for _, bucket, sizes, kept, covered, kind in zip(*(c.to_pylist() for c in right.columns)):
            by_kind[kind].append((bucket, sizes, kept, covered))
        out = [b for row in zip(*(c.to_pylist() for c in left.columns)) for b in run(row, by_kind)]
        memory_returned()
        return pa.Table.from_batches(out) if out else None

    return packed.groupBy("block").cogroup(right.groupBy("block")).applyInArrow(meet, schema)


def summed(packed: DataFrame, counted: DataFrame, model: Model, buckets: int, idle: int) -> DataFrame:
    edges = _edges(buckets)

    def run(row, answers):
        block, _, *parts, _ = row
        rows = [[bucket, block, *packet] for bucket, *packet in Counts(Grams(*parts, idle), answers[0], model).packets(edges)]
        yield _rows(SUMMED, rows) if rows else empty

    empty = pa.RecordBatch.from_pylist([], pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("sizes", pa.list_(pa.int32())), *((c, pa.binary()) for c in ("keys", "kept", "covered"))]))
    return _with_answers(packed, [counted], run, SUMMED)


def _sum(packets: list) -> list[list]:
    keys, sizes = _gathered(packets, 2, 3, keys=True)
    places = [distinct(k)[1] for k in keys]
    columns = []
    for column in (4, 5):
        out = []
        for place, values in zip(places, _gathered(packets, 2, column)[0]):
            total = np.zeros(int(place.max()) + 1 if len(place) else 0, np.uint64)
            np.add.at(total, place, values)
            out.append(total[place])
        columns.append(_by_packet(out, sizes))
    return [[p[1], p[0], p[2], kept, covered] for p, kept, covered in zip(packets, *columns)]


# Scores


def scored(packed: DataFrame, answers: list[DataFrame], model: Model, idle: int) -> DataFrame:
    """(row, id, n_tokens, n_known, base, model) of each segment."""
    id_kind = packed.schema["ids"].dataType.elementType.simpleString()

    def run(row, answers):
        _, rows, *parts, ids = row
        grams = Grams(*parts, idle)
        counts = Counts(grams, answers[0], model)
        counts.hear(answers[1])
        p2, p3 = np.log10(counts.probabilities(1)[0]), np.log10(counts.probabilities(2)[0])
        at = np.flatnonzero(grams.predicted)
        word, pair, triple = (x[at] for x in grams.of)
        logs = np.where(triple >= 0, p3[triple] if len(p3) else 0.0, p2[pair])
        n = counts.n[0][word]
        base = np.log10((n + 1) / (model.tokens + model.types + 1))
        sums = [np.bincount(grams.segment[at], weights, len(rows)) for weights in (None, n > 0, base, logs)]
        columns = [pa.array(rows, pa.int64()), id_array(ids), *(pa.array(x.astype(np.int64)) for x in sums[:2]), *map(pa.array, sums[2:])]
        yield pa.RecordBatch.from_arrays(columns, names=["row", "id", "n_tokens", "n_known", "base", "model"])

    def id_array(ids: list) -> pa.Array:
        return pa.array(ids, kind)

    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(packed.schema["ids"].dataType.elementType)
    return _with_answers(packed, answers, run, f"row long, id {id_kind}, n_tokens long, n_known long, base double, model double")


@contextmanager
def _setting(spark: SparkSession, name: str, value: str):
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row; see the module's account.

    ``score`` is the model's log10 probability of the text: the sum over its words and the end. Words that were never seen
    count as one. ``base_score`` and the counts are of single words.

    Null or empty text has the end alone. Rows that repeat an id give a row each, and so do null ids, which count for the
    split as the empty text. Without training documents a word and the end have a half each. An empty table gives an empty one.
    Other columns are ignored. Long texts are taken in slices, each with the two tokens before it as context. Texts are never
    shuffled: their blocks of token numbers are, once; the tables in the shared folder are removed when scores are written.
    """
    spark = docs.sparkSession
    small_batches(spark, 32)
    source = blocks(docs, id_col, text_col)
    # partitions of blocks grow with the input, by its estimated size, or where none is known by its own partitions
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    parts = size // PARTITION if size < 1 << 60 else docs.rdd.getNumPartitions()
    parallel = max(int(spark.conf.get("spark.sql.shuffle.partitions")), parts, 1)
    folders = [shared_folder(spark, name) for name in ("counts", "sums")]
    # shuffle files go as soon as a table is written, not when the driver's memory is cleaned
    with _setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        with _setting(spark, "spark.sql.adaptive.enabled", "false"):  # so that the checkpoint's partitioning stays known, and blocks stay where they are
            packed = checkpointed(source.repartition(parallel, "block"))
        spark.sparkContext._jvm.System.gc()  # a checkpoint's shuffle goes with the driver's last reference to it
        asking = packed.select(F.coalesce(F.sum(F.expr("aggregate(lengths, 0L, (a, x) -> a + x)")), F.lit(0)).alias("n")).first()["n"]
        buckets = max(parallel, math.ceil(1.7 * asking / BUCKET))  # at most three n-grams a token are asked for, some 1.7 distinct ones
        idle = idle_bits(asking)
        _by_bucket(asked(packed, buckets, idle), buckets, _count, COUNTED).write.parquet(folders[0])
        counted = spark.read.parquet(folders[0])
        report = dict(counted.where("block is null").select(F.posexplode("report").alias("at", "n")).groupBy("at").agg(F.sum("n").alias("n")).collect())
        model = fit([report.get(i, 0) for i in range(3 * REPORTED)])
        _by_bucket(summed(packed, counted, model, buckets, idle), buckets, _sum, TOLD).write.parquet(folders[1])
        segments = scored(packed, [counted, spark.read.parquet(folders[1])], model, idle)
        sums = segments.groupBy("row").agg(F.first("id").alias("id"), *(F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base", "model")))
        scores = checkpointed(sums)
    forgotten(packed)
    for folder in folders:
        removed(spark, folder)
    return scores.select(
        F.col("id").alias(id_col), (~learns_from("id")).alias("held_out"), "n_tokens", "n_known",
        F.lit(model.tokens).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), F.col("model").alias("score"),
    )
