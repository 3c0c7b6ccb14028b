"""Quality by an interpolated modified Kneser-Ney trigram model of trusted text.

The model is fitted on all rows that the labels call good and not toxic but a third of them, by hash, which is held out; the
held-out rows give each language's perplexity quantile, in a grouped aggregate. The model's tables grow with the trusted text,
so no task holds them whole: trigrams are dealt to shards by their middle word (a frequent one by its predecessors, too). What
a trigram's probability takes is then in its shard but for three things: the numbers of predecessors of the words of split
pairs, which are summed in a second deal and sent to all shards of the word, the discounts and the words' own shares. Texts
are not moved: a task sends each shard the trigrams of some hundred texts, sorted and packed, and gets back a sum for each text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import groupby
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, lean, remove, rows_of, small_batches, text_bytes, texts, written

#: Quantile of the held-out perplexities of a language, and the margin over it that is still accepted. A language with fewer
#: than ``FEW`` held-out rows, of which that quantile is but the largest, has the threshold of all languages where that is higher.
QUANTILE, MARGIN, FEW = 0.995, 1.05, 20
#: Trigrams of all texts that a shard is to have, and the least shards. Bytes of text whose trigrams are packed together.
SHARD, SHARDS, PART = 16_000_000, 48, 4_000_000
#: Rounds in which the texts are scored, a share of them in each: their trigrams are on disk for one round at a time.
ROUNDS = 3
#: Shuffle files go at the end of a write, not when the driver happens to collect its garbage.
CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bits of the filter that tells which texts may be trusted rows.
FILTER_BITS = 24
#: Word numbers take so many bits in a key; 0 is the start of a text, 1 any word the vocabulary lacks.
BITS = 20
START, OTHER = 0, 1
MASK = (1 << BITS) - 1
#: Kinds of packed rows, in the order in which a shard needs them.
TRI, BI, HEAD, ASK, PAIR, HIST, PLACES = range(7)
PACKED = "shard int, kind int, part long, blob binary"


class Words(dict):
    """Numbers of raw tokens; a token is normalised when first met: one closing mark goes, a leading capital is lowered."""

    def __init__(self, vocabulary: dict[str, int]):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, token: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        self[token] = found = self.vocabulary.get(plain(token), OTHER)
        return found


def plain(token: bytes) -> str:
    word = token.decode("utf-8", "replace")
    if len(word) > 1 and word[-1] in ".,;:?":
        word = word[:-1]
    return word[0].lower() + word[1:]


def trusted(labels: DataFrame) -> DataFrame:
    """Distinct ``doc_id`` of the rows that the labels call good and not toxic."""
    good = labels.filter("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null")
    return good.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()


def fit_rows(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The ``text`` of every trusted row that is not held out.

    Where the ids are too many to be broadcast, only texts that a filter lets pass meet them: it has a bit for each hash of
    ``FILTER_BITS`` bits, so it never holds back a trusted row, and what it lets pass wrongly finds no partner.
    """
    ids = trusted(labels).filter(~held_out())
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 64 - FILTER_BITS)
    word = ids.select(place.alias("place")).groupBy(F.shiftright("place", 5).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(place & 31 as int))")).alias("bits")).toArrow()
    bits = np.zeros(1 << FILTER_BITS - 5, np.uint32)
    bits[word["at"].to_numpy()] = word["bits"].to_numpy().astype(np.uint32)
    maybe = documents.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = column(batch, "place").fill_null(0).to_numpy()
            yield batch.filter(pa.array((maybe.value[at >> 5] >> (at & 31).astype(np.uint32) & 1).astype(bool))).select(["doc_id", "text"])

    return texts(documents).withColumn("place", place).mapInArrow(lean(run), "doc_id long, text string").join(ids, "doc_id").select("text")


def held_out() -> Column:
    """A third of all rows, by the hash of ``doc_id``: never fitted on."""
    return F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(3)) == 0


def vocabulary(fit: DataFrame) -> tuple[dict[str, int], np.ndarray, int]:
    """Numbers of the words that stand at least twice in the fitted text, most frequent first (as many as a key has room for), how
    often each number stands there, and how many other words there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        for batch in batches:
            counts: Counter = Counter()
            for text in text_bytes(batch):
                counts.update(text.split())
            yield rows_of(["word", "n"], [[plain(w) for w in counts], list(counts.values())], [pa.string(), pa.int64()])

    counts = fit.select("text").mapInArrow(lean(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = written(counts)
    rows = counts.filter("n > 1").orderBy(F.desc("n"), "word").limit(MASK - 2).toArrow()
    every, tokens = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    remove(counts)
    n = rows["n"].to_numpy()
    return {w: i + 2 for i, w in enumerate(rows["word"].to_pylist())}, np.concatenate([[0, tokens - n.sum()], n]).astype(np.int64), every - len(n)


def numbered(many: list[bytes], words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of all texts, two starts before each, and the places where the texts end."""
    flat, ends, get = [], [], words.__getitem__
    for text in many:
        flat += (START, START)
        flat += map(get, text.split())
        ends.append(len(flat))
    return np.array(flat, np.int64), np.array(ends, np.int64)


def keys_of(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The trigrams ``a b c`` of numbered texts as keys, highest bits first ``b``, ``a``, ``c``; and where their last words stand."""
    at = np.nonzero(ids != START)[0]
    return ids[at - 1] << 2 * BITS | ids[at - 2] << BITS | ids[at], at


def _planes(x: np.ndarray, width: int) -> bytes:
    return pa.Codec("zstd", compression_level=1).compress(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width].T).tobytes(), asbytes=True)


def pack(keys: np.ndarray, values: np.ndarray) -> bytes:
    """Sorted keys and a number (32 bits) of each: columns of differences, byte by byte, compressed."""
    b, a, c = keys >> 2 * BITS, keys >> BITS & MASK, keys & MASK
    step = np.diff(b, prepend=0)
    columns = [_planes(step, 3), _planes(np.where(step == 0, np.diff(a, prepend=0), a), 3), _planes(c, 3), _planes(values, 4)]
    return np.array([len(keys), *map(len, columns)], "<i8").tobytes() + b"".join(columns)


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, *sizes = np.frombuffer(blob, "<i8", 5).tolist()
    out, at = [], 40
    for size, width in zip(sizes, (3, 3, 3, 4), strict=True):
        x = np.zeros((n, 4), np.uint8)
        x[:, :width] = np.frombuffer(pa.Codec("zstd").decompress(blob[at : at + size], n * width, asbytes=True), np.uint8).reshape(width, n).T
        out.append(x.view("<u4")[:, 0])
        at += size
    step, a, c, values = out
    a = np.cumsum(a.astype(np.int64))
    first = np.nonzero(step)[0]
    if len(first):  # within a middle word the predecessors are differences, from its first one on
        before = np.where(first > 0, a[first - 1], 0)
        a -= np.repeat(np.concatenate([[0], before]), np.diff(np.concatenate([[0], first, [n]])))
    return np.cumsum(step.astype(np.int64)) << 2 * BITS | a << BITS | c, values


@dataclass
class Deal:
    """The shard of a trigram by its middle word and, where that has more tokens than a shard is to have, by ``a`` modulo ``splits[b]``."""

    shards: int
    splits: np.ndarray

    @staticmethod
    def of(counts: np.ndarray, tokens: int) -> Deal:
        shards = max(SHARDS, ceil(tokens / SHARD))
        splits = 1 + counts * 2 * shards // max(1, int(counts.sum()))
        splits[OTHER] = max(splits[OTHER], shards // 4)  # more of these stand outside the fitted text
        return Deal(shards, splits)

    def part(self, b: np.ndarray, k: np.ndarray) -> np.ndarray:
        mixed = (b.astype(np.uint64) << np.uint64(BITS) | k.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        return ((mixed >> np.uint64(32)) % np.uint64(self.shards)).astype(np.int64)

    def shard(self, keys: np.ndarray) -> np.ndarray:
        b = keys >> 2 * BITS
        return self.part(b, (keys >> BITS & MASK) % self.splits[b])

    def home(self, keys: np.ndarray) -> np.ndarray:
        b = keys >> 2 * BITS
        return self.part(b, np.zeros(len(b), np.int64))

    def places(self, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into ``b``, shard), once for each shard that has trigrams of the word."""
        of = np.repeat(np.arange(len(b)), self.splits[b])
        k = np.arange(len(of)) - np.repeat(np.cumsum(self.splits[b]) - self.splits[b], self.splits[b])
        pairs = np.unique(self.part(b[of], k) * len(b) + of) if len(b) else of
        return pairs % max(1, len(b)), pairs // max(1, len(b))


def dealt(kind: int, part: int, keys: np.ndarray, values: np.ndarray, shard: np.ndarray) -> pa.RecordBatch:
    """A packed row for each shard; keys are sorted and stay so."""
    order = np.argsort(shard.astype(np.uint16), kind="stable")
    keys, values, shard = keys[order], values[order], shard[order]
    cuts = np.concatenate([[0], np.nonzero(np.diff(shard))[0] + 1, [len(shard)]]) if len(shard) else np.zeros(1, int)
    spans = list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
    return packed_rows([(int(shard[i]), kind, part, pack(keys[i:j], values[i:j])) for i, j in spans])


def packed_rows(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    return rows_of(["shard", "kind", "part", "blob"], list(zip(*rows, strict=True)) or [[]] * 4, [pa.int32(), pa.int32(), pa.int64(), pa.binary()])


def summed(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of packed rows, sorted, and the sums of their values."""
    many = [unpack(b) for b in blobs]
    keys = np.concatenate([k for k, _ in many] or [np.zeros(0, np.int64)])
    values = np.concatenate([v for _, v in many] or [np.zeros(0, np.int64)]).astype(np.int64)
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    first = np.nonzero(np.diff(keys, prepend=-1))[0]
    return keys[first], np.add.reduceat(values, first) if len(first) else values


def by_shard(rows: DataFrame, shards: int, one: Callable[[int, list[bytes]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """``one`` applied to the packed rows of each shard; a task takes a shard at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, own in groupby(unrolled(batches), lambda r: r[0]):
            yield from one(shard, [r[3] for r in own])

    return rows.repartitionById(shards, "shard").sortWithinPartitions("shard", "part").mapInArrow(lean(run, 0), PACKED)


def unrolled(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int, bytes]]:
    for batch in batches:
        head = [column(batch, c).to_pylist() for c in ("shard", "kind", "part")]
        blobs = column(batch, "blob")
        for i, (shard, kind, part) in enumerate(zip(*head, strict=True)):
            yield shard, kind, part, blobs[i].as_py()


def histogram(values: np.ndarray) -> bytes:
    return np.bincount(np.minimum(values, 5), minlength=6)[1:5].astype("<i8").tobytes()


def discounts(rows: DataFrame) -> np.ndarray:
    """Modified Kneser-Ney discounts of counts 1, 2 and more, from the counts of counts."""
    n = np.zeros(4, np.int64)
    for r in rows.filter(F.col("kind") == HIST).select("blob").collect():
        n += np.frombuffer(r[0], "<i8")
    return _discounts(n)


def _discounts(n: np.ndarray) -> np.ndarray:
    n1, n2, n3, n4 = (max(1, int(x)) for x in n)
    y = n1 / (n1 + 2 * n2)
    held = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return np.array([min(max(d, 0.05), i + 0.95) for i, d in enumerate(held)])


def _shares(context: np.ndarray, n: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(discounted share of each count in its context, that context's gamma, first place and gamma of each context); contexts are sorted."""
    first = np.nonzero(np.diff(context, prepend=-1))[0]
    if not len(first):
        return np.zeros(0), np.zeros(0), first, np.zeros(0)
    off, sizes = d[np.minimum(n, 3) - 1], np.diff(np.append(first, len(n)))
    total = np.add.reduceat(n, first)
    gamma = np.add.reduceat(off, first) / total
    return (n - off) / np.repeat(total, sizes), np.repeat(gamma, sizes), first, gamma


class Model:
    """Sorted key tables: probabilities of the trigrams and bigrams met, and the weights of their contexts; of a shard, or of all."""

    def __init__(self, tri, ctx, bi, gamma: np.ndarray, one: np.ndarray, others: int):
        self.tri, self.ctx, self.bi, self.gamma, self.one = tri, ctx, bi, gamma, one
        self.others = np.log10(max(1, others))  # words outside the vocabulary share their probability evenly

    @staticmethod
    def _get(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(table[0]):
            return np.zeros(len(keys), bool), np.zeros(len(keys))
        at = np.searchsorted(table[0], keys)
        at[at == len(table[0])] = 0
        return table[0][at] == keys, table[1][at]

    def log10(self, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
        c_all = c
        seen, p = self._get(self.tri, b << 2 * BITS | a << BITS | c)
        out = np.where(seen, p, 0.0)
        left = np.nonzero(~seen)[0]
        a, b, c = a[left], b[left], c[left]
        met, g3 = self._get(self.ctx, b << BITS | a)
        pair, p2 = self._get(self.bi, b << BITS | c)
        out[left] = np.where(met, g3, 1.0) * np.where(pair, p2, self.gamma[b] * self.one[c])
        return np.log10(out) - np.where(c_all == OTHER, self.others, 0.0)


@dataclass
class Shares:
    """What all shards share: discounts of trigrams and bigrams, each word's own probability, the number of words it leaves out."""

    tri: np.ndarray
    bi: np.ndarray
    one: np.ndarray
    others: int

    def model(self, tri: list[bytes], bi: list[bytes]) -> Model:
        keys, n = summed(bi)
        b, c = keys >> 2 * BITS, keys & MASK
        share, weight, first, own = _shares(b, n, self.bi)
        gamma = np.ones(len(self.one))
        gamma[b[first]] = own
        pairs = b << BITS | c, (share + weight * self.one[c]).astype(np.float32)
        keys, n = summed(tri)
        context = keys >> BITS
        share, weight, first, own = _shares(context, n, self.tri)
        p = share + weight * Model._get(pairs, context >> BITS << BITS | keys & MASK)[1]
        return Model((keys, p.astype(np.float32)), (context[first], own.astype(np.float32)), pairs, gamma, self.one, self.others)


@dataclass
class Fitted:
    """Packed counts of all shards (``TRI`` and ``BI`` rows), how they are dealt, the vocabulary and what the shards share."""

    tri: DataFrame
    bi: DataFrame
    deal: Deal
    known: dict[str, int]
    shares: Shares
    sent: Broadcast

    def tables(self) -> DataFrame:
        return self.tri.filter(F.col("kind") == TRI).unionByName(self.bi.filter(F.col("kind") == BI))

    def remove(self) -> None:
        remove(self.tri, self.bi)
        self.sent.destroy()


def counted(fit: DataFrame, of_all: float = 1.0) -> Fitted:
    """The counts of the texts in ``fit``, which have so large a share ``of_all`` texts. Without texts every word has the same probability."""
    known, often, others = vocabulary(fit)
    deal, size = Deal.of(often, int(often.sum() / of_all)), len(known) + 2
    held = fit.sparkSession.sparkContext.broadcast((known, deal))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(held.value[0])
        for many in parts(batches):
            keys, n = np.unique(keys_of(numbered([t for b in many for t in text_bytes(b)], words)[0])[0], return_counts=True)
            yield dealt(PAIR, 0, keys, n, held.value[1].shard(keys))

    def of_shard(shard: int, blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        keys, n = summed(blobs)
        yield packed_rows([(shard, TRI, 0, pack(keys, n)), (shard, HIST, 0, histogram(n))])
        pairs, before = np.unique(keys >> 2 * BITS << 2 * BITS | keys & MASK, return_counts=True)  # distinct words before, of this shard
        yield dealt(PAIR, shard, pairs, before, held.value[1].home(pairs))

    def of_home(shard: int, blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        keys, n = summed(blobs)
        yield packed_rows([(shard, HIST, 0, histogram(n))])
        last, kinds = np.unique(keys & MASK, return_counts=True)
        yield dealt(PLACES, shard, last, kinds, last >> 13)
        b, first, sizes = np.unique(keys >> 2 * BITS, return_index=True, return_counts=True)
        word, to = held.value[1].places(b)
        rows = np.repeat(first[word], sizes[word]) + np.arange(sizes[word].sum()) - np.repeat(np.cumsum(sizes[word]) - sizes[word], sizes[word])
        to = np.repeat(to, sizes[word])
        yield dealt(BI, shard, keys[rows], n[rows], to)

    tri = written(by_shard(fit.select("text").mapInArrow(lean(count), PACKED), deal.shards, of_shard))
    bi = written(by_shard(tri.filter(F.col("kind") == PAIR), deal.shards, of_home))
    d3, d2 = discounts(tri), discounts(bi)
    # distinct pairs that end in a word, summed by blocks of the vocabulary
    block = lambda shard, blobs: iter([packed_rows([(shard, PLACES, 0, pack(*summed(blobs)))])])
    ends, n = summed([r[0] for r in by_shard(bi.filter(F.col("kind") == PLACES), 1 + (size >> 13), block).select("blob").collect()])
    one = np.full(size, 1.0 / (size - 1))
    if len(n):
        off = _discounts(np.bincount(np.minimum(n, 5), minlength=6)[1:5])[np.minimum(n, 3) - 1]
        one *= off.sum() / n.sum()
        one[ends] += (n - off) / n.sum()
    shares = Shares(d3, d2, one, others)
    return Fitted(tri, bi, deal, known, shares, fit.sparkSession.sparkContext.broadcast((known, deal, shares)))


def fitted(fit: DataFrame) -> tuple[Model, dict[str, int]]:
    """The model of a few texts in one piece, and its vocabulary."""
    own = counted(fit)
    blobs = {kind: [r[0] for r in own.tables().filter(F.col("kind") == kind).select("blob").collect()] for kind in (TRI, BI)}
    own.remove()
    # a split word's pairs are in several shards
    keys, n = (np.concatenate(x) for x in zip(*map(unpack, blobs[BI]), (np.zeros(0, np.int64), np.zeros(0, np.uint32)), strict=True))
    keys, first = np.unique(keys, return_index=True)
    return own.shares.model(blobs[TRI], [pack(keys, n[first])]), own.known


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """Batches together until their texts have ``PART`` bytes."""
    many, size = [], 0
    for batch in batches:
        many.append(batch)
        size += column(batch, "text").nbytes
        if size >= PART:
            yield many
            many, size = [], 0
    if many:
        yield many


def scored(documents: DataFrame, model: Fitted, mark: Column | None = None) -> DataFrame:
    """``doc_id``, ``lang``, ``n`` (tokens), ``perplexity`` (null without tokens) and ``mark`` of every text.

    The texts of a part stay in one row of their own (``HEAD``) without the texts, their trigrams go to the shards (``ASK``);
    the sums of logarithms that come back are added up in the order of the shards.
    """
    held = model.sent
    names, types = ["doc_id", "lang", "n", "mark"], [pa.int64(), pa.string(), pa.int64(), pa.binary()]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, deal = Words(held.value[0]), held.value[1]
        for k, many in enumerate(parts(batches)):
            part = TaskContext.get().partitionId() << 32 | k
            ids, ends = numbered([t for b in many for t in text_bytes(b)], words)
            sizes = np.diff(ends, prepend=0)
            keys, at = keys_of(ids)
            doc = np.repeat(np.arange(len(sizes)), sizes)[at]
            order = np.argsort(keys, kind="stable")
            head = pa.Table.from_batches([b.select(["doc_id", "lang", "mark"]) for b in many]).combine_chunks()
            head = rows_of(names, [*(pa.concat_arrays(head[c].chunks) for c in names[:2]), sizes - 2, pa.concat_arrays(head["mark"].chunks)], types)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, head.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(head)
            yield packed_rows([(part % deal.shards, HEAD, part, sink.getvalue().to_pybytes())])
            keys, doc = keys[order], doc[order]
            yield dealt(ASK, part, keys, doc, deal.shard(keys))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, own in groupby(unrolled(batches), lambda r: r[0]):
            tables, made = {TRI: [], BI: []}, None
            for _, kind, part, blob in own:
                if kind in tables:
                    tables[kind].append(blob)
                elif kind == HEAD:
                    yield packed_rows([(-1, HEAD, part, blob)])
                else:
                    made = made or held.value[2].model(tables[TRI], tables[BI])
                    keys, doc = unpack(blob)
                    logs = np.bincount(doc, made.log10(keys >> BITS & MASK, keys >> 2 * BITS, keys & MASK))
                    met = np.nonzero(logs)[0]
                    yield packed_rows([(shard, ASK, part, pack(met, logs[met].astype("<f4").view("<u4")))])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, own in groupby(unrolled(batches), lambda r: r[2]):
            head = pa.ipc.open_stream(next(own)[3]).read_next_batch()
            logs = np.zeros(head.num_rows)
            for r in own:
                doc, values = unpack(r[3])
                logs[doc] += values.view("<f4")
            n = column(head, "n").to_numpy()
            with np.errstate(divide="ignore", invalid="ignore"):
                perplexity = pa.array(np.power(10, -logs / n), mask=n == 0)
            yield rows_of([*names[:3], "perplexity", "mark"], [*head.columns[:3], perplexity, head.columns[3]], [*types[:3], pa.float64(), types[3]])

    rows = texts(documents, F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), (F.lit(None).cast("binary") if mark is None else mark).alias("mark"))
    asked = rows.mapInArrow(lean(ask), PACKED).unionByName(model.tables())
    answers = asked.repartitionById(model.deal.shards, "shard").sortWithinPartitions("shard", "kind", "part").mapInArrow(lean(answer, 0), PACKED)
    return answers.repartition("part").sortWithinPartitions("part", "kind", "shard").mapInArrow(lean(gather, 0), "doc_id long, lang string, n long, perplexity double, mark binary")


def thresholds(scores: DataFrame, labels: DataFrame) -> dict[str, float]:
    """The threshold of each language that has held-out trusted rows (without any: of the fitted rows themselves).

    That of "" also holds for languages without any. There are as many as languages.
    """
    rows = scores.filter("perplexity is not null").join(trusted(labels), "doc_id")
    own = rows.filter(held_out())
    limit = F.percentile_approx("perplexity", F.lit(QUANTILE), F.lit(100_000)) * MARGIN
    every = own.agg(limit).first()[0] or rows.agg(limit).first()[0] or float("inf")
    found = {r[0]: r[1] if r[2] >= FEW else max(r[1], every) for r in own.groupBy("lang").agg(limit, F.count("*")).toLocalIterator()}
    return {**found, "": found.get("", every)}


def judged(documents: DataFrame, labels: DataFrame, mark: Column | None = None) -> DataFrame:
    """:func:`scored` by the model of all trusted rows, with each language's ``threshold`` and ``keep``."""
    spark = documents.sparkSession
    before = spark.conf.get(CLEANED, None)
    spark.conf.set(CLEANED, "true")
    few = trusted(labels).filter(~held_out()).join(documents.select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id").count()
    rows = written(fit_rows(documents, labels))
    model = counted(rows, max(few, 1) / max(documents.count(), 1))
    remove(rows)
    turn = F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.lit("round")), F.lit(ROUNDS))
    rounds = [written(scored(documents.filter(turn == k), model, mark)) for k in range(ROUNDS)]
    model.remove()
    spark.conf.set(CLEANED, before) if before is not None else spark.conf.unset(CLEANED)
    scores = reduce(DataFrame.unionByName, rounds)
    limits = thresholds(scores, labels)
    table = spark.createDataFrame(list(limits.items()), "lang string, own double")
    limit = F.coalesce("own", F.lit(limits[""]))
    return scores.join(F.broadcast(table), "lang", "left").withColumn("threshold", limit).withColumn("keep", (F.col("n") > 0) & (F.col("perplexity") <= limit))


def op6_quality(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Every document with its tokens, perplexity, its language's threshold and ``keep``.

    Texts are scored once; thresholds come from the scores. Null and empty texts have no perplexity and are not kept; a
    language without trusted rows has the threshold of all of them; without trusted rows nothing but empty texts is
    rejected. Repeated rows are each returned; an empty table gives no rows.
    """
    return judged(documents, labels).select("doc_id", F.col("n").alias("n_tokens"), "perplexity", "threshold", "keep")


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, all columns as they are.

    Rows meet what was kept by their text's hash and their language: null and empty texts go; repeated rows and null ids are
    judged each by its text; without trusted rows all other texts stay.
    """
    mark = lambda text: F.unhex(F.md5(text))
    kept = judged(docs, labels, mark(F.coalesce(F.col("text").cast("string"), F.lit("")))).filter("keep").select("mark", F.col("lang").alias("__lang")).distinct()
    rows = docs.withColumn("__mark", mark(F.col("text").cast("string")))
    same = (F.col("__mark") == F.col("mark")) & (F.coalesce(F.col("lang").cast("string"), F.lit("")) == F.col("__lang"))
    return rows.join(kept, same, "left_semi").select(*docs.columns)


def quality_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang"), spark.read.parquet(f"{sf_dir}/labels.parquet")
