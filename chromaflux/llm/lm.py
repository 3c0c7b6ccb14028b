"""Language-model scores of whole documents: a recurrent model trained on the corpus, over tables of word counts.

Texts are split into words once: each task writes parts of the corpus as numbers into the part's own list of words, with
how often each stands in its training documents. These lists are summed to the counts of the corpus, and a part is put
into the network's numbers by looking up its list. The ``HEAD`` most frequent words (a bounded table) are broadcast;
counts of rarer words stay in a table that the rare words of each text are joined with. The network sees the most
frequent words and buckets of the others; a word within its bucket has its smoothed unigram probability there.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import gru
from .common import column, documents, lean, remove, rows_of, text_bytes, texts, written

#: Words that are broadcast with their counts at most, outputs of the network (buckets included), passes of averaging.
HEAD, OUTPUTS, ROUNDS = 1 << 18, 1024 + gru.PER_CLASS, 2
#: Tokens that a text is trained on in one go: the state begins anew in each piece of a longer one (scores carry it to the end).
SEGMENT = 4096
#: Bytes of text in a part; a longer text is a part of its own.
PART = 4 << 20
#: Bytes of parts that a task writes or decodes together.
GROUP = 16 << 20
END = b""
FOLDS, HELD = 7, 2


def held_out(doc_id) -> bool:
    """Whether a document is not trained on: crc32 of its id as text, modulo 7, is 2 (a null id counts as the text "None")."""
    return zlib.crc32(str(doc_id).encode()) % FOLDS == HELD


def tokens(text: bytes) -> list[bytes]:
    """Lower-cased words; the end is implied."""
    return text.lower().split()


class Local(dict):
    """Numbers of the words of a part, in the order they are met; 0 is the end of a text."""

    def __init__(self):
        super().__init__({END: 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


PARTS = "rows array<long>, doc_ids array<long>, turns array<int>, sizes array<int>, tokens binary, words array<binary>, counts array<long>"


def one_list(values: pa.Array) -> pa.ListArray:
    """A column of one row that holds all of ``values``."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


class Part(NamedTuple):
    """A part as it is read: its columns without a Python object for each word or document."""

    rows: np.ndarray | None
    doc_ids: pa.Array | None
    turns: np.ndarray
    sizes: np.ndarray
    tokens: np.ndarray
    words: pa.Array

    @classmethod
    def each(cls, batch: pa.RecordBatch) -> Iterator[Part]:
        of = dict(zip(batch.schema.names, batch.columns, strict=True))
        for i in range(batch.num_rows):
            listed = {k: of[k][i].values for k in ("rows", "doc_ids", "turns", "sizes", "words") if k in of}
            numbers = {k: listed[k].to_numpy() if k in listed else None for k in ("rows", "turns", "sizes")}
            yield cls(**numbers, doc_ids=listed.get("doc_ids"), tokens=np.frombuffer(of["tokens"][i].as_buffer(), np.int32), words=listed["words"])


def parts(docs: DataFrame) -> DataFrame:
    """Parts of the corpus: for each document its row, id, round of training (-1: held out) and size; all their tokens; the words and their training counts."""
    names = [x.split()[0] for x in PARTS.split(", ")]
    types = [pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        local, held, size = Local(), [], 0

        def out() -> pa.RecordBatch:
            row, ids, turn, tokens = zip(*held, strict=True)
            trained = [t for t, x in zip(tokens, turn, strict=True) if x >= 0]
            counts = np.bincount(np.concatenate(trained), minlength=len(local)) if trained else np.zeros(len(local), np.int64)
            lists = [one_list(pa.array(x, t.value_type)) for x, t in zip((row, ids, turn, [*map(len, tokens)]), types, strict=False)]
            binary = pa.array([np.concatenate(tokens).tobytes()], pa.binary())
            return rows_of(names, [*lists, binary, one_list(pa.array(list(local), pa.binary())), one_list(pa.array(counts, pa.int64()))], types)

        for batch in batches:
            for row, doc_id, text in zip(column(batch, "row").to_pylist(), column(batch, "doc_id").to_pylist(), text_bytes(batch), strict=True):
                if held and size + len(text) > PART:
                    yield out()
                    local, held, size = Local(), [], 0
                words = tokens(text)
                ids = np.fromiter(map(local.__getitem__, words), np.int32, len(words))
                turn = -1 if held_out(doc_id) else zlib.crc32(b"round" + str(doc_id).encode()) % ROUNDS
                held.append((row, doc_id, turn, np.append(ids, np.int32(0))))
                size += len(text)
        if held:
            yield out()

    return texts(docs).withColumn("row", F.monotonically_increasing_id()).mapInArrow(lean(run), PARTS)


def word_counts(of_parts: DataFrame) -> DataFrame:
    """``word`` (binary; the end of a text is the empty word) and its count ``n`` over the training documents."""
    each = of_parts.select(F.explode(F.arrays_zip("words", "counts")).alias("x")).select(F.col("x.words").alias("word"), F.col("x.counts").alias("n"))
    return each.filter("n > 0").groupBy("word").agg(F.sum("n").alias("n"))


class Vocabulary:
    """Head words with counts and outputs; totals; the buckets and how much stands in each."""

    def __init__(self, head: list[tuple[bytes, int]], prefixes: dict[bytes, tuple[int, int]], total: int, distinct: int):
        self.total, self.distinct = total, distinct
        ranked = sorted((x for x in head if x[0] != END), key=lambda x: (-x[1], x[0]))
        own = [END, *(w for w, _ in ranked[: OUTPUTS - gru.PER_CLASS - 1])]
        self.first_bucket = OUTPUTS - gru.PER_CLASS
        self.output = {w: i for i, w in enumerate(own)}
        self.count = dict(head)
        inside: dict[bytes, list[int]] = {}
        for w in own[1:]:
            x = inside.setdefault(w[:2], [0, 0])
            x[0] += self.count[w]
            x[1] += 1
        rest = {p: (n - inside.get(p, (0, 0))[0], v - inside.get(p, (0, 0))[1]) for p, (n, v) in prefixes.items() if p != END}
        frequent = sorted((p for p in rest if rest[p][1]), key=lambda p: (-rest[p][0], p))[: gru.PER_CLASS - 1]
        self.bucket = {p: self.first_bucket + i for i, p in enumerate(frequent)}
        sums = np.zeros((gru.PER_CLASS, 2))
        for p, x in rest.items():
            sums[self.bucket.get(p, OUTPUTS - 1) - self.first_bucket] += x
        self.within = -np.log10(sums.sum(1) + 1)  # less log10 (tokens + words + 1): room for one word never seen
        weight = np.zeros(OUTPUTS)
        for w, i in self.output.items():
            weight[i] = self.count.get(w, 0)
        weight[self.first_bucket :] = sums[:, 0]
        self.unigram = (weight + 1) / (weight + 1).sum()

        self.head = pa.array(list(self.count), pa.binary())
        self.prefixes, self.buckets = pa.array(list(self.bucket), pa.binary()), np.array([*self.bucket.values(), OUTPUTS - 1], np.int16)  # the last is of other prefixes
        self.log = np.log10(np.array([*self.count.values(), 0.0]) + 1)  # the last is of words outside the head
        self.outputs = np.array([*map(self.number, self.count), 0], np.int16)

    def number(self, word: bytes) -> int:
        found = self.output.get(word)
        return self.bucket.get(word[:2], OUTPUTS - 1) if found is None else found

    def numbers(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Outputs of the words of a part and their places in the head (-1: not there)."""
        at = places(words, self.head)
        ids = self.outputs[at]
        rare = np.nonzero(at < 0)[0]
        ids[rare] = self.buckets[places(pc.binary_slice(words.take(pa.array(rare)), 0, 2), self.prefixes)]
        return ids, at


def places(words: pa.Array, among: pa.Array) -> np.ndarray:
    """Where each of ``words`` stands ``among`` others (-1: nowhere)."""
    return pc.fill_null(pc.index_in(words, value_set=among), -1).to_numpy()


def vocabulary(counts: DataFrame) -> tuple[Vocabulary, int]:
    """The vocabulary, and the count below which words are not in its head."""
    total, distinct = counts.agg(F.sum("n"), F.count("*")).first()
    steps = counts.select(F.floor(F.log2("n") * 16).alias("step"), "n").groupBy("step").agg(F.count("*").alias("words"), F.min("n").alias("least"))
    cutoff, room = None, HEAD
    for r in sorted(steps.collect(), key=lambda r: -r.step):  # steps of a sixteenth of a power of two: about a thousand at most
        room -= r.words
        if room < 0:
            break
        cutoff = r.least
    cutoff = (total or 0) + 1 if cutoff is None else cutoff  # not even the most frequent step has room: no head but the end
    head = counts.filter((F.col("n") >= cutoff) | (F.length("word") == 0)).toArrow()
    prefix = counts.groupBy(F.substring("word", 1, 2).alias("p")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()
    pairs = list(zip(head["word"].to_pylist(), head["n"].to_pylist(), strict=True))
    return Vocabulary(pairs, {bytes(r.p): (r.n, r.v) for r in prefix}, total or 0, distinct or 0), cutoff


def of_part(part: Part, v: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Outputs and places in the head of all tokens of a part, and where its documents end."""
    outputs, at = v.numbers(part.words)
    return outputs[part.tokens], at[part.tokens], np.cumsum(part.sizes)


def trained(of_parts: DataFrame, known, unigram: np.ndarray) -> dict[str, np.ndarray]:
    """Parameters after ``ROUNDS`` rounds over all training documents, each seen once.

    In a round every task goes through its documents of that round from the same parameters; the results are averaged,
    weighted by tokens, in a grouped aggregate, and only the average comes to the driver.
    """
    spark = of_parts.sparkSession
    params = gru.initial(unigram)
    for turn in range(ROUNDS):
        start = spark.sparkContext.broadcast(params)

        def run(batches: Iterator[pa.RecordBatch], turn=turn, start=start) -> Iterator[pa.RecordBatch]:
            learner, v = gru.Learner(start.value), known.value
            many: list[np.ndarray] = []
            for batch in batches:
                for part in Part.each(batch):
                    outputs, _, ends = of_part(part, v)
                    own = [x for x, t in zip(np.split(outputs, ends[:-1]), part.turns.tolist(), strict=True) if t == turn]
                    many += [x[k : k + SEGMENT] for x in own for k in range(0, len(x), SEGMENT)]
                    if sum(map(len, many)) > 1 << 21:
                        learner.learn(many)
                        many = []
            learner.learn(many)
            if learner.tokens:
                values = gru.flat(learner.p) * np.float32(learner.tokens)
                yield rows_of(["at", "value", "tokens"], [np.arange(len(values), dtype=np.int32), values, np.full(len(values), learner.tokens)], [pa.int32(), pa.float32(), pa.int64()])

        own = of_parts.select("turns", "sizes", "tokens", "words")
        rows = own.mapInArrow(lean(run), "at int, value float, tokens long").groupBy("at").agg((F.sum("value") / F.sum("tokens")).alias("value")).toArrow()
        start.destroy()
        if rows.num_rows:
            values = np.empty(rows.num_rows)
            values[rows["at"].to_numpy()] = rows["value"].to_numpy()
            params = gru.shaped(values, params)
    return params


def scored(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score`` of every document.

    A null text is empty: its end is its one token. Repeated rows are each scored; an empty table gives no rows. Without
    training documents all words are unknown.
    """
    spark = docs.sparkSession
    every = written(parts(docs), GROUP)
    counts = written(word_counts(every))
    words, cutoff = vocabulary(counts)
    total = words.total
    known = spark.sparkContext.broadcast(words)
    model = spark.sparkContext.broadcast(trained(every, known, words.unigram))
    names = ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "word", "times"]
    types = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = known.value
        room = float(np.log10(v.total + v.distinct + 1))

        def out(held: list[Part]) -> Iterator[pa.RecordBatch]:
            """Parts whose texts go through the network together: the longest of them holds up the others less."""
            read = [of_part(part, v) for part in held]
            scores = np.split(gru.score(model.value, [x for outputs, _, ends in read for x in np.split(outputs, ends[:-1])]), np.cumsum([len(p.sizes) for p in held])[:-1])
            for part, (outputs, at, ends), score in zip(held, read, scores, strict=True):
                begins = ends - part.sizes
                value = v.log[at]
                tail = outputs - v.first_bucket
                inside = np.where(tail >= 0, value + v.within[np.maximum(tail, 0)], 0.0)
                rare = np.nonzero(at < 0)[0]
                keys, times = np.unique((np.searchsorted(ends, rare, side="right") << 32) + part.tokens[rare], return_counts=True)
                cuts = pa.array(np.searchsorted(keys >> 32, np.arange(len(ends) + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(cuts, x) for x in (part.words.take(pa.array(keys & 0xFFFFFFFF)), pa.array(times, pa.int32()))]
                base = np.add.reduceat(value, begins) - room * part.sizes
                known_ = np.add.reduceat((at >= 0).astype(np.int64), begins)
                yield rows_of(names, [part.rows, part.doc_ids, part.turns < 0, part.sizes, known_, base, score + np.add.reduceat(inside, begins), *lists], types)

        held: list[Part] = []
        for batch in batches:
            for part in Part.each(batch):
                held.append(part)
                if sum(len(p.tokens) for p in held) > 1 << 21:
                    yield from out(held)
                    held = []
        if held:
            yield from out(held)

    schema = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, word array<binary>, times array<int>"
    first = written(every.drop("counts").mapInArrow(lean(run), schema))
    known.destroy()
    model.destroy()
    remove(every)
    rare = first.select("row", F.explode(F.arrays_zip("word", "times")).alias("x")).select("row", "x.word", "x.times")
    # a word of this join is rarer than the cut, so no key is hot; a word never trained on adds log10 of 1, nothing
    met = rare.join(counts.filter(F.col("n") < cutoff), "word")
    more = met.groupBy("row").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("gain"))
    gain = F.coalesce("gain", F.lit(0.0))
    return first.drop("word", "times").join(more, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + gain).alias("base_score"),
        (F.col("score") + gain).alias("score"),
    )


def op1_lm(spark, sf_dir: str) -> DataFrame:
    return scored(documents(spark, sf_dir))
