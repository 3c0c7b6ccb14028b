"""Benchmark decontamination by the q-gram lemma.

A passage within k edits of a window of m bytes shares at least m - q + 1 - k*q of its q-grams, and their diagonals
differ by at most k. The q-grams that a text shares with an item are counted in overlapping bands of diagonals; where as
many as the bound stand within a window's length, the windows of the item that may lie there are verified by banded
alignment. Windows begin at every byte of an item, so an excerpt of ``WINDOW`` bytes is met wherever it begins.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, lean, rows_of, small_batches, text_bytes, texts

#: Bytes of a q-gram and of a window (a shorter item is one window), and edits allowed per byte.
Q, WINDOW, EDITS = 12, 64, 0.05
#: Benchmark texts that normalise to fewer bytes are met exactly, as whole words.
SHORT = 24
#: Bytes of benchmark text that one pass holds (its index takes sixteen times as many); a larger benchmark is searched in several passes.
BLOCK = 8 << 20
#: Bytes of text that are looked at together, and shared q-grams.
CHUNK, HITS = 1 << 20, 2 << 20
#: Windows of an item that are aligned together.
STARTS = 16
TABLE_BITS = 20

#: Letters, digits and bytes beyond ASCII stay, A-Z become a-z, everything else is a space.
PLAIN = bytes(x + 32 if 65 <= x <= 90 else x if 48 <= x <= 57 or 97 <= x <= 122 or x >= 128 else 32 for x in range(256))


def normalised(text: bytes) -> bytes:
    if not text.isascii():
        text = text.decode("utf-8", "replace").lower().encode()
    return b" ".join(text.translate(PLAIN).split())


def grams(data: bytes) -> np.ndarray:
    """A 64-bit hash of the Q bytes at each place."""
    n = len(data) - Q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    padded = data + bytes(16)
    eight = np.empty(n + 16, np.uint64)
    for o in range(8):
        part = np.frombuffer(padded, "<u8", (len(padded) - o) // 8, o)
        eight[o::8][: len(part)] = part[: len(eight[o::8])]
    x = eight[:n] * np.uint64(0x9E3779B97F4A7C15)
    x ^= eight[Q - 8 : n + Q - 8] * np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x


def distances(patterns: np.ndarray, text: bytes, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(edits, end) of the best alignment of each row of ``patterns`` within ``text``; edits beyond ``most`` are only known to be beyond.

    The band is the text itself: callers pass the few diagonals that reached the bound.
    """
    data, steps = np.frombuffer(text, np.uint8), np.arange(len(text) + 1, dtype=np.int32)
    row = np.zeros((len(patterns), len(text) + 1), np.int32)  # a match may begin anywhere
    for c in patterns.T:
        new = row + 1
        np.minimum(new[:, 1:], row[:, :-1] + (data != c[:, None]), out=new[:, 1:])
        new -= steps
        np.minimum.accumulate(new, axis=1, out=new)  # insertions
        row = new + steps
        if row.min() > most:
            return np.full(len(patterns), most + 1), np.zeros(len(patterns), np.int64)
    end = row.argmin(1)
    return row[np.arange(len(end)), end], end


def began(pattern: bytes, text: bytes, edits: int) -> int:
    """Where an alignment of ``pattern`` with ``edits`` edits that ends with ``text`` begins; of several, the shortest."""
    if not edits:
        return len(text) - len(pattern)
    data = np.frombuffer(text, np.uint8)[::-1][: len(pattern) + edits]
    steps = np.arange(len(data) + 1)
    row = steps
    for c in reversed(pattern):
        new = row + 1
        new[1:] = np.minimum(new[1:], row[:-1] + (data != c))
        row = np.minimum.accumulate(new - steps) + steps
    return len(text) - int((row == edits).argmax())


class Index:
    """Benchmark texts and where each of their q-grams stands."""

    def __init__(self, items: list[tuple[int, bytes]]):
        self.items = [x for x in items if len(x[1]) >= SHORT]
        self.short = sorted({x for x in items if 0 < len(x[1]) < SHORT})
        found = [grams(t) for _, t in self.items]
        sizes = np.array([len(x) for x in found], np.int64)
        every = np.concatenate(found) if found else np.empty(0, np.uint64)
        order = np.argsort(every, kind="stable")
        self.gram = every[order]
        self.item = np.repeat(np.arange(len(found), dtype=np.int32), sizes)[order]
        self.offset = (np.arange(len(every)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)[order]
        self.size = np.minimum([len(t) for _, t in self.items], WINDOW).astype(np.int64)
        self.edits = (self.size * EDITS).astype(np.int64)
        self.bound = np.maximum(1, self.size - Q + 1 - self.edits * Q)
        self.longest = max((len(t) for _, t in self.items), default=0)
        self.seen = np.zeros(1 << TABLE_BITS, bool)
        self.seen[self.gram >> np.uint64(64 - TABLE_BITS)] = True

    def shared(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of ``data`` whose q-gram some item has, and from where to where it stands in the table."""
        g = grams(data)
        if not len(g) or not len(self.gram):
            return (np.empty(0, np.int64),) * 3
        maybe = np.nonzero(self.seen[g >> np.uint64(64 - TABLE_BITS)])[0]
        low, high = (np.searchsorted(self.gram, g[maybe], side) for side in ("left", "right"))
        hit = high > low
        return maybe[hit], low[hit], high[hit]

    def regions(self, place: np.ndarray, low: np.ndarray, high: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(item, least diagonal, first and last place) where a band of diagonals reaches the bound within a window's length."""
        times = high - low
        each = np.repeat(low - np.cumsum(times) + times, times) + np.arange(times.sum())
        item, place = self.item[each].astype(np.int64), np.repeat(place, times)
        diagonal = place - self.offset[each] + self.longest
        width = self.edits[item] + 1  # bands are two widths wide and overlap by one
        band, many = diagonal // width, int(diagonal.max(initial=0)) + 2
        key = np.concatenate([item * many + band, item * many + band + 1])
        place = np.concatenate([place, place])
        order = np.lexsort((place, key))
        key, place = key[order], place[order]
        item = key // many
        last = np.arange(len(key)) + self.bound[item] - 1
        ok = last < len(key)
        last[~ok] = 0
        ok &= (key[last] == key) & (place[last] - place <= self.size[item] + self.edits[item] - Q)
        first, last = np.nonzero(ok)[0], last[ok]
        if not len(first):
            return []
        new = np.concatenate([[True], (key[first[1:]] != key[first[:-1]]) | (place[first[1:]] > place[last[:-1]])])
        begin = np.nonzero(new)[0]
        end = np.concatenate([begin[1:], [len(first)]]) - 1
        at = first[begin]
        base = (key[at] % many - 1) * (self.edits[item[at]] + 1) - self.longest
        return list(zip(item[at].tolist(), base.tolist(), place[at].tolist(), place[last[end]].tolist(), strict=True))

    def windows(self, item: int, base: int, first: int, last: int, data: bytes, low: int, high: int) -> tuple[int, int, int] | None:
        """(begin, end, edits) of what ``data`` between ``low`` and ``high`` has of an item in a region of :meth:`regions`.

        The first and the last window of the item that is there tell where; windows are tried from both sides inwards.
        """
        text, w, k = self.items[item][1], int(self.size[item]), int(self.edits[item])
        top = base + 2 * (k + 1) - 1
        starts = range(max(0, first - top - k * Q), min(len(text) - w, last - base) + 1)
        every = np.lib.stride_tricks.sliding_window_view(np.frombuffer(text, np.uint8), w)

        def met(some: range) -> list[tuple[int, int, int]]:
            lo, hi = max(low, some[0] + base - k), min(high, some[-1] + top + w + k)
            if hi - lo < w - k:
                return []
            edits, ends = distances(every[some[0] : some[-1] + 1], data[lo:hi], k)
            return [(s, int(e), lo + int(end)) for s, e, end in zip(some, edits, ends, strict=True) if e <= k]

        blocks = [starts[i : i + STARTS] for i in range(0, len(starts), STARTS)]
        ahead = next((x for b in blocks if (x := met(b))), None)
        if ahead is None:
            return None
        s, edits, end = ahead[0]
        at = max(low, end - w - edits)
        begin = at + began(text[s : s + w], data[at:end], edits)
        behind = next(x for b in reversed(blocks) if (x := met(b)))[-1]
        return begin, behind[2], min(x[1] for x in (*ahead, behind))

    def search(self, data: bytes, starts: list[int] | None = None, ends: list[int] | None = None) -> list[tuple[int, int, int, int]]:
        """(item, begin, end, edits) of the passages of ``data`` that hold a window of an item within its edits.

        ``starts`` and ``ends`` bound the texts that ``data`` is made of: no passage leaves its text.
        """
        starts, ends = starts or [0], ends or [len(data)]
        place, low, high = self.shared(data)
        out: list[tuple[int, int, int, int]] = []
        at, sums, known = 0, np.cumsum(high - low), {}
        while at < len(place):  # q-grams that many items share: fewer places at a time, which overlap by more than a window
            to = max(at + 1, int(np.searchsorted(sums, (sums[at - 1] if at else 0) + HITS, side="right")))
            upto = to if to == len(place) else int(np.searchsorted(place, place[to] + 2 * WINDOW))
            for item, base, first, last in self.regions(place[at:upto], low[at:upto], high[at:upto]):
                if any(a <= first and last + Q <= b for a, b in known.get(item, ())):  # the band beside it had it
                    continue
                of = int(np.searchsorted(starts, first, side="right")) - 1
                if (found := self.windows(item, base, first, last, data, starts[of], ends[of])) is not None:
                    known.setdefault(item, []).append(found[:2])
                    out.append((item, *found))
            at = to
        return [(self.items[i][0], *x) for i, *x in out]


def scan(index: Index, many: list[bytes]) -> list[dict[int, tuple[int, int, int, int]]]:
    """For each text, (first word, last word, edits, hits) of each item found in it, over the normalised text."""
    found: list[dict[int, list[tuple[int, int, int]]]] = [{} for _ in many]
    plain = [normalised(t) for t in many]

    def note(doc: int, item: int, a: int, b: int, edits: int) -> None:
        found[doc].setdefault(item, []).append((a, b, edits))

    def told(doc: int, passages: list[tuple[int, int, int]]) -> tuple[int, int, int, int]:
        hits, end = 0, -1
        for a, b, _ in sorted(passages):  # those that overlap are one
            hits, end = hits + (a >= end), max(end, b)
        first, last = (plain[doc].count(b" ", 0, x) for x in (min(passages)[0], end - 1))
        return first, last, min(x[2] for x in passages), hits

    def look(parts: list[tuple[int, int]], data: bytes, starts: list[int], ends: list[int]) -> None:
        for item, a, b, edits in index.search(data, starts, ends):
            at = int(np.searchsorted(starts, b - 1, side="right")) - 1
            doc, shift = parts[at]
            note(doc, item, a - starts[at] + shift, b - starts[at] + shift, edits)

    parts, starts, ends, data = [], [], [], bytearray()
    for doc, text in enumerate(plain):
        for shift in range(0, max(1, len(text)), CHUNK):  # long texts in slices that overlap by more than a match
            part = text[shift : shift + CHUNK + 4 * WINDOW]
            parts.append((doc, shift))
            starts.append(len(data))
            ends.append(len(data) + len(part))
            data += part + bytes(Q)
            if len(data) >= CHUNK:
                look(parts, bytes(data), starts, ends)
                parts, starts, ends, data = [], [], [], bytearray()
    if data:
        look(parts, bytes(data), starts, ends)
    if index.short:
        words = ahocorasick.Automaton()
        of: dict[bytes, list[int]] = {}
        for item, text in index.short:
            of.setdefault(text, []).append(item)
        for text in of:
            words.add_word(f" {text.decode('latin-1')} ", text)
        words.make_automaton()
        for doc, text in enumerate(plain):
            for end, short in words.iter(f" {text.decode('latin-1')} "):
                for item in of[short]:
                    note(doc, item, end - 1 - len(short), end - 1, 0)
    return [{item: told(doc, passages) for item, passages in of.items()} for doc, of in enumerate(found)]


def blocks(benchmark: DataFrame) -> list:
    """Broadcast indexes over the benchmark, each of ``BLOCK`` bytes or so; null texts and texts without letters or digits aren't in them.

    One block after another passes through the driver, which holds one at a time.
    """
    spark = benchmark.sparkSession
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = total // BLOCK + 1
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    out, held = [], []

    def close() -> None:
        out.append(spark.sparkContext.broadcast(Index([(i, t) for i, t in held if t])))
        held.clear()

    last = 0
    for r in (rows.withColumn("block", block).orderBy("block") if n > 1 else rows.withColumn("block", F.lit(0))).toLocalIterator():
        if r.block != last:
            close()
            last = r.block
        held.append((r.item_id, normalised(r.text.encode())))
    close()
    return out


def op8_decontamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each text and benchmark item found in it; texts without any have none.

    ``first_word`` and ``last_word`` count words of the normalised text (letters and digits, lower-cased). An item is
    found where ``WINDOW`` bytes of it in a row (all of it, where it has fewer) stand within 5 % edits, and an item under
    ``SHORT`` bytes where it stands as whole words. ``edits`` are the fewest at either end of a passage. A null or
    empty text holds nothing; repeated rows are each reported; an empty benchmark gives no rows.
    """
    names = ["doc_id", "item_id", "first_word", "last_word", "edits", "hits"]
    found = None
    for index in blocks(benchmark):

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [(d, i, *x) for d, of in zip(column(batch, "doc_id").to_pylist(), scan(index.value, text_bytes(batch)), strict=True) for i, x in of.items()]
                if rows:
                    yield rows_of(names, list(map(list, zip(*rows, strict=True))), [pa.int64()] * 6)

        part = texts(docs).mapInArrow(lean(run), ", ".join(f"{n} long" for n in names))
        found = part if found is None else found.unionByName(part)
    return found


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the texts that hold a benchmark passage; all columns and all other rows stay as they are."""
    small_batches(docs.sparkSession)
    for index in blocks(benchmark):

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = [not of for of in scan(index.value, [t or b"" for t in text_bytes(batch)])]
                yield batch.filter(pa.array(keep, pa.bool_()))

        docs = docs.mapInArrow(lean(run), docs.schema)
    return docs
