"""Exact repeats of ``LENGTH`` bytes and more, found by sorting suffixes at anchors.

Sorting every suffix of the corpus would move it many times over. Instead each window of ``LENGTH`` bytes has an anchor
that depends on its bytes alone (its least hashed ``GRAM``-byte string, the leftmost of equals), so equal windows have
equal anchors at equal places. Anchors are grouped by their string; equal surroundings are settled at once; the suffixes
of the other groups are ordered deep-shallow: multikey quicksort to a shallow depth, blind tries below it. Groups too
large for one task compare whole windows by 128-bit hash in a combined aggregate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, column, lean, rows_of, text_bytes, texts, written

LENGTH, GRAM = 100, 32
REACH = LENGTH - GRAM  # an anchor lies at most so far behind the start of its window
#: Depth that multikey quicksort sorts to; group size up to which one task compares all; copies in a batch that make a string frequent.
SHALLOW, SMALL, FREQUENT = 24, 32, 8
CHUNK = 1 << 18


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hash of the ``GRAM`` bytes from each place."""
    n = len(data) - GRAM + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    eight = np.empty(len(data) + 8, np.uint64)
    for o in range(8):
        part = padded[o : o + (len(padded) - o) // 8 * 8].view("<u8")
        to = eight[o::8]
        to[: len(part)] = part[: len(to)]
    x = eight[:n] * np.uint64(0x9E3779B97F4A7C15)
    for at, m in ((8, 0xC2B2AE3D27D4EB4F), (16, 0x165667B19E3779F9), (24, 0xD6E8FEB86659FD93)):
        x ^= x >> np.uint64(31)
        x += eight[at : at + n] * np.uint64(m)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def anchors(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of the anchors of a text, their hashes, and the first and last start of the windows they anchor."""
    n = len(text) - LENGTH + 1
    if n <= 0:
        return tuple(np.empty(0, t) for t in (np.int64, np.uint64, np.int64, np.int64))
    data = np.frombuffer(text, np.uint8)
    places, low, width = [], [], REACH + 1
    for begin in range(0, n, CHUNK):  # long texts in slices: memory stays bounded
        end = min(begin + CHUNK, n)
        h = gram_hashes(data[begin : end + LENGTH - 1])
        m = (h & ~np.uint64((1 << 19) - 1)) | np.arange(len(h), dtype=np.uint64)  # the least hash, then the leftmost
        size = 1
        while size * 2 <= width:
            m = np.minimum(m[:-size], m[size:])
            size *= 2
        m = np.minimum(m[: end - begin], m[width - size :][: end - begin])
        places.append((m & np.uint64((1 << 19) - 1)).astype(np.int64) + begin)
    at = np.concatenate(places)
    first = np.concatenate([[0], np.nonzero(np.diff(at))[0] + 1])
    last = np.concatenate([first[1:] - 1, [n - 1]])
    at = at[first]
    hashes = np.empty(len(at), np.uint64)
    for begin in range(0, len(at), CHUNK):  # of the anchors alone
        part = at[begin : begin + CHUNK]
        rows = np.lib.stride_tricks.sliding_window_view(data, GRAM)[part].copy().view("<u8").reshape(-1, GRAM // 8)
        hashes[begin : begin + CHUNK] = _mix(rows)
    return at, hashes, first, last


def _mix(rows: np.ndarray) -> np.ndarray:
    x = rows[:, 0] * np.uint64(0xFF51AFD7ED558CCD)
    for k in range(1, rows.shape[1]):
        x ^= x >> np.uint64(32)
        x = (x + rows[:, k]) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(29))


# --- deep-shallow sorting -------------------------------------------------------------------------------------------


def common(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


class BlindTrie:
    """A trie that keeps branching depths and single bytes; strings are compared in full once for each insertion."""

    def __init__(self, strings: list[bytes]):
        self.strings, self.root = strings, None

    def insert(self, i: int) -> None:
        s = self.strings[i]
        if self.root is None:
            self.root = [i]
            return
        node = self.root  # blind descent: skip whatever is not a branching byte
        while len(node) == 2 and isinstance(node[1], dict):
            node = node[1].get(s[node[0]] if node[0] < len(s) else -1) or next(iter(node[1].values()))
        depth = common(s, self.strings[node[0]])
        if depth == len(s) == len(self.strings[node[0]]):
            node.append(i)
            return
        parent, key, node = None, None, self.root
        while len(node) == 2 and isinstance(node[1], dict) and node[0] < depth:
            parent, key = node, s[node[0]] if node[0] < len(s) else -1
            node = node[1][key]
        own = s[depth] if depth < len(s) else -1
        if len(node) == 2 and isinstance(node[1], dict) and node[0] == depth:
            node[1][own] = [i]
            return
        some = node
        while len(some) == 2 and isinstance(some[1], dict):
            some = next(iter(some[1].values()))
        other = self.strings[some[0]]
        branch = [depth, {own: [i], other[depth] if depth < len(other) else -1: node}]
        if parent is None:
            self.root = branch
        else:
            parent[1][key] = branch

    def order(self) -> list[int]:
        out, stack = [], [self.root] if self.root else []
        while stack:
            node = stack.pop()
            if len(node) == 2 and isinstance(node[1], dict):
                stack += [node[1][k] for k in sorted(node[1], reverse=True)]
            else:
                out += node
        return out


def deep_shallow(strings: list[bytes]) -> list[int]:
    """Indices of ``strings`` in order: multikey quicksort to ``SHALLOW`` bytes, then a blind trie for each group still equal."""
    out: list[int] = []
    stack: list[tuple[list[int], int]] = [(list(range(len(strings))), 0)]
    while stack:
        some, depth = stack.pop()
        if len(some) < 2:
            out += some
            continue
        if depth >= SHALLOW:
            trie = BlindTrie(strings)
            for i in some:
                trie.insert(i)
            out += trie.order()
            continue
        key = [strings[i][depth] if depth < len(strings[i]) else -1 for i in some]
        pivot = sorted(key)[len(key) // 2]
        less = [i for i, k in zip(some, key, strict=True) if k < pivot]
        same = [i for i, k in zip(some, key, strict=True) if k == pivot]
        more = [i for i, k in zip(some, key, strict=True) if k > pivot]
        stack.append((more, depth))
        if pivot == -1:
            stack.append((same, SHALLOW))
        else:
            stack.append((same, depth + 1))
        stack.append((less, depth))
    return out


def settle(group: list[tuple[int, int, int, int, bytes, bytes]]) -> list[tuple[int, int, int]]:
    """(ord, first, last start) of windows that an earlier member of the group has too.

    A member is (ord, place, first, last start, bytes from the anchor on, bytes before it turned round). Members share the
    anchor's string, so the suffixes behind it are sorted. Two members share the least of the common prefixes of the
    neighbours from one to the other; as that only falls, a member looks no further than its own windows reach.
    """
    behind = [x[4][GRAM:] for x in group]
    order = deep_shallow(behind)
    prefix = [common(behind[a], behind[b]) for a, b in zip(order, order[1:], strict=False)]
    out = []
    for k, i in enumerate(order):
        right = len(group[i][4])
        for n, m in enumerate(order[k + 1 :], k):
            right = min(right, GRAM + prefix[n])
            if right + len(group[i][5]) < LENGTH:
                break
            a, b = sorted((group[i], group[m]), key=lambda x: x[:2])
            first, last = max(b[2], b[1] - common(a[5], b[5])), min(b[3], b[1] + right - LENGTH)  # starts that both sides cover
            if first <= last:
                out.append((b[0], first, last))
    return out


# --- the distributed job --------------------------------------------------------------------------------------------


def ordered(docs: DataFrame) -> DataFrame:
    """``ord``, ``doc_id``, ``text`` (null: empty), where ``ord`` tells documents apart and orders them.

    It is the id itself where ids are distinct and none is null. Otherwise rows are numbered by id (nulls last), then text.
    """
    own = texts(docs)
    n, ids, distinct = own.agg(F.count("*"), F.count("doc_id"), F.countDistinct("doc_id")).first()
    if n == ids == distinct:
        return own.select(F.col("doc_id").alias("ord"), "doc_id", "text")
    held = written(own.withColumn("row", F.monotonically_increasing_id()))
    keys = held.select("row", "doc_id", F.sha2("text", 256).alias("h")).orderBy(F.col("doc_id").asc_nulls_last(), "h", "row").select("row")
    numbers = keys.rdd.zipWithIndex().map(lambda x: (x[0][0], x[1])).toDF("row long, ord long")
    return held.join(numbers, "row").select("ord", "doc_id", "text")


def candidates(docs: DataFrame) -> DataFrame:
    """Anchors: ``key``, ``around`` (hash of all its windows' bytes), ``ord``, ``idx`` (its number in the text), ``kind``.

    Kind 0 are anchors to group; kind 1 only say that their key is frequent; kind 2 are known repeats: what a batch holds of
    more than ``FREQUENT`` copies is combined to its first. A key with many surroundings in a batch is spread over them.
    """
    names = ["key", "around", "ord", "idx", "kind"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int8()]

    def one(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        parts = []
        digest = xxhash.xxh3_64_intdigest
        for o, text in zip(column(batch, "ord").to_pylist(), text_bytes(batch), strict=True):
            _, h, first, last = anchors(text)
            if len(h):
                around = np.array([digest(text[a : b + LENGTH]) for a, b in zip(first.tolist(), last.tolist(), strict=True)], np.uint64)
                parts.append((h, around, np.full(len(h), o, np.int64), np.arange(len(h), dtype=np.int32)))
        if not parts:
            return None
        key, around, o, idx = (np.concatenate(x) for x in zip(*parts, strict=True))
        kind = np.zeros(len(key), np.int8)
        order = np.lexsort((idx, o, around, key))
        k, a = key[order], around[order]
        new = np.concatenate([[True], (k[1:] != k[:-1]) | (a[1:] != a[:-1])])
        group = np.cumsum(new) - 1
        many = np.bincount(group)[group] > FREQUENT
        known = order[many & ~new]
        kind[known] = 2
        new_key = np.concatenate([[True], k[1:] != k[:-1]])
        key_group = np.cumsum(new_key) - 1
        spread = np.bincount(key_group, new)[key_group] > FREQUENT
        marks = np.unique(k[spread])
        key = key.copy()
        hot = order[spread]
        key[hot] = _mix(np.stack([key[hot], around[hot]], 1)) | np.uint64(1)  # spread: odd keys, the others are even
        even = np.ones(len(key), bool)
        even[hot] = False
        key[even] &= ~np.uint64(1)
        key[known] = _mix(np.stack([o[known].view(np.uint64), idx[known].astype(np.uint64)], 1))
        key, around = np.concatenate([key, marks & ~np.uint64(1)]), np.concatenate([around, marks])
        o, idx, kind = np.concatenate([o, np.full(len(marks), -1)]), np.concatenate([idx, np.zeros(len(marks), np.int32)]), np.concatenate([kind, np.ones(len(marks), np.int8)])
        return rows_of(names, [key.view(np.int64), around.view(np.int64), o, idx, kind], types)

    return arrow_map(docs.select("ord", "text"), "key long, around long, ord long, idx int, kind byte", one, rows=0)


def routed(found: DataFrame) -> DataFrame:
    """``ord``, ``idx``, ``key``, ``route``: 0 repeats whole, 1 to compare in a small group, 2 in a large one; single anchors go."""
    same = Window.partitionBy("key", "around").orderBy("ord", "idx")
    ranked = found.withColumn("nth", F.when(F.col("kind") == 2, 2).otherwise(F.row_number().over(same)))
    ranked = ranked.withColumn("n", F.sum(F.when(F.col("kind") == 1, 1000).when(F.col("nth") == 1, 1).otherwise(0)).over(Window.partitionBy("key")))
    odd = F.col("key").bitwiseAND(F.lit(1)) == 1
    route = F.when(F.col("nth") > 1, 0).when(odd | (F.col("n") > SMALL), 2).when(F.col("n") > 1, 1)
    return ranked.filter("kind <> 1").select("ord", "idx", "key", route.alias("route")).filter("route is not null")


def squeezed(docs: DataFrame) -> DataFrame:
    """Texts compressed one by one, for the way through a shuffle."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        press = zstandard.ZstdCompressor(level=3, write_checksum=False)
        return rows_of(["ord", "doc_id", "zip"], [column(batch, "ord"), column(batch, "doc_id"), [press.compress(t) for t in text_bytes(batch)]], [pa.int64(), pa.int64(), pa.binary()])

    return arrow_map(docs, "ord long, doc_id long, zip binary", one)


def surroundings(docs: DataFrame, open_: DataFrame) -> DataFrame:
    """For each anchor still open the bytes around it: ``key``, ``route``, ``ord``, ``at``, ``first``, ``last``, ``bytes`` (its windows)."""
    names = ["key", "route", "ord", "at", "first", "last", "bytes"]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    asked = open_.groupBy("ord").agg(F.collect_list(F.struct("idx", "key", "route")).alias("asked"))

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list] = [[] for _ in names]
        expand = zstandard.ZstdDecompressor()
        for o, packed, asked in zip(column(batch, "ord").to_pylist(), column(batch, "zip").to_pylist(), column(batch, "asked").to_pylist(), strict=True):
            text = expand.decompress(packed)
            at, _, first, last = (x.tolist() for x in anchors(text))
            for x in asked:
                i = x["idx"]
                for to, v in zip(out, (x["key"], x["route"], o, at[i], first[i], last[i], text[first[i] : last[i] + LENGTH]), strict=True):
                    to.append(v)
        return rows_of(names, out, types)

    return arrow_map(squeezed(docs).drop("doc_id").join(asked, "ord"), "key long, route int, ord long, at long, first long, last long, bytes binary", one)


def small_repeats(around: DataFrame) -> DataFrame:
    """``ord``, ``first``, ``last``: starts of repeated windows of the small groups, each group within one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        key = None
        for batch in batches:
            out: list[tuple] = []
            for k, o, at, first, last, around in zip(*(column(batch, c).to_pylist() for c in ("key", "ord", "at", "first", "last", "bytes")), strict=True):
                if k != key:
                    out += settle(group) if len(group) > 1 else []
                    group, key = [], k
                group.append((o, at, first, last, around[at - first :], around[: at - first][::-1]))
            if out:
                yield rows_of(["ord", "first", "last"], list(map(list, zip(*out, strict=True))), [pa.int64()] * 3)
        if len(group) > 1 and (out := settle(group)):
            yield rows_of(["ord", "first", "last"], list(map(list, zip(*out, strict=True))), [pa.int64()] * 3)

    own = around.filter("route = 1").drop("route")
    return own.repartition("key").sortWithinPartitions("key", "ord", "at").mapInArrow(lean(run), "ord long, first long, last long")


def first_windows(around: DataFrame) -> DataFrame:
    """``ord``, ``first``: starts of the windows of the large groups that stand nowhere earlier; all others there repeat.

    Each window is a row of two hashes; the least place of each is a combined aggregate, so no string is hot.
    """
    names, types = ["a", "b", "ord", "first"], [pa.int64()] * 4

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        least: dict[bytes, tuple[int, int]] = {}
        for o, first, last, around in zip(*(column(batch, c).to_pylist() for c in ("ord", "first", "last", "bytes")), strict=True):
            for i in range(last - first + 1):
                h = xxhash.xxh3_128_digest(around[i : i + LENGTH])
                x = (o, first + i)
                if (old := least.get(h)) is None or x < old:
                    least[h] = x
        if not least:
            return None
        hashes = np.frombuffer(b"".join(least), np.int64).reshape(-1, 2)
        places = np.array(list(least.values()), np.int64).reshape(-1, 2)
        return rows_of(names, [hashes[:, 0], hashes[:, 1], places[:, 0], places[:, 1]], types)

    rows = arrow_map(around.filter("route = 2"), "a long, b long, ord long, first long", one, rows=0)
    return rows.groupBy("a", "b").agg(F.min(F.struct("ord", "first")).alias("x")).select("x.ord", "x.first")


def deduplicated(docs: DataFrame) -> DataFrame:
    """Each document without the bytes that a repeated window covers: ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept``.

    ``kept`` are the bytes that are left, in order. Texts of fewer than ``LENGTH`` bytes stay whole; null texts are empty;
    rows with equal ids are ordered by text; an empty table gives no rows.
    """
    named = ordered(docs)
    routes = written(routed(candidates(named)))
    around = written(surroundings(named, routes.filter("route > 0")))
    whole = routes.filter("route <> 1").select("ord", F.when(F.col("route") == 0, 0).otherwise(1).alias("kind"), F.col("idx").cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    small = small_repeats(around).select("ord", F.lit(2).alias("kind"), F.col("first").alias("a"), F.col("last").alias("b"))
    firsts = first_windows(around).select("ord", F.lit(3).alias("kind"), F.col("first").alias("a"), F.lit(0).cast("long").alias("b"))
    marks = whole.unionByName(small).unionByName(firsts).groupBy("ord").agg(F.collect_list(F.struct("kind", "a", "b")).alias("marks"))
    names, types = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"], [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list] = [[] for _ in names]
        expand = zstandard.ZstdDecompressor()
        listed = column(batch, "marks")
        offsets = listed.offsets.to_numpy()
        inner = listed.values.slice(offsets[0], offsets[-1] - offsets[0])
        offsets = offsets - offsets[0]
        fields = [inner.field(i).to_numpy(zero_copy_only=False) for i in range(3)] if len(inner) else [np.empty(0, np.int64)] * 3
        for i, (doc_id, packed) in enumerate(zip(column(batch, "doc_id").to_pylist(), column(batch, "zip").to_pylist(), strict=True)):
            text = expand.decompress(packed)
            part = [f[offsets[i] : offsets[i + 1]] for f in fields]
            for to, v in zip(out, (doc_id, *removed(text, *part)), strict=True):
                to.append(v)
        return rows_of(names, out, types)

    joined = squeezed(named).join(marks, "ord", "left")
    return arrow_map(joined, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary", one)


def removed(text: bytes, kind: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[int, int, int, bytes]:
    """Bytes, bytes removed, runs removed and what is left, from a text's marks."""
    n = len(text)
    if not len(kind):
        return n, 0, 0, text
    _, _, first, last = anchors(text)
    starts = np.zeros(n + 1, bool)  # starts of repeated windows
    for k in (1, 0):
        for i in a[kind == k].tolist():
            starts[first[i] : last[i] + 1] = True
        if k:  # large groups: all their windows but those that come first
            starts[a[kind == 3]] = False
    for x, y in zip(a[kind == 2].tolist(), b[kind == 2].tolist(), strict=True):
        starts[x : y + 1] = True
    at = np.nonzero(starts)[0]
    edge = np.zeros(n + LENGTH + 1, np.int32)
    edge[at] += 1
    edge[at + LENGTH] -= 1
    covered = np.cumsum(edge)[:n] > 0
    runs = int(np.count_nonzero(np.diff(np.concatenate([[0], covered.astype(np.int8)])) == 1))
    return n, int(covered.sum()), runs, np.frombuffer(text, np.uint8)[~covered].tobytes()


def op5_repeats(docs: DataFrame) -> DataFrame:
    """Digest per document: bytes, bytes removed, runs removed, hash of what is left."""
    return deduplicated(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))

