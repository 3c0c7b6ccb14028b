"""SimHash near-duplicates: exact links by pigeonring keys, components by repeated star contraction.

The 64 bits of a fingerprint form a ring of ``m`` segments. If two fingerprints differ in at most ``tau`` bits, then from
some segment on the differences of the first l segments stay within l*tau/m for every l. A key is made from such a
chain: the segments that the budgets let differ are left out, the others must be equal. So all links meet in a key.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, column, lean, remove, rows_of, text_bytes, texts, written

SEED = 42
#: Groups of distinct fingerprints up to this size compare their members; larger ones are split by further chains.
SMALL = 32
#: Segments that a large group's free bits are cut into.
FURTHER = 6
#: Nodes that a task holds at most while it makes stars of its links.
NODES = 1_000_000


def fingerprint(text: bytes, k: int = 4) -> int:
    """SimHash of all ``k``-word shingles, repeats included; 0 for a text without words."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= k:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip((end - size)[: len(words) - k + 1].tolist(), end[k - 1 :].tolist(), strict=True)], np.uint64)
    return majority(hashes)


def fingerprints(docs: DataFrame, k: int = 4) -> DataFrame:
    """``doc_id`` and ``fp``, the fingerprint as a signed long. A null text is empty and has fingerprint 0."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp = np.array([fingerprint(t, k) for t in text_bytes(batch)], np.uint64).view(np.int64)
        return rows_of(["doc_id", "fp"], [column(batch, "doc_id"), fp], [pa.int64(), pa.int64()])

    return arrow_map(texts(docs), "doc_id long, fp long", one)


def parts(bits: list[int], m: int) -> list[int]:
    """Masks of ``m`` segments of like size that the places ``bits`` are cut into."""
    bounds = [len(bits) * i // m for i in range(m + 1)]
    return [sum(1 << b for b in bits[lo:hi]) for lo, hi in zip(bounds, bounds[1:], strict=False)]


def chain_masks(segment: list[int], tau: int, length: int) -> list[int]:
    """Masks of the segments that must be equal, for every chain of ``length`` segments of the ring and every way to spend its budgets."""
    m = len(segment)
    budget = [(i + 1) * tau // m for i in range(m)]
    free = budget[length - 1]
    masks = []
    for start in range(m):
        ring = [segment[(start + i) % m] for i in range(m)]
        for left_out in combinations(range(length), free):
            if all(sum(i <= at for i in left_out) <= budget[at] for at in range(length)):
                masks.append(sum(ring[i] for i in range(length) if i not in left_out))
    return list(dict.fromkeys(masks))


def chains(tau: int, m: int, length: int) -> list[int]:
    """Key masks of all chains of ``length`` of the ``m`` segments of a fingerprint."""
    return chain_masks(parts(list(range(64)), m), tau, length)


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def shared(keyed: DataFrame) -> DataFrame:
    """``keyed`` (with ``key``) without keys that stand once, and with ``n``, how often each stands; written."""
    return written(keyed.withColumn("n", F.count("*").over(Window.partitionBy("key"))).filter("n > 1"))


def links(fps: DataFrame, tau: int = 4, m: int = 9, length: int = 6) -> DataFrame:
    """Links (``a``, ``b``), a < b, whose components are those of all pairs of distinct ``fp`` within ``tau`` bits.

    Every key sends a fingerprint to one group: two meet in a key just if a chain of segments keeps its budgets. Groups of
    up to ``SMALL`` compare their members in full. In a larger group the bits that its key leaves free form a ring of their
    own, whose chains split it again: a key then fixes twelve bits more, so chance alone fills no group. What is still
    large is a crowd around one value: its fingerprints go to all values within tau/2 bits; two of them share such a
    midpoint just if they are within ``tau``, so a link to the smallest at each midpoint joins the same components without
    forming pairs.
    """
    spark = fps.sparkSession
    masks = chains(tau, m, length)
    further = [[mask | x for x in chain_masks(parts([i for i in range(64) if not mask >> i & 1], FURTHER), tau, FURTHER)] for mask in masks]
    own = spark.createDataFrame([([signed(x) for x in masks],)], "masks array<long>")
    subs = spark.createDataFrame([(i, [signed(x) for x in xs]) for i, xs in enumerate(further)], "chain int, masks array<long>")

    def paired(groups: DataFrame, place: str) -> DataFrame:
        """Links of the groups whose first common mask of ``masks`` is that of the group, so that each is returned once."""
        once = f"array_position(transform(masks, mask -> ((a ^ b) & mask) = 0), true) = {place} + 1"
        pairs = f"flatten(transform(fps, (a, i) -> transform(filter(slice(fps, i + 2, size(fps)), b -> bit_count(a ^ b) <= {tau} and {once}), b -> struct(a, b))))"
        return groups.select(F.explode(F.expr(pairs)).alias("p")).select("p.a", "p.b")

    def listed(rows: DataFrame) -> DataFrame:
        return rows.filter(F.col("n") <= SMALL).groupBy("key").agg(F.min("chain").alias("chain"), F.min("sub").alias("sub"), F.sort_array(F.collect_list("fp")).alias("fps"))

    key = F.expr("posexplode(transform(masks, (mask, i) -> xxhash64(i, fp & mask))) as (chain, key)")
    one = shared(fps.join(F.broadcast(own), F.lit(True)).select("fp", key).withColumn("sub", F.lit(0)))
    found = paired(listed(one).join(F.broadcast(own), F.lit(True)), "chain")
    hot = one.filter(F.col("n") > SMALL)
    if hot.isEmpty():
        return found
    again = hot.join(F.broadcast(subs), "chain").select("fp", "chain", F.col("key").alias("was"), F.posexplode("masks").alias("sub", "mask"))
    two = shared(again.select("fp", "chain", "sub", F.xxhash64("was", "sub", F.col("fp").bitwiseAND(F.col("mask"))).alias("key")))
    found = found.unionByName(paired(listed(two).join(F.broadcast(subs), "chain"), "sub"))
    crowd = two.filter(F.col("n") > SMALL).select("fp").distinct()
    return (found if crowd.isEmpty() else found.unionByName(midpoint_links(crowd, tau))).distinct()


def midpoint_links(fps: DataFrame, tau: int) -> DataFrame:
    flips = F.array(*(F.lit(signed(sum(1 << i for i in bits))) for n in range(tau // 2 + 1) for bits in combinations(range(64), n)))
    at = fps.repartition("fp").select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("mid"))
    least = F.min("fp").over(Window.partitionBy("mid"))  # at most as many rows as there are flips
    return at.select(least.alias("a"), F.col("fp").alias("b")).filter("a < b")


def forest(edges: DataFrame) -> DataFrame:
    """The links (``u``, ``v``) of each task's share as stars: every node with the smallest that the share joins it to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def top(x: int) -> int:
            while (p := parent.setdefault(x, x)) != x:
                parent[x] = x = parent[p]
            return x

        def out() -> Iterator[pa.RecordBatch]:
            pairs = [(x, top(x)) for x in list(parent) if parent[x] != x]
            parent.clear()
            if pairs:
                yield rows_of(["u", "v"], list(map(list, zip(*pairs, strict=True))), [pa.int64()] * 2)

        for batch in batches:
            for a, b in zip(column(batch, "u").to_pylist(), column(batch, "v").to_pylist(), strict=True):
                a, b = top(a), top(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
            if len(parent) > NODES:
                yield from out()
        yield from out()

    return edges.mapInArrow(lean(run), "u long, v long")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``node`` and ``root`` (the smallest node reachable) of the nodes that have links; links are (a, b), a != b.

    Each task first makes stars of its share of the links. Then large-star and small-star by turns until nothing changes;
    each round's links are written to the shared folder, and those of the round before removed.
    """

    def mark(links: DataFrame):
        return links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    now = written(forest(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()))
    last = mark(now)
    for _ in range(rounds):
        was = now
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        now = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = now.groupBy("u").agg(F.min("v").alias("m"))
        joined = now.join(least, "u")
        now = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        now = written(now)
        new = mark(now)
        remove(was)
        if new == last:
            break
        last = new
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(docs: DataFrame, k: int = 4, tau: int = 4) -> DataFrame:
    """``doc_id``, ``fp`` and ``component_id``, the smallest ``doc_id`` reachable over links of at most ``tau`` bits.

    Equal fingerprints are one node, so copies never meet pairwise. Null texts count as empty, empty texts share
    fingerprint 0 and are linked; rows with equal ids are kept; a component whose ids are all null has a null id.
    """
    prints = written(fingerprints(docs, k))
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = components(links(nodes.select("fp"), tau)).withColumnRenamed("node", "fp")
    linked = written(found.join(nodes, "fp"))
    roots = linked.groupBy("root").agg(F.min("least").alias("component"))
    known = linked.join(roots, "root").select("fp", "component")
    named = nodes.join(known, "fp", "left").select("fp", F.coalesce("component", "least").alias("component_id"))
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def op10_simhash(docs: DataFrame) -> DataFrame:
    """Digest per document: fingerprint as 16 hexadecimal digits, and its component."""
    return near_duplicates(docs).select("doc_id", hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


#: Bands of min-hashes and hashes in each: texts alike by 0.8 miss all bands once in ten thousand pairs.
BANDS, ROWS = 24, 5
#: Texts of a crowded band that one task compares with so many others of it.
PIVOTS, PART = 64, 256


class WordHashes(dict):
    """64-bit hashes of words, each found once."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word, SEED)
        return found


def shingle_hashes(text: bytes, k: int, known: WordHashes) -> np.ndarray:
    """Hashes of the ``k``-word shingles, repeats included; fewer words are one shingle, no words none."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    each = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n, span = max(1, len(words) - k + 1), min(k, len(words))
    h = each[:n].copy()
    for j in range(1, span):
        h ^= h >> np.uint64(29)
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += each[j : j + n]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def shingles(text: bytes, k: int, known: WordHashes | None = None) -> np.ndarray:
    """Distinct hashes of the ``k``-word shingles, sorted."""
    return np.unique(shingle_hashes(text, k, WordHashes() if known is None else known))


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # long texts in pieces: memory stays bounded
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """``doc_id``, ``mark`` (hash of the text), ``fp`` (SimHash), ``node`` (hash of the set of shingles) and ``bands``, hashes of groups of min-hashes.

    One pass over the texts; those without words have no bands.
    """
    times = np.random.default_rng(SEED).integers(1, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    names, types = ["doc_id", "mark", "fp", "node", "bands"], [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps, nodes, bands, known = [], [], [], WordHashes()
        for text in text_bytes(batch):
            every = shingle_hashes(text, k, known)
            h = np.unique(every)
            fps.append(majority(every) if len(every) else 0)
            nodes.append(xxhash.xxh3_64_intdigest(h.tobytes()))
            if not len(h):
                bands.append([])
                continue
            least, high = np.full(BANDS * ROWS, np.iinfo(np.uint32).max, np.uint32), (h >> np.uint64(32)).astype(np.uint32)
            for at in range(0, len(high), 2048):
                np.minimum(least, (times[:, None] * high[None, at : at + 2048]).min(1), out=least)
            x = np.zeros(BANDS, np.uint64)
            for column_ in least.astype(np.uint64).reshape(BANDS, ROWS).T:
                x = (x ^ column_) * np.uint64(0x9E3779B97F4A7C15)
                x ^= x >> np.uint64(29)
            bands.append((x + np.arange(BANDS, dtype=np.uint64)).view(np.int64))
        long = lambda xs: np.array(xs, np.uint64).view(np.int64)
        return rows_of(names, [column(batch, "doc_id"), column(batch, "mark"), long(fps), long(nodes), bands], types)

    return arrow_map(texts(docs, mark_of(docs).alias("mark")), "doc_id long, mark long, fp long, node long, bands array<long>", one)


def mark_of(docs: DataFrame) -> Column:
    """Hash of the whole text, which tells rows of one id apart."""
    return F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))


def remaining(every: DataFrame, roots: DataFrame, held: DataFrame, similarity: float) -> DataFrame:
    """Links (``a``, ``b``) among the roots of nodes that share a band of ``every`` and have no common root yet; all such pairs are compared.

    In each band the members outside its largest component go in blocks against all members in parts: a task has at
    most some ``PIVOTS`` and ``PART`` sets, and pairs are formed only within it. Bands in one component drop out.
    """
    at = every.join(roots, "node", "left").select("band", "node", F.coalesce("root", "node").alias("root"))
    sizes = at.groupBy("band", "root").agg(F.count("*").alias("n"))
    bands = sizes.groupBy("band").agg(F.sum("n").alias("n"), F.max(F.struct("n", "root")).alias("top")).filter("n > top.n")
    bands = bands.select("band", F.col("top.root").alias("major"), F.ceil((F.col("n") - F.col("top.n")) / PIVOTS).alias("blocks"), F.ceil(F.col("n") / PART).alias("parts"))
    within = at.join(bands, "band").withColumn("minor", F.col("root") != F.col("major")).withColumn("deal", F.xxhash64("node", "band"))
    own = {n: F.pmod("deal", F.col(n)) for n in ("blocks", "parts")}
    each = {n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1)) for n in own}
    pivots = within.filter("minor").select("band", own["blocks"].alias("block"), each["parts"].alias("part"), "node", "root", "minor", F.lit(True).alias("pivot"))
    others = within.select("band", each["blocks"].alias("block"), own["parts"].alias("part"), "node", "root", "minor", F.lit(False).alias("pivot"))

    def compared(group: pa.Table) -> pa.Table:
        rows = group.select(["pivot", "node", "root", "minor", "set"]).to_pylist()
        members, asking = [r for r in rows if not r["pivot"]], [r for r in rows if r["pivot"]]
        out: list[tuple[int, int]] = []
        if members and asking:
            sets = [np.frombuffer(r["set"], np.uint32) for r in members]
            size = np.array([len(x) for x in sets], np.int64)
            known, place = np.unique(np.concatenate(sets), return_inverse=True)
            first = np.cumsum(size) - size
            node, root, minor = (np.array([r[c] for r in members]) for c in ("node", "root", "minor"))
            for r in asking:
                x = np.frombuffer(r["set"], np.uint32)
                to = (root != r["root"]) & (~minor | (node > r["node"])) & (np.minimum(size, len(x)) >= similarity * np.maximum(size, len(x)))
                if not to.any():
                    continue
                mark = np.zeros(len(known), np.int64)
                slot = np.minimum(np.searchsorted(known, x), len(known) - 1)
                mark[slot[known[slot] == x]] = 1
                both = np.add.reduceat(mark[place], first)
                out += [(r["root"], b) for b in np.unique(root[to & (both >= similarity * (size + len(x) - both))]).tolist()]
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return pivots.unionByName(others).join(held, "node").groupBy("band", "block", "part").applyInArrow(compared, "a long, b long").distinct()


def joined_nodes(docs: DataFrame, found: DataFrame, k: int, similarity: float, others: DataFrame | None = None) -> DataFrame:
    """``node`` and ``root`` of all nodes of ``found`` (from :func:`sketches`, written) that are linked to some other node.

    Links are those of texts alike by ``similarity`` or more and ``others`` (``a``, ``b``: nodes). Texts that share a band
    are compared on all their shingles (by 32 bits of each hash): first with the first and the last text of that band,
    then those of it that are in different components still, each with each. The whole graph is solved once; the links
    that the crowded bands then add are solved among the roots alone.
    """
    nodes = found.filter(F.size("bands") > 0).groupBy("node").agg(F.min("doc_id").alias("id"), F.first("bands").alias("bands"))
    every = written(nodes.select("id", "node", F.explode("bands").alias("band")))
    who = F.struct("id", "node")
    ends = written(every.groupBy("band").agg(F.count("*").alias("n"), F.min(who).alias("low"), F.max(who).alias("high")).filter("n > 1"))
    met = every.join(ends, "band").select(F.struct("id", "node").alias("x"), F.explode(F.array("low", "high")).alias("y")).filter("x.node <> y.node")
    pairs = written(met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    asked = pairs.select(F.explode(F.array("a", "b")).alias("x")).select(F.col("x.id").alias("doc_id"), "x.node").distinct()

    def sets(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        out, known = [], WordHashes()
        for n, t in zip(column(batch, "node").to_pylist(), text_bytes(batch), strict=True):
            h = shingles(t, k, known)
            if np.uint64(xxhash.xxh3_64_intdigest(h.tobytes())).view(np.int64) == n:  # not another row of this id
                out.append((n, np.unique(h.astype(np.uint32)).tobytes()))
        return rows_of(["node", "set"], list(map(list, zip(*out, strict=True))), [pa.int64(), pa.binary()]) if out else None

    def compared(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        out = []
        for a, b, x, y in zip(*(column(batch, c).to_pylist() for c in ("a", "b", "x", "y")), strict=True):
            p, q = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
            both = len(np.intersect1d(p, q, assume_unique=True))
            if both >= similarity * (len(p) + len(q) - both):
                out.append((a, b))
        return rows_of(["a", "b"], list(map(list, zip(*out, strict=True))), [pa.int64()] * 2) if out else None

    own = texts(docs)
    held = written(arrow_map(own.join(asked, own["doc_id"].eqNullSafe(asked["doc_id"])).select("node", "text"), "node long, set binary", sets).dropDuplicates(["node"]))
    with_a = pairs.select(F.col("a.node").alias("a"), F.col("b.node").alias("b")).join(held.select(F.col("node").alias("b"), F.col("set").alias("y")), "b")
    both = with_a.join(held.select(F.col("node").alias("a"), F.col("set").alias("x")), "a")
    stars = arrow_map(both, "a long, b long", compared)
    roots = components(stars if others is None else stars.unionByName(others))
    crowded = every.join(ends.filter("n > 3").select("band"), "band").select("band", "node")  # smaller ones are through
    more = written(remaining(crowded, roots, held, similarity))
    remove(pairs, held, every, ends)
    if more.isEmpty():
        return roots
    second = components(more).select(F.col("node").alias("root"), F.col("root").alias("last"))
    kept = roots.join(second, "root", "left").select("node", F.coalesce("last", "root").alias("root"))
    return written(kept.unionByName(second.join(roots.select("root").distinct(), "root", "left_anti").select(F.col("root").alias("node"), F.col("last").alias("root"))))


def alike(docs: DataFrame, k: int = 5, similarity: float = 0.8) -> DataFrame:
    """``doc_id`` and ``component_id`` of documents linked by a Jaccard similarity of ``similarity`` or more.

    SimHash cannot tell texts that are alike by 0.8: their fingerprints differ in up to twenty bits, so candidates are
    texts that share a band of min-hashes (see :func:`joined_nodes`). Equal sets of shingles are one node. Texts without
    words are not linked; null ids are never smallest.
    """
    found = written(sketches(docs, k))
    least = found.groupBy("node").agg(F.min("doc_id").alias("least"))
    named = least.join(joined_nodes(docs, found, k, similarity), "node")
    roots = named.join(named.groupBy("root").agg(F.min("least").alias("component")), "root").select("node", "component")
    known = least.join(roots, "node", "left").select("node", F.coalesce("component", "least").alias("component_id"))
    wordless = F.size("bands") == 0
    return found.join(known, "node").select("doc_id", F.when(wordless, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def close_nodes(found: DataFrame, tau: int) -> DataFrame:
    """Links (``a``, ``b``) between nodes that have one fingerprint, or fingerprints within ``tau`` bits."""
    both = found.filter(F.size("bands") > 0).select("fp", "node").distinct()
    first = written(both.groupBy("fp").agg(F.min("node").alias("first"), F.count("*").alias("n")))
    one = both.join(first.filter("n > 1"), "fp").filter("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b"))
    near_ = written(links(first.select("fp"), tau))
    of = lambda c: first.select(F.col("fp").alias(c), F.col("first").alias(f"node_{c}"))
    two = near_.join(of("a"), "a").join(of("b"), "b").select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
    return one.unionByName(two).filter("a <> b")


def first_of_each(docs: DataFrame, k: int = 5, tau: int = 4, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one row of each component of near duplicates, that with the smallest ``doc_id`` (nulls last, then by text); all columns stay.

    Components join texts whose SimHashes are within ``tau`` bits and texts alike by ``similarity`` (:func:`alike`). Rows
    are told apart by id and text: rows that share an id have their own fate, and of rows equal in both one stays.
    Texts without any word are no copies of one another and all stay; an empty table gives no rows.
    """
    found = written(sketches(docs, k))
    roots = joined_nodes(docs, found, k, similarity, close_nodes(found, tau))
    rows = found.filter(F.size("bands") > 0).groupBy("node", "doc_id", "mark").agg(F.count("*").alias("n"))
    who = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "mark")
    named = written(rows.join(roots, "node", "left").select(F.coalesce("root", "node").alias("root"), who.alias("who"), "n"))
    stays = named.groupBy("root").agg(F.min("who").alias("stays"), F.count("*").alias("rows"))
    fate = named.join(stays.filter("rows > 1"), "root", "left").select(F.col("who.doc_id").alias("id"), F.col("who.mark").alias("mark"), F.coalesce(F.col("who") != F.col("stays"), F.lit(False)).alias("goes"), "n")
    fate = written(fate.filter("goes or n > 1"))
    remove(found, named)
    packed = docs.select(F.struct("*").alias("row"), docs["doc_id"].cast("long").alias("id"), mark_of(docs).alias("mark"))
    same = lambda x: packed["id"].eqNullSafe(x["id"]) & (packed["mark"] == x["mark"])
    gone = fate.filter("goes")
    again = fate.filter("not goes")
    if again.isEmpty():
        return packed.join(gone, same(gone), "left_anti").select("row.*")
    once = packed.join(again, same(again), "left_semi").dropDuplicates(["id", "mark"]).select("row.*")
    return packed.join(fate, same(fate), "left_anti").select("row.*").unionByName(once)
