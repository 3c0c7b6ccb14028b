"""Best-fit packing of token sequences in bulk-synchronous rounds.

Lengths are whole numbers up to the capacity, so range-sorted documents and gaps are runs: (length, how many) and
(gap, how many). A round takes the longest documents left, finds for them the smallest gaps that hold them (their
successors), and settles who gets which by rank; then gaps are updated and the next round begins. The rounds see runs
only, at most as many as there are lengths; documents take their seats by rank in a distributed window and join.
"""

from __future__ import annotations

import base64
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column, lean, rows_of, texts, written

CAPACITY = 2048
#: Shards of each length: a length that a third of all pieces share is ranked by so many tasks.
SHARDS = 64
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Tokens that byte_bpe_50k.json adds to the ranks; ``tokenizers`` reads them in any text.
ADDED = {"<|endoftext|>": 50256}


def encoder(path: str):
    """Byte-level BPE of the ranks in ``path``, with the tokens that the vocabulary's JSON adds to them."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=ADDED)


def ids_of(text: str, encode, path: str) -> np.ndarray:
    """Ids of a text. Runs of a million blanks exhaust the faster encoder's pattern; ``tokenizers`` takes them."""
    try:
        return encode.encode_to_numpy(text, allowed_special="all")
    except ValueError:
        from tokenizers import Tokenizer

        return np.array(Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids, np.uint32)


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens; only the first may be shorter than ``capacity`` where there are more."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


def pieces(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, keep_ids: bool = True) -> DataFrame:
    """Tokenised pieces: ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32`` and, if ``keep_ids``, ``ids``.

    ``vocabulary`` is a file of ranks with the same vocabulary's JSON beside it. Each text ends with id 0; a null text is empty and is that id alone. Repeated rows are separate documents.
    """
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    whole = path.removesuffix(".tiktoken") + ".json"
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *[pa.list_(pa.int32())] * keep_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for doc_id, text in zip(column(batch, "doc_id").to_pylist(), column(batch, "text").to_pylist(), strict=True):
                ids = np.append(ids_of(text, encode, whole), 0).astype("<u4")
                for k, (start, length) in enumerate(cut(len(ids), capacity)):
                    part = ids[start : start + length]
                    for to, x in zip(out, (doc_id, k, start, length, zlib.crc32(part.tobytes()), part), strict=False):
                        to.append(x)
            yield rows_of(names, out, types)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids
    return texts(docs).mapInArrow(lean(run), schema)


def rounds(lengths: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Seats of the ranks of each length: (length, first rank, last rank + 1, first sequence, per sequence, offset).

    ``lengths`` has how many pieces there are of each length. Rank r of a row sits in sequence first + (r - first rank)
    // per, at offset + (r - first rank) % per * length.
    """
    gaps: list[int] = []  # sorted gaps that are there
    runs: dict[int, list[tuple[int, int]]] = {}  # gap -> runs of sequences (first, how many)
    seats, fresh = [], 0

    def put(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in runs:
                insort(gaps, gap)
                runs[gap] = []
            runs[gap].append((first, n))

    for length in sorted(lengths, reverse=True):
        rank, left = 0, lengths[length]
        while left and (at := bisect_left(gaps, length)) < len(gaps):
            gap = gaps[at]
            first, n = runs[gap].pop()
            if not runs[gap]:
                del runs[gap], gaps[at]
            fit = gap // length  # as many as it holds, one after another: each is the best fit of the next rank
            taken = min(n, -(-left // fit))
            whole = min(taken, left // fit)
            placed = 0
            if whole:
                seats.append((length, rank, rank + whole * fit, first, fit, capacity - gap))
                put(gap - fit * length, first, whole)
                placed = whole * fit
            if taken > whole:
                rest = left - placed
                seats.append((length, rank + placed, rank + placed + rest, first + whole, rest, capacity - gap))
                put(gap - rest * length, first + whole, 1)
                placed += rest
            put(gap, first + taken, n - taken)
            rank, left = rank + placed, left - placed
        if left:
            fit = capacity // length
            whole, rest = divmod(left, fit)
            if whole:
                seats.append((length, rank, rank + whole * fit, fresh, fit, 0))
                put(capacity - fit * length, fresh, whole)
            if rest:
                seats.append((length, rank + whole * fit, rank + left, fresh + whole, rest, 0))
                put(capacity - rest * length, fresh + whole, 1)
            fresh += whole + bool(rest)
    return seats


def packed(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``found`` (from :func:`pieces`, written first) with ``sequence_id`` and ``offset`` in its sequence, gapless from 0.

    What reaches the driver are the counts by length, at most ``capacity`` rows; what is broadcast are the seats (a few
    for each length) and one rank offset for each length and shard. An empty table gives no rows.
    """
    spark = found.sparkSession
    salted = found.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(SHARDS)).cast("int"))
    counts = written(salted.groupBy("length", "shard").agg(F.count("*").alias("n")))
    before = Window.partitionBy("length").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    lengths = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}
    schema = "length long, rank_from long, rank_to long, sequence long, per long, at long"
    seats = spark.createDataFrame(rounds(lengths, capacity), schema)
    ranked = salted.withColumn("row", F.row_number().over(Window.partitionBy("length", "shard").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    ranked = ranked.join(F.broadcast(offsets), ["length", "shard"]).withColumn("rank", F.col("first") + F.col("row"))
    seated = ranked.join(F.broadcast(seats.withColumnRenamed("length", "of")), (F.col("length") == F.col("of")) & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to")))
    step = F.col("rank") - F.col("rank_from")
    return seated.select(*found.columns, (F.col("sequence") + F.floor(step / F.col("per"))).alias("sequence_id"), (F.col("at") + step % F.col("per") * F.col("length")).alias("offset"))


def op7_packing(docs: DataFrame) -> DataFrame:
    """One row a piece: where it comes from, where it sits, and the checksum of its ids."""
    return packed(written(pieces(docs, keep_ids=False)))
