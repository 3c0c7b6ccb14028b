"""Token counts by a two-tier lookup on the map side.

The vocabulary's merges never run across the start of a run of blanks, so a text's count is the sum of the counts of its
pre-tokens (a run of blanks and what follows it). A compact table with the lengths of frequent pre-tokens is broadcast;
all others are encoded once a worker and kept in its bounded cache. No pre-token is ever shuffled: the plan is one map.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, lean, rows_of, texts

VOCABULARY = "piece_bpe_32k.model"
LIMIT = 4096
#: The frequent tier: entries, characters of an entry, and the rows and characters of each that it is chosen from.
#: These bound what is broadcast (some 3 MB here, 17 MB at most) and decide about speed only: counts don't depend on the table.
FREQUENT, LONGEST, SAMPLE_ROWS, SAMPLE_CHARS = 1 << 16, 64, 2048, 4096
#: Entries of a worker's cache, and characters of a text that are split at a time.
CACHED, STEP = 1 << 18, 1 << 20
#: How sentencepiece writes a blank.
BLANK = "▁"
_PRE_TOKEN = re.compile(f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+")
_BORDER = re.compile(f"[^{BLANK}]{BLANK}")


def pre_tokens(text: str) -> Iterator[list[str]]:
    """Lists of the pre-tokens of a text as the library would see it: with a blank before it; empty texts have none."""
    if not text:
        return
    shown = BLANK + text.replace(" ", BLANK)
    at = 0
    while at < len(shown):
        border = _BORDER.search(shown, at + STEP) if at + STEP < len(shown) else None
        end = border.start() + 1 if border else len(shown)
        yield _PRE_TOKEN.findall(shown[at:end])
        at = end


@lru_cache(maxsize=2)
def processor(path: str):
    """The library's processor, once it is known to add a blank before a text, keep all other characters and never merge across a border."""
    import sentencepiece

    found = sentencepiece.SentencePieceProcessor(model_file=path)
    if any(_BORDER.search(found.id_to_piece(i)) for i in range(found.get_piece_size())) or found.encode(" x  y ") != found.encode(f"{BLANK}x{BLANK}{BLANK}y{BLANK}"):
        raise ValueError("this vocabulary has tokens across pre-tokens, or changes blanks")
    return found


class Lengths(dict):
    """Tokens of each pre-token: those of the table, and those that this worker has met."""

    def __init__(self, path: str, known: Iterable[tuple[str, int]] = ()):
        super().__init__(known)
        self.encode = processor(path).encode
        self.room = len(self) + CACHED
        self.blank = len(self.encode("x ")) - len(self.encode("x"))

    def __missing__(self, token: str) -> int:
        # the library puts a blank before what it is given, which is the first one here; alone it would be taken for an empty text
        n = self.blank if token == BLANK else len(self.encode(token[1:]))
        if len(token) <= LONGEST and len(self) < self.room:
            self[token] = n
        return n

    def count(self, text: str) -> int:
        return sum(sum(map(self.__getitem__, part)) for part in pre_tokens(text))


def frequent(docs: DataFrame, path: str) -> tuple[str, bytes]:
    """The broadcast tier: frequent pre-tokens, joined by line feeds, and a byte with the length of each.

    It is chosen from the beginnings of the first rows that Spark reads (``SAMPLE_ROWS`` of ``SAMPLE_CHARS``, so some
    33 MB reach the driver at most). Where these are unlike the rest, workers' caches take over.
    """
    seen: Counter[str] = Counter()
    for (text,) in docs.select(F.left("text", F.lit(SAMPLE_CHARS))).take(SAMPLE_ROWS):
        for part in pre_tokens(text):
            seen.update(part)
    lengths = Lengths(path)
    chosen = [(t, n) for t, k in seen.most_common(FREQUENT) if k > 1 and len(t) <= LONGEST and "\n" not in t and (n := lengths[t]) < 256]
    return "\n".join(t for t, _ in chosen), bytes(n for _, n in chosen)


_held: dict[tuple, Lengths] = {}


def held(path: str, table: tuple[str, bytes]) -> Lengths:
    """This worker's lookup: the table and what it has met since, in earlier tasks too."""
    key = (path, hash(table))
    if key not in _held:
        _held.clear()
        _held[key] = Lengths(path, zip(table[0].split("\n"), table[1], strict=False))
    return _held[key]


def counted(docs: DataFrame, model: str | None = None, limit: int = LIMIT) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_tokens`` and ``over_limit`` of each row, by the sentencepiece vocabulary in the file ``model``.

    Counts are those of the library at its defaults for the whole text, without begin or end; strings like ``</s>`` are
    ordinary text, as for the library. A null text is empty: no bytes, no tokens. Repeated and null ids give a row each;
    other columns are ignored; an empty table gives no rows. A long text is split a megabyte at a time.
    """
    path = model or public_tokenizers.path(VOCABULARY)
    rows = texts(docs)
    table = docs.sparkSession.sparkContext.broadcast(frequent(rows, path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = held(path, table.value)
        for batch in batches:
            n = [lengths.count(t) for t in column(batch, "text").to_pylist()]
            yield rows_of(["doc_id", "n_bytes", "n_tokens"], [column(batch, "doc_id"), column(batch, "n_bytes"), n], [pa.int64(), pa.int64(), pa.int64()])

    found = rows.withColumn("n_bytes", F.octet_length("text").cast("long")).mapInArrow(lean(run), "doc_id long, n_bytes long, n_tokens long")
    return found.withColumn("over_limit", F.col("n_tokens") > limit)


def op13_tokens(docs: DataFrame) -> DataFrame:
    """Bytes and tokens of every document, and whether it has more than 4,096 tokens."""
    return counted(docs)
