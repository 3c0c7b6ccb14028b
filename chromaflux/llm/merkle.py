"""Merkle-tree fingerprints: pieces of a paragraph are leaves, paragraphs and sections the branches.

Boundaries come from the content (a paragraph ends at a line break, a section at a paragraph whose hash says so, a piece
at a word whose letters say so), so an edit changes the branches above it and leaves the others alone. Equal roots mean
equal texts; where roots differ, the branches that differ show where.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, lean, rows_of, texts

#: Hexadecimal digits of a leaf, a section and the root in a fingerprint; words of a piece at most.
LEAF, BRANCH, ROOT, MOST = 6, 12, 32, 16
#: Bytes of text that one bucket of neighbouring documents aims at, and buckets at most.
BUCKET, BUCKETS = 16 << 20, 4096


@dataclass(frozen=True)
class Tree:
    """``root``, the digest of each section, and for each section the leaves of each paragraph."""

    root: str
    sections: tuple[str, ...]
    leaves: tuple[tuple[tuple[str, ...], ...], ...]

    def text(self) -> str:
        """root/section:leaves,leaves;section:... with the leaves of a paragraph run together."""
        return self.root + "/" + ";".join(f"{s}:" + ",".join("".join(p) for p in ps) for s, ps in zip(self.sections, self.leaves, strict=True))


def read(fingerprint: str) -> Tree:
    """The tree that :meth:`Tree.text` wrote."""
    root, _, rest = fingerprint.partition("/")
    parts = [x.partition(":") for x in rest.split(";")] if rest else []
    leaves = tuple(tuple(tuple(p[i : i + LEAF] for i in range(0, len(p), LEAF)) for p in x[2].split(",")) for x in parts)
    return Tree(root, tuple(x[0] for x in parts), leaves)


def _pieces(paragraph: bytes) -> list[str]:
    out, begin = [], 0
    words = paragraph.split()
    digest = xxhash.xxh3_64_hexdigest
    for at, w in enumerate(words):
        if (w[0] * 5 + w[-1] * 3 + len(w)) & 3 == 0 or at - begin + 1 >= MOST:
            out.append(digest(b" ".join(words[begin : at + 1]))[:LEAF])
            begin = at + 1
    if begin < len(words) or not out:
        out.append(digest(b" ".join(words[begin:]))[:LEAF])
    return out


def tree(text: bytes) -> Tree:
    """The tree of a text; the empty text has a root and no sections."""
    sections, leaves, digests, own = [], [], [], []

    def close() -> None:
        sections.append(hashlib.blake2b(b"".join(digests), digest_size=BRANCH // 2).hexdigest())
        leaves.append(tuple(own))
        digests.clear()
        own.clear()

    top = hashlib.blake2b(digest_size=ROOT // 2)
    for paragraph in text.split(b"\n") if text else ():
        pieces = _pieces(paragraph)
        whole = hashlib.blake2b(paragraph, digest_size=16).digest()
        digests.append(whole + "".join(pieces).encode())
        own.append(tuple(pieces))
        top.update(whole)
        if whole[0] & 3 == 0:  # a section has four paragraphs on average
            close()
    if own:
        close()
    top.update("".join(sections).encode())
    return Tree(top.hexdigest(), tuple(sections), tuple(leaves))


def likeness(a: Tree, b: Tree) -> float:
    """Share of leaves in common: equal roots 1, no leaf in common 0. Equal sections are matched whole."""
    if a.root == b.root:
        return 1.0
    x, y = (Counter(leaf for s in t.leaves for p in s for leaf in p) for t in (a, b))
    most = max(sum(x.values()), sum(y.values()))
    return (x & y).total() / most if most else 0.0


def edits(a: Tree, b: Tree) -> list[tuple[int, int]]:
    """(section, paragraph) of ``a`` whose branches ``b`` doesn't have, section by section from the top."""
    there, paragraphs = set(b.sections), {p for s in b.leaves for p in s}
    return [(i, k) for i, s in enumerate(a.sections) if s not in there for k, p in enumerate(a.leaves[i]) if p not in paragraphs]


def neighbours(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text``, ``bucket`` and ``extra``: rows dealt to buckets of descending ids, each with the row after its last.

    Bucket bounds are ids that exist, so the row that begins a bucket is known without looking: it also goes to the
    bucket before as an extra row, and the very first goes to the last bucket. Rows are ordered by id (descending,
    nulls last), then text.
    """
    own = texts(docs)
    n, largest = own.agg(F.sum(F.octet_length("text")), F.max("doc_id")).first()
    count = max(1, min(BUCKETS, (n or 0) // BUCKET))
    cuts = [] if largest is None else own.agg(F.percentile_approx("doc_id", [i / count for i in range(1, count)] or [0.5], 100_000)).first()[0]
    bounds = sorted({largest, *cuts} - {None}, reverse=True) if largest is not None and count > 1 else [x for x in [largest] if x is not None]
    held = F.array(*(F.lit(b).cast("long") for b in bounds)) if bounds else F.array().cast("array<long>")
    last = max(0, len(bounds) - 1)
    at = F.when(F.col("doc_id").isNull(), last).otherwise(F.size(F.filter(held, lambda b: b >= F.col("doc_id"))) - 1)
    # a row that bounds bucket k > 0 also ends bucket k - 1; the largest id (or, without ids, every row) ends the last
    before = F.when(F.col("doc_id").eqNullSafe(F.lit(largest)), last).when(F.array_contains(held, F.col("doc_id")), at - 1)
    both = F.array(F.struct(at.cast("int").alias("bucket"), F.lit(False).alias("extra")), F.struct(before.cast("int").alias("bucket"), F.lit(True).alias("extra")))
    dealt = own.select("doc_id", "text", F.explode(F.filter(both, lambda x: x["bucket"].isNotNull())).alias("to"))
    order = [F.col("bucket"), F.col("extra"), F.col("doc_id").desc_nulls_last(), F.col("text")]
    return dealt.select("doc_id", "text", "to.*").repartitionById(max(1, len(bounds)), F.col("bucket")).sortWithinPartitions(*order)


def edited(text: str, following: str) -> str:
    """``text`` with its last third replaced by as much of the beginning of ``following``, or all of it."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def op4_merkle(docs: DataFrame) -> DataFrame:
    """Fingerprint of each text and of its edited text, and how alike they and the next document are.

    A null text is empty; rows with equal ids follow one another by text; a table of one row is its own next document.
    """
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "edited_paragraphs"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row before, which waits for its next
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for doc_id, text, bucket, extra in zip(*(column(batch, c).to_pylist() for c in ("doc_id", "text", "bucket", "extra")), strict=True):
                mine = tree(text.encode())
                if held is not None and held[2] == bucket:
                    was_id, was, _, fingerprint = held
                    new = edited(was, text)
                    changed = fingerprint if new == was else tree(new.encode())
                    row = (was_id, len(was), hashlib.sha256(new.encode()).hexdigest(), fingerprint.text(), changed.text(), likeness(fingerprint, changed), likeness(fingerprint, mine), len(edits(fingerprint, changed)))
                    for to, x in zip(out, row, strict=True):
                        to.append(x)
                held = None if extra else (doc_id, text, bucket, mine)
            yield rows_of(names, out, types)

    return neighbours(docs).mapInArrow(lean(run), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edited_paragraphs long")
