"""Secrets in texts, told apart by how many repositories and owners carry the same value.

DataFrame functions only. A candidate's value is hashed; over the corpus the distinct documents (repositories) and
sources (owners) of each hash are counted. Values that many owners carry are copied examples; values of one owner
with the looks of a real credential are called live.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import texts, written
from .spans import count_of, find, ordered, said

# fixed values: the patterns of the base kinds
ASSIGN = r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"

BASE = ("assign", "access", "hex")
#: Kinds the ownership counts add: they cover the value alone.
LIVE, EXAMPLE, UNCLEAR = "live", "example", "unclear"


def value_of(span: Column) -> Column:
    """The secret itself: what an assignment assigns, else the whole match."""
    return F.when(span["kind"] == "assign", F.regexp_extract(span["value"], ASSIGN, 2)).otherwise(span["value"])


def candidates(docs: DataFrame, owner: str = "source") -> DataFrame:
    """One row per document: ``doc_id``, ``row`` (tells repeated ids apart), ``owner`` and ``spans`` of the base kinds.

    A null text is empty, a null owner is an owner of its own called "".
    """
    text = F.col("text")
    who = F.coalesce(F.col(owner).cast("string"), F.lit("")) if owner in docs.columns else F.lit("")
    spans = ordered(
        find(text, "assign", 0, r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]", ASSIGN, lambda x: F.length(F.regexp_extract(x, ASSIGN, 2)) >= 6),
        find(text, "access", 1, ACCESS, ACCESS, lambda x: F.lit(True)),
        find(text, "hex", 2, HEX, HEX, lambda x: F.lit(True)),
    )
    return texts(docs, who.alias("owner")).select("doc_id", "owner", spans.alias("spans")).withColumn("row", F.monotonically_increasing_id())


def ownership(found: DataFrame) -> DataFrame:
    """``value_hash``, ``repositories`` and ``owners`` of every candidate value.

    Counting runs in two steps, (hash, owner) and then hash, each combined before its shuffle: a value that a third of
    all rows carry sends one row per owner and task, not one per copy. Documents are distinct rows already.
    """
    each = found.select("row", "owner", F.explode(F.array_distinct(F.transform("spans", lambda s: F.xxhash64(value_of(s))))).alias("value_hash"))
    by_owner = each.groupBy("value_hash", "owner").agg(F.count("*").alias("n"))
    return by_owner.groupBy("value_hash").agg(F.sum("n").alias("repositories"), F.count("*").alias("owners"))


def judged(docs: DataFrame, owner: str = "source", max_live_owners: int = 1, max_live_repositories: int = 3, min_example_owners: int = 3) -> DataFrame:
    """``doc_id``, ``base`` and ``verdicts``, arrays of spans; ``verdicts`` covers the values as live, example or unclear.

    Live: at most ``max_live_owners`` owners and ``max_live_repositories`` documents, at least 12 characters with
    letters and digits. Example: ``min_example_owners`` owners or more, or the value says so itself. An empty table
    gives no rows; repeated rows count as copies and are each returned.
    """
    found = written(candidates(docs, owner))
    freq = ownership(found)
    one = found.select("row", F.explode("spans").alias("s")).select("row", "s", value_of(F.col("s")).alias("value")).withColumn("value_hash", F.xxhash64("value"))
    looks = (F.length("value") >= 12) & F.col("value").rlike("[0-9]") & F.col("value").rlike("[A-Za-z]")
    says = F.col("value").rlike("(?i:example|sample|dummy|changeme|xxxx|your)")
    verdict = (
        F.when(says | (F.col("owners") >= min_example_owners), EXAMPLE)
        .when(looks & (F.col("owners") <= max_live_owners) & (F.col("repositories") <= max_live_repositories), LIVE)
        .otherwise(UNCLEAR)
    )
    begin = F.col("s.end") - F.length("value")
    span = F.struct(begin.cast("int").alias("start"), F.lit(3).alias("rank"), verdict.alias("kind"), F.col("s.end").alias("end"), F.col("value").alias("value"))
    # the large side keeps its hot values; adaptive execution splits their partitions, as the other side has one row a value
    verdicts = one.join(freq, "value_hash").groupBy("row").agg(F.array_sort(F.collect_set(span)).alias("verdicts"))
    held = found.filter(F.size("spans") > 0).join(verdicts, "row", "left").select("doc_id", F.col("spans").alias("base"), "verdicts")
    none = found.filter(F.size("spans") == 0).select("doc_id", F.col("spans").alias("base"), F.col("spans").alias("verdicts"))
    return held.unionByName(none)


def op2_secrets(docs: DataFrame) -> DataFrame:
    """Digest per document: counts and hash of the base spans, all spans, and how many values are live or examples."""
    both = judged(docs).select("doc_id", "base", "verdicts")
    return both.select(
        "doc_id",
        *(count_of(F.col("base"), k).alias(f"n_{k}") for k in BASE),
        F.sha2(said(F.col("base")), 256).alias("base_sha256"),
        said(ordered(F.col("base"), F.col("verdicts"))).alias("spans"),
        *(count_of(F.col("verdicts"), k).alias(f"n_{k}") for k in (LIVE, EXAMPLE)),
    )
