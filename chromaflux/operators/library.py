"""Scores of spectra against a library: cosine or composite, weightings, what becomes of unmatched ions, shifted masses, embeddings.

Spectra are long tables (id, mz, intensity). Where every pair is asked for (:func:`scores`) they meet ion by ion in an
equi-join. A search asks for the best ``n`` alone: spectra become one row each, the library is dealt into blocks, every
block meets the queries once and gives its best of each query, so a pair is a number in a task and never a row.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.feature import Word2Vec
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import kept
from .joins import small
from .windows import ahead, islands, top

#: fixed values: powers of the mass and of the intensity in published weightings
WEIGHTINGS = {"None": (0.0, 1.0), "NIST": (1.3, 0.53), "NIST_GC": (3.0, 0.6)}
SIMILARITIES = ("cosine", "composite")
UNMATCHED = ("keep_all", "remove_all", "keep_library", "keep_experimental")


@dataclass(frozen=True)
class Scoring:
    """How a pair is scored. ``shift`` is added to the masses of the query."""

    similarity: str = "composite"
    weighting: str = "NIST_GC"
    unmatched: str = "keep_all"
    shift: int = 0

    def __post_init__(self) -> None:
        for value, known in ((self.similarity, SIMILARITIES), (self.weighting, WEIGHTINGS), (self.unmatched, UNMATCHED)):
            if value not in known:
                raise ValueError(f"{value} is none of {', '.join(known)}")


def _sides(queries: DataFrame, library: DataFrame, scoring: Scoring) -> tuple[DataFrame, DataFrame]:
    """Both sides with the weights ``u`` and ``v`` of their ions, and intensities ``iu`` and ``iv``; an ion has to be there once."""
    mass, power = WEIGHTINGS[scoring.weighting]
    weigh = F.pow(F.col("mz").cast("double"), F.lit(mass)) * F.pow("intensity", F.lit(power))
    q = queries.filter("intensity > 0").select(F.col("id").alias("query"), "mz", weigh.alias("u"), F.col("intensity").alias("iu"))
    if scoring.shift:
        kind = queries.schema["mz"].dataType
        moved = queries.withColumn("mz", (F.col("mz") + scoring.shift).cast(kind))
        q = moved.filter("intensity > 0").select(F.col("id").alias("query"), "mz", weigh.alias("u"), F.col("intensity").alias("iu"))
    return q, library.filter("intensity > 0").select(F.col("id").alias("hit"), "mz", weigh.alias("v"), F.col("intensity").alias("iv"))


def ratio_score(ions: Column) -> Column:
    """Mean of the ratios of neighbouring shared ions, each taken the way that makes it at most 1, over the number of shared ions.

    ``ions``: an array of (mz, u, v) in order; a single ion has no neighbour and scores 0.
    """
    n = F.size(ions)
    pairs = F.arrays_zip(F.slice(ions, F.lit(1), n - 1).alias("a"), F.slice(ions, F.lit(2), n - 1).alias("b"))

    def ratio(p: Column) -> Column:
        r = (p["b"]["v"] / p["a"]["v"]) * (p["a"]["u"] / p["b"]["u"])
        return F.least(r, 1 / r)

    return F.when(n > 1, F.aggregate(F.transform(pairs, ratio), F.lit(0.0), lambda total, r: total + r) / n).otherwise(0.0)


def scores(queries: DataFrame, library: DataFrame, scoring: Scoring = Scoring(), pairs: DataFrame | None = None) -> DataFrame:
    """``query``, ``hit``, ``score`` and ``shared`` ions of every pair that shares an ion (of ``pairs``: query, hit, if given).

    Unmatched ions of a side count in its length unless ``unmatched`` says they go: ``remove_all`` those of both,
    ``keep_library`` those of the query, ``keep_experimental`` those of the library. The composite score mixes the cosine,
    by the query's ions, with the ratios of neighbouring shared ions, by the shared ones.
    """
    q, v = _sides(queries, library, scoring)
    met = q.join(pairs.select("query", "hit"), "query").join(v, ["hit", "mz"]) if pairs is not None else q.join(small(v), "mz")
    sums = [F.sum(F.col("u") * F.col("v")).alias("dot"), F.sum(F.col("u") * F.col("u")).alias("su"), F.sum(F.col("v") * F.col("v")).alias("sv"), F.count("*").alias("shared")]
    if scoring.similarity == "composite":
        sums.append(F.sort_array(F.collect_list(F.struct("mz", F.col("iu").alias("u"), F.col("iv").alias("v")))).alias("ions"))
    found = met.groupBy("query", "hit").agg(*sums)
    if scoring.unmatched in ("keep_all", "keep_experimental"):
        found = found.join(q.groupBy("query").agg(F.sum(F.col("u") * F.col("u")).alias("uu"), F.count("*").alias("nu")), "query")
    else:
        found = found.withColumn("uu", F.col("su")).withColumn("nu", F.col("shared"))
    if scoring.unmatched in ("keep_all", "keep_library"):
        found = found.join(v.groupBy("hit").agg(F.sum(F.col("v") * F.col("v")).alias("vv")), "hit")
    else:
        found = found.withColumn("vv", F.col("sv"))
    score = F.col("dot") / F.sqrt(F.col("uu") * F.col("vv"))
    if scoring.similarity == "composite":
        score = (F.col("nu") * score + F.col("shared") * ratio_score(F.col("ions"))) / (F.col("nu") + F.col("shared"))
    return found.select("query", "hit", score.alias("score"), "shared")


def best(found: DataFrame, n: int) -> DataFrame:
    """The ``n`` highest scores of each query with their ``rank``; equal ones by ``hit``."""
    return top(found, ["query"], n, F.desc(F.round("score", 9)), F.col("hit"))


#: Spectra of a library that are compared at once, queries that are held at once, and cells of a table in a task.
BLOCK, ASKED, CELLS = 8_192, 16_384, 1 << 20


def whole(ions: DataFrame, key: str, *values: str) -> DataFrame:
    """One row for each ``key`` with its ions in order of their masses: arrays ``mz`` and ``values``."""
    listed = ions.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col("mz").cast("double").alias("mz"), *values))).alias("s"))
    return listed.select(key, *(F.col(f"s.{c}").alias(c) for c in ("mz", *values)))


def leading(score: np.ndarray, n: int) -> np.ndarray:
    """Places of the ``n`` highest scores to nine digits, the first of equals first; minus infinity is none."""
    order = -np.round(score, 9)
    if n < len(order):
        at = np.nonzero(order <= np.partition(order, n - 1)[n - 1])[0]
    else:
        at = np.arange(len(order))
    at = at[order[at] < np.inf]
    return at[np.argsort(order[at], kind="stable")[:n]]


def in_blocks(queries: DataFrame, library: DataFrame, n: int, score, on: tuple[str, ...] = (), extra: str = "") -> DataFrame:
    """The ``n`` best of each query (``query`` and arrays) in every block of the library (``hit`` and arrays); both may have the keys ``on``.

    The library is dealt into blocks of about ``BLOCK`` rows, queries into parts of about ``ASKED``; each block meets each part
    in one group, so a group is bounded and what is shuffled are spectra, not pairs. ``score(queries, library)`` gives, for
    each query in turn, the scores of the library's rows (minus infinity: no hit) and further columns by name; ``extra``
    is their schema.
    """
    library, queries = kept(library), kept(queries)
    largest = library.groupBy(*on).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    blocks, parts = max(1, -(-largest // BLOCK)), max(1, -(-queries.count() // ASKED))
    place = lambda c, k: F.pmod(F.xxhash64(c), F.lit(k)).cast("int")
    # every block number meets every part number on both sides
    v = library.withColumn("__b", place("hit", blocks)).withColumn("__a", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    q = queries.withColumn("__a", place("query", parts)).withColumn("__b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    keys = [*on, "__a", "__b"]
    names = [x.split()[0] for x in extra.split(", ") if x]

    def one(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {c: [] for c in ("query", "hit", "score", *names)}
        if len(q) and len(v):
            v = v.sort_values("hit", kind="stable")  # equal scores go by hit
            asked, hits = q["query"].tolist(), v["hit"].to_numpy()
            for i, (found, more) in enumerate(score(q, v)):
                at = leading(found, n)
                out["query"] += [asked[i]] * len(at)
                out["hit"] += hits[at].tolist()
                out["score"] += found[at].tolist()
                for c in names:
                    out[c] += more[c][at].tolist()
        return pd.DataFrame(out)

    kinds = f"query {queries.schema['query'].dataType.simpleString()}, hit {library.schema['hit'].dataType.simpleString()}, score double"
    return q.groupBy(*keys).cogroup(v.groupBy(*keys)).applyInPandas(one, ", ".join(x for x in (kinds, extra) if x))


def _dense(rows: pd.DataFrame, masses: np.ndarray, *names: str) -> list[np.ndarray]:
    """Tables of rows by masses of each of ``names``; 0 where a spectrum lacks a mass, and masses that aren't asked for are left out."""
    sizes = rows["mz"].map(len).to_numpy()
    mz = np.concatenate(rows["mz"].tolist())
    at = np.minimum(np.searchsorted(masses, mz), len(masses) - 1)
    known = masses[at] == mz
    row, column = np.repeat(np.arange(len(rows)), sizes)[known], at[known]
    out = []
    for c in names:
        table = np.zeros((len(rows), len(masses)))
        table[row, column] = np.concatenate(rows[c].tolist())[known]
        out.append(table)
    return out


def _ratios(iu: np.ndarray, iv: np.ndarray, there: np.ndarray) -> np.ndarray:
    """Sum of :func:`ratio_score`'s ratios of one query with every library spectrum; ``iv`` and ``there`` (above 0): its ions by spectra."""
    total = np.zeros(iv.shape[1])
    last, r, low = np.full_like(total, 1e-300), np.empty_like(total), np.empty_like(total)
    for k in range(len(iu)):
        np.divide(iv[k], iu[k], out=r)
        np.minimum(r, last, out=low)  # 0 where the spectrum lacks the ion
        np.maximum(r, last, out=r)
        np.divide(low, r, out=low)
        total += low
        np.divide(iv[k], iu[k], out=r)
        np.copyto(last, r, where=there[k])
    return total


def block_scores(scoring: Scoring):
    """``score`` of :func:`in_blocks` for spectra (``mz``, ``u``/``v``, ``iu``/``iv``): the same numbers as :func:`scores`."""
    composite = scoring.similarity == "composite"

    def score(q: pd.DataFrame, v: pd.DataFrame):
        masses = np.unique(np.concatenate(q["mz"].tolist()))
        vv = np.array([float(np.dot(x, x)) for x in v["v"]])
        step = max(1, CELLS // len(masses))
        parts = [_dense(v.iloc[a : a + step], masses, "v", "iv") for a in range(0, len(v), step)]
        parts = [(t, np.ascontiguousarray(i.T), np.ascontiguousarray(i.T > 0)) for t, i in parts] if composite else [(t, None, i > 0) for t, i in parts]
        few = max(1, CELLS // max(len(v), len(masses)))
        for a in range(0, len(q), few):
            own = q.iloc[a : a + few]
            (u,) = _dense(own, masses, "u")
            has = (u > 0).astype(float)
            dot, shared, su, sv = [], [], [], []
            for t, _, there in parts:
                mine = (there if composite else there.T).astype(float)
                dot.append(u @ t.T)
                shared.append(has @ mine)
                su.append((u * u) @ mine)
                sv.append(has @ (t * t).T)
            dot, shared, su, sv = (np.concatenate(x, 1) for x in (dot, shared, su, sv))
            keeps_u, keeps_v = scoring.unmatched in ("keep_all", "keep_experimental"), scoring.unmatched in ("keep_all", "keep_library")
            with np.errstate(divide="ignore", invalid="ignore"):
                cosine = dot / np.sqrt(((u * u).sum(1)[:, None] if keeps_u else su) * (vv[None, :] if keeps_v else sv))
                for i in range(len(own)):
                    n, found = shared[i], cosine[i]
                    if composite:
                        at = np.nonzero(u[i])[0]
                        ratios = np.concatenate([_ratios(own["iu"].iloc[i], iv[at], there[at]) for _, iv, there in parts])
                        nu = float(len(at)) if keeps_u else n
                        found = (nu * found + n * (ratios / n)) / (nu + n)
                    yield np.where(n > 0, found, -np.inf), {"shared": n.astype(np.int64)}

    return score


def vector_search(queries: DataFrame, library: DataFrame, n: int = 5, scoring: Scoring = Scoring()) -> DataFrame:
    """The ``n`` library spectra of highest score for each query: query, hit, score, shared, rank."""
    q, v = _sides(queries, library, scoring)
    return best(in_blocks(whole(q, "query", "u", "iu"), whole(v, "hit", "v", "iv"), n, block_scores(scoring), extra="shared long"), n)


# --- embeddings -------------------------------------------------------------------------------------------------------


#: Spectra from which one task learns, so that a larger library is learned by more tasks.
SENTENCES = 10_000


def ion_vectors(library: DataFrame, size: int = 32, iterations: int = 5, seed: int = 1) -> DataFrame:
    """``mz`` and its ``vector``, learned from which ions stand together in the library's spectra (skip-grams).

    A spectrum is a sentence of its ions, strongest first. The vectors are as many as there are ions, whatever the library's size.
    """
    listed = library.filter("intensity > 0").groupBy("id").agg(F.sort_array(F.collect_list(F.struct((-F.col("intensity")).alias("o"), "mz"))).alias("s"))
    sentences = listed.select(F.transform("s", lambda x: x["mz"].cast("string")).alias("ions"))
    sentences = kept(sentences)
    most = int(library.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = 1 if iterations < 2 else max(2, min(sentences.count() // SENTENCES, most))
    model = Word2Vec(vectorSize=size, minCount=1, maxIter=iterations, seed=seed, numPartitions=parts, windowSize=20, inputCol="ions", outputCol="v").fit(sentences)
    kind = library.schema["mz"].dataType
    from pyspark.ml.functions import vector_to_array

    return model.getVectors().select(F.col("word").cast(kind).alias("mz"), vector_to_array("vector").alias("vector"))


def embedded(spectra: DataFrame, vectors: DataFrame, power: float = 0.6) -> DataFrame:
    """``id`` and ``vector`` of length 1: the sum of its ions' vectors, weighted by intensity to the ``power``. Unknown ions count for nothing.

    Sums are taken dimension by dimension, so they combine before the shuffle.
    """
    weighted = spectra.filter("intensity > 0").join(F.broadcast(vectors), "mz").select("id", F.pow("intensity", F.lit(power)).alias("w"), F.posexplode("vector").alias("k", "c"))
    sums = weighted.groupBy("id", "k").agg(F.sum(F.col("w") * F.col("c")).alias("c"))
    whole = sums.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("k", "c"))).alias("s"), F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("norm"))
    return whole.filter("norm > 0").select("id", F.transform("s", lambda x: x["c"] / F.col("norm")).alias("vector"))


@dataclass(frozen=True)
class Buckets:
    """Random-projection buckets: ``tables`` of ``bits`` signs each; a query also looks where its ``flips`` weakest signs are turned."""

    tables: int = 12
    bits: int = 6
    flips: int = 3
    seed: int = 5


def _hashed(rows: DataFrame, size: int, b: Buckets, probe: bool) -> DataFrame:
    """``id``, ``vector`` and ``bucket`` (table and signs as one number), of each probe."""
    planes = np.random.default_rng(b.seed).normal(size=(b.tables * b.bits, size))
    flips = b.flips if probe else 0

    @F.pandas_udf("array<long>")
    def buckets(v: pd.Series) -> pd.Series:
        side = (np.stack(v.to_list()) @ planes.T).reshape(len(v), b.tables, b.bits)
        place = 1 << np.arange(b.bits)
        code = ((side > 0) * place).sum(2)
        weakest = np.argsort(np.abs(side), 2)[:, :, :flips]
        every = [code]
        for m in range(1, 1 << flips):
            turned = sum(place[weakest[:, :, j]] for j in range(flips) if m >> j & 1)
            every.append(code ^ turned)
        found = np.stack(every, 2) + (np.arange(b.tables) << b.bits)[None, :, None]
        return pd.Series(list(found.reshape(len(v), -1)))

    return rows.select("id", "vector", F.explode(buckets("vector")).alias("bucket"))


def _dots(q: pd.DataFrame, v: pd.DataFrame):
    """``score`` of :func:`in_blocks` for vectors."""
    table = np.stack(v["vector"].tolist()).T
    few = max(1, CELLS // len(v))
    for a in range(0, len(q), few):
        for found in np.stack(q["vector"].iloc[a : a + few].tolist()) @ table:
            yield found, {}


def near(queries: DataFrame, library: DataFrame, n: int = 5, buckets: Buckets | None = None) -> DataFrame:
    """The ``n`` embedded library spectra of highest cosine; query, hit, score, rank. Both sides: id, vector of length 1.

    Exact, block by block (:func:`in_blocks`). With ``buckets`` only spectra that share a bucket are compared: pairs are made
    distinct before they are scored exactly; every library row is in one bucket of each table.
    """
    if buckets is None:
        return best(in_blocks(queries.select(F.col("id").alias("query"), "vector"), library.select(F.col("id").alias("hit"), "vector"), n, _dots), n)
    first = library.first()
    if first is None:
        return queries.select(F.col("id").alias("query"), F.col("id").alias("hit"), F.lit(0.0).alias("score"), F.lit(1).alias("rank")).limit(0)
    size = len(first["vector"])
    q = _hashed(queries, size, buckets, True).select(F.col("id").alias("query"), "bucket").distinct()
    v = _hashed(library, size, buckets, False).select(F.col("id").alias("hit"), "bucket")
    pairs = q.join(v, "bucket").select("query", "hit").distinct()
    held = pairs.join(queries.select(F.col("id").alias("query"), F.col("vector").alias("a")), "query").join(library.select(F.col("id").alias("hit"), F.col("vector").alias("b")), "hit")
    dot = F.aggregate(F.zip_with("a", "b", lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)
    return best(held.select("query", "hit", dot.alias("score")), n)


def embedding_search(queries: DataFrame, library: DataFrame, vectors: DataFrame, n: int = 5, power: float = 0.6, buckets: Buckets | None = None) -> DataFrame:
    """Search by embedded spectra, ranked by exact cosine: all of them, or with ``buckets`` those that share one."""
    return near(embedded(queries, vectors, power), embedded(library, vectors, power), n, buckets)


def hybrid_search(queries: DataFrame, library: DataFrame, vectors: DataFrame, n: int = 5, scoring: Scoring = Scoring(), wider: int = 10, power: float = 0.6, buckets: Buckets | None = None) -> DataFrame:
    """The embedding proposes ``wider`` times ``n`` spectra for each query, the ions' score ranks them."""
    proposed = embedding_search(queries, library, vectors, n * wider, power, buckets)
    return best(scores(queries, library, scoring, proposed), n)


def search(queries: DataFrame, library: DataFrame, method: str = "vector", n: int = 5, scoring: Scoring = Scoring(), power: float = 0.6, vectors: DataFrame | None = None) -> DataFrame:
    """By method ``vector``, ``w2v`` or ``hybrid``; the latter learn the ions' vectors from the library unless they are given."""
    if method not in ("vector", "w2v", "hybrid"):
        raise ValueError(f"unknown search method {method}")
    if method == "vector":
        return vector_search(queries, library, n, scoring)
    known = ion_vectors(library) if vectors is None else vectors
    if method == "w2v":
        return embedding_search(queries, library, known, n, power)
    return hybrid_search(queries, library, known, n, scoring, power=power)


# --- direct spectra ---------------------------------------------------------------------------------------------------


def direct_spectrum(models: DataFrame, peaks: DataFrame, scans: DataFrame, on: list[str]) -> DataFrame:
    """Spectrum at each model's time: of every ion peak whose bounds hold it, the trace between its samples before and after.

    models: keys, model, rt; peaks: keys, mz, rt_apex, left, right; scans: keys, mz, rt, intensity. Where several peaks of an
    ion hold the time, they give one value, as a trace has one; outside a trace its first or last sample counts. The
    traces are merged with the asked times and looked up by window.
    """
    from .joins import interval_join

    spans = peaks.select(*on, "mz", "left", "right").filter(F.col("left") <= F.col("right"))
    width = spans.agg(F.avg(F.col("right") - F.col("left"))).first()[0]
    # peaks of an ion that overlap are one stretch, so that a model meets an ion once
    merged = islands(spans, [*on, "mz"], "left", "right", 0.0, "right").groupBy(*on, "mz", "island").agg(F.min("left").alias("left"), F.max("right").alias("right")).drop("island")
    asked = interval_join(models.select(*on, "model", F.col("rt").alias("at")).distinct(), merged, "at", "left", "right", on, width=width).select(*on, "mz", "model", "at")
    point = F.struct(F.col("rt").alias("x"), F.col("intensity").alias("y"))
    traces = scans.select(*on, "mz", F.col("rt").alias("at"), point.alias("p"), F.lit(None).cast(asked.schema["model"].dataType).alias("model"))
    both = traces.unionByName(asked.withColumn("p", F.lit(None).cast(traces.schema["p"].dataType)))
    w = Window.partitionBy(*on, "mz").orderBy("at", F.col("p").isNull())  # a sample at the very time is before it
    before = F.last("p", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = ahead(F.col("p"), [*on, "mz"], "at", F.col("p").isNull(), rows=0)
    found = both.withColumn("b", before).withColumn("a", after).filter("p is null")
    lerp = F.col("b.y") + (F.col("a.y") - F.col("b.y")) * (F.col("at") - F.col("b.x")) / (F.col("a.x") - F.col("b.x"))
    value = F.when(F.col("b").isNull(), F.col("a.y")).when(F.col("a").isNull() | (F.col("a.x") == F.col("b.x")), F.col("b.y")).otherwise(lerp)
    return found.select(*on, "model", F.col("at").alias("rt"), "mz", value.alias("intensity")).filter("intensity is not null")
