"""op11: damage, shortest paths against exhaustive search, and conversations that ranges cut."""

import hashlib
import random
import re
import zlib
from itertools import product

import pytest

from chromaflux.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string"
LEGAL = re.compile(r"(s?(ua)+)?")


def plain_damage(rows):
    """The conversations after damage, in order, by a plain loop."""
    out = {}
    for conv, turn, role, text in rows:
        kept = out.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        kept += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return {c: sorted(x, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for c, x in out.items()}


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        body = text.strip("\t\n\v\f\r ")
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def search(rows, found, inserts=4):
    """(cost, audit, repaired lines) by trying every edit string with its roles."""
    best = None
    options = []
    for (_, role, text), fault in zip(rows, found, strict=True):
        extra, here = 3 * (fault == "truncated"), [(4, "D", None)]
        if fault not in ("blank", "duplicate"):
            here += [(extra, "K", (role, text)), (3 + extra, "R", ("user", text)), (3 + extra, "R", ("assistant", text))]
        options.append(here)
    inserted = [[()], [("user",), ("assistant",)], [("user", "assistant"), ("assistant", "user")]]
    places = [x for n in inserted for x in n]
    for chosen in product(*options):
        for between in product(places, repeat=len(rows) + 1):
            if sum(map(len, between)) > inserts:
                continue
            edits, lines, cost = "", [], 0
            for i in range(len(rows) + 1):
                edits += "I" * len(between[i])
                lines += [(r, "") for r in between[i]]
                cost += 3 * len(between[i])
                if i < len(rows):
                    edits, cost = edits + chosen[i][1], cost + chosen[i][0]
                    lines += [chosen[i][2]] if chosen[i][2] else []
            if LEGAL.fullmatch("".join(r[:1] or "-" for r, _ in lines)) and (best is None or (cost, edits) < best[:2]):
                best = (cost, edits, lines)
    return best


def expected(rows):
    out = {}
    for conv, turns in plain_damage(rows).items():
        found = faults(turns)
        known = [t for t, _, _ in turns if t is not None]
        roles = [r[:1] for _, r, _ in turns]
        symbols = [(r, f[:1]) for r, f in zip(roles, found, strict=True)]
        cost, audit = repair.cheapest(symbols)
        lines = [f"{r}:{t}" for _, r, t in repair.mended(audit, [(r, t, 1) for _, r, t in turns])]
        out[conv] = (
            max(known) - min(known) + 1 - len(set(known)) if known else 0, *(found.count(k) for k in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:], strict=False)), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


def got(df):
    rows = df.collect()
    assert len(rows) == len({r.conv_id for r in rows})
    return {r.conv_id: tuple(r)[1:] for r in rows}


@pytest.mark.parametrize("seed", range(12))
def test_edits_are_those_of_exhaustive_search(seed):
    r = random.Random(seed)
    for n in (0, 1, 2, 2, 3, 3):
        rows = [(i, r.choice(["user", "assistant", "system", "other", ""]), r.choice(["a.", "b!", "c", " ", "a."])) for i in range(n)]
        found = faults(rows)
        cost, audit = repair.cheapest([(role[:1], f[:1]) for (_, role, _), f in zip(rows, found, strict=True)])
        lines = [(role, text) for _, role, text in repair.mended(audit, [(role, text, 1) for _, role, text in rows])]
        assert (cost, audit, lines) == search(rows, found)


def test_matrices_give_what_one_walk_gives():
    r = random.Random(4)
    for n in (1, 7, 130, 700):
        symbols = [(r.choice("suaz"), r.choice(["", "", "b", "d", "t"])) for _ in range(n)]
        want = repair.ended(repair.walked(symbols))
        cuts = sorted(r.randrange(n + 1) for _ in range(5))
        parts = [symbols[a:b] for a, b in zip([0, *cuts], [*cuts, n], strict=True)]
        assert repair.ended(repair.product([repair.matrix(p) for p in parts])[0]) == want == repair.cheapest(symbols)


def conversations(seed, n, longest):
    r = random.Random(seed)
    rows = []
    for conv in [None, *range(n)]:
        for turn in range(r.randrange(1, longest)):
            turn = r.choice([turn, turn, turn, turn, None, turn + 3, -turn])
            rows.append((conv, turn, r.choice(["user", "assistant", "system", None, "x", ""]), r.choice([None, "", "Well.", "So", "  \n", "Well. ", "Ünï?", "a b!"])))
    rows += r.sample(rows, len(rows) // 5)
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("parts", [1, 13])
def test_whole_query_by_plain_loop(spark, parts):
    rows = conversations(parts, 150, 9)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        df = spark.createDataFrame(rows, SCHEMA).withColumn("copies", __import__("pyspark").sql.functions.lit("clash"))
        assert got(repair.op11_repair(df)) == expected(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_one_conversation_over_many_tasks(spark):
    r = random.Random(8)
    rows = [(7, i, r.choice(["user", "assistant"]), f"text {r.randrange(900)}{r.choice(['.', ''])}") for i in range(3000)]
    rows += [(c, i, "user", "Hi.") for c in (6, 8) for i in range(2)] + [(9, None, "user", "same.")] * 500
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", 9)
    try:
        df = spark.createDataFrame(rows, SCHEMA)
        assert got(repair.op11_repair(df)) == expected(rows)
        turns = sorted((x.position, x.edit, x.role, x.text) for x in repair.repaired(repair.damaged(df), texts=True).filter("conv_id = 7").collect())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert [t[0] for t in turns] == list(range(len(turns)))
    assert LEGAL.fullmatch("".join(t[2][0] for t in turns))
    assert hashlib.sha256("\n".join(f"{t[2]}:{t[3]}" for t in turns).encode()).hexdigest() == expected(rows)[7][-1]


def test_empty_dropped_and_long(spark):
    assert repair.op11_repair(spark.createDataFrame([], SCHEMA)).count() == 0
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    whole = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 > 4)
    rows = [(gone, 0, "user", "Hi."), (whole, 0, "user", "é" * 3_000_000 + ".")]
    out = got(repair.op11_repair(spark.createDataFrame(rows, SCHEMA)))
    assert out[gone] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert out == expected(rows)
