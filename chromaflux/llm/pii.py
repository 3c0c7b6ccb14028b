"""Personal data in texts: patterns propose spans, checksums confirm them, words nearby adjust the score.

DataFrame functions only. Nothing is shuffled: each text is judged on its own, so no key can be hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import texts
from .spans import count_of, find, let, ordered, pieces, running, said

# fixed values: the patterns of the four base kinds. Possessive quantifiers and the look-behind change no match;
# they keep long runs of digits or letters from being read again from each of their characters.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)(?![A-Za-z0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"

BASE = ("email", "ip", "card", "phone")
#: Words that make a kind likelier where they stand within ``NEAR`` code points before the span.
CONTEXT = {
    "email": "mail|contact|write|address",
    "ip": "ip|host|server|address|login",
    "card": "card|visa|credit|debit|amex|master|pay",
    "phone": "phone|tel|call|mobile|fax|contact",
    "iban": "iban|bank|account|transfer|konto",
    "ssn": "ssn|social|security|insurance",
}
NEAR = 48
#: Score of a span before its context: a checksum says more than a shape.
CONFIRMED, SHAPED, NEARBY = 0.85, 0.6, 0.15


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    value = lambda c: F.ascii(c) - 48
    doubled = lambda d: F.when(d > 4, d * 2 - 9).otherwise(d * 2)
    every = F.split(F.reverse(number), "")
    total = F.aggregate(F.transform(every, lambda c, i: F.when(i % 2 == 1, doubled(value(c))).otherwise(value(c))), F.lit(0), lambda a, x: a + x)
    return total % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether a bank account number passes ISO 7064 mod-97: its first four characters go last, letters count 10 to 35, and 1 must remain."""
    turned = F.concat(F.substring(iban, 5, 64), F.substring(iban, 1, 4))
    step = lambda a, c: F.when(c >= "A", (a * 100 + F.ascii(c) - 55) % 97).otherwise((a * 10 + F.ascii(c) - 48) % 97)
    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), step) == 1


def _card(x: Column) -> Column:
    d = digits(x)
    return F.length(d).between(14, 19) & F.coalesce(F.when(F.length(d).between(14, 19), luhn(d)), F.lit(False))


def _ip(x: Column) -> Column:
    return F.forall(F.split(x, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", "").rlike(r"^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))


def _iban(x: Column) -> Column:
    return mod97(F.regexp_replace(x, " ", ""))


def _finders(text: Column) -> list[Column]:
    return [
        find(text, "email", 0, "@", EMAIL, lambda x: F.lit(True)),
        find(text, "ip", 1, r"[0-9]\.[0-9]++\.[0-9]", IP, _ip),
        find(text, "card", 2, r"[0-9](?:[\x20-]?[0-9]){13}", CARD, _card),
        find(text, "phone", 3, r"\+[0-9]", PHONE, lambda x: F.length(digits(x)).between(10, 15)),
        find(text, "iban", 4, r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]", IBAN, _iban),
        find(text, "ssn", 5, r"[0-9]{3}-[0-9]{2}-[0-9]{4}", SSN, lambda x: ~x.rlike(r"^(?:000|666|9)|-00-|-0000$")),
    ]


def scored(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text`` and ``found``: array of (start, rank, kind, end, value, score), by start and kind.

    A null text is empty and has no spans; repeated rows are judged each on its own; an empty table gives no rows.
    """
    spans = ordered(*_finders(F.col("text")))
    with_spans = texts(docs).select("doc_id", "text", spans.alias("raw"))
    ahead = lambda s: F.struct(F.greatest(s["start"] - NEAR, F.lit(0)).alias("begin"), s["start"].alias("end"))
    zipped = F.arrays_zip(F.col("raw").alias("s"), pieces(F.col("text"), F.transform("raw", ahead)).alias("before"))

    def judge(x: Column) -> Column:
        s, before = x["s"], F.lower(x["before"])
        words = F.lit(False)
        for kind, near in CONTEXT.items():
            words = words | ((s["kind"] == kind) & before.rlike(rf"(?:^|[^a-z])(?:{near})"))
        score = F.when(s["kind"].isin("card", "iban"), CONFIRMED).otherwise(SHAPED) + F.when(words, NEARBY).otherwise(0.0)
        return F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["kind"].alias("kind"), s["end"].alias("end"), s["value"].alias("value"), score.alias("score"))

    return with_spans.select("doc_id", "text", F.transform(zipped, judge).alias("found"))


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with each span replaced by ``[kind]``; of overlapping spans the first counts, and what a later one covers beyond it goes too.

    All columns stay; ``n_chars``, where there is one, follows the new text. A null text stays null.
    """
    held = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    held = held.select("row", "text", ordered(*_finders(F.col("text"))).alias("spans"))
    text = F.col("text")

    def clean(spans: Column) -> Column:
        ends = running(F.transform(spans, lambda s: s["end"]), F.greatest)
        return let(ends, lambda e: joined(spans, e))

    def joined(spans: Column, ends: Column) -> Column:
        begin = lambda i: F.when(i > 0, F.get(ends, i - 1)).otherwise(0)
        cuts = F.transform(spans, lambda s, i: F.struct(begin(i).alias("begin"), F.greatest(begin(i), s["start"]).alias("end")))
        tail = F.struct(F.array_max(ends).alias("begin"), F.length(text).alias("end"))
        kinds = F.transform(spans, lambda s, i: F.when(s["start"] >= begin(i), F.concat(F.lit("["), s["kind"], F.lit("]"))).otherwise(""))
        return F.array_join(F.zip_with(pieces(text, F.concat(cuts, F.array(tail))), F.concat(kinds, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")

    new = F.when(F.col("row.text").isNull(), F.lit(None).cast("string")).when(F.size("spans") == 0, text).otherwise(let(F.col("spans"), clean))
    out = held.select("row", "spans", new.alias("new"))
    changed = {"text": F.col("new")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        changed["n_chars"] = F.when(F.size("spans") == 0, F.col("row.n_chars")).otherwise(F.length("new").cast(kind))
    return out.select(*(changed.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))


def op9_pii(docs: DataFrame) -> DataFrame:
    """Digest per document: counts and hash of the base spans, all spans, and the highest score."""
    found = F.col("found")
    base = F.filter(found, lambda s: s["kind"].isin(*BASE))
    return scored(docs).select(
        "doc_id",
        *(count_of(found, k).alias(f"n_{k}") for k in BASE),
        F.sha2(said(base), 256).alias("base_sha256"),
        said(found).alias("spans"),
        F.coalesce(F.array_max(F.transform(found, lambda s: s["score"])), F.lit(0.0)).alias("max_score"),
    )
