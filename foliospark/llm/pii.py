"""Personal data: regular expressions propose, checksums confirm, context words adjust.

Everything is a DataFrame expression. Positions come from the text between matches (``split``)
and the matches (``regexp_extract_all``), which together tile the text.

The patterns are written so that the JVM's matcher neither recurses nor rescans a run of
characters from each of its positions: runs are possessive, and a match may begin only where the
previous one ended or where a run begins. They find the same spans as the plain forms
given in ``PLAIN``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import running_totals

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn")

#: The definitions, for tests and SQL.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?",
    "ssn": r"[0-9]+-[0-9]+-[0-9]+",
}
PATTERN = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": PLAIN["iban"],
    "ssn": r"(?:\G|(?<![0-9]))[0-9]++-[0-9]++-[0-9]++",
}
#: Prior belief in a confirmed span, and the words near it that raise the belief by CONTEXT_GAIN.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.3}
CONTEXT = {
    "email": "mail|contact|write",
    "ip": "address|host|server|login",
    "card": "card|visa|credit|payment|carte|karte|tarjeta",
    "phone": "phone|call|tel|mobile|fax",
    "iban": "iban|account|bank|konto|compte|cuenta",
    "ssn": "ssn|social|security",
}
CONTEXT_GAIN = 0.3
CONTEXT_CHARS = 40
#: Kinds that the method adds count only from this belief on; base kinds always count.
THRESHOLD = 0.5

def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def value(i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == 0, d).otherwise(twice - F.when(twice > 9, 9).otherwise(0))

    places = F.sequence(F.lit(0), F.length(digits) - 1)
    return F.aggregate(places, F.lit(0), lambda acc, i: acc + value(i)) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN (no spaces) leaves 1 when its rearranged number is divided by 97."""
    moved = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4))

    def step(acc: Column, c: Column) -> Column:
        letter = F.ascii(c) - 55
        return F.when(c.rlike("[0-9]"), (acc * 10 + c.try_cast("int")) % 97).otherwise((acc * 100 + letter) % 97)

    return F.aggregate(F.split(moved, ""), F.lit(0), lambda acc, c: F.when(c == "", acc).otherwise(step(acc, c))) == 1


def _confirmed(kind: str, match: Column) -> Column:
    if kind == "ip":
        small = lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(0)) <= 255)
        return F.forall(F.split(match, r"\."), small)
    if kind == "card":
        n = F.length(_digits(match))
        return F.when(n.between(14, 19), luhn(_digits(match))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(match)).between(10, 15)
    if kind == "iban":
        bare = F.replace(match, F.lit(" "), F.lit(""))
        return F.when(F.length(bare).between(15, 34), mod97(bare)).otherwise(False)
    if kind == "ssn":
        return match.rlike("^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$")
    return F.lit(True)


def _score(kind: str, text: Column, start: Column, end: Column) -> Column:
    """Prior plus the gain if a context word stands within CONTEXT_CHARS of the span."""
    before = F.substring(text, F.greatest(start - CONTEXT_CHARS, F.lit(0)).cast("int") + 1, F.least(start, F.lit(CONTEXT_CHARS)).cast("int"))
    after = F.substring(text, end.cast("int") + 1, F.lit(CONTEXT_CHARS))
    near = F.concat(before, F.lit(" "), after).rlike(rf"(?i)\b(?:{CONTEXT[kind]})")
    return F.least(F.lit(PRIOR[kind]) + F.when(near, CONTEXT_GAIN).otherwise(0.0), F.lit(1.0))


def _spans(kind: str, text: Column) -> Column:
    """array<struct<start,rank,end,kind,score>> of one kind, in text order."""
    found = F.regexp_extract_all(text, F.lit(PATTERN[kind]), F.lit(0))
    between = F.split(text, PATTERN[kind], -1)
    steps = F.zip_with(
        F.transform(F.slice(between, F.lit(1), F.size(found)), lambda x: F.length(x).cast("bigint")),
        F.transform(found, lambda x: F.length(x).cast("bigint")),
        lambda gap, size: gap + size,
    )
    placed = F.zip_with(
        found,
        running_totals(steps),
        lambda m, end: F.struct(m.alias("m"), (end - F.length(m)).alias("start"), end.alias("end")),
    )
    good = F.filter(placed, lambda s: _confirmed(kind, s["m"]))
    shaped = F.transform(
        good,
        lambda s: F.struct(
            s["start"].alias("start"),
            F.lit(KINDS.index(kind)).alias("rank"),
            s["end"].alias("end"),
            F.lit(kind).alias("kind"),
            _score(kind, text, s["start"], s["end"]).alias("score"),
        ),
    )
    kept = shaped if kind in BASE else F.filter(shaped, lambda s: s["score"] >= THRESHOLD)
    empty = F.array().cast("array<struct<start:bigint,rank:int,end:bigint,kind:string,score:double>>")
    # most texts have no confirmed match: only the others pay for positions
    return F.when(F.exists(found, lambda m: _confirmed(kind, m)), kept).otherwise(empty)


def _joined(spans: Column, with_score: bool = False) -> Column:
    def one(s: Column) -> Column:
        parts = [s["kind"], s["start"].cast("string"), s["end"].cast("string")]
        return F.concat_ws(":", *parts, *([F.round(s["score"], 2).cast("string")] if with_score else []))

    return F.array_join(F.transform(spans, one), ",")


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, text and ``found``: array of {start, rank, end, kind, score}, sorted by start.

    Offsets are code points, end exclusive. Null text is empty text; empty texts have no spans.
    Rows are taken one by one, so repeated rows and null doc_ids give a row each. An empty table
    gives an empty result. Only doc_id and text are read.
    """
    text = F.coalesce("text", F.lit(""))
    base = docs.select("doc_id", text.alias("text"))
    spans = [_spans(k, F.col("text")) for k in KINDS]
    return base.select("doc_id", "text", F.array_sort(F.concat(*spans)).alias("found"))


def pii_report(docs: DataFrame) -> DataFrame:
    """Per document: counts of the base kinds, their digest, all spans, and the scores."""
    found = find_pii(docs).drop("text")
    base = F.filter("found", lambda s: s["rank"] < len(BASE))

    def count(kind: str) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *[count(k) for k in BASE],
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.col("found")).alias("spans"),
        _joined(F.col("found"), with_score=True).alias("scores"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """doc_id and text with every span replaced by [KIND]; overlapping spans are replaced once."""
    found = find_pii(docs)
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(F.col("text"), acc["at"].cast("int") + 1, F.greatest(s["start"] - acc["at"], F.lit(0)).cast("int"))
        return F.when(s["start"] < acc["at"], acc).otherwise(
            F.struct(s["end"].alias("at"), F.concat(acc["out"], gap, F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("out"))
        )

    done = F.aggregate("found", start, step)
    rest = F.substring(F.col("text"), done["at"].cast("int") + 1, F.length("text"))
    return found.select("doc_id", F.concat(done["out"], rest).alias("text"))


