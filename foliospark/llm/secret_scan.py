"""Secrets by one combined automaton: all rules in a single pass over the bytes of the texts."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.llm.automaton import BREAK, Automaton
from foliospark.llm.common import small_batches


def _any_match(match: bytes) -> bool:
    return True


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its pattern, its least length, and a check; both drop matches without a second try.

    Lengths are checked after the scan, not counted by the automaton: counters of several rules
    that run at once would multiply its states.
    """

    kind: str
    pattern: str
    least: int = 0
    check: Callable[[bytes], bool] = _any_match


_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
_ASSIGN_BYTES = re.compile(_ASSIGN.encode())


def _long_value(match: bytes) -> bool:
    found = _ASSIGN_BYTES.fullmatch(match)
    return found is not None and len(found[1]) >= 6


def _long_parts(match: bytes) -> bool:
    return all(len(part) >= 8 for part in match.split(b"."))


BASE_RULES = (
    Rule("assign", _ASSIGN, check=_long_value),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]{8,}", 24),
)
#: What the method adds.
MORE_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 15),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", check=_long_parts),
    Rule("stripe", r"sk_live_[A-Za-z0-9]+", 24),
    Rule("private_key", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----"),
)
RULES = BASE_RULES + MORE_RULES
BATCH_BYTES = 8 << 20


@lru_cache(maxsize=4)
def automaton(rules: tuple[Rule, ...]) -> Automaton:
    """The rules' automaton."""
    return Automaton([r.pattern for r in rules])


def _resolve(machine: Automaton, k: int, rule: Rule, text: bytes, ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """Spans of one rule in a text from the places where matches end: leftmost, longest, not overlapping."""
    free = 0
    for last in ends.tolist():
        if last < free:
            continue
        back = machine.backward[k].furthest(text[i] for i in range(last, free - 1, -1))
        if back < 0:
            continue
        start = last + 1 - back
        end = start + machine.forward[k].furthest(text[i] for i in range(start, len(text)))
        free = end
        if end - start >= rule.least and rule.check(text[start:end]):
            yield start, end


def spans_of(
    texts: list[bytes], rules: tuple[Rule, ...] = RULES, machine: Automaton | None = None
) -> list[list[tuple[int, int, int]]]:
    """Per text (start, rule number, end) in code points, sorted."""
    machine = machine or automaton(rules)
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    data = np.frombuffer(bytes([BREAK]).join(texts), np.uint8)
    if not len(data):
        return found
    flags = machine.scan(data)
    starts = np.zeros(len(texts), np.int64)
    np.cumsum([len(t) + 1 for t in texts[:-1]], out=starts[1:])
    hits = np.flatnonzero(flags)
    owner = np.searchsorted(starts, hits, "right") - 1
    for i in np.unique(owner).tolist():
        own = hits[np.searchsorted(owner, i) : np.searchsorted(owner, i, "right")]
        sets, local, text = flags[own], own - starts[i], texts[i]
        seen = {n: machine.accepted[n] for n in np.unique(sets).tolist()}
        spans = [
            (s, k, e)
            for k in sorted({k for ks in seen.values() for k in ks})
            for s, e in _resolve(machine, k, rules[k], text, local[np.isin(sets, [n for n, ks in seen.items() if k in ks])])
        ]
        if spans and not text.isascii():
            points = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
            spans = [(int(points[s]), k, int(points[e])) for s, k, e in spans]
        found[i] = sorted(spans)
    return found


def _batches(texts: list[bytes]) -> Iterator[list[bytes]]:
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= BATCH_BYTES:
            yield part
            part, size = [], 0
    if part:
        yield part


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and found: array of {kind, start, end}, sorted by start, then by the rules' order.

    Offsets are code points, end exclusive. Whole texts are scanned; null text is empty and has no
    spans. A rule's spans do not overlap; spans of different rules may. Rows are taken one
    by one, so repeated rows and null doc_ids get a row each; an empty table gives none. Only doc_id
    and text are read.
    """
    schema = "array<struct<kind:string,start:bigint,end:bigint>>"
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    # compiled once, on the driver; the arrays' size depends on the rules alone (some hundred KB)
    shared = docs.sparkSession.sparkContext.broadcast(automaton(rules))

    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            texts = [t.encode() if t else b"" for t in batch.to_pylist()]
            spans = [s for part in _batches(texts) for s in spans_of(part, rules, shared.value)]
            rows = [[{"kind": rules[k].kind, "start": a, "end": b} for a, k, b in own] for own in spans]
            yield pa.array(rows, kind)

    small_batches(docs.sparkSession)
    return docs.select("doc_id", F.arrow_udf(scan, schema)(F.col("text")).alias("found"))


def _joined(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def secret_report(docs: DataFrame) -> DataFrame:
    """Per document: counts of the base kinds, the digest of their spans, and all spans."""
    kinds = [r.kind for r in BASE_RULES]

    def count(kind: str) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    base = F.filter("found", lambda s: s["kind"].isin(kinds))
    return find_secrets(docs).select(
        "doc_id", *[count(k) for k in kinds], F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans")
    )
