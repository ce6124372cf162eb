"""Language identification: averaged hashed subword embeddings and a linear softmax.

Byte n-grams of the lower-cased text are hashed into buckets, a text is the average of its
buckets' embeddings, and a softmax layer on the average gives the language. Both layers are
trained here by stochastic gradient descent in numpy on a bounded sample of labelled rows. A
temperature fitted on rows set aside calibrates the scores; below ``reject_below`` a text is rejected.

For prediction the two layers are multiplied out: a table of one row of class scores a bucket
goes to the executors (BUCKETS * languages floats: 256 KB a language, however many rows there are).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import small_batches

BUCKETS = 1 << 16
DIMENSIONS = 16
NGRAMS = (2, 3, 4)
#: The training sample: about ROWS_PER_LANGUAGE rows of each language, of a longer text a passage of SAMPLE_CHARS characters
#: from a place that its hash names.
ROWS_PER_LANGUAGE = 600
SAMPLE_CHARS = 20_000
EPOCHS = 4
RATE = 0.5
UNKNOWN = "und"
REJECT_BELOW = 0.5

_BLANK = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
_PAD = max(NGRAMS)
_SLICE_CELLS = 1 << 22
#: So many characters of texts are scored at once.
_PART_CHARS = 1 << 20


@dataclass(frozen=True)
class Model:
    """languages, and the class scores of every bucket (bias included) with the temperature applied."""

    languages: tuple[str, ...]
    scores: np.ndarray


def has_letter(text: str | None) -> bool:
    """Digits and number signs in any script, marks and punctuation are no letters."""
    return bool(text) and any(map(str.isalpha, text))


def _buffer(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' lower-cased bytes between blanks, and where each begins."""
    parts = [b" " + t.lower().encode().translate(_BLANK) + b" " * _PAD for t in texts]
    starts = np.zeros(len(parts), np.int64)
    np.cumsum([len(p) for p in parts[:-1]], out=starts[1:])
    return np.frombuffer(b"".join(parts) + b" " * _PAD, np.uint8), starts


def _buckets(raw: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n, the bucket of the n-gram at every place of ``raw`` (less the pad), and whether it counts."""
    size = len(raw) - _PAD
    wide = raw.astype(np.uint32)
    h = wide[:size].copy()
    inside = (raw[:size] != 32) | (raw[1 : size + 1] != 32)
    for n in range(2, _PAD + 1):
        h = h * np.uint32(0x01000193) + wide[n - 1 : n - 1 + size]
        if n in NGRAMS:
            mixed = (h ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
            yield (mixed >> np.uint32(16)) % np.uint32(BUCKETS), inside


def class_sums(texts: list[str], table: np.ndarray) -> np.ndarray:
    """Per text the sums of its n-grams' rows of ``table``; the whole text counts."""
    raw, starts = _buffer(texts)
    sums = np.zeros((len(texts), table.shape[1]), np.float64)
    step = _SLICE_CELLS // table.shape[1]
    for at in range(0, len(raw) - _PAD, step):
        part = raw[at : at + step + _PAD]
        first = np.searchsorted(starts, at, "right") - 1
        last = np.searchsorted(starts, at + len(part) - _PAD, "left")
        cuts = np.maximum(starts[first:last] - at, 0)
        for ids, counts in _buckets(part):
            rows = table[ids] * counts[:, None]
            sums[first:last] += np.add.reduceat(rows, cuts, axis=0)
    return sums


def _parts(numbers: list[int], texts: list[str]) -> Iterator[list[int]]:
    """The numbers of texts in runs of some _PART_CHARS characters."""
    part, size = [], 0
    for i in numbers:
        part.append(i)
        size += len(texts[i])
        if size >= _PART_CHARS:
            yield part
            part, size = [], 0
    if part:
        yield part


def _features(text: str) -> tuple[np.ndarray, np.ndarray]:
    raw, _ = _buffer([text])
    ids = np.concatenate([i[c] for i, c in _buckets(raw)]) if len(raw) else np.zeros(0, np.uint32)
    found, n = np.unique(ids, return_counts=True)
    return found, n / max(1, n.sum())


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def train(rows: list[tuple[str, str]], seed: int = 7) -> Model:
    """Fit the model on (text, language) rows; a tenth of them is set aside for the temperature.

    Each text is used whole, and once more as a short passage from a random place, so that
    short texts are met in training. No rows or one language give a model of what there is.
    """
    languages = tuple(sorted({lang for _, lang in rows})) or (UNKNOWN,)
    rng = np.random.default_rng(seed)
    number = {lang: i for i, lang in enumerate(languages)}
    seen = []
    for k, (text, lang) in enumerate(rows):
        words = text.split()
        at = int(rng.integers(0, max(1, len(words) - 10)))
        short = " ".join(words[at : at + int(rng.integers(2, 25))])
        seen += [(k % 10 == 9, *_features(t), number[lang]) for t in (text, short) if has_letter(t)]
    emb = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS))
    out = np.zeros((DIMENSIONS, len(languages)))
    fit = [s for s in seen if not s[0]]
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for j in rng.permutation(len(fit)):
            _, ids, share, y = fit[j]
            mean = share @ emb[ids]
            grad = _softmax(mean @ out)
            grad[y] -= 1
            back = out @ grad
            out -= rate * np.outer(mean, grad)
            emb[ids] -= rate * 20 * share[:, None] * back
    table = emb @ out
    kept = [(share @ table[ids], y) for held, ids, share, y in seen if held]
    best = 1.0
    if kept:
        z, y = np.array([a for a, _ in kept]), np.array([b for _, b in kept])
        losses = {t: -np.log(_softmax(z * t)[np.arange(len(y)), y] + 1e-12).mean() for t in (0.25, 0.5, 0.75, 1, 1.5, 2, 3, 4)}
        best = min(losses, key=losses.get)
    return Model(languages, (table * best).astype(np.float32))


def labelled_sample(docs: DataFrame, usable: Column) -> list[tuple[str, str]]:
    """A bounded sample of (text, lang) rows for training, spread over all languages by the rows' hashes.

    Every value of lang is learned, null ones are not; null texts teach nothing.
    """
    rows = docs.select("doc_id", "text", "lang").filter(usable & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return []
    langs = sorted(counts)
    least = F.map_from_arrays(
        F.array(*map(F.lit, langs)), F.array(*[F.lit(int(1e6 * min(1, ROWS_PER_LANGUAGE / counts[lang])) + 1) for lang in langs])
    )
    place = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_000))
    room = F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(0)) + 1
    passage = F.substring("text", F.pmod(F.xxhash64("doc_id", F.lit("place")), room).cast("int") + 1, F.lit(SAMPLE_CHARS))
    chosen = rows.filter(place < F.element_at(least, F.col("lang"))).select(passage.alias("text"), "lang")
    found = chosen.limit(2 * ROWS_PER_LANGUAGE * len(counts)).collect()  # the hash may deal a few more rows than aimed at
    return sorted((r["text"], r["lang"]) for r in found)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` under row, and lang_pred, score, rejected.

    lang_pred is a learned language, or ``und`` with score 0 where the text is null or has no
    letter; rejected where it is ``und`` or the calibrated score is below REJECT_BELOW. Whole texts are
    read, only text is looked at, rows are taken one by one; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = "lang_pred string, score double, rejected boolean"

    def guess(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = shared.value
        extended = np.hstack([own.scores, np.ones((BUCKETS, 1), np.float32)])
        for batch in texts:
            found = batch.to_pylist()
            named = [i for i, t in enumerate(found) if has_letter(t)]
            langs, scores = [UNKNOWN] * len(found), np.zeros(len(found))
            for part in _parts(named, found):
                sums = class_sums([found[i] for i in part], extended)
                chance = _softmax(sums[:, :-1] / np.maximum(1, sums[:, -1:]))
                for i, p in zip(part, chance, strict=True):
                    langs[i], scores[i] = own.languages[int(p.argmax())], float(p.max())
            reject = [lang == UNKNOWN or s < REJECT_BELOW for lang, s in zip(langs, scores, strict=True)]
            yield pa.StructArray.from_arrays(
                [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(reject, pa.bool_())],
                ["lang_pred", "score", "rejected"],
            )

    small_batches(docs.sparkSession)
    guessed = F.arrow_udf(guess, schema)(F.col("text"))
    return docs.select(F.struct("*").alias("row"), guessed.alias("guess")).select("row", "guess.*")


def held_out() -> Column:
    """Whether a row is set aside from all learning: crc32(doc_id as text) mod 4 is 2; never a null id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected: trained on the labelled rows not held out."""
    model = train(labelled_sample(docs, ~held_out()))
    return predict(docs.select("doc_id", held_out().alias("held_out"), "text"), model).select(
        "row.doc_id", "row.held_out", "lang_pred", "score", "rejected"
    )


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose language is not rejected, all columns, whatever their names.

    Rows without letters (null and empty texts among them) are rejected, so is every row where no labelled row teaches
    a language; repeated rows share one fate; an empty table stays empty.
    """
    model = train(labelled_sample(docs, ~held_out()))
    return predict(docs, model).filter(~F.col("rejected")).select("row.*")
