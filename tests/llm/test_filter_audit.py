"""The filter audit against a plain count over all documents, orders and steps."""

import re
from itertools import permutations

import pytest

from foliospark.llm import filter_audit

DOCS = "doc_id bigint, text string, lang string"
LABELS = "doc_id bigint, quality int, toxic int"
LONG = " ".join(f"w{k}" for k in range(120))


def failed(rows):
    """The failed filters of each row, one by one."""
    found = []
    for doc_id, text, _ in rows:
        text = text or ""
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
        copies = [d for d, t, _ in rows if (t or "") == text and d is not None]
        found.append(
            "".join(
                name
                for name, fails in zip(
                    "ABCDE",
                    (
                        len(words) < 100,
                        100 * len(set(words)) < 80 * len(words),
                        100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text),
                        bool(re.search(r"[#$%&*|]", text)),
                        doc_id is not None and any(d < doc_id for d in copies),
                    ),
                    strict=True,
                )
                if fails
            )
        )
    return found


def plain(rows, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    fails = failed(rows)
    result, shapley = {}, {}
    for part in {lang or "" for *_, lang in rows}:
        mine = [(r[0], f) for r, f in zip(rows, fails, strict=True) if (r[2] or "") == part]
        for order in permutations("ABCDE"):
            left = mine
            for step, name in enumerate(order, 1):
                gone = [(d, f) for d, f in left if name in f]
                left = [(d, f) for d, f in left if name not in f]
                result[part, "".join(order), step] = [
                    len(left), len(gone), sum(name in f for _, f in mine) - len(gone), sum(f == name for _, f in mine),
                    sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone),
                ]
                shapley[part, name] = shapley.get((part, name), 0) + len(gone)
    return {(*key, *counts, shapley[key[0], key[1][key[2] - 1]]) for key, counts in result.items()}


def audited(spark, rows, labels):
    found = filter_audit.audit(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)).collect()
    assert len(found) == len({(r.part, r.filter_order, r.step) for r in found})
    return {tuple(r) for r in found}


def test_equals_plain(spark):
    rows = [
        (1, LONG, "en"), (2, LONG, "en"), (3, LONG + " # more", "fr"), (4, "Few WORDS", "en"), (5, "a " * 150, "fr"), (6, "A\x0bB\x0cC " * 60, None),
        (7, "", "en"), (8, None, ""), (9, " \t\n", "fr"), (10, "ÀÉ ÈÜ", "de"), (11, "x|y", "de"), (12, LONG.upper() + "*", "de"), (13, LONG.upper() + "*", "en"),
    ]
    labels = [(1, 1, 0), (2, 1, 1), (3, 0, 1), (4, 1, None), (4, None, 1), (12, 1, 1), (13, 1, 0), (99, 1, 1)]
    assert audited(spark, rows, labels) == plain(rows, labels)


def test_null_ids_ties_and_repeated_rows(spark):
    rows = [(None, LONG, "en"), (None, LONG, "en"), (1, LONG, "en"), (1, LONG, "en"), (2, LONG, "fr"), (2, "#", "fr"), (2, "#", "fr")]
    labels = [(None, 1, 1), (2, 1, 0), (2, 1, 0)]
    assert audited(spark, rows, labels) == plain(rows, labels)


def test_words_are_exact_at_the_bounds(spark):
    rows = [
        (1, " ".join(["w"] * 21 + [f"v{k}" for k in range(79)]), "x"), (2, " ".join(["w"] * 20 + [f"v{k}" for k in range(80)]), "x"),
        (3, " ".join(f"v{k}" for k in range(99)), "x"), (4, "A" + "b" * 9, "x"), (5, "A" + "b" * 8, "x"), (6, "Word word WORD " * 50, "x"),
    ]
    assert audited(spark, rows, []) == plain(rows, [])


def test_empty_and_clashing_columns(spark):
    assert filter_audit.audit(spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)).count() == 0
    docs = spark.createDataFrame([(1, "a", "en", 1, "x", True)], DOCS + ", failed int, digest string, good boolean")
    labels = spark.createDataFrame([(1, 1, 1, 5, "y")], LABELS + ", part int, text string")
    assert filter_audit.audit(docs, labels).count() == 600


@pytest.mark.parametrize("words", [300_000])
def test_very_long_text_and_hot_copies(spark, words):
    rows = [(1, " ".join(f"w{k % 9}" for k in range(words)), "en")] + [(k, LONG, "en") for k in range(2, 120)]
    assert audited(spark, rows, []) == plain(rows, [])


def test_shapley_shares_add_up(spark):
    """Over the five filters the shares are 120 times the documents removed by all."""
    rows = [(k, ("w " * (k % 140)) + ("#" if k % 3 else "") + ("AB" * (k % 5)), "en") for k in range(60)]
    one = [r for r in audited(spark, rows, []) if r[1] == "ABCDE"]
    assert sum(r[-1] for r in one) == 120 * (60 - min(r[3] for r in one))
