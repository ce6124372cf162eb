"""The fuzzy rank of entries against a plain version, on names that hit each tier."""

import random

from pyspark.sql import functions as F

from foliospark.functions.text import fuzzy_score
from foliospark.operators import tree


def greedy(query, text, word_bonus):
    at = streak = points = 0
    for i, c in enumerate(text):
        if at < len(query) and c == query[at]:
            bonus = 15 if word_bonus and (i == 0 or text[i - 1] in " -_/.") else 0
            points += 10 + 5 * streak + bonus
            at, streak = at + 1, streak + 1
        else:
            streak = 0
    return max(points - len(text.encode()) // 20, 0) if at == len(query) else None


def plain(query, name, path, is_dir):
    q, low = query.strip().lower(), name.lower()
    extra = 5 if is_dir else 0
    if not q:
        return 0
    if low == q:
        return 1000 + extra
    if low.startswith(q):
        return 800 + 4 * len(q.encode()) + extra
    by_name = greedy(q, low, True)
    if by_name is not None:
        return 400 + by_name + extra
    by_path = greedy(q, path.lower(), False)
    return None if by_path is None else 150 + by_path


def test_equals_the_plain_version(spark):
    made = random.Random(7)
    word = lambda most: "".join(made.choice("abAB-_ .é") for _ in range(made.randint(0, most)))
    rows = [(i, word(12), made.random() < 0.5) for i in range(250)] + [(250, "ab", True), (251, "AB", False), (252, "abba", True), (253, "x" * 50 + "ab", False), (254, "", False)]
    rows = [(i, name, f"/{word(30)}/{name}", is_dir) for i, name, is_dir in rows]
    df = spark.createDataFrame(rows, "i int, name string, path string, is_dir boolean")
    queries = ["ab", " AB ", "a-b", "é", "bab", "zz", "", "ab.ab"]
    got = df.select("i", *[fuzzy_score(q, F.col("name"), F.col("path"), F.col("is_dir")).alias(f"q{n}") for n, q in enumerate(queries)]).collect()
    want = {(i, n): plain(q, name, path, is_dir) for i, name, path, is_dir in rows for n, q in enumerate(queries)}
    assert {(r["i"], n): r[f"q{n}"] for r in got for n in range(len(queries))} == want
    tiers = {(v or 0) // 50 for v in want.values()}
    assert {0, 3, 8, 16, 20} <= tiers


def test_ranked_search_keeps_the_best(spark):
    rows = [("d", "", "abba", tree.FOLDER), ("e", "d", "ab", tree.DOCUMENT), ("f", "d", "AB", tree.DOCUMENT), ("g", "d", "other", tree.DOCUMENT), ("h", "d", "zzz", tree.TEMPLATE), ("i", "", "none", tree.DOCUMENT)]
    walked = tree.walk(spark.createDataFrame(rows, "id string, parent_id string, name string, type string"))
    got = tree.ranked_search(walked, "ab", 3).collect()
    assert [(r["name"], r["score"]) for r in got][-1] == ("abba", 813) and sorted(r["name"] for r in got[:2]) == ["AB", "ab"]
    assert {r["id"] for r in tree.ranked_search(walked, "ab").collect()} == {"d", "e", "f", "g"}
