"""The operators without an oracle against plain versions on small fixtures."""

import random
import re
import zlib
from hashlib import sha256

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from foliospark.llm import chat, decontam, exact_dedup, langid, packing, pii, secret_scan, simhash, token_scan, tokens, warc

SF = "/root/testdata/sf0.001"
EDGE = [
    (9001, None), (9002, ""), (9003, "token=abc secret = \"abcdefg é\" AKIA" + "A" * 16 + " " + "f" * 40), (9004, "é" * 7 + " api_key: zzzzzzz"),
    (9005, "mail a.b@c.example.org or 10.0.0.256 and 10.0.0.25, +1 (555) 123-4567, 4111 1111 1111 1111"), (9006, "word " * 30_000), (9007, "A b C"), (9008, "a B c"),
    (9008, "a B c"), (None, "a b c"), (9009, "  \t "), (9010, "😀 password='hunter22'"),
]


@pytest.fixture(scope="module")
def docs(spark):
    extra = spark.createDataFrame(EDGE, "doc_id bigint, text string").selectExpr("doc_id", "text", "'x' as found", "'y' as key", "'z' as fp")
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").selectExpr("*", "'x' as found", "'y' as key", "'z' as fp").unionByName(extra).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]


def digest(spans):
    return sha256(",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(spans)).encode()).hexdigest()


def base_secrets(t):
    assign = r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    found = [(m.start(), 0, "assign", m.end()) for m in re.finditer(assign, t, re.ASCII) if len(m[1]) >= 6]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    return found + [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]


def test_secrets(docs, rows):
    got = sorted((str(r["doc_id"]), r["base_sha256"]) for r in secret_scan.secret_report(docs).collect())
    assert got == sorted((str(i), digest(base_secrets(t))) for i, t in rows)


def luhn(d):
    return sum(x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(int(c) for c in reversed(d))) % 10 == 0


def base_pii(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    ok = {
        "email": lambda s: True, "ip": lambda s: all(int(p) <= 255 for p in s.split(".")),
        "card": lambda s: 14 <= len(digits(s)) <= 19 and luhn(digits(s)), "phone": lambda s: 10 <= len(digits(s)) <= 15,
    }
    return [(m.start(), k, kind, m.end()) for k, kind in enumerate(pii.BASE) for m in re.finditer(pii.PLAIN[kind], t) if ok[kind](m[0])]


def test_pii(docs, rows):
    got = sorted((str(r["doc_id"]), r["base_sha256"]) for r in pii.pii_report(docs).collect())
    assert got == sorted((str(i), digest(base_pii(t))) for i, t in rows)


def test_packing(docs, rows):
    encode = Tokenizer.from_file(tokens.WORD_BPE)
    want, got = {}, {}
    for i, t in rows:
        ids = encode.encode(t, add_special_tokens=False).ids + [1]
        want.setdefault(i, []).append(b"".join(x.to_bytes(4, "little") for x in ids))
    pieces = packing.pack(docs).collect()
    for r in sorted(pieces, key=lambda r: (r["sequence_id"], r["start"])):
        assert r["length"] & (r["length"] - 1) == 0 and r["length"] <= 2048 and r["offset"] == 0 and zlib.crc32(r["ids"]) >= 0
        if r["start"] == 0:
            got.setdefault(r["doc_id"], []).append(b"")
        got[r["doc_id"]][-1] += r["ids"]
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert len({r["sequence_id"] for r in pieces}) == len(pieces)


def test_token_counts(spark, docs, rows, tmp_path):
    encode = Tokenizer.from_file(tokens.WORD_BPE)
    token_scan.write_token_files(docs, str(tmp_path / "t"))
    want = sorted(len(encode.encode(t, add_special_tokens=False).ids) for _, t in rows)
    for block in (1 << 20, 64):  # documents that span blocks
        assert sorted(r["n_tokens"] for r in token_scan.scan_token_files(spark, str(tmp_path / "t"), block_tokens=block).collect()) == want


def shingle_hash(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", t.translate({c: c + 32 for c in range(65, 91)}))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else ([" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash(docs, rows):
    fps = sorted({shingle_hash(t) for _, t in rows})
    root = {f: f for f in fps}

    def top(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 2:
                root[top(a)] = top(b)
    least = {}
    for i, t in rows:
        if i is not None:
            k = top(shingle_hash(t))
            least[k] = min(i, least.get(k, i))
    want = sorted((str(i), f"{shingle_hash(t):016x}", least.get(top(shingle_hash(t)))) for i, t in rows)
    assert sorted((str(r["doc_id"]), r["fingerprint"], r["component_id"]) for r in simhash.simhash_components(docs).collect()) == want


def test_ball_links(spark):
    values = [0, 1, 3, 7, 15, -1, -2, 1 << 40, (1 << 40) + (1 << 62)]
    df = spark.createDataFrame([(0, v) for v in values], "g int, v bigint")
    got = {frozenset((r["a"], r["b"])) for r in simhash.ball_links(df, "g", "v", 64, 2).collect()}
    assert all(((a ^ b) & simhash._ALL).bit_count() <= 2 for a, b in map(tuple, got))
    reach = {v: v for v in values}
    for _ in values:
        for a, b in map(tuple, got):
            reach[a] = reach[b] = min(reach[a], reach[b])
    assert len(set(reach.values())) == 2  # 1 << 40 is one bit from 0


def test_near_copies(spark):
    words = [f"w{i * i % 977}" for i in range(300)]
    near = [*words[:150], "changed", *words[151:]]
    rows = [(5, " ".join(words)), (2, " ".join(near)), (3, " ".join(f"v{i * 7 % 613}" for i in range(300))), (4, None), (6, "")]
    kept = simhash.keep_near(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 4, 6]


def kept_by_brute_force(rows):
    def grams(text):
        words = (text or "").lower().split()
        return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())

    sets, root = {i: grams(t) for i, t in rows}, {i: i for i, _ in rows}
    for i in sets:
        for j in sets:
            if i < j and sets[i] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = {k: low if r == high else r for k, r in root.items()}
    return sorted(set(root.values()))


def test_edited_copies_of_a_later_original(spark):
    rng, rows = random.Random(5), []
    for group in range(8):
        original = [f"g{group}w{rng.randrange(400)}" for _ in range(300)]
        for copy in range(9):
            words = list(original)
            for block in range(3):  # each copy has edits of its own, in blocks
                at = 33 * copy + 11 * block
                words[at : at + 6] = [f"c{copy}b{block}x{k}" for k in range(6)]
            rows.append((group * 100 + copy, " ".join(words)))
        rows.append((group * 100 + 50, " ".join(original)))
    want = kept_by_brute_force(rows)
    assert want == [group * 100 for group in range(8)]
    kept = simhash.keep_near(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == want


def test_copies_with_added_and_rewritten_passages(spark):
    rng, rows = random.Random(9), []
    for i in range(45):
        words = [f"p{i}w{rng.randrange(500)}" for _ in range(rng.randrange(150, 400))]
        other, m = list(words), len(words) - 4
        if i % 3 == 0:  # appended text, then one block, then scattered words: all close above 0.8
            other += [f"p{i}new{k}" for k in range(m // 4)]
        elif i % 3 == 1:
            at = rng.randrange(10, 60)
            other[at : at + m // 9 - 4] = [f"p{i}new{k}" for k in range(m // 9 - 4)]
        else:
            for k in range(m // 45):
                other[10 + 40 * k] = f"p{i}new{k}"
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
    want = kept_by_brute_force(rows)
    assert want == [2 * i for i in range(45)]
    kept = simhash.keep_near(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == want


def test_a_family_makes_few_rows(spark):
    rng, rows = random.Random(8), []
    original = [f"w{rng.randrange(900)}" for _ in range(150)]
    for copy in range(120):
        words = list(original)
        for k in range(copy % 5):
            words[rng.randrange(150)] = f"c{copy}x{k}"
        rows.append((copy, " ".join(words) + f" end{copy}"))
    docs, none = spark.createDataFrame(rows, "doc_id bigint, text string"), np.zeros(0, np.int64)
    wide = simhash.near_rows(docs, (none, none))
    wide = spark.createDataFrame(wide.collect(), wide.schema)
    alone = simhash._sized(spark.createDataFrame([], "a bigint, b bigint"))  # no links yet, so that all pairs are open
    prefixed = simhash.prefixes(docs, wide, alone, (none, none))
    members = simhash._mixed_tokens(prefixed.select("key", "n", "component", F.posexplode("prefix").alias("at", "token")))
    met = [(r["a"], r["b"]) for r in simhash.prefix_meetings(members, wide).collect()]
    sets = {r["key"]: simhash.shingle_set(simhash.word_hashes(rows[r["id"]][1])) for r in wide.collect()}
    similar = {(a, b) for a in sets for b in sets if a < b and simhash._jaccard(sets[a], sets[b]) >= simhash.SIMILARITY}
    assert len(similar) > 1000 and similar <= set(met)
    assert len(met) < 1.1 * len(set(met)) < 1.6 * len(similar)  # a row a pair, and few for pairs that are not similar


def test_number_dense_items(spark):
    items = ["What is 48 plus 17?", "Compute 12 + 7 * 3.", "Tom is 12 years old.", "12 km = how many m?", "What is 12 + 15 + 18 + 21 + 24 + 27 + 30?", "7 8 9"]
    moved = ["What is 31 plus 62?", "Compute 11 + 5 * 2.", "Tom is 14 years old.", "15 km = how many m?", "What is 1 + 2 + 3 + 4 + 5 + 6 + 8?", "4 5 6"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    rows = [(base + i, f"Read this first. {t} That is all there was.") for base, ts in ((0, items), (100, moved)) for i, t in enumerate(ts)]
    found = {(r["doc_id"], r["item_id"], r["verbatim"]) for r in decontam.contaminated(spark.createDataFrame(rows, "doc_id bigint, text string"), bench).collect()}
    assert found == {(i, i, True) for i in range(6)} | {(100 + i, i, False) for i in range(5)}  # any three numbers are no copy of "7 8 9"


def test_items_of_names_and_numbers_alone(spark):
    items = ["Compute 12 + 7 * 3.", "Add 1, 2, 3, 4, 5, 6, 7, 8, 9, 10 km.", "7 8 9", "Alice"]
    texts = [
        "So said they. Compute 11 + 5 * 2. That was all.", "Here it is: Add 9, 8, 7, 6, 5, 4, 3, 2, 1, 11 km. Done.",
        "So said they. Multiply 11 + 5 * 2. That was all.", "Here it is: Take 9, 8, 7, 6, 5, 4, 3, 2, 1, 11 km. Done.", "So said they. Compute 11 + 5 cm. That was all.",
        "4 5 6", "Robert", "Compute 12 + 7 * 3.",
    ]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    got = decontam.contaminated(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), bench).collect()
    assert {(r["doc_id"], r["item_id"], r["n_slots"], r["n_changed"], r["verbatim"]) for r in got} == {(0, 0, 4, 3, False), (1, 1, 12, 9, False), (7, 0, 4, 0, True)}


def test_reparameterised_question(spark):
    item = "A train travels 60 miles in 2 hours and then Alice walks another 5 miles before she finally comes home."
    other = "Yesterday we heard. A train travels 90 miles in 4 hours and then Bob walks another 7 miles before she finally comes home. Fine."
    wrong = "A train travels 90 miles in 90 hours and then Bob walks another 90 miles before she finally comes home."
    docs = spark.createDataFrame([(1, item), (2, other), (3, "Nothing of that kind is said in this text at all, not once."), (4, None), (5, wrong)], "doc_id bigint, text string")
    bench = spark.createDataFrame([(7, item), (8, None)], "item_id bigint, text string")
    found = {r["doc_id"]: r for r in decontam.contaminated(docs, bench).collect()}
    assert set(found) == {1, 2, 5}  # values that all become one are reported too
    assert found[1]["verbatim"] and not found[2]["verbatim"] and found[5]["n_changed"] > found[2]["n_changed"] - 2
    assert sorted(r["doc_id"] for r in decontam.keep_clean(docs, bench).collect()) == [3, 4]


def test_values_that_meet_and_one_altered_number(spark):
    pears = "She bought 3 apples and 5 pears from the old market near the river today."
    long = "The first of 20 boxes went to the harbour before noon and nobody counted what was inside until the last of 20 boxes came back."
    rows = [
        (1, "She bought 4 apples and 4 pears from the old market near the river today."),
        (2, long.replace("last of 20", "last of 21")),  # one of two equal numbers altered, all else word for word
        (3, "The first of 30 boxes went to the harbour before noon and nobody counted what was inside until the last of 30 boxes came back."),
        (4, "The first of 30 boxes went to the harbour at last and nobody came."),
    ]
    bench = spark.createDataFrame([(1, pears), (2, long)], "item_id bigint, text string")
    got = decontam.contaminated(spark.createDataFrame(rows, "doc_id bigint, text string"), bench).collect()
    n = len(long.split())
    found = {(r["doc_id"], r["item_id"]): r for r in got}
    assert set(found) == {(1, 1), (2, 2), (3, 2), (4, 2)}
    assert found[2, 2]["verbatim"] and 0 < found[2, 2]["n_windows"] < n - 7
    assert not found[1, 1]["verbatim"] and found[1, 1]["n_changed"] == 2
    assert not found[3, 2]["verbatim"] and found[3, 2]["n_windows"] == n - 7


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    held = [r for r in docs.select("doc_id", "lang", "text").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 and r["lang"] and r["text"]]
    assert all(got[r["doc_id"]]["held_out"] for r in held)
    assert sum(got[r["doc_id"]]["lang_pred"] == r["lang"] for r in held) / len(held) > 0.9


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, lang string")
    bench = spark.createDataFrame([], "item_id bigint, text string")
    turns = spark.createDataFrame([], "conv_id bigint, turn int, role string, text string")
    for df in (
        secret_scan.secret_report(docs), pii.pii_report(docs), packing.pack(docs), exact_dedup.exact_groups(docs), simhash.simhash_components(docs),
        simhash.keep_near(docs), decontam.contaminated(docs, bench), langid.identify(docs), chat.render(turns),
    ):
        assert df.count() == 0


def test_archive_round_trip(spark, tmp_path):
    rows = [(1, "u1", "x" * 1200), (2, "u2", "x" * 1200), (3, "u3", "small"), (4, None, "small"), (5, "u5", None), (None, "u6", "é")]
    warc.write_archive(spark.createDataFrame(rows, "page_id bigint, url string, html string"), str(tmp_path / "w"))
    got = {r["page_id"]: (bytes(r["payload"]).decode(), r["record_type"], r["refers_to"]) for r in warc.read_archive(spark, str(tmp_path / "w")).collect()}
    assert got == {
        1: ("x" * 1200, "revisit", 2), 2: ("x" * 1200, "response", None), 3: ("small", "response", None), 4: ("small", "response", None),
        5: ("", "response", None), None: ("é", "response", None),
    }


def test_snapshots_collapse(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "bot", "b"), (2, 0, "user", "a"), (3, 0, "user", "a"), (3, 1, "bot", "b"), (4, 0, None, None)]
    got = {r["conv_id"]: (r["n_turns"], r["n_copies"]) for r in chat.render(spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string")).collect()}
    assert got == {1: (2, 2), 4: (1, 1)}
