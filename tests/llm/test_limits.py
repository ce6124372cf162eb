"""Cases beyond former limits, added spans, the other columns, and the pipeline against a plain version of its stages."""

import random
import re

import pytest
from pyspark.sql import functions as F
from test_brute_force import kept_by_brute_force
from tokenizers import Tokenizer

import corpus_pipeline
from foliospark.llm import chat, decontam, exact_dedup, langid, packing, pii, secret_scan, token_scan, tokens, warc

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string"


def test_twenty_rules():
    rules = tuple(secret_scan.Rule(f"k{i}", f"key{chr(97 + i)}_[0-9]+", 8) for i in range(20))
    text = b" ".join(b"key%c_%d" % (97 + i, 1000 + i) for i in range(20))
    assert [k for _, k, _ in secret_scan.spans_of([text], rules)[0]] == list(range(20))


def test_added_secrets_and_long_value(spark):
    long = "token=" + "a1" * 2_000_000
    rows = [(1, "ghp_" + "z" * 36 + " -----BEGIN RSA PRIVATE KEY----- xoxb-1234567890-ab sk_live_" + "A" * 24), (2, long)]
    got = {r["doc_id"]: r["spans"] for r in secret_scan.secret_report(spark.createDataFrame(rows, DOCS)).collect()}
    assert got[1] == "github:0:40,private_key:41:72,slack:73:91,stripe:92:124" and got[2].startswith(f"assign:0:{len(long)}")


def test_added_personal_data_and_redaction(spark):
    rows = [(1, "IBAN DE89370400440532013000, mail a@b.org; ssn number 123-45-6789"), (2, None)]
    docs = spark.createDataFrame(rows, DOCS)
    got = {r["doc_id"]: r for r in pii.pii_report(docs).collect()}
    assert "iban:5:27" in got[1]["spans"] and "ssn:54:65" in got[1]["spans"] and got[2]["spans"] == ""
    assert {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}[1] == "IBAN [IBAN], mail [EMAIL]; ssn number [SSN]"


def test_seventy_languages():
    rng = random.Random(3)
    words = {f"l{i:02}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(8)] for i in range(70)}
    say = lambda lang: " ".join(rng.choice(words[lang]) for _ in range(30))
    model = langid.train([(say(lang), lang) for lang in words for _ in range(40)])
    assert len(model.languages) == 70
    table = langid.np.hstack([model.scores, langid.np.ones((langid.BUCKETS, 1), langid.np.float32)])
    sums = langid.class_sums([say(lang) for lang in words], table)
    assert sum(model.languages[int(k)] == lang for k, lang in zip(sums[:, :-1].argmax(1), words, strict=True)) > 60


def test_rejection(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(90001, None, "en"), (90002, "123 456", None), (90003, "", "de")], "doc_id bigint, text string, lang string")
    both = docs.unionByName(odd).selectExpr("*", "'x' as row", "0.5 as score")
    got = {r["doc_id"]: r for r in langid.identify(both).collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 and got[i]["rejected"] for i in (90001, 90002, 90003))
    kept = langid.keep_identified(both)
    assert kept.columns == both.columns and {r["doc_id"] for r in kept.select("doc_id").collect()} == {i for i, r in got.items() if not r["rejected"]}
    long = spark.createDataFrame([(i, ("oui " if i % 2 else "ja ") * 9000, "fr" if i % 2 else "de") for i in range(40)], "doc_id bigint, text string, lang string")
    assert {lang for _, lang in langid.labelled_sample(long, ~langid.held_out())} == {"fr", "de"}


def test_scores_are_calibrated(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    held = [r for r in langid.identify(docs).collect() if r["held_out"] and truth[r["doc_id"]] and r["lang_pred"] != "und"]
    right = sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) / len(held)
    assert abs(right - sum(r["score"] for r in held) / len(held)) < 0.1


def test_token_columns_over_many_tasks(spark, tmp_path):
    encode = Tokenizer.from_file(tokens.WORD_BPE)
    encode.encode_special_tokens = True
    rows = [(1, "a b c"), (2, None), (3, "x <|endoftext|> y"), (4, "w " * 5000)]
    path = str(tmp_path / "t")
    token_scan.write_token_files(spark.createDataFrame(rows, DOCS).coalesce(1), path)
    file = next((tmp_path / "t").glob("part-*"))
    file.write_bytes(file.read_bytes() + b"\x01\x00\x02\x00")  # an open document
    at, want = 0, []
    for i, (_, t) in enumerate(rows):
        n = len(encode.encode(t or "", add_special_tokens=False).ids)
        want.append((i, at, n, True))
        at += n + 1
    found = token_scan.scan_token_files(spark, path, block_tokens=100)
    assert sorted((r["doc_index"], r["start_token"], r["n_tokens"], r["terminated"]) for r in found.collect()) == [*want, (4, at, 2, False)]
    assert token_scan._blocks(spark, path, 2, 200).rdd.getNumPartitions() > 1
    token_scan.write_token_files(spark.createDataFrame([], DOCS), str(tmp_path / "none"))
    assert token_scan.scan_token_files(spark, str(tmp_path / "none")).count() == 0


def test_special_tokens_and_buckets(spark, tmp_path):
    encode = Tokenizer.from_file(tokens.WORD_BPE)
    rows = [(1, "hello <|endoftext|> world <|startoftext|>"), (2, "x" * 300_000), (3, "It's \u0130 e\u0301\u00a0q \x1c ok")]
    pieces = packing.pack(spark.createDataFrame(rows, DOCS)).cache()
    for i, t in rows:
        own = b"".join(bytes(r["ids"]) for r in sorted(pieces.filter(f"doc_id = {i}").collect(), key=lambda r: r["start"]))
        assert own == b"".join(x.to_bytes(4, "little") for x in [*encode.encode(t, add_special_tokens=False).ids, 1])
    packing.write_buckets(pieces, str(tmp_path / "b"))
    stored = spark.read.parquet(str(tmp_path / "b"))
    assert stored.count() == pieces.count() and stored.filter("length <> bucket").isEmpty()


def test_keep_exact(spark):
    rows = [(1, "Ab", "p"), (2, "aB", "q"), (2, "aB", "q"), (3, "É", "r"), (4, "é", "s"), (None, "ab", "t"), (5, None, "u"), (6, "", "v")]
    docs = spark.createDataFrame(rows, DOCS + ", row string").selectExpr("*", "1 as own_sha", "2 as text_sha256")
    kept = exact_dedup.keep_exact(docs)
    assert kept.columns == docs.columns and sorted((r["doc_id"], r["row"]) for r in kept.collect()) == [(2, "q"), (3, "r"), (4, "s"), (6, "v")]
    groups = sorted((str(r["doc_id"]), r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_groups(docs).collect())
    assert groups == [("1", 2, 4, False), ("2", 2, 4, True), ("2", 2, 4, True), ("3", 3, 1, True), ("4", 4, 1, True), ("5", 6, 2, False), ("6", 6, 2, True), ("None", 2, 4, False)]
    assert exact_dedup.keep_exact(docs.limit(0)).count() == 0


NAMES = "Alice Bob Carol Dave Emma Tom Anna Ben Sara Maria Ida Otto Zoe Nils Ruth Hugo".split()
FRAMES = {
    "numbers": ["a farmer sold {#} crates of pears on market day and {#} more the week after so how many crates were left of {#}", "if {#} pipes fill the old tank then {#} pipes need less time to fill it up"],
    "units": ["the train went {#} km in {#} hours and later it went {#} km more before stopping", "each bag held {#} kg of rice and was carried over {#} meters to the river bank"],
    "names inside": ["on the way home {N} gave {N} a small red kite and a long piece of string", "we know that {N} is older than {N} but not as old as the teacher thinks"],
    "names first": ["{N} has {#} apples. {N} has {#} pears. {N} has {#} plums. How many fruits?", "{N} walks {#} miles to school. {N} walks only half as far as that. Who is first?"],
}


def filled(frame, rng):
    """The frame with values for its slots, and the same with other values for all of them."""
    first, second = frame, frame
    names = rng.sample(NAMES, 2 * frame.count("{N}"))
    numbers = rng.sample(range(2, 900), 2 * frame.count("{#}"))
    for mark, values in (("{N}", names), ("{#}", numbers)):
        for k in range(0, len(values), 2):
            first, second = first.replace(mark, str(values[k]), 1), second.replace(mark, str(values[k + 1]), 1)
    return first, second


def test_reparameterised_benchmark(spark):
    """240 items that all hold numbers, units or names; every value is replaced. Each item has words of its own besides the frame."""
    rng = random.Random(11)
    syllables = "ka lo mi nu ra se to vi be du".split()
    word = lambda: "".join(rng.choices(syllables, k=3))
    items, docs, kinds = [], [], {}
    for k in range(240):
        kind = list(FRAMES)[k % 4]
        # a third of the frame's common words are the item's own
        frame = " ".join(w if "{" in w or not w.isalpha() or rng.random() < 0.67 else word() for w in rng.choice(FRAMES[kind]).split())
        item, moved = filled(frame, rng)
        items.append((k, item))
        kinds[k] = kind
        docs.append((k, f"We read on today. {moved} So it went, they say."))
    vocabulary = sorted({w for _, t in items for w in t.split()})
    docs += [(10_000 + k, " ".join(rng.choice(vocabulary) for _ in range(120))) for k in range(240)]  # the items' words and values in no order
    found = decontam.contaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    hit = {(r["doc_id"], r["item_id"]) for r in found}
    for kind in FRAMES:
        own = [k for k in kinds if kinds[k] == kind]
        assert sum((k, k) in hit for k in own) / len(own) >= 0.9, kind
    assert not [d for d, _ in hit if d >= 10_000]


def test_names_in_a_row_are_one_slot(spark):
    item = "Every week the teacher asked Bob to count all the red and blue marbles in the old box."
    rows = [(1, item.replace("Bob", "Jo Ann Lee")), (2, item.replace("marbles", "ribbons").replace("old", "new").replace("teacher", "baker").replace("count", "sort"))]
    bench = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    got = decontam.contaminated(spark.createDataFrame(rows, DOCS), bench).collect()
    assert [(r["doc_id"], r["n_changed"], r["n_windows"]) for r in got] == [(1, 1, len(item.split()) - 7)]


def test_archive_records(spark, tmp_path):
    path = str(tmp_path / "w")
    rows = [(None, "a\r\nb", "x"), (None, "a", "x"), (3, "c", "y" * 1200), (3, "d", "y" * 1200), (4, "e", "y" * 1200)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 as digest", "2 as header")
    warc.write_archive(pages, path, "2024-05-06T07:08:09Z")
    records = [bytes(r["record"]).decode() for r in warc.read_archive(spark, path).collect()]
    ids = [re.search("WARC-Record-ID: (.*)\r", r)[1] for r in records]
    assert len(set(ids)) == 5 and all("WARC-Date: 2024-05-06T07:08:09Z\r\n" in r for r in records) and any("a%0D%0Ab" in r for r in records)
    for r in records:
        head, body = r.split("\r\n\r\n", 1)
        assert int(re.search(r"Content-Length: (\d+)", head)[1]) == len(body) - 4
    assert {(r["page_id"], r["record_type"], r["refers_to"]) for r in warc.read_archive(spark, path).filter("page_id > 2").collect()} == {(3, "revisit", 4), (4, "response", None)}
    spoiled = spark.read.parquet(f"{path}/headers").selectExpr("page_id", "digest", "cast(replace(cast(header as string), 'sha1:', 'sha1:0') as binary) as header")
    spoiled.write.parquet(str(tmp_path / "v/headers"))
    spark.read.parquet(f"{path}/payloads").write.parquet(str(tmp_path / "v/payloads"))
    with pytest.raises(Exception, match="declared digest"):
        warc.read_archive(spark, str(tmp_path / "v")).select("payload").collect()
    warc.write_archive(pages.limit(0), str(tmp_path / "e"))
    assert warc.read_archive(spark, str(tmp_path / "e")).count() == 0


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rejected = {r["doc_id"] for r in langid.identify(docs).collect() if r["rejected"]}
    left = {r["doc_id"]: r["text"] or "" for r in docs.collect() if r["doc_id"] not in rejected}
    fold = lambda t: t.translate({c: c + 32 for c in range(65, 91)})
    largest = {fold(t): i for i, t in sorted(left.items())}
    left = {i: t for i, t in left.items() if largest[fold(t)] == i}
    left = {i: left[i] for i in kept_by_brute_force(list(left.items()))}
    own = spark.createDataFrame(list(left.items()), DOCS)
    bad = {r["doc_id"] for r in decontam.contaminated(own, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    encode = Tokenizer.from_file(tokens.WORD_BPE)
    want = {i: len(encode.encode(t, add_special_tokens=False).ids) + 1 for i, t in left.items() if i not in bad}
    got = {}
    for r in corpus_pipeline.run(spark, SF).collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
    assert got == want and len(want) < docs.count()


@pytest.mark.parametrize("text", ["½ ² ①", "Ⅷ 12", "٣ ٤", "_ -", "́", " \n"])
def test_no_letter_has_no_language(spark, text):
    """Number signs in any script are no letters."""
    learned = [(k, "the house and the garden of a friend", "en", "s", 1) for k in range(40)]
    docs = spark.createDataFrame([*learned, (100, text, None, "s", 1)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    row = langid.identify(docs).filter("doc_id = 100").first()
    assert (row["lang_pred"], row["score"], row["rejected"]) == ("und", 0.0, True)
    assert langid.keep_identified(docs).filter("doc_id = 100").count() == 0


def test_turns_without_a_conversation(spark):
    """Each is a conversation of its own: a copy, the beginning of another, or maximal."""
    rows = [(1, 0, "u", "a"), (1, 1, "v", "b"), (None, 0, "u", "a"), (None, 5, "u", "x"), (None, 9, "u", "x"), (None, 1, None, None), (2, 0, "u", "z"), (None, 0, "u", "z")]
    got = {(r["conv_id"], r["n_turns"], r["n_copies"], r["chat"].count("<|start|>")) for r in chat.render(spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string")).collect()}
    assert got == {(1, 2, 1, 2), (None, 1, 2, 1), (None, 1, 1, 1), (2, 1, 2, 1)}


def test_many_turns_and_many_without_a_conversation(spark):
    """A conversation of 50,000 turns, its beginnings, and a third of all rows without an id."""
    turn = F.col("id").cast("int").alias("turn")
    said = [F.lit("u").alias("role"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text")]
    long = spark.range(50_000).select(F.lit(1).cast("bigint").alias("conv_id"), turn, *said)
    short = spark.range(300).select(F.lit(2).cast("bigint").alias("conv_id"), turn, *said)
    loose = spark.range(25_000).select(F.lit(None).cast("bigint").alias("conv_id"), turn, F.lit("w").alias("role"), F.concat(F.lit("x"), (F.col("id") % 7).cast("string")).alias("text"))
    got = chat.render(long.unionByName(short).unionByName(loose)).select("conv_id", "n_turns", "n_copies", F.length("chat").alias("n")).collect()
    assert {(r["conv_id"], r["n_turns"]) for r in got} == {(1, 50_000), (None, 1)} and len(got) == 8
    assert sum(r["n_copies"] for r in got) == 25_001
