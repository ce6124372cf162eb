"""Range-coded token files: exact round trips, the library's own ids, damage, and the cases its docstrings define."""

import random
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from foliospark.llm import range_coder, token_archive
from foliospark.llm.tokens import BYTE_BPE, ByteEncoder
from foliospark.session import new_path

SCHEMA = "doc_id bigint, text string"
WORDS = "the of and a in is that were shall however".split()


def plain_rows(rows):
    """doc_id, start, n_tokens, crc32 by the library's own encode, in ascending doc_id order (None first)."""
    tokenizer = Tokenizer.from_file(BYTE_BPE)
    found, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, token_archive.END_ID]
        found.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return found


def archived(spark, rows, **options):
    path = new_path(spark, "test-archive")
    token_archive.write_archive(spark.createDataFrame(rows, SCHEMA), path, **options)
    read = token_archive.read_archive(spark, path).collect()
    for r in read:
        assert len(r.ids) == 4 * r.n_tokens
    return path, sorted(((r.doc_id, r.start, r.n_tokens, zlib.crc32(r.ids)) for r in read), key=lambda r: r[1])


@pytest.mark.parametrize("n", [0, 1, 2, 255, 256, 511, 512, 70_001])
@pytest.mark.parametrize("kind", ["one id", "uniform", "ends of the vocabulary", "repeated passages"])
def test_coder_round_trip(n, kind):
    draw = np.random.default_rng(n)
    size = token_archive.VOCABULARY
    ids = {
        "one id": lambda: np.full(n, size - 1),
        "uniform": lambda: draw.integers(0, size, n),
        "ends of the vocabulary": lambda: draw.choice([0, size - 1], n, p=[0.999, 0.001]),
        "repeated passages": lambda: np.resize(draw.integers(0, size, 300), n),
    }[kind]().astype(np.uint16)
    coded = range_coder.encode(ids, size)
    assert np.array_equal(range_coder.decode(coded, n, size), ids)
    if n > 70_000 and kind != "uniform":
        assert len(coded) < n / 2


def test_coder_uses_both_ids_before():
    """Where only two ids before tell the next, order 2 must help: shorter than with the order broken."""
    draw = np.random.default_rng(3)
    bits = draw.integers(0, 2, 60_000)
    for k in range(2, len(bits)):
        bits[k] = bits[k - 1] ^ bits[k - 2] if draw.random() < 0.98 else bits[k]
    known = len(range_coder.encode(bits.astype(np.uint16), 4))
    assert known < 0.45 * len(range_coder.encode(draw.permutation(bits).astype(np.uint16), 4))


def test_coder_refuses_foreign_ids():
    with pytest.raises(ValueError, match="vocabulary"):
        range_coder.encode(np.array([5], np.uint16), 5)


def test_encoder_equals_library():
    draw = random.Random(11)
    letters = [*"ab Z09²½ªéÉſ_'.,!\n\t\r  \x1c\x1f\x85\xa0　漢🙂st", "'ll", " <|endoftext|>", "​", " \n", "  ", "x" * 90]
    texts = ["".join(draw.choices(letters, k=draw.randint(0, 14))) for _ in range(4000)] + [None, "", " ", "  "]
    tokenizer, own = Tokenizer.from_file(BYTE_BPE), ByteEncoder()
    for k in range(0, len(texts), 300):
        for text, ids in zip(texts[k : k + 300], own.encode_batch(texts[k : k + 300]), strict=True):
            assert np.frombuffer(ids, "<u2").tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids, repr(text)


def test_encoder_remembers_pieces_of_columns():
    """Words that differ in their signs alone are not learned anew; columns of both widths, also slices, are read as they are."""
    ends = ["", ".", ",", "***", "!\n", "'s", "'s.", ".\nAnd", "\n\n", " ", "\x00's", " <|endoftext|>", " 漢's"]
    texts = [f"l'été {w}{e}" for e in ends for w in ("Haus", "maison", "x" * 90, "'ll", "12")] + [None, ""]
    tokenizer, own = Tokenizer.from_file(BYTE_BPE), ByteEncoder()
    wanted = [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    for kind in (pa.string(), pa.large_string()):
        column = pa.array(["before it's", *texts, "after"], kind).slice(1, len(texts))
        assert [np.frombuffer(i, "<u2").tolist() for i in own.encode_batch(column)] == wanted
    assert len(own.known) < 30
    assert own.encode_batch(pa.array([None, ""], pa.string())) == own.encode_batch([None, ""]) == [b"", b""] and own.encode_batch([]) == []


def test_archive_round_trip(spark):
    draw = random.Random(7)
    rows = [(k * 7 % 501, " ".join(draw.choices(WORDS, k=draw.randint(1, 60)))) for k in range(500)]
    rows += [(1000, None), (1001, ""), (1002, "<|endoftext|> ! !"), (1003, "word " * 60_000), (None, "no id"), (None, "no id")]
    path, read = archived(spark, rows, block_ids=700)
    expected = plain_rows(rows)
    assert sorted(r[1:3] for r in read) == sorted(r[1:3] for r in expected)
    assert [r for r in read if r[0] is not None] == expected[2:]
    assert token_archive.blocks(spark, path).count() > 10


def test_archive_ties_and_hot_ids(spark):
    """Rows of one id may be dealt to many files; each stays, in the table's order."""
    rows = [(5, f"copy {k}") for k in range(400)] + [(k, "other") for k in range(400)]
    _, read = archived(spark, rows, block_ids=50)
    assert [r[2:] for r in read] == [r[2:] for r in plain_rows(rows)]
    assert sum(r[0] == 5 for r in read) == 401


def test_archive_empty_table_and_clashing_columns(spark):
    assert archived(spark, [])[1] == []
    path = new_path(spark, "test-archive")
    odd = spark.createDataFrame([(1, "a b", "x", 9, 4)], "doc_id int, text string, place string, ids int, block int")
    token_archive.write_archive(odd, path)
    assert [r.n_tokens for r in token_archive.read_archive(spark, path).collect()] == [3]


def test_archive_damage_is_an_error(spark):
    path, _ = archived(spark, [(k, f"text number {k} of some") for k in range(50)])
    file = next(p for p in Path(path).glob("part-*") if p.stat().st_size > 200)
    raw = bytearray(file.read_bytes())
    raw[-20] ^= 4
    file.write_bytes(raw)
    file.with_name(f".{file.name}.crc").unlink(missing_ok=True)
    with pytest.raises(Exception, match="damaged"):
        token_archive.read_archive(spark, path).collect()
    file.write_bytes(raw[:-30])
    with pytest.raises(Exception, match="damaged"):
        token_archive.read_archive(spark, path).collect()
