"""Near duplicates by SimHash and meet-in-the-middle ball hashing.

Two fingerprints at most ``2 r`` bits apart have a common neighbour at most ``r`` bits from either.
Every distinct fingerprint emits all its variants within ``r`` bits, variants are shuffled, and
fingerprints that meet at a variant are checked. A variant is met by at most as many distinct
fingerprints as the ball has points, so no bucket is ever large however many documents
share a fingerprint.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.llm.common import scratch, shuffles_cleaned, small_batches, small_or_shuffled, stored
from foliospark.llm.components import components

#: bit counts of each byte value, most significant bit first
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
SLICE = 1 << 16
_ALL = (1 << 64) - 1


def shingles(text: str | None, size: int) -> Iterator[list[bytes]]:
    """Word shingles in slices: A-Z lower-cased, words between ASCII white space, joined by a space.

    A text of fewer words is one shingle, a text of none has none.
    """
    words = (text or "").encode().lower().split()
    if words and len(words) < size:
        yield [b" ".join(words)]
        return
    for at in range(0, len(words) - size + 1, SLICE):
        part = words[at : at + SLICE + size - 1]
        yield [b" ".join(g) for g in zip(*(part[i:] for i in range(size)), strict=False)]


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th further hash of 64-bit hashes (a multiply-xorshift finaliser)."""
    x = h + np.uint64(k * 0x9E3779B97F4A7C15 & _ALL)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprint(text: str | None, size: int, count: int = 1) -> np.ndarray:
    """``count`` unsigned 64-bit SimHashes: a bit is 1 if over half the shingle hashes set it.

    The first takes XXH64 with seed 42, the others hashes derived from it.
    """
    total, ones = 0, np.zeros((count, 64), np.int64)
    digest = xxhash.xxh64_intdigest
    for part in shingles(text, size):
        total += len(part)
        first = np.array([digest(s, 42) for s in part], np.uint64)
        for k in range(count):
            h = (_mixed(first, k) if k else first).astype(">u8").view(np.uint8).reshape(-1, 8)
            for byte in range(8):
                ones[k, 8 * byte : 8 * byte + 8] += np.bincount(h[:, byte], minlength=256) @ _BITS
    return np.packbits(2 * ones > total, axis=1).view(">u8").ravel().astype(np.uint64)


def fingerprints(docs: DataFrame, size: int = 3, count: int = 1) -> DataFrame:
    """Every column of ``docs`` but text, and fp: array of ``count`` SimHashes as signed longs."""
    others = [f for f in docs.schema.fields if f.name != "text"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in others) + ", fp array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t, size, count).view(np.int64) for t in batch.column("text").to_pylist()]
            names = [f.name for f in others]
            yield pa.record_batch([*(batch.column(c) for c in names), pa.array(fps, pa.list_(pa.int64()))], [*names, "fp"])

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, schema)


def ball(width: int, radius: int) -> list[int]:
    """All ``width``-bit masks of at most ``radius`` ones, as signed longs."""
    masks = [sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(width), r)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def ball_links(values: DataFrame, group: str, value: str, width: int, distance: int) -> DataFrame:
    """Links (group, a, b) that join, within a group, all values at most ``distance`` bits apart.

    ``values`` has distinct rows. Values that meet at a variant are chained in order instead of
    paired: they are all within ``distance`` of one another when ``distance`` is even, and each
    link is checked in any case. A pair within ``distance`` is linked directly or through the
    other values of its variant.
    """
    masks = F.array(*[F.lit(m).cast("bigint") for m in ball(width, (distance + 1) // 2)])
    emitted = values.select(F.col(group).alias("g"), F.col(value).alias("v"), F.explode(masks).alias("mask")).select(
        "g", "v", F.col("v").bitwiseXOR(F.col("mask")).alias("variant")
    )
    met = Window.partitionBy("g", "variant").orderBy("v")
    return (
        emitted.select("g", "v", F.lag("v").over(met).alias("u"))
        .filter(F.col("u").isNotNull() & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= distance))
        .select(F.col("g"), F.col("u").alias("a"), F.col("v").alias("b"))
        .distinct()
    )


def simhash_components(docs: DataFrame, size: int = 3, distance: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id reachable).

    Fingerprints at most ``distance`` bits apart are linked, and links are followed. Null and
    wordless texts have fingerprint zero and are linked like any others. Repeated rows get a row
    each; a null doc_id is never a component's smallest unless all its ids are null. An empty
    table gives an empty result. Other columns are ignored.
    """
    with scratch(docs.sparkSession) as block:
        own = stored(
            fingerprints(docs.selectExpr("cast(doc_id as bigint) as doc_id", "text"), size).select("doc_id", F.col("fp")[0].alias("fp")),
            "simhash",
        )
        classes = stored(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-classes")
        links = ball_links(classes.select(F.lit(0).alias("g"), "fp"), "g", "fp", 64, distance)
        member = components(links)
        rooted = stored(
            classes.join(member, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("root")),
            "simhash-roots",
        )
        least = stored(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "simhash-least")
        named = stored(
            rooted.select("fp", "root").join(least, "root").select(F.col("fp").alias("class_fp"), "component_id"), "simhash-named"
        )
        return block.keep(own.join(named, F.col("fp") == F.col("class_fp"))).select(
            "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
        )


#: Near-copy search: FINGERPRINTS hashes over word pairs, which move less than longer shingles when single words
#: change, are cut into bands of BAND_BITS bits; candidates are then checked exactly. Unrelated documents meet
#: in such a band once in some 10^11 pairs, so that candidates grow with the copies and not with the square of the table.
CANDIDATE_WORDS = 2
FINGERPRINTS = 3
BAND_BITS = 48
BAND_DISTANCE = 2
SHINGLE_WORDS = 5
SIMILARITY = 0.8

_BAND_BYTES = BAND_BITS // 8
_PLACES = np.array([_mixed(np.array([k], np.uint64), k + 1)[0] | np.uint64(1) for k in range(1, SHINGLE_WORDS + 1)], np.uint64)


def word_hashes(text: str | None) -> np.ndarray:
    """XXH64 of each word: A-Z lower-cased, words between ASCII white space."""
    words = (text or "").encode().lower().split()
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def gram_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash for each run of ``size`` words; fewer words are one run, none have none."""
    size = min(size, len(words))
    n = len(words) - size + 1 if size else 0
    total = np.full(n, size, np.uint64)
    for k in range(size):
        total = _mixed(total ^ (words[k : k + n] * _PLACES[k]), k)
    return total


def band_values(words: np.ndarray) -> np.ndarray:
    """The bands of a text's SimHashes over word pairs, as longs: the band's number above its bits."""
    first = gram_hashes(words, CANDIDATE_WORDS)
    ones = np.zeros((FINGERPRINTS, 64), np.int64)
    for at in range(0, len(first), SLICE):
        for k in range(FINGERPRINTS):
            bits = np.unpackbits(_mixed(first[at : at + SLICE], k + 1).view(np.uint8).reshape(-1, 8), axis=1)
            ones[k] += bits.sum(axis=0, dtype=np.int64)
    parts = np.packbits(2 * ones > len(first), axis=1).reshape(-1, _BAND_BYTES)
    wide = np.zeros((len(parts), 8), np.uint8)
    wide[:, 8 - _BAND_BYTES :] = parts
    wide[:, 7 - _BAND_BYTES] = np.arange(len(parts))
    return wide.view(">i8").ravel().astype(np.int64)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    """Arrays of longs as one Arrow column of lists."""
    ends = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([a.size for a in arrays], out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*arrays, np.zeros(0, np.int64)])))


def shingle_set(words: np.ndarray) -> np.ndarray:
    """The distinct hashes of a text's shingles as longs, sorted."""
    return np.unique(gram_hashes(words, SHINGLE_WORDS).view(np.int64))


#: Bits of a set's sketch. It has one for every bin of hashes, so that it tells sets of up to some 600 shingles apart well, larger ones less.
SKETCH_BITS = 512


def sketch(own: np.ndarray) -> np.ndarray:
    """Whether the shingles in each of SKETCH_BITS bins are odd in number, as longs. Sets differ in as many shingles at least as their sketches in bits."""
    odd = np.bincount(own & (SKETCH_BITS - 1), minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def prefix_length(n: int, similarity: float = SIMILARITY) -> int:
    """How many first shingles of a set of ``n`` hold one of every set that is similar enough, in any common order."""
    return n - math.ceil(round(similarity * n, 6)) + 1 if n else 0


def split_common(own: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that are not among the common ones, and those that are, by their counts; ties in the order of the hashes."""
    known, counts = common
    if not known.size:
        return own, own[:0]
    at = np.minimum(np.searchsorted(known, own), known.size - 1)
    hit = known[at] == own
    found = own[hit]
    return own[~hit], found[np.argsort(counts[at[hit]], kind="stable")]


def _with_sha(docs: DataFrame) -> DataFrame:
    """id (doc_id, a null one as the largest long), sha (the text's SHA-256) and text; null texts are left out."""
    last = F.lit((1 << 63) - 1)
    own = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), last).alias("id"), F.unhex(F.sha2("text", 256)).alias("sha"), "text")
    return own.filter("text is not null")


def near_rows(docs: DataFrame, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """One row for each text with words, in one pass: key, id, sha, bands, and of its shingle set the sketch, n (the size), p (the length of its
    prefix), free (the first 2 p shingles that are not common), n_free (how many it has of these) and known (its first p common ones).

    ``key`` numbers the rows: write the table before reading it twice.
    """
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, bands, sketches, numbers, frees, knowns = [], [], [], [], [], []
            for at, text in enumerate(batch.column("text")):
                words = word_hashes(text.as_py())
                if words.size:
                    own = shingle_set(words)
                    free, known = split_common(own, shared.value)
                    p = prefix_length(own.size)
                    kept.append(at)
                    bands.append(band_values(words))
                    sketches.append(sketch(own))
                    numbers.append((own.size, p, free.size))
                    frees.append(free[: 2 * p])
                    knowns.append(known[:p])
            rows = batch.select(["key", "id", "sha"]).take(pa.array(kept, pa.int64()))
            n, p, n_free = np.array(numbers, np.int64).reshape(-1, 3).T
            yield pa.record_batch(
                [*rows.columns, _lists(bands), _lists(sketches), pa.array(n), pa.array(p), _lists(frees), pa.array(n_free), _lists(knowns)],
                ["key", "id", "sha", "bands", "sketch", "n", "p", "free", "n_free", "known"],
            )

    numbered = _with_sha(docs).select(F.monotonically_increasing_id().alias("key"), "id", "sha", "text")
    return numbered.mapInArrow(
        run,
        "key bigint, id bigint, sha binary, bands array<bigint>, sketch array<bigint>, "
        "n bigint, p bigint, free array<bigint>, n_free bigint, known array<bigint>",
    )


def _wanted_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """key, text of the texts in ``wanted`` (key and sha, every sha once); equal texts give equal rows."""
    small_batches(docs.sparkSession)
    side = small_or_shuffled(wanted.select("key", F.col("sha").alias("wanted_sha")))
    return _with_sha(docs).join(side, F.col("sha") == F.col("wanted_sha")).select("key", "text")


def shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """key, hashes (a shingle set as bytes) of the texts in ``wanted``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, text in enumerate(batch.column("text")):
                found = shingle_set(word_hashes(text.as_py())).tobytes()
                yield pa.record_batch([batch.column("key").slice(at, 1), pa.array([found], pa.binary())], ["key", "hashes"])

    return _wanted_texts(docs, wanted).mapInArrow(run, "key bigint, hashes binary")


def free_shingles(docs: DataFrame, wanted: DataFrame, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """key, all_free (the shingles that are not common, sorted) of the texts in ``wanted``."""
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, text in enumerate(batch.column("text")):
                free = split_common(shingle_set(word_hashes(text.as_py())), shared.value)[0]
                yield pa.record_batch([batch.column("key").slice(at, 1), _lists([free])], ["key", "all_free"])

    return _wanted_texts(docs, wanted).mapInArrow(run, "key bigint, all_free array<bigint>")


def candidate_links(own: DataFrame) -> DataFrame:
    """Pairs (a, b) of keys whose fingerprints meet in some band, for each b the a that it meets in most bands.

    In a band, each member of a class (one band value) is paired with the class's smallest key, and the smallest
    keys of classes at most BAND_DISTANCE bits apart are paired along ``ball_links``. Similar pairs that these do not join
    are found by ``near_links``.
    """
    with scratch(own.sparkSession) as block:
        members = own.select("key", F.explode("bands").alias("value"))
        classes = stored(members.groupBy("value").agg(F.min("key").alias("first"), F.count("*").alias("n")), "band-classes")
        several = classes.filter("n > 1").select(F.col("value").alias("shared"), "first")
        within = members.join(several, F.col("value") == F.col("shared")).filter("key <> first").select(F.col("first").alias("a"), F.col("key").alias("b"))
        links = stored(ball_links(classes.select(F.lit(0).alias("g"), "value"), "g", "value", BAND_BITS, BAND_DISTANCE), "band-links")
        left = classes.select(F.col("value").alias("a"), F.col("first").alias("ka"))
        right = classes.select(F.col("value").alias("b"), F.col("first").alias("kb"))
        between = links.join(left, "a").join(right, "b").filter("ka <> kb").select(F.col("ka").alias("a"), F.col("kb").alias("b"))
        ends = within.unionByName(between).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        met = ends.groupBy("a", "b").agg(F.count("*").alias("bands"))
        best = met.groupBy("b").agg(F.max(F.struct("bands", (-F.col("a")).alias("a"))).alias("best")).select((-F.col("best.a")).alias("a"), "b")
        return block.keep(stored(best, "near-pairs"))


def _jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = np.intersect1d(a, b, assume_unique=True).size
    return both / max(1, a.size + b.size - both)


def verified(pairs: DataFrame, docs: DataFrame, own: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b) whose shingle sets have a Jaccard similarity of at least ``similarity``.

    The sets are made again from the texts of the documents in some pair (``own`` has key and sha). Of each pair the set of the document with fewer pairs is moved to the other, so that
    the set of a document that many are compared with is never copied for each of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(c) for c in ("xa", "xb"))
            good = [_jaccard(np.frombuffer(p.as_buffer(), np.int64), np.frombuffer(q.as_buffer(), np.int64)) >= similarity for p, q in zip(x, y, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    with scratch(docs.sparkSession) as block:
        met = stored(pairs.select(F.explode(F.array("a", "b")).alias("end")).groupBy("end").agg(F.count("*").alias("met")), "pair-ends")
        with_a = pairs.join(met.select(F.col("end").alias("a"), F.col("met").alias("ma")), "a")
        both = with_a.join(met.select(F.col("end").alias("b"), F.col("met").alias("mb")), "b")
        turned = F.col("ma") < F.col("mb")
        wanted = stored(own.select("key", "sha").join(met, F.col("key") == F.col("end"), "left_semi"), "pair-texts")
        sets = stored(shingle_sets(docs, wanted), "pair-sets")
        if sets.count() > wanted.count():  # rows repeat a text
            repeated, sets = sets, stored(sets.dropDuplicates(["key"]), "pair-sets")
            block.drop(repeated)
        aimed = stored(both.select(F.when(turned, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(turned, F.col("a")).otherwise(F.col("b")).alias("b")), "pairs-aimed")
        first = sets.select(F.col("key").alias("b"), F.col("hashes").alias("xb"))
        second = sets.select(F.col("key").alias("a"), F.col("hashes").alias("xa"))
        half = stored(aimed.join(first, "b"), "pairs-with-set")
        size_a, size_b = F.octet_length("xa"), F.octet_length("xb")
        whole = half.join(second, "a").filter(F.least(size_a, size_b) >= F.lit(similarity) * F.greatest(size_a, size_b) - 1e-6)
        return block.keep(stored(whole.select("a", "b", "xa", "xb").mapInArrow(run, "a bigint, b bigint"), "verified"))


#: Shingles are ordered: those of few documents by hash, then those of HEAVY or more components, then the COMMON_SHINGLES most
#: frequent in about SAMPLE_DOCS documents. Any order gives the same pairs; this one keeps shared passages out of the prefixes.
SAMPLE_DOCS = 10_000
COMMON_SHINGLES = 100_000
HEAVY = 8
#: The documents of a prefix shingle that more than so many share are first compared with one of them.
LARGE_CLASS = 4


def common_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, and counts of the most frequent shingles in a sample of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column("text"):
                yield pa.record_batch([pa.array(shingle_set(word_hashes(text.as_py())))], ["token"])

    small_batches(docs.sparkSession)
    every = max(1, docs.count() // SAMPLE_DOCS)
    some = docs.select("text").filter(F.col("text").isNotNull() & (F.pmod(F.xxhash64("doc_id", "text"), F.lit(every)) == 0))
    seen = some.mapInArrow(run, "token bigint").groupBy("token").count()
    with shuffles_cleaned(docs.sparkSession):
        rows = seen.filter("count > 2").orderBy(F.desc("count"), "token").limit(COMMON_SHINGLES).collect()
    hashes = np.array([r["token"] for r in rows], np.int64)
    order = np.argsort(hashes)
    return hashes[order], np.array([r["count"] for r in rows], np.int64)[order]


def _mixed_tokens(rows: DataFrame) -> DataFrame:
    """Of (token, key, n, component) the rows of tokens that documents of several components share, with members (how many)."""
    with scratch(rows.sparkSession) as block:
        mixed = stored(
            rows.groupBy(F.col("token").alias("mixed")).agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("members"))
            .filter("x <> y").select("mixed", "members"),
            "prefix-mixed",
        )
        return block.keep(stored(rows.join(mixed, F.col("token") == F.col("mixed")).drop("mixed"), "prefix-open"))


def _with_component(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """``rows`` with the component of their key, and share: 1 / the component's size. ``groups`` has node, component, size."""
    found = groups.select(F.col("node").alias("linked"), F.col("component").alias("joined"), "size")
    joined = rows.join(found, F.col("key") == F.col("linked"), "left")
    return joined.select(*rows.columns, F.coalesce("joined", "key").alias("component"), (1 / F.coalesce("size", F.lit(1))).alias("share"))


def _sized(links: DataFrame) -> DataFrame:
    with scratch(links.sparkSession) as block:
        groups = components(links)
        sizes = groups.groupBy(F.col("component").alias("sized")).agg(F.count("*").alias("size"))
        return block.keep(stored(groups.join(sizes, F.col("component") == F.col("sized")).drop("sized"), "near-components"))


def prefixes(docs: DataFrame, own: DataFrame, groups: DataFrame, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """key, n, component, prefix: the first p shingles of each document in the common order.

    Heavy shingles are told apart among the first 2 p free ones. Where fewer than p of these are light, though the
    document has more, its whole set is made again from the text.
    """
    with scratch(docs.sparkSession) as block:
        rows = _with_component(own.select("key", "n", "p", "free", "n_free", "known"), groups)
        tokens = rows.select("key", "share", F.explode("free").alias("token"))
        heavy = stored(tokens.groupBy("token").agg(F.sum("share").alias("weight")).filter(F.col("weight") >= HEAVY).withColumnRenamed("token", "heavy"), "heavy-shingles")
        heavy = small_or_shuffled(heavy)
        own_heavy = stored(
            tokens.join(heavy, F.col("token") == F.col("heavy")).groupBy(F.col("key").alias("holder"))
            .agg(F.sort_array(F.collect_list(F.struct("weight", "token"))).alias("held")),
            "documents-with-heavy",
        )
        held = F.coalesce(F.transform("held", lambda h: h["token"]), F.array().cast("array<bigint>"))
        marked = rows.join(own_heavy, F.col("key") == F.col("holder"), "left").select(
            "key", "n", "p", "component", "n_free", "known", F.size("free").alias("n_seen"), F.array_except("free", held).alias("light"), held.alias("held")
        )
        short = (F.size("light") < F.col("p")) & (F.col("n_seen") < F.col("n_free"))
        prefix = F.slice(F.concat("light", "held", "known"), F.lit(1), F.col("p").cast("int"))
        marked = stored(  # the wide rows are joined once
            marked.select("key", "n", "p", "component", F.when(~short, prefix).alias("prefix"), F.when(short, F.col("known")).alias("known")), "prefixes"
        )
        done = marked.filter("prefix is not null").select("key", "n", "component", "prefix")
        rest = marked.filter("prefix is null").select("key", "n", "p", "component", "known")
        if rest.isEmpty():
            return block.keep(done)
        wanted = stored(own.select("key", "sha").join(rest.select(F.col("key").alias("short_key")), F.col("key") == F.col("short_key"), "left_semi"), "short-texts")
        whole = free_shingles(docs, wanted, common).dropDuplicates(["key"])
        placed = whole.select(F.col("key").alias("of"), F.explode("all_free").alias("token")).join(heavy, F.col("token") == F.col("heavy"), "left")
        order = placed.groupBy("of").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("weight", F.lit(0.0)).alias("weight"), "token"))).alias("ordered"))
        remade = rest.join(order, F.col("key") == F.col("of")).select(
            "key", "n", "component", F.slice(F.concat(F.transform("ordered", lambda t: t["token"]), "known"), F.lit(1), F.col("p").cast("int")).alias("prefix")
        )
        return block.keep(done.unionByName(stored(remade, "prefixes-remade")))


def _near_size(x: str, y: str) -> Column:
    return F.least(x, y) >= SIMILARITY * F.greatest(x, y) - 1e-6


def hub_pairs(members: DataFrame, links: DataFrame, turn: int) -> DataFrame:
    """Pairs (a, b): each document with the hub, of another component, that it meets at most of its large tokens.

    A token's hub is its document of most links in the first turn, any one in later turns.
    """
    with scratch(members.sparkSession) as block:
        large = members.filter(F.col("members") > LARGE_CLASS).select("token", "key", "n", "component")
        if turn:
            ranked = large.withColumn("rank", F.xxhash64("key", F.lit(turn)))
        else:
            ends = links.select(F.explode(F.array("a", "b")).alias("end")).groupBy("end").agg(F.count("*").alias("rank"))
            ranked = large.join(ends, F.col("key") == F.col("end"), "left").select("token", "key", "n", "component", F.coalesce("rank", F.lit(0)).alias("rank"))
        ranked = stored(ranked, "prefix-large")
        hubs = stored(
            ranked.groupBy(F.col("token").alias("hub_token")).agg(F.max(F.struct("rank", "key", "n", "component")).alias("hub")), "prefix-hubs"
        )
        met = (
            ranked.join(hubs, F.col("token") == F.col("hub_token"))
            .filter((F.col("component") != F.col("hub.component")) & _near_size("n", "hub.n"))
            .groupBy("key", F.col("hub.key").alias("hub")).agg(F.count("*").alias("tokens"))
        )
        best = met.groupBy("key").agg(F.max(F.struct("tokens", "hub")).alias("best"))
        pairs = best.select(F.least("key", "best.hub").alias("a"), F.greatest("key", "best.hub").alias("b")).distinct()
        return block.keep(stored(pairs, "prefix-hub-pairs"))


def _most_different(x: str, y: str) -> Column:
    """In how many shingles at most similar sets of these sizes differ."""
    return (1 - SIMILARITY) / (1 + SIMILARITY) * (F.col(x) + F.col(y)) + 1e-6


def prefix_meetings(members: DataFrame, own: DataFrame) -> DataFrame:
    """Pairs (a, b), with few repeats, among them all similar documents of different components.

    Similar documents meet at their first common shingle. What either has before it the other has not, so its places (``at``) bound the
    difference; a token behind a common one is not their first, which the two tokens before it show in most cases; and sketches that differ in
    more bits than similar sets in shingles rule a pair out. None of this drops a similar pair, and pairs of a large family that are not similar make no rows.
    """
    main = stored(members.groupBy(F.col("token").alias("main_token")).agg(F.mode("component").alias("main")), "prefix-main")
    in_order = Window.partitionBy("key").orderBy("at")
    placed = members.join(main, F.col("token") == F.col("main_token")).select(
        "token", "key", "n", "component", "at", (F.col("component") == F.col("main")).alias("in_main"), (F.col("members") > LARGE_CLASS).alias("large"),
        *[F.lag("token", k).over(in_order).alias(f"before{k}") for k in (1, 2)],
    )
    sketches = own.select(F.col("key").alias("sketched"), "sketch")
    rows = stored(
        placed.join(sketches, F.col("key") == F.col("sketched")).select(*[c for c in placed.columns if c != "large"], F.when(F.col("large"), F.col("sketch")).alias("sketch")),
        "prefix-rows",
    )
    # the documents of a token's largest component meet only those outside it
    x = rows.filter("not in_main").drop("in_main").withColumnsRenamed({"key": "ka", "n": "na", "component": "ca", "at": "ia", "before1": "xa", "before2": "ya", "sketch": "sa"})
    y = rows.withColumnsRenamed({"key": "kb", "n": "nb", "component": "cb", "at": "ib", "before1": "xb", "before2": "yb", "sketch": "sb"})
    most = _most_different("na", "nb")
    again = [F.coalesce(F.col(p) == F.col(q), F.lit(False)) for p in ("xa", "ya") for q in ("xb", "yb")]
    bits = sum((F.bit_count(F.col("sa")[k].bitwiseXOR(F.col("sb")[k])) for k in range(SKETCH_BITS // 64)), F.lit(0))
    met = x.join(y, "token").filter(
        (F.col("ca") != F.col("cb")) & (F.col("in_main") | (F.col("ka") < F.col("kb"))) & _near_size("na", "nb")
        & (F.col("ia") + F.col("ib") <= most) & (F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib")) >= (F.col("na") + F.col("nb") - most) / 2)
        & ~(again[0] | again[1] | again[2] | again[3]) & (F.coalesce(bits, F.lit(0)) <= most)
    )
    return met.select(F.least("ka", "kb").alias("a"), F.greatest("ka", "kb").alias("b"))


def prefix_pairs(members: DataFrame, own: DataFrame) -> DataFrame:
    """All pairs (a, b) of documents of different components that may be similar enough."""
    with scratch(members.sparkSession) as block:
        return block.keep(stored(prefix_meetings(members, own).distinct(), "prefix-pairs"))


def near_links(docs: DataFrame, own: DataFrame, links: DataFrame, prefixed: DataFrame) -> DataFrame:
    """Links that join, with ``links``, exactly the documents that chains of similar pairs join.

    ``prefixed`` has the ``prefixes``, with the components of the links. A prefix-filter join over shingles: two sets of a Jaccard similarity of at least SIMILARITY share
    a shingle of their prefixes, so every such pair meets at a token. Only pairs that the links found so
    far do not join yet are compared; none of these is left out. In groups of many copies most are joined by comparing each with
    a hub, in turns, before the rest is compared pair by pair.
    """
    with scratch(docs.sparkSession) as block:
        members = _mixed_tokens(prefixed.select("key", "n", "component", F.posexplode("prefix").alias("at", "token")))
        turn, fresh = 0, True
        while fresh:  # as long as a tenth of the hubs are similar
            tried = hub_pairs(members, links, turn)
            found = verified(tried, docs, own)
            fresh = found.count() > tried.count() / 10
            if not found.isEmpty():
                links = stored(links.unionByName(found), "prefix-links")
                again = stored(_with_component(members.drop("component", "members"), _sized(links)).drop("share"), "prefix-labelled")
                block.drop(members)
                members = _mixed_tokens(again)
                block.drop(again)
            turn += 1
        pairs = prefix_pairs(members, own)
        block.drop(members)
        return block.keep(links if pairs.isEmpty() else stored(links.unionByName(verified(pairs, docs, own)), "prefix-links"))


def near_groups(docs: DataFrame) -> DataFrame:
    """id, sha, best_id, best_sha of every row that has a near copy; best is its group's smallest (id, sha).

    ``id`` is doc_id (a null one ranks last, as the largest long), ``sha`` the text's SHA-256. Texts are compared
    once, however many rows repeat them.
    """
    with scratch(docs.sparkSession) as block:
        common = common_shingles(docs)
        wide = stored(near_rows(docs, common), "near-rows")
        rows = stored(wide.select("key", "id", "sha", "sketch"), "near-keys")
        texts = rows.groupBy(F.col("sha").alias("text_sha")).agg(F.min("key").alias("first"), F.count("*").alias("n_rows"))
        repeated = stored(texts.filter("n_rows > 1"), "near-repeated")
        again = rows.join(repeated, F.col("sha") == F.col("text_sha")).filter("key <> first").select(F.col("key").alias("again"))
        again = None if repeated.isEmpty() else stored(again, "near-again")
        once, own = (t if again is None else t.join(again, F.col("key") == F.col("again"), "left_anti") for t in (wide, rows))
        links = verified(candidate_links(once), docs, own)
        prefixed = prefixes(docs, once, _sized(links), common)
        block.drop(wide)
        links = near_links(docs, own, links, prefixed)
        groups = components(links)
        grouped = stored(groups.join(own.select("key", "sha"), F.col("node") == F.col("key")).select("component", F.col("sha").alias("group_sha")), "near-grouped")
        named = rows.select("id", "sha").join(grouped, F.col("sha") == F.col("group_sha")).select("component", "id", "sha")
        single = repeated.select(F.col("text_sha").alias("group_sha")).join(grouped.select("group_sha"), "group_sha", "left_anti")
        copies = rows.select("id", "sha", "key").join(single, F.col("sha") == F.col("group_sha")).join(
            repeated.select("text_sha", "first"), F.col("sha") == F.col("text_sha")
        ).select(F.col("first").alias("component"), "id", "sha")
        ranked = stored(named if repeated.isEmpty() else named.unionByName(copies), "near-ranked")
        best = ranked.groupBy(F.col("component").alias("group")).agg(F.min(F.struct("id", "sha")).alias("best"))
        result = ranked.join(best, F.col("component") == F.col("group")).select(
            "id", "sha", F.col("best.id").alias("best_id"), F.col("best.sha").alias("best_sha")
        )
        return block.keep(stored(result, "near-groups"))


def keep_near(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: of each group of near copies, the one with the smallest doc_id.

    Documents are linked when they share at least SIMILARITY of their five-word shingles; links are
    followed. Band candidates join most of them, a prefix-filter join all others. A document with no near copy stays as it is, null and
    empty texts among them (texts without words have no shingles and are similar to none). Null
    doc_ids rank last; rows equal in doc_id and text go or stay together. All columns are
    carried along, whatever their names; an empty table stays empty.
    """
    gone = near_groups(docs).filter((F.col("id") != F.col("best_id")) | (F.col("sha") != F.col("best_sha"))).select(
        F.col("id").alias("gone_id"), F.col("sha").alias("gone_sha")
    )
    last = F.lit((1 << 63) - 1)
    rows = docs.select(
        F.struct("*").alias("row"), F.coalesce(F.col("doc_id").cast("bigint"), last).alias("own_id"), F.unhex(F.sha2("text", 256)).alias("own_sha")
    )
    return rows.join(small_or_shuffled(gone), (F.col("own_id") == F.col("gone_id")) & (F.col("own_sha") == F.col("gone_sha")), "left_anti").select("row.*")
