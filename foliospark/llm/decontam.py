"""Benchmark decontamination by template canonicalisation.

Numbers, units after numbers, and names (capitalised words, at the start of a sentence too, since
nothing tells the names there from other words) become typed placeholders, windows of the resulting template are hashed, and the hashes of documents and
benchmark items are joined. Where a window is shared, the values in its slots are compared: a
re-parameterised question replaces each value by one other value throughout. DataFrame
functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.llm.common import scratch, stored

WINDOW = 8
#: A window with fewer literal words says too little without its slot values.
LEAST_LITERAL = 4
#: Windows of a size and kind that has at most so many are picked out inside each text's row, those of other kinds by the join.
RARE_WINDOWS = 256
#: Up to this many benchmark windows (some 200 bytes each) they are broadcast, beyond it shuffled.
BROADCAST_WINDOWS = 200_000
#: Up to this many keys of matched documents (32 bytes each) they are broadcast, beyond it the texts are shuffled.
BROADCAST_KEYS = 1_000_000

_NUMBER, _UNIT, _NAME = "\x01", "\x02", "\x03"
_MARKS = [_NUMBER, _UNIT, _NAME]
#: Kinds of windows: slots as types; every word as it is; names as they are and other slots as types.
_TEMPLATE, _RAW, _NAMED = 0, 1, 2
_UNITS = (
    "mm|cm|km|m|mg|kg|g|lbs|lb|oz|ml|l|miles|mile|meters|meter|metres|metre|inches|inch|feet|foot|yards|yard|"
    "seconds|second|minutes|minute|hours|hour|days|day|weeks|week|months|month|years|year|"
    "dollars|dollar|euros|euro|cents|cent|percent|liters|liter|litres|litre|gallons|gallon"
)
_WORD = r"\p{L}\p{N}"


def template_words(text: Column) -> Column:
    """The text's words in lower case, slot words behind a mark of their type."""
    # each pattern begins with a plain character class, so that it fails at once at most characters
    marked = F.regexp_replace(text, rf"[0-9](?<![{_WORD}].)[0-9]*+(?:[.,][0-9]+)*+", _NUMBER + "$0")
    marked = F.regexp_replace(marked, rf"\p{{Lu}}(?<![{_WORD}].)\p{{Ll}}++(?![{_WORD}])", _NAME + "$0")
    marked = F.regexp_replace(marked, rf"([0-9] ?)({_UNITS})(?![{_WORD}])", "$1 " + _UNIT + "$2")
    marked = F.regexp_replace(marked, r"[.,](?:(?![0-9])|(?<![0-9].))", " ")
    # names in a row are one name
    marked = F.regexp_replace(marked, rf" {_NAME}(?<={_NAME}\p{{L}}{{1,64}}.{{2}})", "_")
    parts = F.split(F.lower(marked), rf"[^a-z0-9.,_{''.join(_MARKS)}{_WORD}]++")
    return F.filter(parts, lambda w: w != "")


def is_slot(word: Column) -> Column:
    return F.substring(word, 1, 1).isin(_MARKS)


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(F.when(is_slot(w), F.substring(w, 1, 1)).otherwise(w)))


def _raw_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _is_name(word: Column) -> Column:
    return F.substring(word, 1, 1) == _NAME


def _named_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(F.when(is_slot(w) & ~_is_name(w), F.substring(w, 1, 1)).otherwise(w)))


#: The word hashes of each kind, by the name of their column.
_HASHES = {_TEMPLATE: ("hashes", _hashes), _RAW: ("raw_hashes", _raw_hashes), _NAMED: ("named_hashes", _named_hashes)}


def _joined(windows: Column, step: int) -> Column:
    """Each window hashed with the one ``step`` places on; the last ``step`` have none."""
    n = F.greatest(F.size(windows) - step, F.lit(0))
    return F.zip_with(F.slice(windows, F.lit(1), n), F.slice(windows, F.lit(step + 1), n), lambda a, b: F.xxhash64(a, b))


def placed_windows(rows: DataFrame, size: int) -> DataFrame:
    """``rows`` with ``hashes`` (one a word) replaced by one row per window of ``size`` words: at, window.

    Windows grow by doubling, so a window of 8 takes 3 steps. Texts with fewer words have none.
    """
    others = [c for c in rows.columns if c != "hashes"]
    width, last = 1, F.transform("hashes", lambda h: F.xxhash64(h))
    while width < size:
        rows = rows.select(*others, last.alias("hashes"))
        step = min(width, size - width)
        last, width = _joined(F.col("hashes"), step), width + step
    return rows.select(*others, F.posexplode(last).alias("at", "window"))


def _literals(words: Column) -> Column:
    return F.size(F.filter(words, lambda w: ~is_slot(w)))


def _wanted_at(size: int, kind: int) -> Column:
    """Where an item's wanted windows of this size and kind begin."""
    return F.transform(F.filter("wanted", lambda w: (w["size"] == size) & (w["kind"] == kind)), lambda w: w["at"])


def _item_windows(benchmark: DataFrame) -> DataFrame:
    """window, kind, size, item_id, item_at, item_words of every window that is looked for.

    Windows have WINDOW words, or the item's own number if it has fewer. One with too few literal
    words is looked for with its slot values (raw), and as a template it grows by doubling up
    to the whole item until it has enough. A template without a literal word is any row of numbers and is not looked for;
    if its item has names beside numbers or units, the whole item is looked for with its own names and with any numbers and units.
    """
    words = F.col("words")
    n, base = F.size(words), F.least(F.size(words), F.lit(WINDOW))
    part = lambda at, size: F.slice(words, at + 1, size)
    few = lambda at: _literals(part(at, base)) < F.least(base, F.lit(LEAST_LITERAL))
    longer = F.concat(F.filter(F.array(*[F.lit(WINDOW << k) for k in range(1, 16)]), lambda z: z < n), F.array(n))

    def grown(at: Column) -> Column:
        fit = F.filter(longer, lambda z: _literals(part(F.least(at, n - z), z)) >= LEAST_LITERAL)
        size = F.coalesce(F.get(fit, F.lit(0)), n)
        return F.struct(F.least(at, n - size).alias("at"), size.alias("size"), F.lit(_TEMPLATE).alias("kind"))

    def own(at: Column, kind: int) -> Column:
        return F.struct(at.alias("at"), base.alias("size"), F.lit(kind).alias("kind"))

    starts = F.sequence(F.lit(0), n - base)
    templates = F.transform(starts, lambda at: F.when(few(at), grown(at)).otherwise(own(at, _TEMPLATE)))
    templates = F.filter(F.array_distinct(templates), lambda w: _literals(part(w["at"], w["size"])) > 0)
    raws = F.transform(F.filter(starts, few), lambda at: own(at, _RAW))
    whole = F.array(F.struct(F.lit(0).alias("at"), n.alias("size"), F.lit(_NAMED).alias("kind")))
    slots_only = (_literals(words) == 0) & F.exists(words, _is_name) & F.exists(words, lambda w: ~_is_name(w))
    named = F.filter(whole, lambda w: slots_only)
    items = stored(
        benchmark.select("item_id", template_words(F.coalesce("text", F.lit(""))).alias("words"))
        .filter(F.size("words") > 0)
        .select("item_id", "words", F.concat(templates, raws, named).alias("wanted")),
        "item-words",
    )
    kinds = items.select(F.explode("wanted").alias("w")).select("w.size", "w.kind").distinct().collect()
    found = None
    for size, kind in sorted((r["size"], r["kind"]) for r in kinds):
        some = items.withColumn("wanted", _wanted_at(size, kind)).filter(F.size("wanted") > 0)
        hashed = some.withColumn("hashes", _HASHES[kind][1](words))
        part_found = (
            placed_windows(hashed, size)
            .filter(F.array_contains("wanted", F.col("at")))
            .select(
                "window", F.lit(kind).alias("kind"), F.lit(size).alias("size"), "item_id",
                F.col("at").alias("item_at"), F.slice("words", F.col("at") + 1, F.lit(size)).alias("item_words"),
            )
        )
        found = part_found if found is None else found.unionByName(part_found)
    if found is None:
        return items.select(
            F.lit(0).cast("bigint").alias("window"), F.lit(_TEMPLATE).alias("kind"), F.lit(0).alias("size"), "item_id",
            F.lit(0).alias("item_at"), F.col("words").alias("item_words"),
        ).filter("false")
    return found


def _window_key(window: Column, size: Column, kind: Column) -> Column:
    """One number for a window and its kind, so that windows of all kinds join by a single long."""
    return window.bitwiseXOR(F.xxhash64(size, kind))


def _described(windows: Column, size: int, kind: int, rare: list[int] | None) -> Column:
    """array<struct<at, key>> of the windows; of a rare kind only those that are looked for."""
    described = F.transform(windows, lambda w, i: F.struct(i.alias("at"), _window_key(w, F.lit(size), F.lit(kind)).alias("key")))
    return described if rare is None else F.filter(described, lambda w: w["key"].isin(rare))


def all_windows(rows: DataFrame, kinds: list[tuple[int, int, list[int] | None]]) -> DataFrame:
    """``rows`` with the word hashes of each kind (``_HASHES``) replaced by one row per window of each size and kind: at, key.

    The windows of all kinds grow from the same doubled ones, so that a text is templated and read once. A kind comes with the keys that are
    looked for if they are few: then no other window of it leaves the text's row.
    """
    others = [c for c in rows.columns if c not in [source for source, _ in _HASHES.values()]]
    found = []
    for own_kind, (source, _) in _HASHES.items():
        name, sizes = f"w{own_kind}_", {size: rare for size, kind, rare in kinds if kind == own_kind}
        if not sizes:
            continue
        rows = rows.withColumn(f"{name}1", F.transform(source, lambda h: F.xxhash64(h)))
        width = 1
        while 2 * width <= max(sizes):
            rows = rows.withColumn(f"{name}{2 * width}", _joined(F.col(f"{name}{width}"), width))
            width *= 2
        for size, rare in sizes.items():
            base = 1 << (size.bit_length() - 1)
            own = F.col(f"{name}{base}")
            windows = own if base == size else _joined(own, size - base)
            found.append(_described(windows, size, own_kind, rare))
    return rows.select(*others, F.explode(F.concat(*found)).alias("w")).select(*others, "w.*")


def _text_key() -> Column:
    """The SHA-256 of a document's text: what a document holds depends on its text alone."""
    return F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))


def _same_words(pair: Column, kind: Column) -> Column:
    """Whether a document's word may stand for an item's: the same word, or a slot of the same type where the kind leaves its value open."""
    item, doc = pair["i"], pair["d"]
    is_open = is_slot(item) & ((kind == _TEMPLATE) | ((kind == _NAMED) & ~_is_name(item)))
    return (item == doc) | (is_open & (F.substring(item, 1, 1) == F.substring(doc, 1, 1)))


def shared_windows(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_key, doc_id, item_id, doc_at, item_at, doc_words, item_words of all shared windows, in one pass over the documents."""
    items = stored(_item_windows(benchmark).withColumn("key", _window_key(F.col("window"), F.col("size"), F.col("kind"))), "item-windows")
    counted = items.groupBy("size", "kind").agg(F.count("*").alias("n")).collect()
    few_keys = items.join(F.broadcast(items.groupBy("size", "kind").count().filter(F.col("count") <= RARE_WINDOWS)), ["size", "kind"], "left_semi")
    listed: dict[tuple[int, int], set[int]] = {(r["size"], r["kind"]): set() for r in counted if r["n"] <= RARE_WINDOWS}
    for r in few_keys.select("size", "kind", "key").collect():  # RARE_WINDOWS a kind at most
        listed[r["size"], r["kind"]].add(r["key"])
    kinds = sorted(((*k, sorted(listed[k]) if k in listed else None) for k in ((r["size"], r["kind"]) for r in counted)), key=lambda k: k[:2])
    few = items.count() <= BROADCAST_WINDOWS
    found_words = template_words(F.coalesce("text", F.lit("")))
    words = docs.select("doc_id", _text_key().alias("doc_key"), found_words.alias("words"))
    own = words.select("doc_id", "doc_key", *[hashed(F.col("words")).alias(source) for source, hashed in _HASHES.values()])
    if not kinds:
        empty = "array<string>"
        return own.filter("false").select(
            "doc_key", "doc_id", F.lit(None).cast("bigint").alias("item_id"), F.lit(0).alias("doc_at"),
            F.lit(0).alias("item_at"), F.array().cast(empty).alias("doc_words"), F.array().cast(empty).alias("item_words"),
        )
    placed = all_windows(own, kinds).select("doc_id", "doc_key", F.col("at").alias("doc_at"), F.col("key").alias("sought"))
    found = placed.join(F.broadcast(items) if few else items, F.col("sought") == F.col("key")).drop("sought", "key", "window")
    # windows are matched by hash; only the documents with a match are read again, and their words compared
    hits = stored(found, "window-hits")
    matched = stored(hits.select(F.col("doc_key").alias("hit_key")).distinct(), "hit-keys")
    keys = F.broadcast(matched) if matched.count() <= BROADCAST_KEYS else matched
    texts = docs.select(_text_key().alias("text_key"), "text").join(keys, F.col("text_key") == F.col("hit_key"), "left_semi")
    words = stored(
        texts.dropDuplicates(["text_key"]).select("text_key", template_words(F.coalesce("text", F.lit(""))).alias("words")), "hit-words"
    )
    pairs = F.arrays_zip(F.col("item_words").alias("i"), F.col("doc_words").alias("d"))
    return hits.join(words, F.col("doc_key") == F.col("text_key")).select(
        "doc_key", "doc_id", "item_id", "doc_at", "item_at", "kind",
        F.slice("words", F.col("doc_at") + 1, F.col("size")).alias("doc_words"), "item_words",
    ).filter(F.forall(pairs, lambda p: _same_words(p, F.col("kind")))).drop("kind")


def _consistent(slots: Column) -> Column:
    """Whether each item value has one document value. Different item values may have the same one."""
    return F.size(F.array_distinct(F.transform(slots, lambda p: p["i"]))) == F.size(slots)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents that hold benchmark passages: doc_id, item_id, n_windows, n_slots, n_changed, verbatim (and doc_key).

    Windows are gathered by document, item and offset between the two, so that a passage counts as
    one place; a place has at most as many windows as the item. A run of windows counts if its slots are
    consistent (``_consistent``); of any other run the windows with the item's own values count. Of
    a document and item the place with most windows is returned. Null texts are empty, texts and items
    without words match nothing, items without literal words only match with their own names or, without names, their own values, null item_ids are items like others, repeated rows count once,
    empty tables give no rows, and columns other than doc_id, text and item_id are ignored.
    """
    pairs = F.filter(
        F.arrays_zip(F.col("item_words").alias("i"), F.col("doc_words").alias("d")), lambda p: is_slot(p["i"])
    )
    spot = ["doc_key", "doc_id", "item_id", "offset"]
    at = shared_windows(docs, benchmark).select(
        "doc_key", "doc_id", "item_id", (F.col("doc_at") - F.col("item_at")).alias("offset"), "item_at",
        (F.col("item_at") + F.size("item_words")).alias("end"), pairs.alias("pairs"),
    )
    # a run is a stretch of the place that its windows cover without a gap
    before = Window.partitionBy(*spot).orderBy("item_at", "end")
    begins = F.col("item_at") >= F.coalesce(F.max("end").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = at.withColumn("begins", begins.cast("int")).withColumn(
        "run", F.sum("begins").over(before.rowsBetween(Window.unboundedPreceding, 0))
    )
    whole = runs.groupBy(*spot, "run").agg(F.collect_set(F.struct("item_at", "pairs")).alias("windows"))
    whole = whole.withColumn("slots", F.array_distinct(F.flatten(F.transform("windows", lambda w: w["pairs"]))))
    literal = F.filter("windows", lambda w: F.forall(w["pairs"], lambda p: p["i"] == p["d"]))
    counted = whole.select(*spot, F.when(_consistent(F.col("slots")), F.col("windows")).otherwise(literal).alias("windows"))
    place = counted.filter(F.size("windows") > 0).groupBy(*spot).agg(F.flatten(F.collect_list("windows")).alias("windows")).select(
        *spot,
        F.size(F.array_distinct(F.transform("windows", lambda w: w["item_at"]))).alias("n_windows"),
        F.array_distinct(F.flatten(F.transform("windows", lambda w: w["pairs"]))).alias("slots"),
    )
    changed = F.size(F.filter("slots", lambda p: p["i"] != p["d"]))
    good = place.select(
        "doc_key", "doc_id", "item_id", F.struct("n_windows", F.size("slots").alias("n_slots"), (-changed).alias("kept")).alias("place")
    )
    best = good.groupBy("doc_key", "doc_id", "item_id").agg(F.max("place").alias("place"))
    return best.select(
        "doc_id",
        "item_id",
        F.col("place.n_windows").cast("bigint").alias("n_windows"),
        F.col("place.n_slots").cast("bigint").alias("n_slots"),
        (-F.col("place.kept")).cast("bigint").alias("n_changed"),
        (F.col("place.kept") == 0).alias("verbatim"),
        "doc_key",
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without a benchmark passage, all columns.

    Null and empty texts hold no passage and stay; equal texts go or stay together whatever their ids; an empty table stays
    empty, and an empty benchmark leaves all rows. Extra columns are carried along, whatever their names.
    """
    with scratch(docs.sparkSession) as block:
        bad = block.keep(stored(contaminated(docs, benchmark).select("doc_key").distinct(), "contaminated"))
    rows = docs.select(F.struct("*").alias("row"), _text_key().alias("own_key"))
    return rows.join(bad, F.col("own_key") == F.col("doc_key"), "left_anti").select("row.*")
