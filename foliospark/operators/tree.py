"""File trees as adjacency tables: paths, search, ordering, mutations.

Entries have id, parent_id (``""`` is the root), name, type, modified. Paths come from pointer
doubling: every round joins each entry to the entry its pointer names, so a tree of depth d takes
log2(d) rounds of plain joins whatever its size, and a parent cycle is seen because its pointers
never reach the root.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions.text import fuzzy_score, resolved_path
from foliospark.session import scratch, stored

ROOT = ""
TRASH = "trash"
FOLDER, DOCUMENT, TEMPLATE = "CollectionType", "DocumentType", "TemplateType"


def ancestors(entries: DataFrame) -> DataFrame:
    """id and chain: the ids from an entry's top ancestor down to itself, and names likewise.

    A parent that does not exist counts as the root. Entries on or below a parent cycle have a null chain.
    """
    known = entries.select(F.col("id").alias("kid"))
    rooted = entries.join(known, F.col("parent_id") == F.col("kid"), "left").select(
        "id", F.when(F.col("kid").isNotNull(), F.col("parent_id")).alias("up"),
        F.array("id").alias("chain"), F.array("name").alias("names"), F.array("type").alias("types"),
    )
    with scratch(entries.sparkSession) as block:
        state = stored(rooted, "tree")
        left, before = state.filter("up is not null").count(), None
        # a round resolves some entry of any tree; where none is resolved, all that is left hangs on a cycle
        while left and left != before:
            above = state.select(*[F.col(c).alias(f"above_{c}") for c in state.columns])
            joined = state.join(above, F.col("up") == F.col("above_id"), "left")
            longer = [F.when(F.col("above_id").isNotNull(), F.concat(f"above_{c}", c)).otherwise(F.col(c)).alias(c) for c in ("chain", "names", "types")]
            state = stored(joined.select("id", F.col("above_up").alias("up"), *longer), "tree")
            left, before = state.filter("up is not null").count(), left
        block.keep(state)
    done = F.col("up").isNull()
    return state.select("id", *[F.when(done, F.col(c)).alias(c) for c in ("chain", "names", "types")])


def walk(entries: DataFrame, include_templates: bool = False) -> DataFrame:
    """Entries with path, depth and is_dir; the trash subtree and (unless asked for) templates with what is below are left out.

    Entries of parent cycles are left out too; ``cycles`` returns them.
    """
    chains = ancestors(entries).filter("chain is not null")
    hidden = F.array_contains("chain", TRASH)
    if not include_templates:
        hidden = hidden | F.coalesce(F.array_contains("types", TEMPLATE), F.lit(False))
    paths = chains.filter(~hidden).select(
        F.col("id").alias("own_id"), "chain", F.concat(F.lit("/"), F.array_join("names", "/")).alias("path"), F.size("chain").alias("depth")
    )
    return entries.join(paths, F.col("id") == F.col("own_id")).drop("own_id").withColumn("is_dir", F.col("type") == FOLDER)


def cycles(entries: DataFrame) -> DataFrame:
    """Ids of entries that never reach the root."""
    return ancestors(entries).filter("chain is null").select("id")


def children(walked: DataFrame, parent_id: str) -> DataFrame:
    """The entries of a folder, folders first, then by lower-case name; the trash is none of them."""
    own = walked.filter((F.col("parent_id") == parent_id) & (F.col("id") != TRASH))
    return own.orderBy(F.col("is_dir").desc(), F.lower("name"), "id")


def subtree(walked: DataFrame, top_id: str) -> DataFrame:
    return walked.filter(F.array_contains("chain", top_id))


def display_line(compact: bool = False) -> Column:
    """The line that a listing shows: name with a slash, or a type mark and the name."""
    if compact:
        return F.concat("name", F.when(F.col("is_dir"), "/").otherwise(""))
    return F.concat(F.when(F.col("is_dir"), "[d] ").otherwise("[f] "), "name")


def find(walked: DataFrame, pattern: str, by_line: bool = False) -> DataFrame:
    """Entries whose path (or display line) matches a regular expression."""
    return walked.filter((display_line() if by_line else F.col("path")).rlike(pattern))


def glob_pattern(glob: str) -> str:
    """An anchored regular expression of a shell pattern: ``*``, ``?`` and classes; none cross a slash."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if c == "[" and (end := glob.find("]", i + 2)) > 0:
            inner = glob[i + 1 : end]
            out += "[" + ("^" + inner[1:] if inner[0] == "^" else inner) + "]"
            i = end
        elif c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        else:
            out += "\\" + c if not c.isalnum() else c
        i += 1
    return f"^{out}$"


def glob_last(walked: DataFrame, directory: str, glob: str) -> DataFrame:
    """Children of a directory path whose name matches the pattern, in any case."""
    parent = F.regexp_replace("path", "/[^/]*$", "")
    return walked.filter((parent == directory.rstrip("/")) & F.lower("name").rlike(glob_pattern(glob.lower())))


def search(
    walked: DataFrame, query: str, regex: bool = False, case_sensitive: bool = False, target: str = "name",
    kind: str | None = None, limit: int | None = None,
) -> DataFrame:
    """Substring or regular-expression search on name or path; a limit takes the first in path order."""
    c = F.col(target)
    if regex:
        hit = c.rlike(query if case_sensitive else f"(?i){query}")
    else:
        hit = c.contains(query) if case_sensitive else F.lower(c).contains(query.lower())
    wanted = {"dir": FOLDER, "file": DOCUMENT, "template": TEMPLATE}
    found = walked.filter(hit if kind is None else hit & (F.col("type") == wanted[kind]))
    return found if limit is None else found.orderBy("path", "id").limit(limit)


def ranked_search(walked: DataFrame, query: str, limit: int = 100) -> DataFrame:
    """The best matches: by score, then lower-case name, then path, then id; for a blank query the first entries in path order."""
    if not query.strip():
        return walked.withColumn("score", F.lit(0)).orderBy("path", "id").limit(limit)
    scored = walked.withColumn("score", fuzzy_score(query, F.col("name"), F.col("path"), F.col("is_dir")))
    return scored.filter("score is not null").orderBy(F.desc("score"), F.lower("name"), "path", "id").limit(limit)


def listing_order(dirs_first: bool = True, by_time: bool = False, reverse: bool = False) -> list[Column]:
    """Sort keys of a listing; directories stay first when the rest is reversed."""
    key = F.col("modified") if by_time else F.lower("name")
    first = [F.when(F.col("is_dir"), 0).otherwise(1)] if dirs_first else []
    return [*first, key.desc() if reverse else key.asc(), F.col("id")]


def listed(walked: DataFrame, **how: bool) -> DataFrame:
    """Each directory's entries numbered in listing order."""
    return walked.withColumn("place", F.row_number().over(Window.partitionBy("parent_id").orderBy(*listing_order(**how))))


def delete_plan(walked: DataFrame, selected: DataFrame, recursive: bool = True) -> DataFrame:
    """id and depth of what a deletion removes, each once, children before parents by depth.

    ``selected`` has one column, id. Without ``recursive`` a selected directory with children fails.
    """
    chosen = selected.select(F.col("id").alias("chosen")).distinct()
    hit = walked.select("id", "depth", F.explode("chain").alias("above")).join(chosen, F.col("above") == F.col("chosen"), "left_semi")
    plan = hit.select("id", "depth").distinct()
    if not recursive:
        own = plan.join(chosen, F.col("id") == F.col("chosen"), "left")
        return own.select(
            F.when(F.col("chosen").isNull(), F.raise_error(F.lit("directory is not empty")).cast("string")).otherwise(F.col("id")).alias("id"), "depth"
        )
    return plan


def delete(entries: DataFrame, plan: DataFrame) -> DataFrame:
    return entries.join(plan.select(F.col("id").alias("gone")), F.col("id") == F.col("gone"), "left_anti")


def delete_outcome(plan: DataFrame, remaining: DataFrame) -> DataFrame:
    """One row: how many planned entries are gone and how many remain."""
    left = remaining.select(F.col("id").alias("left_id")).distinct()
    both = plan.join(left, F.col("id") == F.col("left_id"), "left")
    return both.agg(F.count_if(F.col("left_id").isNull()).alias("removed"), F.count_if(F.col("left_id").isNotNull()).alias("remaining"))


def create_folder(entries: DataFrame, parent_id: str, new_id: str, name: str) -> DataFrame:
    """Adds a folder, its name trimmed; a blank name, one with slashes, one that a sibling has, and a parent that is no folder fail."""
    name = name.strip()
    if not name or "/" in name or "\\" in name:
        raise ValueError("a folder needs a name without slashes")
    if parent_id != ROOT and entries.filter((F.col("id") == parent_id) & (F.col("type") == FOLDER)).isEmpty():
        raise ValueError(f"not a directory: {parent_id}")
    if _taken(entries, new_id, parent_id, name):
        raise ValueError(f"the name is taken: {name}")
    made = entries.sparkSession.createDataFrame([(new_id, parent_id, name, FOLDER)], "id string, parent_id string, name string, type string")
    return entries.unionByName(made, allowMissingColumns=True)


def _taken(entries: DataFrame, entry_id: str, parent_id: str, name: str) -> bool:
    same = (F.coalesce("parent_id", F.lit(ROOT)) == parent_id) & (F.col("name") == name) & (F.col("id") != entry_id)
    return not entries.filter(same).isEmpty()


def rename(entries: DataFrame, entry_id: str, name: str) -> DataFrame:
    """Entries with one renamed; an unknown entry, a blank name, one with slashes and one that a sibling has fail."""
    name = name.strip()
    if not name or "/" in name or "\\" in name:
        raise ValueError("an entry needs a name without slashes")
    own = entries.filter(F.col("id") == entry_id).select(F.coalesce("parent_id", F.lit(ROOT)).alias("up")).first()
    if own is None:
        raise ValueError(f"no such entry: {entry_id}")
    if _taken(entries, entry_id, own["up"], name):
        raise ValueError(f"the name is taken: {name}")
    return entries.withColumn("name", F.when(F.col("id") == entry_id, name).otherwise(F.col("name")))


def move(entries: DataFrame, entry_id: str, new_parent: str) -> DataFrame:
    """All entries, walked or not, with one moved; the walk only checks.

    An unknown entry, a target that is no directory, that lies in the entry itself or that has the entry's name fail.
    """
    own = entries.filter(F.col("id") == entry_id).select("name").first()
    if own is None:
        raise ValueError(f"no such entry: {entry_id}")
    if new_parent != ROOT:
        target = entries.filter(F.col("id") == new_parent).select("type").first()
        if target is None or target["type"] != FOLDER:
            raise ValueError(f"not a directory: {new_parent}")
        plain = entries.select("id", "parent_id", "name", "type")
        inside = ancestors(plain).filter((F.col("id") == new_parent) & F.coalesce(F.array_contains("chain", entry_id), F.lit(True)))
        if not inside.isEmpty():
            raise ValueError("cannot move an entry into itself")
    if _taken(entries, entry_id, new_parent, own["name"]):
        raise ValueError(f"the name is taken: {own['name']}")
    moved = entries.withColumn("parent_id", F.when(F.col("id") == entry_id, new_parent).otherwise(F.col("parent_id")))
    return moved.drop("chain", "path", "depth", "is_dir")


def at_path(walked: DataFrame, path: Column) -> DataFrame:
    """The entries at a path, in which ``.`` and ``..`` are resolved first."""
    return walked.filter(F.col("path") == resolved_path(path))


def missing_directories(paths: DataFrame, existing: DataFrame) -> DataFrame:
    """Every prefix of the wanted directory paths that does not exist yet, parents first by depth."""
    parts = F.filter(F.split("path", "/"), lambda p: p != "")
    n = F.size("parts")
    prefixes = paths.select(parts.alias("parts")).filter(n > 0).select(
        F.explode(F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("/"), F.array_join(F.slice("parts", F.lit(1), i), "/")))).alias("path")
    )
    there = existing.select(F.col("path").alias("there"))
    wanted = prefixes.distinct().join(there, F.col("path") == F.col("there"), "left_anti")
    return wanted.withColumn("depth", F.size(F.split("path", "/")) - 1)


def snapshot_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """id and change (added, changed, removed) between two snapshots of (id, hash)."""
    old = before.select(F.col("id").alias("old_id"), F.col("hash").alias("old_hash"))
    new = after.select(F.col("id").alias("new_id"), F.col("hash").alias("new_hash"))
    both = old.join(new, F.col("old_id") == F.col("new_id"), "full_outer")
    change = F.when(F.col("old_id").isNull(), "added").when(F.col("new_id").isNull(), "removed").when(~F.col("old_hash").eqNullSafe(F.col("new_hash")), "changed")
    return both.select(F.coalesce("new_id", "old_id").alias("id"), change.alias("change")).filter("change is not null")
