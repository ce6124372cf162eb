"""Column functions on names, paths, Markdown and log texts; all of them are Catalyst expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Languages of source files by extension.
LANGUAGES = {
    "go": "go", "py": "python", "js": "javascript", "ts": "typescript", "tsx": "typescript", "c": "c", "h": "c",
    "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "hpp": "cpp", "hh": "cpp", "rs": "rust", "java": "java", "rb": "ruby",
    "php": "php", "sh": "bash", "bash": "bash", "zsh": "bash", "json": "json", "yml": "yaml", "yaml": "yaml",
    "toml": "toml", "sql": "sql", "html": "html", "css": "css", "xml": "xml",
}

# Failure classes of a log text, in the order in which they are tried.
FAILURE_DETAIL = [
    ("auth", ["authentication", "auth", "unauthorized", "401", "403"]),
    ("timeout", ["timeout", "timed out"]),
    ("not-found", ["not found", "no such file", "404"]),
    ("network", ["network", "connection", "dns", "refused"]),
    ("conflict", ["already exists", "conflict", "409"]),
    ("permission", ["permission denied", "access denied"]),
    ("runtime-error", ["error:", "panic", "fatal"]),
    ("cli-usage", ["usage:", "flag", "unknown command"]),
]
FAILURE_SUMMARY = [
    ("auth", ["authentication", "unauthorized", "401", "403"]),
    ("timeout", ["timeout", "timed out"]),
    ("not-found", ["not found", "no such file", "404"]),
    ("network", ["network", "connection", "dns", "refused"]),
    ("conflict", ["already exists", "conflict", "409"]),
    ("permission", ["permission denied", "access denied"]),
    ("pandoc-pdf", ["pandoc", "xelatex", "latex", "exit status 43"]),
    ("http-400", ["status 400", "bad request"]),
    ("runtime-error", ["error:", "panic", "fatal"]),
    ("cli-usage", ["usage:", "flag", "unknown command", "unsupported file type"]),
]


def classify(text: Column, rules: list[tuple[str, list[str]]], default: str = "unknown") -> Column:
    """The first class of which the lower-cased text contains a phrase; null text is empty."""
    low = F.lower(F.coalesce(text, F.lit("")))
    found = [(name, reduce(Column.__or__, [low.contains(p) for p in phrases])) for name, phrases in rules]
    return reduce(lambda chain, r: chain.when(r[1], r[0]), found[1:], F.when(found[0][1], found[0][0])).otherwise(default)


def first_like(text: Column, rules: list[tuple[str, str]], default: str = "other") -> Column:
    """The name of the first rule whose SQL pattern the text matches in any case."""
    chain = F.when(text.ilike(rules[0][0]), rules[0][1])
    for pattern, name in rules[1:]:
        chain = chain.when(text.ilike(pattern), name)
    return chain.otherwise(default)


def truncated(text: Column, most: int, mark: str) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(mark))).otherwise(text)


_SPACE = " \t\n\r\f\x0b"


def normal_path(path: Column) -> Column:
    """Trimmed of white space, with one leading slash added if missing and no trailing one; empty is the root."""
    bare = F.regexp_replace(F.trim(F.coalesce(path, F.lit("")), F.lit(_SPACE)), "/+$", "")
    return F.when(bare == "", "/").when(bare.startswith("/"), bare).otherwise(F.concat(F.lit("/"), bare))


def resolved_path(path: Column) -> Column:
    """A normal path without empty and ``.`` parts; ``..`` leaves the part before it, and the root stays the root."""
    parts = F.filter(F.split(normal_path(path), "/"), lambda p: ~p.isin("", "."))
    kept = F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda acc, p: F.when(p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p))),
    )
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def base_name(path: Column) -> Column:
    """The last part of a path."""
    return F.regexp_extract(F.regexp_replace(F.coalesce(path, F.lit("")), "/+$", ""), "[^/]*$", 0)


def safe_name(name: Column) -> Column:
    """A file name: of the last path part, the stem in letters, digits, ``_ . -`` and the extension as it is.

    Runs of ``_`` are one, the stem's ends are bare, a stem of nothing is ``document``.
    """
    base = base_name(name)
    ending = F.regexp_extract(base, r"\.[^.]*$", 0)
    stem = F.substring(base, F.lit(1), F.length(base) - F.length(ending))
    kept = F.regexp_replace(F.replace(stem, F.lit(" "), F.lit("_")), "[^A-Za-z0-9_.-]", "")
    bare = F.regexp_replace(F.regexp_replace(kept, "_+", "_"), "^[_-]+|[_-]+$", "")
    return F.concat(F.when(bare == "", "document").otherwise(bare), ending)


def safe_relative_path(path: Column) -> Column:
    """Slash-separated, without empty, ``.`` and ``..`` parts."""
    parts = F.split(F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/")), "/")
    return F.array_join(F.filter(parts, lambda p: ~p.isin("", ".", "..")), "/")


def safe_attachment(name: Column) -> Column:
    """Without control characters; slashes, backslashes and quotes become ``_``; blank and dots alone are ``document``."""
    bare = F.translate(F.regexp_replace(F.coalesce(name, F.lit("")), r"\p{Cc}", ""), '/\\"', "___")
    return F.when(F.trim(bare, F.lit(_SPACE)) == "", "document").when(bare.isin(".", ".."), "document").otherwise(bare)


def remote_key(base: Column, directory: Column, name: Column) -> Column:
    """base/directory/name as a normal path; an empty directory is left out."""
    return normal_path(F.concat_ws("/", normal_path(base), F.nullif(F.trim(directory), F.lit("")), name))


def date_directory(text: Column, override: Column | None = None, base: str = "/ai") -> Column:
    """The remote directory of a day: base/YYYY/MM/DD of ``YYYY/MM/DD`` or ``YYYY-MM-DD``, of the current day if blank.

    An override that is not blank wins. Only lengths and digits are checked; any other text fails.
    """
    bare = F.regexp_replace(F.trim(F.coalesce(text, F.lit("")), F.lit(_SPACE)), "^/+|/+$", "")
    shaped = F.when(bare.rlike("^[0-9]{4}/[0-9]{2}/[0-9]{2}$"), bare).when(bare.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.replace(bare, F.lit("-"), F.lit("/")))
    blank = F.trim(F.coalesce(text, F.lit("")), F.lit(_SPACE)) == ""
    wrong = F.raise_error(F.concat(F.lit("invalid date: "), text)).cast("string")
    day = F.when(blank, F.date_format(F.current_date(), "yyyy/MM/dd")).when(shaped.isNotNull(), shaped).otherwise(wrong)
    own = F.concat(F.lit(base + "/"), day)
    return own if override is None else F.when(F.trim(F.coalesce(override, F.lit("")), F.lit(_SPACE)) != "", normal_path(override)).otherwise(own)


def extension(path: Column) -> Column:
    """The lower-case extension of the last path part, without its dot."""
    return F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))


def language_of(path: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.coalesce(F.element_at(pairs, extension(path)), F.lit(""))


def extension_allowed(path: Column, allowed: list[str]) -> Column:
    wanted = [e.strip().lower().removeprefix(".") for e in allowed if e.strip()]
    return extension(path).isin(wanted) if wanted else F.lit(True)


def ensure_pdf(name: Column) -> Column:
    bare = F.trim(name, F.lit(_SPACE))
    return F.when(F.lower(bare).endswith(".pdf"), bare).otherwise(F.concat(bare, F.lit(".pdf")))


def pdf_name(path: Column, total: int, override: str = "") -> Column:
    """The name of a Markdown file's PDF: its own stem, or an override, which only one file may have and which is a bare name."""
    wanted = override.strip()
    if not wanted:
        return F.concat(F.regexp_replace(base_name(path), r"\.[^.]*$", ""), F.lit(".pdf"))
    if total != 1:
        raise ValueError("a name is valid for one file only")
    if "/" in wanted or "\\" in wanted:
        raise ValueError("a name may not contain path separators")
    return ensure_pdf(F.lit(wanted))


def without_front_matter(text: Column) -> Column:
    """Drops a leading YAML block and the line breaks behind it.

    The text must begin with ``---`` in its first column, alone on its line but for white space (CRLF too), and a closing
    ``---`` line must follow.
    """
    return F.regexp_replace(text, r"\A---[^\S\n]*\n(?s:.*?\n)??[^\S\n]*---[^\S\n]*(?:\n+|\z)", "")


def is_list_line(line: Column) -> Column:
    return line.rlike(r"^[ \t]*(?:[-*+] |[0-9]+\. )")


def list_level(line: Column) -> Column:
    """Nesting depth of a list line from 1: two spaces or one tab a level; 0 for other lines."""
    lead = F.regexp_extract(line, r"^([ \t]*)", 1)
    tabs = F.length(F.replace(lead, F.lit(" "), F.lit("")))
    return F.when(is_list_line(line), F.floor((F.length(lead) + tabs) / 2) + 1).otherwise(0).cast("int")


def code_fence(code: Column) -> Column:
    """Back-ticks that fence a code text: longer than any run in it, three at least."""
    runs = F.transform(F.regexp_extract_all(code, F.lit("(`+)"), F.lit(1)), lambda r: F.length(r))
    return F.repeat(F.lit("`"), F.greatest(F.lit(3), F.coalesce(F.array_max(runs), F.lit(0)) + 1))


def reference_label(label: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(label), r"\s+", " "))


def inline_images(text: Column) -> Column:
    """Targets of ``![alt](target)``."""
    return F.regexp_extract_all(text, F.lit(r"!\[([^\]]*)\]\(([^)]+)\)"), F.lit(2))


def is_remote_target(target: Column) -> Column:
    return F.lower(F.trim(target)).rlike("^(?:https?://|data:)")


# The pattern of a mermaid fence, its body the group.
MERMAID = "(?s)```mermaid\\s*\\n(.*?)\\n\\s*```"


def mermaid_blocks(text: Column) -> Column:
    """The bodies of mermaid fences, in order."""
    return F.regexp_extract_all(text, F.lit(MERMAID), F.lit(1))


def mermaid_pictures(text: Column, prefix: str = "", width: str = "") -> Column:
    """struct<text, pictures>: mermaid fences as pictures below ./images, and what is to be drawn (number, name, source).

    Fences are numbered from 1; an empty one has a number too, but stays in the text and is not drawn. Null is empty.
    """
    own = F.coalesce(text, F.lit(""))
    whole = F.regexp_extract_all(own, F.lit(MERMAID), F.lit(0))

    def block(body: Column, i: Column) -> Column:
        name = F.concat(F.lit(f"{prefix}mermaid-"), F.lpad((i + 1).cast("string"), F.greatest(F.lit(3), F.length((i + 1).cast("string"))), F.lit("0")), F.lit(".png"))
        return F.struct((i + 1).alias("number"), name.alias("name"), F.trim(body, F.lit(_SPACE)).alias("source"))

    found = F.transform(mermaid_blocks(own), block)
    size = f"{{width={width}}}" if width else ""
    shown = lambda b: F.concat(F.lit("![mermaid diagram "), b["number"].cast("string"), F.lit("](./images/"), b["name"], F.lit(")" + size))
    put = F.zip_with(whole, found, lambda old, b: F.when(b["source"] == "", old).otherwise(shown(b)))
    between = F.split(own, MERMAID, -1)
    joined = F.array_join(F.zip_with(between, F.concat(put, F.array(F.lit(""))), lambda plain, new: F.concat(plain, new)), "")
    return F.struct(joined.alias("text"), F.filter(found, lambda b: b["source"] != "").alias("pictures"))


def text_counts(text: Column) -> Column:
    """Characters plus one and lines of a text; both zero for an empty one."""
    empty = F.length(text) == 0
    return F.struct(
        F.when(empty, 0).otherwise(F.length(text) + 1).alias("characters"),
        F.when(empty, 0).otherwise(F.size(F.split(text, "\n"))).alias("lines"),
    )


def comparable_sha(text: Column) -> Column:
    """SHA-256 of a text with line ends, outer and repeated white space evened out."""
    return F.sha2(F.trim(F.regexp_replace(text, r"\s+", " ")), 256)


def media_type(content: Column, path: Column) -> Column:
    """From the first bytes, else from the extension."""
    head = F.hex(F.substring(content, 1, 12))
    by_name = F.create_map(*[F.lit(x) for x in ("png", "image/png", "jpg", "image/jpeg", "jpeg", "image/jpeg", "gif", "image/gif", "webp", "image/webp")])
    return (
        F.when(head.startswith("89504E47"), "image/png")
        .when(head.startswith("FFD8FF"), "image/jpeg")
        .when(head.startswith("47494638"), "image/gif")
        .when(head.startswith("52494646") & head.endswith("57454250"), "image/webp")
        .otherwise(F.coalesce(F.element_at(by_name, extension(path)), F.lit("application/octet-stream")))
    )


def _subsequence(query: str, text: Column, word_bonus: bool) -> Column:
    """Points of a greedy subsequence match of a lower-case query, null if there is none."""
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("streak"), F.lit(0).alias("points"))

    def step(acc: Column, i: Column) -> Column:
        c = F.substring(text, i, F.lit(1))
        hit = (acc["at"] < len(query)) & (c == F.substring(F.lit(query), acc["at"] + 1, F.lit(1)))
        before = F.substring(text, i - 1, F.lit(1))
        opens = (i == 1) | before.isin(" ", "-", "_", "/", ".")
        bonus = F.when(opens, 15).otherwise(0) if word_bonus else F.lit(0)
        return F.when(
            hit,
            F.struct(
                (acc["at"] + 1).alias("at"), (acc["streak"] + 1).alias("streak"),
                (acc["points"] + 10 + 5 * acc["streak"] + bonus).alias("points"),
            ),
        ).otherwise(F.struct(acc["at"].alias("at"), F.lit(0).alias("streak"), acc["points"].alias("points")))

    places = F.when(F.length(text) > 0, F.sequence(F.lit(1), F.length(text))).otherwise(F.array().cast("array<int>"))
    done = F.aggregate(places, start, step)
    less = F.floor(F.octet_length(text) / 20).cast("int")
    return F.when(done["at"] == len(query), F.greatest(done["points"] - less, F.lit(0)))


def fuzzy_score(query: str, name: Column, path: Column, is_dir: Column) -> Column:
    """Rank of an entry for a query, null if it doesn't match; a blank query matches all with 0.

    Exact name 1000; prefix 800 and 4 a query byte; name subsequence 400 and its points; path
    subsequence 150 and its points; directories get 5 more on the name's tiers. Positions are
    characters, so non-ASCII names may score a little unlike a byte-wise scan.
    """
    q = query.strip().lower()
    low, where = F.lower(name), F.lower(path)
    extra = F.when(is_dir, 5).otherwise(0)
    if not q:
        return F.lit(0)
    return (
        F.when(low == q, F.lit(1000) + extra)
        .when(low.startswith(q), F.lit(800 + 4 * len(q.encode())) + extra)
        .otherwise(F.coalesce(F.lit(400) + _subsequence(q, low, True) + extra, F.lit(150) + _subsequence(q, where, False)))
    )


def command_kinds(tool: str) -> dict[str, list[tuple[str, str]]]:
    """The four ordered rule sets that name a tool's sub-commands: for listed calls, sequences, the summary and failures."""
    rule = lambda words, name=None: (f"%{tool} {words}%", name or words)
    plain = [rule(w) for w in ("upload", "cloud", "rmdoc", "render", "status", "help")]
    fine = [rule("upload bundle"), rule("upload md"), rule("upload", "upload (other)"), rule("cloud ls"), rule("cloud account")]
    rest = [rule("cloud", "cloud (other)"), rule("rmdoc"), rule("render"), rule("status")]
    flag = rule("--", "flag-first")
    return {
        "calls": [*plain, flag],
        "sequences": plain,
        "summary": [*fine, rule("cloud rm"), *rest, rule("help"), flag],
        "failures": [*fine, *rest],
    }


def command_excerpt(command: Column, tool: str, most: int = 60) -> Column:
    """The first word behind the tool's name and the flags that follow it; without the name the command's beginning."""
    found = F.regexp_extract(F.coalesce(command, F.lit("")), rf"{tool}\s+(\S+(?:\s+--\S+)*)", 1)
    return F.substring(F.when(found != "", found).otherwise(F.coalesce(command, F.lit(""))), 1, most)


def is_auth_error(message: Column) -> Column:
    """Whether an error text speaks of missing rights; null does not."""
    low = F.lower(F.coalesce(message, F.lit("")))
    return reduce(Column.__or__, [low.contains(p) for p in ("401", "unauthorized", "403", "forbidden", "token expired")])


def is_not_found_error(message: Column) -> Column:
    low = F.lower(F.coalesce(message, F.lit("")))
    return reduce(Column.__or__, [low.contains(p) for p in ("doesnt exist", "doesn't exist", "not found")])


def rfc3339(epoch_ms: Column) -> Column:
    """Milliseconds since 1970 as a UTC time stamp text."""
    return F.date_format(F.timestamp_millis(epoch_ms), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def cover_page(flag: Column) -> Column:
    """The page of a cover flag: ``1`` is page 0, empty and ``0`` none; any other value fails."""
    wrong = F.raise_error(F.concat(F.lit("the cover page flag must be 0 or 1, not "), flag)).cast("int")
    return F.when(F.coalesce(flag, F.lit("")).isin("", "0"), F.lit(None).cast("int")).when(flag == "1", 0).otherwise(wrong)


def layout(name: Column) -> Column:
    """A layout's name, trimmed and in lower case; blank is ``default``, any other than default and editor fails."""
    low = F.lower(F.trim(F.coalesce(name, F.lit("")), F.lit(_SPACE)))
    return F.when(low == "", "default").when(low.isin("default", "editor"), low).otherwise(F.raise_error(F.concat(F.lit("unknown layout: "), name)).cast("string"))
