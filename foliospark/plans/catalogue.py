"""Registered queries over the driver tables and their DuckDB oracles.

The driver tables stand in for a workspace's: events are a usage log, region to customer a file
tree, orders and line items local and remote documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliospark.functions import ink, markdown, text
from foliospark.operators import pages, scene, sequences, sync, tree, usage
from foliospark.session import table
from foliospark.sources import pagefile, pagewriter
from foliospark.streaming import events as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

GAP_MS = 6 * 3_600_000


def query(sql: str | None = None) -> Callable:
    """Registers a query under its function's name, with its oracle."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("session_id"), "ts", F.col("event_id").alias("id"), F.col("event_type").alias("kind"),
        F.concat_ws(" ", "event_type", F.col("event_id").cast("string")).alias("command"), (F.col("event_type") != "error").alias("success"),
    )


_RUNS = f"""
  g as (select *, epoch_us(ts) // 1000 - lag(epoch_us(ts) // 1000) over (partition by user_id order by ts, event_id) as gap_ms from events),
  r as (select *, sum(case when gap_ms > {GAP_MS} then 1 else 0 end)
               over (partition by user_id order by ts, event_id rows unbounded preceding) as run from g)
"""


@query("select event_type, count(*) as n from events group by 1")
def usage_tool_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))


@query("select count(*) as n from events where event_type ilike '%ER%'")
def usage_total_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").filter(F.col("event_type").ilike("%ER%")).agg(F.count("*").alias("n"))


@query("""select event_type as kind, count(*) as calls, count(*) filter (event_type <> 'error') as succeeded,
  count(*) filter (event_type = 'error') as failed, count(distinct user_id) as sessions,
  count(*) filter (event_type <> 'error') * 100.0 / count(*)::double as success_rate,
  count(*)::double / count(distinct user_id) as per_session from events group by 1""")
def usage_subcommand_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.kind_summary(_calls(spark, sf_dir))


@query("""select event_id, cast(json_extract_string(props, '$.k') as bigint) as k,
  case when length(props) > 6 then substring(props, 1, 6) || '...' else props end as shown from events where event_type = 'error'""")
def usage_calls_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").filter("event_type = 'error'")
    return e.select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"), text.truncated(F.col("props"), 6, "...").alias("shown"))


@query(f"""with {_RUNS},
  n as (select *, row_number() over (partition by user_id, run order by ts, event_id) as nth from r)
  select user_id as session_id, run, count(*) as calls, array_to_string(list_sort(list(distinct event_type)), ', ') as kinds,
    count(*) filter (event_type <> 'error') as succeeded, count(*) filter (event_type = 'error') as failed,
    max(epoch_us(ts) // 1000) - min(epoch_us(ts) // 1000) as duration_ms, min(ts) as first_ts,
    string_agg(event_type || ' ' || event_id, '; ' order by nth) filter (nth <= 5)
      || case when count(*) > 5 then ' (+' || (count(*) - 5) || ' more)' else '' end as commands
  from n group by user_id, run having count(*) >= 2""")
def usage_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.sequences(_calls(spark, sf_dir), GAP_MS)


@query(f"""with g as (select *, cast(floor((epoch_us(ts) // 1000 - lag(epoch_us(ts) // 1000) over (partition by user_id order by ts, event_id)) / 1000.0 + 0.5) as bigint) as gap_s from events)
  select user_id as session_id, event_id as id, gap_s, sum(case when gap_s > {GAP_MS // 1000} then 1 else 0 end)
    over (partition by user_id order by ts, event_id rows unbounded preceding) + 1 as run from g""")
def usage_sequence_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.timeline(_calls(spark, sf_dir), GAP_MS // 1000).select("session_id", "id", "gap_s", "run")


@query(f"""with {_RUNS},
  s as (select user_id as session_id, count(*) as calls, count(*) filter (event_type = 'error') as failed, max(run) + 1 as runs from r group by 1)
  select *, failed / calls::double as fail_ratio, floor(runs * (1 + failed / calls::double) * 10 + 0.5) / 10 as score from s where calls >= 3""")
def usage_churn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.churn(_calls(spark, sf_dir), GAP_MS, 3)


# The oracles' own lists, written out so that an error in the operators' lists shows.
_MODES = """case when contains(t, 'auth') or contains(t, '401') or contains(t, '403') then 'auth'
    when contains(t, 'timeout') or contains(t, 'timed out') then 'timeout'
    when contains(t, 'not found') or contains(t, 'no such file') or contains(t, '404') then 'not-found'
    when contains(t, 'network') or contains(t, 'connection') or contains(t, 'dns') or contains(t, 'refused') then 'network'
    when contains(t, 'already exists') or contains(t, 'conflict') or contains(t, '409') then 'conflict'
    when contains(t, 'permission denied') or contains(t, 'access denied') then 'permission'
    when contains(t, 'error:') or contains(t, 'panic') or contains(t, 'fatal') then 'runtime-error'
    when contains(t, 'usage:') or contains(t, 'flag') or contains(t, 'unknown command') then 'cli-usage' else 'unknown' end"""
_MODES_SUMMED = """case when contains(t, 'authentication') or contains(t, 'unauthorized') or contains(t, '401') or contains(t, '403') then 'auth'
    when contains(t, 'timeout') or contains(t, 'timed out') then 'timeout'
    when contains(t, 'not found') or contains(t, 'no such file') or contains(t, '404') then 'not-found'
    when contains(t, 'network') or contains(t, 'connection') or contains(t, 'dns') or contains(t, 'refused') then 'network'
    when contains(t, 'already exists') or contains(t, 'conflict') or contains(t, '409') then 'conflict'
    when contains(t, 'permission denied') or contains(t, 'access denied') then 'permission'
    when contains(t, 'pandoc') or contains(t, 'latex') or contains(t, 'exit status 43') then 'pandoc-pdf'
    when contains(t, 'status 400') or contains(t, 'bad request') then 'http-400'
    when contains(t, 'error:') or contains(t, 'panic') or contains(t, 'fatal') then 'runtime-error'
    when contains(t, 'usage:') or contains(t, 'flag') or contains(t, 'unknown command') or contains(t, 'unsupported file type') then 'cli-usage' else 'unknown' end"""


@query(f"select doc_id, {_MODES} as mode from (select doc_id, lower(coalesce(text, '')) as t from documents)")
def usage_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.classify(F.col("text"), text.FAILURE_DETAIL).alias("mode"))


@query(f"""with m as (select {_MODES_SUMMED} as mode from (select lower(coalesce(text, '')) as t from documents))
  select mode, count(*) as n, count(*) / sum(count(*)) over ()::double as share from m group by mode""")
def usage_failure_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return usage.shares(docs.select(text.classify(F.col("text"), text.FAILURE_SUMMARY).alias("mode")), "mode")


@query("select conv_id, turn, coalesce(role, '') as role from conversations")
def unnest_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    nested = c.groupBy("conv_id").agg(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("")).alias("role"))).alias("turns"))
    return nested.select("conv_id", F.inline("turns"))


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)
    row = lambda i, p, n, k, m: [i.alias("id"), p.alias("parent_id"), n.alias("name"), F.lit(k).alias("type"), m.alias("modified")]
    tag = lambda a, c: F.concat(F.lit(a), F.col(c).cast("string"))
    none = F.lit(None).cast("string")
    return (
        t("region").select(*row(tag("r", "r_regionkey"), F.lit(""), F.col("r_name"), tree.FOLDER, none))
        .unionByName(t("nation").select(*row(tag("n", "n_nationkey"), tag("r", "n_regionkey"), F.col("n_name"), tree.FOLDER, none)))
        .unionByName(t("customer").select(*row(tag("c", "c_custkey"), tag("n", "c_nationkey"), F.col("c_name"), tree.DOCUMENT, F.col("c_mktsegment"))))
        .unionByName(t("supplier").select(*row(tag("s", "s_suppkey"), tag("n", "s_nationkey"), F.col("s_name"), tree.TEMPLATE, none)))
    )


_TREE = """
  e as (select 'r' || r_regionkey as id, '' as parent_id, r_name as name, 'CollectionType' as type, null as modified from region
    union all select 'n' || n_nationkey, 'r' || n_regionkey, n_name, 'CollectionType', null from nation
    union all select 'c' || c_custkey, 'n' || c_nationkey, c_name, 'DocumentType', c_mktsegment from customer
    union all select 's' || s_suppkey, 'n' || s_nationkey, s_name, 'TemplateType', null from supplier),
  w as (select *, '/' || name as path, 1 as depth, [id] as chain from e where parent_id = ''
    union all select e.*, w.path || '/' || e.name, w.depth + 1, list_append(w.chain, e.id) from e join w on e.parent_id = w.id),
  v as (select *, type = 'CollectionType' as is_dir from w where type <> 'TemplateType')
"""


def _walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.walk(_entries(spark, sf_dir))


@query(f"with recursive {_TREE} select id, path, depth, is_dir from v")
def tree_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _walk(spark, sf_dir).select("id", "path", "depth", "is_dir")


@query(f"with recursive {_TREE} select id, name from v where parent_id = 'r1'")
def tree_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.children(_walk(spark, sf_dir), "r1").select("id", "name")


@query(f"with recursive {_TREE} select id, path from v where list_contains(chain, 'r2')")
def tree_subtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.subtree(_walk(spark, sf_dir), "r2").select("id", "path")


@query(f"with recursive {_TREE} select id, path from v where regexp_matches(path, 'A/.*[13]$')")
def tree_find_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.find(_walk(spark, sf_dir), "A/.*[13]$").select("id", "path")


@query(f"with recursive {_TREE} select id, name from v where parent_id = 'r1' and regexp_matches(lower(name), '^[^/]*a[^/]*$')")
def tree_glob_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    walked = _walk(spark, sf_dir)
    top = table(spark, sf_dir, "region").filter("r_regionkey = 1").select(F.concat(F.lit("/"), "r_name").alias("top"))
    parent = F.regexp_replace("path", "/[^/]*$", "")
    return walked.join(top, parent == F.col("top"), "left_semi").filter(F.lower("name").rlike(tree.glob_pattern("*a*"))).select("id", "name")


@query(f"with recursive {_TREE} select id, path from v where contains(lower(path), 'asia') and type = 'DocumentType'")
def tree_search_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.search(_walk(spark, sf_dir), "Asia", target="path", kind="file").select("id", "path")


@query(f"with recursive {_TREE} select id, path from v where regexp_matches(path, '(?i)an') order by path, id limit 50")
def tree_search_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.search(_walk(spark, sf_dir), "an", regex=True, target="path", limit=50).select("id", "path")


@query()
def tree_search_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.ranked_search(_walk(spark, sf_dir), "cus").select("id", "path", "score")


@query(f"""with recursive {_TREE} select id, row_number() over (partition by parent_id order by case when is_dir then 0 else 1 end,
  modified desc nulls last, id) as place from v""")
def tree_list_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.listed(_walk(spark, sf_dir), by_time=True, reverse=True).select("id", "place")


@query(f"with recursive {_TREE} select id, depth from v where list_contains(chain, 'r3') or list_contains(chain, 'n1')")
def tree_delete_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    picked = spark.createDataFrame([("r3",), ("n1",)], "id string")
    return tree.delete_plan(_walk(spark, sf_dir), picked)


@query(f"""with recursive {_TREE}, p as (select id from v where list_contains(chain, 'r3'))
  select count(*) filter (id like 'c%') as removed, count(*) filter (id not like 'c%') as remaining from p""")
def tree_delete_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = tree.delete_plan(_walk(spark, sf_dir), spark.createDataFrame([("r3",)], "id string"))
    gone = plan.filter("id like 'c%'")
    return tree.delete_outcome(plan, tree.delete(_entries(spark, sf_dir), gone))


@query(f"""with recursive {_TREE} select id, case when id = 'n2' then 'r0' else parent_id end as parent_id,
  case when id = 'n3' then 'RENAMED' else name end as name from e""")
def tree_move_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.rename(tree.move(_entries(spark, sf_dir), "n2", "r0"), "n3", " RENAMED ").select("id", "parent_id", "name")


_HASHED = "select p_partkey as id, {} as hash from part where p_partkey % 10 <> {}"


@query(f"""select coalesce(n.id, o.id) as id, case when o.id is null then 'added' when n.id is null then 'removed' else 'changed' end as change
  from ({_HASHED.format("p_name", 3)}) o full join ({_HASHED.format("case when p_size = 7 then p_type else p_name end", 4)}) n on o.id = n.id
  where o.id is null or n.id is null or o.hash is distinct from n.hash""")
def snapshot_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    old = part.filter("p_partkey % 10 <> 3").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("hash"))
    new = part.filter("p_partkey % 10 <> 4").select(F.col("p_partkey").alias("id"), F.expr("case when p_size = 7 then p_type else p_name end").alias("hash"))
    return tree.snapshot_delta(old, new)


def _sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    local = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderdate").alias("modified"))
    remote = table(spark, sf_dir, "lineitem").filter("l_quantity > 10").groupBy("l_orderkey").agg(
        F.max("l_shipdate").alias("modified"), (F.count("*") > 5).alias("is_dir")
    ).withColumnRenamed("l_orderkey", "key").unionByName(
        table(spark, sf_dir, "customer").select((-F.col("c_custkey")).alias("key"), F.lit(None).cast("timestamp_ntz").alias("modified"), (F.col("c_acctbal") < 0).alias("is_dir"))
    )
    return sync.plan(local, remote, check_times=True)


_SYNC = """
  remote as (select l_orderkey as key, max(l_shipdate) as modified, count(*) > 5 as is_dir from lineitem where l_quantity > 10 group by 1
    union all select -c_custkey, null, c_acctbal < 0 from customer),
  p as (select coalesce(o_orderkey, key) as key, case when o_orderkey is null then 'orphan' when key is null then 'upload'
      when is_dir or coalesce(o_orderdate > modified, false) then 'stale' else 'skip' end as action,
    case when o_orderkey is null then 'remote only' when key is null then 'missing' when is_dir then 'remote is a directory'
      when o_orderdate > modified then 'local is newer' else 'present' end as reason
    from orders full join remote on o_orderkey = key where not (o_orderkey is null and is_dir))
"""


@query(f"with {_SYNC} select key, action, reason from p")
def sync_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sync(spark, sf_dir)


@query(f"""with {_SYNC} select count(*) filter (action = 'upload') as n_upload, count(*) filter (action = 'skip') as n_skip,
  count(*) filter (action = 'stale') as n_stale, count(*) filter (action = 'orphan') as n_orphan, 0 as n_error from p""")
def sync_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.action_counts(_sync(spark, sf_dir))


_BASE = r"regexp_extract(rtrim(coalesce({0}, ''), '/'), '[^/]*$')"
_ENDING = rf"regexp_extract({_BASE}, '\.[^.]*$')"
_STEM = rf"left({_BASE}, length({_BASE}) - length({_ENDING}))"
_SAFE = rf"""coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(replace({_STEM}, ' ', '_'),
  '[^A-Za-z0-9_.-]', '', 'g'), '_+', '_', 'g'), '^[_-]+|[_-]+$', '', 'g'), ''), 'document') || {_ENDING}"""


@query(f"""select key, count(*) as inputs, min(p_name) as first_input, max(p_name) as last_input
  from (select {_SAFE.format("p_name")} as key, p_name from part) group by key having count(*) > 1""")
def sync_duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.duplicate_keys(table(spark, sf_dir, "part").select(text.safe_name(F.col("p_name")).alias("key"), F.col("p_name").alias("input")))


@query("""select o_custkey as job_id, count(*) as total, count(*) filter (o_orderstatus <> 'O') as finished,
  count(*) filter (o_orderstatus = 'P') as failed, case when count(*) filter (o_orderstatus = 'O') > 0 then 'uploading'
  when count(*) filter (o_orderstatus = 'P') > 0 then 'failed' else 'done' end as state from orders group by 1""")
def job_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.when(F.col("o_orderstatus") == "O", "uploading").when(F.col("o_orderstatus") == "P", "failed").otherwise("done")
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("job_id"), F.col("o_orderkey").alias("item"), F.lit(1).alias("seq"), state.alias("state"))
    return sync.job_rollup(o)


@query(rf"""select page_id, {_SAFE.format("url")} as name,
  array_to_string(list_filter(string_split(replace(coalesce(url, ''), '\', '/'), '/'), lambda p: p not in ('', '.', '..')), '/') as path from pages""")
def name_sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", text.safe_name(u).alias("name"), text.safe_relative_path(u).alias("path"))


@query("select p_partkey, '/backup/' || p_brand || '/' || p_name as key from part")
def remote_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", text.remote_key(F.lit("backup/"), F.col("p_brand"), F.col("p_name")).alias("key"))


@query("select o_orderkey, '/ai/' || strftime(o_orderdate, '%Y/%m/%d') as directory from orders")
def date_dir(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", text.date_directory(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("directory"))


@query("""with u as (select page_id, lower(regexp_extract(url, '\\.([^./]*)$', 1)) as e from pages)
  select page_id, case when e = 'go' then 'go' when e = 'py' then 'python' when e = 'js' then 'javascript' when e in ('ts', 'tsx') then 'typescript' when e in ('c', 'h') then 'c'
    when e in ('cc', 'cpp', 'cxx', 'hpp', 'hh') then 'cpp' when e = 'rs' then 'rust' when e = 'java' then 'java' when e = 'rb' then 'ruby' when e = 'php' then 'php'
    when e in ('sh', 'bash', 'zsh') then 'bash' when e in ('yml', 'yaml') then 'yaml' when e in ('json', 'toml', 'sql', 'html', 'css', 'xml') then e else '' end as language from u""")
def ext_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.language_of(F.col("url")).alias("language"))


@query(r"""select doc_id, sha256(case doc_id % 4 when 2 then ' ---' || chr(10) || 'a' || chr(10) || '---' || chr(10) || coalesce(text, '')
    when 3 then '--- x' || chr(10) || coalesce(text, '') else ltrim(coalesce(text, ''), chr(10)) end) as body_sha from documents""")
def md_front_matter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text behind a YAML block: plain, with CRLF and empty lines after it, out of the first column, or no block at all."""
    own = F.coalesce("text", F.lit(""))
    heads = ("---\ntitle: x\ntags: [a]\n---\n\n\n", "---\r\nt\r\n---  \r\n", " ---\na\n---\n", "--- x\n")
    head = F.element_at(F.array(*map(F.lit, heads)), (F.col("doc_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(text.without_front_matter(F.concat(head, own)), 256).alias("body_sha"))


_RUNS_OF_TICKS = "list_max(list_transform(regexp_extract_all({0}, '`+'), lambda r: length(r)))"
_TICKED = "coalesce(text, '') || ' ' || repeat('`', cast(doc_id % 5 as int))"


@query(f"select doc_id, repeat('`', cast(greatest(3, coalesce({_RUNS_OF_TICKS.format(_TICKED)}, 0) + 1) as int)) as fence from documents")
def md_fence_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.concat(F.coalesce("text", F.lit("")), F.lit(" "), F.repeat(F.lit("`"), (F.col("doc_id") % 5).cast("int")))
    return table(spark, sf_dir, "documents").select("doc_id", text.code_fence(code).alias("fence"))


@query(r"""select doc_id, cast(line - 1 as int) as line, regexp_matches(l, '^[ \t]*(?:[-*+] |[0-9]+\. )') as is_list
  from (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as l, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as line from documents)""")
def md_list_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = pages.split_paragraphs(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return lines.select("doc_id", "line", text.is_list_line(F.col("line_text")).alias("is_list"))


@query("""select conv_id, sha256(string_agg('# ' || turn || chr(10) || coalesce(text, ''), chr(10) || chr(10) order by turn)) as bundle_sha
  from conversations group by 1""")
def md_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat(F.lit("# "), F.col("turn").cast("string"), F.lit("\n"), F.coalesce("text", F.lit("")))
    joined = pages.sorted_concat(table(spark, sf_dir, "conversations"), "conv_id", ["turn"], body, "\n\n")
    return joined.select("conv_id", F.sha2("bundle", 256).alias("bundle_sha"))


@query("""with l as (select l_orderkey, row_number() over (partition by l_orderkey order by l_linenumber, 'p' || l_partkey) - 1 as page_index, l_partkey
    from lineitem where l_returnflag <> 'R')
  select l_orderkey as doc, cast(page_index as int) as page_index, 'p' || l_partkey as page_id, -1 as source_page from l""")
def page_plan_cpages(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = F.struct(
        F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("id"),
        F.when(F.col("l_returnflag") == "R", F.struct(F.lit("1:1").alias("timestamp"), F.lit(1).alias("value"))).alias("deleted"),
    )
    made = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", page.alias("page")))), lambda x: x["page"]).alias("pages")
    )
    content = made.select("doc", F.to_json(F.struct(F.lit("pdf").alias("fileType"), F.struct("pages").alias("cPages"))).alias("content"))
    return pages.page_plan(content).select("doc", "page_index", "page_id", "source_page")


@query("""select o_orderkey as doc, cast(i as int) as page_index, case when i = 0 then 'first' else i::varchar end as page_id, cast(i as int) as source_page
  from orders, unnest(range(0, 1 + o_orderkey % 3)) as u(i)""")
def page_plan_legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = (F.col("o_orderkey") % 3 + 1).cast("int")
    content = F.to_json(F.struct(n.alias("pageCount"), F.array(F.lit("first")).alias("pages")))
    made = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc"), content.alias("content"))
    return pages.page_plan(made).select("doc", "page_index", "page_id", "source_page")


@query("""select conv_id as seq_id, cast(turn as bigint) as p2, cast(row_number() over (partition by conv_id order by turn) - 1 as int) as place from conversations""")
def crdt_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("seq_id"), F.lit(1).alias("p1"), F.col("turn").alias("p2"), F.lit(1).alias("left_p1"), (F.col("turn") - 1).alias("left_p2"),
        F.lit(None).alias("right_p1"), F.lit(None).alias("right_p2"),
    )
    return sequences.sequence_order(own).drop("p1")


@query("""with l as (select conv_id, turn, case turn % 4 + 1 when 1 then 70 when 2 then 150 else 35 end as h from conversations)
  select conv_id, turn, (-88 + sum(h) over w - h)::double as y, (-88 + sum(h) over w)::double as y_text from l
  window w as (partition by conv_id order by turn rows unbounded preceding)""")
def text_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.col("turn") % 4 + 1).alias("style"))
    return pages.paragraph_positions(c, "conv_id", "turn", "style").drop("style")


@query("""select label, min(least_x) - 1 as min_x, min(least_y) - 1 as min_y, max(most_x) + 1 as max_x, max(most_y) + 1 as max_y, count(*) as boxes
  from (select label, list_min(embedding[1:64:2])::double as least_x, list_max(embedding[1:64:2])::double as most_x,
    list_min(embedding[2:64:2])::double as least_y, list_max(embedding[2:64:2])::double as most_y from embeddings) group by label""")
def bbox_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda i: F.get("embedding", i).cast("double")
    points = F.transform(F.sequence(F.lit(0), F.lit(62), F.lit(2)), lambda i: F.struct(at(i).alias("x"), at(i + 1).alias("y")))
    boxed = table(spark, sf_dir, "embeddings").select("label", ink.points_box(points, 1.0).alias("box"))
    return ink.union_boxes(boxed, ["label"])


@query("""select l_orderkey, l_linenumber, case when t in (5, 18) then 25.0 when t = 23 then 12.0 when t in (4, 17) then l_quantity * 1.8
    when t in (7, 13) then l_quantity * l_quantity else l_quantity end as width,
  case when t in (5, 18) then 0.3 when t = 23 then 115 / 255.0 when t in (7, 13) then 0.7 else 1.0 end as opacity,
  case when t in (5, 18) then 2 else 1 end as cap
  from (select *, l_partkey % 25 as t from lineitem)""")
def stroke_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    style = ink.stroke_style(F.col("l_partkey") % 25, F.col("l_quantity"), F.lit(21))
    return li.select("l_orderkey", "l_linenumber", style.alias("s")).select("l_orderkey", "l_linenumber", "s.*")


@query("select l_returnflag, l_linenumber, count(*) as n, arg_max(l_quantity, (l_orderkey, l_partkey)) as last_quantity from lineitem group by 1, 2")
def tool_colour_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = F.max_by("l_quantity", F.struct("l_orderkey", "l_partkey")).alias("last_quantity")
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linenumber").agg(F.count("*").alias("n"), last)


@query("""select c_custkey, case when r in (90, 270) then h else w end as width, case when r in (90, 270) then w else h end as height,
    round((w - 100) * 72 / 226, 6) as x, round(h - (w - 50) * 72 / 226, 6) as y
  from (select c_custkey, (c_custkey % 4) * 90 as r, 100.0 + c_custkey % 7 as w, 200.0 + c_custkey % 11 as h from customer)""")
def page_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    w, h = (k % 7).cast("double") + 100, (k % 11).cast("double") + 200
    size = ink.displayed_size(w, h, ink.rotation(k % 4 * 90 + 360))
    at = ink.overlay_point(w, w, F.lit(100.0), F.lit(50.0), h)
    return table(spark, sf_dir, "customer").select("c_custkey", size.alias("s"), at.alias("p")).select(
        "c_custkey", "s.*", F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y")
    )


@query("""select doc_id, doc_id % 3 <> 0 as match, case when doc_id % 3 = 0 then 1 / len(w)::double else 0.0 end as max_ratio, 1 as pages
  from (select doc_id, string_split(coalesce(text, ''), ' ') as w from documents)""")
def compare_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("page"), F.split(F.coalesce("text", F.lit("")), " ").alias("cells"), "text")
    other = F.when(F.col("doc_id") % 3 == 0, F.concat(F.array(F.lit("\x00")), F.slice("cells", F.lit(2), F.size("cells")))).otherwise(F.col("cells"))
    return pages.document_verdict(pages.compare_pages(d, d.withColumn("cells", other), 0.0))


@query(f"""with {_RUNS},
  d as (select *, cast(trunc(value) as bigint) as v, case when event_type in ('click', 'view') then 'x' else 'y' end as axis from r),
  m as (select *, v - lag(v) over (partition by user_id, run, axis order by ts, event_id) as d from d),
  s as (select user_id, run, sum(case when axis = 'x' and d > 0 then d else 0 end) as "left", sum(case when axis = 'x' and d < 0 then -d else 0 end) as "right",
    sum(case when axis = 'y' and d < 0 then -d else 0 end) as up, sum(case when axis = 'y' and d > 0 then d else 0 end) as down from m group by 1, 2)
  select * from s where "left" + "right" + up + down > 0""")
def gestures_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(
        "user_id", "ts", F.col("event_id").alias("id"), F.col("value").cast("bigint").alias("value"),
        F.when(F.col("event_type").isin("click", "view"), "x").otherwise("y").alias("axis"),
    )
    return usage.gestures(e, GAP_MS)


@query(f"""with g as (select *, coalesce(epoch_us(ts) - lag(epoch_us(ts)) over w > {GAP_MS}000, false) as opens from events
    window w as (partition by user_id order by ts, event_id)),
  r as (select *, sum(opens::int) over (partition by user_id order by ts, event_id) as run,
    cast(trunc(value) as bigint) as v, case when event_type in ('click', 'view') then 'x' else 'y' end as axis from g),
  m as (select *, v - lag(v) over (partition by user_id, run, axis order by ts, event_id) as d from r where v is not null),
  s as (select user_id, min(ts) as start_ts, max(epoch_us(ts)) + {GAP_MS}000 as end_us,
    sum(case when axis = 'x' and d > 0 then d else 0 end)::bigint as "left", sum(case when axis = 'x' and d < 0 then -d else 0 end)::bigint as "right",
    sum(case when axis = 'y' and d < 0 then -d else 0 end)::bigint as up, sum(case when axis = 'y' and d > 0 then d else 0 end)::bigint as down
    from m group by user_id, run)
  select user_id, start_ts, "left", "right", up, down from s
  where "left" + "right" + up + down > 0 and end_us <= ((select max(epoch_ms(ts)) from events) - 10000) * 1000""")
def gestures_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gestures that the watermark has closed when the stream is drained."""
    schema = table(spark, sf_dir, "events").schema
    e = streams.event_stream(spark, f"{sf_dir}/events.parquet*", schema).select(
        "user_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("id"), F.col("value").cast("bigint").alias("value"),
        F.when(F.col("event_type").isin("click", "view"), "x").otherwise("y").alias("axis"),
    )
    closed = streams.drained(streams.gesture_stream(e, GAP_MS))
    return closed.withColumn("start_ts", F.col("start_ts").cast("timestamp_ntz"))


@query("select cast(ts as date) as day, count(*) as n, min(ts) as first_ts, max(ts) as last_ts from events group by 1")
def daily_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


_WORDS = ["upload bundle a", "upload md b", "upload c", "cloud ls", "cloud account", "cloud rm x", "cloud put", "rmdoc", "Render p", "status", "help", "--flag", "other"]
_COMMAND = "'cd x && Pen ' || ([" + ", ".join(f"'{w}'" for w in _WORDS) + "])[1 + event_id % 13] || ' --a --b ' || event_type"


_SAYS = "when command ilike '%pen {0}%' then '{1}'"
_PLAIN = " ".join(_SAYS.format(w, w) for w in ("upload", "cloud", "rmdoc", "render", "status", "help"))
_UPLOADS = " ".join(_SAYS.format(*w) for w in (("upload bundle", "upload bundle"), ("upload md", "upload md"), ("upload", "upload (other)"), ("cloud ls", "cloud ls"), ("cloud account", "cloud account")))
_OTHERS = " ".join(_SAYS.format(*w) for w in (("cloud", "cloud (other)"), ("rmdoc", "rmdoc"), ("render", "render"), ("status", "status")))
_KINDS = {
    "calls": f"case {_PLAIN} {_SAYS.format('--', 'flag-first')} else 'other' end",
    "sequences": f"case {_PLAIN} else 'other' end",
    "summary": f"case {_UPLOADS} {_SAYS.format('cloud rm', 'cloud rm')} {_OTHERS} {_SAYS.format('help', 'help')} {_SAYS.format('--', 'flag-first')} else 'other' end",
    "failures": f"case {_UPLOADS} {_OTHERS} else 'other' end",
}


def _commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = F.element_at(F.array(*map(F.lit, _WORDS)), (F.col("event_id") % 13 + 1).cast("int"))
    command = F.concat(F.lit("cd x && Pen "), word, F.lit(" --a --b "), "event_type")
    return table(spark, sf_dir, "events").select("event_id", "event_type", command.alias("command"))


@query(f"""select event_id, {", ".join(f"{sql} as {n}" for n, sql in _KINDS.items())}
  from (select event_id, {_COMMAND} as command from events)""")
def usage_command_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A call's sub-command by each of the four rule sets."""
    rules = text.command_kinds("pen")
    return _commands(spark, sf_dir).select("event_id", *[text.first_like(F.col("command"), r).alias(n) for n, r in rules.items()])


@query(f"""select {_KINDS["calls"]} as kind, count(*) as n, regexp_extract(command, 'Pen\\s+(\\S+(?:\\s+--\\S+)*)', 1) as excerpt
  from (select {_COMMAND} as command from events) group by 1, 3""")
def usage_calls_by_command(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = text.first_like(F.col("command"), text.command_kinds("pen")["calls"])
    return _commands(spark, sf_dir).groupBy(kind.alias("kind"), text.command_excerpt(F.col("command"), "Pen").alias("excerpt")).agg(F.count("*").alias("n"))


@query(f"""with {_RUNS}, k as (select user_id, run, min(ts) as first_ts, count(*) as calls from r group by 1, 2 having count(*) >= 2)
  select user_id as session_id, run, calls, row_number() over (order by user_id, first_ts, run) as number from k""")
def usage_numbered_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = usage.sequences(_calls(spark, sf_dir), GAP_MS)
    return usage.numbered_sequences(found).select("session_id", "run", "calls", "number")


@query("""with p as (select o_orderkey as key, o_orderkey % 5 as a, o_custkey % 4 as f from orders)
  select count(*) filter (a in (0, 1) and f > 0 or a = 2 and f = 1) as failed, count(*) filter (a in (0, 1) and f = 2) as convert_failed,
    count(*) filter (a in (0, 1) and f = 3) as upload_failed, count(*) filter (a in (0, 1) and f = 1 or a = 2 and f = 1) as delete_failed from p""")
def sync_execution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures by phase of a forced plan of uploads (0), stale items (1), orphans (2), skips and errors."""
    o = table(spark, sf_dir, "orders")
    action = F.element_at(F.array(*map(F.lit, ("upload", "stale", "orphan", "skip", "error"))), (F.col("o_orderkey") % 5 + 1).cast("int"))
    phase = F.element_at(F.array(*map(F.lit, ("none", "delete", "convert", "upload"))), (F.col("o_custkey") % 4 + 1).cast("int"))
    tried = o.filter("o_custkey % 4 > 0 and not (o_orderkey % 5 = 2 and o_custkey % 4 > 1)")
    attempts = tried.select(F.col("o_orderkey").alias("key"), phase.alias("phase"), F.lit("broken").alias("error"))
    return sync.failures_by_phase(sync.executed(o.select(F.col("o_orderkey").alias("key"), action.alias("action")), attempts, True))


@query("""select p_partkey from part where p_name not in (select regexp_extract('/x/' || p_name, '[^/]*$') from part where p_partkey % 3 = 0)""")
def sync_missing_by_leaf(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    remote = part.filter("p_partkey % 3 = 0").select(F.concat(F.lit("/x/"), "p_name").alias("path"))
    return sync.missing_by_leaf(part.select("p_partkey", F.concat_ws("/", "p_brand", "p_name").alias("path")), remote).select("p_partkey")


@query("""with o as (select c_custkey as k, 'old' || c_custkey as content from customer where c_custkey % 3 <> 0),
  n as (select c_custkey as k, 'new' || c_custkey as content, c_custkey % 2 = 0 as pdf from customer where c_custkey % 5 < 3)
  select coalesce(o.k, n.k)::varchar as name, case when n.k is null or (o.k is not null and not n.pdf) then o.content else n.content end as content,
    case when n.k is null then 'kept' when not n.pdf then 'refused: not a PDF' when o.k is null then 'added' else 'content replaced' end as outcome
  from o full join n on o.k = n.k where o.k is not null or n.pdf""")
def cloud_put(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    name = F.col("c_custkey").cast("string").alias("name")
    text_of = lambda word: F.concat(F.lit(word), F.col("c_custkey").cast("string")).alias("content")
    old = c.filter("c_custkey % 3 <> 0").select(F.lit("d").alias("parent_id"), name, text_of("old"), F.lit("m").alias("meta"))
    ext = F.when(F.col("c_custkey") % 2 == 0, "PDF").otherwise("epub").alias("ext")
    new = c.filter("c_custkey % 5 < 3").select(F.lit("d").alias("parent_id"), name, text_of("new"), F.lit("m").alias("meta"), ext)
    return sync.put(old, new, content_only=True).select("name", "content", "outcome")


@query("""with l as (select l_orderkey as doc, cast(row_number() over (partition by l_orderkey order by l_linenumber) - 1 as int) as page_index,
    l_partkey % 4 - 1 as source_page from (select distinct l_orderkey, l_linenumber, min(l_partkey) over (partition by l_orderkey, l_linenumber) as l_partkey from lineitem)),
  s as (select o_orderkey as doc, n as number, 100.0 + n as width from orders, unnest([1, 2]) as u(n)),
  j as (select l.*, s.width from l left join s on l.doc = s.doc and l.source_page + 1 = s.number),
  u as (select doc, arg_min(width, page_index) filter (width is not null) as usual from j group by 1)
  select j.doc, j.page_index, j.width is null as blank, coalesce(j.width, u.usual, f.width) as width from j join u on j.doc = u.doc
  left join s f on f.doc = j.doc and f.number = 1""")
def page_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with the size of the source page that they show; blank ones get their document's usual size."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("k"))
    at = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber")) - 1
    plan = li.select(F.col("l_orderkey").alias("doc"), at.alias("page_index"), (F.col("k") % 4 - 1).alias("source_page"))
    numbers = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc"), F.explode(F.array(F.lit(1), F.lit(2))).alias("number"))
    source = numbers.withColumn("width", 100.0 + F.col("number")).withColumn("height", F.lit(1.0))
    return pages.joined_to_source(plan, source).select("doc", "page_index", "blank", "width")


@query(r"""with t as (select event_id, case event_id % 6 when 0 then 'HTTP 401' when 1 then 'it doesn''t exist' when 2 then 'Token Expired' when 3 then 'page NOT found' else event_type end as m,
    ['', '0', '1'][1 + event_id % 3] as f, [' Editor ', 'default', ''][1 + event_id % 3] as l from events)
  select event_id, event_id % 6 in (0, 2) as auth, event_id % 6 in (1, 3) as missing, case when f = '1' then 0 end as cover,
    case when event_id % 3 = 0 then 'editor' else 'default' end as layout, strftime(to_timestamp(event_id * 3600) at time zone 'UTC', '%Y-%m-%dT%H:%M:%SZ') as at from t""")
def log_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    of = lambda words, n: F.element_at(F.array(*map(F.lit, words)), (k % n + 1).cast("int"))
    message = F.when(k % 6 < 4, of(("HTTP 401", "it doesn't exist", "Token Expired", "page NOT found", "", ""), 6)).otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").select(
        "event_id", text.is_auth_error(message).alias("auth"), text.is_not_found_error(message).alias("missing"), text.cover_page(of(("", "0", "1"), 3)).alias("cover"),
        text.layout(of((" Editor ", "default", ""), 3)).alias("layout"), text.rfc3339(k.cast("bigint") * 3600000).alias("at"),
    )


@query(r"""with d as (select doc_id, coalesce(text, '') || ' ![a](<x y.png> "t") ![b\]](u' || doc_id || '.png)' as t from documents),
  e as (select doc_id, unnest(regexp_extract_all(t, '!\[((?:\\.|[^\]])*)\]\((<[^>\n]*>|[^)\n]+)\)', 2)) as target from d)
  select doc_id, case when target like '<%' then regexp_extract(target, '^<([^>]*)>', 1) else regexp_extract(trim(target), '^\S*') end as path, count(*) as n from e group by 1, 2""")
def md_image_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    own = F.concat(F.coalesce("text", F.lit("")), F.lit(' ![a](<x y.png> "t") ![b\\]](u'), F.col("doc_id").cast("string"), F.lit(".png)"))
    target = d.select("doc_id", F.explode(markdown.image_targets(own)).alias("target"))
    return target.select("doc_id", markdown.split_target(F.col("target"))["path"].alias("path")).groupBy("doc_id", "path").agg(F.count("*").alias("n"))


@query(f"""select doc_id, sha256('# notes.go' || chr(10) || chr(10) || f || 'go' || chr(10) || t || case when t like '%' || chr(10) then '' else chr(10) end || f || chr(10)) as page_sha
  from (select doc_id, t, repeat('`', cast(greatest(3, coalesce({_RUNS_OF_TICKS.format("t")}, 0) + 1) as int)) as f from (select doc_id, {_TICKED} as t from documents))""")
def md_source_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.concat(F.coalesce("text", F.lit("")), F.lit(" "), F.repeat(F.lit("`"), (F.col("doc_id") % 5).cast("int")))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(markdown.source_page(F.lit("/src/notes.go"), F.lit(""), code), 256).alias("page_sha"))


@query()
def md_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with spaced and flattened lists; tested against hand-made texts."""
    d = markdown.with_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", F.sha2(markdown.spaced_lists(), 256).alias("spaced_sha"), F.sha2(markdown.flattened_lists(4), 256).alias("flat_sha"))


@query("""select c_custkey, round(1 + c_custkey % 9 / 2.0 * (1 - cos(radians(c_custkey % 360))) + 2 * sin(radians(c_custkey % 360)), 6) as first_x, 5 as n,
  round(c_custkey % 9 / 1.0, 6) as oval_width, chr(cast(98 + c_custkey // 26 % 20 as int)) || chr(cast(97 + c_custkey % 26 as int)) as letters from customer""")
def drawn_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turned rectangles, ovals and page letters."""
    k = F.col("c_custkey")
    shape = F.struct(
        F.lit(1.0).alias("x"), F.lit(2.0).alias("y"), (k % 9).cast("double").alias("width"), F.lit(4.0).alias("height"), (k % 360).cast("double").alias("degrees"),
        F.array(F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))).alias("points"),
    )
    rect, oval = ink.shape_points(F.lit("rect"), shape), ink.points_box(ink.shape_points(F.lit("ellipse"), shape))
    return table(spark, sf_dir, "customer").select(
        "c_custkey", F.round(F.get(rect, F.lit(0))["x"], 6).alias("first_x"), F.size(rect).alias("n"), F.round(oval["max_x"] - oval["min_x"], 6).alias("oval_width"),
        ink.page_letters(k % 520).alias("letters"),
    )


def _drawn_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of page files written from orders: a stroke for each return flag, a point for each line item."""
    li = table(spark, sf_dir, "lineitem")
    point = F.struct("l_linenumber", "l_partkey", F.col("l_quantity").cast("double").alias("x"), F.col("l_linenumber").cast("double").alias("y"), (F.col("l_partkey") % 50).cast("double").alias("width"))
    lines = li.groupBy("l_orderkey", "l_returnflag").agg(F.transform(F.array_sort(F.collect_list(point)), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), p["width"].alias("width"))).alias("points"))
    stroke = F.struct(F.lit(17).alias("tool"), F.lit(0).alias("color"), F.lit(2.0).alias("thickness"), "points")
    drawn = lines.groupBy(F.col("l_orderkey").alias("page")).agg(F.collect_list(stroke).alias("strokes"))
    return pagefile.page_blocks(drawn.select("page", pagewriter.page_file(F.col("strokes"), "made").alias("bytes")), ["page"])


@query("""select l_orderkey as page, count(distinct l_returnflag) as strokes, count(*) as points, max(l_partkey % 50)::double as widest,
  min(l_quantity)::double as min_x, max(l_quantity)::double as max_x, max(l_linenumber)::double as max_y from lineitem group by 1""")
def scene_strokes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strokes, points, widths and boxes of written and decoded page files."""
    drawn = scene.strokes(_drawn_blocks(spark, sf_dir))
    boxed = drawn.select("page", F.size("points").alias("n"), F.array_max(F.transform("points", lambda p: p["width"])).alias("w"), ink.points_box(F.col("points")).alias("box"))
    return boxed.groupBy("page").agg(
        F.count("*").alias("strokes"), F.sum("n").alias("points"), F.max("w").alias("widest"), F.min("box.min_x").alias("min_x"), F.max("box.max_x").alias("max_x"),
        F.max("box.max_y").alias("max_y"),
    )


@query("""with n as (select count(distinct l_orderkey) as pages from lineitem), s as (select count(*) as strokes from (select distinct l_orderkey, l_returnflag from lineitem))
  select u.type, case when u.type = 5 then strokes else pages end as blocks, 2 as last_version from n, s, unnest([1, 2, 4, 5]) as u(type)""")
def scene_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks by type and the version last seen of each."""
    b = _drawn_blocks(spark, sf_dir)
    return b.groupBy("type").agg(F.count("*").alias("blocks"), F.max_by("current_version", F.struct("page", "block")).alias("last_version"))
