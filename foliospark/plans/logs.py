"""Queries of session logs of any shape, reviews, day listings and drawn diagrams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions import text
from foliospark.operators import reports
from foliospark.plans.catalogue import query
from foliospark.session import delete_path, new_path, scratch, stored, table
from foliospark.sources import files


@query("""select 's' || user_id as session_id, cast(row_number() over (partition by user_id order by event_id) - 1 as int) as position,
    case user_id % 4 when 0 then event_type || ' "' || event_id || '"' when 1 then event_id::varchar end as command,
    case user_id % 4 when 0 then '{"k":' || floor(value)::bigint || '}' when 1 then '"' || event_type || '"' when 2 then event_id::varchar end as result
  from events where user_id % 4 <> 3""")
def session_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The calls of session logs of four shapes, a file each: objects, an array of one, bare values for objects, and no array of calls."""
    e = table(spark, sf_dir, "events")
    ident, kind = F.col("event_id").cast("string"), F.col("user_id") % 4
    whole = F.floor("value").cast("bigint")
    shapes = (
        F.to_json(F.struct(F.struct(F.concat("event_type", F.lit(' "'), ident, F.lit('"')).alias("command")).alias("input"), F.struct(F.struct(whole.alias("k")).alias("result")).alias("output"))),
        F.to_json(F.struct(F.struct(F.col("event_id").alias("command")).alias("input"), F.struct(F.col("event_type").alias("result")).alias("output"))),
        F.to_json(F.struct(F.col("event_type").alias("input"), F.struct(F.col("event_id").alias("result")).alias("output"))),
        F.to_json(F.struct(ident.alias("input"))),
    )
    call = F.when(kind == 0, shapes[0]).when(kind == 1, shapes[1]).when(kind == 2, shapes[2]).otherwise(shapes[3])
    own = e.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", call.alias("call")))), lambda c: c["call"]), ",").alias("calls"))
    calls = F.when(kind == 3, F.concat(F.lit('{"first":['), "calls", F.lit("]}"))).otherwise(F.concat(F.lit("["), "calls", F.lit("]")))
    session = F.concat(F.lit('{"id":"s'), F.col("user_id").cast("string"), F.lit('","tool_calls":'), calls, F.lit("}"))
    logs = new_path(spark, "session-logs")
    own.select(F.when(kind == 1, F.concat(F.lit("["), session, F.lit("]"))).otherwise(session).alias("value")).write.option("maxRecordsPerFile", 1).text(logs)
    with scratch(spark) as block:
        found = files.session_calls(
            files.session_variants(spark, logs), "$.tool_calls", {"session_id": "$.id"}, {"command": "$.input.command"}, {"result": "$.output.result"}
        )
        kept = stored(found, "session-calls")
        delete_path(spark, logs)
        return block.keep(kept)


@query(r"""with r as (select conv_id, list(coalesce(role, '') order by turn) as roles, coalesce(arg_min(coalesce(text, ''), turn), '') as notes from conversations group by 1),
    f as (select conv_id, roles, notes, 'validation-' || (conv_id * 60) as name, case when conv_id % 2 = 0 then 'pass' else 'fail' end as status from r)
  select name, sha256('{"documentId":"doc ' || conv_id || '","actions":' || to_json(roles)::varchar || ',"review":{"status":"' || status || '","notes":' || to_json(notes)::varchar
      || '},"timestamp":' || (1700000000123 + conv_id * 60000) || '}') as json_sha,
    sha256('# Validation Session: ' || name || chr(10) || chr(10) || '**Document ID:** doc ' || conv_id || '  ' || chr(10) || '**Timestamp:** '
      || strftime(to_timestamp(1700000000 + conv_id * 60) at time zone 'UTC', '%Y-%m-%dT%H:%M:%SZ') || '  ' || chr(10) || '**Status:** ' || status || chr(10) || chr(10)
      || '## Actions Performed' || chr(10) || chr(10) || array_to_string(list_transform(roles, lambda x: '- ' || x || chr(10)), '') || chr(10) || '## Review Notes' || chr(10) || chr(10)
      || case when notes = '' then '(no notes)' else notes end || chr(10)) as markdown_sha from f""")
def review_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A review of every conversation, its turns' roles as actions and its first turn as notes."""
    c = table(spark, sf_dir, "conversations")
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"))
    own = c.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(turn)), lambda t: t["role"]).alias("actions"), F.min_by(F.coalesce("text", F.lit("")), "turn").alias("notes"))
    key = F.col("conv_id")
    reviews = own.select(
        F.concat(F.lit("doc "), key.cast("string")).alias("document_id"), (F.lit(1_700_000_000_123) + key * 60_000).alias("timestamp"), "actions",
        F.when(key % 2 == 0, "pass").otherwise("fail").alias("status"), "notes", (key * 60).alias("saved_at"),
    )
    made = reports.review_reports(reviews)
    return made.select("name", F.sha2("json", 256).alias("json_sha"), F.sha2("markdown", 256).alias("markdown_sha"))


@query("""select cast(ts as date) as day, case when event_type = 'error' then '??:??' else strftime(ts - interval 4 hour, '%H:%M') end || '  '
    || case when event_type = 'view' then '📁' else '📄' end || ' ' || event_type || ' ' || event_id as line from events""")
def day_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of each day as a folder's lines, four hours behind UTC; those of errors have no time."""
    e = table(spark, sf_dir, "events")
    name = F.concat_ws(" ", "event_type", F.col("event_id").cast("string"))
    return reports.day_listing(
        e.select(F.to_date("ts").alias("day"), name.alias("name"), (F.col("event_type") == "view").alias("is_dir"), F.when(F.col("event_type") != "error", F.col("ts")).alias("modified")), -4
    )


@query(r"""select doc_id, sha256(t || chr(10) || '![mermaid diagram 1](./images/d' || doc_id % 3 || '-mermaid-001.png){width=5in}' || chr(10) || t || chr(10) || '```mermaid' || chr(10) || chr(10) || '```')
    as text_sha, 1 as pictures, 'graph ' || doc_id as source from (select doc_id, coalesce(text, '') as t from documents) where doc_id % 3 = 1
  union all select doc_id, sha256(t || chr(10) || '![mermaid diagram 1](./images/mermaid-001.png)' || chr(10) || t || chr(10) || '```mermaid' || chr(10) || chr(10) || '```'), 1, 'graph ' || doc_id
    from (select doc_id, coalesce(text, '') as t from documents) where doc_id % 3 <> 1""")
def md_mermaid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text twice, a diagram between the two and an empty one at the end."""
    t = F.coalesce("text", F.lit(""))
    ident = F.col("doc_id").cast("string")
    own = F.concat(t, F.lit("\n```mermaid\n  graph "), ident, F.lit(" \n  ```\n"), t, F.lit("\n```mermaid\n\n```"))
    made = F.when(F.col("doc_id") % 3 == 1, text.mermaid_pictures(own, "d1-", "5in")).otherwise(text.mermaid_pictures(own))
    drawn = table(spark, sf_dir, "documents").select("doc_id", made.alias("m"))
    return drawn.select("doc_id", F.sha2("m.text", 256).alias("text_sha"), F.size("m.pictures").alias("pictures"), F.get("m.pictures", F.lit(0))["source"].alias("source"))
