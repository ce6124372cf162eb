"""The queries of the training-data operators, with SQL oracles where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm import chat, decontam, exact_dedup, filter_audit, langid, packing, pii, secret_scan, simhash, token_archive, token_scan, warc, whitening
from foliospark.llm.common import new_path
from foliospark.session import table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-files")
    token_scan.write_token_files(table(spark, sf_dir, "documents"), path)
    counts = token_scan.scan_token_files(spark, path)
    number = F.regexp_extract("file", r"part-(\d+)[^/]*$", 1).cast("int")
    return counts.select(number.alias("file_number"), "doc_index", "start_token", "n_tokens", "terminated")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_report(table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_report(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents")).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket"
    )


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(table(spark, sf_dir, "conversations"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("doc_key")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    warc.write_archive(table(spark, sf_dir, "pages"), path)
    return warc.read_archive(spark, path).select(
        "page_id",
        F.octet_length("payload").cast("bigint").alias("payload_bytes"),
        F.sha1("payload").alias("payload_digest"),
        "record_type",
        "refers_to",
    )


def op11_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' token ids, written to range-coded files and read back."""
    path = new_path(spark, "token-archive")
    token_archive.write_archive(table(spark, sf_dir, "documents"), path)
    return token_archive.read_archive(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings on their eight principal components, whitened."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of five filters over all documents, by language."""
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_counts,
        op2_secrets,
        op3_exact_dedup,
        op4_pii,
        op5_packing,
        op6_chat,
        op7_simhash,
        op8_decontamination,
        op9_language_id,
        op10_warc,
        op11_token_output,
        op12_whitening,
        op13_filter_audit,
    )
}
ORACLES = {
    "op3_exact_dedup": """
        with norm as (
          select doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                          'abcdefghijklmnopqrstuvwxyz')) as text_sha256
          from documents)
        select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size,
               doc_id = max(doc_id) over w as kept, text_sha256
        from norm window w as (partition by text_sha256)""",
    "op6_chat": """
        with t as (
          select conv_id, turn, coalesce(role, 'unknown') as r, coalesce(text, '') as x,
                 coalesce('c' || conv_id, 'row' || row_number() over ()) as own
          from conversations),
        c as (
          select min(conv_id) as conv_id, list(sha256(r) || sha256(x) order by turn) as hs,
                 list('<|start|>' || replace(r, '<|', '< |') || chr(10) || replace(x, '<|', '< |')
                      || '<|end|>' || chr(10) order by turn) as parts
          from t group by own),
        k as (
          select conv_id, hs, array_to_string(hs, '|') as whole, len(hs) as n_turns,
                 array_to_string(parts, '') as chat
          from c),
        shorter as (
          select distinct array_to_string(hs[1:i], '|') as whole from k, unnest(range(1, n_turns)) as u(i)),
        g as (
          select whole, min(conv_id) as conv_id, max(n_turns) as n_turns, count(*) as n_copies,
                 any_value(chat) as chat
          from k group by whole)
        select conv_id, n_turns, n_copies, chat from g where whole not in (select whole from shorter)""",
    "op10_warc": """
        with sized as (
          select page_id, coalesce(html, '') as payload, strlen(coalesce(html, '')) as payload_bytes
          from pages),
        grouped as (select *, max(page_id) over (partition by payload) as first_id from sized)
        select page_id, payload_bytes, sha1(payload) as payload_digest,
               case when payload_bytes < 1000 or page_id = first_id then 'response' else 'revisit' end as record_type,
               case when payload_bytes < 1000 or page_id = first_id then null else first_id end as refers_to
        from grouped""",
    "op13_filter_audit": r"""
        with d as (select doc_id, coalesce(text, '') as t, coalesce(lang, '') as part from documents),
        w as (select *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from d),
        f as (
          select doc_id, part, len(ws) < 100 as a, 100 * len(list_distinct(ws)) < 80 * len(ws) as b,
                 100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) as c,
                 regexp_matches(t, '[#$%&*|]') as d, doc_id > min(doc_id) over (partition by t) as e
          from w),
        m as (
          select part, a::int + 2 * b::int + 4 * c::int + 8 * d::int + 16 * coalesce(e, false)::int as s, count(*) as n,
                 count(*) filter (doc_id in (select doc_id from labels where quality = 1)) as g,
                 count(*) filter (doc_id in (select doc_id from labels where toxic = 1)) as x
          from f group by all),
        l as (select unnest(['A', 'B', 'C', 'D', 'E']) as c),
        o as (
          select p.c || q.c || r.c || u.c || v.c as filter_order
          from l p, l q, l r, l u, l v
          where len(list_distinct([p.c, q.c, r.c, u.c, v.c])) = 5),
        k as (
          select filter_order, step, 1 << (ascii(filter_order[step]) - 65) as own,
                 list_sum(list_transform(range(0, step), lambda i: case when i = 0 then 0 else 1 << (ascii(filter_order[i]) - 65) end)) as before
          from o, (select unnest([1, 2, 3, 4, 5]) as step)),
        z as (
          select part, filter_order, step, own,
                 coalesce(sum(n) filter (s & (before | own) = 0), 0)::bigint as kept,
                 coalesce(sum(n) filter (s & own <> 0 and s & before = 0), 0)::bigint as removed,
                 coalesce(sum(n) filter (s & own <> 0 and s & before <> 0), 0)::bigint as redundant,
                 coalesce(sum(n) filter (s = own), 0)::bigint as unique_fails,
                 coalesce(sum(g) filter (s & own <> 0 and s & before = 0), 0)::bigint as good_lost,
                 coalesce(sum(x) filter (s & own <> 0 and s & before = 0), 0)::bigint as toxic_lost
          from m, (select *, before::bigint as b0 from k) group by part, filter_order, step, own)
        select part, filter_order, step::int as step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
               (sum(removed) over (partition by part, own))::bigint as shapley
        from z""",
}
