"""The registered queries of this subpackage: thin calls of the operators on whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from walkloom.llm.chat import CONTROLS, as_records, format_records, read_back
from walkloom.llm.exact_dedup import exact_groups
from walkloom.llm.licences import DIGESTS, EQUIVALENTS, KNOWN, known_licences, scan_licences, sign_characters
from walkloom.llm.media import decode_media, encode_media
from walkloom.llm.mixing import mix
from walkloom.llm.near_dup import near_duplicates
from walkloom.llm.packing import pack
from walkloom.llm.quality import quality_scores
from walkloom.llm.secrets import fit_forest, labelled_findings, scan_secrets
from walkloom.llm.warc import TRACKING, captures_of_pages, resolve_revisits
from walkloom.sharedfs import table


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


def op2_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(table(spark, sf_dir, "documents"), known_licences(spark)).withColumnRenamed("id", "doc_id")


def op3_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), window=2048, with_ids=False).drop("ids")


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mix(table(spark, sf_dir, "documents"))
    return m.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=2, percent=80).select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return q.select(F.col("id").alias("doc_id"), "held_out", "score", F.col("accepted").cast("int").alias("predicted"))


def op7_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = resolve_revisits(captures_of_pages(table(spark, sf_dir, "pages")))
    merged = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))), "\n")
    return r.select("record_id", "canonical_url", "time", "verdict", "response_id", "response_time", merged.alias("merged_headers"), "payload_sha256", "payload_chars")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"), fit_forest(labelled_findings(spark)))
    return found.select(F.col("id").alias("doc_id"), "start", "length", F.sha2("candidate", 256).alias("candidate_sha256"), "score", "secret")


def op9_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = decode_media(encode_media(table(spark, sf_dir, "documents")))
    tail = F.crc32(F.expr("substring(payload, -64)"))
    return d.select(F.col("id").alias("doc_id"), "n_bytes", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), tail.alias("tail_crc32"), F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature", "height", "width", F.sha2("rgb", 256).alias("rgb_sha256"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return read_back(format_records(as_records(turns.unionByName(extra)))).withColumnRenamed("key", "conv_id")


def queries() -> dict:
    return {k: v for k, v in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return ORACLE


_SQUEEZED = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')"

ORACLE = {
    "op1_exact_dedup": f"""
        with t as (select doc_id, {_SQUEEZED} as body, length(coalesce(text, '')) as cp from documents),
        w as (select doc_id, first_value(doc_id) over (partition by body order by cp desc, doc_id) as keep_id,
                     cast(count(*) over (partition by body) as bigint) as group_size, sha256(body) as text_sha256 from t)
        select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from w""",
}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _escaped_length(column: str) -> str:
    rest = "|".join("".join("\\" + c if c in "|[]/<>" else c for c in x[1:]) for x in CONTROLS)
    return f"length(regexp_replace({column}, '([<\\[])(\\\\*)({rest})', '\\1#\\2\\3', 'g'))"


_SAID = "'</s>[INST] ok [/INST]'"
ORACLE["op10_chat_format"] = f"""
    with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
               union all select -1, 0, 'user', {_SAID} union all select -1, 1, 'assistant', {_SAID})
    select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn)) as turns_sha256,
           cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
           sha256(coalesce(string_agg(text, '' order by turn) filter (where role = 'assistant'), '')) as loss_sha256,
           cast(sum(24 + length(role) + {_escaped_length("text")}) as bigint) as formatted_chars
    from t group by conv_id"""


def _canonical_words(column: str) -> str:
    signs = " || ".join(_quoted(c) if c not in "\t\r\x0b\x0c" else f"chr({ord(c)})" for c in sign_characters())
    c = f"regexp_replace(lower(coalesce({column}, '')), '(?m)^[^\\p{{L}}\\p{{N}}\\n]*(?:copyright[^\\p{{L}}\\n]*(?:\\(c\\)|©|[0-9]{{4}})|\\(c\\)[^\\p{{L}}\\n]*[0-9]{{4}}|©)[^\\n]*$', '', 'g')"
    c = f"translate({c}, {signs}, repeat(' ', {len(sign_characters())}))"
    c = f"regexp_replace(regexp_replace({c}, ' +', '  ', 'g'), '(?m)^ *| *$', ' ', 'g')"
    for spelt, kept in EQUIVALENTS:
        c = f"replace({c}, {_quoted(' ' + spelt.replace(' ', '  ') + ' ')}, {_quoted(' ' + kept.replace(' ', '  ') + ' ')})"
    return c


_CLOSED = "trim(regexp_replace({}, '\\s+', ' ', 'g'), ' ')"
_KNOWN_ROWS = ", ".join(f"({i}, {_quoted(n)}, {_quoted(k)}, {_quoted(t)})" for i, (n, k, t) in enumerate(KNOWN))
_DIGEST_ROWS = ", ".join(f"({len(KNOWN) + i}, {_quoted(n)}, {_quoted(d)})" for i, (n, d) in enumerate(DIGESTS))
ORACLE["op2_licence_scan"] = f"""
    with f as (select place, licence, kind, {_CLOSED.format(_canonical_words("text"))} as body from (values {_KNOWN_ROWS}) v(place, licence, kind, text)),
    k as (select kind, digest, min_by(licence, place) as licence from (select place, licence, kind, sha256(body) as digest from f union all select place, licence, 'text', digest from (values {_DIGEST_ROWS}) v(place, licence, digest)) x group by 1, 2),
    d as (select doc_id, {_canonical_words("text")} as w from documents),
    l as (select doc_id, {_CLOSED.format("line")} as body from (select doc_id, unnest(string_split(w, chr(10))) as line from d) x),
    n as (select doc_id, string_agg(distinct licence, ',' order by licence) as notices, count(*) as lines from l join k on k.kind = 'notice' and k.digest = sha256(l.body) and l.body <> '' group by 1),
    t as (select doc_id, {_CLOSED.format("w")} as body from d)
    select t.doc_id, sha256(t.body) as text_digest, k.licence, coalesce(n.notices, '') as notices, coalesce(n.lines, 0) as notice_lines
    from t left join k on k.kind = 'text' and k.digest = sha256(t.body) and t.body <> '' left join n on n.doc_id = t.doc_id"""

_TRACKED = ", ".join(_quoted(x) for x in TRACKING)
ORACLE["op7_warc_revisits"] = f"""
    with u as (select page_id as p, html, md5(coalesce(html, '')) as tag, regexp_replace(regexp_replace(trim(url, ' '), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.\\-]*://', '') as u from pages),
    v as (select *, regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(u, '^([^/?]*)', 1)), '^.*@', ''), '^www\\d*\\.', ''), ':(?:80|443)$|\\.$', '') || regexp_replace(regexp_extract(u, '^[^/?]*([^?]*)', 1), '/+$', '') as base,
                 list_sort(list_filter(string_split(regexp_extract(u, '\\?(.*)$', 1), '&'), lambda x: x <> '' and lower(split_part(x, '=', 1)) not in ({_TRACKED}))) as q from u),
    w as (select *, base || case when len(q) > 0 then '?' || array_to_string(q, '&') else '' end as key, case when p % 13 = 0 then p * 10 - 5 else p * 10 + 7 + (p % 3) * 1000 end as asked,
                 'day ' || cast(p // 100 as varchar) as day, case when p % 11 = 0 then 'other' else tag end as sent from v),
    c as (select key, 2 * p as record_id, 10 * p as time, 1 as kind, p as r, p from w union all select key, 2 * p + 1, asked, 0, null, p from w),
    s as (select *, last_value(r ignore nulls) over (partition by key order by time, kind, record_id rows between unbounded preceding and current row) as got from c),
    j as (select s.record_id, s.key, s.time, m.p as mp, m.sent, m.day as mday, x.p as rp, x.tag as rtag, x.day as rday, x.html as rhtml,
                 case when x.p is null then 'no_earlier_response' when m.p % 7 <> 0 and m.sent <> x.tag then 'validators_differ' when m.p % 7 = 0 and m.day <> x.day then 'validators_differ' else 'resolved' end as verdict
          from s join w m on m.p = s.p left join w x on x.p = s.got where s.kind = 0)
    select record_id, key as canonical_url, cast(time as bigint) as time, verdict, case when verdict = 'resolved' then 2 * rp end as response_id, case when verdict = 'resolved' then 10 * rp end as response_time,
           case when verdict = 'resolved' then 'cache-control: max-age=60' || chr(10) || 'content-length: ' || cast(length(coalesce(rhtml, '')) as varchar) || chr(10) || 'content-type: text/html' || chr(10) || 'date: ' || cast(time as varchar) || chr(10)
             || 'etag: ' || case when mp % 7 = 0 or mp % 5 <> 0 or mp % 11 = 0 then '' else 'W/' end || '"' || case when mp % 7 = 0 then rtag else sent end || '"' || chr(10) || 'last-modified: ' || case when mp % 7 = 0 then mday else rday end end as merged_headers,
           case when verdict = 'resolved' then sha256(coalesce(rhtml, '')) end as payload_sha256, case when verdict = 'resolved' then length(coalesce(rhtml, '')) end as payload_chars from j"""
