"""The library's tables, derived from the star-schema test tables.

Each view is one SELECT that both Spark and the checking engine understand;
three notations differ between them and are filled in per dialect:
MILLIS[ts] (epoch milliseconds), LIST[a, b] (array) and UUID[text] (a
UUID-shaped text that is a function of `text`). All views cover whole tables.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages",
        "benchmark", "labels", "conversations")

_TENANT = "concat('user-', cast(label % 3 as string))"
_ENTRY_NO = "label * 10 + vec_id % 10"

VIEWS = {
    # --- vector tables -----------------------------------------------------
    "v_evidence": f"""
        select concat('ev-', lpad(cast(vec_id as string), 9, '0')) as point_id, embedding as vector, 'evidence' as source_type,
          concat('E', cast(cast(floor(vec_id / 5) as bigint) as string)) as evidence_id,
          concat('cam-', cast(vec_id % 7 as string)) as camera_id, {_TENANT} as user_id,
          concat('dev-', cast(vec_id % 11 as string)) as device_id, cast(label as int) as app_id,
          concat('INF-', cast(vec_id % 13 as string)) as infraction_code,
          LIST[cast(label as string), cast(10 + vec_id % 4 as string)] as category,
          vec_id % 4 <> 0 as weapon_analyzed, (vec_id % 4 <> 0 and vec_id % 3 = 0) as has_weapon,
          case when vec_id % 4 <> 0 and vec_id % 3 = 0
               then LIST['arma', case when vec_id % 2 = 0 then 'persona' else 'objeto' end] end as weapon_classes,
          cast(vec_id % 5 as int) as image_index, concat('http://img/', cast(vec_id as string), '.jpg') as image_url,
          cast(null as string) as blacklist_entry_id, cast(null as string) as blacklist_reference_id,
          cast(null as string) as model_version, timestamp '2024-01-01 00:00:00' + vec_id * interval '1' minute as created_at
        from embeddings""",
    "v_watch": f"""
        select concat('bl-', lpad(cast(vec_id as string), 9, '0')) as point_id, embedding as vector, 'blacklist' as source_type,
          cast(null as string) as evidence_id, cast(null as string) as camera_id, {_TENANT} as user_id,
          cast(null as string) as device_id, cast(null as int) as app_id, cast(null as string) as infraction_code,
          LIST[cast(label as string)] as category, cast(null as boolean) as weapon_analyzed, cast(null as boolean) as has_weapon,
          case when label < 0 then LIST[''] end as weapon_classes, cast(null as int) as image_index, concat('http://wl/', cast(vec_id as string), '.jpg') as image_url,
          UUID[concat('entry-', cast({_ENTRY_NO} as string))] as blacklist_entry_id,
          UUID[concat('ref-', cast(vec_id as string))] as blacklist_reference_id, 'clip-vit-b-32' as model_version,
          timestamp '2024-01-01 00:00:00' + vec_id * interval '1' second as created_at
        from embeddings""",
    "v_index": f"""
        select concat('ix-', lpad(cast(vec_id as string), 9, '0')) as point_id, embedding as vector, {_TENANT} as user_id,
          concat('ext-', cast(vec_id % 5 as string)) as external_id,
          UUID[concat('ixb-', cast(label % 3 as string), '-', cast(vec_id % 8 as string))] as batch_id, cast(vec_id as int) as item_index,
          case when vec_id % 6 = 0 then null when vec_id % 6 = 1 then '' else concat('item-', cast(vec_id as string)) end as item_ref,
          concat('http://ix/', cast(vec_id as string)) as source_url,
          case when vec_id % 9 = 0 then null when vec_id % 9 = 1 then 'other-model' else 'clip-vit-b-32' end as model_version
        from embeddings""",
    "v_landed": f"""
        select distinct UUID[concat('ixb-', cast(label % 3 as string), '-', cast(vec_id % 8 as string))] as id, {_TENANT} as user_id
        from embeddings""",
    "v_wl_entries": f"""
        select UUID[concat('entry-', cast(n as string))] as id, concat('Entry ', cast(n as string)) as name, concat('cat-', cast(n % 4 as string)) as category,
          cast(case when n % 5 = 0 then 2 else 3 end as int) as status, n % 4 <> 0 as active, concat('user-', cast(tenant as string)) as user_id,
          cast(1 + n % 3 as int) as blacklist_version, case when n % 3 = 0 then null else 0.2 + (n % 3) * 0.02 end as match_threshold,
          timestamp '2024-01-01 00:00:00' + n * interval '1' hour as created_at
        from (select {_ENTRY_NO} as n, min(label % 3) as tenant from embeddings group by {_ENTRY_NO}) as g""",
    "v_wl_refs": f"""
        select UUID[concat('ref-', cast(vec_id as string))] as id, UUID[concat('entry-', cast({_ENTRY_NO} as string))] as entry_id,
          concat('http://wl/', cast(vec_id as string), '.jpg') as image_url, cast(case when vec_id % 6 = 0 then 1 else 3 end as int) as status,
          timestamp '2024-01-01 00:00:00' + vec_id * interval '1' second as created_at
        from embeddings""",
    "v_wl_embs": f"""
        select UUID[concat('emb-', cast(vec_id as string))] as id, UUID[concat('entry-', cast({_ENTRY_NO} as string))] as entry_id,
          UUID[concat('ref-', cast(vec_id as string))] as reference_id, concat('bl-', lpad(cast(vec_id as string), 9, '0')) as qdrant_point_id,
          'clip-vit-b-32' as model_version, timestamp '2024-01-01 00:00:00' + vec_id * interval '1' second as created_at
        from embeddings""",
    # --- request tables ----------------------------------------------------
    "v_requests": """
        select concat('req-', cast(event_id as string)) as id, concat('E', cast(event_id as string)) as evidence_id,
          concat('cam-', cast(event_id % 17 as string)) as camera_id, concat('user-', cast(user_id as string)) as user_id,
          concat('dev-', cast(event_id % 23 as string)) as device_id, cast(event_id % 5 as int) as app_id,
          concat('INF-', cast(event_id % 13 as string)) as infraction_code,
          case when event_id % 7 = 0 then null when event_id % 7 = 1 then 'not json'
               when event_id % 7 = 2 then concat('["x",', cast(user_id % 10 as string), ']')
               else concat('[', cast(user_id % 10 as string), ',', cast(10 + event_id % 3 as string), ']') end as category,
          cast(case event_type when 'error' then 5 when 'view' then 1 when 'click' then 2 else 3 end as int) as status,
          LIST[concat('http://img/', cast(event_id as string), '.jpg')] as image_urls, concat('w-', cast(event_id % 3 as string)) as worker_id,
          case when event_type = 'error' then 'boom' end as error_message, cast(event_id % 4 as int) as retry_count,
          ts as processing_started_at,
          case when event_type = 'click' then null else ts + cast(floor(value) as int) * interval '1' second end as processing_completed_at,
          case when event_id % 11 = 0 then null
               else concat(cast(MILLIS[ts] - 97 * (event_id % 50) as string), '-', cast(event_id % 3 as string)) end as stream_message_id,
          event_id % 5 <> 0 as weapon_analyzed, event_id % 10 in (1, 3) as has_weapon,
          case when event_id % 10 in (1, 3) then LIST['arma', 'persona'] else LIST['none'] end as weapon_classes,
          value / 1000 as weapon_max_confidence, cast(null as string) as weapon_summary,
          case when event_id % 25 = 0 then 'timeout' end as weapon_analysis_error, ts as created_at,
          ts + interval '1' minute as updated_at
        from events""",
    "v_searches": """
        select concat('s-', cast(o_orderkey as string)) as id, concat('search-', cast(o_orderkey as string)) as search_id,
          concat('user-', cast(o_custkey % 50 as string)) as user_id, concat('http://q/', cast(o_orderkey as string), '.png') as image_url,
          cast(case o_orderstatus when 'F' then 3 when 'O' then 2 when 'P' then 4 else 1 end as int) as status,
          cast(1 + o_orderkey % 2 as int) as similarity_status,
          case when o_orderkey % 4 = 0 then 'image_index' else 'evidence' end as search_type,
          case when o_orderkey % 4 = 0 then LIST['ext-1', 'ext-2'] end as external_ids,
          0.5 as threshold, cast(20 as int) as max_results,
          concat('{"camera_id":"cam-', cast(o_orderkey % 7 as string), '"}') as search_metadata,
          cast(o_orderkey % 9 as int) as total_matches, cast(null as string) as results_key,
          case when o_orderkey % 5 = 0 then null else concat('q-', cast(o_orderkey as string)) end as qdrant_query_point_id,
          concat('w-', cast(o_orderkey % 3 as string)) as worker_id, cast(null as string) as error_message,
          cast(o_orderkey % 4 as int) as retry_count, o_orderdate + (o_orderkey % 86400) * interval '1' second as processing_started_at,
          o_orderdate + (o_orderkey % 86400) * interval '1' second + interval '1' hour as processing_completed_at,
          cast(null as string) as stream_message_id, o_orderdate as created_at, o_orderdate + interval '2' hour as updated_at
        from orders""",
    "v_matches": """
        select concat('m-', cast(l_orderkey as string), '-', cast(l_linenumber as string), '-', cast(l_partkey as string), '-', cast(l_suppkey as string), '-',
                      cast(cast(l_quantity as int) as string), '-', cast(cast(floor(l_extendedprice * 100 + 0.5) as bigint) as string)) as id,
          concat('s-', cast(l_orderkey as string)) as search_request_id, concat('E', cast(l_partkey as string)) as evidence_id,
          concat('cam-', cast(l_suppkey as string)) as camera_id, l_extendedprice / 123457 as similarity_score,
          concat('http://img/', cast(l_partkey as string), '.jpg') as image_url,
          concat('{"batch_id":"b-', cast(l_orderkey as string), '","item_index":', cast(l_linenumber as string), '}') as match_metadata,
          case when l_orderkey % 4 = 0 then concat('ext-', cast(l_suppkey % 5 as string)) end as external_id
        from lineitem""",
    # --- watch-list rows without vectors -------------------------------------
    "v_entries": """
        select concat('entry-', cast(c_custkey as string)) as id, case when c_custkey % 50 = 0 then '' else c_name end as name, c_mktsegment as category,
          cast(null as string) as description, cast(1 + c_custkey % 5 as int) as status, c_custkey % 3 <> 0 as active, c_custkey % 10 = 0 as is_archived,
          concat('user-', cast(c_nationkey as string)) as user_id, cast(1 + c_custkey % 4 as int) as blacklist_version,
          case when c_custkey % 2 = 0 then null else c_acctbal / 10000 end as match_threshold, cast(null as string) as json_data,
          timestamp '2024-01-01 00:00:00' + (c_custkey * 7919 % 100000) * interval '1' second as created_at,
          timestamp '2024-02-01 00:00:00' + c_custkey * interval '1' second as updated_at
        from customer""",
    "v_refs": """
        select concat('ref-', cast(o_orderkey as string)) as id, concat('entry-', cast(o_custkey as string)) as entry_id,
          concat('http://ref/', cast(o_orderkey as string), '.jpg') as image_url, 'reference' as image_type, cast(1 + o_orderkey % 4 as int) as status,
          case when o_orderkey % 4 = 3 then 'bad image' end as error_message, cast(o_orderkey % 3 as int) as retry_count,
          cast(null as string) as json_data, o_orderdate as created_at, o_orderdate + interval '1' day as updated_at
        from orders""",
    "v_embs": """
        select concat('emb-', cast(l_orderkey as string), '-', cast(l_linenumber as string), '-', cast(l_partkey as string), '-', cast(l_suppkey as string), '-',
                      cast(cast(l_quantity as int) as string), '-', cast(cast(floor(l_extendedprice * 100 + 0.5) as bigint) as string)) as id,
          concat('entry-', cast(o_custkey as string)) as entry_id, concat('ref-', cast(l_orderkey as string)) as reference_id,
          concat('p-', cast(l_partkey as string), '-', cast(l_orderkey as string), '-', cast(l_linenumber as string), '-', cast(l_suppkey as string)) as qdrant_point_id,
          'clip-vit-b-32' as model_version, cast(null as string) as json_data, l_shipdate as created_at
        from lineitem join orders on l_orderkey = o_orderkey""",
    # --- batches -------------------------------------------------------------
    "v_batches": """
        select concat('b-', cast(o_orderkey as string)) as id, concat('ref-', cast(o_orderkey as string)) as client_batch_ref,
          concat('ext-', cast(o_orderkey % 40 as string)) as external_id, concat('user-', cast(o_custkey % 25 as string)) as user_id,
          case when o_orderstatus = 'F' then 'completed' when o_orderkey % 2 = 0 then 'pending' else 'computing' end as status,
          cast(2 + o_orderkey % 4 as int) as submitted_count, cast(0 as int) as embedded_count, cast(0 as int) as filtered_count, cast(0 as int) as failed_count,
          cast(null as string) as source_ref, cast(null as string) as metadata, cast(null as string) as error_message,
          o_orderdate as created_at, o_orderdate as updated_at, case when o_orderstatus = 'F' then o_orderdate + interval '1' hour end as completed_at
        from orders""",
    "v_landings": """
        select concat('b-', cast(l_orderkey as string)) as batch_id, cast(l_linenumber as int) as item_index, concat('item-', cast(l_partkey as string)) as item_ref,
          concat('http://ix/', cast(l_partkey as string)) as source_url,
          case when l_returnflag = 'R' and l_linestatus = 'F' then 'download_failed' when l_returnflag = 'R' then 'no_result'
               when l_returnflag = 'N' and l_linestatus = 'F' then 'filtered' else 'embedded' end as status,
          cast(null as string) as qdrant_point_id, cast(null as int) as duplicate_of_index, cast(null as string) as error_message,
          concat(cast(MILLIS[l_shipdate] + 10000000000000 as string), lpad(cast(l_partkey as string), 9, '0'), lpad(cast(l_suppkey as string), 7, '0'),
                 lpad(cast(cast(floor(l_extendedprice * 100 + 0.5) as bigint) as string), 12, '0')) as seq
        from lineitem""",
    # --- streams ---------------------------------------------------------------
    "v_inputs": """
        select cast(user_id as string) as key, concat(cast(MILLIS[ts] as string), '-', cast(event_id % 3 as string)) as stream_id
        from events where event_type <> 'purchase'""",
    "v_outputs": """
        select cast(user_id as string) as key, concat(cast(MILLIS[ts] as string), '-', cast(event_id % 3 as string)) as stream_id
        from events where event_type = 'purchase'""",
    "v_messages": """
        select case event_type when 'view' then 'embeddings.computed' when 'click' then 'search.vector.computed' when 'purchase' then 'compute.error'
                    when 'signup' then 'made.up' end as event_type,
          case when event_id % 10 = 0 then '{broken' when event_id % 10 = 1 then null
               else concat('{"evidence_id":"E', cast(event_id as string), '","camera_id":"cam-', cast(user_id as string), '","app_id":', cast(event_id % 5 as string), '}') end as payload,
          concat(cast(MILLIS[ts] as string), '-', cast(event_id % 3 as string)) as stream_id
        from events""",
    "v_patches": """
        select concat('entry-', cast(user_id as string)) as entry_id, event_id as seq,
          case event_type when 'view' then concat('{"match_threshold":0.', cast(1 + event_id % 5 as string), '}')
            when 'click' then '{"active":false}' when 'purchase' then concat('{"active":true,"name":"N', cast(event_id as string), '"}')
            when 'signup' then '{"match_threshold":null,"category":null}'
            else concat('{"category":"C', cast(event_id % 3 as string), '","match_threshold":0.', cast(1 + event_id % 3 as string), '}') end as patch
        from events""",
}

def uuid_of(text: str) -> str:
    """The UUID[text] notation for a constant."""
    digest = hashlib.md5(text.encode()).hexdigest()
    return "-".join(digest[s - 1:s - 1 + n] for s, n in _UUID_PARTS)


_UUID_PARTS = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))


def _uuid(expr: str) -> str:
    return "concat(" + ", '-', ".join(f"substr(md5({expr}), {s}, {n})" for s, n in _UUID_PARTS) + ")"


def _fill(sql: str, millis: Callable[[str], str], array: str) -> str:
    sql = re.sub(r"UUID\[(.*?)\]", lambda m: _uuid(m.group(1)), sql)
    sql = re.sub(r"MILLIS\[(.*?)\]", lambda m: millis(m.group(1)), sql)
    return re.sub(r"LIST\[(.*?)\]", lambda m: f"{array}({m.group(1)})", sql)


def spark_sql(name: str) -> str:
    return _fill(VIEWS[name], lambda ts: f"unix_millis(cast({ts} as timestamp))", "array")


def check_sql(query: str) -> str:
    """Oracle text: the views a query names, as common table expressions in front of it."""
    used = [v for v in VIEWS if re.search(rf"\b{v}\b", query)]
    head = ",\n".join(f"{v} as ({_fill(VIEWS[v], lambda ts: f'(epoch_us({ts}) // 1000)', 'list_value')})" for v in used)
    body = _fill(query.strip(), lambda ts: f"(epoch_us({ts}) // 1000)", "list_value")
    if not used:
        return body
    if body.lower().startswith("with "):
        return f"with {head},\n{body[5:]}"
    return f"with {head}\n{body}"


class Domain:
    """Lazy access to base tables and views of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir.rstrip("/")
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def __getitem__(self, name: str) -> DataFrame:
        if name in BASE:
            return self.base(name)
        sql = spark_sql(name)
        tables = [t for t in BASE if re.search(rf"\b(from|join) {t}\b", sql)]
        sql = re.sub(r"\b(from|join) (" + "|".join(tables) + r")\b", r"\1 {\2}", re.sub(r"[{}]", lambda m: m.group(0) * 2, sql))
        df = self.spark.sql(sql, **{t: self.base(t) for t in tables})
        times = [f.name for f in df.schema if isinstance(f.dataType, T.TimestampNTZType)]
        return df.withColumns({t: F.col(t).cast("timestamp") for t in times}) if times else df
