"""The signal and sequence tables that the queries read, as SQL over the given tables.

The text is accepted by Spark and DuckDB alike. Every view is over all rows and whole texts of its tables.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = ("events", "orders", "lineitem", "conversations", "embeddings")
#: In an order in which each uses only earlier ones.
VIEWS = {
    "reads_meta": """
select user_id as read_id,
       'FC0' || cast(1 + user_id % 3 as string) as source_file,
       'barcode0' || cast(1 + user_id % 4 as string) as barcode,
       cast(user_id % 7 - 3 as double) as offset_adc,
       case when user_id % 37 = 5 then null
            when user_id % 31 = 7 then cast('NaN' as double)
            when user_id % 29 = 9 then 0e0
            else 1e-1 + (user_id % 5) * 5e-2 end as scale,
       case when user_id % 11 = 0 then null when user_id % 11 = 1 then 4e3 else 5e3 end as read_sample_rate,
       count(*) as raw_length
from events group by user_id
""",
    "samples": """
select user_id as read_id,
       cast(row_number() over (partition by user_id order by ts, event_id) - 1 as int) as pos,
       cast(floor(value * 10) as int) as adc
from events
""",
    "readstats": """
select cast(o_orderkey as string) as name,
       'barcode0' || cast(1 + o_custkey % 3 as string) as barcode,
       case when o_orderkey % 97 = 0 then '' else cast(cast(floor(o_totalprice / 20) as bigint) as string) end as read_length,
       cast(o_orderkey % 150 as string) as qstart,
       cast(cast(floor(o_totalprice / 20) as bigint) - (o_orderkey * 7) % 150 as string) as qend,
       case when o_orderkey % 89 = 0 then 'nan' else cast(9e1 + ((o_orderkey * 37) % 1000) / 1e2 as string) end as acc,
       cast(9e1 + ((o_orderkey * 53) % 1000) / 1e2 as string) as coverage,
       cast(8e0 + ((o_orderkey * 17) % 150) / 1e1 as string) as mean_quality,
       'chr' || cast(o_custkey % 5 as string) as ref,
       cast(o_custkey as string) as rstart,
       cast(o_custkey + 700 as string) as rend
from orders
""",
    "raw_index": """
select l_orderkey as read_id,
       'FC0' || cast(1 + l_suppkey % 3 as string) as source_file,
       cast(max(l_quantity) * 1000 as bigint) as raw_length
from lineitem group by 1, 2
""",
    # one number for each (l_orderkey, l_partkey, l_suppkey), in their order
    "alignments": """
select l_orderkey as read_id,
       'chr' || cast(l_suppkey % 5 as string) as ref,
       l_partkey as start_pos,
       l_partkey + cast(max(l_quantity) as bigint) as end_pos,
       (l_orderkey * 10000000 + l_partkey) * 100000 + l_suppkey as ordinal,
       case when l_partkey % 53 = 0 then '' else md5(cast(l_partkey as string)) end as seq
from lineitem group by l_orderkey, l_partkey, l_suppkey
""",
    # Three callers of one signal, which the bytes of a turn stand for: each byte is two of four letters. The callers edit the
    # text first, and give some turns an id of their own, so ids are missing on every side.
    "calls_turns": """
select conv_id * 1000 + turn * 10 as id, role, text, length(text) as n,
       replace(text, 'q', '') as text_o,
       case when length(text) % 11 = 0 then '' else replace(replace(text, 'e', ''), 'th', 'ht') end as text_g
from conversations where text is not null
""",
    "calls_truth": """
select id + case when n % 17 = 0 then 1 else 0 end as read_id,
       case when n % 13 = 0 then '' else role end as barcode,
       translate(hex(text), '0123456789ABCDEF', 'ACGTACGTACGTACGT') as seq,
       translate(hex(text), '0123456789ABCDEF', '+,-./0123456789:') as qual
from calls_turns
""",
    "calls_original": """
select id + case when n % 13 = 0 then 2 else 0 end as read_id,
       translate(hex(text_o), '0123456789ABCDEF', 'ACGTACGTACGTACGT') as seq,
       translate(hex(text_o), '0123456789ABCDEF', '@ABCDEFGHIJKLMNO') as qual
from calls_turns
""",
    "calls_generated": """
select id + case when n % 7 = 0 then 3 else 0 end as read_id,
       translate(hex(text_g), '0123456789ABCDEF', 'ACGTACGTACGTACGT') as seq,
       translate(hex(text_g), '0123456789ABCDEF', '56789:;<=>?@ABCD') as qual
from calls_turns
""",
    "codebook": """
select cast(vec_id as int) as code, embedding as vec from embeddings where vec_id < 32
""",
    "latents": """
select vec_id, embedding as vec from embeddings where vec_id >= 32
""",
    "feature_pairs": """
select a.vec_id, a.embedding as y, b.embedding as y_hat
from embeddings a join embeddings b on b.vec_id = a.vec_id + 1
""",
    "step_log": """
select event_id + 1 as step, case when event_type = 'signup' then 'perplexity' else event_type end as metric, value
from events
""",
    "timings": """
select event_id + 1 as step, value as step_ms from events
""",
    "eval_history": """
select event_id as step, event_type as run,
       case when event_id % 7 = 0 then null when event_id % 97 = 3 then cast('NaN' as double) else value end as mean_qscore_delta,
       case when event_id % 14 = 0 then null else value / 2 end as summary_mean
from events
""",
}


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture table; views are replaced each time, frames made before keep their own plan."""
    for table in BASE:
        spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(table)
    if name.startswith("calls_"):
        spark.sql(VIEWS["calls_turns"]).createOrReplaceTempView("calls_turns")
    return spark.sql(VIEWS[name])


def oracle(body: str, extra: dict[str, str] | None = None) -> str:
    """``body`` with the fixture tables that it uses, and those they use, as common table expressions."""
    known = {**VIEWS, **(extra or {})}
    need, todo = set(), [body]
    while todo:
        text = todo.pop()
        for name in known:
            if name not in need and re.search(rf"\b{name}\b", text):
                need.add(name)
                todo.append(known[name])
    parts = ",\n".join(f"{n} as ({known[n].strip()})" for n in known if n in need)
    return f"with {parts}\n{body}" if parts else body
