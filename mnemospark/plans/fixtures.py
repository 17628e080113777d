"""The memory layers as views over the star-schema tables; the same SQL text serves Spark and other engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.shared import shares

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS = {
    # One topic per user turn, with the assistant's reply if it follows.
    "v_topic": """
select conv_id*1000+turn as id, conv_id as scene_id,
       case when turn<4 then 1 when turn<6 then 2 else 3 end as depth,
       case when turn>=2 then conv_id*1000+turn-2 end as parent_id,
       (conv_id*100+turn)*1000 as user_ts,
       case when nrole='assistant' then (conv_id*100+turn+1)*1000 else 0 end as agent_ts,
       text as user_text, case when nrole='assistant' then ntext end as agent_text
from (select *, lead(role) over (partition by conv_id order by turn) as nrole,
             lead(text) over (partition by conv_id order by turn) as ntext from conversations) x
where role='user'""",
    "v_archive": """
select conv_id*1000+turn as id,
       case role when 'user' then 0 when 'assistant' then 1 else 2 end as role,
       case when role='assistant' then conv_id*1000+turn-1 else conv_id*1000+turn end as context_id,
       (conv_id*100+turn)*1000 as created_at, text as content from conversations""",
    "v_node": """
select p_partkey as id, p_brand as graph_id, p_name as title, p_type as node_type,
       concat(p_brand,' ',p_type) as content from part""",
    "v_edge_member": """
select distinct l.l_orderkey as edge_id, cast(substring(o.o_orderpriority,1,1) as int)-1 as kind, l.l_partkey as node_id
from lineitem l join orders o on o.o_orderkey=l.l_orderkey""",
    "v_usage": "select user_id as scene_id, count(*) as hit_count, max(ts) as last_hit from events group by user_id",
    "v_cap_use": "select user_id as cap_id, ts, case when event_type='error' then 0 else 1 end as success from events",
    # Node state for decay: importance by volume, emotion by the mix of events.
    "v_l1": """
select user_id as id, user_id as scene_id, least(1.0e0, count(*)/100.0e0) as importance,
       avg(case when event_type='purchase' then 1.0e0 else 0.0e0 end) as valence,
       avg(case when event_type='error' then 0.2e0 else 0.0e0 end) as arousal, max(ts) as updated_at
from events group by user_id""",
    # A changelog: an event per key; 'error' deletes.
    "v_log": "select user_id as id, event_id as seq, case when event_type='error' then 'D' else 'U' end as op, value as payload from events",
}

#: Columns of tables that a view reads, the first being the key that it joins them by. They are dealt by it into as many tasks as the
#: larger one's rows ask for: left to itself, the join and what follows it take as many rows a task as fit 64 MB of compressed shuffle.
DEALT = {"v_edge_member": {"lineitem": ("l_orderkey", "l_partkey"), "orders": ("o_orderkey", "o_orderpriority")}}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view, over frames instead of registered names: nothing is left in the session."""
    import re

    text = VIEWS[name]
    used = [t for t in TABLES if re.search(rf"\b(?:from|join) {t}\b", text)]
    for t in used:
        text = re.sub(rf"\b(from|join) {t}\b", rf"\1 {{{t}}}", text)
    frames = {t: table(spark, sf_dir, t) for t in used}
    if name in DEALT:
        n = shares(spark, max(f.count() for f in frames.values()))
        frames = {t: f.select(*DEALT[name][t]).repartition(n, DEALT[name][t][0]) for t, f in frames.items()}
    return spark.sql(text, **frames)


def ctes(*names: str) -> str:
    """The views as common table expressions, for engines that have only the base tables."""
    return "with " + ",\n".join(f"{n} as ({VIEWS[n]})" for n in names) + "\n"
