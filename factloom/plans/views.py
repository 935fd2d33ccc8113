"""The engine's input tables as derived from the given ones, in SQL that Spark and DuckDB both run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS = {
    # news articles: a title line, the body, a link and a date
    "articles": """
        select doc_id as article_id, split_part(text, chr(10), 1) as title, concat('https://', source, '.example/', cast(doc_id as string), case when doc_id % 2 = 0 then '/' else '' end) as url,
               make_date(cast(2022 + doc_id % 3 as int), cast(1 + doc_id % 12 as int), cast(1 + doc_id % 28 as int)) as published_date, text, doc_id % 3 <> 0 as flag, lang, source
        from documents""",
    # numeric claims: one for each order line
    "claims": """
        select l_orderkey * 8 + l_linenumber as claim_id, l_orderkey as article_id, l_linenumber as pos, max(l_suppkey) as supp, max(l_partkey) as part,
               concat('In ', cast(max(year(l_shipdate)) as string), ' supplier ', cast(max(l_suppkey) as string), case when max(l_suppkey) % 3 = 0 then ' shipments fell to ' when max(l_suppkey) % 3 = 1 then ' shipments rose to ' else ' shipped ' end,
                      cast(cast(max(l_quantity) as int) as string), case when max(l_suppkey) % 4 = 0 then ' percent' else ' units' end, case when max(l_partkey) % 5 = 0 then ', the highest in 3 years.' when max(l_partkey) % 5 = 1 then ', a record low and the lowest since the merger.' else '.' end) as sentence,
               case max(l_returnflag) when 'A' then 'level' when 'N' then 'rate' else 'compare' end as claim_type,
               case when l_linenumber = 5 then null else max(l_quantity) end as value, case when max(l_suppkey) % 4 = 0 then '%' else 'units' end as unit,
               case when l_linenumber % 3 = 0 then 'delta' else 'level' end as value_type, case l_linenumber % 4 when 1 then 'increase' when 2 then 'decrease' else null end as comparison_operator,
               case when max(l_partkey) % 7 = 0 then concat('NATION_', cast(max(l_suppkey) % 25 as string)) else null end as comparison_target,
               case when max(l_suppkey) % 4 = 1 then null else concat('Supplier ', cast(max(l_suppkey) as string)) end as source_org,
               case when max(l_partkey) % 2 = 0 then cast(max(year(l_shipdate)) as string) else cast(max(year(l_shipdate) * 100 + month(l_shipdate)) as string) end as period,
               case when max(l_partkey) % 2 = 0 then 'Y' else 'M' end as freq
        from lineitem group by l_orderkey, l_linenumber""",
    # the catalog of statistics tables: one for each part
    "catalog": """
        select p_partkey as table_id, p_size as org_id, concat(p_name, ' ', lower(p_type)) as title, p_brand as category, split(p_name, ' ') as keywords,
               case when p_partkey % 9 = 0 then '' else concat(p_name, ' by ', p_brand) end as description, concat(p_name, ' ', p_brand) as embedding_text
        from part""",
    # official cells: shipped units of a supplier by flag, status and month
    "observations": """
        select l_suppkey as table_id, l_returnflag as item_id, l_linestatus as dim, 'M' as freq, cast(max(year(l_shipdate) * 100 + month(l_shipdate)) as string) as period, sum(l_quantity) as value,
               case when l_suppkey % 4 = 0 then '%' else 'units' end as unit
        from lineitem group by l_suppkey, l_returnflag, l_linestatus, year(l_shipdate), month(l_shipdate)""",
    # scored matches of claims with tables, from three sources
    "candidates": """
        select l_orderkey * 8 + l_linenumber as claim_id, l_partkey as table_id, case l_returnflag when 'A' then 'keyword' when 'N' then 'vector' else 'index' end as source, max(l_quantity) as score
        from lineitem group by l_orderkey * 8 + l_linenumber, l_partkey, l_returnflag""",
    # claims that name a statistic: one for each supplier
    "topics": """
        select s_suppkey as claim_id, concat('The ', p_name, ' market grew') as sentence, s_acctbal as balance, s_nationkey as nation from supplier join part on p_partkey = s_suppkey""",
    # finished verification records: one for each order
    "records": """
        select o_orderkey as result_id, concat('Customer ', cast(o_custkey as string)) as article_title, case o_orderstatus when 'F' then 'match' when 'O' then 'mismatch' else 'undecidable' end as verdict,
               cast(o_custkey % 100 as double) / 100 as score, o_orderdate as created_at, case when o_orderkey % 4 = 0 then null else cast(o_orderdate as date) end as published, o_custkey % 60 as table_id, o_orderpriority as status
        from orders""",
}


def _needs(sql: str, seen: list[str]) -> list[str]:
    """Views that sql names, those that they need first."""
    for v in VIEWS:
        if v not in seen and re.search(rf"\b{v}\b", sql):
            _needs(VIEWS[v], seen)
            seen.append(v)
    return seen


def over(sql: str) -> str:
    """DuckDB SQL with the views that it names put before it."""
    views = _needs(sql, [])
    if not views:
        return sql
    heads = ", ".join(f"{v} as ({VIEWS[v]})" for v in views)
    body = sql.lstrip()
    return f"with {heads}, {body[5:]}" if body.lower().startswith("with ") else f"with {heads} {body}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, or a view over them."""
    if name in BASE:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = VIEWS[name]
    tables = {b: spark.read.parquet(f"{sf_dir}/{b}.parquet") for b in BASE if re.search(rf"(from|join) {b}\b", sql)}
    for b in tables:
        sql = re.sub(rf"(from|join) {b}\b", rf"\1 {{{b}}}", sql)
    return spark.sql(sql, **tables)
