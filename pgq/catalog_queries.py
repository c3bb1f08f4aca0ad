"""Queries of the engine's own operators, each with the SQL that gives the same rows."""

from __future__ import annotations

import os
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pgq.functions import text
from pgq.operators import checks, evaluation, generate
from pgq.operators import corpus as K
from pgq.operators import normal as N
from pgq.operators.planner import plan
from pgq.plans.catalog import DRIVER, load
from pgq.plans.intent import REGIMES
from pgq.plans.policies import DEFAULT, PLACES
from pgq.session import dealt, prepare

QUERIES: dict = {}
ORACLE: dict = {}


def _intent(name: str, sql: str, target: str, path=(), filters=(), agg=None, order=None, limit=None, ret=(), regime=None):
    kind = "aggregation" if agg and agg[0] != "count" else "count" if agg else "ranking" if order else "lookup"
    raw = {
        "regime": regime or f"{'relational' if path else 'simple'}_{kind}_query",
        "schema": {
            "target": {"label": target}, "path": [list(p) for p in path], "filters": [{"node_label": f[0], "attribute": f[1], "operator": f[2], "value": f[3]} for f in filters],
            "aggregate": {"function": agg[0], "attribute": agg[1]} if agg else None, "order_by": {"node_label": order[0], "attribute": order[1], "direction": order[2]} if order else None,
            "limit": limit, "return_attributes": list(ret),
        },
    }
    QUERIES[name] = lambda spark, sf_dir: plan(spark, sf_dir, raw)
    ORACLE[name] = sql


def _agg(fn: str, col: str) -> str:
    """Sums of the raw column, with DuckDB's compensated sum: a plain one depends on the order of the rows."""
    s = f"fsum({col})"
    return f"{s} as sum_{col}" if fn == "sum" else f"{s} / count({col}) as avg_{col}" if fn == "avg" else f"{fn}({col}) as {fn}_{col}"


CNT = 'cast(count(*) as bigint) as "count"'
RN, NC, NS, CO, OL = ("Region", "CONTAINS", "Nation"), ("Nation", "HAS_CUSTOMER", "Customer"), ("Nation", "HAS_SUPPLIER", "Supplier"), ("Customer", "PLACED", "Order"), ("Order", "HAS_ITEM", "LineItem")
for _n, _op in (("eq", "="), ("ne", "!="), ("gt", ">"), ("lt", "<"), ("ge", ">="), ("le", "<=")):
    _intent(f"simple_lookup_{_n}", f"select p_partkey, p_name from part where p_size {_op} 20", "Part", filters=[("Part", "p_size", _op, 20)], ret=["p_partkey", "p_name"])
_intent("simple_lookup_contains", "select c_custkey, c_name from customer where contains(c_name, '42')", "Customer", filters=[(None, "c_name", "contains", "42")], ret=["c_custkey", "c_name"])
_intent("simple_lookup_multi_filter", "select c_custkey, c_name from customer where c_acctbal > 5000 and c_mktsegment = 'BUILDING'", "Customer", filters=[("Customer", "c_acctbal", ">", 5000), ("Customer", "c_mktsegment", "=", "BUILDING")], ret=["c_custkey", "c_name"])
_intent("date_filter", "select o_orderkey from orders where o_orderdate >= timestamp '1996-01-01' and o_orderdate < timestamp '1997-01-01'", "Order", filters=[("Order", "o_orderdate", "=", 1996)], ret=["o_orderkey"])
_intent("whole_node_return", "select s_suppkey, s_name, s_nationkey, s_acctbal from supplier where s_acctbal < 1000", "Supplier", filters=[("Supplier", "s_acctbal", "<", 1000)])
_intent("simple_count", f"select {CNT} from orders", "Order", agg=("count", None))
_intent("simple_count_filtered", f"select {CNT} from orders where o_orderstatus = 'F'", "Order", filters=[("Order", "o_orderstatus", "=", "F")], agg=("count", None))
for _f in ("avg", "sum", "min", "max"):
    _intent(f"simple_{_f}", f"select {_agg(_f, 'p_retailprice')} from part", "Part", agg=(_f, "p_retailprice"))
    _intent(f"rel_{_f}_1hop", f"select {_agg(_f, 'o_totalprice')} from customer join orders on c_custkey = o_custkey where c_mktsegment = 'MACHINERY'", "Order", [CO], [("Customer", "c_mktsegment", "=", "MACHINERY")], (_f, "o_totalprice"))
for _d in ("asc", "desc"):
    _intent(f"simple_ranking_{_d}", f"select s_suppkey, s_acctbal from supplier order by s_acctbal {_d}, s_suppkey limit 5", "Supplier", order=("Supplier", "s_acctbal", _d), limit=5, ret=["s_suppkey", "s_acctbal"])
_intent("rel_lookup_1hop", "select n_name from region join nation on r_regionkey = n_regionkey where r_name = 'ASIA'", "Nation", [RN], [("Region", "r_name", "=", "ASIA")], ret=["n_name"])
_intent("rel_lookup_2hop", "select c_custkey, c_name from region join nation on r_regionkey = n_regionkey join customer on n_nationkey = c_nationkey where r_name = 'ASIA' and c_acctbal > 5000", "Customer", [RN, NC], [("Region", "r_name", "=", "ASIA"), ("Customer", "c_acctbal", ">", 5000)], ret=["c_custkey", "c_name"])
_intent("rel_lookup_3hop", "select o_orderkey, o_totalprice from region join nation on r_regionkey = n_regionkey join customer on n_nationkey = c_nationkey join orders on c_custkey = o_custkey where r_name = 'EUROPE' and o_totalprice > 300000", "Order", [RN, NC, CO], [("Region", "r_name", "=", "EUROPE"), ("Order", "o_totalprice", ">", 300000)], ret=["o_orderkey", "o_totalprice"])
_intent("rel_count_1hop", f"select {CNT} from customer join orders on c_custkey = o_custkey where c_mktsegment = 'BUILDING' and o_totalprice > 100000", "Order", [CO], [("Customer", "c_mktsegment", "=", "BUILDING"), ("Order", "o_totalprice", ">", 100000)], ("count", None))
_intent("rel_count_2hop", f"select {CNT} from customer join orders on c_custkey = o_custkey join lineitem on o_orderkey = l_orderkey where l_returnflag = 'R'", "LineItem", [CO, OL], [("LineItem", "l_returnflag", "=", "R")], ("count", None))
_intent("rel_ranking_1hop", "select s_suppkey, s_acctbal from nation join supplier on n_nationkey = s_nationkey where n_nationkey < 5 order by s_acctbal desc, n_nationkey, s_suppkey limit 5", "Supplier", [NS], [("Nation", "n_nationkey", "<", 5)], order=("Supplier", "s_acctbal", "desc"), limit=5, ret=["s_suppkey", "s_acctbal"])
_intent("rel_ranking_2hop", "select c_custkey, c_acctbal from region join nation on r_regionkey = n_regionkey join customer on n_nationkey = c_nationkey where r_name = 'AFRICA' order by c_acctbal desc, r_regionkey, n_nationkey, c_custkey limit 10", "Customer", [RN, NC], [("Region", "r_name", "=", "AFRICA")], order=("Customer", "c_acctbal", "desc"), limit=10, ret=["c_custkey", "c_acctbal"])
_intent("self_relationship", "select b.n_nationkey, b.n_name from nation a join nation b on a.n_regionkey = b.n_regionkey where b.n_nationkey < 10", "Nation", [("Nation", "SAME_REGION", "Nation")], [("Nation", "n_nationkey", "<", 10)], ret=["n_nationkey", "n_name"])
_intent("label_default_filter", "select l.doc_id, quality from documents d join labels l on d.doc_id = l.doc_id where toxic = 1", "Label", [("Document", "HAS_LABEL", "Label")], [(None, "toxic", "=", 1)], ret=["doc_id", "quality"])

# -- a corpus of intents, from orders, that either engine can make ---------------------------------------------------------

TARGETS = ["Customer", "Supplier", "Part", "Order", "Nowhere"]
ATTRS = ["c_acctbal", "s_acctbal", "p_size", "o_totalprice", "nothing"]
OPS = ["=", ">", "<", ">=", "<="]
FNS = ["avg", "sum", "min", "max"]


def intents(spark: SparkSession, sf_dir: str, deal: bool = False) -> DataFrame:
    """Every order as an intent: regime by o_orderkey % 8, target by customer, filters by status and price.  deal: for steps
    that take long for a row."""
    o = prepare(spark).read.parquet(f"{sf_dir}/orders.parquet")
    o = dealt(o.select("o_orderkey", "o_custkey"), "o_orderkey") if deal else o
    i, c = F.col("o_orderkey"), F.col("o_custkey")
    at = lambda xs, k: F.element_at(F.array(*map(F.lit, xs)), (k % len(xs) + 1).cast("int"))
    flt = lambda k, v: F.struct(F.lit(None).cast("string").alias("node_label"), at(ATTRS, c).alias("attribute"), at(OPS, k).alias("operator"), v.cast("string").alias("value"))
    n = i % 3
    none = lambda kind: F.lit(None).cast(kind)
    step = F.struct(F.lit("Region").alias("src"), F.lit("CONTAINS").alias("rel"), F.lit("Nation").alias("dst"))
    return o.select(
        i.alias("id"), at(REGIMES, i).alias("regime"), at(TARGETS, c).alias("target"), F.when(i % 8 >= 4, F.array(step)).otherwise(F.slice(F.array(step), 1, 0)).alias("path"),
        F.slice(F.array(flt(i, i % 50), flt(c, c % 70)), F.lit(1), n.cast("int")).alias("filters"),
        F.when((i % 4 == 2), F.struct(at(FNS, c).alias("function"), at(ATTRS, c).alias("attribute"))).when(i % 4 == 1, F.struct(F.lit("count").alias("function"), none("string").alias("attribute"))).alias("aggregate"),
        F.when(i % 4 == 3, F.struct(none("string").alias("node_label"), at(ATTRS, c).alias("attribute"), at(["asc", "desc"], c).alias("direction"))).alias("order_by"),
        F.when((i % 4 == 3) & (c % 7 > 0), at([5, 10, 20], c)).cast("int").alias("limit"),
        F.slice(F.array(at(ATTRS, c), F.lit("extra")), F.lit(1), (c % 9 == 0).cast("int") + F.when(i % 4 == 0, 1).otherwise(0)).alias("return_attributes"),
    )


def _pick(xs, k):
    return f"[{', '.join(repr(x) for x in xs)}][({k}) % {len(xs)} + 1]"


CORPUS = f"""
c as (select o_orderkey as id, {_pick(REGIMES, 'o_orderkey')} as regime, {_pick(TARGETS, 'o_custkey')} as target, {_pick(ATTRS, 'o_custkey')} as attr, o_orderkey % 8 >= 4 as hop,
  o_orderkey % 3 as nf, {_pick(OPS, 'o_orderkey')} as op1, o_orderkey % 50 as v1, {_pick(OPS, 'o_custkey')} as op2, o_custkey % 70 as v2,
  case o_orderkey % 4 when 2 then {_pick(FNS, 'o_custkey')} when 1 then 'count' end as fn, case when o_orderkey % 4 = 3 then {_pick(['asc', 'desc'], 'o_custkey')} end as dir,
  case when o_orderkey % 4 = 3 and o_custkey % 7 > 0 then [5, 10, 20][o_custkey % 3 + 1] end as lim, (case when o_custkey % 9 = 0 then 1 else 0 end) + (case when o_orderkey % 4 = 0 then 1 else 0 end) as nr from orders)"""
CLASH = "(nf = 2 and ((op1 in ('>','>=') and op2 in ('<','<=') and v1 > v2) or (op2 in ('>','>=') and op1 in ('<','<=') and v2 > v1)))"
#: Reasons of the corpus once mended() has given paths that fit and broken() has spoilt some rows.
REASON = f"""case when id % 23 = 0 then 'intent_meta' when target = 'Nowhere' then 'target' when nr = 2 then 'return_attributes' when nf > 0 and id % 53 = 0 then 'label_not_in_pattern' when nf > 0 and id % 43 = 0 then 'filters'
  when {CLASH} then 'filters' when dir is not null and (id % 29 = 0 or id % 47 = 0) then 'order_by' when dir is not null and lim is null then 'limit' when hop and id % 41 <> 0 and id % 31 = 0 then 'path'
  when fn is not null and id % 37 = 0 then 'aggregate' when hop and id % 41 = 0 then 'regime_path' end"""
BUCKET = """concat_ws(';', regime, 'depth_' || (case when hop then '1' else '0' end), 'filter=' || (case when nf > 0 then '1' else '0' end), 'agg=' || (case when fn is not null then '1' else '0' end),
  'order=' || (case when dir is not null then '1' else '0' end), 'limit=' || (case when lim is not null then '1' else '0' end), 'proj_' || nr)"""
FEATURES = """f as (select id, unnest(list_distinct(['label:' || target] || (case when hop then ['label:Region', 'label:Nation', 'rel:CONTAINS'] else [] end)
  || (case when nf > 0 then ['attr:' || target || '.' || attr, 'op:' || op1] else [] end) || (case when nf > 1 then ['op:' || op2] else [] end))) as feature from c)"""
_ATTRS = {k: v.properties for k, v in DRIVER.labels.items()}


def _corpus(name: str, fn, sql: str, deal: bool = False):
    QUERIES[name] = lambda spark, sf_dir: fn(intents(spark, sf_dir, deal))
    ORACLE[name] = f"with {CORPUS}{', ' if sql.startswith('f as') else ' '}{sql}"


def mended(d: DataFrame) -> DataFrame:
    """Relational rows on a path that holds their target."""
    step = lambda *t: F.array(F.struct(*[F.lit(x).alias(n) for x, n in zip(t, ("src", "rel", "dst"), strict=True)]))
    fits = F.when(F.col("target") == "Customer", step(*NC)).when(F.col("target") == "Supplier", step(*NS)).when(F.col("target") == "Part", step("Part", "SOLD_AS", "LineItem")).otherwise(step(*CO))
    return d.withColumn("path", F.when(F.size("path") > 0, fits).otherwise(F.col("path")))


def broken(d: DataFrame) -> DataFrame:
    """Some rows spoilt in each way that the checks know."""
    i, every = F.col("id"), lambda n: F.col("id") % n == 0
    first = F.when(every(53), F.struct(F.lit("Region").alias("node_label"), F.lit("r_regionkey").alias("attribute"), F.lit("=").alias("operator"), F.lit("1").alias("value")))
    first = first.when(every(43), F.get("filters", 0).withField("operator", F.lit("~"))).otherwise(F.get("filters", 0))
    bad = F.struct(F.lit("Nation").alias("src"), F.lit("OWNS").alias("rel"), F.lit("Customer").alias("dst"))
    up = F.col("order_by").withField("direction", F.when(every(29), "up").otherwise(F.col("order_by.direction")))
    return d.select(
        "id", F.when(every(23), "odd_query").otherwise(F.col("regime")).alias("regime"), "target",
        F.when(every(41), F.slice("path", 1, 0)).when(every(31) & (F.size("path") > 0), F.concat("path", F.array(bad))).otherwise(F.col("path")).alias("path"),
        F.when(F.size("filters") > 0, F.concat(F.array(first), F.slice("filters", 2, 9))).otherwise(F.col("filters")).alias("filters"),
        F.when(~every(37), F.col("aggregate")).alias("aggregate"), F.when(~(i % 47 == 0) & F.col("order_by").isNotNull(), up).alias("order_by"), "limit", "return_attributes",
    )


def _reasoned(d: DataFrame) -> DataFrame:
    return broken(mended(d)).withColumn("reason", checks.reason(_ATTRS, list(DRIVER.patterns)))


_corpus("validate_reason_histogram", lambda d: _reasoned(d).groupBy(F.coalesce("reason", F.lit("ok")).alias("reason")).agg(F.count("*").alias("n")), f"select coalesce({REASON}, 'ok') as reason, count(*) as n from c group by 1")
_corpus("rejections_by_regime", lambda d: K.rejections(_reasoned(d)), f"select case when id % 23 = 0 then 'odd_query' else regime end as regime, {REASON} as reason, count(*) as n from c where {REASON} is not null group by 1, 2")
_corpus("interval_compat", lambda d: d.where(~K.compatible()).select("id"), f"select id from c where {CLASH}")
_corpus("bucket_signature_counts", lambda d: d.groupBy(K.bucket().alias("bucket")).agg(F.count("*").alias("n")), f"select {BUCKET} as bucket, count(*) as n from c group by 1")
_corpus("bucket_balance", lambda d: K.balance(d, 20, 50, 7).select("id", "bucket"), f"select id, bucket from (select id, {BUCKET} as bucket, row_number() over (partition by {BUCKET} order by md5('7:' || id), id) as r from c) where r <= 50")
_corpus("topk_regimes", lambda d: K.top_regimes(d, 3).groupBy("regime").agg(F.count("*").alias("n")), "select regime, count(*) as n from c group by 1 order by n desc, regime limit 3")
_corpus("feature_universe", lambda d: K.features(d).groupBy("feature").agg(F.count("*").alias("n")), f"{FEATURES} select feature, count(*) as n from f group by 1")
_SPLIT = f"""{FEATURES}, h as (select id, md5('3:' || id) as h from c), w as (select distinct arg_min(f.id, struct_pack(h := h.h, id := f.id)) as id from f join h on f.id = h.id group by feature),
r as (select h.id, w.id is not null as first, row_number() over (partition by w.id is not null order by h.h, h.id) as r from h left join w on h.id = w.id),
s as (select id, case when (first and r <= g) or (not first and r <= g - t) then 'train' else 'validation' end as part from r, (select floor(count(*) * 0.8)::bigint as g from c), (select count(*) as t from w))"""
_corpus("coverage_split", lambda d: K.split(d, 0.8, 3).select("id", "part"), f"{_SPLIT} select id, part from s")
_corpus("split_ratio_adjust", lambda d: K.split(d, 0.8, 3).groupBy("part").agg(F.count("*").alias("n")), f"{_SPLIT} select part, count(*) as n from s group by 1")
_corpus("coverage_missing", lambda d: K.missing(K.split(d, 0.8, 3)), f"{_SPLIT} select distinct feature from f where feature not in (select feature from f join s on f.id = s.id where part = 'train')")
_corpus("path_coverage", lambda d: K.counted(d, K.path_text(), "path"), "select case when hop then 'Region-CONTAINS->Nation' else '[]' end as path, count(*) as n from c group by 1")
_corpus("relationship_usage", lambda d: K.counted(d.select(F.explode("path").alias("p")), F.col("p.rel"), "rel"), "select 'CONTAINS' as rel, count(*) as n from c where hop")
_corpus("depth_distribution", lambda d: K.counted(d, F.size("path"), "depth"), "select case when hop then 1 else 0 end as depth, count(*) as n from c group by 1")
_corpus("node_coverage", K.node_coverage, "select label, n, round(n / (select count(*) from c), 3) as rate from (select label, count(*) as n from (select target as label from c union all select 'Region' from c where hop union all select 'Nation' from c where hop) group by 1)")
_corpus("target_entropy", lambda d: K.entropy(K.counted(d, F.col("target"), "target")), "select round(-sum(n / t * log2(n / t)), 4) as entropy from (select count(*)::double as n, sum(count(*)) over ()::double as t from c group by target)")
_corpus("mandatory_filter", lambda d: K.with_mandatory(d.withColumn("filters", F.transform("filters", lambda f: f.withField("node_label", F.col("target")))), "Customer", "c_mktsegment", "=", "BUILDING").select("id", F.size("filters").alias("n")), "select id, (nf + case when target = 'Customer' and nf > 0 then 1 else 0 end)::int as n from c")
_corpus("dedup_structures", lambda d: K.dedup_structures(d).select("id", "regime", "target"), "select min(id) as id, regime, target from c group by regime, target, hop, nf, case when nf > 0 then [op1, v1::varchar] end, case when nf > 1 then [op2, v2::varchar] end, fn, dir, lim, nr")
_corpus("top_paths", lambda d: K.top_paths(mended(d)), "select case when not hop then '[]' else case target when 'Customer' then 'Nation-HAS_CUSTOMER->Customer' when 'Supplier' then 'Nation-HAS_SUPPLIER->Supplier' when 'Part' then 'Part-SOLD_AS->LineItem' else 'Customer-PLACED->Order' end end as path, count(*) as n from c group by 1 order by n desc, path limit 5")
_corpus("target_rate", lambda d: K.rates(K.counted(d, F.col("target"), "target"), d.agg(F.count("*"))), "select target, count(*) as n, round(count(*) / (select count(*) from c), 3) as rate from c group by 1")
_corpus("augmentation_filter", lambda d: K.for_augmentation(d).select("id"), "select id from c where fn is not null and fn <> 'count' and nf = 0")
_corpus("duplicate_attributes", lambda d: d.where(~generate.distinct_attributes()).select("id"), "select id from c where nf = 2")
_corpus("intent_sections", lambda d: d.select("id", text.sections().alias("text")), """select id, concat_ws(chr(10) || chr(10), 'Query regime:' || chr(10) || '- ' || regime, 'Target entity:' || chr(10) || '- ' || target, case when hop then 'Relationships:' || chr(10) || '- Nation located inside Region' end,
  case when nf > 0 then 'Conditions:' || chr(10) || '- None ' || attr || ' ' || {0} || ' ' || v1 || (case when nf > 1 then chr(10) || '- None ' || attr || ' ' || {1} || ' ' || v2 else '' end) end,
  case when fn is not null then 'Aggregation:' || chr(10) || '- ' || fn || (case when fn <> 'count' then ' of ' || attr else '' end) end, case when dir is not null then 'Sorting:' || chr(10) || '- ' || attr || ' ' || dir end,
  case when lim is not null then 'Limit:' || chr(10) || '- ' || lim end, case when nr > 0 then 'Return:' || chr(10) || '- ' || attr || (case when nr > 1 then ', extra' else '' end) end) as text from c""".format(*["case %s when '=' then 'exactly equal to' when '>' then 'more than' when '<' then 'less than' when '>=' then 'at least' else 'at most' end" % o for o in ("op1", "op2")]))
_corpus("instruction_prompt", lambda d: d.select("id", text.instruction_prompt(F.col("target"), "Answer in JSON.").alias("prompt")), "select id, '### Instruction:' || chr(10) || 'Answer in JSON.' || chr(10) || chr(10) || '### Question:' || chr(10) || target || chr(10) || chr(10) || '### Answer:' || chr(10) as prompt from c")
_corpus("paraphrase_prompt", lambda d: d.select("id", text.paraphrase_prompt(F.col("target"), F.col("regime"), {r: f"Keep {r}." for r in REGIMES}, 15).alias("prompt")), """select id, 'Query regime: ' || regime || chr(10) || chr(10) || 'Keep ' || regime || '.' || chr(10) || chr(10) || 'Generate 15 paraphrases.' || chr(10) || chr(10) || 'Question:' || chr(10) || '"' || target || '"' as prompt from c""")
_VALUE = """'{"node_label":null,"attribute":"' || attr || '","operator":"' || @op || '",' || (case when attr = 'nothing' then '"value_str":"' || @v || '","value_int":null' else '"value_str":null,"value_int":' || @v end) || ',"value_float":null}'"""
_corpus("training_rows", lambda d: text.training_rows(d.withColumn("q", F.when(F.col("id") % 6 > 0, F.concat(F.lit(" "), F.col("target"), F.lit(" ")))), "q", _ATTRS), """select target as question, regime, '{"target":{"label":"' || target || '"},"path":[' || (case when hop then '{"source":{"label":"Region"},"relationship":"CONTAINS","target":{"label":"Nation"}}' else '' end) || '],"filters":['
  || (case when nf > 0 then @one else '' end) || (case when nf > 1 then ',' || @two else '' end) || '],"order_by":' || coalesce('{"node_label":null,"attribute":"' || attr || '","direction":"' || dir || '"}', 'null') || ',"limit":' || coalesce(lim::varchar, 'null')
  || ',"aggregate":' || (case when fn is null then 'null' when fn = 'count' then '{"function":"count","attribute":null}' else '{"function":"' || fn || '","attribute":"' || attr || '"}' end)
  || ',"return_attributes":[' || (case when nr > 0 then '"' || attr || '"' else '' end) || (case when nr > 1 then ',"extra"' else '' end) || ']}' as schema from c where id % 6 > 0""".replace("@one", _VALUE.replace("@op", "op1").replace("@v", "v1")).replace("@two", _VALUE.replace("@op", "op2").replace("@v", "v2")))
_corpus("intent_to_text", lambda d: d.select("id", text.intent_text().alias("text")), """select id, concat_ws(chr(10), 'Regime: ' || regime, 'Target: ' || target, case when hop then 'Path: Region CONTAINS Nation' end,
  case when nf > 0 then 'Where: ' || attr || ' ' || {0} || ' ' || v1 || (case when nf > 1 then ' and ' || attr || ' ' || {1} || ' ' || v2 else '' end) end,
  case when fn is not null then 'Compute: ' || fn || (case when fn <> 'count' then ' of ' || attr else '' end) end, case when dir is not null then 'Order: ' || attr || ' ' || dir end,
  case when lim is not null then 'Limit: ' || lim end, case when nr > 0 then 'Return: ' || attr || (case when nr > 1 then ', extra' else '' end) end) as text from c""".format(*["case %s when '=' then 'equal to' when '>' then 'more than' when '<' then 'less than' when '>=' then 'at least' else 'at most' end" % o for o in ("op1", "op2")]))
_corpus("prompt_build", lambda d: d.select("id", text.prompt(F.concat(F.lit("  which "), F.col("target"), F.lit("? "))).alias("prompt")), "select id, 'Answer with a query intent in JSON.' || chr(10) || '### Question: which ' || target || '?' || chr(10) || '### Answer:' || chr(10) as prompt from c")
_corpus("json_extract", lambda d: d.select("id", text.first_object(F.concat(F.lit('so: {"a": {"b": '), F.col("id").cast("string"), F.lit("}} and {}"))).alias("json")), """select id, '{"a": {"b": ' || id || '}}' as json from c""")
_corpus("paraphrase_union", lambda d: text.paraphrases(d.select("id", F.col("target").alias("question"))), "select id, unnest([target, 'Please tell me: ' || target, 'I would like to know: ' || target]) as question from c")


def _expanded(d: DataFrame) -> DataFrame:
    pol = d.sparkSession.createDataFrame([("Customer", "avg", "c_acctbal"), ("Customer", "sum", "c_acctbal"), ("Part", "max", "p_size")], "label string, function string, attribute string")
    return K.expand_aggregates(d, pol).groupBy("target", "aggregate.function", "aggregate.attribute").agg(F.count("*").alias("n"))


def _ranked(d: DataFrame) -> DataFrame:
    pol = d.sparkSession.createDataFrame([("Customer", "c_acctbal"), ("Part", "p_size"), ("Part", "p_retailprice")], "label string, attribute string")
    return K.expand_ranking(d, pol).groupBy("target", "order_by.attribute", "order_by.direction", "limit").agg(F.count("*").alias("n"))


_corpus("agg_expansion", _expanded, "select target, function, attribute, sum(1 + case when nf > 0 then 1 else 0 end)::bigint as n from c join (values ('Customer', 'avg', 'c_acctbal'), ('Customer', 'sum', 'c_acctbal'), ('Part', 'max', 'p_size')) p(label, function, attribute) on target = label group by 1, 2, 3")
_corpus("order_limit_expansion", _ranked, "select target, attribute, direction, \"limit\", count(*) as n from c join (values ('Customer', 'c_acctbal'), ('Part', 'p_size'), ('Part', 'p_retailprice')) p(label, attribute) on target = label, (values ('asc'), ('desc')) d(direction), (values (5), (10), (20)) l(\"limit\") group by 1, 2, 3, 4")


# -- evaluation: expected and predicted schemas as JSON text, wrong in every way the comparison tells apart ----------------


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order's intent as JSON, beside a prediction with other targets, paths, labels to order by and limits, a number
    of another type, filters and keys that are missing or too many, and parts that are null."""
    d = intents(spark, sf_dir, deal=True)
    i, n, nf = F.col("id"), lambda k: F.col("id") % k == 0, F.size("filters")
    q = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    obj = lambda **kv: F.concat(F.lit("{"), *[x for j, (k, v) in enumerate(kv.items()) for x in (F.lit(("," if j else "") + f'"{k}":'), v)], F.lit("}"))
    null, target = F.lit("null"), F.col("target")
    flt = lambda k, tail: obj(node_label=q(target), attribute=q(F.get("filters", k)["attribute"]), operator=q(F.get("filters", k)["operator"]), value=F.concat(F.get("filters", k)["value"], tail))
    listed = lambda *xs: F.concat(F.lit("["), F.array_join(F.array_compact(F.array(*xs)), ","), F.lit("]"))
    step, more = F.lit('{"src":"Region","rel":"CONTAINS","dst":"Nation"}'), F.lit('{"src":"Nation","rel":"HAS_CUSTOMER","dst":"Customer"}')
    agg = F.when(F.col("aggregate").isNotNull(), obj(function=q(F.col("aggregate.function")), attribute=F.coalesce(q(F.col("aggregate.attribute")), null))).otherwise(null)
    order = lambda label: F.when(F.col("order_by").isNotNull(), obj(node_label=q(label), attribute=q(F.col("order_by.attribute")), direction=q(F.col("order_by.direction")))).otherwise(null)
    limit, hop = F.coalesce(F.col("limit").cast("string"), null), F.size("path") > 0
    rets = listed(*[q(F.get("return_attributes", k)) for k in (0, 1)])
    gold = obj(target=obj(label=q(target)), path=listed(F.when(hop, step)), filters=listed(F.when(nf > 0, flt(0, F.lit(""))), F.when(nf > 1, flt(1, F.lit("")))), aggregate=agg, order_by=order(target), limit=limit, return_attributes=rets)
    tail = F.when(i % 4 == 1, ".0").otherwise("")
    pred = obj(
        target=obj(label=q(F.when(n(5), "Region").otherwise(target))), path=listed(F.when(hop & (i % 6 != 4), step), F.when(hop & n(13), more)),
        filters=listed(F.when(nf > 0, flt(0, tail)), F.when((nf > 1) & ~n(2), flt(1, tail)), F.when(n(11), obj(node_label=q(target), attribute=F.lit('"extra"'), operator=F.lit('"="'), value=F.lit('"x"')))),
        aggregate=F.when(n(17), null).otherwise(agg), order_by=order(F.when(n(9), "Region").otherwise(target)),
        **{"return_attributes": F.when(n(10), listed(F.lit('"other"'))).otherwise(rets)},
    )
    other = F.when(n(19), "}").otherwise(F.concat(F.lit(',"limit":'), F.when(n(7), F.lit('"7"')).when(n(3), F.lit("7")).otherwise(limit), F.lit("}")))
    pred = F.concat(F.substring(pred, F.lit(1), F.length(pred) - 1), other)
    return evaluation.judged(d.select("id", "regime", F.when(n(10), "other").otherwise(F.col("regime")).alias("predicted_regime"), gold.alias("gold"), pred.alias("predicted")), deal=False)


_EXTRA = """case when id % 11 = 0 then '{"attribute":"extra","node_label":"' || target || '","operator":"=","value":"x"}' end"""
_MORE = """case when hop and id % 13 = 0 then '{"dst":"Customer","rel":"HAS_CUSTOMER","src":"Nation"}' end"""
_FLT = """case when {cond} then '{{"attribute":"' || attr || '","node_label":"' || target || '","operator":"' || {op} || '","value":' || {v} || '}}' end"""
#: Lists in order of their JSON text; for components with the closing brace as a blank, so that 5 comes before 57 as it does
#: in text.
_IN_ORDER = "list_sort(list_transform(list_filter([%s], lambda x: x is not null), lambda x: replace(x, '~', '~')))"
_BY_VALUE = ("lambda x: replace(x, '~', '~')", "lambda x: replace(x, '}', ' ')")
_LIST = "'[' || replace(coalesce(array_to_string(" + _IN_ORDER + ", ','), ''), ' ', '}') || ']'"
_AGG = """case when fn is null then 'null' when fn = 'count' then '{"attribute":null,"function":"count"}' else '{"attribute":"' || attr || '","function":"' || fn || '"}' end"""
_STEPS = """case when hop%s then '{"dst":"Nation","rel":"CONTAINS","src":"Region"}' end"""
_RETS = _LIST % """case when nr > 0 then '"' || attr || '"' end, case when nr > 1 then '"extra"' end"""
#: Both trees with lists in order, flattened by DuckDB, met node by node: a node counts if its parents are containers of one
#: type, and, in a list, if both sides have it.
EVAL = f"""j as (select id, '{{"target":{{"label":"' || target || '"}},"path":' || {_LIST % (_STEPS % '')} || ',"filters":' || {_LIST % (_FLT.format(cond='nf > 0', op='op1', v='v1') + ', ' + _FLT.format(cond='nf > 1', op='op2', v='v2'))} || ',"aggregate":' || {_AGG}
  || ',"order_by":' || coalesce('{{"node_label":"' || target || '","attribute":"' || attr || '","direction":"' || dir || '"}}', 'null') || ',"limit":' || coalesce(lim::varchar, 'null') || ',"return_attributes":' || {_RETS} || '}}' as g,
  '{{"target":{{"label":"' || (case when id % 5 = 0 then 'Region' else target end) || '"}},"path":' || {_LIST % (_STEPS % ' and id % 6 <> 4' + ', ' + _MORE)}
  || ',"filters":' || {_LIST % (_FLT.format(cond='nf > 0', op='op1', v="v1 || (case when id % 4 = 1 then '.0' else '' end)") + ', ' + _FLT.format(cond='nf > 1 and id % 2 <> 0', op='op2', v="v2 || (case when id % 4 = 1 then '.0' else '' end)")
    + ', ' + _EXTRA)}
  || ',"aggregate":' || (case when id % 17 = 0 then 'null' else {_AGG} end) || ',"order_by":' || coalesce('{{"node_label":"' || (case when id % 9 = 0 then 'Region' else target end) || '","attribute":"' || attr || '","direction":"' || dir || '"}}', 'null')
  || (case when id % 19 = 0 then '' else ',"limit":' || (case when id % 7 = 0 then '"7"' when id % 3 = 0 then '7' else coalesce(lim::varchar, 'null') end) end) || ',"return_attributes":' || (case when id % 10 = 0 then '["other"]' else {_RETS} end) || '}}' as p from c),
gt as (select j.id, t.fullkey as k, t.path as up, replace(t.type, 'UBIGINT', 'BIGINT') as ty, t.value::varchar as v from j, json_tree(j.g::json) t),
pt as (select j.id, t.fullkey as k, t.path as up, replace(t.type, 'UBIGINT', 'BIGINT') as ty, t.value::varchar as v from j, json_tree(j.p::json) t),
n as (select id, k, coalesce(gt.up, pt.up) as up, gt.ty as gty, pt.ty as pty, gt.v as gv, pt.v as pv from gt full join pt using (id, k)),
m as (select n.*, u.gty as uty, case when u.gty = 'ARRAY' then json_array_length(u.gv::json) = json_array_length(u.pv::json) end as even from n left join n u on n.id = u.id and n.up = u.k and n.k <> '$'
  where n.k = '$' or (u.gty = u.pty and (u.gty = 'OBJECT' or (u.gty = 'ARRAY' and n.gty is not null and n.pty is not null)))),
w as (select id, ltrim(k[2:], '.') as path, even, uty, gty, pty, coalesce(gty = pty and gty not in ('OBJECT', 'ARRAY') and gv = pv, false) as hit,
  case when gty is null then '<missing>' when gty = 'ARRAY' and pty = 'ARRAY' then json_array_length(gv::json)::varchar when gty = 'VARCHAR' then trim(gv, '"') when gty = 'NULL' then 'None' when gty = 'OBJECT' then replace(replace(gv, ':', ': '), ',', ', ') else gv end as expected,
  case when pty is null then '<missing>' when gty = 'ARRAY' and pty = 'ARRAY' then json_array_length(pv::json)::varchar when pty = 'VARCHAR' then trim(pv, '"') when pty = 'NULL' then 'None' else pv end as predicted, gv, pv from m),
e as (select id, path, expected, predicted from w where gty is null or pty is null or gty <> pty or (gty = 'ARRAY' and expected <> predicted) or (gty not in ('OBJECT', 'ARRAY') and gv <> pv)),
f as (select id, hit::bigint as correct, case when gty is null or pty is null or gty <> pty then (select count(*) from json_tree(coalesce(gv, pv)::json) t where t.type not in ('OBJECT', 'ARRAY')) when gty in ('OBJECT', 'ARRAY') then 0 else 1 end as total from w)"""
_EVENLY = "p as (select path, (case when gty = 'ARRAY' and pty = 'ARRAY' then list_sort(json_extract(gv::json, '$[*]')::varchar[]) = list_sort(list_transform(json_extract(pv::json, '$[*]')::varchar[], lambda x: replace(x, '.0}', '}'))) else hit end)::bigint as correct from w where not coalesce(gty = 'OBJECT' and pty = 'OBJECT', false) and not exists (select 1 from m u where u.id = w.id and starts_with(u.k, '$.') and not u.even and (ltrim(u.k[2:], '.') = w.path or starts_with(w.path, ltrim(u.k[2:], '.') || '.'))))"


def _judged(name: str, fn, sql: str):
    QUERIES[name] = lambda spark, sf_dir: fn(judged(spark, sf_dir))
    ORACLE[name] = f"with {CORPUS}, {EVAL}{sql}" if name != "component_accuracy" else f"with {CORPUS}, {EVAL.replace(*_BY_VALUE)}{sql}"


_judged("schema_diff", evaluation.errors, " select id, path, expected, predicted from e")
_judged("component_accuracy", evaluation.component_accuracy, f", {_EVENLY} select path as component, count(*) as total, sum(correct)::bigint as correct, round(100.0::double * sum(correct) / count(*), 2) as accuracy from p group by 1")
_judged("error_ranking", evaluation.error_ranking, " select path, expected, predicted, count(*) as n from e group by 1, 2, 3")
_judged("error_paths", evaluation.error_paths, " select path, count(*) as n from e group by 1 order by n desc, path limit 20")
_judged("field_accuracy", evaluation.field_accuracy, " select sum(correct)::bigint as correct, sum(total)::bigint as total, round(100.0::double * sum(correct) / sum(total), 2) as accuracy from f")
_judged("exact_match", evaluation.exact_match, " select (t - b)::bigint as exact, t::bigint as total, round(100.0::double * (t - b) / t, 2) as accuracy from (select (select count(*) from c) as t, (select count(distinct id) from e) as b)")
_judged("regime_accuracy", evaluation.regime_accuracy, " select count(*) filter (id % 10 <> 0) as correct, count(*) as total, round(100.0::double * count(*) filter (id % 10 <> 0) / count(*), 2) as accuracy from c")
_judged("leaf_count", lambda d: d.select("id", evaluation.leaf_count(F.col("gold")).alias("n")), " select id, count(*) as n from gt where ty not in ('OBJECT', 'ARRAY') group by 1")
_corpus("insert_before_regime", lambda d: K.insert_before(d, d, "simple_ranking_query").select("id", F.col("pos.a").alias("a"), F.col("pos.b").alias("b")), "select id, id::double as a, 1 as b from c union all select id, (select coalesce(min(id) filter (regime = 'simple_ranking_query')::double, 'inf'::double) from c), 0 from c")
_TRIPLES = [t for t in sorted(DRIVER.patterns) if t[0] != t[2]]
QUERIES["path_enumeration"] = lambda s, d: K.paths(s, _TRIPLES, 3).select(K.path_text().alias("path"))
ORACLE["path_enumeration"] = f"""with recursive e(src, rel, dst) as (values {', '.join(map(str, _TRIPLES))}), p(path, seen, d) as (select src || '-' || rel || '->' || dst, [src, dst], 1 from e
 union all select path || '|' || src || '-' || rel || '->' || dst, seen || [dst], d + 1 from p join e on seen[-1] = src where d < 3 and not list_contains(seen, dst)) select path from p"""


def _raw(d: DataFrame) -> DataFrame:
    """The corpus as JSON text: each path encoding in turn, limits as numbers, structs or (unreadable) text, and text that isn't JSON."""
    i, num = F.col("id"), lambda k: F.get("filters", k)["value"].cast("long")
    step = F.when(i % 4 == 0, '["Region","CONTAINS","Nation"]').when(i % 4 == 1, '{"from":"Region","relationship":"CONTAINS","to":"Nation"}').when(i % 4 == 2, '{"from":"Region","rel":"CONTAINS","to":"Nation"}').otherwise('{"source":{"label":"Region"},"relationship":"CONTAINS","target":{"label":"Nation"}}')
    value = lambda k: F.when(i % 5 == 0, F.concat(F.lit('"value":'), num(k))).when(i % 5 == 1, F.concat(F.lit('"value":'), num(k), F.lit(".5"))).when(i % 5 == 2, F.lit('"value":true')).when(i % 5 == 3, F.concat(F.lit('"value":"'), num(k), F.lit('"'))).otherwise(F.concat(F.lit('"value_int":'), num(k)))
    one = lambda k: F.concat(F.lit('{"attribute":"'), F.get("filters", k)["attribute"], F.lit('","operator":"'), F.get("filters", k)["operator"], F.lit('",'), value(k), F.lit("}"))
    limit = F.when(F.col("limit").isNull(), "null").when(i % 3 == 0, F.col("limit").cast("string")).when(i % 3 == 1, F.concat(F.lit('{"value":'), F.col("limit"), F.lit("}"))).otherwise(F.concat(F.lit('"'), F.col("limit"), F.lit('"')))
    body = F.concat(
        F.lit('{"target":'), F.when(i % 2 == 0, F.concat(F.lit('"'), F.col("target"), F.lit('"'))).otherwise(F.concat(F.lit('{"label":"'), F.col("target"), F.lit('"}'))), F.lit(',"path":['), F.when(F.size("path") > 0, step).otherwise(""),
        F.lit('],"filters":'), F.when(F.size("filters") == 0, "[]").when(F.size("filters") == 1, one(0)).otherwise(F.concat(F.lit("["), one(0), F.lit(",7,"), one(1), F.lit("]"))), F.lit(',"limit":'), limit, F.lit("}"),
    )
    return d.select("id", F.when(i % 11 == 0, "{not json").otherwise(F.concat(F.lit('{"regime":"'), F.col("regime"), F.lit('","schema":'), body, F.lit("}"))).alias("raw"))


def _each_filter(d: DataFrame) -> DataFrame:
    """Outer, as an inner explode asks for the size of its list before rows are dealt out: all the work twice, once in few tasks."""
    return d.select("id", F.posexplode_outer("filters").alias("at", "f")).where("at is not null")


_corpus(
    "normalize_ir", lambda d: N.normalize(_raw(d)).select("id", "regime", "target", K.path_text().alias("path"), F.size("filters").alias("n_filters"), "limit"),
    """select id, case when ok then regime end as regime, case when ok then target end as target, case when ok and hop then 'Region-CONTAINS->Nation' else '[]' end as path, (case when ok then nf else 0 end)::int as n_filters,
  case when ok and id % 3 < 2 then lim end as "limit" from (select *, id % 11 <> 0 as ok from c)""", deal=True,
)
_corpus(
    "value_typing", lambda d: _each_filter(N.normalize(_raw(d))).select("id", "at", "f.attribute", "f.operator", "f.value_str", "f.value_int", "f.value_float", "f.value_bool"),
    """select id, pos::int as at, attr as attribute, case pos when 0 then op1 else op2 end as operator, case when id % 5 = 3 then v::varchar end as value_str, case when id % 5 in (0, 4) then v end as value_int,
  case when id % 5 = 1 then v + 0.5::double end as value_float, case when id % 5 = 2 then true end as value_bool
  from (select *, case pos when 0 then v1 else v2 end as v from c, (values (0), (1)) p(pos) where pos < nf and id % 11 <> 0)""", deal=True,
)

# -- a catalog read from schema and mapping files, with edge tables -----------------------------------------------------------

SHOP = load(os.path.join(os.path.dirname(os.path.abspath(__file__)), "plans", "shop_schema.json"), os.path.join(os.path.dirname(os.path.abspath(__file__)), "plans", "shop_mapping.json"))


def _loaded(name: str, sql: str, schema: dict):
    QUERIES[name] = lambda spark, sf_dir: plan(spark, sf_dir, {"schema": schema}, SHOP)
    ORACLE[name] = sql


_where = lambda label, attribute, operator, value: {"node_label": label, "attribute": attribute, "operator": operator, "value": value}
_loaded(
    "edge_table_2hop", "select p_name as name, p_size as size from nation join supplier on n_nationkey = s_nationkey join lineitem on s_suppkey = l_suppkey join part on l_partkey = p_partkey where n_name = 'NATION_3' and p_size > 45",
    {"target": "Article", "path": [["Country", "HOSTS", "Vendor"], ["Vendor", "OFFERS", "Article"]], "filters": [_where("Country", "name", "=", "NATION_3"), _where("Article", "size", ">", 45)], "return_attributes": ["name", "size"]},
)
_loaded(
    "edge_table_self", f"select {CNT} from part a join lineitem e on a.p_partkey = e.l_partkey join part b on e.l_suppkey = b.p_partkey where b.p_size < 10",
    {"target": "Article", "path": [["Article", "NEXT_TO", "Article"]], "filters": [_where("Article", "size", "<", 10)], "aggregate": {"function": "count"}},
)
_loaded(
    "edge_table_self_2hop", f"select {CNT} from part a join lineitem e on a.p_partkey = e.l_partkey join part b on e.l_suppkey = b.p_partkey join lineitem f on b.p_partkey = f.l_partkey join part c on f.l_suppkey = c.p_partkey where c.p_size = 7 and not (e.l_orderkey = f.l_orderkey and e.l_linenumber = f.l_linenumber and e.l_partkey = f.l_partkey and e.l_suppkey = f.l_suppkey)",
    {"target": "Article", "path": [["Article", "NEXT_TO", "Article"]] * 2, "filters": [_where("Article", "size", "=", 7)], "aggregate": {"function": "count"}},
)
_loaded(
    "mapped_ranking", "select s_name as name, s_acctbal as rating from nation join supplier on n_nationkey = s_nationkey order by s_acctbal desc, n_nationkey, s_suppkey limit 7",
    {"target": "Vendor", "path": [["Country", "HOSTS", "Vendor"]], "order_by": {"attribute": "rating", "direction": "desc"}, "limit": 7, "return_attributes": ["name", "rating"]},
)
_loaded("mapped_node_return", "select s_name as name, s_acctbal as rating from supplier where s_acctbal > 9000", {"target": "Vendor", "filters": [_where("Vendor", "rating", ">", 9000)]})

# -- generation, from policy tables: nothing is read from the driver's tables -------------------------------------------------

ALL_LABELS = ["Place", "Neighborhood", "Road", "Intersection", "Review"]
#: Patterns of the larger published schema.
ALL_PATTERNS = [("Neighborhood", "CONTAINS", "Place"), ("Neighborhood", "CONTAINS", "Road"), ("Place", "NEAR", "Intersection"), ("Place", "HAS_REVIEW", "Review"), ("Intersection", "ROAD", "Intersection"), ("Road", "CONTAINS", "Place")]
DEEP = replace(DEFAULT, regimes={k: replace(v, depth=3 * min(v.depth, 1)) for k, v in DEFAULT.regimes.items()})
_values = lambda rows: ", ".join("(" + ", ".join(repr(x) for x in r) + ")" for r in rows)
_steps = lambda d: F.array_join(F.transform(d, lambda p: F.concat(p["src"], F.lit("-"), p["rel"], F.lit("->"), p["dst"])), "|")

QUERIES["generate_paths"] = lambda s, d: generate.path_rows(s, ALL_LABELS, ALL_PATTERNS, PLACES, DEEP).select("regime", "target", _steps("path").alias("path"))
ORACLE["generate_paths"] = f"""with recursive r(regime) as (values {_values([(k,) for k in DEEP.regimes])}), l(label, most) as (values {_values([(l, PLACES.paths[l][1]) for l in ALL_LABELS])}),
 e(src, rel, dst) as (values {_values([p for p in ALL_PATTERNS if p[2] in PLACES.paths[p[0]][0]])}),
 p(path, seen, d) as (select src || '-' || rel || '->' || dst, [src, dst], 1 from e where src <> dst union all select path || '|' || src || '-' || rel || '->' || dst, seen || [dst], d + 1 from p join e on seen[-1] = src where d < 3 and not list_contains(seen, dst))
 select regime, label as target, '' as path from r, l where regime like 'simple%' union all select regime, seen[-1], path from r, p join l on l.label = seen[1] where regime like 'relational%' and d <= most"""


def _base(s: SparkSession) -> DataFrame:
    return generate.base_rows(generate.path_rows(s, ALL_LABELS, ALL_PATTERNS, PLACES, DEEP), PLACES, DEEP)


_PROJECTIONS = [(l, ",".join(p)) for l in ALL_LABELS for p in PLACES.projections_of(l)]
QUERIES["generate_projections"] = lambda s, d: _base(s).select("regime", "target", _steps("path").alias("path"), F.array_join("return_attributes", ",").alias("attributes"))
ORACLE["generate_projections"] = f"with q as ({ORACLE['generate_paths']}), a(target, attributes) as (values {_values(_PROJECTIONS)}) select regime, target, path, attributes from q join a using (target)"
_OPS = [(l, a, o) for l, attrs in PLACES.filterable.items() for a in attrs for o in PLACES.operators_of(l, a)]
QUERIES["generate_filter_candidates"] = lambda s, d: generate.candidates(_base(s), PLACES, DEEP).select("base", "label", "attribute", "operator")
ORACLE["generate_filter_candidates"] = f"""with q as ({ORACLE['generate_projections']}), o(label, attribute, operator) as (values {_values(_OPS)}),
 b as (select md5(concat_ws('|', regime, target, '[' || coalesce(array_to_string(list_transform(list_filter(string_split(path, '|'), lambda x: x <> ''), lambda x: '{{"src":"' || string_split(x, '-')[1] || '","rel":"' || string_split(string_split(x, '-')[2], '>')[1] || '","dst":"' || string_split(x, '->')[2] || '"}}'), ','), '') || ']',
   '["' || replace(attributes, ',', '","') || '"]')) as base, list_distinct(string_split(regexp_replace(case when path = '' then target else path end, '-[A-Z_]+->', '|', 'g'), '|')) as labels from q),
 k as (select base, label, attribute, operator, row_number() over (partition by base, label, attribute order by md5(concat_ws(':', '42', base, label, attribute, operator))) as r from (select base, unnest(labels) as label from b) join o using (label))
 select base, label, attribute, operator from k where r <= 2"""


def _sets(s: SparkSession) -> DataFrame:
    """Every set of one to three filter candidates of a label, for one base row of each label."""
    base = generate.base_rows(generate.path_rows(s, ALL_LABELS, ALL_PATTERNS, PLACES, DEFAULT), PLACES, DEFAULT).where("regime = 'simple_count_query'")
    found = generate.candidates(base.groupBy("target").agg(F.min_by(F.struct("base", "labels"), "base").alias("x")).select("x.*"), PLACES, DEFAULT)
    rank = F.row_number().over(Window.partitionBy("label").orderBy("attribute", "operator"))
    return K.combinations(found.withColumn("i", rank), "label", "i", 3, 64).select("label", F.array_join(F.transform("set", lambda x: x.cast("string")), ",").alias("set"))


QUERIES["filter_combinations"] = lambda s, d: _sets(s)
ORACLE["filter_combinations"] = f"""with o(label, attribute, operator) as (values {_values(_OPS)}), n as (select label, sum(least(n, 2)) as n from (select label, attribute, count(*) as n from o group by 1, 2) group by 1),
 i as (select label, unnest(range(1, n::bigint + 1)) as i from n) select label, i::varchar as "set" from i union all select a.label, concat_ws(',', a.i, b.i) from i a join i b on a.label = b.label and a.i < b.i
 union all select a.label, concat_ws(',', a.i, b.i, c.i) from i a join i b on a.label = b.label and a.i < b.i join i c on b.label = c.label and b.i < c.i"""
QUERIES["generate_intents"] = lambda s, d: generate.generate(s).select("id", "regime", "target", F.to_json(F.struct("modifiers", "path", "filters", "aggregate", "order_by", "limit", "return_attributes")).alias("intent"))
QUERIES["generate_deep_intents"] = lambda s, d: generate.generate(s, ALL_LABELS, ALL_PATTERNS, PLACES, DEEP).select("id", "regime", "target", F.to_json(F.struct("modifiers", "path", "filters", "aggregate", "order_by", "limit", "return_attributes")).alias("intent"))
QUERIES["generate_dataset"] = lambda s, d: generate.dataset(s).select("id", "regime", "target", "bucket")
QUERIES["target_json"] = lambda s, d: text.training_rows(intents(s, d).withColumn("q", F.col("target")), "q", _ATTRS).select(text.target_json(F.col("regime"), F.col("schema")).alias("target"))


def _bare(s: SparkSession) -> DataFrame:
    """Base rows without filters, as they come to the expansions."""
    return _base(s).withColumn("filters", F.array().cast(generate.FILTERS))


_AGGS = [(l, f, a) for l, attrs in PLACES.aggregatable.items() for a in attrs for f in PLACES.functions_of(a) if f != "count"]
_ORDERS = [(l, a) for l, attrs in PLACES.orderable.items() for a in attrs]
FREE = replace(DEEP, regimes={k: replace(v, orders=0, limits=0) for k, v in DEEP.regimes.items()})
_BASE_ROWS = f"q as ({ORACLE['generate_projections']})"
QUERIES["generate_aggregates"] = lambda s, d: generate.aggregated(_bare(s)).groupBy("regime", "target", "aggregate.function", "aggregate.attribute").agg(F.count("*").alias("n"))
ORACLE["generate_aggregates"] = f"""with {_BASE_ROWS}, a(target, function, attribute) as (values {_values(_AGGS)}) select regime, target, function, attribute, count(*) as n from (
 select regime, target, 'count' as function, null as attribute from q where regime like '%count%' union all select regime, target, function, attribute from q join a using (target) where regime like '%aggregation%'
 union all select regime, target, null, null from q where regime like '%lookup%' or regime like '%ranking%') group by 1, 2, 3, 4"""
QUERIES["generate_orders_and_limits"] = lambda s, d: generate.limited(generate.ordered(generate.aggregated(_bare(s)), PLACES, FREE), FREE).where("order_by is not null").groupBy("regime", "target", "order_by.attribute", "order_by.direction", "limit").agg(F.count("*").alias("n"))
ORACLE["generate_orders_and_limits"] = f"""with {_BASE_ROWS}, o(target, attribute) as (values {_values(_ORDERS)}) select regime, target, attribute, direction, "limit", count(*) as n
 from q join o using (target), (values ('asc'), ('desc')) d(direction), (values (5), (10), (20)) l("limit") where regime like '%ranking%' group by 1, 2, 3, 4, 5"""
_VALUES = [(l, a, v[0], v[1] - v[0] + 1, "") if isinstance(v, tuple) else (l, a, 0, len(v), "|".join(map(str, v))) for l, attrs in PLACES.filterable.items() for a in attrs if PLACES.operators_of(l, a) for v in [PLACES.values_of(l, a)]]
QUERIES["generate_filter_values"] = lambda s, d: generate.candidates(_base(s), PLACES, DEEP).groupBy("label", "attribute", "operator", "value").agg(F.count("*").alias("n"))
ORACLE["generate_filter_values"] = f"""with f as ({ORACLE['generate_filter_candidates']}), v(label, attribute, least, span, choices) as (values {_values(_VALUES)}),
 x as (select *, ('0x' || substr(md5(concat_ws(':', '42', 'value', base, label, attribute, operator)), 1, 13))::bigint % span as idx from f join v using (label, attribute))
 select label, attribute, operator, case when choices = '' then (least + idx)::varchar else string_split(choices, '|')[idx + 1] end as value, count(*) as n from x group by 1, 2, 3, 4"""
_WORDS = [("4.5", True, False), (" 7 ", True, False), ("1_000", True, False), ("1e3", True, False), ("nan", True, False), ("yes", False, True), ("TRUE", False, True), ("0", True, True), ("1__0", False, False), ("maybe", False, False)]
_corpus(
    "text_coercion", lambda d: d.withColumn("w", F.element_at(F.array(*[F.lit(w) for w, *_ in _WORDS]), (F.col("id") % len(_WORDS) + 1).cast("int"))).select("id", checks.reads_as_number(F.col("w")).alias("number"), checks.reads_as_truth(F.col("w")).alias("truth")),
    f"select id, w.number, w.truth from c join (values {_values([(i, n, t) for i, (_, n, t) in enumerate(_WORDS)])}) w(i, number, truth) on id % {len(_WORDS)} = i",
)
_judged("error_values", evaluation.error_values, " select distinct expected, predicted from e")
