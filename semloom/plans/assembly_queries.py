"""Export assembly, review lists and lookups, each with its SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from semloom.functions import lexicon
from semloom.functions.vectors import fixed
from semloom.operators import assembly as B
from semloom.operators import clusters as C
from semloom.operators import neighbors as N
from semloom.operators import texts as T
from semloom.plans.text_queries import QUERIES as TEXTS
from semloom.plans.text_queries import STOP, docs
from semloom.plans.vector_queries import KNN, V, fix
from semloom.plans.vector_queries import QUERIES as VECTORS
from semloom.sources.tables import layers, table, vectors


def label_export(spark, sf):
    t = lambda name, key, label: table(spark, sf, name).select(F.col(key).cast("long").alias("cluster"), F.col(label).alias("label"))
    return B.flat_labels({"macro": t("region", "r_regionkey", "r_name"), "neighborhood": t("nation", "n_nationkey", "n_name"), "micro": t("supplier", "s_suppkey", "s_name")})


def cluster_export(spark, sf):
    c = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("cluster")).agg(F.count("*").alias("size"))
    n = table(spark, sf, "nation")
    labels = n.where("n_nationkey % 4 <> 1").select(F.col("n_nationkey").alias("cluster"), F.col("n_name").alias("label"))
    return B.cluster_export("neighborhood", c, labels, n.where("n_regionkey > 0").select(F.col("n_nationkey").alias("cluster"), F.col("n_regionkey").alias("parent")))


def layer_summary(spark, sf):
    a, v = layers(spark, sf), vectors(spark, sf)
    long = reduce(lambda x, y: x.unionByName(y), [a.select(F.lit(n).alias("layer"), "id", F.col(n).alias("cluster")) for n in B.LAYERS])
    each = [C.coherence(v.drop("cluster").join(a.select("id", F.col(n).alias("cluster")), "id")).select(F.lit(n).alias("layer"), "cluster", "coherence") for n in B.LAYERS]
    out = B.layer_summary(long, reduce(lambda x, y: x.unionByName(y), each))
    return out.select("layer", "clusters", "largest", "tiny", *[fixed(F.col(c)).alias(c) for c in ("average", "least", "most")])


def _reviewed(spark, sf):
    l = table(spark, sf, "labels")  # noqa: E741
    d = table(spark, sf, "documents").join(l, "doc_id")
    verdict = F.when(F.col("toxic") == 1, "fail").when(F.col("quality") == 0, "mixed").otherwise("pass")
    flags = F.array_compact(F.array(F.when(F.col("n_chars") > 5000, "long"), F.when(F.contains("text", F.lit("@")), "mail"), F.when(F.contains("text", F.lit("token")), "secret")))
    return d.select(F.col("doc_id").alias("id"), verdict.alias("verdict"), flags.alias("flags"), (F.col("toxic") * 3 + (1 - F.col("quality")) * 2 + F.size(flags)).cast("int").alias("severity"))


def top_issues(spark, sf):
    return B.top_issues(_reviewed(spark, sf), 80).select("id", "verdict", "severity", F.array_join("flags", ",").alias("flags"))


def weakest_labels(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("cluster"), F.col("s_name").alias("label"), F.round(F.abs(F.col("s_acctbal")) % 10).cast("long").alias("confidence"))
    return B.weakest_labels(s)


def label_confidence(spark, sf):
    s = table(spark, sf, "supplier").groupBy("s_nationkey").agg(F.avg(F.when(F.col("s_suppkey") % 3 > 0, F.col("s_acctbal"))).alias("mean"))
    return s.select("s_nationkey", fixed(F.col("mean"), 4).alias("mean"))


def latest_by_title(spark, sf):
    p = table(spark, sf, "part")
    return B.latest_by_title(p.select(F.col("p_partkey").alias("ord"), F.col("p_partkey").alias("id"), F.col("p_name").alias("title")), p.select(F.upper("p_name").alias("title")).distinct())


def find_titles(spark, sf):
    p = table(spark, sf, "part")
    wanted = p.select(F.when(F.col("p_partkey") % 3 == 0, F.concat(F.initcap("p_name"), F.lit(" ("), (F.col("p_size") + 1950).cast("string"), F.lit(")"))).otherwise(F.col("p_name")).alias("title")).distinct()
    return B.find_titles(p.select(F.col("p_partkey").alias("ord"), F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.when(F.col("p_size") % 7 > 0, F.col("p_size") + 1950).alias("year")), wanted)


def _paths(spark, sf):
    return layers(spark, sf).select("id", F.concat(F.lit("Area "), F.col("macro").cast("string")).alias("macro"), F.concat(F.lit("area-"), F.col("neighborhood").cast("string")).alias("neighborhood"), F.concat(F.lit("Spot "), F.col("micro").cast("string")).alias("micro"))


def duplicate_path_label(spark, sf):
    return _paths(spark, sf).select("id", B.path_repeats(*B.LAYERS).alias("repeated"))


def _flags(spark, sf):
    d = docs(spark, sf)
    more = d.where(F.contains("text", F.lit("@"))).select("id", F.lit("label_contradiction").alias("type"), F.lit(1).alias("severity"))
    return B.structural_flags(d, vectors(spark, sf), _paths(spark, sf), more)


def structural_audit(spark, sf):
    return _flags(spark, sf).groupBy("type").agg(F.count("*").alias("flags"), F.countDistinct("id").alias("entities"), F.max("severity").alias("severity"))


def audit_rows(spark, sf):
    d = docs(spark, sf).select("id", F.col("source").alias("title"))
    rows = B.audit_rows(d, _flags(spark, sf), N.nearest(vectors(spark, sf), 5), 3)
    return rows.select("id", "title", F.array_join("flags", ",").alias("flags"), F.col("worst").cast("int").alias("worst"), F.array_join(F.col("neighbors").cast("array<string>"), ",").alias("neighbors"))


def evidence_warnings(spark, sf):
    d = docs(spark, sf).withColumn("cluster", F.col("lang"))
    terms = T.cluster_terms(d, [*lexicon.CLUSTER_STOP, *STOP]).groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("t"))
    e = d.groupBy("cluster").agg(F.count("*").alias("size")).join(terms, "cluster").withColumn("terms", F.transform("t", lambda s: s["term"]))
    return B.evidence_warnings(e, ["and", "der", "de", "en"], 50).select("cluster", F.array_join("noisy", ",").alias("noisy"), "small")


def neighbor_gap(spark, sf):
    p = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("cluster")).agg((F.avg("l_quantity") / 10).alias("x"), (F.avg("l_discount") * 50).alias("y"), (F.count("*") / 100000).alias("r"))
    li = table(spark, sf, "lineitem")
    a, b = li.select("l_orderkey", F.col("l_suppkey").alias("a")), li.select("l_orderkey", F.col("l_suppkey").alias("b"))
    links = a.join(b, "l_orderkey").where("a <> b").groupBy("a", "b").agg(F.count("*").cast("double").alias("weight"))
    return B.neighbor_gap(p, links).select(fixed(F.col("gap")).alias("gap"))


def min_max_scale(spark, sf):
    o = table(spark, sf, "orders")
    e = o.groupBy("o_custkey").agg(F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"))
    return o.join(e, "o_custkey").select("o_orderkey", fixed(B.scaled(F.col("o_totalprice"), F.col("lo"), F.col("hi"), 40.0, 860.0)).alias("x"))


def keyword_set(spark, sf):
    words = F.split(F.coalesce("text", F.lit("")), " ")
    return docs(spark, sf).select("id", F.md5(F.array_join(B.keyword_set(words, ["the", "und", "les", "una"]), " ").cast("binary")).alias("digest"))


def halton_offsets(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", fixed(B.halton(F.col("c_custkey") + 1, 2), 9).alias("x"), fixed(B.halton(F.col("c_custkey") + 1, 3), 9).alias("y"))


def usage_totals(spark, sf):
    e = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    return e.groupBy("event_type").agg(F.count("*").alias("calls"), F.coalesce(F.sum(k), F.lit(0)).cast("long").alias("tokens"), fixed(F.coalesce(F.sum(k), F.lit(0)) * 0.15 / 1e6, 9).alias("usd"))


def cluster_evidence(spark, sf):
    v = vectors(spark, sf)
    values = docs(spark, sf).select("id", F.col("source").alias("value"))
    out = B.cluster_evidence(v, values, C.representatives(v), C.coherence(v), 5, 40)
    return out.select("cluster", "size", F.array_join("values", ",").alias("sources"), F.array_join("representatives", ",").alias("ids"), fixed(F.col("coherence")).alias("coherence"), "small")


def child_labels(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("cluster"), F.col("s_nationkey").alias("parent"), F.concat(F.lit("Part-"), (F.col("s_suppkey") % 3).cast("string")).alias("label"), F.split("s_name", "#").alias("words"))
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("cluster"), F.concat(F.lit("part "), (F.col("n_nationkey") % 3).cast("string")).alias("label"))
    suffix = B.specificity_suffix(F.col("words"), [("7", "Seven"), ("3", "Three")], F.lit("Region"))
    return B.child_labels(s, n, suffix)


CLUSTER_TERMS = TEXTS["cluster_terms"][1]
PATHS = "n as (select vec_id as id, 'Area ' || (label // 4)::int as macro, 'area-' || (label // 2)::int as neighborhood, 'Spot ' || label as micro from embeddings), r as (select id, lower(macro) = replace(neighborhood, '-', ' ') as repeated from n)"
FLAGS = PATHS + """, f as (select doc_id as id, 'missing_point' as type, 3 as severity from documents where doc_id not in (select id from n)
 union all select r.id, 'duplicate_path_label', 2 from r join documents on r.id = doc_id where repeated
 union all select doc_id, 'label_contradiction', 1 from documents where contains(text, '@') and doc_id in (select id from n))"""
_LAYERED = " union all ".join(f"select '{n}' as layer, id, {x} as cluster, e from v" for n, x in (("macro", "(cluster // 4)::int"), ("neighborhood", "(cluster // 2)::int"), ("micro", "cluster")))
_VERDICT = "case when toxic = 1 then 'fail' when quality = 0 then 'mixed' else 'pass' end"
_FLAG_LIST = "list_filter([case when n_chars > 5000 then 'long' end, case when contains(text, '@') then 'mail' end, case when contains(text, 'token') then 'secret' end], lambda x: x is not null)"


def _halton(base: int) -> str:
    return f"(with recursive h as (select c_custkey as id, c_custkey + 1 as v, 1.0::double / {base} as f, 0.0::double as r from customer union all select id, v // {base}, f / {base}, r + f * (v % {base}) from h where v > 0) select id, r from h where v = 0)"


QUERIES = {
    "label_export": (label_export, "select 'macro:' || r_regionkey as label_id, 'macro' as layer, r_regionkey::bigint as cluster, r_name as label from region union all select 'neighborhood:' || n_nationkey, 'neighborhood', n_nationkey::bigint, n_name from nation union all select 'micro:' || s_suppkey, 'micro', s_suppkey::bigint, s_name from supplier"),
    "cluster_export": (cluster_export, "select c_nationkey as cluster, case when n_regionkey > 0 then n_regionkey end as parent, count(*) as size, case when n_nationkey % 4 <> 1 then 'neighborhood:' || n_nationkey end as label_id, case when n_nationkey % 4 <> 1 then n_name end as label from customer left join nation on c_nationkey = n_nationkey group by all"),
    "layer_summary": (layer_summary, V + f""", a as ({_LAYERED}), s as (select layer, cluster, count(*) as n from a group by 1, 2), c as (select x.layer, x.cluster, avg(list_cosine_similarity(x.e, y.e)) as coherence from a x join a y on x.layer = y.layer and x.cluster = y.cluster and x.id < y.id group by 1, 2)
 select layer, count(*) as clusters, max(n) as largest, count(*) filter (n < 5) as tiny, {fix('avg(coherence)')} as average, {fix('min(coherence)')} as least, {fix('max(coherence)')} as most from s left join c using (layer, cluster) group by layer"""),
    "top_issues": (top_issues, f"with r as (select doc_id as id, {_VERDICT} as verdict, {_FLAG_LIST} as flags, toxic * 3 + (1 - quality) * 2 as s from documents join labels using (doc_id)) select id, verdict, (s + len(flags))::int as severity, coalesce(array_to_string(flags, ','), '') as flags from r where verdict <> 'pass' or len(flags) > 0 order by s + len(r.flags) desc, (verdict = 'fail') desc, len(r.flags) desc, id limit 80"),
    "weakest_labels": (weakest_labels, "select s_suppkey as cluster, s_name as label, round(abs(s_acctbal) % 10)::bigint as confidence from supplier order by confidence, cluster limit 5"),
    "label_confidence": (label_confidence, f"select s_nationkey, {fix('avg(s_acctbal) filter (s_suppkey % 3 > 0)', 4)} as mean from supplier group by 1"),
    "latest_by_title": (latest_by_title, "select upper(p_name) as title, max(p_partkey) as id from part group by 1"),
    "find_titles": (find_titles, r"""with p as (select p_partkey as id, p_name, case when p_size % 7 > 0 then p_size + 1950 else 0 end as year, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') as init, p_size from part),
 w as (select distinct case when id % 3 = 0 then init || ' (' || (p_size + 1950) || ')' else p_name end as title, case when id % 3 = 0 then p_size + 1950 end as target, lower(p_name) as key from p)
 select title, p.id from w join p on lower(p.p_name) = w.key qualify row_number() over (partition by title order by case when year = target then 0 else 1 end, case when year = target then 0 else year end, p.id) = 1"""),
    "duplicate_path_label": (duplicate_path_label, f"with {PATHS} select * from r"),
    "structural_audit": (structural_audit, f"with {FLAGS} select type, count(*) as flags, count(distinct id) as entities, max(severity)::int as severity from f group by 1"),
    "audit_rows": (audit_rows, KNN.format(k=5) + ", " + FLAGS + """, g as (select id, string_agg(type, ',' order by severity desc, type) as flags, max(severity) as worst from f group by 1),
 b as (select src as id, string_agg(nbr::varchar, ',' order by rank) as neighbors from knn where rank <= 3 and nbr in (select doc_id from documents) group by 1)
 select doc_id as id, source as title, coalesce(flags, '') as flags, coalesce(worst, 0)::int as worst, coalesce(neighbors, '') as neighbors from documents left join g on doc_id = g.id left join b on doc_id = b.id"""),
    "neighbor_gap": (neighbor_gap, f"""with p as (select l_suppkey as c, avg(l_quantity) / 10 as x, avg(l_discount) * 50 as y, count(*) / 100000 as r from lineitem group by 1), k as (select a.l_suppkey as a, b.l_suppkey as b, count(*) as w from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and a.l_suppkey < b.l_suppkey group by 1, 2)
 select {fix('coalesce(sum(greatest(0, sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)) - p.r - q.r) * w) / sum(w), 0)')} as gap from k join p on a = p.c join p q on b = q.c"""),
    "min_max_scale": (min_max_scale, f"with e as (select o_orderkey, o_totalprice as v, min(o_totalprice) over (partition by o_custkey) as lo, max(o_totalprice) over (partition by o_custkey) as hi from orders) select o_orderkey, {fix('case when lo = hi then 450 else 40 + (v - lo) / (hi - lo) * 820 end')} as x from e"),
    "keyword_set": (keyword_set, "select doc_id as id, md5(coalesce(array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split(coalesce(text, ''), ' '), lambda w: lower(w)), lambda w: w <> '' and w not in ('the', 'und', 'les', 'una')))), ' '), '')) as digest from documents"),
    "halton_offsets": (halton_offsets, f"select a.id as c_custkey, {fix('a.r', 9)} as x, {fix('b.r', 9)} as y from {_halton(2)} a join {_halton(3)} b on a.id = b.id"),
    "usage_totals": (usage_totals, f"select event_type, count(*) as calls, coalesce(sum((props->>'k')::bigint), 0)::bigint as tokens, {fix('coalesce(sum((props->>$$k$$)::bigint), 0) * 0.15::double / 1e6', 9)} as usd from events group by 1"),
    "cluster_evidence": (cluster_evidence, f"""with rep as ({VECTORS['representatives'][1]}), coh as ({VECTORS['cluster_coherence'][1]}), n as (select label as cluster, count(*) as size from embeddings group by 1),
 c as (select label as cluster, source, count(*) as k from embeddings join documents on vec_id = doc_id group by 1, 2), b as (select cluster, string_agg(source || ':' || k, ',' order by k desc, source) as sources from (select * from c qualify row_number() over (partition by cluster order by k desc, source) <= 5) group by 1)
 select n.cluster, size, coalesce(sources, '') as sources, coalesce((select string_agg(id::varchar, ',' order by rank) from rep where rep.cluster = n.cluster), '') as ids, coherence, size < 40 as small from n left join b on n.cluster = b.cluster left join coh on n.cluster = coh.cluster"""),
    "child_labels": (child_labels, "select s_suppkey as cluster, 'Part-' || (s_suppkey % 3) || case when s_suppkey % 3 = n_nationkey % 3 then ': ' || case when contains(s_name, '7') then 'Seven' when contains(s_name, '3') then 'Three' else 'Region' end else '' end as label from supplier left join nation on s_nationkey = n_nationkey"),
    "evidence_warnings": (evidence_warnings, f"""with ct as ({CLUSTER_TERMS}), n as (select lang as cluster, count(*) as size from documents group by 1)
 select cluster, coalesce(string_agg(term, ',' order by rank) filter (term in ('and', 'der', 'de', 'en')), '') as noisy, any_value(size) < 50 as small from ct join n using (cluster) group by 1"""),
}
