"""Audit, evaluation and serving queries, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from semloom.functions import text as X
from semloom.functions.vectors import fixed
from semloom.operators import audit as A
from semloom.operators import clusters as C
from semloom.operators import neighbors as N
from semloom.operators import relational as R
from semloom.plans.vector_queries import KNN, V, fix
from semloom.sources.tables import layers, table, vectors


def _nodes(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("title"), "source", "lang", F.length("text").alias("score"))
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("cluster")).join(d, "id")


def node_join(spark, sf):
    n = _nodes(spark, sf).join(layers(spark, sf), "id")
    name = lambda c: F.when(F.col(c) % 3 != 0, F.concat(F.lit(f"{c} "), F.col(c).cast("string")))
    return n.select("id", F.coalesce(F.nullif(X.clean(F.col("title")), F.lit("")), F.concat(F.lit("Entity "), F.col("id").cast("string"))).alias("title"), F.coalesce(name("macro"), name("neighborhood"), name("micro"), F.lit("")).alias("label"))


def cluster_members(spark, sf):
    return A.members(_nodes(spark, sf).withColumn("title", X.plain_label(F.col("title"))), 42, 10).select("cluster", "id", "rank")


def variant_overlap(spark, sf):
    v = vectors(spark, sf)
    half = v.withColumn("embedding", F.slice("embedding", 1, 32))
    return A.list_overlap(N.nearest(v, 5), N.nearest(half, 5)).where("same < 4")


def audit_selection(spark, sf):
    return A.selection(_nodes(spark, sf), 60, "-7")


def neighbor_flags(spark, sf):
    n = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.array("lang").alias("genres"), X.title_tokens(F.col("text")).alias("tokens"))
    return A.neighbor_flags(n, N.nearest(vectors(spark, sf), 5))


def audit_verdicts(spark, sf):
    e = table(spark, sf, "events").groupBy("user_id").agg(F.count_if(F.col("value") > 90).alias("bad"), F.count_if(F.col("value") < 50).alias("good"), (F.max("event_id") % 5 == 0).alias("off"))
    return e.select("user_id", A.verdict(F.col("bad"), F.col("good"), F.col("off")).alias("verdict"))


def repeated_child_labels(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("cluster"), F.col("s_nationkey").alias("parent"), F.concat(F.lit("Part-"), (F.col("s_suppkey") % 3).cast("string")).alias("label"))
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("cluster"), F.concat(F.lit("part "), (F.col("n_nationkey") % 3).cast("string")).alias("label"))
    return A.repeated_child_labels(s, n, X.plain_label)


def label_precedence(spark, sf):
    n = table(spark, sf, "nation").select("n_regionkey", "n_name")
    base = n.groupBy(F.col("n_regionkey").alias("key")).agg(F.min("n_name").alias("label"))
    over = table(spark, sf, "region").where("r_regionkey < 3").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("label"))
    return A.with_precedence([base, over], "key")


def point_reassign(spark, sf):
    return A.reassign(layers(spark, sf), [(1, 2), (3, 1), (5, 9999), (7, 8)], ["macro", "neighborhood", "micro"])


def boundary_edges(spark, sf):
    g = vectors(spark, sf).select("cluster", F.floor(F.col("embedding")[0] * 50).alias("i"), F.floor(F.col("embedding")[1] * 50).alias("j"))
    one = g.groupBy("i", "j").agg(F.min("cluster").alias("cluster"))
    corner = lambda a, b: F.struct(((F.col("i") + a) / 50).alias("x"), ((F.col("j") + b) / 50).alias("y"))
    cells = one.select("cluster", F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1)).alias("cell"))
    return A.boundary_edges(cells)


def last_results(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("ord"), F.col("event_type").alias("model"), F.when(F.col("value") > 20, F.floor(F.col("value") / 40).cast("string")).alias("verdict"))
    return A.last_results(e, "click")


def grouped_counts(spark, sf):
    return A.grouped_counts(table(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"])


def recommend_k(spark, sf):
    """Metrics of several numbers of clusters, as one grouped query, and the best."""
    v = vectors(spark, sf)
    ks = v.withColumn("k", F.explode(F.array(*[F.lit(k) for k in (2, 3, 5, 7, 10)])))
    # a vector belongs to one cluster of each k: (k, cluster) is the key
    keyed = ks.withColumn("cluster", F.col("k") * 100 + F.floor(F.col("cluster") * F.col("k") / 10).cast("int"))
    per = C.coherence(keyed).withColumn("k", F.floor(F.col("cluster") / 100).cast("int"))
    m = per.groupBy("k").agg(F.avg("coherence").alias("c"), F.avg("n").alias("a"), F.max("n").alias("hi"), F.count_if(F.col("n") < 5).alias("tiny"), F.count("*").alias("clusters"))
    score = F.coalesce("c", F.lit(0.0)) - F.abs(F.col("a") - 14) / 14 - F.greatest(F.lit(0), F.col("hi") - 40) / 40 - F.col("tiny") / F.col("clusters") * 2
    return m.select("k", fixed(score).alias("score")).orderBy(F.desc("score"), F.desc("k")).limit(3)


def selection_score(spark, sf):
    v, lay = vectors(spark, sf), layers(spark, sf)
    knn = N.nearest(v, 7)
    parts = [N.same_cluster_rate(knn, lay.select("id", F.col(c).alias("cluster"))).select(F.col("same_rate").alias(c)) for c in ("macro", "neighborhood", "micro")]
    mean = None
    for c in ("macro", "neighborhood", "micro"):
        one = C.coherence(v.drop("cluster").join(lay.select("id", F.col(c).alias("cluster")), "id")).select("coherence")
        mean = one if mean is None else mean.unionByName(one)
    row = parts[0].crossJoin(parts[1]).crossJoin(parts[2]).crossJoin(mean.agg(F.avg("coherence").alias("coh"))).crossJoin(C.balance(lay.select("id", F.col("macro").alias("cluster"))).select("penalty"))  # one row each
    score = F.col("macro") * 6 + F.col("neighborhood") * 20 + F.col("micro") * 24 + F.coalesce("coh", F.lit(0.0)) * 22 - F.col("penalty")
    return row.select(fixed(score).alias("score"))


def variant_cost(spark, sf):
    d = table(spark, sf, "documents").groupBy("lang").agg(F.sum(X.token_estimate(F.col("text"))).alias("tokens"))
    price = spark.createDataFrame([("en", 0.13), ("fr", 0.02)], "lang string, usd double")
    return d.join(F.broadcast(price), "lang", "left").select("lang", "tokens", fixed(F.col("tokens") * F.coalesce("usd", F.lit(0.13)) / 1e6, 9).alias("usd"))


def refresh_metadata(spark, sf):
    n = _nodes(spark, sf)
    best = R.top_per_key(n, ["cluster"], [F.desc("score"), F.col("id")], 8).groupBy("cluster").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda s: s["id"].cast("string")), ",").alias("best"))
    words = n.groupBy("cluster", "source").agg(F.count("*").alias("n"))
    top = R.top_per_key(words, ["cluster"], [F.desc("n"), F.col("source")], 3).groupBy("cluster").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "source"))), lambda s: s["source"]), ",").alias("top"))
    return n.groupBy("cluster").agg(F.count("*").alias("size")).join(best, "cluster").join(top, "cluster")


def sampling_bias(spark, sf):
    o = table(spark, sf, "orders").agg(F.count("*").alias("n"), F.count_if(F.year("o_orderdate") == 1997).alias("now"), F.count_if(F.year("o_orderdate") > 1997).alias("later"), F.count_if(F.contains(F.lower("o_orderpriority"), F.lit("urgent"))).alias("series"))
    share = lambda c: F.coalesce(F.try_divide(c, "n"), F.lit(0.0))
    return o.select("n", fixed(share("now")).alias("current"), F.array_join(F.array_compact(F.array(F.when(share("now") >= 0.25, "many current"), F.when(F.col("later") > 0, "some future"), F.when(share("series") >= 0.25, "many of a series"))), "; ").alias("warnings"))


NODES = "n as (select vec_id as id, label as cluster, text as title, source, lang, length(text) as score from embeddings join documents on vec_id = doc_id)"
TOKENS = r"list_distinct(list_filter(regexp_split_to_array(translate(lower(title), '-‑:', '   '), '\s+'), lambda w: length(w) > 3 and w not in ('the', 'a', 'an', 'of', 'and', 'or', 'part', 'chapter', 'movie')))"
LAYERS = "l as (select vec_id as id, (label // 4)::int as macro, (label // 2)::int as neighborhood, label as micro from embeddings)"

QUERIES = {
    "node_join": (node_join, rf"with {NODES}, {LAYERS} select n.id, coalesce(nullif(trim(regexp_replace(title, '[\s\x{{00A0}}]+', ' ', 'g')), ''), 'Entity ' || n.id) as title, coalesce(case when macro % 3 <> 0 then 'macro ' || macro end, case when neighborhood % 3 <> 0 then 'neighborhood ' || neighborhood end, case when micro % 3 <> 0 then 'micro ' || micro end, '') as label from n join l on n.id = l.id"),
    "cluster_members": (cluster_members, f"with {NODES} select cluster, id, row_number() over (partition by cluster order by (id = 42) desc, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')), id) as rank from n qualify rank <= 10"),
    "variant_overlap": (variant_overlap, KNN.format(k=5) + ", q as (select a.id as src, b.id as nbr, list_cosine_similarity(a.e[1:32], b.e[1:32]) as sim from v a join v b on a.id <> b.id), h as (select src, nbr from q qualify row_number() over (partition by src order by sim desc, nbr) <= 5) select knn.src, count(h.nbr) as same from knn left join h on knn.src = h.src and knn.nbr = h.nbr group by 1 having count(h.nbr) < 4"),
    "audit_selection": (audit_selection, f"with {NODES}, k as (select *, md5(id || '-7') as key from n), f as (select *, row_number() over (partition by cluster order by key, id) = 1 as first from k) select id, case when first then 'cluster' else 'score' end as part from f order by first desc, case when first then key end, score desc, key, id limit 60"),
    "neighbor_flags": (neighbor_flags, "with v as (select vec_id as id, list_transform(embedding, lambda x: x::double) as e from embeddings), p as (select a.id as src, b.id as nbr, list_cosine_similarity(a.e, b.e) as sim from v a join v b on a.id <> b.id), knn as (select src, nbr from p qualify row_number() over (partition by src order by sim desc, nbr) <= 5), n as (select doc_id as id, lang, text as title from documents), " + f"t as (select id, lang, {TOKENS} as tokens from n),"
     " g as (select s.id, count(*) filter (o.lang = s.lang) as same, count(*) filter (o.lang <> s.lang and len(list_intersect(s.tokens, o.tokens)) > 0) as confused from t s join knn on s.id = src left join t o on nbr = o.id group by 1)"
     " select id, 'missing_neighbors' as flag, 2 as severity from t where id not in (select src from knn) union all select id, 'possible_title_confusion', 2 from g where confused > 0 union all select id, 'low_neighbor_genre_overlap', 1 from g where same <= 1"),
    "audit_verdicts": (audit_verdicts, "select user_id, case when bad >= 2 or (bad >= 1 and off) then 'fail' when bad >= 1 or off or good = 0 then 'mixed' else 'pass' end as verdict from (select user_id, count(*) filter (value > 90) as bad, count(*) filter (value < 50) as good, max(event_id) % 5 = 0 as off from events group by 1)"),
    "repeated_child_labels": (repeated_child_labels, "select s_suppkey as cluster, s_nationkey as parent, 'Part-' || (s_suppkey % 3) as label from supplier where s_suppkey % 3 = s_nationkey % 3"),
    "label_precedence": (label_precedence, "select n_regionkey as key, coalesce(any_value(r_name), min(n_name)) as label from nation left join region on n_regionkey = r_regionkey and r_regionkey < 3 group by 1"),
    "point_reassign": (point_reassign, f"with {LAYERS}, m as (select * from (values (1, 2), (3, 2), (7, 8)) t(id, target)) select l.id, t.macro, t.neighborhood, t.micro from l left join m on l.id = m.id join l t on t.id = coalesce(m.target, l.id)"),
    "boundary_edges": (boundary_edges, "with g as (select floor(embedding[1]::double * 50)::bigint as i, floor(embedding[2]::double * 50)::bigint as j, min(label) as cluster from embeddings group by 1, 2), e as (select cluster, (i + a)::double / 50 as px, (j + b)::double / 50 as py, (i + c)::double / 50 as qx, (j + d)::double / 50 as qy from g, (values (0, 0, 1, 0), (1, 0, 1, 1), (1, 1, 0, 1), (0, 1, 0, 0)) t(a, b, c, d)), f as (select cluster, floor(px * 1e4 + 0.5)::bigint as px, floor(py * 1e4 + 0.5)::bigint as py, floor(qx * 1e4 + 0.5)::bigint as qx, floor(qy * 1e4 + 0.5)::bigint as qy from e), o as (select cluster, case when (px, py) <= (qx, qy) then px else qx end as x0, case when (px, py) <= (qx, qy) then py else qy end as y0, case when (px, py) <= (qx, qy) then qx else px end as x1, case when (px, py) <= (qx, qy) then qy else py end as y1 from f) select x0, y0, x1, y1, count(*) as n, count(*) = 1 or min(cluster) <> max(cluster) as boundary from o group by 1, 2, 3, 4"),
    "last_results": (last_results, "select user_id as id, floor(value / 40)::bigint::varchar as verdict from events where event_type = 'click' and value > 20 qualify row_number() over (partition by user_id order by event_id desc) = 1"),
    "grouped_counts": (grouped_counts, "select 'o_orderstatus' as column, o_orderstatus as value, count(*) as n from orders group by 2 union all select 'o_orderpriority', o_orderpriority, count(*) from orders group by 2"),
    "recommend_k": (recommend_k, V + f", k as (select k, id, floor(cluster * k / 10)::int as c, e from v, (values (2), (3), (5), (7), (10)) t(k)), h as (select a.k, a.c, avg(list_cosine_similarity(a.e, b.e)) as c2 from k a join k b on a.k = b.k and a.c = b.c and a.id < b.id group by 1, 2), s as (select k, c, count(*) as n from k group by 1, 2), m as (select s.k, avg(c2) as c, avg(n) as a, max(n) as hi, count(*) filter (n < 5) as tiny, count(*) as n from s left join h on s.k = h.k and s.c = h.c group by 1) select k, {fix('coalesce(c, 0) - abs(a - 14) / 14 - greatest(0, hi - 40) / 40 - tiny / n * 2')} as score from m order by score desc, k desc limit 3"),
    "selection_score": (selection_score, KNN.format(k=7) + f", {LAYERS}, r as (select avg((a.macro = b.macro)::int) as ma, avg((a.neighborhood = b.neighborhood)::int) as nb, avg((a.micro = b.micro)::int) as mi from knn join l a on src = a.id join l b on nbr = b.id), w as (select v.id, e, unnest(['a' || macro, 'b' || neighborhood, 'c' || micro]) as c from v join l on v.id = l.id), h as (select avg(c) as coh from (select a.c as k, avg(list_cosine_similarity(a.e, b.e)) as c from w a join w b on a.c = b.c and a.id < b.id group by 1)), z as (select count(*) as n from l group by macro), y as (select avg(n) as a, max(n) as hi, min(n) as lo from z), pen as (select greatest(0, hi / a - 1.8) * 12 + greatest(0, 0.45 - lo / a) * 28 + (select count(*) from z, y where n < a * 0.25) * 2.5 as penalty from y) select {fix('ma * 6 + nb * 20 + mi * 24 + coh * 22 - penalty')} as score from r, h, pen"),
    "variant_cost": (variant_cost, r"with d as (select lang, sum((case when length(text) = 0 then 0 else greatest(1, ceil(length(text) / 4), ceil(len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) * 1.35)) end)::bigint)::bigint as tokens from documents group by 1) select lang, tokens, " + fix("tokens * case lang when 'fr' then 0.02 else 0.13 end::double / 1e6", 9) + " as usd from d"),
    "refresh_metadata": (refresh_metadata, f"with {NODES}, b as (select cluster, string_agg(id::varchar, ',' order by r) as best from (select cluster, id, row_number() over (partition by cluster order by score desc, id) as r from n qualify r <= 8) group by 1), t as (select cluster, string_agg(source, ',' order by r) as top from (select cluster, source, row_number() over (partition by cluster order by c desc, source) as r from (select cluster, source, count(*) as c from n group by 1, 2) qualify r <= 3) group by 1), s as (select cluster, count(*) as size from n group by 1) select s.cluster, size, best, top from s join b on s.cluster = b.cluster join t on s.cluster = t.cluster"),
    "sampling_bias": (sampling_bias, f"with o as (select count(*) as n, count(*) filter (year(o_orderdate) = 1997) as now, count(*) filter (year(o_orderdate) > 1997) as later, count(*) filter (contains(lower(o_orderpriority), 'urgent')) as series from orders) select n, {fix('now / n')} as current, coalesce(array_to_string(list_filter([case when now / n >= 0.25 then 'many current' end, case when later > 0 then 'some future' end, case when series / n >= 0.25 then 'many of a series' end], lambda x: x is not null), '; '), '') as warnings from o"),
}
