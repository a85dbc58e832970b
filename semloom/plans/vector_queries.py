"""Vector, cluster and hierarchy queries, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from semloom.functions.vectors import doubles, fixed, unit
from semloom.functions.vectors import norm as length
from semloom.operators import clusters as C
from semloom.operators import ivf as IVF
from semloom.operators import neighbors as N
from semloom.sources.tables import layers, table, vectors

V = "with v as (select vec_id as id, label as cluster, list_transform(embedding, lambda x: x::double) as e from embeddings)"
U = V + ", u as (select id, cluster, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) as u from v)"
KNN = (
    V
    + ", p as (select a.id as src, b.id as nbr, list_cosine_similarity(a.e, b.e) as sim from v a join v b on a.id <> b.id), "
    + "knn as (select src, nbr, sim, row_number() over (partition by src order by sim desc, nbr) as rank from p qualify rank <= {k})"
)


def fix(x: str, digits: int = 6) -> str:
    return f"floor(({x}) * 1e{digits} + 0.5)::double / 1e{digits}"


def knn_cosine_top10(spark, sf):
    return N.nearest(vectors(spark, sf), 10).select("src", "nbr", fixed(F.col("sim")).alias("sim"), F.col("rank").cast("long").alias("rank"))


def ivf_neighbors(spark, sf):
    v = vectors(spark, sf).select("id", "embedding")
    index = IVF.build(v)
    found = IVF.search(index, v, 10, IVF.tuned_probes(index, 10))
    return found.select("src", "nbr", fixed(F.col("sim")).alias("sim"), F.col("rank").cast("long").alias("rank"))


def ivf_exact_neighbors(spark, sf):
    v = vectors(spark, sf).select("id", "embedding")
    found = IVF.search(IVF.build(v), v, 10, exact=True)
    return found.select("src", "nbr", fixed(F.col("sim")).alias("sim"), F.col("rank").cast("long").alias("rank"))


def l2_normalize(spark, sf):
    v = vectors(spark, sf).select("id", doubles("embedding").alias("e"))
    return v.select("id", fixed(length(F.col("e"))).alias("length"), F.posexplode(unit(F.col("e"))).alias("pos", "x")).select(
        "id", "length", F.col("pos").cast("long").alias("pos"), fixed(F.col("x")).alias("x")
    )


def cluster_centroid(spark, sf):
    return C.centroids(vectors(spark, sf)).select("cluster", F.col("pos").cast("long").alias("pos"), fixed(F.col("value")).alias("value"))


def cluster_coherence(spark, sf):
    return C.coherence(vectors(spark, sf)).select("cluster", "n", fixed(F.col("coherence")).alias("coherence"))


def representatives(spark, sf):
    return C.representatives(vectors(spark, sf)).select("cluster", "id", fixed(F.col("sim")).alias("sim"), F.col("rank").cast("long").alias("rank"))


def top_pairs(spark, sf):
    # the ten best pairs are among every vector's ten best
    pairs = N.nearest(vectors(spark, sf), 10).where("src < nbr or src > nbr")
    pairs = pairs.groupBy(F.least("src", "nbr").alias("i"), F.greatest("src", "nbr").alias("j")).agg(F.max("sim").alias("sim"))
    return pairs.orderBy(F.desc("sim"), "i", "j").limit(10).select("i", "j", fixed(F.col("sim")).alias("sim"))


def in_cluster_pairs(spark, sf):
    v = vectors(spark, sf)
    knn = N.nearest(v, 10)
    c = v.select("id", "cluster")
    both = knn.join(c.withColumnsRenamed({"id": "src", "cluster": "c"}), "src").join(c.withColumnsRenamed({"id": "nbr", "cluster": "d"}), "nbr").where("c = d")
    first = both.groupBy("c", F.least("src", "nbr").alias("i"), F.greatest("src", "nbr").alias("j")).agg(F.min(F.struct("src", "rank")).alias("at"))
    order = C.Window.partitionBy("c").orderBy("at")
    return first.withColumn("r", F.row_number().over(order)).where("r <= 8").select(F.col("c").alias("cluster"), "i", "j", F.col("r").cast("long").alias("r"))


def same_cluster_rate(spark, sf):
    v = vectors(spark, sf)
    return N.same_cluster_rate(N.nearest(v, 7), v).select(fixed(F.col("same_rate")).alias("same_rate"), "pairs")


def silhouette_cosine(spark, sf):
    return C.silhouette(vectors(spark, sf)).select(fixed(F.col("silhouette")).alias("silhouette"))


def knn_graph_edges(spark, sf):
    return N.edges(N.nearest(vectors(spark, sf), 5)).select("src", "dst", fixed(F.col("weight")).alias("weight"))


def graph_modularity(spark, sf):
    v = vectors(spark, sf)
    return N.modularity(N.edges(N.nearest(v, 5)), v).select(fixed(F.col("modularity")).alias("modularity"))


def rerank_context(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.array("source").alias("genres"), F.array("lang").alias("keywords"))
    context = layers(spark, sf).join(d, "id")
    out = N.rerank(N.nearest(vectors(spark, sf), 20), context, 12)
    return out.select("src", "nbr", fixed(F.col("sim")).alias("sim"), F.col("rank").cast("long").alias("rank"))


def cluster_size_stats(spark, sf):
    return C.size_stats(vectors(spark, sf)).select("clusters", fixed(F.col("avg_size")).alias("avg_size"), fixed(F.col("median_size")).alias("median_size"), "min_size", "max_size", "tiny")


def _nested(spark, sf):
    return vectors(spark, sf).select("id", F.col("cluster").alias("child"), F.pmod(F.col("id"), F.lit(3)).cast("int").alias("parent"))


def majority_parent(spark, sf):
    return C.majority_parent(_nested(spark, sf))


def hierarchy_mismatch(spark, sf):
    return C.mismatch_rate(_nested(spark, sf)).select("checked", "mismatched", fixed(F.col("rate")).alias("rate"))


def allocate_children(spark, sf):
    sizes = vectors(spark, sf).groupBy(F.col("cluster").alias("parent")).agg(F.count("*").alias("n"))
    return C.allocate_children(sizes, 37)


def remap_by_size(spark, sf):
    return C.remap_by_size(vectors(spark, sf))


def macro_balance(spark, sf):
    out = C.balance(vectors(spark, sf))
    return out.select(*[fixed(F.col(c)).alias(c) for c in out.columns])


def ari_nmi(spark, sf):
    v = vectors(spark, sf).select(F.col("cluster").alias("a"), F.pmod(F.col("id"), F.lit(3)).cast("int").alias("b"))
    return C.agreement(v).select(fixed(F.col("ari")).alias("ari"), fixed(F.col("nmi")).alias("nmi"))


def labelability(spark, sf):
    v = vectors(spark, sf)
    stats = C.size_stats(v).crossJoin(C.coherence(v).agg(F.avg("coherence").alias("coherence"))).crossJoin(C.silhouette(v))  # one row each
    score = (
        F.coalesce("coherence", F.lit(0.0)) + F.coalesce("silhouette", F.lit(0.0)) * 0.5 - F.abs(F.col("avg_size") - 14) / 14
        - F.greatest(F.lit(0), F.col("max_size") - 45) / 45 - F.col("tiny") / F.col("clusters") * 1.5
    )
    return stats.select(fixed(score).alias("labelability"))


NESTED = "(select vec_id as id, label as child, (vec_id % 3)::int as parent from embeddings)"
VOTES = f"votes as (select child, parent, count(*) as votes, min(id) as first from {NESTED} group by all), best as (select child, parent, votes from votes qualify row_number() over (partition by child order by votes desc, first) = 1)"
SIL = """, s as (select cluster as other, pos, sum(x) as s from (select cluster, unnest(u) as x, generate_subscripts(u, 1) as pos from u) group by all),
 sv as (select other, list(s order by pos) as s from s group by other), n as (select cluster as other, count(*) as n from v group by cluster),
 d as (select u.id, u.cluster = sv.other as own, n.n, case when u.cluster = sv.other then (n.n - list_inner_product(u.u, sv.s)) / nullif(n.n - 1, 0) else 1 - list_inner_product(u.u, sv.s) / n.n end as d from u cross join sv join n using (other)),
 ab as (select id, min(case when own then d end) as a, min(case when not own then d end) as b, min(case when own then n end) as n from d group by id),
 sil as (select avg(case when n = 1 then 0.0 else (b - a) / greatest(a, b) end) as silhouette from ab)"""
COH = ", c as (select a.cluster, avg(list_cosine_similarity(a.e, b.e)) as coherence from v a join v b on a.cluster = b.cluster and a.id < b.id group by 1)"

QUERIES = {
    "knn_cosine_top10": (knn_cosine_top10, KNN.format(k=10) + f" select src, nbr, {fix('sim')} as sim, rank::bigint as rank from knn"),
    "ivf_neighbors": (ivf_neighbors, None),
    "ivf_exact_neighbors": (ivf_exact_neighbors, KNN.format(k=10) + f" select src, nbr, {fix('sim')} as sim, rank::bigint as rank from knn"),
    "l2_normalize": (l2_normalize, U + f" select id, {fix('sqrt(list_inner_product(e, e))')} as length, (pos - 1)::bigint as pos, {fix('x')} as x from (select u.id, e, unnest(u) as x, generate_subscripts(u, 1) as pos from u join v on u.id = v.id)"),
    "cluster_centroid": (cluster_centroid, V + f" select cluster, (pos - 1)::bigint as pos, {fix('avg(x)')} as value from (select cluster, unnest(e) as x, generate_subscripts(e, 1) as pos from v) group by cluster, pos"),
    "cluster_coherence": (cluster_coherence, V + COH + f" select n.cluster, n, {fix('coherence')} as coherence from (select cluster, count(*) as n from v group by 1) n left join c on n.cluster = c.cluster"),
    "representatives": (representatives, V + f", m as (select cluster, list(value order by pos) as c from (select cluster, pos, avg(x) as value from (select cluster, unnest(e) as x, generate_subscripts(e, 1) as pos from v) group by all) group by cluster), r as (select v.cluster, id, list_cosine_similarity(e, c) as sim from v join m on v.cluster = m.cluster) select cluster, id, {fix('sim')} as sim, (row_number() over (partition by cluster order by sim desc, id))::bigint as rank from r qualify rank <= 8"),
    "top_pairs": (top_pairs, V + f" select i, j, {fix('sim')} as sim from (select a.id as i, b.id as j, list_cosine_similarity(a.e, b.e) as sim from v a join v b on a.id < b.id order by sim desc, i, j limit 10)"),
    "in_cluster_pairs": (in_cluster_pairs, KNN.format(k=10) + ", f as (select c.cluster, least(src, nbr) as i, greatest(src, nbr) as j, min((src, rank)) as spot from knn join v c on src = c.id join v d on nbr = d.id where c.cluster = d.cluster group by 1, 2, 3) select cluster, i, j, (row_number() over (partition by cluster order by spot))::bigint as r from f qualify r <= 8"),
    "same_cluster_rate": (same_cluster_rate, KNN.format(k=7) + f" select {fix('coalesce(sum((a.cluster = b.cluster)::int) / nullif(count(*), 0), 0.0)')} as same_rate, count(*) as pairs from knn join v a on src = a.id join v b on nbr = b.id"),
    "silhouette_cosine": (silhouette_cosine, U + SIL + f" select {fix('silhouette')} as silhouette from sil"),
    "knn_graph_edges": (knn_graph_edges, KNN.format(k=5) + f" select least(src, nbr) as src, greatest(src, nbr) as dst, {fix('max(sim)')} as weight from knn group by 1, 2"),
    "graph_modularity": (graph_modularity, KNN.format(k=5) + f", g as (select least(src, nbr) as s, greatest(src, nbr) as d, max(sim) as w from knn group by 1, 2), e as (select a.cluster as a, b.cluster as b, w from g join v a on s = a.id join v b on d = b.id), k as (select k, sum(w) as degree from (select a as k, w from e union all select b, w from e) group by 1), i as (select a as k, sum(w) as inside from e where a = b group by 1), m as (select sum(w) as m from e) select {fix('sum(coalesce(inside, 0) / m - (degree / (2 * m)) ** 2)')} as modularity from k left join i on k.k = i.k, m"),
    "rerank_context": (rerank_context, KNN.format(k=20) + f""", x as (select vec_id as id, label // 4 as macro, label // 2 as nb, label as micro, source, lang from embeddings join documents on vec_id = doc_id),
 b as (select knn.*, s.id is not null as known, t.id is not null as there, case when s.id is null then sim else sim + case when s.macro = t.macro then 0.008 else 0.0 end::double + case when s.nb = t.nb then 0.022 else 0.0 end::double + case when s.micro = t.micro then 0.035 else 0.0 end::double + case when s.source = t.source then 0.012 else -0.022 end::double + case when s.lang = t.lang then 0.006 else -0.006 end::double end as adj from knn left join x s on src = s.id left join x t on nbr = t.id)
 select src, nbr, {fix('sim')} as sim, (row_number() over (partition by src order by adj desc, sim desc, rank))::bigint as rank from b where not known or there qualify row_number() over (partition by src order by adj desc, sim desc, b.rank) <= 12"""),
    "cluster_size_stats": (cluster_size_stats, f"select count(*) as clusters, {fix('avg(n)')} as avg_size, {fix('median(n)')} as median_size, min(n) as min_size, max(n) as max_size, count(*) filter (n < 5) as tiny from (select count(*) as n from embeddings where label >= 0 group by label)"),
    "majority_parent": (majority_parent, f"with {VOTES} select * from best"),
    "hierarchy_mismatch": (hierarchy_mismatch, f"with {VOTES} select count(*) as checked, count(*) filter (p.parent <> best.parent) as mismatched, {fix('count(*) filter (p.parent <> best.parent) / count(*)')} as rate from {NESTED} p join best on p.child = best.child"),
    "allocate_children": (allocate_children, """with s as (select label as parent, count(*) as n from embeddings group by 1), b as (select parent, n, n - 1 as cap, sum(n - 1) over () as caps, least(37, sum(n) over ()) - count(*) over () as l from s),
 e as (select *, least(cap, floor(l * cap / caps)) as extra, l * cap / caps as exact from b), r as (select *, l - sum(extra) over () as more, row_number() over (order by (extra + 1 < n) desc, extra - exact, n desc, parent) as r from e)
 select parent, (1 + extra + case when r <= more and extra + 1 < n then 1 else 0 end)::bigint as children from r"""),
    "remap_by_size": (remap_by_size, "select label as cluster, (row_number() over (order by count(*) desc, min(vec_id)) - 1)::bigint as new_id, count(*) as n from embeddings group by label"),
    "macro_balance": (macro_balance, f"with s as (select count(*) as n from embeddings where label >= 0 group by label), m as (select avg(n) as a, max(n) as hi, min(n) as lo from s) select {fix('a')} as average, {fix('hi / a')} as largest_ratio, {fix('lo / a')} as smallest_ratio, {fix('greatest(0, hi / a - 1.8) * 12 + greatest(0, 0.45 - lo / a) * 28 + (select count(*) from s, m where n < a * 0.25) * 2.5')} as penalty from m"),
    "ari_nmi": (ari_nmi, f"""with p as (select label as a, vec_id % 3 as b from embeddings), t as (select count(*)::double as t from p), c as (select a, b, count(*)::double as n from p group by all), ra as (select a, sum(n) as n from c group by 1), rb as (select b, sum(n) as n from c group by 1),
 q as (select (select sum(n * (n - 1) / 2) from c) as ij, (select sum(n * (n - 1) / 2) from ra) as sa, (select sum(n * (n - 1) / 2) from rb) as sb, (select -sum(n / t * ln(n / t)) from c, t) as hab, (select -sum(n / t * ln(n / t)) from ra, t) as ha, (select -sum(n / t * ln(n / t)) from rb, t) as hb, t from t)
 select {fix('(ij - sa * sb / (t * (t - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (t * (t - 1) / 2))')} as ari, {fix('(ha + hb - hab) / ((ha + hb) / 2)')} as nmi from q"""),
    "labelability": (labelability, U + SIL + COH + f", z as (select count(*) as k, avg(n) as a, max(n) as hi, count(*) filter (n < 5) as tiny from (select count(*) as n from v group by cluster)) select {fix('(select avg(coherence) from c) + silhouette * 0.5 - abs(a - 14) / 14 - greatest(0, hi - 45) / 45 - tiny / k * 1.5')} as labelability from z, sil"),
}
