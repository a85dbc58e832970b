"""Labels in context, neighbour patterns, variant notes and label texts, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from semloom.functions import text as X
from semloom.functions.vectors import fixed
from semloom.operators import comparison as M
from semloom.operators import labelling as L
from semloom.operators import neighbors as N
from semloom.operators.staging import kept
from semloom.plans.vector_queries import KNN, fix
from semloom.sources.tables import layers, table, vectors


def label_context(spark, sf):
    """Nations as clusters below their regions; every fifth region has no label."""
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    evidence = n.select(F.col("n_nationkey").alias("cluster"), F.array(F.concat(F.lit("about "), "n_name")).alias("warnings"))
    parents = n.select(F.col("n_nationkey").alias("cluster"), F.col("n_regionkey").alias("parent"))
    labels = r.where("r_regionkey % 5 <> 4").select(F.col("r_regionkey").alias("parent"), F.col("r_name").alias("label"))
    return L.label_context(evidence, parents, labels, "neighborhood").select("cluster", F.array_join("warnings", "; ").alias("warnings"))


def region_labels(spark, sf):
    """Market segments of customers as regions: place by the mean of key and balance; size where the segment's name is long, else points."""
    c = table(spark, sf, "customer").withColumn("cluster", F.col("c_nationkey"))
    labels = table(spark, sf, "nation").select(F.when(F.col("n_nationkey") % 4 == 3, "micro").otherwise("macro").alias("layer"), F.col("n_nationkey").alias("cluster"), F.col("n_name").alias("label"))
    regions = c.groupBy("cluster").agg(F.avg("c_custkey").alias("x"), F.avg("c_acctbal").alias("y"), F.count("*").alias("points"))
    regions = regions.withColumn("size", F.when(F.col("cluster") % 2 == 0, F.col("points") * 2)).withColumn("layer", F.lit("macro"))
    out = L.region_labels(labels, regions, "macro")
    return out.select("cluster", "label", fixed(F.col("x"), 3).alias("x"), fixed(F.col("y"), 2).alias("y"), "n", "rank")


def _patterns(spark, sf, near=None):
    p = table(spark, sf, "part")
    titles = p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"))
    word = lambda i: F.element_at(F.split("p_name", " "), i)
    first = p.groupBy("p_name").agg(F.min("p_partkey").alias("k"))
    good = first.select(F.initcap("p_name").alias("title"), word(1).alias("pattern"), F.lit(True).alias("good"))
    bad = first.select(F.initcap("p_name").alias("title"), F.lower(word(-1)).alias("pattern"), F.lit(False).alias("good"))
    absent = first.where("k % 3 = 0").select(F.concat(F.lit("no "), "p_name").alias("title"), F.lit("x").alias("pattern"), F.lit(True).alias("good"))
    near = N.nearest(vectors(spark, sf).select("id", "embedding"), 7) if near is None else near
    return L.pattern_hits(near, titles, good.union(bad).union(absent))


def neighbor_patterns(spark, sf):
    return _patterns(spark, sf)


def pattern_summary(spark, sf):
    return L.pattern_summary(_patterns(spark, sf))


def selection_full(spark, sf):
    """The selection score with neighbour patterns, tiny clusters and a measured mismatch, its parts beside it."""
    lay = layers(spark, sf)
    v = vectors(spark, sf).select("id", "embedding")
    near = kept(N.nearest(v, 7))
    row = M.selection(v, lay, near, _patterns(spark, sf, near), 0.25)
    names = ("macro", "neighborhood", "micro", "coherence", "penalty", "score")
    return row.select(*[fixed(F.col(c)).alias(c) for c in names], "good", "bad", "tiny")


def variant_notes(spark, sf):
    """Languages as variants: confidence from labels, coherence from lengths, noise from marks."""
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    name = F.when(F.col("lang") == "en", "no_reviews").when(F.col("lang") == "de", "light_reviews").when(F.col("lang") == "fr", "medium_reviews").otherwise(F.col("lang"))
    s = d.groupBy(name.alias("variant")).agg(F.avg("quality").alias("confidence"), F.avg((F.length("text") % 100) / 100).alias("coherence"), (F.count_if(F.length("text") < 60) % 7).alias("tiny"), (F.count_if(F.contains("text", F.lit("#"))) % 11).alias("noise"))
    return L.variant_notes(s)


def fnv_hash(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", X.fnv1a_letters(F.substring_index("text", " ", 5)).alias("hash"))


def wrapped_labels(spark, sf):
    p = table(spark, sf, "part")
    label = F.concat_ws(" ", "p_name", "p_brand", "p_type", "p_name")
    return p.select("p_partkey", F.array_join(X.wrapped(label, 24), "/").alias("lines"), X.runtime_text(F.col("p_size") * 7).alias("runtime"), X.year_text(F.when(F.col("p_partkey") % 2 == 0, F.col("p_size")), F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand"))).alias("year"))


PATTERNS = KNN.format(k=7) + """, ti as (select lower(p_name) as key, max(p_partkey) as src from part group by 1), f as (select p_name, min(p_partkey) as k from part group by 1),
 pa as (select p_name as title, split_part(p_name, ' ', 1) as pattern, true as good from f union all select p_name, lower(split_part(p_name, ' ', -1)), false from f union all select 'no ' || p_name, 'x', true from f where k % 3 = 0),
 nr as (select src, lower(p_name) as other from knn join part on nbr = p_partkey),
 h as (select case when starts_with(pa.title, 'no ') then pa.title else (select string_agg(upper(w[1]) || lower(w[2:]), ' ') from (select unnest(string_split(pa.title, ' ')) as w)) end as title, src is not null as present, pattern, good, exists (select 1 from nr where nr.src = ti.src and contains(other, pattern)) as hit from pa left join ti on lower(pa.title) = key)"""

QUERIES = {
    "label_context": (label_context, f"select n_nationkey as cluster, 'about ' || n_name || case when r_regionkey % 5 <> 4 then '; Parent macro label: ' || r_name else '' end || '; {L.GENERAL}' as warnings from nation join region on n_regionkey = r_regionkey"),
    "region_labels": (region_labels, f"with r as (select c_nationkey as cluster, avg(c_custkey) as x, avg(c_acctbal) as y, count(*) * case when c_nationkey % 2 = 0 then 2 else 1 end as n from customer group by c_nationkey) select n_nationkey as cluster, n_name as label, {fix('x', 3)} as x, {fix('y', 2)} as y, n::bigint as n, row_number() over (order by n desc, n_nationkey) as rank from nation join r on n_nationkey = cluster where n_nationkey % 4 <> 3"),
    "neighbor_patterns": (neighbor_patterns, PATTERNS + " select * from h"),
    "pattern_summary": (pattern_summary, PATTERNS + " select count(distinct title) as requested, count(distinct title) filter (present) as present, count(*) filter (hit and not good) as bad_hits, count(*) filter (hit and good) as good_hits from h"),
    "selection_full": (selection_full, PATTERNS + f""", l as (select vec_id as id, floor(label / 4)::int as macro, floor(label / 2)::int as neighborhood, label as micro from embeddings),
 r as (select avg((a.macro = b.macro)::int) as macro, avg((a.neighborhood = b.neighborhood)::int) as neighborhood, avg((a.micro = b.micro)::int) as micro from knn join l a on src = a.id join l b on nbr = b.id),
 w as (select v.id, e, unnest(['a' || macro, 'b' || neighborhood, 'c' || micro]) as c from v join l on v.id = l.id), n as (select c, count(*) as n from w group by 1), co as (select avg(x) as coherence from (select a.c, avg(list_cosine_similarity(a.e, b.e)) as x from w a join w b on a.c = b.c and a.id < b.id group by 1)),
 z as (select count(*) as n from l group by macro), y as (select avg(n) as a, max(n) as hi, min(n) as lo from z), pe as (select greatest(0, hi / a - 1.8) * 12 + greatest(0, 0.45 - lo / a) * 28 + (select count(*) from z, y where n < a * 0.25) * 2.5 as penalty from y),
 x as (select *, (select count(*) from h where hit and good) as good, (select count(*) from h where hit and not good) as bad, (select count(*) from n where n < 5) as tiny from r, co, pe)
 select {fix('macro')} as macro, {fix('neighborhood')} as neighborhood, {fix('micro')} as micro, {fix('coherence')} as coherence, {fix('penalty')} as penalty, {fix('macro * 6 + neighborhood * 20 + micro * 24 + coherence * 22 + good * 0.7::double - 0.25::double * 55 - bad * 3 - tiny * 0.03::double - penalty')} as score, good, bad, tiny from x"""),
    "variant_notes": (variant_notes, """with s as (select case lang when 'en' then 'no_reviews' when 'de' then 'light_reviews' when 'fr' then 'medium_reviews' else lang end as variant, coalesce(avg(quality), 0) as c, avg((length(text) % 100) / 100) as h, count(*) filter (length(text) < 60) % 7 as tiny, count(*) filter (contains(text, '#')) % 11 as noise from documents left join labels using (doc_id) group by 1),
 p as (select * from s where variant = 'no_reviews'), l as (select * from s where variant = 'light_reviews'), m as (select * from s where variant = 'medium_reviews')
 select (select variant from s order by c + h - 0.02 * tiny - 0.002 * noise - case when variant = 'medium_reviews' then 0.03 else 0.0 end desc, variant limit 1) as recommended, case when l.c - p.c >= 0 and l.h - p.h >= -0.01 then 'light helps or preserves' else 'light may hurt' end as light_note, case when m.noise > l.noise or m.c - l.c < -0.02 then 'medium is noisier' else 'medium adds no obvious noise' end as medium_note from p, l, m"""),
    "fnv_hash": (fnv_hash, "with t as (select doc_id, array_to_string(string_split(text, ' ')[1:5], ' ') as t from documents) select doc_id, list_reduce([unicode(c)::bigint for c in string_split(t, '')], lambda h, u: (xor(h, u) * 16777619) & 4294967295, 2166136261::bigint) as hash from t"),
    "wrapped_labels": (wrapped_labels, """with t as (select *, string_split(trim(regexp_replace(p_name || ' ' || p_brand || ' ' || p_type || ' ' || p_name, '\\s+', ' ', 'g')), ' ') as w from part)
 select p_partkey, list_reduce(w, lambda a, x: case when length(split_part(a, '/', -1)) + 1 + length(x) <= 24 then a || ' ' || x else a || '/' || x end) as lines, case when p_size * 7 = 0 then '' when p_size * 7 < 60 then (p_size * 7) || ' min' else (p_size * 7 // 60) || 'h ' || (p_size * 7 % 60) || 'm' end as runtime, case when p_partkey % 2 = 0 then p_size::varchar when p_partkey % 3 = 0 then left(p_brand, 4) else 'Unknown year' end as year from t"""),
}
