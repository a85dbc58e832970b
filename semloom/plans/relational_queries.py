"""Relational, rule, search and geometry queries over the tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from semloom.functions import text as X
from semloom.functions.vectors import fixed
from semloom.operators import clusters as C
from semloom.operators import layout as L
from semloom.operators import neighbors as N
from semloom.operators import relational as R
from semloom.operators import rules as S
from semloom.operators import search as B
from semloom.plans.vector_queries import KNN, fix
from semloom.sources.tables import table, vectors

PROPS = "k long"


def nested_normalize(spark, sf):
    e = table(spark, sf, "events")
    props = F.from_json("props", PROPS)
    return e.select("event_id", X.clean_or_null(F.col("event_type")).alias("kind"), F.year("ts").cast("long").alias("year"), F.concat((F.floor(F.year("ts") / 10) * 10).cast("string"), F.lit("s")).alias("decade"), props["k"].alias("k"))


def eligible_topn(spark, sf):
    o = table(spark, sf, "orders").where((F.coalesce("o_totalprice", F.lit(0.0)) >= 50000) & (F.col("o_orderstatus") == "F") & (F.date_format("o_orderdate", "yyyy-MM-dd") >= "1995-01-01"))
    return o.orderBy((F.col("o_orderpriority") == "1-URGENT").desc(), F.desc("o_totalprice"), "o_orderkey").limit(100).select("o_orderkey", "o_custkey", "o_orderpriority", fixed(F.col("o_totalprice"), 2).alias("price"))


def balanced_sample(spark, sf):
    o = table(spark, sf, "orders").withColumn("bucket", F.year("o_orderdate").cast("long"))
    return R.top_per_key(o, ["bucket"], [F.desc("o_totalprice"), F.col("o_orderkey")], 20).select("bucket", "o_orderkey", "rank")


def dedupe_first(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return R.first_wins(e, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", fixed(F.col("value"), 2).alias("value"))


def tag_topk_join(spark, sf):
    li = table(spark, sf, "lineitem").where("l_discount >= 0.02").select("l_orderkey", "l_partkey", "l_discount", "l_linenumber")
    top = R.top_per_key(li, ["l_orderkey"], [F.desc("l_discount"), F.desc("l_partkey"), F.col("l_linenumber")], 3)
    p = table(spark, sf, "part").where("p_size >= 10").select("p_partkey", "p_name")
    return top.join(p, top.l_partkey == p.p_partkey).select("l_orderkey", "rank", "p_partkey", "p_name")


def left_enrich(spark, sf):
    d, l = table(spark, sf, "documents").select("doc_id", "lang"), table(spark, sf, "labels")
    return d.join(l, "doc_id", "left").select("doc_id", "lang", F.coalesce("quality", F.lit(-1)).alias("quality"), F.coalesce("toxic", F.lit(-1)).alias("toxic"))


def cache_misses(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))
    cache = d.join(table(spark, sf, "labels"), "doc_id", "left_semi")
    return R.cache_misses(d, cache, "hash").select("doc_id", "hash")


def counter_topn(spark, sf):
    return R.counter(table(spark, sf, "part").withColumn("word", F.explode(F.split("p_name", " "))), "word", 25)


def missing_fields(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return R.missing_fields(d, "doc_id", ["text", "quality", "toxic"], 50)


def percent_with(spark, sf):
    d = table(spark, sf, "documents")
    return R.share(d, "long", F.length("text") > 2000).select("name", "hits", "total", fixed(F.col("share")).alias("share"))


def coverage(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return d.groupBy("source").agg(F.count("*").alias("n"), F.count("quality").alias("labelled"), F.count_if(F.col("toxic") == 1).alias("toxic"))


def reception_tags(spark, sf):
    p = table(spark, sf, "part")
    tags = R.status_tags(F.col("p_size") / 5, F.col("p_retailprice") * 2, F.col("p_partkey") % 150)
    return p.select("p_partkey", F.array_join(tags, "; ").alias("tags"))


def shard_modulo(spark, sf):
    return R.shard(table(spark, sf, "customer"), "c_custkey", 100).groupBy("shard").agg(F.count("*").alias("n"), F.min("c_custkey").alias("first"))


def verdict_counts(spark, sf):
    e = table(spark, sf, "events").withColumn("big", F.col("value") > 50)
    return e.groupBy("event_type", "big").agg(F.count("*").alias("n"))


def duplicate_titles(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", X.plain_label(F.col("text")).alias("label"))
    g = d.where("label <> ''").groupBy("label").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))
    return g.where("n > 1")


def _clusters(spark, sf):
    return table(spark, sf, "embeddings").groupBy(F.col("label").alias("cluster")).agg(F.concat(F.lit("label "), F.col("label").cast("string")).alias("label")).distinct()


def _rules(spark, sf):
    """Rules from the documents: ord doc_id, cluster doc_id mod 10, new label its source."""
    d = table(spark, sf, "documents")
    return d.select((F.col("doc_id") % 10).cast("int").alias("cluster"), F.col("doc_id").alias("ord"), F.col("source").alias("new_label"))


def label_repair_final(spark, sf):
    return S.final_labels(_clusters(spark, sf), _rules(spark, sf))


def label_repair_log(spark, sf):
    return S.label_log(_clusters(spark, sf), _rules(spark, sf))


def neighbor_repair(spark, sf):
    v = vectors(spark, sf)
    rule = v.select(F.col("id").alias("src"), F.posexplode(F.array(F.col("id") + 1, F.col("id") + 2)).alias("pos", "nbr"))
    return S.neighbor_repair(N.nearest(v, 10), rule).select("src", "nbr", fixed(F.col("sim")).alias("sim"), "rank")


def label_contradictions(spark, sf):
    d = table(spark, sf, "documents")
    low = F.lower("text")
    label = d.select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 3 == 0, "macro").when(F.col("doc_id") % 3 == 1, "neighborhood").otherwise("micro").alias("layer"), low.alias("label"), F.col("lang").alias("signal"))
    checks = spark.createDataFrame([("english", ["the", "with"], ["en"]), ("german", ["und", "der "], ["de"])], "flag string, label_terms array<string>, signal_terms array<string>")
    return S.contradictions(label, checks)


def weak_clusters(spark, sf):
    v = vectors(spark, sf)
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "lang")
    n = v.join(d, "id").groupBy("cluster", "lang").agg(F.count("*").alias("n"))
    share = n.groupBy("cluster").agg((F.max("n") / F.sum("n")).alias("share"))
    e = C.coherence(v).join(share, "cluster").withColumn("layer", F.when(F.col("cluster") < 5, "low").otherwise("high"))
    return S.weak_clusters(e, 4).select("layer", "cluster", fixed(F.col("coherence")).alias("coherence"), fixed(F.col("share")).alias("share"), "rank")


def normalize_results(spark, sf):
    e = table(spark, sf, "events").select((F.col("user_id") * 3).alias("id"), F.col("event_id").alias("ord"), F.upper("event_type").alias("verdict"), F.floor(F.col("value") / 20).cast("int").alias("severity"))
    e = e.withColumn("verdict", F.when(F.col("verdict") == "CLICK", "FAIL").when(F.col("verdict") == "VIEW", "Pass").otherwise(F.col("verdict")))
    return S.normalized_results(e, table(spark, sf, "customer").select(F.col("c_custkey").alias("id")))


def search_rank(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_size").cast("string").alias("year"), F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("everything"))
    return B.search(p, "br", 8).select("id", "title", fixed(F.col("score")).alias("score"))


def accent_search(spark, sf):
    """The best twenty documents for a query with accents and capitals, by their first line, language and whole text."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), F.col("source").alias("original_title"), F.col("lang").alias("year"), F.col("text").alias("everything"))
    return B.folded_search(d, "CÍON", 20).select("id", "title", fixed(F.col("score")).alias("score"))


def level_of_detail(spark, sf):
    p = table(spark, sf, "part").groupBy(B.layer_of_zoom(F.col("p_size") / 5).alias("layer")).agg(F.count("*").alias("n"))
    return p


def _points(spark, sf):
    return vectors(spark, sf).select("id", "cluster", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))


def point_bounds(spark, sf):
    b = L.bounds(_points(spark, sf), "cluster")
    return b.select("cluster", "n", *[fixed(F.col(c)).alias(c) for c in ("x0", "x1", "y0", "y1", "cx", "cy")])


def scaled_radii(spark, sf):
    n = _points(spark, sf).groupBy("cluster").agg(F.count("*").alias("n"))
    return L.scaled_radii(n, 1.0, 0.6, 0.05).select("cluster", "n", fixed(F.col("r")).alias("r"))


def centroid_affinity(spark, sf):
    c = L.bounds(_points(spark, sf), "cluster").select("cluster", "cx", "cy")
    return L.centroid_affinity(c, 4).select("a", "b", fixed(F.col("w")).alias("w"))


def cluster_affinity(spark, sf):
    v = vectors(spark, sf)
    c = v.select("id", "cluster")
    links = N.nearest(v, 10).join(c.withColumnsRenamed({"id": "src", "cluster": "a"}), "src").join(c.withColumnsRenamed({"id": "nbr", "cluster": "b"}), "nbr")
    n = c.groupBy("cluster").agg(F.count("*").alias("n"))
    return L.cluster_affinity(links, n, 0.2).select("a", "b", fixed(F.col("w")).alias("w"))


def golden_spiral(spark, sf):
    return L.spiral(_points(spark, sf)).select("cluster", "id", fixed(F.col("x")).alias("x"), fixed(F.col("y")).alias("y"))


def point_in_polygon(spark, sf):
    square = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((-0.1, -0.1), (0.1, -0.08), (0.12, 0.1), (-0.08, 0.12))])
    return _points(spark, sf).where(L.inside(F.col("x"), F.col("y"), square)).select("id")


def hit_test(spark, sf):
    p = _points(spark, sf)
    probes = p.where("id % 10 = 0").select(F.col("id").alias("probe"), (F.col("x") + 0.01).alias("px"), (F.col("y") - 0.01).alias("py"))
    return L.hits(p, probes, 0.05).select("probe", "id", fixed(F.col("d")).alias("d"))


PTS = "p as (select vec_id as id, label as cluster, embedding[1]::double as x, embedding[2]::double as y from embeddings)"
LABELS = "c as (select distinct label as cluster, 'label ' || label as label from embeddings), r as (select (doc_id % 10)::int as cluster, doc_id as ord, source as new_label from documents)"

QUERIES = {
    "nested_normalize": (nested_normalize, "select event_id, nullif(trim(event_type), '') as kind, year(ts)::bigint as year, (floor(year(ts) / 10) * 10)::bigint || 's' as decade, json_extract(props, '$.k')::bigint as k from events"),
    "eligible_topn": (eligible_topn, f"select o_orderkey, o_custkey, o_orderpriority, {fix('o_totalprice', 2)} as price from orders where coalesce(o_totalprice, 0) >= 50000 and o_orderstatus = 'F' and strftime(o_orderdate, '%Y-%m-%d') >= '1995-01-01' order by (o_orderpriority = '1-URGENT') desc, o_totalprice desc, o_orderkey limit 100"),
    "balanced_sample": (balanced_sample, "select year(o_orderdate)::bigint as bucket, o_orderkey, row_number() over (partition by year(o_orderdate) order by o_totalprice desc, o_orderkey) as rank from orders qualify rank <= 20"),
    "dedupe_first": (dedupe_first, f"select user_id, event_type, event_id, {fix('value', 2)} as value from events qualify row_number() over (partition by user_id, event_type order by ts, event_id) = 1"),
    "tag_topk_join": (tag_topk_join, "with t as (select l_orderkey, l_partkey, row_number() over (partition by l_orderkey order by l_discount desc, l_partkey desc, l_linenumber) as rank from lineitem where l_discount >= 0.02 qualify rank <= 3) select l_orderkey, rank, p_partkey, p_name from t join part on l_partkey = p_partkey where p_size >= 10"),
    "left_enrich": (left_enrich, "select d.doc_id, lang, coalesce(quality, -1) as quality, coalesce(toxic, -1) as toxic from documents d left join labels l on d.doc_id = l.doc_id"),
    "cache_misses": (cache_misses, "with d as (select doc_id, sha256(text) as hash from documents) select * from d where hash not in (select hash from d where doc_id in (select doc_id from labels))"),
    "counter_topn": (counter_topn, "select value, n, row_number() over (order by n desc, value) as rank from (select value, count(*) as n from (select unnest(string_split(p_name, ' ')) as value from part) group by 1 order by n desc, value limit 25)"),
    "missing_fields": (missing_fields, "select * from (select d.doc_id, array_to_string(list_filter([case when coalesce(text, '') = '' then 'text' end, case when coalesce(quality, 0) = 0 then 'quality' end, case when coalesce(toxic, 0) = 0 then 'toxic' end], lambda x: x is not null), ', ') as missing from documents d left join labels l on d.doc_id = l.doc_id) where missing <> '' order by doc_id limit 50"),
    "percent_with": (percent_with, f"select 'long' as name, count(*) filter (length(text) > 2000) as hits, count(*) as total, {fix('count(*) filter (length(text) > 2000) / count(*)')} as share from documents"),
    "coverage": (coverage, "select source, count(*) as n, count(quality) as labelled, count(*) filter (toxic = 1) as toxic from documents d left join labels l on d.doc_id = l.doc_id group by 1"),
    "reception_tags": (reception_tags, """with p as (select p_partkey, p_size / 5 as r, p_retailprice * 2 as v, p_partkey % 150 as p from part) select p_partkey, coalesce(array_to_string(list_filter([
 case when r >= 8.0 and v >= 1000 then 'reception: widely acclaimed' when r >= 7.2 and v >= 1000 then 'reception: well liked' when r <= 5.5 and v >= 500 then 'reception: poorly received' when r > 5.5 and r < 7.0 and v >= 1000 then 'reception: mixed mainstream' end,
 case when v >= 8000 or p >= 120 then 'audience scale: blockbuster visibility' when v >= 2500 then 'audience scale: mainstream visibility' when v < 500 then 'audience scale: niche visibility' end,
 case when r >= 7.0 and v < 800 then 'status: small-audience favorite' end, case when r < 6.0 and v >= 1000 then 'status: possible b-movie or misfire' end], lambda x: x is not null), '; '), '') as tags from p"""),
    "shard_modulo": (shard_modulo, "select (c_custkey % 100)::int as shard, count(*) as n, min(c_custkey) as first from customer group by 1"),
    "verdict_counts": (verdict_counts, "select event_type, value > 50 as big, count(*) as n from events group by all"),
    "duplicate_titles": (duplicate_titles, "select label, count(*) as n, min(doc_id) as first from (select doc_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) as label from documents) where label <> '' group by 1 having count(*) > 1"),
    "label_repair_final": (label_repair_final, f"with {LABELS} select c.cluster, coalesce(arg_max(new_label, ord), any_value(label)) as label from c left join r on c.cluster = r.cluster group by 1"),
    "label_repair_log": (label_repair_log, f"with {LABELS}, x as (select c.cluster, ord, coalesce(lag(new_label) over (partition by c.cluster order by ord), label) as old, new_label as new from c join r on c.cluster = r.cluster) select * from x where old is distinct from new"),
    "neighbor_repair": (neighbor_repair, KNN.format(k=10) + f""", n as (select id as src, id + d as nbr, floor((0.86::double - 0.025::double * (d - 1)) * 1e6 + 0.5) / 1e6 as sim, 0 as part, d - 1 as place from v, (values (1), (2)) t(d)),
 a as (select * from n union all select src, nbr, sim, 1, rank from knn), o as (select * from a where src <> nbr qualify row_number() over (partition by src, nbr order by part, place) = 1),
 r as (select src, nbr, sim, part, row_number() over (partition by src order by part, place) as rank from o qualify rank <= 12 or part = 0)
 select src, nbr, {fix('sim')} as sim, rank from r"""),
    "label_contradictions": (label_contradictions, """with l as (select doc_id as id, case doc_id % 3 when 0 then 'macro' when 1 then 'neighborhood' else 'micro' end as layer, lower(text) as label, lang as signal from documents)
 select id, layer, flag, case when layer = 'micro' then 2 else 1 end as severity from l, (values ('english', 'the', 'with', 'en'), ('german', 'und', 'der ', 'de')) c(flag, a, b, s) where layer <> 'macro' and (contains(label, a) or contains(label, b)) and not contains(signal, s)"""),
    "weak_clusters": (weak_clusters, "with v as (select vec_id as id, label as cluster, list_transform(embedding, lambda x: x::double) as e from embeddings), c as (select a.cluster, avg(list_cosine_similarity(a.e, b.e)) as coherence from v a join v b on a.cluster = b.cluster and a.id < b.id group by 1), s as (select cluster, max(n) / sum(n) as share from (select cluster, lang, count(*) as n from v join documents on id = doc_id group by all) group by 1)"
     + f", e as (select case when c.cluster < 5 then 'low' else 'high' end as layer, c.cluster, coherence, share from c join s on c.cluster = s.cluster) select layer, cluster, {fix('coherence')} as coherence, {fix('share')} as share, row_number() over (partition by layer order by coalesce(coherence, 0), share, cluster) as rank from e where coherence < 0.57 or share < 0.35 qualify rank <= 4"),
    "normalize_results": (normalize_results, "with e as (select user_id * 3 as id, event_id as ord, case upper(event_type) when 'CLICK' then 'fail' when 'VIEW' then 'pass' else lower(event_type) end as verdict, floor(value / 20)::int as severity from events), f as (select * from e where id in (select c_custkey from customer) qualify row_number() over (partition by id order by ord) = 1) select id, case when verdict in ('pass', 'mixed', 'fail') then verdict else 'mixed' end as verdict, greatest(0, least(3, coalesce(severity, 0))) as severity from f"),
    "search_rank": (search_rank, f"with p as (select p_partkey as id, lower(p_name) as t, p_name as title, p_size::varchar as y, lower(p_name || ' ' || p_brand || ' ' || p_type) as e from part), s as (select id, title, case when t = 'br' then 0.0 when starts_with(t, 'br') then 1.0 when instr(t, 'br') > 0 then 2 + (instr(t, 'br') - 1)::double / 100 when starts_with(y, 'br') then 3.0 when instr(e, 'br') > 0 then 4 + (instr(e, 'br') - 1)::double / 1000 end::double as score from p) select id, title, {fix('score')} as score from s where score is not null order by s.score, id limit 8"),
    "accent_search": (accent_search, f"""with p as (select doc_id as id, split_part(text, chr(10), 1) as title, strip_accents(lower(split_part(text, chr(10), 1))) as t, strip_accents(lower(source)) as o, lang as y, strip_accents(lower(text)) as e from documents),
 s as (select id, title, case when t = 'cion' or o = 'cion' then 0.0 when starts_with(t, 'cion') or starts_with(o, 'cion') then 1.0 when instr(t, 'cion') > 0 then 2 + (instr(t, 'cion') - 1)::double / 100 when starts_with(y, 'cion') then 3.0 when instr(e, 'cion') > 0 then 4 + (instr(e, 'cion') - 1)::double / 1000 end::double as score from p)
 select id, title, {fix('score')} as score from s where score is not null order by s.score, id limit 20"""),
    "level_of_detail": (level_of_detail, "select case when p_size / 5 < 3.15 then 'macro' when p_size / 5 < 7.1 then 'neighborhood' else 'micro' end as layer, count(*) as n from part group by 1"),
    "point_bounds": (point_bounds, f"with {PTS} select cluster, count(*) as n, {fix('min(x)')} as x0, {fix('max(x)')} as x1, {fix('min(y)')} as y0, {fix('max(y)')} as y1, {fix('avg(x)')} as cx, {fix('avg(y)')} as cy from p group by 1"),
    "scaled_radii": (scaled_radii, f"with {PTS}, n as (select cluster, count(*) as n from p group by 1) select cluster, n, {fix('greatest(0.05, sqrt(n) * sqrt(0.6 / sum(n) over ()))')} as r from n"),
    "centroid_affinity": (centroid_affinity, f"with {PTS}, c as (select cluster, avg(x) as x, avg(y) as y from p group by 1), d as (select a.cluster as a, b.cluster as b, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) as d from c a join c b on a.cluster <> b.cluster), r as (select *, row_number() over (partition by a order by d, b) as rank from d qualify rank <= 4) select a, b, {fix('1 - (rank - 1) / 4 + greatest(0, 1 - d / max(d) over (partition by a)) * 0.45')} as w from r"),
    "cluster_affinity": (cluster_affinity, KNN.format(k=10) + f", n as (select cluster, count(*) as n from v group by 1), s as (select least(a.cluster, b.cluster) as a, greatest(a.cluster, b.cluster) as b, sum(greatest(0, sim - 0.2)) as s from knn join v a on src = a.id join v b on nbr = b.id where a.cluster <> b.cluster group by 1, 2) select a, b, {fix('least(3.2, s / greatest(1, sqrt(x.n * y.n)) * 9)')} as w from s join n x on a = x.cluster join n y on b = y.cluster"),
    "golden_spiral": (golden_spiral, f"with {PTS}, i as (select cluster, id, (row_number() over (partition by cluster order by id) - 1)::double as i, count(*) over (partition by cluster) as n from p) select cluster, id, {fix('sqrt((i + 0.5) / n) * cos(i * 2.399963229728653)')} as x, {fix('sqrt((i + 0.5) / n) * sin(i * 2.399963229728653)')} as y from i"),
    "point_in_polygon": (point_in_polygon, f"with {PTS}, e as (select * from (values (-0.1, -0.1, 0.1, -0.08), (0.1, -0.08, 0.12, 0.1), (0.12, 0.1, -0.08, 0.12), (-0.08, 0.12, -0.1, -0.1)) t(x0, y0, x1, y1)) select id from p, e group by id having count(*) filter ((y0 > y) <> (y1 > y) and x < (x1 - x0)::double * (y - y0) / (y1 - y0) + x0) % 2 = 1"),
    "hit_test": (hit_test, f"with {PTS}, q as (select id as probe, x + 0.01 as px, y - 0.01 as py from p where id % 10 = 0), d as (select probe, id, sqrt((x - px) ** 2 + (y - py) ** 2) as d from p, q) select probe, id, {fix('d')} as d from d where d <= 0.05 qualify row_number() over (partition by probe order by d.d, id) = 1"),
}
