"""Queries of the record path: a paged service and its records, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from semloom.functions.vectors import fixed
from semloom.operators.staging import shared_dir
from semloom.plans.vector_queries import fix
from semloom.sources import paged as P
from semloom.sources import records as R
from semloom.sources import tiles as T
from semloom.sources.tables import table


def _served(spark, sf):
    """Orders as a paged service: 2,000 keys a page; every 97th key comes again on the next page at twice the price."""
    o = table(spark, sf, "orders").select(
        (F.floor(F.col("o_orderkey") / 2000) + 1).cast("int").alias("n"), "o_orderkey", "o_custkey", F.col("o_totalprice").cast("double").alias("price"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")
    )
    again = o.where(F.col("o_orderkey") % 97 == 0).withColumn("n", F.col("n") + 1).withColumn("price", F.col("price") * 2)
    path = f"{shared_dir(spark)}/pages-{uuid.uuid4().hex}"
    P.write_pages(o.union(again), "n", path)
    return P.paged(spark, "o_orderkey long, o_custkey long, price double, day string", path=path, filterable="price, day")


def paged_discover(spark, sf):
    rows = _served(spark, sf).where((F.col("price") >= 150000) & (F.col("day") <= "1997-06-30"))
    return P.discover(rows, "o_orderkey", 1000).select("o_orderkey", "o_custkey", fixed(F.col("price"), 2).alias("price"), "day", F.col("page").cast("long").alias("page"))


def paged_balanced(spark, sf):
    rows = P.balanced(_served(spark, sf), "o_orderkey", F.substring("day", 1, 4).cast("long"), 60)
    return rows.select("bucket", "o_orderkey", fixed(F.col("price"), 2).alias("price"))


def details(spark, sf):
    """Nested detail records from orders and their lines, with blank, missing and repeated parts."""
    o, li, p = table(spark, sf, "orders"), table(spark, sf, "lineitem"), table(spark, sf, "part")
    line = li.join(p, li.l_partkey == p.p_partkey).select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_returnflag", "l_linestatus", "p_name", "p_brand", "p_type").alias("l"))
    lines = line.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list("l")).alias("ls"))
    key = F.col("o_orderkey")
    each = lambda f: F.transform("ls", f)
    named = lambda f: each(lambda l: F.struct(f(l).alias("name")))
    review = F.transform(F.filter("ls", lambda l: l["l_discount"] > 0.05), lambda l: F.struct(F.lit("x").alias("author"), F.repeat(F.concat(l["p_type"], F.lit("  ")), F.lit(60)).alias("content")))
    job = lambda l: F.when(l["l_returnflag"] == "R", "Director").otherwise("Writer")
    rows = o.join(lines, "o_orderkey", "left").select(
        key.alias("id"), F.when(key % 3 == 0, "  ").otherwise(F.concat(F.lit("tt"), key)).alias("imdb_id"),
        F.struct(F.when(key % 2 == 0, F.concat(F.lit("ex  "), key)).alias("imdb_id")).alias("external_ids"),
        F.when(key % 11 != 0, F.concat(F.lit(" Order   "), key, F.lit(" "))).alias("title"), F.col("o_orderpriority").alias("original_title"),
        F.when(key % 5 == 0, " ").otherwise(F.concat(F.lit("  "), "o_orderpriority", F.lit("   of\n"), "o_orderstatus")).alias("overview"), F.lit(None).cast("string").alias("tagline"),
        F.when(key % 7 == 0, "").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("release_date"), (F.col("o_custkey") % 200).cast("int").alias("runtime"),
        (key % 13 == 0).alias("adult"), F.when(key % 17 != 0, key % 19 == 0).alias("video"), F.when(F.col("o_orderstatus") == "F", "EN").when(F.col("o_orderstatus") == "O", "en").otherwise("fr").alias("original_language"),
        named(lambda l: F.when(l["l_quantity"] < 5, " ").otherwise(l["p_brand"])).alias("genres"), F.struct(named(lambda l: F.replace(l["p_name"], F.lit(" "), F.lit("   "))).alias("keywords")).alias("keywords"),
        F.struct(review.alias("results")).alias("reviews"),
        F.struct(named(lambda l: F.concat(F.lit("P"), l["l_partkey"])).alias("cast"), each(lambda l: F.struct(job(l).alias("job"), F.concat(F.lit("S"), l["l_suppkey"]).alias("name"))).alias("crew")).alias("credits"),
        F.lit(None).cast("array<struct<name:string>>").alias("production_companies"), named(lambda l: l["l_linestatus"]).alias("production_countries"),
        F.lit(None).cast("string").alias("poster_path"), F.concat(F.lit("/b"), key).alias("backdrop_path"), (F.col("o_totalprice") / 1000).alias("popularity"),
        F.when(key % 23 != 0, F.col("o_totalprice") / 100000).alias("vote_average"), F.when(key % 29 != 0, F.col("o_custkey")).cast("int").alias("vote_count"),
    )
    return rows


def record_normalize(spark, sf):
    flat = R.normalize(details(spark, sf))
    lists = {c for c, t in flat.dtypes if t.startswith("array")}
    numbers = {"vote_average", "popularity"}
    return flat.select(*[F.array_join(c, "|").alias(c) if c in lists else fixed(F.col(c)).alias(c) if c in numbers else F.col(c) for c in flat.columns])


def record_eligible(spark, sf):
    d = R.eligible(details(spark, sf), 1994, "1998-03-01", 40, 50)
    return d.select("id", "release_date", "runtime", "vote_count")


def _signals(spark, sf):
    links = table(spark, sf, "orders").select((F.col("o_orderkey") + 1000000).alias("movieId"), F.col("o_custkey").alias("tmdbId"))
    scores = table(spark, sf, "lineitem").select((F.col("l_orderkey") + 1000000).alias("movieId"), F.col("l_partkey").alias("tagId"), (F.col("l_discount") * 10).alias("relevance"))
    tags = table(spark, sf, "part").where("p_size >= 10").select(F.col("p_partkey").alias("tagId"), F.col("p_name").alias("tag"))
    return R.tag_signals(table(spark, sf, "customer").select(F.col("c_custkey").alias("id")), links, scores.groupBy("movieId", "tagId").agg(F.max("relevance").alias("relevance")), tags, 0.32, 3)


def record_tags(spark, sf):
    return _signals(spark, sf).select("id", F.array_join("tags", "|").alias("tags"))


def record_enrich(spark, sf):
    own = R.normalize(details(spark, sf)).select("id", "imdb_id", "title")
    d = table(spark, sf, "documents")
    synopses = d.select(F.when(F.col("doc_id") % 6 == 0, "").otherwise(F.concat(F.lit("tt"), F.floor(F.col("doc_id") / 2))).alias("imdb_id"), F.array("source", "lang").alias("plot_tags"), F.concat(F.lit("s"), "doc_id").alias("synopsis"), F.col("doc_id").alias("ord"))
    out = R.enrich(own, _signals(spark, sf), synopses)
    return out.select("id", "imdb_id", "title", F.array_join("tags", "|").alias("tags"), F.array_join("plot_tags", "|").alias("plot_tags"), "synopsis")


def viewport_points(spark, sf):
    """Orders as points of a map (customer, price) in tiles of a thousand, and those of one view."""
    path = f"{shared_dir(spark)}/tiles-{uuid.uuid4().hex}"
    points = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").cast("double").alias("x"), F.col("o_totalprice").alias("y"))
    T.write_tiles(points, path, target=1000)
    return T.viewport(spark, path, 40.0, 90000.0, 110.0, 250000.0).select("id", "x", fixed(F.col("y"), 2).alias("y"))


DETAILS = f"""with ls as (select l_orderkey as id, list({{{{'q': l_quantity, 'd': l_discount, 'f': l_returnflag, 's': l_linestatus, 'pk': l_partkey, 'sk': l_suppkey, 'n': p_name, 'b': p_brand, 't': p_type}}}} order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount) as ls from lineitem join part on l_partkey = p_partkey group by 1),
 d as (select o_orderkey as id, case when o_orderkey % 3 <> 0 then 'tt' || o_orderkey when o_orderkey % 2 = 0 then 'ex ' || o_orderkey end as imdb_id, case when o_orderkey % 11 <> 0 then 'Order ' || o_orderkey else '' end as title, o_orderpriority as original_title,
 case when o_orderkey % 7 = 0 then '' else strftime(o_orderdate, '%Y-%m-%d') end as release_date, case when o_orderkey % 7 <> 0 then year(o_orderdate)::int end as year, (o_custkey % 200)::int as runtime, case when o_orderkey % 5 <> 0 then o_orderpriority || ' of ' || o_orderstatus end as overview,
 case when o_orderkey % 23 <> 0 then o_totalprice / 100000 end as vote_average, case when o_orderkey % 29 <> 0 then o_custkey end::int as vote_count, o_totalprice / 1000 as popularity, case o_orderstatus when 'F' then 'EN' when 'O' then 'en' else 'fr' end as original_language,
 o_orderkey % 13 = 0 as adult, o_orderkey % 17 <> 0 and o_orderkey % 19 = 0 as video, coalesce(ls, []) as ls from orders o left join ls on ls.id = o_orderkey)""".replace("{{", "{").replace("}}", "}")
TAGS = """links as (select o_custkey as id, max(o_orderkey) as o from orders join customer on o_custkey = c_custkey group by 1), sc as (select l_orderkey as o, l_partkey as tag, max(l_discount * 10) as r from lineitem group by all),
 tr as (select id, tag, row_number() over (partition by id order by r desc, tag desc) as rank from sc join links using (o) where r >= 0.32 qualify rank <= 3), tg as (select id, string_agg(p_name, '|' order by rank) as tags from tr join part on tag = p_partkey where p_size >= 10 group by 1)"""

SERVED = """with o as (select o_orderkey // 2000 + 1 as page, o_orderkey, o_custkey, o_totalprice::double as price, strftime(o_orderdate, '%Y-%m-%d') as day from orders),
 s as (select * from o union all select page + 1, o_orderkey, o_custkey, price * 2, day from o where o_orderkey % 97 = 0)"""

QUERIES = {
    "viewport_points": (viewport_points, f"select o_orderkey as id, o_custkey::double as x, {fix('o_totalprice', 2)} as y from orders where o_custkey between 40 and 110 and o_totalprice between 90000 and 250000"),
    "record_normalize": (record_normalize, DETAILS + f""" select id, imdb_id, title, original_title, release_date, year, runtime, overview, array_to_string([x.b for x in ls if x.q >= 5], '|') as genres, array_to_string([x.n for x in ls], '|') as keywords, {fix('vote_average')} as vote_average, vote_count, {fix('popularity')} as popularity,
 array_to_string([left(trim(repeat(x.t || ' ', 60)), 500) for x in ls if x.d > 0.05], '|') as reviews, original_language, array_to_string([x.s for x in ls], '|') as production_countries, '' as production_companies, array_to_string(['P' || x.pk for x in ls[1:10]], '|') as cast, array_to_string(['S' || x.sk for x in ls if x.f = 'R'], '|') as directors,
 null::varchar as poster_path, '/b' || id as backdrop_path from d"""),
    "record_eligible": (record_eligible, DETAILS + " select id, release_date, runtime, vote_count from d where coalesce(year, 0) >= 1994 and release_date <= '1998-03-01' and not adult and not video and lower(original_language) = 'en' and runtime >= 40 and coalesce(vote_count, 0) >= 50 and overview is not null"),
    "record_tags": (record_tags, "with " + TAGS + " select id, tags from tg"),
    "record_enrich": (record_enrich, DETAILS + ", " + TAGS + """, syn as (select case when doc_id % 6 <> 0 then 'tt' || (doc_id // 2) end as imdb_id, source || '|' || lang as plot_tags, 's' || doc_id as synopsis from documents where doc_id % 6 <> 0 qualify row_number() over (partition by doc_id // 2 order by doc_id desc) = 1)
 select d.id, d.imdb_id, title, coalesce(tags, '') as tags, coalesce(plot_tags, '') as plot_tags, synopsis from d left join tg on d.id = tg.id left join syn on d.imdb_id = syn.imdb_id"""),
    "paged_discover": (paged_discover, SERVED + f", f as (select * from s where price >= 150000 and day <= '1997-06-30' qualify row_number() over (partition by o_orderkey order by page) = 1 order by page, o_orderkey limit 1000) select o_orderkey, o_custkey, {fix('price', 2)} as price, day, page::bigint as page from f"),
    "paged_balanced": (paged_balanced, SERVED + f""", f as (select *, left(day, 4)::bigint as bucket from s qualify row_number() over (partition by left(day, 4), o_orderkey order by page) = 1),
 t as (select * from f qualify row_number() over (partition by bucket order by page, o_orderkey) <= 60)
 select bucket, o_orderkey, {fix('price', 2)} as price from t qualify row_number() over (partition by o_orderkey order by bucket, page) = 1"""),
}
