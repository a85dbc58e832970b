"""Text queries over documents and conversations, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from semloom.functions import lexicon
from semloom.functions import text as X
from semloom.functions.vectors import fixed
from semloom.operators import texts as T
from semloom.plans.vector_queries import fix
from semloom.sources.tables import table

#: Common short words of the table's prose stand in for a lexicon of the subject's own.
FORMS = {"first": ("the", "and", "that"), "second": ("der", "die", "und"), "third": ("les", "des", "que"), "fourth": ("una", "los", "con")}
STOP = ["the", "of", "and"]


def docs(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", "source", "lang")


def digest(name, column):
    """A query that returns md5 and length of a text column, so that rows stay small."""

    def run(spark, sf):
        return docs(spark, sf).select("id", F.md5(column(F.col("text")).cast("binary")).alias("digest"), F.length(column(F.col("text"))).cast("long").alias("size"))

    run.__name__ = name
    return run


def sql_digest(x: str) -> str:
    return f"with t as (select doc_id as id, {x} as t from documents) select id, md5(t) as digest, length(t)::bigint as size from t"


def token_cost(spark, sf):
    t = docs(spark, sf).groupBy("source").agg(F.count("*").alias("n"), F.sum(X.token_estimate(F.col("text"))).alias("tokens"))
    return t.select("source", "n", "tokens", fixed(F.col("tokens") * 0.13 / 1e6, 9).alias("usd"))


def title_tokens(spark, sf):
    return docs(spark, sf).select("id", F.array_join(X.title_tokens(F.col("text")), " ").alias("tokens"))


def collapse_repeats(spark, sf):
    words = X.collapse_repeats(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    return docs(spark, sf).select("id", F.size(words).cast("long").alias("n"), F.md5(F.array_join(words, " ").cast("binary")).alias("digest"))


def redact_values(spark, sf):
    values = X.redaction_values(F.array("lang", "source", F.lit("the"), F.lit("une"), F.lit("eine")))
    return docs(spark, sf).select("id", F.md5(X.redact(F.col("text"), values).cast("binary")).alias("digest"))


def char_budget(spark, sf):
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("turns"))
    kept = X.budget(F.transform(F.slice("turns", 1, 4), lambda s: X.clean(s["text"])), 180)
    return c.select("conv_id", F.size(kept).cast("long").alias("n"), F.array_join(kept, " | ").alias("snippet"))


def profile_assembly(spark, sf):
    return T.profile(docs(spark, sf)).select("id", F.md5(F.col("profile").cast("binary")).alias("digest"), "tokens")


def tone_tags(spark, sf):
    return T.tone_tags(docs(spark, sf), FORMS)


def sentiment(spark, sf):
    return T.sentiment(docs(spark, sf), ("the", "der"), ("of", "und"))


def tfidf_top_terms(spark, sf):
    w = T.top_terms(T.tfidf(docs(spark, sf), STOP, 5000), "id", 6)
    return w.select("id", "term", fixed(F.col("weight")).alias("weight"), "rank")


def cluster_terms(spark, sf):
    d = docs(spark, sf).withColumn("cluster", F.col("lang"))
    return T.cluster_terms(d, [*lexicon.CLUSTER_STOP, *STOP]).select("cluster", "term", fixed(F.col("weight")).alias("weight"), "rank")


def franchise_terms(spark, sf):
    d = docs(spark, sf)
    return d.groupBy("lang").agg(F.count_if(T.holds_any(F.col("text"))).alias("listed"), F.count_if(T.holds_any(F.col("text"), (*lexicon.FRANCHISE, "token", "licensed"))).alias("more"))


def noise_diagnostics(spark, sf):
    return T.noise_counts(docs(spark, sf), ("token", "mail", "full", "!!", "est"))


NOISE_FREE = r"regexp_replace(regexp_replace(text, 'https?://\S+|www\.\S+', ' ', 'g'), '#\S+', ' ', 'g')"
MARKS = NOISE_FREE
for _m in ("!", r"\?", r"\.", ",", ";", ":"):
    MARKS = f"regexp_replace({MARKS}, '{_m}{{2,}}', '{_m.lstrip(chr(92))}', 'g')"
SPACES = r"[\s\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x0B\x1C-\x1F]+"
CLEAN = f"trim(regexp_replace(text, '{SPACES}', ' ', 'g'))"
TOK = "(case when length({t}) = 0 then 0 else greatest(1, ceil(length({t}) / 4), ceil(len(list_filter(regexp_split_to_array({t}, '\\s+'), lambda w: w <> '')) * 1.35)) end)::bigint"
GRAMS = r"""g as (select id, {c} ws from (select doc_id as id, lang as cluster, list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}\p{{M}}_]{{2,}}'), lambda w: w not in ({stop})) as ws from documents)),
 t as (select id, {c} unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) as term from g), tf as (select id, {c} term, count(*) as tf from t group by all)"""

QUERIES = {
    "clean_text": (digest("clean_text", X.clean), sql_digest(CLEAN)),
    "strip_noise": (digest("strip_noise", X.strip_noise), sql_digest(NOISE_FREE)),
    "collapse_marks": (digest("collapse_marks", lambda c: X.collapse_marks(X.strip_noise(c))), sql_digest(MARKS)),
    "normalized_label": (digest("normalized_label", X.plain_label), sql_digest("trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))")),
    "shorten": (digest("shorten", lambda c: X.shorten(c, 60)), sql_digest(f"case when length({CLEAN}) <= 60 then {CLEAN} else rtrim({CLEAN}[1:59]) || '...' end")),
    "content_hash": (lambda s, d: docs(s, d).select("id", F.sha2("text", 256).alias("hash")), "select doc_id as id, sha256(text) as hash from documents"),
    "token_cost": (token_cost, f"with t as (select source, count(*) as n, sum({TOK.format(t='text')})::bigint as tokens from documents group by 1) select source, n, tokens, {fix('tokens * 0.13::double / 1e6', 9)} as usd from t"),
    "title_tokens": (title_tokens, r"select doc_id as id, coalesce(array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(translate(lower(text), '-‑:', '   '), '\s+'), lambda w: length(w) > 3 and w not in ('the', 'a', 'an', 'of', 'and', 'or', 'part', 'chapter', 'movie')))), ' '), '') as tokens from documents"),
    "collapse_repeats": (collapse_repeats, r"""with w as (select doc_id as id, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') as ws from documents), u as (select id, unnest(ws) as w, generate_subscripts(ws, 1) as pos from w), k as (select *, lower(regexp_replace(w, '[^A-Za-z0-9_]+', '', 'g')) as k from u),
 c as (select *, lag(k) over (partition by id order by pos) as p from k), r as (select *, sum(case when k = p and k <> '' then 0 else 1 end) over (partition by id order by pos) as run from c), n as (select *, row_number() over (partition by id, run order by pos) as n from r)
 select w.id, coalesce(count(pos), 0)::bigint as n, md5(coalesce(string_agg(n.w, ' ' order by pos), '')) as digest from w left join (select * from n where n <= 2 or k = '') n on w.id = n.id group by w.id"""),
    "redact_values": (redact_values, f"""with t as (select doc_id as id, list_reduce(list_prepend(text, list_sort(list_filter(list_distinct([lang, source, 'the', 'une', 'eine']), lambda v: length(v) > 2), 'desc')), lambda t, v: t) as t, text, source from documents)
 select id, md5(nullif(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?i)' || case when length(source) > 4 then source else 'eine' end, '', 'g'), '(?i)' || case when length(source) > 4 then 'eine' else source end, '', 'g'), '(?i)the', '', 'g'), '(?i)une', '', 'g'), '{SPACES}', ' ', 'g')), '')) as digest from t"""),
    "char_budget": (char_budget, f"""with recursive t as (select conv_id, {CLEAN} as s, row_number() over (partition by conv_id order by turn, text) as i from conversations qualify i <= 4),
 r as (select conv_id, 0 as i, 180 as l, [] :: varchar[] as o from (select distinct conv_id from conversations) union all select r.conv_id, r.i + 1, case when r.l > 0 and length(trim(t.s[1:r.l])) > 0 then r.l - length(trim(t.s[1:r.l])) else r.l end, case when r.l > 0 and length(trim(t.s[1:r.l])) > 0 then list_append(r.o, trim(t.s[1:r.l])) else r.o end from r join t on t.conv_id = r.conv_id and t.i = r.i + 1)
 select conv_id, len(o)::bigint as n, coalesce(array_to_string(o, ' | '), '') as snippet from r qualify row_number() over (partition by conv_id order by i desc) = 1"""),
    "profile_assembly": (profile_assembly, f"""with recursive t as (select doc_id as id, unnest(string_split({MARKS}, chr(10))) as s, generate_subscripts(string_split({MARKS}, chr(10)), 1) as i from documents), c as (select id, i, trim(regexp_replace(s, '{SPACES}', ' ', 'g')) as s from t),
 r as (select doc_id as id, 0 as i, 180 as l, []::varchar[] as o from documents union all select r.id, r.i + 1, case when length(trim(c.s[1:r.l])) > 0 then r.l - length(trim(c.s[1:r.l])) else r.l end, case when length(trim(c.s[1:r.l])) > 0 then list_append(r.o, trim(c.s[1:r.l])) else r.o end from r join c on c.id = r.id and c.i = r.i + 1 where r.l > 0),
 k as (select id, o from r qualify row_number() over (partition by id order by i desc) = 1),
 p as (select id, concat_ws(chr(10), case when coalesce(source, '') <> '' then 'Genres: ' || source end, case when coalesce(lang, '') <> '' then 'Keywords: ' || lang end, case when len(o) > 0 then 'Premise: ' || array_to_string(o, '; ') end) as profile from k join documents on id = doc_id)
 select id, md5(profile) as digest, {TOK.format(t='profile')} as tokens from p"""),
    "tone_tags": (tone_tags, "with l(tone, w) as (values " + ", ".join(f"('{t}', '{w}')" for t, ws in FORMS.items() for w in ws) + "), u as (select doc_id as id, unnest(regexp_extract_all(lower(text), '[a-z][a-z''-]+')) as w from documents), s as (select id, tone, count(*) as score from u join l using (w) group by all) select id, tone, score, row_number() over (partition by id order by score desc, tone) as rank from s qualify rank <= 5"),
    "sentiment": (sentiment, "with u as (select doc_id as id, unnest(regexp_extract_all(lower(text), '[a-z][a-z''-]+')) as w from documents), n as (select id, count(*) filter (w in ('the', 'der')) as good, count(*) filter (w in ('of', 'und')) as bad from u where w in ('the', 'der', 'of', 'und') group by 1) select *, case when good >= bad * 2 and good >= 2 then 'admiring' when bad >= good * 2 and bad >= 2 then 'critical' when good > 0 and bad > 0 then 'divided' end as verdict from n"),
    "franchise_terms": (franchise_terms, "with d as (select lang, " + " or ".join(f"contains(lower(text), '{t}')" for t in lexicon.FRANCHISE) + " as hit, lower(text) as low from documents) select lang, count(*) filter (hit) as listed, count(*) filter (hit or contains(low, 'token') or contains(low, 'licensed')) as more from d group by 1"),
    "noise_diagnostics": (noise_diagnostics, "select term, count(*) as n from documents, (values ('token'), ('mail'), ('full'), ('!!'), ('est')) v(term) where contains(lower(text), term) group by 1"),
    "tfidf_top_terms": (tfidf_top_terms, "with " + GRAMS.format(c="", stop="'the', 'of', 'and'") + f""", v as (select term, sum(tf) as a, count(*) as df from tf group by 1 order by a desc, term limit 5000), x as (select id, term, tf * (ln((1 + (select count(*) from documents)) / (1 + df)) + 1) as x from tf join v using (term)), w as (select id, term, x / sqrt(sum(x * x) over (partition by id)) as weight from x)
 select id, term, {fix('weight')} as weight, row_number() over (partition by id order by floor(weight * 1e9 + 0.5) desc, term) as rank from w qualify rank <= 6"""),
    "cluster_terms": (cluster_terms, "with " + GRAMS.format(c="cluster,", stop=", ".join(f"'{w}'" for w in [*lexicon.CLUSTER_STOP, *STOP])) + f""", v as (select cluster, term, df from (select cluster, term, count(*) as df, sum(tf) as a from tf group by cluster, term) qualify row_number() over (partition by cluster order by a desc, term) <= 3000), n as (select lang as cluster, count(*) as n from documents group by 1),
 x as (select id, cluster, term, n, tf * (ln((1 + n) / (1 + df)) + 1) as x from tf join v using (cluster, term) join n using (cluster)), u as (select cluster, term, n, x / sqrt(sum(x * x) over (partition by id)) as u from x), m as (select cluster, term, sum(u) / n as weight from u group by cluster, term, n)
 select cluster, term, {fix('weight')} as weight, row_number() over (partition by cluster order by floor(weight * 1e9 + 0.5) desc, term) as rank from m qualify rank <= 15"""),
}
