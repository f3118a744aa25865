"""The queries of the training-data operators and, where SQL can express them, their twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seismark.llm import decontamination, hard_negatives, jaccard_join, language_id, license_scan, packing, perplexity, quality_rules, ranked_search, simhash_join, substring_dedup, token_store, url_filter
from seismark.llm.registry import query, table


@query("op3_packing")
def packing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.word_lengths(table(spark, sf_dir, "documents")))


@query("op4_language_id")
def language_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = language_id.held_out()
    model = language_id.train(docs.where(~out))
    return language_id.identify(docs, model).select("doc_id", out.alias("held_out"), "lang_pred", "score")


@query("op5_token_store")
def token_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.token_digest(table(spark, sf_dir, "documents"), token_store.public_tokenizer("byte_bpe_50k.json"))


@query("op6_url_filter")
def url_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = url_filter.train(url_filter.labelled_urls(spark))
    return url_filter.judge(table(spark, sf_dir, "pages"), model)


@query("op7_quality_rules")
def rules_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    trees = quality_rules.train(docs, table(spark, sf_dir, "labels"))
    return quality_rules.judge(docs.select("doc_id", "text"), trees).drop("text")


OP1_SQL = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
win as (select doc_id, s, array_to_string(list_slice(w, s + 1, s + 20), ' ') as k from (select doc_id, w, unnest(range(len(w) - 19)) as s from d where len(w) >= 20)),
firsts as (select k, min({'d': doc_id, 's': s}) as f from win group by k having count(*) > 1),
gone as (select doc_id, list(distinct p) as p from (select doc_id, unnest(range(s, s + 20)) as p from win join firsts using (k) where f <> {'d': doc_id, 's': s}) group by doc_id),
kept as (select d.doc_id, w, p, list_filter(range(len(w)), lambda i: not list_contains(coalesce(p, []), i)) as stay from d left join gone using (doc_id))
select doc_id, len(w)::bigint as n_words, coalesce(len(p), 0)::bigint as n_removed, sha256(array_to_string(list_transform(stay, lambda i: w[i + 1]), ' ')) as kept_sha256 from kept"""


@query("op1_substring_dedup", OP1_SQL)
def substring_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP10_SQL = r"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') as w from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') as w from benchmark where item_id is not null),
iw as (select distinct item_id, least(len(w), 10) as l, array_to_string(list_slice(w, s + 1, s + 10), ' ') as k
  from (select item_id, w, unnest(range(greatest(len(w) - 10, 0) + 1)) as s from b where len(w) > 0)),
dw as (select doc_id, s, l, array_to_string(list_slice(w, s + 1, s + l), ' ') as k from
  (select doc_id, w, l, unnest(range(len(w) - l + 1)) as s from d, (select distinct l from iw) where len(w) >= l)),
hits as (select doc_id, s, dw.l as l, item_id from dw join iw on dw.l = iw.l and dw.k = iw.k),
cover as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(s, s + l)) as p from hits) group by doc_id),
its as (select doc_id, count(*) as n_items, string_agg(i, ',' order by i) as names from (select distinct doc_id, item_id::varchar as i from hits) group by doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(names, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 as contaminated from d left join cover using (doc_id) left join its using (doc_id)"""


@query("op10_decontamination", OP10_SQL)
def decontamination_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontamination.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


@query("op10_proximity")
def proximity_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op10_decontamination and n_near; on its own, as the twin of that query has the exact columns only."""
    out = decontamination.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), near=True)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated", "n_near")


OP2_SQL = r"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
sh as (select distinct doc_id, array_to_string(list_slice(w, s + 1, s + 5), ' ') as k from (select doc_id, w, unnest(range(greatest(len(w) - 5, 0) + 1)) as s from d where len(w) > 0)),
n as (select doc_id, count(*) as n from sh group by doc_id),
pairs as (select x.doc_id as a, y.doc_id as b, count(*) as c from sh x join sh y on x.k = y.k and x.doc_id <> y.doc_id group by all),
links as (select a, b from pairs join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * c >= 75 * (na.n + nb.n - c)),
reach as (select doc_id as a, doc_id as b from d union select reach.a, links.b from reach join links on reach.b = links.a)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, component_id from d left join n using (doc_id) join (select a as doc_id, min(b) as component_id from reach group by a) using (doc_id)"""


@query("op2_jaccard_join", OP2_SQL)
def jaccard_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.groups(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@query("op8_perplexity")
def perplexity_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op9_license_scan")
def license_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.summary(table(spark, sf_dir, "documents"))


@query("op12_simhash_join")
def simhash_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No twin: DuckDB has no XXH64 with a seed; tests compare with all pairs."""
    out = simhash_join.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", simhash_join.digits().alias("fingerprint"), "component_id")


OP13_SQL = """
with r as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as anchor_id, b.vec_id as id, a.label = b.label as same, list_inner_product(a.v, b.v)::bigint as score from r a join r b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
p as (select anchor_id, id as positive_id, score as positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, id) <= 5)
select anchor_id, positive_id, (row_number() over w)::integer as rank, id as negative_id, positive_score, score as negative_score from p join s using (anchor_id)
  where not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score
  window w as (partition by anchor_id, positive_id order by score desc, id) qualify row_number() over w <= 10"""


@query("op13_hard_negatives", OP13_SQL)
def negatives_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(hard_negatives.prepared(table(spark, sf_dir, "embeddings")), F.col("kid") % 100 == 0)


OP11_SQL = r"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') as t from documents),
q as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') as t from benchmark),
c as (select count(*)::bigint as n, sum(len(t))::bigint as l from d where len(t) > 0),
qt as (select item_id, term, count(*) as times from (select item_id, unnest(t) as term from q) group by all),
tf as (select doc_id, term, count(*) as tf, any_value(m) as m from (select doc_id, unnest(t) as term, 75 + (25 * len(t) * n) // l as m from d, c where len(t) > 0) where term in (select term from qt) group by all),
w as (select term, floor(1000 * ln((2 * n + 2)::double / (2 * count(*) + 1)::double))::bigint as w from tf, c group by term, n),
s as (select item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::bigint as score from qt join w using (term) join tf using (term) group by all)
select item_id, (row_number() over (partition by item_id order by score desc, doc_id))::integer as rank, doc_id, score from s where score > 0
qualify row_number() over (partition by item_id order by score desc, doc_id) <= 20"""


@query("op11_ranked_search", OP11_SQL)
def search_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
