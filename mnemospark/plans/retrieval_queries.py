"""Queries of the retrieval channels over documents and embeddings, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.scalars import cosine
from ..operators import retrieval as R
from ..sources.shared import settle, spread
from .fixtures import table

QUERY = ["the", "tion", "and", "the", "que"]
FUZZY = ["thoner", "einver", "leque", "the and"]
KEYWORDS = ["The", "and", "Que", "von", "reou"]
ACTIVE = [3, 5]

#: Tokens as other engines get them. Documents hold no Han characters, so that no run is cut into pairs.
TOK = r"""tok as (
  select doc_id as id, regexp_extract_all(lower(regexp_replace(regexp_replace(coalesce(text, ''), '([\p{Ll}\p{Nd}])(\p{Lu})', '\1 \2', 'g'),
         '(\p{Lu})(\p{Lu}\p{Ll})', '\1 \2', 'g')), '[\p{L}\p{Nd}]+') as toks, source from documents)"""
BM25 = f"""{TOK},
st as (select count(*) as n, avg(len(toks)) as avgdl from tok),
q as (select * from (values ('the', 2), ('tion', 1), ('and', 1), ('que', 1)) v(term, mult)),
tf as (select t.id, len(t.toks) as dl, q.term, q.mult, len(list_filter(t.toks, lambda x: x = q.term)) as tf from tok t, q),
df as (select term, count(*) as df from tf where tf > 0 group by term),
bm as (select id, sum(mult * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) as score
       from tf join df using (term), st where tf > 0 group by id)"""
FUZ = """fq as (select * from (values ('thoner'), ('einver'), ('leque'), ('the and')) v(q)),
fz as (select id, max(1.0 / (1 + levenshtein(asc7, q))) as score
       from (select id, term, regexp_replace(term, '[^\x00-\x7F]', '~', 'g') as asc7 from (select id, unnest(list_distinct(toks)) as term from tok)) t, fq
       where abs(length(term) - length(q)) <= 2 and levenshtein(asc7, q) <= 2 group by id)"""
TOPICS = """tp as (
  select id, coalesce(try_cast(substring(source, 4) as bigint), -1) as scene_id, 1 + id % 3 as depth, id * 1000 as user_ts, toks as keywords
  from tok)"""


def _docs(spark, sf):
    return spread(table(spark, sf, "documents").select("doc_id", "text", "source")).select(F.col("doc_id").alias("id"), T.words(F.col("text")).alias("tokens"), "source")


def _topics(docs):
    scene = F.coalesce(F.expr("try_cast(substring(source, 4) as bigint)"), F.lit(-1))
    return docs.select(
        "id", scene.alias("scene_id"), (1 + F.col("id") % 3).alias("depth"), (F.col("id") * 1000).alias("user_ts"), F.col("tokens").alias("keywords")
    )


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("scene_id"), F.col("embedding").alias("vector"))


def _query_vector(spark, sf):
    row = table(spark, sf, "embeddings").where("vec_id = 0").select("embedding").first()
    return list(row[0]) if row else [0.0]


def tokenise(spark, sf):
    docs = table(spark, sf, "documents")
    plain, kept = T.words(F.col("text")), T.tokens(F.col("text"))
    return docs.select("doc_id", F.size(plain).alias("n_words"), F.md5(F.array_join(plain, " ")).alias("words_md5"), F.size(kept).alias("n_tokens"))


def bigrams(spark, sf):
    return _docs(spark, sf).select("id", F.md5(F.array_join(T.with_bigrams(F.col("tokens")), "|")).alias("joined_md5"))


def corpus_stats(spark, sf):
    return R.corpus_stats(R.document_lengths(_docs(spark, sf))).select("n", F.round("avgdl", 6).alias("avgdl"))


def document_frequencies(spark, sf):
    return R.document_frequencies(R.postings(_docs(spark, sf)))


def top_terms(spark, sf):
    return R.top_terms(document_frequencies(spark, sf), 20)


def bm25_search(spark, sf):
    return R.bm25(_docs(spark, sf), QUERY).select("id", F.round("score", 6).alias("score"))


def bm25_indexed(spark, sf):
    docs = settle(_docs(spark, sf).select("id", "tokens"))  # tokens are made once for postings and lengths, each read twice
    return R.bm25_indexed(R.postings(docs), R.document_lengths(docs), QUERY).select("id", F.round("score", 6).alias("score"))


def fuzzy_indexed(spark, sf):
    return R.fuzzy_indexed(R.postings(_docs(spark, sf)), FUZZY).select("id", F.round("score", 6).alias("score"))


def scene_retrieval_indexed(spark, sf):
    """scene_retrieval from a stored index: tokens are made once, each channel reads its postings."""
    docs = settle(_docs(spark, sf))  # tokens are made once for all channels
    topics = _topics(docs).withColumn("l3_refs", F.array().cast("array<bigint>"))
    index = (settle(R.postings(docs)), settle(R.document_lengths(docs)))
    found = R.retrieve(topics, docs, _vectors(spark, sf).select("id", "vector"), QUERY, FUZZY, KEYWORDS, _query_vector(spark, sf), ACTIVE, index=index)
    return found.select("scene_id", F.round("score", 5).alias("score"))


def bm25_topk(spark, sf):
    return R.bm25(_docs(spark, sf), QUERY).select("id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "id").limit(10)


def fuzzy_search(spark, sf):
    return R.fuzzy(_docs(spark, sf), FUZZY).select("id", F.round("score", 6).alias("score"))


def vector_search(spark, sf):
    return R.vector(_vectors(spark, sf), _query_vector(spark, sf)).select("id", F.round("score", 6).alias("score"))


def cosine_neighbours(spark, sf):
    """The nearest vector of each label to the query vector: a join-free top-1 by group."""
    q = F.array(*(F.lit(float(x)).cast("float") for x in _query_vector(spark, sf)))
    scored = _vectors(spark, sf).where("id <> 0").select("scene_id", "id", F.round(cosine(F.col("vector"), q), 6).alias("score"))
    best = scored.groupBy("scene_id").agg(F.max(F.struct("score", (-F.col("id")).alias("i"))).alias("b"))
    return best.select("scene_id", (-F.col("b.i")).alias("id"), F.col("b.score").alias("score"))


def rrf_fusion(spark, sf):
    docs = settle(_docs(spark, sf).select("id", "tokens"))
    rounded = [c.withColumn("score", F.round("score", 6)) for c in (R.bm25(docs, QUERY), R.fuzzy(docs, FUZZY))]
    return R.fuse(rounded).select("id", F.round("rrf", 8).alias("rrf"))


def keyword_overlap(spark, sf):
    topics = _topics(_docs(spark, sf))
    return topics.select("id", F.round(T.keyword_overlap(F.col("keywords"), KEYWORDS), 6).alias("overlap"))


def scene_retrieval(spark, sf):
    """All scenes with their scores: channels, fusion, floor and bonuses together."""
    docs = settle(_docs(spark, sf))  # tokens are made once for all channels
    topics = _topics(docs).withColumn("l3_refs", F.array().cast("array<bigint>"))
    found = R.retrieve(topics, docs.select("id", "tokens"), _vectors(spark, sf).select("id", "vector"), QUERY, FUZZY, KEYWORDS, _query_vector(spark, sf), ACTIVE)
    return found.select("scene_id", F.round("score", 5).alias("score"))


def scene_retrieval_by_reference(spark, sf):
    """The same among topics that refer to one graph: the fuzzy channel still ranks every document."""
    docs = settle(_docs(spark, sf))  # tokens are made once for all channels
    topics = _topics(docs).withColumn("l3_refs", F.array(F.col("id") % 4))
    found = R.retrieve(topics, docs.select("id", "tokens"), _vectors(spark, sf).select("id", "vector"), QUERY, FUZZY, KEYWORDS, None, ACTIVE, l3_id=1)
    return found.select("scene_id", F.round("score", 5).alias("score"))


def retrieve_scene(spark, sf):
    """The winning scene."""
    return R.winner(scene_retrieval(spark, sf))


def latest_scene(spark, sf):
    return R.latest_scene(R.candidates(_topics(_docs(spark, sf)))).select("scene_id")


def entity_hit(spark, sf):
    """Share of a benchmark item's tokens that its namesake document holds."""
    items = table(spark, sf, "benchmark").select("item_id", F.col("text").alias("answer"))
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("item_id"), "text")
    return items.join(docs, "item_id").select("item_id", F.round(T.entity_hit(F.col("answer"), F.col("text")), 6).alias("hit"))


def recall_summary(spark, sf):
    """Mean, and nearest-rank percentiles, of the entity hits."""
    return entity_hit(spark, sf).agg(
        F.round(F.avg("hit"), 6).alias("mean"), F.min("hit").alias("least"), F.expr("percentile_disc(0.5) within group (order by hit)").alias("p50"),
        F.expr("percentile_disc(0.95) within group (order by hit)").alias("p95"), F.max("hit").alias("most"),
    )


_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
_HIT = r"""hit as (
  select item_id, round(len(list_filter(w, lambda t: contains(lower(d.text), t)))::double / nullif(len(w), 0), 6) as hit
  from (select item_id, list_distinct(regexp_extract_all(lower(text), '\p{Nd}+|\p{L}{3,}')) as w from benchmark) b
  join documents d on d.doc_id = b.item_id)"""
_VEC = """vq as (select embedding as q from embeddings where vec_id = 0),
vc as (select vec_id as id, label, list_cosine_similarity(embedding::double[], q::double[]) as score from embeddings, vq)"""
_SCENES = f"""with {BM25}, {FUZ}, {TOPICS}, {_VEC},
el as (select * from tp where depth <= 2),
ch as (select 1 as c, id, score from bm where id in (select id from el) union all select 2, id, score from fz
       union all select 3, id, score from vc where score > 0 and id in (select id from el)),
rk as (select id, 1.0 / (60 + row_number() over (partition by c order by score desc, id)) as part from ch),
rrf as (select id, sum(part) as rrf from rk group by id),
kw as (select ['the', 'and', 'que', 'von', 'reou'] as q),
sc as (select scene_id, sum(rrf + len(list_intersect(list_distinct(keywords), q))::double / 5) as score from rrf join el using (id), kw group by scene_id),
fl as (select scene_id, max(score) + 1.0 as floor from vc join el using (id) where score >= 0.5 group by scene_id),
bo as (select coalesce(sc.scene_id, fl.scene_id) as scene_id, greatest(coalesce(score, 0), coalesce(floor, -1e308)) as score
       from sc full join fl on sc.scene_id = fl.scene_id),
re as (select arg_max(scene_id, user_ts) as recent from el),
fin as (select scene_id, round(score + case when scene_id in (3, 5) then 0.2 when scene_id = recent then 0.1 else 0 end, 5) as score from bo, re)
"""

_BY_REF = f"""with {BM25}, {FUZ}, {TOPICS},
el as (select * from tp where depth <= 2 and id % 4 = 1),
ch as (select 1 as c, id, score from bm where id in (select id from el) union all select 2, id, score from fz),
rk as (select id, 1.0 / (60 + row_number() over (partition by c order by score desc, id)) as part from ch),
rrf as (select id, sum(part) as rrf from rk group by id),
kw as (select ['the', 'and', 'que', 'von', 'reou'] as q),
sc as (select scene_id, sum(rrf + len(list_intersect(list_distinct(keywords), q))::double / 5) as score from rrf join el using (id), kw group by scene_id),
re as (select arg_max(scene_id, user_ts) as recent from el)
select scene_id, round(score + case when scene_id in (3, 5) then 0.2 when scene_id = recent then 0.1 else 0 end, 5) as score from sc, re"""

QUERIES = {
    "tokenise": (tokenise, f"with {TOK} select id as doc_id, len(toks) as n_words, md5(array_to_string(toks, ' ')) as words_md5,"
                           f" len(list_filter(toks, lambda w: w not in ({_STOP}))) as n_tokens from tok"),
    "bigrams": (bigrams, f"with {TOK} select id, md5(array_to_string(toks || list_transform(range(1, greatest(len(toks), 1)), lambda i: toks[i] || ' ' || toks[i+1]), '|')) as joined_md5 from tok"),
    "corpus_stats": (corpus_stats, f"with {TOK} select count(*) as n, round(avg(len(toks)), 6) as avgdl from tok"),
    "document_frequencies": (document_frequencies, f"with {TOK} select term, count(*) as df from (select id, unnest(list_distinct(toks)) as term from tok) group by term"),
    "top_terms": (top_terms, f"with {TOK} select term, count(*) as df from (select id, unnest(list_distinct(toks)) as term from tok) group by term order by df desc, term limit 20"),
    "bm25_search": (bm25_search, f"with {BM25} select id, round(score, 6) as score from bm"),
    "bm25_indexed": (bm25_indexed, f"with {BM25} select id, round(score, 6) as score from bm"),
    "bm25_topk": (bm25_topk, f"with {BM25} select id, round(score, 6) as score from bm order by score desc, id limit 10"),
    "fuzzy_search": (fuzzy_search, f"with {TOK}, {FUZ} select id, round(score, 6) as score from fz"),
    "fuzzy_indexed": (fuzzy_indexed, f"with {TOK}, {FUZ} select id, round(score, 6) as score from fz"),
    "scene_retrieval_indexed": (scene_retrieval_indexed, _SCENES + "select scene_id, score from fin"),
    "vector_search": (vector_search, f"with {_VEC} select id, round(score, 6) as score from vc where score > 0"),
    "cosine_neighbours": (cosine_neighbours, f"with {_VEC}, r as (select *, round(score, 6) as s from vc where id <> 0),"
                          " o as (select *, row_number() over (partition by label order by s desc, id) as k from r) select label as scene_id, id, s as score from o where k = 1"),
    "rrf_fusion": (rrf_fusion, f"with {BM25}, {FUZ}, ch as (select 1 as c, id, round(score, 6) as score from bm union all select 2, id, round(score, 6) from fz),"
                   " rk as (select id, 1.0::double / (60 + row_number() over (partition by c order by score desc, id)) as part from ch)"
                   " select id, round(sum(part), 8) as rrf from rk group by id"),
    "keyword_overlap": (keyword_overlap, f"with {TOK}, {TOPICS} select id, round(len(list_intersect(list_distinct(keywords), ['the', 'and', 'que', 'von', 'reou']))::double / 5, 6) as overlap from tp"),
    "scene_retrieval": (scene_retrieval, _SCENES + "select scene_id, score from fin"),
    "scene_retrieval_by_reference": (scene_retrieval_by_reference, _BY_REF),
    "retrieve_scene": (retrieve_scene, _SCENES + "select scene_id, score from fin where score > 1 order by score desc, scene_id limit 1"),
    "latest_scene": (latest_scene, f"with {TOK}, {TOPICS} select arg_max(scene_id, user_ts) as scene_id from tp where depth <= 2"),
    "entity_hit": (entity_hit, f"with {_HIT} select item_id, hit from hit"),
    "recall_summary": (recall_summary, f"with {_HIT} select round(avg(hit), 6) as mean, min(hit) as least, quantile_disc(hit, 0.5) as p50, quantile_disc(hit, 0.95) as p95, max(hit) as most from hit"),
}
