"""Hybrid retrieval: BM25, vector and fuzzy channels, rank fusion, scene scores.

Everything that depends on the query is a literal or a row, everything that depends on the corpus stays distributed: BM25 needs
one row of statistics and no shuffle, the fuzzy and vector channels are narrow, and ranks are taken in ranges of scores.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Defaults
from ..functions.scalars import cosine
from ..functions.text import keyword_overlap
from ..sources.shared import settle

DEFAULTS = Defaults()

#: So many terms close to a query, at most, are sent to every task; more meet the postings by an exchange.
CLOSE_TERMS = 1_000_000


# Sparse index


def postings(docs: DataFrame, tokens: str = "tokens") -> DataFrame:
    """id, term, tf."""
    return docs.select("id", F.explode(tokens).alias("term")).groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))


def document_lengths(docs: DataFrame, tokens: str = "tokens") -> DataFrame:
    return docs.select("id", F.size(tokens).alias("dl"))


def document_frequencies(posted: DataFrame) -> DataFrame:
    """term, df."""
    return posted.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def corpus_stats(lengths: DataFrame) -> DataFrame:
    """One row: n, avgdl."""
    return lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))


def idf(n: Column, df: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1)


def _saturation(tf: Column, dl: Column, avgdl: Column, k1: float, b: float) -> Column:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))


def _is(wanted: str):
    return lambda term: term == wanted


def bm25(docs: DataFrame, query: list[str], tokens: str = "tokens", candidates: Column | None = None,
         k1: float = DEFAULTS.bm25_k1, b: float = DEFAULTS.bm25_b) -> DataFrame:
    """id, score of docs with a positive score. Repeated query tokens count repeatedly.

    Term frequencies of the few query terms are counted inside each row; statistics are over all docs, scores only over
    the candidates. The only exchange is that of the one-row statistics.
    """
    terms = Counter(query)
    if not terms:
        return docs.select("id", F.lit(0.0).alias("score")).limit(0)
    names = list(terms)
    columns = ["dl", *(f"tf{i}" for i in range(len(names)))]

    def counts(found: Column) -> Column:
        # No field is nullable: else a filter for null counts would make the tokens once more.
        sizes = [F.size(found), *(F.size(F.filter(found, _is(q))) for q in names)]
        return F.struct(*(F.coalesce(n, F.lit(0)).alias(c) for n, c in zip(sizes, columns, strict=True)))

    # The lambda binds a row's tokens to a name: they are made once, however many terms are counted.
    tokens = F.col(tokens) if isinstance(tokens, str) else tokens
    keep = F.lit(True) if candidates is None else candidates
    none = F.struct(*(F.lit(0).alias(c) for c in columns))
    counted = docs.select("id", keep.alias("keep"), F.coalesce(F.element_at(F.transform(F.array(tokens), counts), 1), none).alias("c"))
    stats = counted.agg(
        F.count(F.lit(1)).alias("n"), F.avg("c.dl").alias("avgdl"), *(F.count_if(F.col(f"c.tf{i}") > 0).alias(f"df{i}") for i in range(len(names)))
    )
    parts = [
        F.lit(float(terms[q])) * idf(F.col("n"), F.col(f"df{i}")) * _saturation(F.col(f"c.tf{i}"), F.col("c.dl"), F.col("avgdl"), k1, b)
        for i, q in enumerate(names)
    ]
    # A term that occurs has a positive part. The filter needs the statistics, so that it is not evaluated twice below the join
    # with their one row.
    score = sum(parts[1:], parts[0])
    return counted.where("keep").crossJoin(F.broadcast(stats)).select("id", score.alias("score")).where("score > 0")


def bm25_indexed(posted: DataFrame, lengths: DataFrame, query: list[str], candidates: DataFrame | None = None,
                 k1: float = DEFAULTS.bm25_k1, b: float = DEFAULTS.bm25_b) -> DataFrame:
    """The same from a stored index: only the query terms' postings are read. candidates: the ids that are scored."""
    terms = Counter(query)
    if not terms:
        return lengths.select("id", F.lit(0.0).alias("score")).limit(0)
    hits = posted.where(F.col("term").isin(*terms))
    weight = F.create_map(*(F.lit(x) for t in terms.items() for x in (t[0], float(t[1]))))
    if candidates is None:
        scored = hits
    else:
        scored = hits.join(candidates.select("id"), "id", "left_semi")
    found = scored.join(F.broadcast(document_frequencies(hits)), "term").join(lengths, "id").crossJoin(F.broadcast(corpus_stats(lengths)))
    part = weight[F.col("term")] * idf(F.col("n"), F.col("df")) * _saturation(F.col("tf"), F.col("dl"), F.col("avgdl"), k1, b)
    return found.groupBy("id").agg(F.sum(part).alias("score"))


def top_terms(frequencies: DataFrame, n: int) -> DataFrame:
    """The n terms of the most documents; ties by term."""
    return frequencies.orderBy(F.desc("df"), "term").limit(n)


# Channels


def closeness(term: Column, query: list[str], distance: int) -> Column:
    """The best 1 / (1 + edit distance) of a term to any query token, within the distance; null if none is."""
    found = []
    for q in dict.fromkeys(query):
        d = F.levenshtein(term, F.lit(q), distance)
        near = F.abs(F.char_length(term) - len(q)) <= distance
        found.append(F.when(near & (d >= 0), 1.0 / (1.0 + d)))
    return F.greatest(*found, F.lit(None).cast("double"))


def fuzzy(docs: DataFrame, query: list[str], tokens: str = "tokens", distance: int = DEFAULTS.fuzzy_distance) -> DataFrame:
    """id, score: the best closeness of any term of the document.

    Terms are compared where they are; only documents with a match are kept, and only their best score is.
    """
    if not query:
        return docs.select("id", F.lit(0.0).alias("score")).limit(0)
    terms = docs.select("id", F.explode(F.array_distinct(tokens)).alias("term"))
    matched = terms.select("id", closeness(F.col("term"), query, distance).alias("score")).where("score > 0")
    return matched.groupBy("id").agg(F.max("score").alias("score"))


def fuzzy_indexed(posted: DataFrame, query: list[str], distance: int = DEFAULTS.fuzzy_distance) -> DataFrame:
    """The same from a stored index: every distinct term is compared once, and only postings of close terms are read."""
    if not query:
        return posted.select("id", F.lit(0.0).alias("score")).limit(0)
    terms = settle(posted.select("term").distinct().select("term", closeness(F.col("term"), query, distance).alias("score")).where("score > 0"))
    if terms.count() <= CLOSE_TERMS:
        terms = F.broadcast(terms)
    return posted.join(terms, "term").groupBy("id").agg(F.max("score").alias("score"))


def vector(vectors: DataFrame, query: list[float]) -> DataFrame:
    """id, score: cosine with the query, positive ones. Vectors of another dimension are left out."""
    q = F.array(*(F.lit(float(x)).cast("float") for x in query))
    sized = vectors.where(F.size("vector") == len(query))
    return sized.select("id", cosine(F.col("vector"), q).alias("score")).where("score > 0")


# Fusion


def ranked(*channels: DataFrame) -> DataFrame:
    """channel, id, score, rank: 1 for the greatest score of a channel, ties by id.

    All rows are range-partitioned by (channel, falling score, id) and sorted there, so that no task sees all of a channel,
    however many scores are equal; a row's place in its range is shifted by the ranges before, one number for each range and channel.
    """
    whole = channels[0].select(F.lit(0).alias("channel"), "id", "score")
    for i, c in enumerate(channels[1:], 1):
        whole = whole.unionAll(c.select(F.lit(i).alias("channel"), "id", "score"))
    order = ["channel", F.desc("score"), "id"]
    # The scores are fixed once (the splitters are sampled from them), then the ranges.
    ranges = settle(whole).repartitionByRange(*order).sortWithinPartitions(*order)
    ranges = settle(ranges.withColumn("place", F.monotonically_increasing_id()))
    ranges = ranges.withColumn("range", F.shiftright("place", 33)).withColumn("place", F.col("place").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = ranges.groupBy("range", "channel").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("channel").orderBy("range")) - F.col("n")
    beside = F.sum("n").over(Window.partitionBy("range").orderBy("channel")) - F.col("n")
    shift = sizes.select("range", "channel", (before - beside).alias("shift"))
    placed = ranges.join(F.broadcast(shift), ["range", "channel"])
    return placed.select("channel", "id", "score", (F.col("place") + F.col("shift") + 1).alias("rank"))


def fuse(channels: list[DataFrame], k: float = DEFAULTS.rrf_k) -> DataFrame:
    """id, rrf: reciprocal ranks summed over channels."""
    return ranked(*channels).groupBy("id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("rrf"))


def topic_scores(rrf: DataFrame, topics: DataFrame, keywords: list[str]) -> DataFrame:
    """topics (id, scene_id, user_ts, keywords) with an rrf entry: score = rrf + keyword overlap."""
    # The overlap is taken where the topics are: a number is exchanged, not the keywords.
    overlaps = topics.select("id", "scene_id", "user_ts", keyword_overlap(F.col("keywords"), keywords).alias("overlap"))
    return overlaps.join(rrf, "id").select("id", "scene_id", "user_ts", (F.col("rrf") + F.col("overlap")).alias("score"))


def scene_scores(scored: DataFrame) -> DataFrame:
    return scored.groupBy("scene_id").agg(F.sum("score").alias("score"))


def with_vector_floor(scenes: DataFrame, best_cosine: DataFrame, threshold: float = DEFAULTS.min_scene_score,
                      least: float = DEFAULTS.vector_min_score) -> DataFrame:
    """Scenes (scene_id, score) lifted to threshold + cosine where a topic's cosine (scene_id, cos) reaches least."""
    floor = best_cosine.where(F.col("cos") >= least).groupBy("scene_id").agg((F.max("cos") + threshold).alias("floor"))
    both = scenes.join(floor, "scene_id", "full")
    return both.select("scene_id", F.greatest(F.coalesce("score", F.lit(0.0)), F.coalesce("floor", F.lit(float("-inf")))).alias("score"))


def with_bonuses(scenes: DataFrame, active: list[int], recent_scene: int | None, bonus: float = DEFAULTS.activation_bonus,
                 recent: float = DEFAULTS.recent_bonus) -> DataFrame:
    """Active scenes gain bonus, else the most recent one gains recent. active holds at most the configured capacity."""
    is_active = F.col("scene_id").isin(*active) if active else F.lit(False)
    is_recent = F.col("scene_id") == recent_scene if recent_scene is not None else F.lit(False)
    gain = F.when(is_active, bonus).when(is_recent, recent).otherwise(0.0)
    return scenes.withColumn("score", F.col("score") + gain)


def latest_scene(topics: DataFrame) -> DataFrame:
    """One row: the scene of the topic of the greatest timestamp."""
    return topics.agg(F.max_by("scene_id", F.struct("user_ts", "id")).alias("scene_id"))


def winner(scenes: DataFrame, threshold: float = DEFAULTS.min_scene_score) -> DataFrame:
    """The best scene above (not at) the threshold; ties to the smaller id. Empty if there is none."""
    return scenes.orderBy(F.desc("score"), "scene_id").limit(1).where(F.col("score") > threshold)


def candidates(topics: DataFrame, l3_id: int | None = None) -> DataFrame:
    """Topics that are searched: depth 1 and 2, with a reference to a graph if one is named."""
    found = topics.where("depth <= 2")
    return found if l3_id is None else found.where(F.array_contains("l3_refs", l3_id))


def retrieve(topics: DataFrame, docs: DataFrame, vectors: DataFrame, query_tokens: list[str], fuzzy_tokens: list[str], keywords: list[str],
             query_vector: list[float] | None, active: list[int], l3_id: int | None = None, config: Defaults = DEFAULTS,
             index: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """All scenes with their scores, before winner(). index: stored postings and lengths, read in place of docs.

    topics: id, scene_id, depth, user_ts, keywords, l3_refs; docs: id, tokens (the whole index); vectors: id, vector. The fuzzy channel
    ranks all indexed documents, so that non-candidates take rank positions, as they should; the others rank candidates.
    """
    eligible = candidates(topics, l3_id)
    ids = eligible.select("id")
    if index:
        channels = [bm25_indexed(*index, query_tokens, ids, config.bm25_k1, config.bm25_b), fuzzy_indexed(index[0], fuzzy_tokens, config.fuzzy_distance)]
    else:
        marked = docs.join(ids.withColumn("is_candidate", F.lit(True)), "id", "left")
        channels = [bm25(marked, query_tokens, candidates=F.col("is_candidate").isNotNull(), k1=config.bm25_k1, b=config.bm25_b)]
        channels.append(fuzzy(docs, fuzzy_tokens, distance=config.fuzzy_distance))
    close = None
    if query_vector is not None:
        close = vector(vectors.join(ids, "id", "left_semi"), query_vector)
        channels.append(close)
    scored = topic_scores(fuse(channels, config.rrf_k), eligible, keywords)
    scenes = scene_scores(scored)
    if close is not None:
        best = close.join(eligible.select("id", "scene_id"), "id").select("scene_id", F.col("score").alias("cos"))
        scenes = with_vector_floor(scenes, best, config.min_scene_score, config.vector_min_score)
    # The most recent scene is one row that joins the scenes.
    recent = latest_scene(eligible).withColumnRenamed("scene_id", "recent_id")
    is_active = F.col("scene_id").isin(*active) if active else F.lit(False)
    gain = F.when(is_active, config.activation_bonus).when(F.col("scene_id") == F.col("recent_id"), config.recent_bonus).otherwise(0.0)
    return scenes.crossJoin(F.broadcast(recent)).select("scene_id", (F.col("score") + gain).alias("score"))
