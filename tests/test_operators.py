"""Golden numbers of single operators, worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from mnemospark import errors
from mnemospark.config import Defaults, validate_dim, validate_tenant
from mnemospark.functions import scalars as S
from mnemospark.functions import text as T
from mnemospark.operators import graph as G
from mnemospark.operators import layers as L
from mnemospark.operators import lifecycle as C
from mnemospark.operators import retrieval as R
from mnemospark.plans import catalog
from mnemospark.plans.fixtures import table, view
from mnemospark.sources import shared


def one(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize(
    "text, members",
    [
        ("fetchUserData", ["fetch", "user", "data"]), ("JSONParser", ["json", "parser"]), ("getUserID", ["get", "user", "id"]),
        ("api_key", ["api", "key"]), ("err_0x3f01", ["err", "0x3f01"]), ("", []), ("!!! ...", []),
    ],
)
def test_words(spark, text, members):
    assert one(spark, T.words(F.lit(text))) == members


def test_words_of_han_and_null(spark):
    assert one(spark, T.words(F.lit("学习Rust语言"))) == ["学习", "rust", "语言"]
    assert one(spark, T.words(F.lit("向量数据库"))) == ["向量", "量数", "数据", "据库"]
    assert one(spark, T.words(F.lit(None).cast("string"))) == []
    assert one(spark, T.tokens(F.lit("the cat and the dog"))) == ["cat", "dog"]


def test_camel_trim_and_cuts(spark):
    assert one(spark, T.split_camel_lower(F.lit("JSONParser"))) == ["json", "parser"]
    assert one(spark, T.split_camel_lower(F.lit("api_Key"))) == ["api_Key"]
    assert one(spark, T.trim_punctuation(F.lit("(hello_!)"))) == "hello_"
    for text, n, wanted in [("äöü", 5, "äö"), ("abc", 5, "abc"), ("a€b", 3, "a"), ("a€b", 4, "a€"), ("😀x", 3, "")]:
        assert one(spark, T.first_bytes(F.lit(text), n)) == wanted, (text, n)


def test_bm25_of_one_document(spark):
    docs = spark.createDataFrame([(1, ["machine", "learning"])], "id long, tokens array<string>")
    score = R.bm25(docs, ["machine"]).first()["score"]
    assert score == pytest.approx(math.log(0.5 / 1.5 + 1) * 2.2 / 2.2, abs=1e-9) and round(score, 3) == 0.288
    both = R.bm25_indexed(R.postings(docs), R.document_lengths(docs), ["machine", "machine"]).first()["score"]
    assert both == pytest.approx(2 * score)
    assert R.bm25(docs, []).count() == 0 and R.bm25(docs, ["absent"]).count() == 0


def test_cosine(spark):
    v = lambda *x: F.array(*(F.lit(float(i)).cast("float") for i in x))
    for a, b, wanted in [((1, 0), (1, 0), 1), ((1, 0), (0, 1), 0), ((1, 0), (-1, 0), -1), ((0, 0), (1, 0), 0), ((1,), (1, 0), 0)]:
        assert one(spark, S.cosine(v(*a), v(*b))) == pytest.approx(wanted)


def test_edit_distance_and_fuzzy(spark):
    assert one(spark, F.levenshtein(F.lit("kitten"), F.lit("sitting"))) == 3
    docs = spark.createDataFrame([(1, ["rust", "cook"]), (2, ["trust"]), (3, ["python"])], "id long, tokens array<string>")
    assert {r["id"]: r["score"] for r in R.fuzzy(docs, ["rust"]).collect()} == {1: 1.0, 2: 0.5}


def test_overlap(spark):
    k = F.array(F.lit("Rust"), F.lit("memory"), F.lit("rust"))
    assert one(spark, T.keyword_overlap(k, ["rust", "Memory", "graph"])) == pytest.approx(2 / 3)
    assert one(spark, T.keyword_overlap(k, [])) == 0


def test_ranks_are_exact_with_ties(spark):
    rows = [(i, float(i % 7)) for i in range(500)]
    ranks = {r["id"]: r["rank"] for r in R.ranked(spark.createDataFrame(rows, "id long, score double")).collect()}
    wanted = {i: k + 1 for k, (i, _) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])))}
    assert ranks == wanted


def test_scene_scores(spark):
    # Two channels rank the only topic first, its keywords match fully, its scene is active: 1 + 2/61 + 0.2.
    topics = spark.createDataFrame([(1, 10, 1, 100, ["rust"], [])], "id long, scene_id long, depth int, user_ts long, keywords array<string>, l3_refs array<long>")
    docs = spark.createDataFrame([(1, ["rust"])], "id long, tokens array<string>")
    vectors = spark.createDataFrame([], "id long, vector array<float>")
    scene = R.retrieve(topics, docs, vectors, ["rust"], ["rust"], ["rust"], None, [10]).first()
    assert scene["score"] == pytest.approx(1 + 2 / 61 + 0.2)
    assert R.winner(R.retrieve(topics, docs, vectors, ["rust"], ["rust"], ["rust"], None, [])).first()["score"] == pytest.approx(1 + 2 / 61 + 0.1)
    # The threshold is strict.
    assert R.winner(spark.createDataFrame([(1, 1.0)], "scene_id long, score double")).count() == 0
    floor = R.with_vector_floor(spark.createDataFrame([(1, 0.05)], "scene_id long, score double"), spark.createDataFrame([(1, 0.6), (2, 0.4)], "scene_id long, cos double"))
    assert [(r[0], round(r[1], 6)) for r in floor.collect()] == [(1, 1.6)]


def _graph(spark):
    nodes = spark.createDataFrame([(i, 7, t) for i, t in enumerate("ABCD")] + [(9, 8, "X")], "id long, graph_id long, title string")
    edges = spark.createDataFrame([(1, 7, 0, [0, 1]), (2, 7, 1, [1, 2]), (3, 7, 1, [2, 3]), (4, 7, 5, [])], "id long, graph_id long, kind int, node_ids array<long>")
    return nodes, edges


@pytest.mark.parametrize("depth, kinds, n, m", [(1, None, 2, 2), (2, None, 3, 3), (3, None, 4, 4), (0, None, 2, 2), (3, [0], 2, 1)])
def test_subgraph(spark, depth, kinds, n, m):
    nodes, edges = _graph(spark)
    found, inside = G.subgraph(nodes, edges, 7, 0, depth, kinds)
    assert (found.count(), inside.count()) == (n, m)


def test_subgraph_errors_and_hyperedges(spark):
    nodes, edges = _graph(spark)
    for start, code in ((99, errors.NOT_FOUND), (9, errors.INVALID_QUERY)):
        with pytest.raises(errors.MemoryError_) as e:
            G.subgraph(nodes, edges, 7, start, 1)
        assert errors.code_of(e.value) == code
    member = spark.createDataFrame([(1, 0, n) for n in (1, 2, 3)], "edge_id long, kind int, node_id long")
    assert G.adjacency(member).count() == 6
    assert {r["node_id"]: r["depth"] for r in G.breadth_first(member, spark.range(1, 2).toDF("node_id"), 1).collect()} == {1: 0, 2: 1, 3: 1}
    kept, dead = G.without_nodes(spark.createDataFrame([(1, [1, 2, 3]), (2, [1, 2])], "id long, node_ids array<long>"), spark.range(2, 3).toDF("node_id"))
    assert [r["node_ids"] for r in kept.collect()] == [[1, 3]] and [r["id"] for r in dead.collect()] == [2]


def test_decay(spark):
    hour = 3_600_000
    nodes = spark.createDataFrame([(1, 1.0, 0.0, 0.0, 0), (2, 1.0, 0.9, 0.9, 0), (3, 0.06, 0.0, 0.0, 0), (4, 0.2, 0.0, 0.0, 0)],
                                  "id long, importance double, valence double, arousal double, updated_at long")
    found = {r["id"]: (round(r["new_importance"], 6), r["fate"]) for r in C.decay_nodes(nodes, F.lit(50 * hour)).collect()}
    assert found == {1: (round(math.exp(-0.5), 6), "kept"), 2: (1.0, "kept"), 3: (round(0.06 * math.exp(-0.5), 6), "removed"), 4: (round(0.2 * math.exp(-0.5), 6), "pruned")}


def test_merges(spark):
    merge = lambda a, b: one(spark, L.merge_content(F.lit(a), F.lit(b)))
    assert (merge("ab", ""), merge("ab", "b"), merge("b", "ab"), merge("a", "b")) == ("ab", "ab", "ab", "a\nb")
    with pytest.raises(errors.MemoryError_):
        L.merge_scenes(spark.range(1), 1, [1])
    with pytest.raises(errors.MemoryError_):
        L.import_nodes(spark.range(1), spark.range(1), "other")
    active: list[int] = []
    for s in (1, 2, 3, 2, 4):
        active = L.active_scenes(active, s, 3)
    assert active == [2, 3, 4]


def test_scalars(spark):
    for value in (0, 1, -1, 1 << 62, -(1 << 63)):
        text = one(spark, S.to_hex(F.lit(value).cast("long")))
        assert text == S.format_id(value) and S.parse_id(text) == value and one(spark, S.from_hex(F.lit(text))) == value
    with pytest.raises(errors.MemoryError_):
        S.parse_id("12")
    assert one(spark, S.strip_fences(F.lit("```json\n{\"a\": 1}\n```"))) == '{"a": 1}'
    assert one(spark, S.clamp(F.lit(float("nan")), -1, 1)) == 0
    assert one(spark, S.flexible_id(F.lit("00000000000000ff"))) == 255 or one(spark, S.flexible_id(F.lit("00000000000000FF"))) == 255


def test_configuration():
    assert Defaults().validate().capacity == 7
    for bad in (lambda: Defaults(rrf_k=-1).validate(), lambda: validate_dim(0), lambda: validate_tenant("a/b"), lambda: Defaults(tokenizer_engine="x").validate()):
        with pytest.raises(errors.MemoryError_):
            bad()


def test_edge_members_are_dealt_by_their_number(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(shared, "ROWS_A_TASK", 500)
    member = view(spark, sf_dir, "v_edge_member")
    # One join and one distinct, both in the tasks that the tables were dealt to.
    assert member.rdd.getNumPartitions() >= table(spark, sf_dir, "lineitem").count() / 500
    assert member.groupBy("edge_id").count().rdd.getNumPartitions() == member.rdd.getNumPartitions()


def test_adjacency_of_repeated_pairs(spark, monkeypatch):
    monkeypatch.setattr(shared, "ROWS_A_TASK", 20)
    edges = {e: [1, 2, e % 5 + 3, e % 7 + 3] for e in range(60)} | {60: [9], 61: [1, None]}
    member = spark.createDataFrame([(e, 0, n) for e, ns in edges.items() for n in ns], "edge_id long, kind int, node_id long")
    found = G.adjacency(member)
    wanted = {(a, b) for ns in edges.values() for a in ns for b in ns if a is not None and b is not None and a != b}
    assert sorted(map(tuple, found.collect())) == sorted(wanted)
    assert found.rdd.getNumPartitions() >= 60 * 3 / 20


def test_indexed_search_makes_tokens_once(spark, sf_dir):
    # Postings and lengths come from the settled tokens: the query that is left reads no documents.
    assert not catalog.queries()["bm25_indexed"](spark, sf_dir).inputFiles()
