"""The pipeline against what its stages must do, and its registration."""

import collections
import re

import public_tokenizers
import tokenizers
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from mnemospark.llm import exact_dedup

from .test_operators import brute_components


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir).cache()
        kept[name] = out
        if name != "bpe":
            assert out.columns == columns
            docs = out
    start = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert kept["language_id"].count() >= 0.98 * start.count()
    assert exact_dedup.groups(kept["exact_dedup"]).where("group_size > 1").count() == 0
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", "", t or "")
    best = {}
    for r in kept["language_id"].collect():
        key = (-len(r["text"] or ""), r["doc_id"])
        best[norm(r["text"])] = min(best.get(norm(r["text"]), key), key)
    assert sorted(r["doc_id"] for r in kept["exact_dedup"].select("doc_id").collect()) == sorted(i for _, i in best.values())
    rows = [(r["doc_id"], r["text"]) for r in kept["exact_dedup"].collect()]
    _, roots = brute_components(rows, 5)
    assert {r["doc_id"] for r in kept["near_dedup"].select("doc_id").collect()} == set(roots.values())
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))
    had, has = (
        {r["source"]: r["n"] for r in kept[s].groupBy("source").agg(F.sum(words).alias("n")).collect()} for s in ("near_dedup", "mixing")
    )
    weight = {s: i % 3 + 1 for i, s in enumerate(sorted(had))}
    assert all(has[s] <= 3.2 * had[s] + 600 for s in has) and sum(has.values()) > 0.8 * sum(had.values())
    open_ = [s for s in had if has[s] < 2.5 * had[s]]
    ratios = [has[s] / weight[s] for s in open_]
    assert max(ratios) < 2.5 * min(ratios)
    real = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {r["doc_id"]: r["text"] for r in kept["mixing"].collect()}
    for r in kept["bpe"].collect():
        ids = real.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["token_ids"] == ids and r["n_tokens"] == len(ids) and r["decoded"] == real.decode(ids, skip_special_tokens=False)
    assert kept["bpe"].count() == kept["mixing"].count() and kept["bpe"].where("n_tokens = 0").count() == 0


def test_hard_rows(spark, hard, empty, clashing, tmp_path):
    """Nulls, repeated rows, very long texts, no rows at all, and columns with names that the stages use themselves."""
    for name, docs in (("hard", hard), ("empty", empty), ("clashing", clashing)):
        docs.write.parquet(f"file://{tmp_path}/{name}/documents.parquet")
        found = corpus_pipeline.run(spark, f"file://{tmp_path}/{name}").cache()
        carried = [c for c in docs.columns if c not in ("text", "token_ids")]
        assert found.columns == [*carried, "n_tokens", "token_ids", "decoded"]
        ids = {r["doc_id"] for r in found.select("doc_id").collect()}
        if name == "empty":
            assert not ids
        else:
            # The longest of the copies stays (3), nothing without a letter does, and of the near copies one.
            assert not ids & {1, 2, 6, 7, 8, 12, 14} and len(ids & {3, 4, 5}) <= 1 and {3, 10} & ids
            assert found.where("n_tokens = 0").count() == 0


def test_run_and_registration(spark, sf_dir):
    names = collections.Counter(n.split("_")[0] for n in __spark_entry__.queries() if n.startswith("op"))
    assert names == {f"op{i}": 1 for i in range(1, 11)} and "pipeline" in __spark_entry__.queries()
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
