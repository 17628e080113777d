"""The training-data operators against brute force on rows of every difficult kind."""

import collections
import hashlib
import html
import math
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
import tokenizers
from pyspark.sql import functions as F

from mnemospark.llm import bpe, exact_dedup, fingerprints, html_extract, language_id, lm_score, minhash, mixing, repeats, warc
from mnemospark.llm.common import ship

from .conftest import hard_rows, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)


def table(frame):
    return [r.asDict() for r in frame.collect()]


# 1


def test_bpe_is_exact(hard, empty, clashing):
    path = public_tokenizers.path("word_bpe_49k.json")
    real = tokenizers.Tokenizer.from_file(path)
    found = collections.Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in table(bpe.encode(hard.select("doc_id", "text"), path, digests=True)))
    wanted = collections.Counter()
    for i, text, *_ in hard_rows():
        ids = real.encode(text or "", add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        wanted[i, len(ids), sha(" ".join(map(str, ids))), sha(real.decode(ids, skip_special_tokens=False))] += 1
    assert found == wanted
    assert bpe.encode(empty, path).count() == 0
    plain = bpe.encode(clashing, path, decoded_col="decoded")
    assert plain.columns == [*(c for c in clashing.columns if c != "token_ids"), "token_ids", "decoded"] and plain.count() == len(hard_rows())


def test_bpe_of_odd_texts():
    path = public_tokenizers.path("word_bpe_49k.json")
    real, mine = tokenizers.Tokenizer.from_file(path), bpe.Tokenizer(open(path, "rb").read())
    for text in ["It'll do's <|endoftext|>x<|startoftext|>", "ΑΣ Σίσυφος İ ſ ß", "a\x1cb\x85c d", "aaaa" * 200, "日本語 😀é ½", "<|endof", "x" * 3000]:
        e = real.encode(text, add_special_tokens=False)
        ids = mine.encode(text)
        assert list(ids) == e.ids and mine.shown(ids) == " ".join(map(str, e.ids)) and mine.decode(ids).decode() == real.decode(e.ids, skip_special_tokens=False)


# 2


def test_exact_groups(spark, hard, empty, clashing):
    groups = collections.defaultdict(list)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", "", t or "")
    for i, text, *_ in hard_rows():
        groups[norm(text)].append((-len(text or ""), i is not None, i))
    # With a hash that is the same for all texts, the comparison of neighbours alone tells them apart.
    for mark in (F.xxhash64, lambda norm: F.lit(7).cast("long")):
        found = collections.Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in table(exact_dedup.groups(hard, mark=mark)))
        wanted = collections.Counter()
        for i, text, *_ in hard_rows():
            g = groups[norm(text)]
            best = min(g, key=lambda x: (x[0], x[1], x[2] or 0))[2]
            wanted[i, best, len(g), i == best, hashlib.sha256(norm(text).encode()).hexdigest()] += 1
        assert found == wanted
    kept = exact_dedup.dedup(clashing)
    assert kept.columns == clashing.columns and kept.count() == len(groups)
    best = {min(g, key=lambda x: (x[0], x[1], x[2] or 0))[2] for g in groups.values()}
    assert {r["doc_id"] for r in table(kept)} == best
    assert exact_dedup.groups(empty).count() == exact_dedup.dedup(empty).count() == 0


# 3


def page(article: str, n: int, extra: str = "") -> str:
    return (
        f"<!DOCTYPE html><html><head><title>T{n}</title><style>p{{}}</style><script>var a='</p>';</script></head><body><nav><ul><li><a href=/{n}>menu {n}</a></li></ul></nav>"
        f"<!-- x --><div class=\"ad\">Buy now {n}</div><p>Our standing notice to readers</p>{extra}{article}<div id='comments'><p>I disagree {n}</p></div><footer>&copy; host</footer></body></html>"
    )


def test_html(spark, empty):
    rows = [
        (1, "http://a.org/1", page("<article><h1>Head</h1><p><b>One &amp; two.<br><p>Th\n ree</p><aside>skip</aside></article>", 1), "Head\nOne & two.\nTh ree"),
        (2, "http://a.org/2", page("<article class=post><p>Other text</p><form><input>send</form></article>", 2), "Other text"),
        (3, "http://a.org/3", page("<main><div class='share'>share</div><p>Main one</p></main>", 3), "Main one"),
        (4, "http://a.org/4", page("<div><p>No article here 4</p></div>", 4), "No article here 4"),
        (5, "http://b.org/", None, ""), (6, None, "", ""), (7, "bad", "plain <b>text", "plain text"), (8, "http://a.org/1", page("<article><p>Again</p></article>", 1), "Again"),
        (9, "http://a.org/9", page("<div class='ad'>open<article><p>Inside</p></article>", 9), "Inside"), (None, "http://c.org", "<p>x</p>\n<p>y</p>", "x\ny"),
        (10, "http://d.org", "<article>" + "<p>long word</p>" * 5000 + "</article>", "\n".join(["long word"] * 5000)),
    ]
    frame = spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    found = {(r["page_id"], r["url"]): (r["text"], r["n_chars"]) for r in table(html_extract.main_text(frame))}
    assert all(found[i, url] == (text, len(text)) for i, url, _, text in rows)
    assert html_extract.main_text(frame.limit(0)).count() == 0
    templates = {r["host"]: len(r["template"]) for r in table(html_extract.templates(frame.withColumn("host", F.regexp_extract("url", "//([^/]*)", 1)), "page_id"))}
    assert templates.get("a.org", 0) >= 2 and "b.org" not in templates


def test_html_template_in_articles(spark):
    """Boilerplate that repeats inside articles is template; what differs fills slots, nested by class."""
    body = "<article><h1>Title {0}</h1><p>Read this on our site</p>{1}<p>Last {0}</p><p>Follow us for more</p></article>"
    items = lambda i: "".join(f"<section><h2>Part</h2><p>Item {i} {k}</p></section>" for k in range(i % 3 + 1))
    rows = [(i, f"http://t.org/{i}", page(body.format(i, items(i)), i)) for i in range(6)]
    rows += [(10 + i, "http://copy.org/", "<article><h1>Same</h1><p>On each page</p></article>") for i in range(4)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r["page_id"]: r["text"] for r in table(html_extract.main_text(frame))}
    for i in range(6):
        assert found[i].split("\n") == [f"Title {i}", *(f"Item {i} {k}" for k in range(i % 3 + 1)), f"Last {i}"]
    assert all(found[10 + i] == "Same\nOn each page" for i in range(4))
    hosts = table(html_extract.templates(frame.withColumn("host", F.regexp_extract("url", "//([^/]*)", 1)), "page_id"))
    template = html_extract.Template(next(r["template"] for r in hosts if r["host"] == "t.org"))
    at = {text: slot for slot, text in html_extract.slots(rows[2][2], template)}
    # The items' class is open once more than the class of the page, and all items fill the same slot.
    assert at["Item 2 0"] == at["Item 2 1"] == at["Item 2 2"] and len(at["Item 2 0"]) > len(at["Title 2"]) >= 1


def brute_template(sources: list[str]) -> set[int]:
    """The tokens of valid classes, from whole occurrence vectors."""
    counts = [collections.Counter(t for *_, t in html_extract.placed(s) if t is not None) for s in sources]
    classes = collections.defaultdict(set)
    for token in set().union(*counts):
        vector = tuple(c[token] for c in counts)
        if sum(n > 0 for n in vector) >= max(html_extract.LEAST_PAGES, html_extract.SHARE * len(sources)):
            classes[vector].add(token)
    return {t for c in classes.values() if len(c) >= html_extract.LEAST_TOKENS for t in c}


def test_html_templates_by_brute_force(spark):
    r = random.Random(8)
    rows = []
    for i in range(40):
        parts = [f"<p class=f{k}>Fixed text {k}, " + "long " * 80 * (k % 2) + "</p>" for k in range(6) if r.random() < 0.8]
        rows.append((i, f"http://h{i % 3}.net/{i}", f"<body><div class=top>{''.join(parts)}</div><article>{'<section><p>x</p></section>' * r.randrange(3)}<p>Own {i}</p></article></body>"))
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.regexp_extract("url", "//([^/]*)", 1))
    found = {r["host"]: {t["token"] & ((1 << 64) - 1) for t in r["template"]} for r in table(html_extract.templates(frame, "page_id"))}
    assert found == {f"h{h}.net": brute_template([s for i, _, s in rows if i % 3 == h]) for h in range(3)}
    # Without the template, fixed texts of any length would stay: it decides the result.
    texts = {r["page_id"]: r["text"] for r in table(html_extract.main_text(frame.withColumn("html", F.regexp_replace("html", "</?article>", ""))))}
    assert all("Fixed" not in t and f"Own {i}" in t for i, t in texts.items())
    assert "Fixed" in html_extract.extract(rows[0][2].replace("article", "div"), html_extract.Template())


def test_html_odd_markup():
    read = lambda source: html_extract.extract(source, html_extract.Template())
    assert read('<article class="post with-sidebar"><p>two</p></article>') == "two"
    assert read("<p>intro</p><div class='content ad-free'><p>Real story</p></div>") == "intro\nReal story"
    assert read("<article><div class='form-group'>Body text</div></article>") == "Body text"
    assert read('<article><div class="article-header"><h1>Head</h1></div><p>x</p></article>') == "Head\nx"
    assert read("<p title=it's>hello") == "hello" and read("<p title='>'>a</p><p title=\"<b>\">b</p>") == "a\nb"
    assert read("<p>intro</p><div class='sidebar-left'>menu</div><div class='cookie-notice-box'>we use</div>") == "intro"
    started = time.perf_counter()
    for odd in ("<p title='>", "<p title=\"'>", "<p <p", "<!", "<!-- <", "<p a='\"b>x"):
        read(odd * 100_000)
    assert time.perf_counter() - started < 20


def test_html_marks_do_not_drop_articles():
    none, text = html_extract.Template(), "Real text of the page, " * 20
    read = lambda source, template=none: html_extract.extract(source, template)
    for name in ("has-sidebar", "no-ads", "with-header", "sidebar", "page-header"):
        for whole in (f"<html><body class='{name}'>{{}}</body></html>", f"<html class='{name}'><body><div id='{name}'><section class={name}>{{}}</section></div></body></html>"):
            assert read(whole.format(f"<article><p>{text}</p></article>")) == text.strip()
            assert read(whole.format(f"<main class='{name}'><p>{text}</p></main>")) == text.strip()
            assert read(whole.format(f"<p>{text}</p>")) == text.strip()
    parts = "<article><div class='entry-header'><h1>Head</h1></div><section id='related-work'><h2>Related</h2><p>{0}</p></section><div class='search-form-of-x'><p>{0}</p></div>{1}</article>"
    wanted = f"Head\nRelated\n{text.strip()}\n{text.strip()}"
    assert read(parts.format(text, "<div class='share'>Share</div><aside>skip</aside><div hidden><p>skip</p></div>")) == wanted
    # Repetition on the host confirms a short marked element, and replies of any length.
    boxes = "<div class='related'><ul><li>Other {0}</li></ul></div><div class='comments'><p>Reply {0} " + "so " * 200 + "</p></div>"
    source = parts.format(text, boxes.format(7))
    tokens = [(token, name, i) for i, (kind, name, marks, _, token) in enumerate(html_extract.placed(source)) if kind != "text" and name == "div"]
    opens = [(t, 5, i) for t, _, i in tokens if i in [i for i, (k, _, m, *_) in enumerate(html_extract.placed(source)) if k == "open" and ("related" in m or "comments" in m)]]
    assert len(opens) == 2 and read(source, html_extract.Template(opens)) == wanted
    assert "Other 7" in read(source) and "Reply 7" in read(source)


# 4


def test_warc(spark, tmp_path):
    rows = [(1, "http://x", "same"), (2, "http://y", "same"), (3, None, None), (4, "http://z\r\nEvil: 1", ""), (5, "u", "WARC/1.1\r\n\r\nöß" * 9000), (5, "u", "WARC/1.1\r\n\r\nöß" * 9000), (9, "v", "same")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    source, target = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    warc.archive_pages(frame, source)
    first = warc.read_headers(spark, source)
    assert {r["type"] for r in table(first)} == {"response"} and first.count() == len(rows)
    warc.deduplicate(spark, source, target)
    found = sorted((r["page_id"], r["bytes"], r["digest"], r["type"], r["refers_to"]) for r in table(warc.read_headers(spark, target).fillna(-1)))
    sha = lambda t: warc.payload_digest((t or "").encode())
    wanted = [(i, len((t or "").encode()), sha(t), "revisit" if i in (1, 2, 3) else "response", {1: 9, 2: 9, 3: 4}.get(i, -1)) for i, _, t in rows]
    wanted[5] = (5, *wanted[5][1:3], "revisit", 5)
    assert found == sorted(wanted)
    big = warc.resolve(first, least_bytes=100)
    assert big.where("first").count() == len(rows) - 1
    warc.archive_pages(frame.limit(0), f"file://{tmp_path}/none")
    warc.deduplicate(spark, f"file://{tmp_path}/none", f"file://{tmp_path}/none2")


# 5


def test_elias_fano():
    values = np.unique(np.random.default_rng(1).integers(0, 1 << 44, 5000).astype(np.uint64))
    low_bytes, n, low, high = lm_score.EliasFano.encode(values)
    ef = lm_score.EliasFano(low_bytes, n, np.frombuffer(low, np.uint8), np.frombuffer(high, np.uint8))
    assert (ef[np.arange(n)] == values).all()
    asked = np.concatenate([values[::7], values[::5] + np.uint64(1), np.array([0, 1 << 44], np.uint64)])
    assert (ef.successor(asked) == np.searchsorted(values, asked)).all()


def test_trie_searches_ranges_of_contexts():
    r = np.random.default_rng(2)
    contexts = np.unique(r.integers(0, 1 << 63, 400).astype(np.uint64))
    groups = [np.unique(np.append(r.integers(0, 1 << 40, n), [0] * (n % 2)).astype(np.uint64)) for n in r.integers(1, 60, len(contexts))]
    starts = np.cumsum([0, *map(len, groups)])[:-1]
    codes = r.integers(0, lm_score.STEPS, sum(map(len, groups))).astype(np.uint16)
    trie = lm_score.Trie(contexts, starts, np.concatenate(groups), codes)
    assert trie.pointers.n == len(contexts) + 1 and (trie.pointers[np.arange(len(contexts))] == starts).all()
    known = {(int(c), int(w)): int(codes[a + i]) for c, a, g in zip(contexts, starts, groups, strict=True) for i, w in enumerate(g)}
    asked = [np.unique(np.concatenate([g[::2], groups[i - 1][:5], np.array([0, (1 << 40) - 1], np.uint64)])) for i, g in enumerate(groups)]
    heads = np.append(contexts[:-1], np.uint64(1 << 63))  # the last is no context
    found = trie.find(heads, np.array([len(x) for x in asked]), np.concatenate(asked))
    assert found.tolist() == [known.get((int(c), int(w)), lm_score.STEPS + 1) for c, x in zip(heads, asked, strict=True) for w in x]
    # The pointers decide: with others, the same successors are not found.
    trie.pointers = lm_score.EliasFano(*(np.frombuffer(x, np.uint8) if isinstance(x, bytes) else x for x in lm_score.EliasFano.encode(np.zeros(len(contexts) + 1, np.uint64))))
    assert (trie.find(contexts, np.array([len(g) for g in groups]), np.concatenate(groups)) == lm_score.STEPS + 1).all()
    # Compact: what is in memory beside the mapped levels is far below 8 bytes an element.
    many = np.arange(100_000, dtype=np.uint64) * np.uint64(1000)
    ef = lm_score.EliasFano(*(np.frombuffer(x, np.uint8) if isinstance(x, bytes) else x for x in lm_score.EliasFano.encode(many)))
    held = [x for v in vars(ef).values() for x in (v if isinstance(v, tuple) else (v,)) if isinstance(x, np.ndarray) and x.flags.writeable]
    assert sum(x.nbytes for x in held) < len(many) and (ef[np.arange(len(many))] == many).all()


@pytest.mark.parametrize("hot", [lm_score.HOT, 1])
def test_language_model(hard, empty, hot):
    remainder = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(10))
    texts = [(i, WORD.findall((t or "").translate(LOWER)) + ["\0end"], i is not None and zlib.crc32(str(i).encode()) % 10 != 0) for i, t, *_ in hard_rows()]
    c = collections.Counter(w for _, ws, train in texts if train for w in ws)
    pairs = collections.Counter(p for _, ws, train in texts if train for p in zip(["\0begin", *ws], ws, strict=False))
    n, v = sum(c.values()), len(c)
    seen = collections.Counter(c) + collections.Counter({"\0begin": c["\0end"]})
    p1 = lambda w: (c[w] + 0.1) / (n + 0.1 * (v + 1))
    successors = collections.Counter(a for a, _ in pairs)

    def p2(a, b):
        if seen[a] > hot:
            mass = lm_score.PRIOR * seen[a] ** lm_score.POWER
            return (pairs[a, b] + mass * p1(b)) / (seen[a] + mass)
        return (max(pairs[a, b] - lm_score.DISCOUNT, 0) + lm_score.DISCOUNT * successors[a] * p1(b)) / seen[a] if seen[a] else p1(b)

    for a in [*list(seen)[:50], "\0begin", "no such word"]:  # over all words and the unknown one
        assert sum(p2(a, b) for b in c) + p2(a, "\0unknown") == pytest.approx(1)
    wanted = collections.defaultdict(list)
    for i, ws, train in texts:
        base = sum(math.log10(p1(w)) for w in ws)
        whole = sum(math.log10(p2(a, b)) for a, b in zip(["\0begin", *ws], ws, strict=False))
        wanted[i].append((train, len(ws), sum(c[w] > 0 for w in ws), n, base, whole))
    found = table(lm_score.score(hard, remainder != 0, hot=hot))
    assert len(found) == len(texts)
    for r in found:
        train, tokens, known, all_, base, whole = wanted[r["doc_id"]][0]
        assert (r["train"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (train, tokens, known, all_)
        assert r["base_score"] == pytest.approx(base) and r["score"] == pytest.approx(whole, abs=2e-4 * tokens)
    assert lm_score.score(empty, F.lit(True)).count() == 0
    assert {r["score"] for r in table(lm_score.score(hard.limit(2), F.lit(False)))} == {0.0}


# 6


def fill(sizes: dict, weights=(1, 2, 3), cap=3.0) -> dict:
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = float(sum(sizes.values())), set(order), {}
    while open_:
        total = sum(w[s] for s in open_)
        full = [s for s in open_ if left * w[s] / total > cap * sizes[s]]
        if not full:
            return out | {s: left * w[s] / total for s in open_}
        for s in full:
            out[s] = cap * sizes[s]
        left -= sum(out[s] for s in full)
        open_ -= set(full)
    return out


def test_mixing(spark, hard, empty, clashing):
    size = lambda t: len(WORD.findall(t or ""))
    sizes = collections.Counter()
    for _, t, _, s in hard_rows():
        sizes[s] += size(t)
    targets = fill(sizes)
    runs = [sorted(map(str, table(mixing.mix(hard.repartition(k))))) for k in (1, 7)]
    assert runs[0] == runs[1]
    found = table(mixing.mix(hard))
    assert len(found) == len(hard_rows())
    sources = {(i, size(t)): s for i, t, _, s in hard_rows()}
    taken = collections.Counter()
    for r in found:
        s = sources[r["doc_id"], r["size"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(targets[s]) and 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    assert all(abs(taken[s] - targets[s]) <= 1 for s in sizes)
    # The schedule spreads each source evenly: of the first slots, each has its share to within a few.
    plan = mixing.settle(mixing.source_targets(hard.groupBy("source").agg(F.sum(F.lit(1)).cast("long").alias("source_size"), F.count("*").alias("docs")), (1, 2, 3), 3.0))
    slots = mixing.schedule(spark, plan, 78, 9, 1)
    assert slots.groupBy("source").agg((F.max("rank") + 1 == F.count("*")).alias("dense")).where("not dense").count() == 0
    # All of the mix by brute force: streams in the order of their hashes, slots by golden-ratio points.
    order = {(r["id"], r["source"], r["mark"]): r["place"] for r in table(mixing.with_sizes(hard, "doc_id", "text", "source"))}
    marks = {(r["doc_id"], r["source"], r["text"]): r["mark"] for r in table(hard.withColumn("mark", F.xxhash64("text")))}
    takes = {s: round(t) for s, t in targets.items()}
    block = max(1, min(mixing.BLOCK, sum(takes.values()) // mixing.LEAST_BLOCKS))
    full = mixing.settle(mixing.source_targets(hard.withColumn("n", F.regexp_count("text", F.lit(WORD.pattern))).groupBy("source").agg(F.sum(F.coalesce("n", F.lit(0))).cast("long").alias("source_size"), F.count("*").alias("docs")), (1, 2, 3), 3.0))
    at = {(r["source"], r["rank"]): r["n"] for r in table(mixing.schedule(spark, full, sum(takes.values()), len(takes), block))}
    wanted = collections.Counter()
    for source in takes:
        stream = sorted((order[i, s, marks[i, s, t]], -1 if i is None else i, size(t), i) for i, t, _, s in hard_rows() if s == source)
        start, words = 0, []
        for _, _, n, i in stream:
            places = [p for lap in range(4) for p in range(start + lap * sizes[source], start + lap * sizes[source] + n) if p < takes[source]]
            wanted[i, n, len(places), min((at[source, p // block] for p in places), default=None)] += 1
            start += n
    assert collections.Counter((r["doc_id"], r["size"], r["taken"], r["first_slot"]) for r in found) == wanted
    same_name = spark.createDataFrame([(1, "a b c d", "x"), (1, "e", "x"), (2, "f g " * 30, "y")], "doc_id long, text string, source string")
    assert sorted(r["text"] for r in table(mixing.mixed(same_name))) == sorted(["a b c d"] * 3 + ["e"] * 3 + ["f g " * 30])
    mixed = mixing.mixed(clashing)
    assert mixed.columns == clashing.columns and mixed.count() > 0
    assert mixing.mix(empty).count() == mixing.mixed(empty).count() == 0
    assert mixing.mix(spark.createDataFrame([(1, " ", "a")], "doc_id long, text string, source string")).first()["taken"] == 0


def test_mixing_small_shares(spark):
    """Sources of a few words beside large ones meet their targets too, though the golden-ratio points may miss their spans."""
    sizes = {"a": 5_000_000, "b": 3_000_000, "c": 2_000_000, "d": 60, "e": 300, None: 7} | {f"s{i:03d}": 2_000_000 // (i + 1) ** 2 + 1 for i in range(300)}
    rows = [(s, n, 1) for s, n in sizes.items()]
    totals = spark.createDataFrame(rows, "source string, source_size long, docs long")
    plan = mixing.settle(mixing.source_targets(totals, (1, 2, 3), 3.0))
    takes = {r["source"]: r["take"] for r in table(plan)}
    block = 512
    slots = table(mixing.schedule(spark, plan, sum(takes.values()), len(takes), block))
    ranks = collections.defaultdict(list)
    for r in sorted(slots, key=lambda r: r["n"]):
        ranks[r["source"]].append(r["rank"])
    assert len({r["n"] for r in slots}) == len(slots)
    assert {s: v for s, v in ranks.items()} == {s: list(range(-(-t // block))) for s, t in takes.items() if t}
    texts = [(i, "w " * (20_000 if i else 40), "big" if i % 2 else "large") for i in range(1, 9)] + [(0, "w " * 3, "few")]
    docs = spark.createDataFrame(texts, "doc_id long, text string, source string")
    taken = {r["doc_id"]: (r["taken"], r["target"]) for r in table(mixing.mix(docs, weights=(1, 1, 1), cap=1.0))}
    assert taken[0] == (3, 3.0) and all(t == 20_000 for i, (t, _) in taken.items() if i)


# 7


def test_fingerprints(spark, hard, empty):
    rows = {}
    for i, t, *_ in hard_rows():
        rows.setdefault(i if i is not None else -math.inf, t or "")
    order = sorted(rows, reverse=True)
    found = table(fingerprints.fingerprints(hard))
    assert len(found) == len(hard_rows())
    by_text = collections.defaultdict(set)
    for r in found:
        i = r["doc_id"] if r["doc_id"] is not None else -math.inf
        after = rows[order[(order.index(i) + 1) % len(order)]]
        text, cut = rows[i], len(rows[i]) // 3
        edited = text[: len(text) - cut] + after[:cut]
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and r["n_chars"] == len(text)
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        by_text[text].add(r["fingerprint"])
    assert all(len(f) == 1 for f in by_text.values())
    assert fingerprints.fingerprints(empty).count() == 0
    alone = fingerprints.fingerprints(spark.createDataFrame([(1, "a b c d e f g h i")], "doc_id long, text string")).first()
    assert alone["near_next"] == 1.0


def test_fingerprints_by_brute_force(spark, hard):
    """Every fingerprint and both likenesses, from hashes that Spark takes of single words and of five hashes."""
    texts = {}
    for i, t, *_ in hard_rows():
        texts.setdefault(-math.inf if i is None else i, t or "")
    order = sorted(texts, reverse=True)
    after = {i: texts[order[(k + 1) % len(order)]] for k, i in enumerate(order)}
    edited = {i: t[: len(t) - len(t) // 3] + after[i][: len(t) // 3] for i, t in texts.items()}
    words_of = {t: WORD.findall(t.lower()) for t in {*texts.values(), *edited.values()}}
    known = sorted({w for ws in words_of.values() for w in ws})
    hashed = {r["w"]: r["h"] for r in table(spark.createDataFrame([(w,) for w in known], "w string").withColumn("h", F.xxhash64("w")))}
    wholes = {t: [tuple(hashed[w] for w in ws[i : i + 5]) for i in range(len(ws) - 4)] for t, ws in words_of.items()}
    fives = spark.createDataFrame([(list(x),) for x in {x for s in wholes.values() for x in s}], "a array<long>")
    five = {tuple(r["a"]): r["h"] for r in table(fives.withColumn("h", F.xxhash64(*(F.col("a")[k] for k in range(5)))))}
    few = spark.createDataFrame([([hashed[w] for w in ws],) for ws in words_of.values() if 0 < len(ws) < 5], "a array<long>")
    short = {tuple(r["a"]): r["h"] for r in table(few.withColumn("h", F.xxhash64("a")))}
    most = -(1 << 63) + (1 << 64) // fingerprints.SCALE

    def sketch(t):
        ws = words_of[t]
        found = {five[x] for x in wholes[t]} if len(ws) >= 5 else {short[tuple(hashed[w] for w in ws)]} if ws else set()
        return {h for h in found if h < most} or ({min(found)} if found else set())

    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    text = lambda a: " ".join(f"{h & (1 << 64) - 1:x}" for h in sorted(a))
    for r in table(fingerprints.fingerprints(hard)):
        i = -math.inf if r["doc_id"] is None else r["doc_id"]
        a, b, c = sketch(texts[i]), sketch(edited[i]), sketch(after[i])
        assert (r["fingerprint"], r["edited_fingerprint"]) == (text(a), text(b)), i
        assert r["near_edited"] == pytest.approx(like(a, b)) and r["near_next"] == pytest.approx(like(a, c))


def test_merged_fingerprints(spark):
    """The merged fingerprint is that of all shingles together, though a side had none below the threshold."""
    few = [p for p in (" ".join(prose(s, 5).split()[:5]) for s in range(60))]
    frame = spark.createDataFrame([(a, b) for a, b in zip(few, [prose(5, 300), *few], strict=False)], "a string, b string")
    both = fingerprints.retained(F.concat(fingerprints.shingle_hashes(F.col("a")), fingerprints.shingle_hashes(F.col("b"))))
    merged = fingerprints.merge(fingerprints.sketch(F.col("a")), fingerprints.sketch(F.col("b")))
    assert frame.select((both == merged).alias("same")).where("not same").count() == 0


def test_sketches_estimate(spark):
    a, b = prose(5, 4000), prose(5, 4000)[: len(prose(5, 4000)) // 10] + " " + prose(6, 3000)
    shingles = lambda t: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}
    x, y = shingles(a), shingles(b)
    frame = spark.createDataFrame([(a, b)], "a string, b string").select(fingerprints.sketch(F.col("a")).alias("a"), fingerprints.sketch(F.col("b")).alias("b"))
    got = frame.select(fingerprints.likeness(F.col("a"), F.col("b")), fingerprints.containment(F.col("b"), F.col("a")), F.size(fingerprints.merge(F.col("a"), F.col("b")))).first()
    assert abs(got[0] - len(x & y) / len(x | y)) < 0.03 and abs(got[1] - len(x & y) / len(y)) < 0.06 and abs(got[2] * fingerprints.SCALE / len(x | y) - 1) < 0.15


# 8


def test_language(spark, sf_dir, hard, empty):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    learned = language_id.learn(docs.where(language_id.fold() != 2))
    found = language_id.identify(docs, learned).join(docs.select("doc_id", "lang"), "doc_id").where(language_id.fold() == 2)
    assert found.where("lang = lang_pred").count() >= 0.97 * found.count() and found.where("rejected").count() <= 0.02 * found.count()
    rows = {r["doc_id"]: r for r in table(language_id.identify(hard, learned))}
    assert len(rows) == len({r[0] for r in hard_rows()})
    for i in (6, 7, 8, 14):
        assert (rows[i]["lang_pred"], rows[i]["score"], rows[i]["rejected"]) == ("und", 0.0, True)
    assert all(0 <= r["score"] <= 1 for r in rows.values()) and rows[9]["lang_pred"] in learned.languages
    assert language_id.identify(empty, learned).count() == 0
    nothing = language_id.learn(empty)
    assert {r["lang_pred"] for r in table(language_id.identify(hard, nothing))} == {"und"}
    assert language_id.keep_identified(hard, learned).columns == hard.columns


def test_kneser_ney_sums_to_one():
    model = language_id.Identifier([("x", "abracadabra alakazam"), ("y", "zzz yyy")])
    codes = np.arange(len(np.flatnonzero(model.codes)) + 1, dtype=np.uint64)
    for context in (0, 1, 5):
        c = np.uint64(context)
        grams = (c << np.uint64(48)) | (c << np.uint64(32)) | (c << np.uint64(16)) | codes
        for m in model.models:
            assert np.exp(m.log_probability(grams)).sum() == pytest.approx(1, abs=1e-4)


def test_kneser_ney_by_brute_force():
    """Probabilities of a model against interpolated Kneser-Ney with dictionaries."""
    text = "abracadabra alakazam"
    model = language_id.Identifier([("x", text)])
    points, offsets = language_id.letters([text])
    codes = [int(model.codes[language_id._SPACE])] * 3 + [int(model.codes[p]) for p in points]
    grams = collections.Counter(tuple(codes[i : i + 4]) for i in range(len(codes) - 3))
    levels = {4: grams}
    for n in (3, 2, 1):
        levels[n] = collections.Counter(g[1:] for g in levels[n + 1])
    alphabet = len(set(codes))

    def p(gram):
        if not gram:
            return 1 / (alphabet + 1)
        level = levels[len(gram)]
        once, twice = (sum(c == k for c in level.values()) for k in (1, 2))
        d = once / (once + 2 * twice) if once else 0.5
        same = [c for g, c in level.items() if g[:-1] == gram[:-1]]
        if not same:
            return p(gram[1:])
        return max(level[gram] - d, 0) / sum(same) * (gram in level) + d * len(same) / sum(same) * p(gram[1:])

    packed = model.pack(points, offsets)
    found = np.exp(model.models[0].log_probability(packed))
    assert found == pytest.approx([p(tuple(codes[i : i + 4])) for i in range(len(codes) - 3)], rel=1e-4)


def test_language_sample_is_bounded(spark, monkeypatch):
    rows = [(i, f"{'ab' if i % 2 else 'cd'} " * 50, f"l{i % 2}") for i in range(200)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = []
    monkeypatch.setattr(language_id, "Identifier", lambda sample: seen.append(sample))
    monkeypatch.setattr(language_id, "TOTAL_BYTES", 4 * 150 * 2)
    language_id.learn(frame)
    assert collections.Counter(lang for lang, _ in seen[0]) == {"l0": 4, "l1": 4}
    language_id.learn(frame.limit(0))
    assert seen[1] == []


# 9


def brute_components(rows, size=2, threshold=80):
    sets = {}
    for i, t, *_ in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets.setdefault(i, frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else []))
    ids = [i for i in sets if i is not None]
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, i in enumerate(ids):
        for j in ids[:k]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= threshold * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return sets, {i: find(i) for i in ids}


def test_near_duplicates(spark, hard, empty, clashing):
    words = prose(9, 200).split()
    family = []
    for i in range(80):  # a chain of edits: ends are far from each other, every step is a link
        words = [f"w{i}" if (k * 7 + i * 13) % 40 == 0 else w for k, w in enumerate(words)]
        family.append((1000 + i, " ".join(words), "en", "a"))
    rows = hard_rows() + family
    frame = spark.createDataFrame(rows, hard.schema).repartition(5)
    sets, roots = brute_components(rows)
    found = table(minhash.near_duplicates(frame))
    assert len(found) == len(rows)
    for r in found:
        i = r["doc_id"]
        assert r["n_shingles"] == len(sets[i])
        assert r["component_id"] == (None if i is None else roots[i]) and r["kept"] == (i is None or roots[i] == i), i
    kept = minhash.keep_first(clashing)
    assert kept.columns == clashing.columns
    assert minhash.near_duplicates(empty).count() == minhash.keep_first(empty).count() == 0


def test_near_duplicates_of_one_name(spark):
    """Rows of one identifier with different texts are separate documents."""
    a, b = prose(21, 80), prose(22, 80)
    frame = spark.createDataFrame([(1, a), (5, a), (5, b), (9, b), (9, b)], "doc_id long, text string")
    found = collections.Counter((r["doc_id"], r["component_id"], r["kept"]) for r in table(minhash.near_duplicates(frame)))
    assert found == {(1, 1, True): 1, (5, 1, False): 1, (5, 5, True): 1, (9, 5, False): 2}
    assert sorted((r["doc_id"], r["text"]) for r in table(minhash.keep_first(frame))) == sorted([(1, a), (5, b)])


def test_blocks_find_what_stars_miss(spark):
    # Without stars, the exact blocks alone must link everything inside a bucket.
    rows = [(i, prose(1, 60) + f" x{i}") for i in range(30)]
    frame = spark.createDataFrame(rows, "name long, text string")
    signed = minhash.signatures(frame, "name", "text", 2, 48, 4).select(F.col("id").alias("name"), F.col("class").alias("id"), "n", "bands")
    sets = minhash.packed_sets(frame.join(signed, "name"), 2).join(signed.select("id", "bands"), "id")
    assert sets.count() == 30 and minhash.packed_sets(frame.withColumn("id", F.lit(1).cast("long")), 2).count() == 0
    buckets = signed.select(F.explode("bands").alias("bucket"), "id", "n")
    none = spark.createDataFrame([], "id long, root long")
    links = minhash.remaining(buckets, none, sets, 80)
    assert minhash.components(links).count() == 29 and minhash.components(links).select("root").distinct().count() == 1


# 10


def test_repeats(hard, empty, clashing, spark):
    texts = [(i, (t or "").encode()) for i, t, *_ in hard_rows()]
    count = collections.Counter(b[p : p + 200] for _, b in texts for p in range(len(b) - 199))
    wanted = collections.Counter()
    for i, b in texts:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 199):
            if count[b[p : p + 200]] > 1:
                gone[p : p + 200] = True
        spans = int(np.sum(gone & ~np.concatenate([[False], gone[:-1]])))
        wanted[i, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()] += 1
    found = collections.Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in table(repeats.remove_repeats(hard)))
    assert found == wanted
    crowded = repeats.remove_repeats(hard, crowd=1)
    assert collections.Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in table(crowded)) == wanted
    assert repeats.remove_repeats(empty).count() == 0
    # A key with more entries in a chunk than are sent one by one, and (with fewer allowed) in all chunks together.
    passage = prose(7, 60)
    many = spark.createDataFrame([(i, prose(200 + i, 50) + " " + passage + " " + prose(900 + i, 50)) for i in range(150)], "doc_id long, text string").coalesce(1)
    gone = [r["n_removed"] for r in table(repeats.remove_repeats(many))]
    assert min(gone) >= len(passage.encode())
    assert repeats.remove_repeats(clashing).count() == len(hard_rows())


def thue_morse(n: int) -> str:
    s = "a"
    while len(s) < n:
        s += s.translate(str.maketrans("ab", "ba"))
    return s[:n]


def test_strings_that_collide_under_polynomials(spark):
    """A Thue-Morse string and its complement have equal polynomials modulo 2**64, whatever the odd base."""
    one = thue_morse(1024)
    two = one.translate(str.maketrans("ab", "ba"))
    frame = spark.createDataFrame([(1, one), (2, two), (10, one[:200]), (11, two[:200])], "doc_id long, text string")
    assert {r["n_known"] for r in table(lm_score.score(frame, F.col("doc_id") != 2)) if r["id" if "id" in r else "doc_id"] == 2} == {1}
    assert {r["doc_id"]: r["component_id"] for r in table(minhash.near_duplicates(frame))} == {1: 1, 2: 2, 10: 10, 11: 11}
    count = collections.Counter(t[p : p + 200] for t in (one, two, one[:200], two[:200]) for p in range(len(t) - 199))
    covered = lambda t: len({q for p in range(len(t) - 199) if count[t[p : p + 200]] > 1 for q in range(p, p + 200)})
    assert [r["n_removed"] for r in sorted(table(repeats.remove_repeats(frame)), key=lambda r: r["doc_id"])] == [covered(t) for t in (one, two, one[:200], two[:200])]


def test_corpus_order_is_lexicographic():
    """The suffix arrays of dictionary and parse together give the order of whole suffixes."""
    r = random.Random(5)
    base = bytes(r.choice(b"ab ") for _ in range(600))
    for _ in range(20):
        texts = [base[a : a + r.randrange(200, 300)] for a in (r.randrange(300) for _ in range(8))] + [b"a" * r.randrange(200, 400) for _ in range(3)]
        texts += [t[:k] + b"c" + t[k:] for t, k in ((t, r.randrange(len(t))) for t in texts[:4])]
        raw, ends = b"".join(texts), np.cumsum([len(t) for t in texts])
        data = np.frombuffer(raw, np.uint8)
        strings = np.concatenate([np.arange(e - len(t), e - 199) for t, e in zip(texts, ends, strict=True)])
        rests = [raw[p : ends[np.searchsorted(ends, p, "right")]] for p in strings]
        assert [rests[i] for i in repeats.corpus_order(data, ends, strings)] == sorted(rests)
        count = collections.Counter(raw[p : p + 200] for p in strings)
        assert repeats.repeated(data, ends, strings).tolist() == [count[raw[p : p + 200]] > 1 for p in strings]
