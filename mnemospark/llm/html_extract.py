"""Main-text extraction by deduced page templates (equivalence classes of tokens).

Tokens of a page are its tags, with class and place in the tree, and its text nodes. Over all pages of a host, the
tokens with the same occurrence vector (the same count on every page) form an equivalence class; vectors are never
gathered: a token's vector is summed up in a fingerprint, a sum over pages of a hash of (page, count), which merges in
partial aggregates. A class is valid if it is frequent (on half of the host's pages and at least LEAST_PAGES) and large (at
least two tokens, tags and texts alike); its tokens are in the order of their first places on the pages. A page is read
against its host's valid classes: a class that begins inside another's occurrence nests there, in the slot between two
tokens of the outer class, and what is no token of the template fills a slot. Only fillers are data: a template text is
boilerplate and dropped, inside an article too. Slots inside menus, headers, footers, sidebars, notices, adverts, forms and
comments are dropped by the tags that enclose them. A host with too few pages has no template, and its pages are read by
their tags alone.

Marks (names in class, id and role, such as sidebar) drop an element, but never html, body, an article or what holds one. A
marked element inside an article goes only if the host repeats it (its tag is template) and its own text is short or is
readers' replies, or if it is a bare label. A page without an article that marks leave empty is read without them.

A page meets its host's template by (host, salt), so that a host with a third of all pages is dealt over all tasks.

Text: character references are decoded, white space inside a block becomes one space, blocks are joined by a line feed.
The text of an ``article`` or ``main`` counts, without such an element the page's body. An article that is template text
throughout (a host's pages repeat each other) has no slot to tell data by and is kept whole.

Defined cases: a null or empty html gives an empty text; a null url is a host of its own, without a name; repeated rows
each give a row; broken nesting closes at the next enclosing end tag; a tag that never ends reaches to the page's end; pages
are read in one pass, in time that grows with their length; ties (tokens of one place) keep the order of their hashes;
other columns, whatever their names, are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pages, settle_table, shuffle_partitions, tidy

#: Pages of a host on which a class must occur, and the share of them; tokens of a class. A host of fewer pages has no template.
LEAST_PAGES, SHARE, LEAST_TOKENS = 3, 0.5, 2
#: Characters up to which the text of a marked element that the host repeats is short.
SHORT = 200

#: Comments, declarations and tags; quotes count behind an equals sign only. Nothing is given back, so that a scan is linear.
_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:=\s*+(?:"[^"]*+"|'[^']*+')|[^>])*+)(?:>|\Z)""", re.S
)
_NAMED = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
#: Elements whose content is not markup.
_RAW = {n: re.compile(rf"</{n}\s*>", re.I) for n in ("script", "style", "textarea", "title", "noscript", "template", "iframe", "svg")}
_BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4"
    " h5 h6 header hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_TREE = frozenset("html body div section article main nav header footer aside form fieldset ul ol dl table figure details dialog".split())
_DROPPED = frozenset("nav aside form footer dialog fieldset select button menu head".split())
#: Words of class, id and role that mark what is not the article.
_MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb"
    " breadcrumbs header masthead footer sidebar aside widget notice cookie cookies consent gdpr newsletter subscribe subscription"
    " signup login share sharing social related recommended comment comments respond disqus popup modal overlay form search"
    " pagination pager contentinfo complementary".split()
)
#: Words before a mark that say what a page has or lacks, not what the element is: has-sidebar, no-ads.
_QUALIFIERS = frozenset("has have no not non with without hide hides show shows is".split())
#: Words behind a mark that leave it what it is: sidebar-left, share-buttons; ad-free and related-work are no marks.
_BOXES = frozenset(
    "area bar block body bottom box button buttons container content icon icons inner item items left link links list outer panel posts"
    " right section slot top unit widget wrap wrapper".split()
)
#: Marks that are parts of an article inside one, and marks of what readers write under it, which may be long.
_PARTS, _REPLIES = frozenset("header masthead banner".split()), frozenset("comment comments respond disqus".split())
#: Tags of prose: a marked element with one of these is more than a label. Characters of a label at most.
_PROSE, LABEL = frozenset("p h1 h2 h3 h4 h5 h6 li dd blockquote pre td figcaption".split()), 40
#: Elements that no word drops.
_KEPT = frozenset("html body article main".split())
_WORD = re.compile(r"[a-z]+")
#: What a tag says of its element: nothing, hidden, or marks of what is not the article.
PLAIN, HIDDEN = frozenset(), frozenset({"hidden"})


def _marks(attributes: str) -> tuple[str, frozenset[str]]:
    """Class, id and role as text, and the words in them that mark the element as not the article (or HIDDEN)."""
    if not attributes or not attributes.strip():
        return "", PLAIN
    named, dropped, marks = [], False, set()
    for key, value in _NAMED.findall(attributes):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true"):
            dropped = True
            continue
        named.append(f"{key}={value}")
        for name in value.split():
            words = _WORD.findall(name)
            while len(words) > 1 and words[-1] in _BOXES and words[-1] not in _MARKS:
                words.pop()
            if words and words[0] not in _QUALIFIERS and words[-1] in _MARKS:
                marks.add(words[-1])
    return " ".join(named), HIDDEN if dropped else frozenset(marks)


def events(source: str) -> Iterator[tuple[str, str, str, frozenset[str]]]:
    """(kind, name, marks or text, marking words) of each tag and text node, without comments and raw content."""
    at, n = 0, len(source)
    while at < n:
        m = _TOKEN.search(source, at)
        end = m.start() if m else n
        if end > at:
            yield "text", "", source[at:end], PLAIN
        if not m:
            return
        at = m.end()
        if not m[2]:
            continue
        name = m[2].lower()
        if m[1]:
            yield "close", name, "", PLAIN
            continue
        marks, dropped = _marks(m[3])
        if name in _RAW:
            closing = _RAW[name].search(source, at)
            at = closing.end() if closing else n
            continue
        yield "open", name, marks, dropped
        if m[3].rstrip().endswith("/") and name in _TREE:
            yield "close", name, "", PLAIN


def placed(source: str, hashed: bool = True) -> Iterator[tuple[str, str, str, frozenset[str], int | None]]:
    """Events with the token each is: a hash of its kind, name and place in the tree (none for blank texts)."""
    path: list[str] = []
    for kind, name, text, marked in events(source):
        token = None
        if not hashed:
            pass
        elif kind == "text":
            shown = " ".join(html.unescape(text).split())
            if shown:
                token = xxhash.xxh64_intdigest(f"#{'/'.join(path)}#{shown}")
        elif kind == "open":
            token = xxhash.xxh64_intdigest(f"<{'/'.join(path)}<{name} {text}")
            if name in _TREE:
                path.append(name)
        else:
            if name in _TREE and name in path:
                while path.pop() != name:
                    pass
            token = xxhash.xxh64_intdigest(f">{'/'.join(path)}>{name}")
        yield kind, name, text, marked, token


class Template:
    """A host's valid classes, each with its tokens in order."""

    def __init__(self, rows: Iterable[tuple[int, int, int]] = ()):
        """rows: token, class, and a number that rises with the token's place."""
        classes: dict[int, list[tuple[int, int]]] = {}
        for token, of, at in rows:
            classes.setdefault(of, []).append((at, token & ((1 << 64) - 1)))
        #: Of each token, its class, its number in the class, and whether it is the last there.
        self.tokens = {t: (of, i, i == len(m) - 1) for of, m in classes.items() for i, (_, t) in enumerate(sorted(m))}

    def __bool__(self) -> bool:
        return bool(self.tokens)


class Reading:
    """A page read against a template: which occurrences of classes are open, the inner ones last."""

    def __init__(self, template: Template):
        self.tokens, self.open = template.tokens, []

    def take(self, token: int | None) -> bool:
        """Whether the next token of the page is the template's: the first of a class, or the one due in an open occurrence."""
        found = self.tokens.get(token)
        if found is None:
            return False
        of, number, last = found
        at = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i][0] == of), None)
        if number:
            if at is None or self.open[at][1] != number - 1:
                return False  # out of order: it fills a slot
            del self.open[at + 1 :]
            self.open[at][1] = number
            if last:
                self.open.pop()
        elif not last:
            if at is not None and self.open[at][1] == 0:
                del self.open[at:]  # the same class again, though the earlier occurrence is not over
            self.open.append([of, 0])
        return True

    @property
    def slot(self) -> tuple[tuple[int, int], ...]:
        """Where the page is: of each open occurrence, outer ones first, the class and the number of the token it is behind."""
        return tuple(map(tuple, self.open))


def slots(source: str, template: Template) -> Iterator[tuple[tuple[tuple[int, int], ...], str]]:
    """The texts that fill the template's slots on a page, with their slots, in page order."""
    reading = Reading(template)
    for kind, _, text, _, token in placed(source):
        if not reading.take(token) and kind == "text" and text.strip():
            yield reading.slot, " ".join(html.unescape(text).split())


def _lines(blocks: list[list[str]]) -> str:
    lines = (" ".join(html.unescape("".join(b)).split()) for b in blocks if b)
    return "\n".join(line for line in lines if line)


class _Suspect:
    """A marked element inside an article: where its text begins, and what tells whether it goes."""

    def __init__(self, kept: tuple[list[list[str]], ...], prose: int, fixed: bool, marked: frozenset[str]):
        self.starts = [(len(blocks), len(blocks[-1])) for blocks in kept]
        self.prose, self.fixed, self.marked = prose, fixed, marked

    def settle(self, kept: tuple[list[list[str]], ...], prose: int) -> None:
        """Takes the element's text back if it is a bare label, or if the host repeats the element and it is short or holds replies."""
        n, m = self.starts[0]
        own = len(_lines([kept[0][n - 1][m:], *kept[0][n:]]))
        label = prose == self.prose and own <= LABEL
        if not (label or (self.fixed and (own <= SHORT or self.marked & _REPLIES))):
            return
        for blocks, (n, m) in zip(kept, self.starts, strict=True):
            del blocks[n:]
            del blocks[-1][m:]
            blocks.append([])


def extract(source: str | None, template: Template) -> str:
    """The main text of a page, given its host's template."""
    if not source:
        return ""
    path: list[list] = []  # tree elements: name, 1 if dropped by its tag or hidden, 1 if by its marks, what is to be settled at its end
    # Blocks: of the article's slots, of all its text, of the body's slots, of these with what marks drop.
    inside, whole, everything, marks_too = kept = [[]], [[]], [[]], [[]]
    found = hard = soft = main = prose = 0
    reading = Reading(template)

    def leave():
        nonlocal hard, soft, main
        closed, was_hard, was_soft, suspect = path.pop()
        hard -= was_hard
        soft -= was_soft
        main -= closed in ("article", "main") and main > 0
        if suspect:
            suspect.settle(kept, prose)

    for kind, name, text, marked, token in placed(source, bool(template)):
        fixed = reading.take(token)
        if kind == "text":
            if hard:
                continue
            if not fixed:
                marks_too[-1].append(text)
            if soft:
                continue
            if main:
                whole[-1].append(text)
            if not fixed:
                everything[-1].append(text)
                if main:
                    inside[-1].append(text)
            continue
        if name in _BLOCKS:
            for blocks in kept:
                blocks.append([])
        prose += kind == "open" and name in _PROSE
        if name not in _TREE and name not in _DROPPED:
            continue
        if kind == "open":
            hidden = marked is HIDDEN and name not in ("html", "body")
            if name in ("article", "main") and not hidden:
                # What holds an article is not dropped by its marks; an advert that was never closed holds it too.
                for entry in path:
                    soft -= entry[2]
                    entry[2] = 0
                while path and hard and path[-1][0] in ("div", "section"):
                    leave()
                found += not hard
                main += 1
            dropped = hidden or name in _DROPPED or (name == "header" and not main)
            words = PLAIN if dropped or name in _KEPT or marked is HIDDEN else marked - _PARTS if main else marked
            suspect = _Suspect(kept, prose, fixed, words) if words and main and not hard + soft else None
            path.append([name, int(dropped), int(bool(words) and not main), suspect])
            hard += dropped
            soft += path[-1][2]
        elif any(entry[0] == name for entry in path):
            while True:
                closed = path[-1][0]
                leave()
                if closed == name:
                    break
    while path:
        leave()
    return (_lines(inside) or _lines(whole)) if found else _lines(everything) or _lines(marks_too)


def templates(rows: DataFrame, id_col: str, host_col: str = "host", html_col: str = "html") -> DataFrame:
    """host, template (array of the tokens of valid classes, with class and order): one row for each host with a template."""

    def run(batches):
        for batch in tidy(batches):
            hosts: dict[str, int] = {}
            sums: dict[tuple[str, int], list] = {}
            for i, host, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                hosts[host] = hosts.get(host, 0) + 1
                counts: dict[int, int] = {}
                firsts: dict[int, int] = {}
                for at, (*_, token) in enumerate(placed(source or "")):
                    if token is not None:
                        counts[token] = counts.get(token, 0) + 1
                        firsts.setdefault(token, at)
                for token, n in counts.items():
                    row = sums.setdefault((host, token), [0, 0, 0])
                    row[0] += 1
                    # A sum over pages, of 44 bits each, so that a batch's sum stays in 64 bits.
                    row[1] += xxhash.xxh64_intdigest(f"{i} {n}") >> 20
                    row[2] += firsts[token]
            keys = [*sums, *((host, None) for host in hosts)]
            values = [*sums.values(), *([n, 0, 0] for n in hosts.values())]
            signed = [None if t is None else t - (1 << 64) if t >= 1 << 63 else t for _, t in keys]
            columns = [
                pa.array([h for h, _ in keys], pa.string()), pa.array(signed, pa.int64()), pa.array([v[0] for v in values], pa.int64()),
                pa.array([v[1] for v in values], pa.int64()), pa.array([v[2] for v in values], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["host", "token", "pages", "vector", "at"])

    schema = "host string, token bigint, pages bigint, vector bigint, at bigint"
    parts = rows.select(id_col, host_col, html_col).mapInArrow(run, schema)
    # The vector's fingerprint is summed by halves, which cannot overflow.
    low, high = F.col("vector").bitwiseAND(F.lit((1 << 22) - 1)), F.shiftright("vector", 22)
    summed = parts.groupBy("host", "token").agg(
        F.sum("pages").alias("pages"), F.sum(low).alias("low"), F.sum(high).alias("high"), F.sum("at").alias("at")
    )
    summed = settle_table(summed.where(f"token is null or pages >= {LEAST_PAGES}"), "html-tokens")
    sizes = summed.where("token is null").select("host", F.col("pages").alias("all_pages"))
    frequent = summed.where("token is not null").join(sizes, "host").where(F.col("pages") >= SHARE * F.col("all_pages"))
    same = Window.partitionBy("host", "pages", "low", "high")
    valid = frequent.withColumn("size", F.count(F.lit(1)).over(same)).where(f"size >= {LEAST_TOKENS}")
    # The tokens of a class are on the same pages, so that their summed first places are in the order of the pages.
    token = F.struct("token", F.xxhash64("pages", "low", "high").alias("class"), "at")
    return valid.groupBy("host").agg(F.array_sort(F.collect_list(token)).alias("template"))


def main_text(rows: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, url, text, n_chars."""
    named = rows.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    # The authority of a url, in JVM expressions; what stands before an at sign or after a colon is part of it.
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", 1))
    named = named.withColumn("host", host)
    salt = F.pmod(F.xxhash64("id", "url"), F.lit(max(64, shuffle_partitions(rows.sparkSession))))
    named_salted = named.withColumn("salt", salt)
    known = settle_table(templates(named, "id"), "html-templates")
    used = named.select("host", salt.alias("salt")).distinct().join(known, "host")
    joined = named_salted.join(used, ["host", "salt"], "left").select("id", "url", "html", "template")

    def run(batches):
        for batch in tidy(batches):
            texts, last, last_template = [], None, Template()
            for source, template in zip(batch.column(2).to_pylist(), batch.column(3), strict=True):
                key = template.values if template.is_valid else None
                if key is None:
                    last, last_template = None, Template()
                elif last is None or not key.equals(last):
                    last, last_template = key, Template(zip(*(f.to_pylist() for f in key.flatten()), strict=True))
                texts.append(extract(source, last_template))
            columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, url_col, "text", "n_chars"])

    kind = rows.schema[id_col].dataType.simpleString()
    return joined.mapInArrow(run, f"`{id_col}` {kind}, `{url_col}` string, text string, n_chars bigint")


def op3_html_text(spark, sf_dir):
    return main_text(pages(spark, sf_dir))
