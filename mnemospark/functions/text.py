"""Text functions as columns: tokens, camel case, trimming, similarity. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that searches ignore, English and Chinese.
STOP_WORDS = (
    "the a an is are was were be been being have has had do does did will would could should may might can shall"
    " to of in for on with at by from as into through during before after above below between out off over under"
    " again further then once here there when where why how all both each few more most other some such no nor not"
    " only own same so than too very just and but if or because until while this that these those"
    " i me my we our you your he him his she her it its they them their what which who"
    " 的 了 在 是 我 有 和 就 不 人 都 一 一个 上 也 很 到 说 要 去 你 会 着 没有 看 好 自己 这 他 她 它 们 那 些"
    " 什么 怎么 为什么 哪 谁 吗 呢 吧 啊 哦 嗯 把 被 让 给 呀"
).split()


def pre_split(text: Column) -> Column:
    """A space at every camel-case border of a text."""
    lower_upper = F.regexp_replace(text, r"([\p{Ll}\p{Nd}])(\p{Lu})", "$1 $2")
    return F.regexp_replace(lower_upper, r"(\p{Lu})(\p{Lu}\p{Ll})", "$1 $2")


def _segments(word: Column) -> Column:
    """A run of Han characters as overlapping pairs (there is no dictionary here), anything else as it is."""
    pairs = F.transform(F.sequence(F.lit(1), F.char_length(word) - 1), lambda i: F.substring(word, i, 2))
    return F.when(word.rlike(r"^\p{IsHan}{3,}$"), pairs).otherwise(F.array(word))


def words(text: Column) -> Column:
    """Lower-case tokens of a text: camel case and underscores part words, Han runs become pairs. Null: no tokens."""
    split = pre_split(F.coalesce(text, F.lit("")))
    pattern, whole = F.lit(r"[\p{L}\p{Nd}]+"), F.lit(0)
    han = F.regexp_extract_all(F.lower(F.regexp_replace(split, r"(\p{IsHan}+)", " $1 ")), pattern, whole)
    plain = F.regexp_extract_all(F.lower(split), pattern, whole)
    return F.when(text.rlike(r"\p{IsHan}"), F.flatten(F.transform(han, _segments))).otherwise(plain)


def tokens(text: Column) -> Column:
    """words() without stop words; repeats stay."""
    return F.filter(words(text), lambda w: ~w.isin(*STOP_WORDS))


def with_bigrams(tokens_: Column) -> Column:
    """Tokens, then each adjacent pair joined by a space."""
    n = F.size(tokens_)
    pairs = F.transform(F.sequence(F.lit(0), n - 2), lambda i: F.concat_ws(" ", F.get(tokens_, i), F.get(tokens_, i + 1)))
    return F.when(n > 1, F.concat(tokens_, pairs)).otherwise(tokens_)


def split_camel(word: Column) -> Column:
    """Lower-case parts of one identifier; whole if it has an underscore or one case only."""
    mixed = word.rlike(r"\p{Lu}") & word.rlike(r"\p{Ll}") & ~word.contains("_")
    border = r"(?<=\p{Ll})(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})"
    return F.when(mixed, F.split(F.regexp_replace(word, border, "\u0000"), "\u0000")).otherwise(F.array(word))


def split_camel_lower(word: Column) -> Column:
    parts = split_camel(word)
    return F.when(F.size(parts) > 1, F.transform(parts, F.lower)).otherwise(parts)


def trim_punctuation(text: Column) -> Column:
    """Without leading and trailing characters that are no letter, digit or underscore."""
    return F.regexp_replace(F.regexp_replace(text, r"^[^\p{L}\p{Nd}_]+", ""), r"[^\p{L}\p{Nd}_]+$", "")


def first_points(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def first_bytes(text: Column, n: int) -> Column:
    """At most n bytes of UTF-8, cut at a character: bytes of a cut character go."""
    raw = F.substring(F.encode(text, "UTF-8"), 1, n)
    # Points that fit: of the first n characters, those whose end lies within n bytes.
    points = F.length(F.regexp_replace(F.hex(raw), "(?:8|9|A|B)[0-9A-F](?=(?:[0-9A-F]{2})*$)", "")) / 2
    cut = F.substring(text, F.lit(1), points.cast("int"))
    return F.when(F.octet_length(text) <= n, text).when(F.octet_length(cut) <= n, cut).otherwise(
        F.substring(text, F.lit(1), points.cast("int") - 1)
    )


def normal_name(name: Column) -> Column:
    return F.lower(F.trim(name))


def keyword_set(keywords: Column) -> Column:
    return F.array_distinct(F.transform(keywords, F.lower))


def clean_keywords(keywords: Column) -> Column:
    """Trimmed, without empty and repeated ones, order kept, case significant."""
    return F.array_distinct(F.filter(F.transform(keywords, lambda k: F.trim(k)), lambda k: k != ""))


def keyword_overlap(topic_keywords: Column, query: list[str]) -> Column:
    """Share of the query's lower-case keywords that the topic has; 0 without keywords."""
    wanted = sorted({q.lower() for q in query})
    if not wanted:
        return F.lit(0.0)
    return F.size(F.array_intersect(F.transform(topic_keywords, F.lower), F.array(*map(F.lit, wanted)))) / F.lit(float(len(wanted)))


def answer_tokens(text: Column) -> Column:
    """Digit runs, and letter runs of at least three letters, lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"\p{Nd}+|\p{L}{3,}"), F.lit(0)))


def entity_hit(answer: Column, context: Column) -> Column:
    """Share of the answer's tokens that occur in the context; null without tokens."""
    wanted, low = answer_tokens(answer), F.lower(context)
    found = F.filter(wanted, lambda t: low.contains(t))
    return F.when(F.size(wanted) > 0, F.size(found) / F.size(wanted))
