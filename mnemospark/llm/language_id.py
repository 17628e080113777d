"""Language identification by interpolated Kneser-Ney character models in sorted hash arrays.

For each language a model of order 4 over letters (runs of anything else count as one space) is learned from a bounded
sample of labelled rows; each order's n-grams and contexts are stored as sorted arrays of hashes with their discounted
probabilities and back-off masses. A text goes to the language of the least cross-entropy by character. The
probability comes from a softmax whose temperature is fitted on a part of the sample that the models did not see; so is
the limit of cross-entropy beyond which a text is rejected.

The sample: of each language at most SAMPLE rows, the least by a hash of the identifier, of at most SAMPLE_BYTES each, and
of all languages together about TOTAL_BYTES. That bound makes the models small enough to send to every executor. Letters
beyond the 65,534 most frequent of the sample count as unseen. Every row is scored, over its whole text.

Defined cases: null texts and texts without a letter are ``und`` with score 0, and rejected; rows of null language are
not learned from; repeated rows are scored alike; an empty table, or one without labels, gives ``und`` throughout; extra
columns are carried only by ``keep_identified``.
"""

from __future__ import annotations

import functools
import sys
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bytesops import mix
from .common import documents, tidy

ORDER = 4
#: Rows of the sample for a language, and bytes of the longest of them.
SAMPLE, SAMPLE_BYTES = 600, 100_000
#: Bytes of the sample: of one language, of all (but for the last row of each language).
LANG_BYTES, TOTAL_BYTES = 8 << 20, 64 << 20
#: One in so many of the sample's rows calibrates.
CALIBRATES = 5
#: Letters below which cross-entropy alone does not reject.
LEAST_LETTERS = 100
#: Code points of a piece that is scored at once.
PIECE = 2 << 20
UND = "und"
_SPACE = 32


@functools.cache
def _letters() -> np.ndarray:
    """For every code point, itself if it is a letter or a mark, else the space."""
    kinds = (unicodedata.category(chr(i))[0] if i < 0xD800 or i > 0xDFFF else "C" for i in range(sys.maxunicode + 1))
    return np.fromiter((i if k in "LM" else _SPACE for i, k in enumerate(kinds)), np.uint32, sys.maxunicode + 1)


def letters(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The letters of all texts end to end, words parted by one space, and the texts' offsets."""
    lowered = [(t or "").lower() for t in texts]
    points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in lowered])]).astype(np.int64)
    points = _letters()[points]
    space = points == _SPACE
    again = space.copy()  # a space after a space, or at a text's start
    again[1:] &= space[:-1]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    again[heads] = space[heads]
    # A text that starts with several spaces: the first is dropped, the others follow a space.
    kept = np.concatenate([[0], np.cumsum(~again)])
    return points[~again], kept[offsets]


def before(x: np.ndarray, offsets: np.ndarray, k: int, pad: int) -> np.ndarray:
    """The element k places before each, within its text; pad before the start."""
    out = np.full(len(x), pad, x.dtype)
    out[k:] = x[:-k] if k else x
    for j in range(k):
        at = offsets[:-1] + j
        out[at[at < len(x)]] = pad
    return out


class Model:
    """Sorted hash arrays of one language: for each order n-grams with discounted probabilities, contexts with masses."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, alphabet: int):
        self.uniform = 1.0 / (alphabet + 1)
        self.grams: list[tuple[np.ndarray, np.ndarray]] = []
        self.contexts: list[tuple[np.ndarray, np.ndarray]] = []
        levels = []
        for n in range(ORDER, 0, -1):
            levels.append((n, grams, counts))
            # Lower orders count distinct continuations to the left.
            grams, counts = np.unique(grams & np.uint64((1 << 16 * (n - 1)) - 1), return_counts=True)
        for n, g, c in reversed(levels):
            once, twice = (c == 1).sum(), (c == 2).sum()
            discount = once / (once + 2 * twice) if once else 0.5
            context = g >> np.uint64(16)
            contexts, inverse, kinds = np.unique(context, return_inverse=True, return_counts=True)
            total = np.bincount(inverse, c)
            self.grams.append(self._sorted(g, np.maximum(c - discount, 0) / total[inverse]))
            self.contexts.append(self._sorted(contexts, discount * kinds / total))

    @staticmethod
    def _sorted(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hashes = mix(keys.astype(np.uint64))
        order = np.argsort(hashes)
        return hashes[order], values[order].astype(np.float32)

    @staticmethod
    def _find(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray, default: float) -> np.ndarray:
        hashes, values = table
        wanted = mix(keys.copy())
        at = np.minimum(np.searchsorted(hashes, wanted), len(hashes) - 1)
        return np.where(hashes[at] == wanted, values[at], np.float32(default))

    def log_probability(self, grams: np.ndarray) -> np.ndarray:
        """Natural log probability of the last character of each packed 4-gram after the other three."""
        p = np.full(len(grams), self.uniform)
        for n in range(1, ORDER + 1):
            gram = grams & np.uint64((1 << 16 * n) - 1)
            p = self._find(self.grams[n - 1], gram, 0.0) + self._find(self.contexts[n - 1], gram >> np.uint64(16), 1.0) * p
        return np.log(p)


class Identifier:
    """Models of several languages with one alphabet, a temperature and a limit of cross-entropy for each language."""

    def __init__(self, rows: list[tuple[str, str]]):
        """rows: (language, text), in an order that does not depend on the machine."""
        rows = [(lang, text) for lang, text in rows if text]
        self.languages = sorted({lang for lang, _ in rows})
        points, offsets = letters([t for _, t in rows])
        used, counts = np.unique(points, return_counts=True)
        used = used[np.argsort(-counts, kind="stable")][: (1 << 16) - 2]
        self.codes = np.zeros(sys.maxunicode + 1, np.uint16)
        self.codes[used] = np.arange(1, len(used) + 1)
        self.models, fold = [], np.arange(len(rows)) % CALIBRATES == 0
        if not rows:
            return
        if len(rows) < 4 * CALIBRATES * len(self.languages):
            fold[:] = False
        packed = self.pack(points, offsets)
        row = np.repeat(np.arange(len(rows)), np.diff(offsets))
        spoken = np.array([self.languages.index(lang) for lang, _ in rows])
        for i in range(len(self.languages)):
            mine = (spoken == i)[row] & ~fold[row]
            if not mine.any():
                mine = (spoken == i)[row]
            if not mine.any():  # no letters at all: a model of the space
                self.models.append(Model(np.array([0], np.uint64), np.array([1]), len(used)))
                continue
            self.models.append(Model(*np.unique(packed[mine], return_counts=True), len(used)))
        self.temperature, self.limits = 1.0, np.full(len(self.languages), np.log(len(used) + 1) + 1)
        use = np.flatnonzero(fold if fold.any() else np.ones(len(rows), bool))
        sums, n = self.sums([rows[i][1] for i in use])
        use, sums, n = use[n > 0], sums[n > 0], n[n > 0]
        if len(use):
            mean = sums / n[:, None]
            # A softmax of mean log probabilities by the square root of the length: its sharpness is fitted.
            sharp = [2.0**k for k in range(-2, 8)]
            self.temperature = min(sharp, key=lambda t: self._loss(mean, n, spoken[use], t))
            for i in range(len(self.languages)):
                own = -mean[(spoken[use] == i) & (n >= LEAST_LETTERS), i]
                if len(own):  # three quarters of the way from the worst seen to a uniform guess
                    self.limits[i] = own.max() + 0.75 * max(0.0, np.log(len(used) + 1) - own.max())

    def pack(self, points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        codes = self.codes[points].astype(np.uint64)
        space = int(self.codes[_SPACE])
        out = codes.copy()
        for k in range(1, ORDER):
            out |= before(codes, offsets, k, space) << np.uint64(16 * k)
        return out

    def _posterior(self, mean: np.ndarray, n: np.ndarray, sharp: float) -> np.ndarray:
        z = mean * (sharp * np.sqrt(n))[:, None]
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def _loss(self, mean: np.ndarray, n: np.ndarray, spoken: np.ndarray, sharp: float) -> float:
        p = self._posterior(mean, n, sharp)[np.arange(len(n)), spoken]
        return float(-np.log(np.maximum(p, 1e-12)).mean())

    def sums(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """For each text the sums of log probabilities by language, and its letters (0 if it has none)."""
        points, offsets = letters(texts)
        out = np.zeros((len(texts), len(self.models)))
        sizes = np.diff(offsets)
        if len(points):
            grams, inverse = self._distinct(points, offsets)
            some = sizes > 0
            for i, model in enumerate(self.models):
                out[some, i] = np.add.reduceat(model.log_probability(grams)[inverse], offsets[:-1][some])
        real = np.concatenate([[0], np.cumsum(points != _SPACE)])
        return out, np.where(np.diff(real[offsets]) > 0, sizes, 0)

    def _distinct(self, points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distinct packed 4-grams and where each place's is among them: by dense tables while these are small."""
        codes = self.codes[points]
        space = self.codes[_SPACE]
        some = np.flatnonzero(np.bincount(codes, minlength=int(space) + 1))
        some = np.union1d(some, [space]).astype(np.uint64)
        dense = np.zeros(int(some[-1]) + 1, np.int32)
        dense[some.astype(np.int64)] = np.arange(len(some))
        a = len(some)
        if a * a <= 1 << 22:
            d = dense[codes]
            pair = before(d, offsets, 1, int(dense[space])) * a + d
            front = before(pair, offsets, 2, int(dense[space]) * (a + 1))
            seen = np.zeros(a * a, bool)
            seen[pair] = True
            seen[front] = True
            pairs = np.flatnonzero(seen)
            if len(pairs) ** 2 <= 1 << 24:
                small = np.zeros(a * a, np.int32)
                small[pairs] = np.arange(len(pairs))
                key = small[front] * len(pairs) + small[pair]
                table = np.zeros(len(pairs) ** 2, np.int32)
                table[key] = 1
                keys = np.flatnonzero(table)
                table[keys] = np.arange(len(keys))
                front_, pair_ = pairs[keys // len(pairs)], pairs[keys % len(pairs)]
                four = [some[front_ // a], some[front_ % a], some[pair_ // a], some[pair_ % a]]
                grams = (four[0] << np.uint64(48)) | (four[1] << np.uint64(32)) | (four[2] << np.uint64(16)) | four[3]
                return grams, table[key]
        return np.unique(self.pack(points, offsets), return_inverse=True)

    def identify(self, texts: list[str | None]) -> list[tuple[str, float, bool, float | None]]:
        """language, score, rejected, cross-entropy by character."""
        if not self.languages:
            return [(UND, 0.0, True, None)] * len(texts)
        sums, n = self.sums(texts)
        mean = sums / np.maximum(n, 1)[:, None]
        best = mean.argmax(1)
        score = self._posterior(mean, np.maximum(n, 1), self.temperature)[np.arange(len(n)), best]
        entropy = -mean[np.arange(len(n)), best]
        strange = (n >= LEAST_LETTERS) & (entropy > self.limits[best])
        return [
            (self.languages[b], float(s), bool(x), float(e)) if k else (UND, 0.0, True, None)
            for b, s, x, e, k in zip(best, score, strange, entropy, n, strict=True)
        ]


def learn(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Identifier:
    """Fits on a bounded sample of labelled: SAMPLE rows of each language, whole texts, the same on every run."""
    rows = labelled.where(F.col(lang_col).isNotNull() & (F.octet_length(text_col) <= SAMPLE_BYTES))
    place = F.xxhash64(F.col(id_col), F.lit("sample"))
    rows = rows.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), place.alias("place"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return Identifier([])
    # Half as many again as wanted, so that the sample is full; then exactly the least places, within the bytes.
    most = {lang: min(int((1 << 64) * min(1.0, 1.5 * SAMPLE / n)) - (1 << 63), (1 << 63) - 1) for lang, n in counts.items()}
    share = F.create_map(*(F.lit(x) for item in most.items() for x in item))
    few = rows.where(F.col("place") <= F.element_at(share, F.col("lang")))
    here = Window.partitionBy("lang").orderBy("place", "text")
    size = F.octet_length("text")
    few = few.withColumn("row", F.row_number().over(here)).withColumn("before", F.sum(size).over(here.rowsBetween(Window.unboundedPreceding, -1)))
    quota = min(LANG_BYTES, TOTAL_BYTES // len(counts))
    few = few.where((F.col("row") <= SAMPLE) & (F.coalesce("before", F.lit(0)) < quota))
    sample = [(r["lang"], r["text"]) for r in sorted(few.collect(), key=lambda r: (r["place"], r["lang"], r["text"]))]
    return Identifier(sample)


def identify(docs: DataFrame, identifier: Identifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each row: id, lang_pred, score, rejected, entropy."""
    shared = docs.sparkSession.sparkContext.broadcast(identifier)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, lang_pred string, score double, rejected boolean, entropy double"

    def run(batches):
        known = shared.value
        for batch in tidy(batches, 2500):
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            found, at = [], 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end] or "") <= PIECE):
                    size += len(texts[end] or "")
                    end += 1
                found += known.identify(texts[at:end])
                at = end
            lang, score, rejected, entropy = zip(*found, strict=True) if found else ((), (), (), ())
            columns = [ids, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_()), pa.array(entropy, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "lang_pred", "score", "rejected", "entropy"])

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def keep_identified(docs: DataFrame, identifier: Identifier, text_col: str = "text") -> DataFrame:
    """The rows of docs that are not rejected, with their columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(identifier)
    place = docs.columns.index(text_col)

    def run(batches):
        known = shared.value
        for batch in tidy(batches, 2500):
            texts, kept, at = batch.column(place).to_pylist(), [], 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end] or "") <= PIECE):
                    size += len(texts[end] or "")
                    end += 1
                kept += [not r[2] for r in known.identify(texts[at:end])]
                at = end
            yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def fold(id_col: str = "doc_id", folds: int = 4) -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds))


def op8_language_id(spark, sf_dir):
    docs = documents(spark, sf_dir)
    learned = learn(docs.where(fold() != 2))
    found = identify(docs, learned)
    return found.select("doc_id", (fold() == 2).alias("held_out"), "lang_pred", "score", "rejected", "entropy")
