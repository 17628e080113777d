"""Language-model scoring with sharded Elias-Fano n-gram tries.

Texts become chunks of tokens (a table bucketed by chunk: later passes meet it without moving it). Two exchanges follow:

1. Words: each chunk sends its distinct words with training counts to word shards, which add them up and answer with
   the totals, so that each chunk knows c(w) of its own words.
2. Bigrams: each chunk sends its distinct (context, word) pairs, of contexts that training texts hold, to trie shards by
   context; a hot context (seen more than HOT times) is dealt over several shards by a salt of the word. A shard adds up the counts,
   builds its trie (contexts, monotone Elias-Fano pointers to successors, successors as one Elias-Fano sequence, quantised log
   probabilities), maps it into memory, and answers every chunk's pairs by search among the successors of the context, and its
   contexts by their numbers of distinct successors.

The model is a bigram interpolated with the contract's add-0.1 unigram p1. By absolute discounting, p(w|v) = max(c(vw) - DISCOUNT, 0) / c(v)
+ DISCOUNT n(v) / c(v) p1(w), where n(v) counts the distinct successors of v. Of a hot context no shard knows n(v); its prior mass is
m = PRIOR c(v)**POWER instead, which follows the growth of n(v): p(w|v) = (c(vw) + m p1(w)) / (c(v) + m). Both sum to 1 over all words.
After a context that no training text holds, p = p1. The trie stores log10 of the first term, quantised to 16 bits.
Nothing is pruned or capped: all n-grams of all training texts are in the tries. No table reaches the driver but two totals.
A context is hot by its training count: one that is rare there and frequent in other texts only is answered by one shard.

Defined cases: null and empty texts are one end token; repeated rows are separate texts, each counted and scored; with no
training text every probability is the uniform 1 / (V + 1) = 1; a very long text is read whole; other columns, whatever their
names, are not read; an empty table gives an empty result. As with the blocks of an exchange, there is a row for each chunk and shard.
"""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesops import flat, mix, pieces, words
from .common import documents, dropped_after, settle_table, shuffle_partitions

#: Bytes of text of a chunk.
CHUNK = 8 << 20
#: What is taken from the count of a seen pair, and the prior mass of hot contexts: PRIOR * count ** POWER.
DISCOUNT, PRIOR, POWER = 0.75, 2.0, 0.8
#: A context seen more often is hot; numbers of successors of the others fit 16 bits.
HOT = (1 << 16) - 1
#: A hot context is dealt over one in so many shards, and over eight at least.
SHARE = 16
#: Quantised log10: steps from 0 down to -FLOOR.
FLOOR, STEPS = 12.0, 65_534
_END = np.uint64(0xE4D0E4D0E4D0E4D1)
_BEGIN = np.uint64(0xBE61BE61BE61BE61)
_ID_TYPES = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
_W40 = np.uint64((1 << 40) - 1)


def _planes(values: np.ndarray) -> bytes:
    """uint32 values as four planes of bytes, which compress well."""
    return values.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes()


def _unplanes(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view(np.uint32).reshape(-1)


def _pack40(values: np.ndarray) -> bytes:
    return values.view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _unpack40(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return out.view(np.uint64).reshape(-1)


#: Of each byte, where its k-th one is, the leading bit first.
_SELECT = np.zeros((256, 8), np.uint8)
for _byte in range(256):
    _ones = np.flatnonzero(np.unpackbits(np.array([_byte], np.uint8)))
    _SELECT[_byte, : len(_ones)] = _ones


class EliasFano:
    """A monotone sequence of integers: low bits as they are (whole bytes), high bits in unary. Both stay as they are mapped;
    in memory are only the counts of ones and zeros before each 64 high bits."""

    def __init__(self, low_bytes: int, n: int, low: np.ndarray, high: np.ndarray):
        self.low_bytes, self.n, self.low, self.high = low_bytes, n, low, high.reshape(-1, 8)
        ones = np.zeros(len(self.high) + 1, np.uint32)
        np.cumsum(np.bitwise_count(self.high).sum(1, dtype=np.uint32), out=ones[1:])
        self._before = np.arange(len(ones), dtype=np.uint32) * np.uint32(64) - ones, ones

    def _select(self, k: np.ndarray, bit: int) -> np.ndarray:
        """The place of the k-th bit of this value among the high bits; each k must be below their number."""
        before = self._before[bit]
        word = np.searchsorted(before, k.astype(np.uint32), "right") - 1
        rest = k - before[word]
        eight = self.high[word] if bit else ~self.high[word]
        counts = np.cumsum(np.bitwise_count(eight), 1, dtype=np.uint8)
        byte = (counts <= rest[:, None]).sum(1)
        rows = np.arange(len(k))
        rest = rest - np.where(byte > 0, counts[rows, byte - 1], 0)
        return word * 64 + byte * 8 + _SELECT[eight[rows, byte], rest]

    def _below(self, head: np.ndarray) -> np.ndarray:
        """How many elements have smaller high bits."""
        out = np.where(head > 0, self.n, 0)
        some = np.flatnonzero((head > 0) & (head <= int(self._before[0][-1])))
        out[some] = self._select(head[some] - 1, 0) - (head[some] - 1)
        return out

    def _lows(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros((len(at), 8), np.uint8)
        if self.low_bytes:
            out[:, : self.low_bytes] = self.low.reshape(self.n, self.low_bytes)[at]
        return out.view(np.uint64).reshape(-1)

    @staticmethod
    def encode(values: np.ndarray) -> tuple[int, int, bytes, bytes]:
        n = len(values)
        spread = int(values[-1]) // n if n else 0
        low_bytes = min(7, max(0, (spread.bit_length() - 1 + 4) // 8))
        low = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :low_bytes]
        heads = (values >> np.uint64(8 * low_bytes)).astype(np.int64)
        bits = np.zeros(int(heads[-1]) + n if n else 0, np.uint8)
        bits[heads + np.arange(n)] = 1
        high = np.packbits(bits).tobytes()
        return low_bytes, n, np.ascontiguousarray(low).tobytes(), high + bytes(-len(high) % 8)

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        return self._lows(at) | ((self._select(at, 1) - at).astype(np.uint64) << np.uint64(8 * self.low_bytes))

    def successor(self, wanted: np.ndarray, begin: np.ndarray | int = 0, end: np.ndarray | None = None) -> np.ndarray:
        """Of each wanted value, the place of the first element in [begin, end) not below it (end if none): within its high
        bits' run, by bisection over the low bits."""
        end = self.n if end is None else end
        shift = np.uint64(8 * self.low_bytes)
        head = (wanted >> shift).astype(np.int64)
        low = wanted & ((np.uint64(1) << shift) - np.uint64(1))
        first, last = (np.clip(self._below(h), begin, end) for h in (head, head + 1))
        while len(open_ := np.flatnonzero(first < last)):
            middle = (first[open_] + last[open_]) // 2
            below = self._lows(middle) < low[open_]
            first[open_[below]] = middle[below] + 1
            last[open_[~below]] = middle[~below]
        return first


class Trie:
    """One shard: its levels lie in one file that is mapped into memory and has no name any more."""

    def __init__(self, contexts: np.ndarray, starts: np.ndarray, successors: np.ndarray, codes: np.ndarray):
        """contexts: rising hashes; starts: where their successors begin; successors: 40-bit word hashes, rising inside a
        context; codes: quantised log probabilities."""
        ends = np.append(starts, len(successors))
        # Successors become one monotone sequence by adding to each context's the last element of the context before.
        base = np.zeros(len(contexts), np.uint64)
        if len(contexts):
            np.cumsum(successors[ends[1:-1] - 1], out=base[1:])
        levels = [EliasFano.encode(x) for x in (ends.astype(np.uint64), successors + np.repeat(base, np.diff(ends)))]
        parts = [contexts.tobytes(), codes.astype(np.uint16).tobytes(), *(p for lv in levels for p in lv[2:])]
        with tempfile.TemporaryFile() as file:
            file.write(b"".join(parts) or b"\0")
            file.flush()
            mapped = np.memmap(file, np.uint8, "r")
        at, views = 0, []
        for p in parts:
            views.append(mapped[at : at + len(p)])
            at += len(p)
        self.contexts, self.codes = views[0].view(np.uint64), views[1].view(np.uint16)
        self.pointers, self.successors = (EliasFano(*levels[i][:2], views[2 + 2 * i], views[3 + 2 * i]) for i in (0, 1))

    def find(self, contexts: np.ndarray, lengths: np.ndarray, successors: np.ndarray) -> np.ndarray:
        """The codes of successors grouped by context (lengths of the groups); STEPS + 1 where the trie has none."""
        out = np.full(len(successors), STEPS + 1, np.uint16)
        if not len(self.contexts):
            return out
        at = np.minimum(np.searchsorted(self.contexts, contexts), len(self.contexts) - 1)
        known = np.repeat(self.contexts[at] == contexts, lengths)
        # The context's own range, and what was added to its successors.
        begin, end = (self.pointers[x].astype(np.int64) for x in (at, at + 1))
        base = np.where(begin > 0, self.successors[np.maximum(begin - 1, 0)], np.uint64(0))
        wanted = np.repeat(base, lengths) + successors
        end = np.repeat(end, lengths)
        place = self.successors.successor(wanted, np.repeat(begin, lengths), end)
        known &= place < end
        place = np.minimum(place, self.successors.n - 1)
        hit = known & (self.successors[place] == wanted)
        out[hit] = self.codes[place[hit]]
        return out


def chunks(docs: DataFrame) -> DataFrame:
    """docs (id, text, train) as chunks of tokens: the distinct words by falling frequency, tokens as places among them."""

    def pack(number, ids, train, lengths, hashes):
        h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        distinct, inverse, counts = np.unique(h, return_inverse=True, return_counts=True)
        order = np.argsort(-counts, kind="stable")
        place = np.empty(len(order), np.uint32)
        place[order] = np.arange(len(order))
        columns = [
            pa.array([number], pa.int64()), pa.array([ids], pa.list_(id_type)), pa.array([np.array(train, np.uint8).tobytes()], pa.binary()),
            pa.array([np.array(lengths, np.int64).tobytes()], pa.binary()), pa.array([distinct[order].tobytes()], pa.binary()),
            pa.array([_planes(place[inverse])], pa.binary()),
        ]
        return columns

    names = ["chunk", "ids", "train", "lengths", "words", "tokens"]
    kind = docs.schema["id"].dataType.simpleString()
    id_type = _ID_TYPES[kind]

    def run(batches):
        task = TaskContext.get().partitionId()
        number, size = task << 32, 0
        ids, train, lengths, hashes = [], [], [], []

        def flush():
            return pa.RecordBatch.from_arrays(pack(number, ids, train, lengths, hashes), names=names)

        for batch in batches:
            data, offsets = flat(batch.column(1))
            for i, j in pieces(offsets):
                h, at = words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                hashes.append(h)
                lengths += np.diff(at).tolist()
                ids += batch.column(0).slice(i, j - i).to_pylist()
                train += batch.column(2).slice(i, j - i).to_pylist()
                size += int(offsets[j] - offsets[i])
                if size >= CHUNK:
                    yield flush()
                    number, size = number + 1, 0
                    ids, train, lengths, hashes = [], [], [], []
        if ids:
            yield flush()

    schema = f"chunk bigint, ids array<{kind}>, train binary, lengths binary, words binary, tokens binary"
    return docs.select("id", "text", "train").mapInArrow(run, schema)


def _unchunk(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """words, tokens with the end of each text (at place len(words)), their texts' offsets, and whether texts train."""
    w = np.frombuffer(row["words"], np.uint64)
    t = _unplanes(row["tokens"])
    lengths = np.frombuffer(row["lengths"], np.int64)
    train = np.frombuffer(row["train"], bool)
    ends = np.cumsum(lengths)
    return np.append(w, _END), np.insert(t, ends, len(w)), np.concatenate([[0], np.cumsum(lengths + 1)]), train


def _word_rows(row: dict, shards: int):
    """Each word shard's words of a chunk (places, rising by shard) and their training counts."""
    w, t, offsets, train = _unchunk(row)
    counts = np.bincount(t[np.repeat(train, np.diff(offsets))], minlength=len(w))
    shard = (mix(w ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    bounds = np.searchsorted(shard[order], np.arange(shards + 1))
    return w, counts, order, bounds


class _Pairs:
    """The distinct (context, word) pairs of a chunk: those of known contexts dealt over trie shards, contexts and words rising inside a shard."""

    def __init__(self, row: dict, totals: np.ndarray, shards: int, hot: int):
        self.words, self.tokens, self.offsets, self.train = _unchunk(row)
        n = len(self.words)  # the place n stands for the beginning
        context = np.empty(len(self.tokens), np.uint64)
        context[1:] = self.tokens[:-1]
        context[self.offsets[:-1]] = n
        pair, self.inverse = np.unique(context * np.uint64(n + 1) + self.tokens.astype(np.uint64), return_inverse=True)
        trains = np.repeat(self.train, np.diff(self.offsets))
        self.counts = np.bincount(self.inverse[trains], minlength=len(pair))
        v, w = (pair // np.uint64(n + 1)).astype(np.int64), (pair % np.uint64(n + 1)).astype(np.int64)
        hashes = np.append(self.words, _BEGIN)
        w40 = mix(hashes[w] + np.uint64(1)) & _W40
        self.seen = np.append(totals, totals[-1])  # a text begins as often as it ends
        salt = np.where(self.seen[v] > hot, (w40 >> np.uint64(20)) % np.uint64(max(8, shards // SHARE)), np.uint64(0))
        shard = (mix(hashes[v] + salt * np.uint64(0xD1342543DE82EF95)) % np.uint64(shards)).astype(np.int64)
        by_hash = np.empty(n + 1, np.int64)
        by_hash[np.argsort(hashes, kind="stable")] = np.arange(n + 1)
        # Order by shard, then context hash; pairs are in order of context place, words inside it follow by their hash.
        self.all_w = w
        known = np.flatnonzero(self.seen[v] > 0)
        self.order = known[np.lexsort((w40[known], (shard[known] << 32) | by_hash[v[known]]))]
        self.v, self.w40, self.w = v[self.order], w40[self.order], w[self.order]
        self.bounds = np.searchsorted(shard[self.order], np.arange(shards + 1))
        self.hashes = hashes

    def heads(self, shard: int) -> np.ndarray:
        """Where each context of a shard begins, counted from the shard's first pair."""
        v = self.v[self.bounds[shard] : self.bounds[shard + 1]]
        return np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))


def _bigram_rows(row: dict, totals: np.ndarray, shards: int, hot: int):
    p = _Pairs(row, totals, shards, hot)
    counts = p.counts[p.order]
    for s in range(shards):
        a, b = p.bounds[s], p.bounds[s + 1]
        if a == b:
            continue
        v, heads = p.v[a:b], p.heads(s)
        yield s, p.hashes[v[heads]].tobytes(), _planes(p.seen[v[heads]]), _planes(np.diff(np.append(heads, b - a))), _pack40(p.w40[a:b]), _planes(counts[a:b])


def _totals(row: dict, shards: int) -> np.ndarray:
    """c(w) of a chunk's words (the end last), from the word shards' answers."""
    w, _, order, bounds = _word_rows(row, shards)
    out = np.zeros(len(w), np.int64)
    for s, raw in row["word_answers"]:
        out[order[bounds[s] : bounds[s + 1]]] = _unplanes(raw)
    return out


def _word_shard(table: pa.Table) -> pa.Table:
    """Adds up a word shard and answers each chunk."""
    keys = [np.frombuffer(x, np.uint64) for x in table["words"].to_pylist()]
    counts = [_unplanes(x) for x in table["counts"].to_pylist()]
    distinct, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(inverse, np.concatenate(counts), len(distinct)).astype(np.int64)
    ends = np.cumsum([len(k) for k in keys])
    answers = [_planes(total[x]) for x in np.split(inverse, ends[:-1])]
    n = len(answers)
    return pa.table({
        "chunk": table["chunk"], "shard": table["shard"], "answer": pa.array(answers, pa.binary()),
        "all_tokens": pa.array([int(total.sum())] * n, pa.int64()), "all_words": pa.array([int((total > 0).sum())] * n, pa.int64()),
    })


def _back_off(seen: np.ndarray, successors: np.ndarray, hot: int) -> np.ndarray:
    """The mass that contexts leave to the unigram."""
    prior = PRIOR * np.maximum(seen, 1.0) ** POWER
    return np.where(seen > hot, prior / (seen + prior), DISCOUNT * successors / np.maximum(seen, 1))


def _trie_shard(table: pa.Table, hot: int) -> pa.Table:
    """Builds a shard's trie from all chunks' counts; answers each chunk's pairs, then its contexts."""
    rows = []
    for r in table.select(["contexts", "seen", "lengths", "successors", "counts"]).to_pylist():
        rows.append((np.frombuffer(r["contexts"], np.uint64), _unplanes(r["seen"]), _unplanes(r["lengths"]).astype(np.int64), _unpack40(r["successors"]), _unplanes(r["counts"])))
    contexts, first, back = np.unique(np.concatenate([r[0] for r in rows]), return_index=True, return_inverse=True)
    seen = np.concatenate([r[1] for r in rows])[first].astype(np.float64)
    rank = np.repeat(back.astype(np.uint64), np.concatenate([r[2] for r in rows]))
    keys = (rank << np.uint64(40)) | np.concatenate([r[3] for r in rows])
    counts = np.concatenate([r[4] for r in rows])
    trained = counts > 0
    keys, inverse = np.unique(keys[trained], return_inverse=True)
    total = np.bincount(inverse, counts[trained], len(keys))
    of = (keys >> np.uint64(40)).astype(np.int64)
    used, starts = np.unique(of, return_index=True)
    often = seen[of] > hot
    logs = np.log10(np.where(often, total / (seen[of] + PRIOR * seen[of] ** POWER), (total - DISCOUNT) / seen[of])) if len(keys) else np.zeros(0)
    codes = np.round(np.clip(-logs / FLOOR, 0, 1) * STEPS).astype(np.uint16)
    trie = Trie(contexts[used], starts, keys & _W40, codes)
    successors = np.minimum(np.bincount(of, minlength=len(contexts)), HOT).astype(np.uint16)
    heads = np.split(back, np.cumsum([len(r[0]) for r in rows])[:-1])
    answers = [np.concatenate([trie.find(r[0], r[2], r[3]), successors[h]]) for r, h in zip(rows, heads, strict=True)]
    raw = [a.view(np.uint8).reshape(-1, 2).T.tobytes() for a in answers]
    return pa.table({"chunk": table["chunk"], "shard": table["shard"], "answer": pa.array(raw, pa.binary())})


def _per_chunk(answers: DataFrame, name: str) -> DataFrame:
    return answers.groupBy("chunk").agg(F.collect_list(F.struct("shard", "answer")).alias(name))


def _rows(batch: pa.RecordBatch):
    """Rows of a batch as dicts, one at a time; answers as (shard, bytes)."""
    for i in range(batch.num_rows):
        row = batch.slice(i, 1).to_pylist()[0]
        for name in ("word_answers", "pair_answers"):
            if name in row:
                row[name] = [(x["shard"], x["answer"]) for x in row[name] or []]
        yield row


def score(docs: DataFrame, train: F.Column | str, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """One row per text: id, train, n_tokens, n_known, train_tokens, base_score, score. train: which texts are learned from; hot: at
    most HOT."""
    spark = docs.sparkSession
    shards = max(16, 4 * shuffle_partitions(spark))
    buckets = shuffle_partitions(spark)
    flagged = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    kind = flagged.schema["id"].dataType.simpleString()
    name = f"lm_chunks_{uuid.uuid4().hex}"
    writer = chunks(flagged).write.option("compression", "zstd").bucketBy(buckets, "chunk")
    writer.saveAsTable(name, format="parquet")
    with dropped_after(spark) as drop:
        drop.table(name)
        table = spark.table(name)

        def send_words(batches):
            for batch in batches:
                for row in _rows(batch):
                    w, counts, order, bounds = _word_rows(row, shards)
                    some = [s for s in range(shards) if bounds[s] < bounds[s + 1]]
                    parts = [order[bounds[s] : bounds[s + 1]] for s in some]
                    columns = [
                        pa.array([row["chunk"]] * len(some), pa.int64()), pa.array(some, pa.int32()),
                        pa.array([w[x].tobytes() for x in parts], pa.binary()), pa.array([_planes(counts[x]) for x in parts], pa.binary()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=["chunk", "shard", "words", "counts"])

        # The ids are not needed to send.
        plain = table.select("chunk", "train", "lengths", "words", "tokens")
        sent = plain.mapInArrow(send_words, "chunk bigint, shard int, words binary, counts binary")
        answered = sent.groupBy("shard").applyInArrow(_word_shard, "chunk bigint, shard int, answer binary, all_tokens bigint, all_words bigint")
        word_answers = drop(settle_table(answered, "lm-words"))
        whole = word_answers.groupBy("shard").agg(F.first("all_tokens").alias("n"), F.first("all_words").alias("v"))
        totals = whole.agg(F.sum("n"), F.sum("v")).first()
        all_tokens, all_words = int(totals[0] or 0), int(totals[1] or 0)
        by_chunk = _per_chunk(word_answers.select("chunk", "shard", "answer"), "word_answers")

        def send_pairs(batches):
            for batch in batches:
                for row in _rows(batch):
                    made = list(zip(*_bigram_rows(row, _totals(row, shards), shards, hot), strict=True))
                    if not made:
                        continue
                    columns = [pa.array([row["chunk"]] * len(made[0]), pa.int64()), pa.array(made[0], pa.int32()), *(pa.array(c, pa.binary()) for c in made[1:])]
                    yield pa.RecordBatch.from_arrays(columns, names=["chunk", "shard", "contexts", "seen", "lengths", "successors", "counts"])

        schema = "chunk bigint, shard int, contexts binary, seen binary, lengths binary, successors binary, counts binary"
        sent = plain.join(by_chunk, "chunk").mapInArrow(send_pairs, schema)
        pair_answers = drop(settle_table(sent.groupBy("shard").applyInArrow(lambda t: _trie_shard(t, hot), "chunk bigint, shard int, answer binary"), "lm-pairs"))
        # A chunk without a known context has no answers.
        both = table.join(by_chunk, "chunk").join(_per_chunk(pair_answers, "pair_answers"), "chunk", "left")

        id_type = _ID_TYPES[kind]

        def finish(batches):
            for batch in batches:
                for row in _rows(batch):
                    counts = _totals(row, shards)
                    p = _Pairs(row, counts, shards, hot)
                    unigram = np.log10((counts + 0.1) / (all_tokens + 0.1 * (all_words + 1)))
                    codes, successors = np.empty((2, len(p.order)), np.uint16)
                    for s, raw in row["pair_answers"]:
                        answer = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(2, -1).T).view(np.uint16).reshape(-1)
                        a, b = p.bounds[s], p.bounds[s + 1]
                        codes[a:b] = answer[: b - a]
                        successors[a:b] = np.repeat(answer[b - a :], np.diff(np.append(p.heads(s), b - a)))
                    own = np.where(codes <= STEPS, 10.0 ** (codes * (-FLOOR / STEPS)), 0.0)
                    logs = unigram[p.all_w]
                    logs[p.order] = np.log10(own + _back_off(p.seen[p.v].astype(float), successors, hot) * 10.0 ** unigram[p.w])
                    heads = p.offsets[:-1]
                    columns = [
                        pa.array(row["ids"], id_type),
                        pa.array(p.train), pa.array(np.diff(p.offsets)), pa.array(np.add.reduceat((counts > 0)[p.tokens].astype(np.int64), heads)),
                        pa.array(np.add.reduceat(unigram[p.tokens], heads)), pa.array(np.add.reduceat(logs[p.inverse], heads)),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=["id", "train", "n_tokens", "n_known", "base_score", "score"])

        schema = f"id {kind}, train boolean, n_tokens bigint, n_known bigint, base_score double, score double"
        found = settle_table(both.mapInArrow(finish, schema), "lm-scores")
    return found.select(
        F.col("id").alias(id_col), "train", "n_tokens", "n_known", F.lit(all_tokens).cast("bigint").alias("train_tokens"), "base_score", "score"
    )


def op5_lm_score(spark, sf_dir):
    remainder = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(10))
    found = score(documents(spark, sf_dir), remainder != 0)
    return found.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
