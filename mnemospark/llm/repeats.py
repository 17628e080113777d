"""Removal of long repeated substrings by prefix-free parsing.

Each text is parsed at rolling-hash triggers: a place starts a phrase if a hash of the next TRIGGER bytes is divisible by
2**SPACING_BITS. Equal strings are parsed alike, so that the parse, not the text, is what is compared:

* Every WINDOW-byte string has an anchor, the first trigger at or after its start; a string without one near its start has
  the place of the least rolling hash. Neighbouring strings of one anchor make an entry: the text from the first of them to
  the end of the last. An entry's key is a hash of the KEY bytes at its anchor, which all its strings contain.
* Entries meet by key, as hashes. An entry that occurs again is repeated with all its strings, however long the repetition goes
  on, and nothing inside it is looked at: this is where highly repetitive text costs next to nothing. An entry alone under
  its key is unique with all its strings. Only entries that share a key with different ones are taken apart.
* These entries meet again with their bytes, and in every shard the parse is sorted: the dictionary (distinct phrases) and
  the parse (phrases by rank in it) each get their suffix array, and the two combine into the order of the strings: first the
  rank of the phrase's suffix, then the rank of the parse behind it. Neighbours in that order are compared byte by byte,
  and those with WINDOW bytes in common are repeated.
* A key with very many different entries (a passage that a large share of the documents have, each time in another
  context) would be one task's load. Its strings are dealt out by their own 128-bit hashes instead, and equal ones are repeats.

Entries are equal by a 64-bit hash under a 48-bit key, strings of crowded keys by 128 bits, all others by their bytes. Texts
stay in one table, bucketed by chunk, which three passes read in place (the last does not parse again); between passes each distinct entry of a chunk is
sent once, and answers of a few bits. As with the blocks of an exchange, there is a row for each chunk and shard.

Defined cases: null and empty texts have no bytes and lose none; texts shorter than WINDOW lose none; a text longer than CHUNK
is a chunk of its own; repeated rows repeat each other and are removed where they do; other columns, whatever their names,
are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import pickle
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytesops import eights, flat, hashes, mix, pieces
from .common import documents, dropped_after, settle_table, shuffle_partitions

WINDOW, KEY = 200, 64
TRIGGER, SPACING_BITS = 10, 5
#: Bytes of a chunk; different entries of one key beyond which the key is crowded, in a chunk and in all chunks together.
CHUNK, MANY, CROWD = 4 << 20, 64, 4096
_ID_TYPES = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
#: Answers for an entry: what is repeated as a whole, what is compared by bytes (and repeated anyway), what by hashes.
UNIQUE, REPEATED, COMPARE, SHOW, SPLIT = 0, 1, 2, 3, 4
#: In place of a shard: what a chunk keeps for itself.
OWN = -1
_W48 = np.uint64((1 << 48) - 1)
_SECOND = np.uint64(0xC2B2AE3D27D4EB4F)


def _pack48(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpack48(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).reshape(-1)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All places of the ranges [start, start + length), end to end."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def rolling(data: np.ndarray) -> np.ndarray:
    """A hash of the TRIGGER bytes from each place on that has so many."""
    if len(data) < TRIGGER:
        return np.zeros(0, np.uint64)
    eight = eights(data)
    n = len(data) - TRIGGER + 1
    out = eight[:n] * np.uint64(0x9E3779B97F4A7C15)
    out += eight[TRIGGER - 8 : TRIGGER - 8 + n]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    return out


def triggers(data: np.ndarray, offsets: np.ndarray, found: np.ndarray | None = None) -> np.ndarray:
    """The places that start a phrase; a trigger's bytes are in one text."""
    found = rolling(data) if found is None else found
    t = np.flatnonzero(found >> np.uint64(64 - SPACING_BITS) == 0)
    return t[t + TRIGGER <= offsets[np.searchsorted(offsets, t, "right")]] if len(t) else t


class Parse:
    """The entries of a chunk: strings [low, high] of one anchor each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, window: int = WINDOW):
        reach = window - KEY  # a string's anchor starts at most so far behind its start
        roll = rolling(data)
        t = triggers(data, offsets, roll)
        doc = np.searchsorted(offsets, t, "right") - 1
        start, stop = offsets[doc], offsets[doc + 1] - window  # the first and the last string's start
        previous = np.concatenate([[-1], t[:-1]]) + 1
        previous = np.maximum(previous, start)  # triggers of the text before do not count
        low, high = np.maximum(previous, t - reach), np.minimum(t, stop)
        some = low <= high
        low, high, at = low[some], high[some], t[some]
        bare = self._bare(offsets, low, high, window)
        if len(bare):
            more = self._least(roll, bare, reach)
            new = np.ones(len(bare), bool)
            new[1:] = (bare[1:] != bare[:-1] + 1) | (more[1:] != more[:-1])
            heads = np.flatnonzero(new)
            last = np.append(heads[1:], len(bare)) - 1
            low, high, at = np.append(low, bare[heads]), np.append(high, bare[last]), np.append(at, more[heads])
        self.data, self.window = data, window
        self.low, self.high, self.at = low, high, at
        self.key = hashes(data, at, at + KEY) & _W48
        self.entry = hashes(data, low, high + window, at - low + 1)

    @staticmethod
    def _bare(offsets: np.ndarray, low: np.ndarray, high: np.ndarray, window: int) -> np.ndarray:
        """The starts of strings without a trigger near their start: what the runs leave between them and at a text's end."""
        start, stop = offsets[:-1], offsets[1:] - window
        long = stop >= start
        start, stop = start[long], stop[long]
        edge = np.concatenate([low, stop + 1])
        order = np.argsort(edge, kind="stable")
        edge = edge[order]
        before = np.concatenate([[0], np.concatenate([high, stop])[order][:-1] + 1])
        before = np.maximum(before, start[np.searchsorted(start, edge, "right") - 1]) if len(edge) else before[:0]
        return ranges(before, np.maximum(edge - before, 0))

    @staticmethod
    def _least(roll: np.ndarray, bare: np.ndarray, reach: int) -> np.ndarray:
        """Of each place, where the least hash of it and the reach places behind it is, the first of equal ones."""
        new = np.ones(len(bare), bool)
        new[1:] = bare[1:] != bare[:-1] + 1
        heads = np.flatnonzero(new)
        lengths = np.diff(np.append(heads, len(bare)))
        zone = ranges(bare[heads], lengths + reach)
        first = np.cumsum(lengths + reach) - (lengths + reach)  # of each zone, its first place among all zones
        at = np.repeat(first, lengths) + (bare - np.repeat(bare[heads], lengths))
        least, width = (roll[zone] & ~np.uint64(0xFFFFFFFF)) | zone.astype(np.uint64), 1
        while 2 * width <= reach + 1:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        return (np.minimum(least[at], least[at + reach + 1 - width]) & np.uint64(0xFFFFFFFF)).astype(np.int64)

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The runs that stand for distinct (key, entry), in order, whether each occurs more than once here, each run's place
        among them, and whether the key is new."""
        order = np.lexsort((self.entry, self.key))
        k, e = self.key[order], self.entry[order]
        key = np.ones(len(order), bool)
        key[1:] = k[1:] != k[:-1]
        new = key.copy()
        new[1:] |= e[1:] != e[:-1]
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(new) - 1
        heads = np.flatnonzero(new)
        return order[heads], np.diff(np.append(heads, len(order))) > 1, place, key[heads]

    def strings(self, runs: np.ndarray) -> np.ndarray:
        """The starts of the strings of some runs."""
        return ranges(self.low[runs], self.high[runs] - self.low[runs] + 1)


def _firsts(new: np.ndarray) -> np.ndarray:
    """Of each place, the last one up to it that is new."""
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))


def suffix_ranks(symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Of each place, the rank of the rest of its string; symbols are above 0, ends are the places behind the strings.

    A suffix array by prefix doubling, with equal ranks for equal rests; strings lie end to end, and a rest stops at its end.
    A rank is one more than the number of smaller rests, so that each round sorts only those that are not yet told apart.
    """
    n = len(symbols)
    if not n:
        return symbols.astype(np.int64)
    lengths = np.diff(np.concatenate([[0], ends]))
    left = np.repeat(ends, lengths) - np.arange(n)
    # As many symbols at once as fit into an integer.
    bits = int(symbols.max()).bit_length()
    width = max(1, 63 // bits)
    key = np.zeros(n, np.int64)
    for k in range(width):
        key <<= bits
        key[: n - k] += np.where(left[: n - k] > k, symbols[k:], 0) if k else symbols
    order = np.argsort(key)
    key = key[order]
    new = np.append(True, key[1:] != key[:-1])
    rank = np.empty(n, np.int64)
    rank[order] = _firsts(new) + 1
    alone = new & np.append(new[1:], True)
    open_ = order[~alone]
    while len(open_ := open_[left[open_] >= width]):
        behind = np.minimum(open_ + width, n - 1)
        key = rank[open_] * (n + 1) + np.where(left[open_] > width, rank[behind], 0)
        order = np.argsort(key)
        open_, key = open_[order], key[order]
        old = rank[open_]
        new = np.append(True, key[1:] != key[:-1])
        rank[open_] = old + _firsts(new) - _firsts(np.append(True, old[1:] != old[:-1]))
        alone = new & np.append(new[1:], True)
        open_, width = open_[~alone], 2 * width
    return rank


def corpus_order(data: np.ndarray, ends: np.ndarray, strings: np.ndarray) -> np.ndarray:
    """The order of the rests of texts at the given places, by the suffix arrays of the dictionary and the parse of texts."""
    offsets = np.concatenate([[0], ends])
    cuts = np.union1d(triggers(data, offsets), offsets[:-1])
    text = np.searchsorted(ends, cuts, "right")
    # A phrase reaches over the next trigger's bytes.
    stops = np.minimum(np.append(cuts[1:], len(data)) + TRIGGER, ends[text])
    raw, known, phrase = data.tobytes(), {}, np.empty(len(cuts), np.int64)
    for i, (a, b) in enumerate(zip(cuts.tolist(), stops.tolist(), strict=True)):
        phrase[i] = known.setdefault(raw[a:b], len(known))
    sizes = np.array([len(p) for p in known], np.int64)
    dictionary = np.frombuffer(b"".join(known), np.uint8)
    in_dictionary = suffix_ranks(dictionary.astype(np.int64) + 1, np.cumsum(sizes))
    starts = np.cumsum(sizes) - sizes
    # The parse: each text's phrases by rank; the rest of the parse behind a text's last phrase is empty, rank 0.
    last = np.append(text[1:] != text[:-1], True)
    parse = suffix_ranks(in_dictionary[starts[phrase]], np.flatnonzero(last) + 1)
    behind = np.append(parse[1:], 0)
    behind[last] = 0
    of = np.searchsorted(cuts, strings, "right") - 1
    suffix = in_dictionary[starts[phrase[of]] + (strings - cuts[of])]
    return np.argsort(suffix * (len(parse) + 1) + behind[of], kind="stable")


def repeated(data: np.ndarray, ends: np.ndarray, strings: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Whether the window bytes at each place are those at another, too: neighbours in corpus order are compared in full."""
    order = corpus_order(data, ends, strings)
    a, b = strings[order[:-1]], strings[order[1:]]
    eight, same = eights(data), np.arange(len(a))
    for k in [*range(0, window - 8, 8), window - 8]:
        same = same[eight[a[same] + k] == eight[b[same] + k]]
    out = np.zeros(len(strings), bool)
    out[order[same]] = True
    out[order[same + 1]] = True
    return out


def chunks(docs: DataFrame) -> DataFrame:
    """docs (id, text) as chunks: ids, lengths and the bytes end to end."""
    kind = docs.schema["id"].dataType.simpleString()
    id_type = _ID_TYPES[kind]

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        ids, lengths, parts, size = [], [], [], 0

        def row():
            columns = [
                pa.array([number], pa.int64()), pa.array([ids], pa.list_(id_type)),
                pa.array([np.array(lengths, np.int64).tobytes()], pa.binary()), pa.array([b"".join(parts)], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(columns, names=["chunk", "ids", "lengths", "data"])

        for batch in batches:
            data, offsets = flat(batch.column(1))
            for i, j in pieces(offsets, CHUNK):
                more = int(offsets[j] - offsets[i])
                if ids and size + more > CHUNK:
                    yield row()
                    number += 1
                    ids, lengths, parts, size = [], [], [], 0
                ids += batch.column(0).slice(i, j - i).to_pylist()
                lengths += np.diff(offsets[i : j + 1]).tolist()
                parts.append(data[offsets[i] : offsets[j]].tobytes())
                size += more
        if ids:
            yield row()

    return docs.mapInArrow(run, f"chunk bigint, ids array<{kind}>, lengths binary, data binary")


def _parse(row: dict) -> Parse:
    return Parse(np.frombuffer(row["data"], np.uint8), np.concatenate([[0], np.cumsum(np.frombuffer(row["lengths"], np.int64))]))


class _Sent:
    """The distinct entries of a chunk, dealt over shards by key; of a key with MANY of them, one row stands for all."""

    def __init__(self, parse: Parse, shards: int):
        self.runs, self.again, self.place, new = parse.entries()
        group = np.cumsum(new) - 1
        self.many = np.bincount(group, minlength=1)[group] > MANY if len(group) else np.zeros(0, bool)
        self.key = parse.key[self.runs]
        self.shown = np.where(self.many, np.uint64(0), np.maximum(parse.entry[self.runs], np.uint64(1)))  # 0 stands for many
        kept = np.flatnonzero(~self.many | new)
        shard = (mix(self.key[kept] ^ np.uint64(0x2545F4914F6CDD1D)) % np.uint64(shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        #: The entries that are sent, in order of shards, and where each shard's begin.
        self.order, self.bounds = kept[order], np.searchsorted(shard[order], np.arange(shards + 1))

    def answers(self, row: dict) -> np.ndarray:
        found = np.zeros(len(self.key), np.uint8)
        for s, raw in row["entry_answers"]:
            found[self.order[self.bounds[s] : self.bounds[s + 1]]] = np.frombuffer(raw, np.uint8)
        found[self.many] = SPLIT
        return found


def _entry_answers(table: pa.Table, crowd: int) -> pa.Table:
    """Counts a shard's entries by key and tells each chunk what to do with its own."""
    keys = [_unpack48(x) for x in table["keys"].to_pylist()]
    entries = [np.frombuffer(x, np.uint64) for x in table["entries"].to_pylist()]
    again = [np.frombuffer(x, bool) for x in table["again"].to_pylist()]
    k, e, a = np.concatenate(keys), np.concatenate(entries), np.concatenate(again)
    order = np.lexsort((e, k))
    ks, es = k[order], e[order]
    new_key = np.ones(len(order), bool)
    new_key[1:] = ks[1:] != ks[:-1]
    new = new_key.copy()
    new[1:] |= es[1:] != es[:-1]
    entry, key = np.cumsum(new) - 1, np.cumsum(new_key) - 1
    repeats = (np.bincount(entry, 1 + a[order]) > 1)[entry]
    different = np.bincount(key, new)[key]
    single = np.bincount(key, ~repeats)[key] > 0  # some entry of the key occurs once
    answer = np.where(repeats, REPEATED, np.where(different == 1, UNIQUE, COMPARE)).astype(np.uint8)
    answer[repeats & (different > 1) & single & new] = SHOW  # one occurrence shows the strings of its entry
    answer[(np.bincount(key, es == 0)[key] > 0) | (different > crowd)] = SPLIT
    out = np.empty(len(order), np.uint8)
    out[order] = answer
    ends = np.cumsum([len(x) for x in keys])
    made = [x.tobytes() for x in np.split(out, ends[:-1])]
    return pa.table({"chunk": table["chunk"], "shard": table["shard"], "answer": pa.array(made, pa.binary())})


class _Open:
    """What of a chunk is compared: entries by their bytes, and distinct strings of crowded keys by their hashes."""

    def __init__(self, sent: _Sent, parse: Parse, decisions: np.ndarray, shards: int):
        self.parse = parse
        picked = np.flatnonzero((decisions[sent.order] == COMPARE) | (decisions[sent.order] == SHOW))
        self.runs, self.bounds = sent.runs[sent.order[picked]], np.searchsorted(picked, sent.bounds)
        self.counts = parse.high[self.runs] - parse.low[self.runs] + 1
        self.starts = parse.strings(np.flatnonzero(decisions[sent.place] == SPLIT))
        one, two = (hashes(parse.data, self.starts, self.starts + parse.window, seed) for seed in (0, _SECOND))
        order = np.lexsort((two, one))
        one, two = one[order], two[order]
        new = np.ones(len(order), bool)
        new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        self.inverse = np.empty(len(order), np.int64)
        self.inverse[order] = np.cumsum(new) - 1
        heads = np.flatnonzero(new)
        self.one, self.two, self.again = one[heads], two[heads], np.diff(np.append(heads, len(order))) > 1
        # The leading bits are the shard, so that the distinct hashes are in order of shards already.
        shard = ((self.one >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)
        self.hash_bounds = np.searchsorted(shard, np.arange(shards + 1, dtype=np.uint64))

    def sent(self, s: int) -> tuple[bytes, bytes, bytes, bytes] | None:
        """Counts of strings and bytes of a shard's entries, hashes of its strings, and whether these occur again here."""
        a, b = self.bounds[s : s + 2]
        c, d = self.hash_bounds[s : s + 2]
        if a == b and c == d:
            return None
        low, size = self.parse.low[self.runs[a:b]], self.counts[a:b] + self.parse.window - 1
        both = np.stack([self.one[c:d], self.two[c:d]], 1)
        return self.counts[a:b].astype(np.uint8).tobytes(), self.parse.data[ranges(low, size)].tobytes(), both.tobytes(), np.packbits(self.again[c:d]).tobytes()

    def pending(self, whole: np.ndarray) -> bytes:
        """What the chunk needs again when the answers are there; whole: the runs that are repeated anyway."""
        cover = _cover(len(self.parse.data), self.parse.low[whole], self.parse.high[whole] - self.parse.low[whole] + self.parse.window)
        return pickle.dumps((np.packbits(cover), self.parse.low[self.runs], self.counts, self.bounds, self.starts, self.inverse, self.hash_bounds))


def _cover(n: int, starts: np.ndarray, lengths: np.ndarray | int) -> np.ndarray:
    """Which of n places the ranges cover."""
    open_ = np.bincount(starts, minlength=n + 1) - np.bincount(starts + lengths, minlength=n + 1)
    return np.cumsum(open_)[:n] > 0


def _gone(pending: bytes, n: int, answers: list[tuple[int, bytes]]) -> np.ndarray:
    """Which bytes of a chunk are repeated, given what was pending and the shards' answers."""
    cover, low, counts, bounds, starts, inverse, hash_bounds = pickle.loads(pending)
    found, hit = [], np.zeros(hash_bounds[-1], bool)
    for s, raw in answers:
        a, b = bounds[s : s + 2]
        c, d = hash_bounds[s : s + 2]
        own = ranges(low[a:b], counts[a:b])
        bits = np.unpackbits(np.frombuffer(raw, np.uint8))[: len(own) + d - c].astype(bool)
        found.append(own[bits[: len(own)]])
        hit[c:d] = bits[len(own) :]
    strings = np.concatenate([*found, starts[hit[inverse]]])
    return np.unpackbits(cover)[:n].astype(bool) | _cover(n, strings, WINDOW)


def _string_answers(table: pa.Table) -> pa.Table:
    """Marks the strings of a shard that occur elsewhere, too: first those of entries, by corpus order, then those sent as hashes."""
    counts = [np.frombuffer(x, np.uint8).astype(np.int64) for x in table["counts"].to_pylist()]
    data = np.frombuffer(b"".join(table["data"].to_pylist()), np.uint8)
    sent = [np.frombuffer(x, np.uint64).reshape(-1, 2) for x in table["hashes"].to_pylist()]
    again = [np.unpackbits(np.frombuffer(x, np.uint8))[: len(f)] for x, f in zip(table["again"].to_pylist(), sent, strict=True)]
    every = np.concatenate(counts)
    ends = np.cumsum(every + WINDOW - 1)
    strings = ranges(ends - (every + WINDOW - 1), every)
    hit = repeated(data, ends, strings) if len(strings) else np.zeros(0, bool)
    hashed = np.concatenate(sent)
    order = np.lexsort((hashed[:, 1], hashed[:, 0]))
    same = np.zeros(len(order), bool)
    equal = (hashed[order[1:]] == hashed[order[:-1]]).all(1)
    same[1:] = equal
    same[:-1] |= equal
    hashed_hit = np.concatenate(again).astype(bool)
    hashed_hit[order] |= same
    by_entry = np.split(hit, np.cumsum([int(c.sum()) for c in counts])[:-1])
    by_hash = np.split(hashed_hit, np.cumsum([len(x) for x in sent])[:-1])
    made = [np.packbits(np.concatenate(x)).tobytes() for x in zip(by_entry, by_hash, strict=True)]
    return pa.table({"chunk": table["chunk"], "shard": table["shard"], "answer": pa.array(made, pa.binary())})


def _rows(batch: pa.RecordBatch):
    for i in range(batch.num_rows):
        row = batch.slice(i, 1).to_pylist()[0]
        for name in ("entry_answers", "string_answers"):
            if name in row:
                row[name] = [(x["shard"], x["answer"]) for x in row[name] or []]
        yield row


def _per_chunk(answers: DataFrame, name: str) -> DataFrame:
    return answers.groupBy("chunk").agg(F.collect_list(F.struct("shard", "answer")).alias(name))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, crowd: int = CROWD) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, the kept text (bytes that no
    longer form a character are replaced)."""
    spark: SparkSession = docs.sparkSession
    buckets = shuffle_partitions(spark)
    shards = max(16, 4 * buckets)
    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = named.schema["id"].dataType.simpleString()
    id_type = _ID_TYPES[kind]
    name = f"repeat_chunks_{uuid.uuid4().hex}"
    chunks(named).write.option("compression", "zstd").bucketBy(buckets, "chunk").saveAsTable(name, format="parquet")
    with dropped_after(spark) as drop:
        drop.table(name)
        table = spark.table(name)
        plain = table.select("chunk", "lengths", "data")
        answer = "chunk bigint, shard int, answer binary"

        def send_entries(batches):
            for batch in batches:
                for row in _rows(batch):
                    parse = _parse(row)
                    sent = _Sent(parse, shards)
                    some = [s for s in range(shards) if sent.bounds[s] < sent.bounds[s + 1]]
                    parts = [sent.order[sent.bounds[s] : sent.bounds[s + 1]] for s in some]
                    columns = [
                        pa.array([row["chunk"]] * len(some), pa.int64()), pa.array(some, pa.int32()),
                        pa.array([_pack48(sent.key[x]) for x in parts], pa.binary()),
                        pa.array([sent.shown[x].tobytes() for x in parts], pa.binary()),
                        pa.array([sent.again[x].tobytes() for x in parts], pa.binary()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=["chunk", "shard", "keys", "entries", "again"])

        sent = plain.mapInArrow(send_entries, "chunk bigint, shard int, keys binary, entries binary, again binary")
        answered = drop(settle_table(sent.groupBy("shard").applyInArrow(lambda t: _entry_answers(t, crowd), answer), "repeat-entries"))
        entry_answers = _per_chunk(answered, "entry_answers")

        def send_strings(batches):
            for batch in batches:
                for row in _rows(batch):
                    parse = _parse(row)
                    sent = _Sent(parse, shards)
                    decisions = sent.answers(row)
                    x = _Open(sent, parse, decisions, shards)
                    decisions = decisions[sent.place]
                    own = x.pending(np.flatnonzero((decisions == REPEATED) | (decisions == SHOW)))
                    made = [(OWN, None, own, None, None), *((s, *part) for s in range(shards) if (part := x.sent(s)))]
                    columns = [pa.array(c, k) for c, k in zip(zip(*made, strict=True), [pa.int32(), *[pa.binary()] * 4], strict=True)]
                    columns = [pa.array([row["chunk"]] * len(made), pa.int64()), *columns]
                    yield pa.RecordBatch.from_arrays(columns, names=["chunk", "shard", "counts", "data", "hashes", "again"])

        schema = "chunk bigint, shard int, counts binary, data binary, hashes binary, again binary"
        sent = plain.join(entry_answers, "chunk", "left").mapInArrow(send_strings, schema)
        sent = drop(settle_table(sent, "repeat-strings"))
        answered = sent.where(F.col("shard") != OWN).groupBy("shard").applyInArrow(_string_answers, answer)
        answered = drop(settle_table(answered, "repeat-answers"))
        own = sent.where(F.col("shard") == OWN).select("chunk", F.col("data").alias("pending"))
        both = table.join(own, "chunk").join(_per_chunk(answered, "string_answers"), "chunk", "left")

        def finish(batches):
            for batch in batches:
                for row in _rows(batch):
                    data = np.frombuffer(row["data"], np.uint8)
                    offsets = np.concatenate([[0], np.cumsum(np.frombuffer(row["lengths"], np.int64))])
                    yield _outcome(row["ids"], data, offsets, _gone(row["pending"], len(data), row["string_answers"]), id_type, with_text)

        schema = f"id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept_text string" * with_text
        found = settle_table(both.mapInArrow(finish, schema), "repeat-results")
    return found.withColumnRenamed("id", id_col)


def _outcome(ids: list, data: np.ndarray, offsets: np.ndarray, gone: np.ndarray, id_type: pa.DataType, with_text: bool) -> pa.RecordBatch:
    rising = gone.copy()
    rising[1:] &= ~gone[:-1]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    rising[heads] = gone[heads]
    removed = np.concatenate([[0], np.cumsum(gone)])
    spans = np.concatenate([[0], np.cumsum(rising)])
    kept = [data[a:b][~gone[a:b]].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    columns = [
        pa.array(ids, id_type), pa.array(np.diff(offsets)), pa.array(np.diff(removed[offsets])), pa.array(np.diff(spans[offsets])),
        pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
    ]
    names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    if with_text:
        columns.append(pa.array([k.decode("utf-8", "replace") for k in kept], pa.string()))
        names.append("kept_text")
    return pa.RecordBatch.from_arrays(columns, names=names)


def op10_repeats(spark, sf_dir):
    return remove_repeats(documents(spark, sf_dir))
