"""BPE encoding and decoding: exact merges in linear time, without running the merges.

A word is matched from left to right: an Aho-Corasick automaton gives every vocabulary token that occurs in it, the longest
token at the current place is tried first, and it is accepted only if the merge order could not have joined it differently
with the token before (the pair-compatibility table). If no prefix fits, the last token is given up for its next shorter
prefix; a place that failed is never tried again, so that the work stays linear in the word's length. Decoding takes each
id's bytes from one blob by an offset table.

The compatibility of a pair is computed by undoing merges from both sides (the test of pairs that the backtracking encoders
in public byte-pair libraries use) and memoised: a table of fixed size holds pairs met lately.
Encodings of words, and of runs without white space, are memoised too, in tables of bounded size. The vocabulary reaches executors inside a broadcast of
the file's bytes (its size is that of the vocabulary, not of the data).

Defined cases: null and empty texts have no tokens and decode to the empty string; the strings of special tokens in a text
become their ids, as the library does by default; other columns are kept by ``encode`` and never clash (see its names).
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from array import array

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import documents, tidy

#: Runs without white space whose encodings are remembered in a Python worker (half as many words), and their longest length.
REMEMBERED, REMEMBERED_BYTES = 300_000, 64
#: Places of the table of remembered pairs, eight bytes each; a pair displaces the one that had its place.
PAIRS = (1 << 20) - 3
#: Code points that stand for the bytes, and for a word's last byte.
_INNER, _LAST = 0, 0x100
#: White space as the library has it; str.split() also splits at the four separators.
_SPACES, _SEPARATORS = regex.compile(r"[\s--[\x1c-\x1f]]+", regex.V1), regex.compile("[\x1c-\x1f]")


def _byte_letters() -> dict[str, int]:
    """The byte for each letter of the byte-level alphabet: printable Latin-1 stands for itself, the rest follow from 256."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Remembered:
    """A mapping of at most so many keys: the younger half takes new ones in, the older half is given up when that is full."""

    def __init__(self, most: int):
        self.half, self.young, self.old = most // 2, {}, {}

    def get(self, key: str) -> bytes | None:
        found = self.young.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key: str, value: bytes) -> None:
        if len(key) <= REMEMBERED_BYTES:
            if len(self.young) >= self.half:
                self.old, self.young = self.young, {}
            self.young[key] = value


class Tokenizer:
    """A BPE vocabulary with word ends whose ids follow the merge order, read from a tokenizers file's content."""

    def __init__(self, content: bytes):
        spec = json.loads(content)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"]
        letters = _byte_letters()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._special = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self._words = regex.compile(split)
        size = max([*model["vocab"].values(), *self.special.values()]) + 1
        symbols: dict[int, str] = {}
        texts: list[bytes] = [b""] * size
        # decode() without a decoder joins the tokens' own strings by a space.
        for token, i in model["vocab"].items():
            texts[i] = token.encode()
            ended = token.endswith(self.suffix)
            raw = [letters[c] for c in (token.removesuffix(self.suffix) if ended else token)]
            symbols[i] = "".join(chr(_INNER + b) for b in raw[: len(raw) - ended]) + (chr(_LAST + raw[-1]) if ended else "")
        for token, i in self.special.items():
            texts[i] = token.encode()
        ids = {s: i for i, s in symbols.items()}
        # Offsets into one blob; each token is followed by the joining space.
        self.offsets = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)
        self.blob = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        self.length = {i: len(s) for i, s in symbols.items()}
        self.left = list(range(size))
        self.right = list(range(size))
        self.pairs: dict[tuple[int, int], int] = {}
        vocab = model["vocab"]
        for a, b in model["merges"]:
            left, right, whole = vocab[a], vocab[b], vocab[a + b]
            if (left, right) not in self.pairs:
                self.pairs[left, right] = whole
                self.left[whole], self.right[whole] = left, right
        self._fits = array("q", [-1]) * PAIRS
        self._size = size
        # Tokens that their own string does not merge to are never the answer.
        usable = {s: i for s, i in ids.items() if len(s) == 1 or (self.left[i] != i and self._compatible(self.left[i], self.right[i], i))}
        self.whole = usable
        self.automaton = ahocorasick.Automaton()
        self.shorter = [-1] * size
        for s, i in usable.items():
            self.automaton.add_word(s, i)
            for end in range(len(s) - 1, 0, -1):
                if (j := usable.get(s[:end])) is not None:
                    self.shorter[i] = j
                    break
        self.automaton.make_automaton()
        self._names = [str(i) for i in range(size)]
        self._known, self._known_words = Remembered(REMEMBERED), Remembered(REMEMBERED // 2)

    def _compatible(self, first: int, second: int, limit: int) -> bool:
        """Whether merging would leave first and second side by side: no merge across the border comes before the last
        merges inside them. Undoes the later of the two tokens' merges, step by step, looking for an earlier one across."""
        while True:
            across = self.pairs.get((first, second))
            if across is not None and across < limit:
                return False
            if first > second:
                limit = first
                first = self.right[first]
                if first == limit:
                    limit = second + 1
                    second = self.left[second]
                    if second + 1 == limit:
                        return True
            else:
                limit = second + 1
                second = self.left[second]
                if second + 1 == limit:
                    limit = first
                    first = self.right[first]
                    if first == limit:
                        return True

    def fits(self, first: int, second: int) -> bool:
        key = first * self._size + second
        found = self._fits[key % PAIRS]
        if found >> 1 != key:
            found = self._fits[key % PAIRS] = 2 * key + self._compatible(first, second, 1 << 62)
        return bool(found & 1)

    def encode_word(self, raw: bytes) -> list[int]:
        """The ids of one word's bytes."""
        text = raw[:-1].decode("latin-1") + chr(_LAST + raw[-1])
        n = len(text)
        if (whole := self.whole.get(text)) is not None:
            return [whole]  # the longest match is the word itself, and nothing is before it
        longest = [0] * (n + 1)
        length, shorter, known, size = self.length, self.shorter, self._fits, self._size
        # Every key that ends at a place is reported, by rising ends: the last one noted for a start is the longest.
        for end, i in self.automaton.iter(text):
            longest[end + 1 - length[i]] = i
        ids: list[int] = []
        open_ = bytearray(b"\1") * (n + 1)
        at, token = 0, longest[0]
        while at < n:
            end = at + length[token]
            fits = bool(open_[end])
            if fits and ids:
                key = ids[-1] * size + token
                found = known[key % PAIRS]
                fits = found & 1 if found >> 1 == key else self.fits(ids[-1], token)
            if fits:
                ids.append(token)
                at = end
                token = longest[at]
            elif shorter[token] >= 0:
                token = shorter[token]
            else:
                open_[at] = 0
                token = ids.pop()
                at -= length[token]
        return ids

    def chunks(self, text: str) -> list[str]:
        """The normalised text, cut at white space, which no word crosses."""
        text = unicodedata.normalize("NFC", text)
        # Case by code point, as the library does: no final sigma.
        text = text.replace("Σ", "σ").lower()
        return _SPACES.split(text) if _SEPARATORS.search(text) else text.split()

    def _chunk(self, chunk: str) -> bytes:
        """The ids of a run without white space, packed."""
        found = self._known.get(chunk)
        if found is None:
            parts: list[bytes] = []
            for word in self._words.findall(chunk):
                known = self._known_words.get(word)
                if known is None:
                    known = array("i", self.encode_word(word.encode())).tobytes()
                    self._known_words.put(word, known)
                parts.append(known)
            found = b"".join(parts) if len(parts) != 1 else parts[0]
            self._known.put(chunk, found)
        return found

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of a text."""
        found: list[bytes] = []
        at, text = 0, text or ""
        spans = [(m.start(), m.end()) for m in self._special.finditer(text)] if self._special else []
        for start, end in [*spans, (len(text), len(text))]:
            get, make = self._known.young.get, self._chunk
            found += [get(c) or make(c) for c in self.chunks(text[at:start] if spans else text)]
            if end > start:
                found.append(np.array([self.special[text[start:end]]], np.int32).tobytes())
            at = end
        return np.frombuffer(b"".join(found), np.int32)

    def shown(self, ids: np.ndarray) -> str:
        """Ids in decimal, joined by spaces."""
        names = self._names
        return " ".join([names[i] for i in ids.tolist()])

    def decode(self, ids: np.ndarray) -> bytes:
        """The tokens' strings joined by a space, gathered from the blob at once."""
        if not len(ids):
            return b""
        start = self.offsets[ids]
        length = self.offsets[np.asarray(ids) + 1] - start
        ends = np.cumsum(length)
        place = np.arange(ends[-1]) + np.repeat(start - (ends - length), length)
        return self.blob[place].tobytes()[:-1]


_loaded: dict[str, Tokenizer] = {}


def tokenizer(key: str, content: bytes) -> Tokenizer:
    """The tokenizer of this Python worker, built once for each vocabulary."""
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Tokenizer(content)
    return _loaded[key]


def encode(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "token_ids", decoded_col: str | None = None,
           digests: bool = False) -> DataFrame:
    """docs with the token ids of text_col (array<int>) and, if named, the text decoded from them.

    With digests, instead: n_tokens, ids_sha256 and decoded_sha256 of the same ids and decoded bytes. A column of docs that
    has the name of a new column is replaced.
    """
    with open(path, "rb") as file:
        content = file.read()
    key = hashlib.sha256(content).hexdigest()
    shared = docs.sparkSession.sparkContext.broadcast(content)
    new = {ids_col: "array<int>"} | ({decoded_col: "string"} if decoded_col else {})
    if digests:
        new = {"n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}
    if digests:
        docs = docs.drop(*(c for c in new if c != text_col))
    kept = [f for f in docs.schema.fields if f.name not in new]
    names = [f.name for f in kept]
    docs = docs.select(*(f"`{n}`" for n in names)) if text_col in names else docs
    from pyspark.sql.types import StructType, _parse_datatype_string

    schema = StructType([*kept, *_parse_datatype_string(", ".join(f"`{k}` {v}" for k, v in new.items())).fields])

    def run(batches):
        t = tokenizer(key, shared.value)
        for batch in tidy(batches):
            columns = {n: batch.column(n) for n in names}
            made: list[list] = [[] for _ in new]
            for text in batch.column(text_col):
                ids = t.encode(text.as_py())
                if digests:
                    row = (len(ids), hashlib.sha256(t.shown(ids).encode()).hexdigest(), hashlib.sha256(t.decode(ids)).hexdigest())
                else:
                    row = (ids, t.decode(ids).decode("utf-8", "replace"))
                for column, value in zip(made, row, strict=False):
                    column.append(value)
            for (name, kind), values in zip(new.items(), made, strict=True):
                columns[name] = pa.array(values, {"array<int>": pa.list_(pa.int32()), "bigint": pa.int64(), "string": pa.string()}[kind])
            yield pa.RecordBatch.from_pydict(columns)

    return docs.mapInArrow(run, schema)


def op1_bpe(spark, sf_dir):
    import public_tokenizers

    docs = documents(spark, sf_dir).select("doc_id", "text")
    return encode(docs, public_tokenizers.path("word_bpe_49k.json"), digests=True).drop("text")
