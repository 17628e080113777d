"""Near-duplicate detection by min-max hashing, exact on what it links.

1. Each text becomes its set of 2-word shingles (64-bit hashes); equal sets are one class from here on, named by a digest of
   the set, so that copies are never paired.
2. Under each of PERMUTATIONS permutations a set keeps both its minimum and its maximum: two signature values for one hash
   evaluation. Bands of four values are the keys of buckets.
3. In every bucket, and in every bucket of two neighbouring bands, all members are compared with one hub, the member that
   shares most buckets with others (an original has more of them than its edited copies), on the full sets: about one
   comparison for a member and hub. Connected components follow by minima of stars.
4. What a bucket still holds apart is compared exactly: its members outside its largest component with all members of other
   components, in blocks of bounded size, each pair in the first bucket that it shares. Then every pair of members of a
   bucket is compared or connected already, so that no link inside a bucket is lost. Pairs are never rows.

With 48 permutations there are 24 bands of 4 values: two sets of similarity 0.8 share no bucket with probability 4e-6.

Full sets reach a comparison packed, six bytes a shingle (a false match inside one pair of sets of 400 shingles has
probability 6e-10). Everything large stays in tables in the shared folder; no list of documents reaches the driver.

Defined cases: texts without words (or null) have an empty set, are linked with nothing and are kept; one word makes one
shingle of the whole sequence; repeated rows of one identifier have one component if their texts are equal, and are separate
documents of one name if not; rows of null identifier are linked with nothing and kept; texts of any length are read whole;
an empty table gives an empty result; other columns, whatever their names, are carried only by ``keep_first``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytesops import flat, mix, pieces, words
from .common import documents, settle, settle_table, shuffle_partitions, tidy

PERMUTATIONS, ROWS = 48, 4
SHINGLE = 2
#: Members on either side of a block of comparisons.
BLOCK = 256
#: Shingle hashes are compared by their low 48 bits.
_MASK = np.uint64((1 << 48) - 1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, rising, end to end, and their offsets."""
    h, at = words(data, offsets)
    made = []
    # Hashes of size consecutive words; those that reach into the next text are skipped below.
    rolled = h.copy()
    for k in range(1, size):
        rolled = mix(rolled[: len(h) - k] * np.uint64(3) + h[k:]) if len(h) > k else rolled[:0]
    for i in range(len(at) - 1):
        first, last = at[i], at[i + 1]
        if last - first >= size:
            made.append(np.unique(rolled[first : last - size + 1]))
        elif last > first:  # fewer words: the whole sequence
            x = np.array([last - first], np.uint64)
            for v in h[first:last]:
                x = mix(x * np.uint64(5) + v)
            made.append(x)
        else:
            made.append(h[:0])
    lengths = np.array([len(m) for m in made], np.int64)
    return (np.concatenate(made) if made else h[:0]), np.concatenate([[0], np.cumsum(lengths)])


def _seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    x = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return x[:n] | np.uint64(1), x[n:]


def bands(hashes: np.ndarray, offsets: np.ndarray, permutations: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band of each non-empty set: (sets, bands)."""
    a, b = _seeds(permutations)
    heads = offsets[:-1]
    signature = np.empty((len(heads), 2 * permutations), np.uint64)
    for i in range(permutations):
        v = hashes * a[i]
        v ^= v >> np.uint64(32)
        v *= b[i] | np.uint64(1)
        signature[:, 2 * i] = np.minimum.reduceat(v, heads)
        signature[:, 2 * i + 1] = np.maximum.reduceat(v, heads)
    keys = np.zeros((len(heads), 2 * permutations // rows), np.uint64)
    for j in range(rows):
        keys = mix(keys * np.uint64(7) + signature[:, j::rows])
    return keys + np.arange(1, keys.shape[1] + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def signatures(docs: DataFrame, id_col: str, text_col: str, size: int, permutations: int, rows: int) -> DataFrame:
    """id, mark (a hash of the text), n (shingles), class (a digest of the set), bands (array, empty for empty sets)."""

    def run(batches):
        for batch in tidy(batches):
            data, offsets = flat(batch.column(1))
            for i, j in pieces(offsets):
                hashes, at = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], size)
                n = np.diff(at)
                some = n > 0
                heads = at[:-1][some]
                keys = np.zeros((0, 2 * permutations // rows), np.uint64)
                if len(heads):
                    keys = bands(hashes, np.append(heads, at[-1]), permutations, rows)
                keys_of = digests(hashes, at)
                ends = np.concatenate([[0], np.cumsum(some * keys.shape[1])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.reshape(-1).view(np.int64)))
                columns = [batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), pa.array(n), pa.array(keys_of.view(np.int64)), lists]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "mark", "n", "class", "bands"])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, mark bigint, n bigint, class bigint, bands array<bigint>"
    return docs.select(id_col, text_col, F.xxhash64(text_col)).mapInArrow(run, schema)


def digests(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit digest of each set."""
    out = np.zeros(len(at) - 1, np.uint64)
    some = at[1:] > at[:-1]
    if some.any():
        sums = (np.add.reduceat(mix(hashes ^ np.uint64(x)), at[:-1][some]) for x in (0xA5A5A5A5A5A5A5A5, 0x123456789ABCDEF1))
        out[some] = mix(next(sums)) + next(sums)
    return out


def packed_sets(docs: DataFrame, size: int) -> DataFrame:
    """docs (id, text) as id, n, packed: the set's hashes, low 48 bits, rising; only texts whose set has the digest id."""

    def run(batches):
        for batch in tidy(batches):
            data, offsets = flat(batch.column(1))
            for i, j in pieces(offsets):
                hashes, at = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], size)
                packed = [_pack(np.unique(hashes[a:b] & _MASK)) for a, b in zip(at[:-1], at[1:], strict=True)]
                columns = [batch.column(0).slice(i, j - i), pa.array(np.diff(at)), pa.array(packed, pa.binary())]
                made = pa.RecordBatch.from_arrays(columns, names=["id", "n", "packed"])
                yield made.filter(pa.array(digests(hashes, at).view(np.int64) == columns[0].to_numpy()))

    return docs.select("id", "text").mapInArrow(run, "id bigint, n bigint, packed binary")


def _pack(hashes: np.ndarray) -> bytes:
    return hashes.view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    raw = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :6] = raw
    return out.view(np.uint64).reshape(-1)


def _intersections(one: np.ndarray, many: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of one sorted set with sets that lie end to end."""
    at = np.minimum(np.searchsorted(one, many), len(one) - 1)
    return np.add.reduceat((one[at] == many).astype(np.int64), heads)


def _salts(df: DataFrame) -> int:
    return max(64, shuffle_partitions(df.sparkSession))


def looked_up(rows: DataFrame, by: str, few: DataFrame) -> DataFrame:
    """rows joined (left) with few, which has each value of by once: a value that many rows have is dealt over salts."""
    rows = rows.withColumn("salt", F.pmod(F.xxhash64(*rows.columns), F.lit(_salts(rows))))
    used = rows.select(by, "salt").distinct().join(few, by)
    return rows.join(used, [by, "salt"], "left").drop("salt")


def linked(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Of the pairs (hub, other): those with 100 * intersection >= threshold * union of their full sets.

    The hub's side of the second join may be hot: rows are dealt over salts by the other's identifier, and the hub's set
    is repeated for salts in use only.
    """
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("other"), F.lit(_salts(pairs))))
    hubs = salted.select("hub", "salt").distinct().join(sets.select(F.col("id").alias("hub"), F.col("packed").alias("hub_set")), "hub")
    other = sets.select(F.col("id").alias("other"), F.col("packed").alias("other_set"))
    both = salted.join(other, "other").join(hubs, ["hub", "salt"]).select("hub", "other", "hub_set", "other_set")

    def run(batches):
        for batch in tidy(batches):
            keep, last, last_set = [], None, None
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                a, b = a.as_buffer(), b.as_buffer()
                if last is None or not a.equals(last):
                    last, last_set = a, _unpack(a)
                x = _unpack(b)
                common = int(_intersections(last_set, x, np.zeros(1, np.int64))[0])
                keep.append(100 * common >= threshold * (len(last_set) + len(x) - common))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    kind = sets.schema["id"].dataType.simpleString()
    return both.mapInArrow(run, f"hub {kind}, other {kind}")


def _mark(edges: DataFrame) -> tuple:
    """Equal for equal sets of edges (and, but for a chance of 2**-64, for those alone)."""
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(edges: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """edges (a, b) as id, root: the least identifier of each vertex's component.

    Minimum label propagation over stars: every vertex hands its neighbours' least label to its neighbours and to its
    old label, so that stars merge and path lengths halve; rounds grow with the logarithm of the longest path.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()
    edges = settle(edges)
    mark = _mark(edges)
    while True:
        # Large star: each vertex links its larger neighbours to the least of its neighbours and itself.
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # The neighbour lists of hot vertices are not gathered: the least label joins the edges instead.
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a > b").distinct()
        # Small star: each vertex links its smaller neighbours and itself to the least of them.
        small_least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(small_least.select("a", F.col("m").alias("b")))
        edges = settle(small.where("a > b").distinct())
        mark, last = _mark(edges), mark
        if mark == last:
            break
    return edges.select(F.col("a").alias("id"), F.col("b").alias("root"))


def star_pairs(keyed: DataFrame, threshold: int) -> DataFrame:
    """Distinct pairs (hub, other) of keyed rows (key, id, n): all members of a key with its hub, if their sizes allow a link."""
    sizes = settle(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"))
    members = keyed.join(sizes, "key")
    degree = members.groupBy("id").agg(F.sum("size").alias("degree"))
    members = settle_table(members.select("key", "id", "n").join(degree, "id"), "minhash-members")
    best = F.max(F.struct("degree", F.xxhash64("id").alias("tie"), "id", "n")).alias("best")
    hubs = settle(members.groupBy("key").agg(best).select("key", F.col("best.id").alias("hub"), F.col("best.n").alias("hub_n")))
    close = F.least("hub_n", "n") * 100 >= F.greatest("hub_n", "n") * threshold
    pairs = members.join(hubs, "key").where((F.col("id") != F.col("hub")) & close)
    return pairs.select("hub", F.col("id").alias("other")).distinct()


def remaining(buckets: DataFrame, roots: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Links (a, b) between members of different components in a bucket (band, bucket, id, n), compared exactly in blocks.

    A block meets BLOCK members outside the bucket's largest component with BLOCK members of the bucket: rows grow with members
    times blocks. A pair that shares several buckets is compared in the first of them.
    """
    named = buckets.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    sizes = named.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("c"))
    largest = F.max(F.struct("c", "root")).alias("largest")
    stats = sizes.groupBy("bucket").agg(F.sum("c").alias("all"), largest, F.count(F.lit(1)).alias("parts")).where("parts > 1")
    stats = stats.select("bucket", F.col("largest.root").alias("main"), F.ceil(F.col("all") / BLOCK).alias("cols"), F.ceil((F.col("all") - F.col("largest.c")) / BLOCK).alias("rows"))
    open_ = settle_table(named.join(settle(stats), "bucket"), "minhash-open")
    spread = lambda n, mark: F.pmod(F.xxhash64("id", F.lit(mark)), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n.cast("int") - 1))
    place = ["bucket", "row", "col"]
    few = open_.where("root <> main").withColumn("row", spread(F.col("rows"), "row")).withColumn("col", every(F.col("cols")))
    many = open_.withColumn("col", spread(F.col("cols"), "col")).withColumn("row", every(F.col("rows")))
    columns = [*place, "id", "root", "main", "bands", "packed"]
    few, many = (x.select(*place, "id", "root", "main").join(sets.select("id", "bands", "packed"), "id").select(*columns) for x in (few, many))
    kind = sets.schema["id"].dataType.simpleString()
    # The sides come from the same rows: other names keep their columns apart.
    few, many = (x.toDF(*(f"{side}_{c}" for c in columns)) for x, side in ((few, "few"), (many, "many")))
    sides = [x.groupBy(*x.columns[: len(place)]) for x in (few, many)]
    return sides[0].cogroup(sides[1]).applyInArrow(_compare_blocks(threshold, columns), f"a {kind}, b {kind}")


def _compare_blocks(threshold: int, columns: list[str]):
    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.rename_columns(columns), right.rename_columns(columns)
        found: list[tuple] = []
        if left.num_rows and right.num_rows:
            bucket = left["bucket"][0].as_py()
            ids, roots = right["id"].to_pylist(), np.array(right["root"].to_pylist())
            bands = np.array(right["bands"].to_pylist(), np.int64)
            sets = [_unpack(x) for x in right["packed"].to_pylist()]
            sizes = np.array([len(x) for x in sets])
            flat_sets, ends = np.concatenate(sets), np.cumsum(sizes)
            order = np.arange(len(flat_sets))
            linked_roots: set[tuple] = set()
            for id_, root, main, own_bands, raw in zip(*(left[c].to_pylist() for c in ("id", "root", "main", "bands", "packed")), strict=True):
                one = _unpack(raw)
                shared = bands == np.array(own_bands, np.int64)
                first = shared.argmax(1)
                here = bands[np.arange(len(ids)), first] == bucket
                close = np.minimum(sizes, len(one)) * 100 >= np.maximum(sizes, len(one)) * threshold
                # Both members outside the main component: one direction is enough.
                once = (roots == main) | np.array([i > id_ for i in ids])
                chosen = np.flatnonzero(here & close & once & (roots != root))
                chosen = np.array([c for c in chosen if (root, roots[c]) not in linked_roots], np.int64)
                if not len(chosen):
                    continue
                parts = np.concatenate([order[ends[c] - sizes[c] : ends[c]] for c in chosen])
                heads = np.concatenate([[0], np.cumsum(sizes[chosen])[:-1]])
                common = _intersections(one, flat_sets[parts], heads)
                for c in chosen[100 * common >= threshold * (len(one) + sizes[chosen] - common)]:
                    if (root, roots[c]) not in linked_roots:
                        linked_roots.add((root, roots[c]))
                        found.append((id_, ids[c]))
        kind = left.schema.field("id").type
        return pa.table({"a": pa.array([f[0] for f in found], kind), "b": pa.array([f[1] for f in found], kind)})

    return compare


def _components(docs: DataFrame, id_col: str, text_col: str, size: int, threshold: int, permutations: int, rows: int) -> DataFrame:
    """id, mark (a hash of the text), n, component_id: one row for each row of docs."""
    nameless = docs.where(F.col(id_col).isNull())
    docs = docs.where(F.col(id_col).isNotNull())
    signed = settle_table(signatures(docs, id_col, text_col, size, permutations, rows), "minhash-signatures")
    # Empty sets are linked with nothing, not even with one another.
    some = signed.where("n > 0")
    # From here on, id is the class; its first member is the least identifier.
    classes = some.groupBy(F.col("class").alias("id")).agg(F.min("id").alias("first"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    classes = settle_table(classes, "minhash-classes")
    keys = classes.select("id", "n", F.explode("bands").alias("key"))
    counted = settle(keys.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key"))
    buckets = settle_table(keys.join(counted, "key"), "minhash-buckets")
    own = settle_table(classes.join(buckets.select("id").distinct(), "id", "left_semi"), "minhash-candidates")
    # The text of the first member; where rows of that identifier have other texts, their sets have other digests.
    named = docs.select(F.col(id_col).alias("first"), F.col(text_col).alias("text"))
    texts = named.join(own.select("first", "id"), "first").withColumn("mark", F.xxhash64("text"))
    sets = settle_table(packed_sets(texts.dropDuplicates(["first", "id", "mark"]), size).dropDuplicates(["id"]), "minhash-sets")
    # Two neighbouring bands together: members that share both are closer to each other than to most of the bucket.
    after = F.element_at("bands", F.pmod(F.col("place") + 1, F.size("bands")) + 1)
    pairs_of_bands = own.select("id", "n", "bands", F.posexplode("bands").alias("place", "band"))
    doubled = pairs_of_bands.select(F.xxhash64("band", after).alias("key"), "id", "n")
    pairs = settle_table(star_pairs(buckets.select("key", "id", "n").union(doubled.select("key", "id", "n")), threshold), "minhash-pairs")
    found = settle(linked(pairs, sets, threshold).select(F.col("hub").alias("a"), F.col("other").alias("b")))
    roots = components(found)
    both = sets.join(own.select("id", "bands"), "id")
    more = settle(remaining(buckets.select(F.col("key").alias("bucket"), "id", "n"), roots, both, threshold))
    if not more.isEmpty():
        roots = components(more.union(roots.select(F.col("id").alias("a"), F.col("root").alias("b"))))
    # Every class of a component gets the least identifier of all of them.
    linked_ = settle(roots.select("id", "root").union(roots.select("root", "root").distinct()).distinct().join(own.select("id", "first"), "id"))
    least = linked_.groupBy("root").agg(F.min("first").alias("least"))
    answer = looked_up(linked_.select("id", "root"), "root", least).select(F.col("id").alias("class"), "least")
    answer = classes.select(F.col("id").alias("class"), "first").join(answer, "class", "left").select("class", F.coalesce("least", "first").alias("component_id"))
    out = looked_up(some.select("id", "mark", "n", "class"), "class", answer).select("id", "mark", "n", "component_id")
    alone = signed.where("n = 0").select("id", "mark", "n", F.col("id").alias("component_id"))
    lone = signatures(nameless, id_col, text_col, size, permutations, rows).select("id", "mark", "n", F.col("id").alias("component_id"))
    return out.unionByName(alone).unionByName(lone)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, threshold: int = 80,
                    permutations: int = PERMUTATIONS, rows: int = ROWS) -> DataFrame:
    """One row per document: id, n_shingles, component_id, kept."""
    return _components(docs, id_col, text_col, size, threshold, permutations, rows).select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept")
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, threshold: int = 80,
               permutations: int = PERMUTATIONS, rows: int = ROWS) -> DataFrame:
    """The rows of docs of the smallest identifier of each component, with their columns as they are."""
    found = _components(docs, id_col, text_col, size, threshold, permutations, rows)
    kept = found.where(F.col("id").eqNullSafe(F.col("component_id"))).select(F.col("id").alias("__kept"), F.col("mark").alias("__mark")).distinct()
    same = docs[id_col].eqNullSafe(F.col("__kept")) & (F.xxhash64(docs[text_col]) == F.col("__mark"))
    return docs.join(kept, same, "left_semi")


def op9_minhash(spark, sf_dir):
    return near_duplicates(documents(spark, sf_dir))
