"""SimHash near-duplicates through a byte-position inverted index.

A fingerprint of 64 bits is eight bytes at eight positions.  Fingerprints that
differ in k bits or fewer (k at most 4) differ in k bytes or fewer, so they share
at least 8 - k >= 4 bytes at the same positions, and at least three of these lie
in the first seven positions.  The index therefore posts each *distinct*
fingerprint under its 35 triples of positional bytes; in every posting list the
shared positional bytes of a pair are tallied, pairs that reach the guaranteed
minimum are kept, and the bits are verified.

A posting list never gives all its pairs: it is searched breadth first, each
member found leaves the list, and only (member, root) links come out.  A list of
a dense group of m near copies therefore takes about m comparisons for its centre
and few for the rest.  Exact copies are one fingerprint before the index.
Components are found by :mod:`paritas.llm.components`.

Defined results: null, empty or blank text has fingerprint zero, which links like
any other; a component's id is the smallest non-null id in it (null if it has
none); each row gets a result, rows of one id each their own, equal rows equal ones; a
bit set in exactly half of the hashes is 0; texts of any length are read whole; an empty
table gives no rows.  Other columns aren't read (by the stage carried), whatever their
names.

The pipeline's stage (:func:`one_of_each_group`) has another rule: five-word shingles
with a Jaccard similarity of 0.8 or more.  Its first candidates come from the same index
over the fingerprints of those shingles.  But pairs of 0.8 differ in about ten bits of a
fingerprint and often in 18, where no byte need be shared, so bands of MinHash values
add those that the index can't reach.  Of a long list of a band only a spanning tree by SimHash
distances is verified at first; then, in every such list whose members aren't one
component yet, members of different components meet if their sketches are alike.
Each candidate is verified on its shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paritas.llm.common import arrow_schema, batches_out, partitions, small_batches, stored, text_batches, wide_hash
from paritas.llm.components import components

SHINGLE, SEED, MAX_BITS = 4, 42, 4
TRIPLES = list(combinations(range(7), 3))

#: The pipeline's stage: words of a shingle, similarity as a fraction, bands of MinHash values and values of each,
#: and the longest list of which all pairs are verified at once.
STAGE_SHINGLE, SIMILAR, BANDS, ROWS, SHORT_LIST = 5, (4, 5), 30, 5, 6
#: Members of a long list that one spanning tree joins, and how many of them join the next tree as well.
TREE, SHARED = 2048, 32
#: Of the BANDS * ROWS pairs of two low bits of MinHash values, how many may differ between members that are verified.  At
#: the similarity 22.5 differ on average, with a deviation of 4.4.
UNLIKE = 42
_WORDS = -(-BANDS * ROWS // 64)
_XOR, _ODD = np.random.default_rng(SEED).integers(0, 1 << 64, (2, BANDS * ROWS), np.uint64) | np.array([[0], [1]], np.uint64)


def fingerprint(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Bit by bit, the majority of the XXH64 of the word shingles, as a signed long."""
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    n = len(words) - shingle + 1
    if n <= 1:
        hashes = np.array([xxh64_intdigest(line, seed)], np.uint64)
    else:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths + 1) - 1
        starts = (ends - lengths)[:n].tolist()
        hashes = np.fromiter((xxh64_intdigest(line[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :].tolist())), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        counts += np.unpackbits(hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, fp of every row."""
    small_batches(docs.sparkSession)
    ddl = "doc_id long, fp long"
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in text_batches(batch, "__text"):
                yield batches_out({"doc_id": rows.column("__id"), "fp": [fingerprint(t, shingle, seed) for t in texts]}, schema)

    return docs.select(docs[id_col].cast("long").alias("__id"), docs[text_col].alias("__text")).mapInArrow(run, ddl)


def near(x: np.uint64, others: np.ndarray, max_bits: int) -> np.ndarray:
    """Which of others share enough positional bytes with x and differ in few enough bits."""
    differ = others ^ x
    shared = 8 - (differ.view(np.uint8).reshape(-1, 8) != 0).sum(axis=1)
    out = shared >= 8 - max_bits
    out[out] = np.bitwise_count(differ[out]) <= max_bits
    return out


def list_links(members: np.ndarray, max_bits: int, direct: bool = False) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links (member, root) that join the linked members of one posting list; direct: (member, the one that it was found from)."""
    found, roots = [], []
    rest = members
    while len(rest) > 1:
        root, rest = rest[0], rest[1:]
        open_ = [root]
        while open_ and len(rest):
            at = open_.pop()
            hit = near(at, rest, max_bits)
            if hit.any():
                new = rest[hit]
                found.append(new)
                roots.append(np.full(len(new), at if direct else root))
                open_.extend(new)
                rest = rest[~hit]
    return found, roots


def _triple_keys(fp: Column) -> Column:
    byte = [F.shiftrightunsigned(fp, 8 * i).bitwiseAND(0xFF) for i in range(7)]
    return F.array(*[F.lit(k << 24).cast("long") + byte[a] * 65536 + byte[b] * 256 + byte[c] for k, (a, b, c) in enumerate(TRIPLES)])


def links(distinct_fps: DataFrame, max_bits: int = MAX_BITS, direct: bool = False) -> DataFrame:
    """(a, b) of fingerprints: enough links to give the components of all pairs within max_bits; direct: each itself within max_bits."""
    if not 0 <= max_bits <= 4:
        raise ValueError("max_bits must be 0 to 4: the index relies on four shared bytes")
    ddl = "a long, b long"
    schema = arrow_schema(ddl)
    posted = distinct_fps.select("fp", F.explode(_triple_keys(F.col("fp"))).alias("key"))
    parts = partitions(distinct_fps)
    listed = posted.repartition(parts, "key").sortWithinPartitions("key", "fp").select("key", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        held_key = None
        found: list[np.ndarray] = []
        roots: list[np.ndarray] = []

        def close() -> None:
            nonlocal held
            members = np.concatenate(held) if held else np.zeros(0, np.uint64)
            held = []
            if len(members) > 1:
                f, r = list_links(members, max_bits, direct)
                found.extend(f)
                roots.extend(r)

        def out() -> pa.RecordBatch:
            a, b = np.concatenate(found).view(np.int64), np.concatenate(roots).view(np.int64)
            found.clear()
            roots.clear()
            return batches_out({"a": a, "b": b}, schema)

        for batch in batches:
            key = batch.column("key").to_numpy()
            fp = batch.column("fp").to_numpy().astype(np.int64).view(np.uint64)
            edges = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]))
            if not len(key):
                continue
            if held_key is not None and key[0] != held_key:
                close()
            sizes = np.diff(edges)
            for g in np.flatnonzero((sizes > 1) | (np.arange(len(sizes)) == 0) | (np.arange(len(sizes)) == len(sizes) - 1)).tolist():
                if g:
                    close()
                held = [*held, fp[edges[g] : edges[g + 1]]]
            held_key = key[-1]
            if sum(map(len, found)) > 10_000:
                yield out()
        close()
        if found:
            yield out()

    return listed.mapInArrow(run, ddl)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id, one row per row of docs."""
    rows = stored(fingerprints(docs, id_col, text_col, shingle, seed))
    one = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(one, max_bits))
    labelled = roots.union(roots.select("root", "root").distinct()).join(one.withColumnRenamed("fp", "node"), "node")
    smallest = labelled.groupBy("root").agg(F.min("least").alias("component"))
    of = labelled.join(smallest, "root").select(F.col("node").alias("fp"), "component")
    ids = one.join(of, "fp", "left").select("fp", F.when(F.col("component").isNotNull(), F.col("component")).otherwise(F.col("least")).alias("component_id"))
    ids = stored(ids)  # dealt anew by the join, so that AQE can split a fingerprint that many rows share
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return rows.join(ids, "fp").select("doc_id", hexed.alias("fingerprint"), "component_id")


# --- the pipeline's stage: pairs of five-word shingle sets with a Jaccard similarity of 0.8 or more --------------------


def shingles(text: str, size: int = STAGE_SHINGLE, seed: int = SEED) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; a text of fewer words is one shingle, one without words has none."""
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1)).tolist()
    last = ends[min(size, len(words)) - 1 :].tolist()
    return np.unique(np.fromiter((xxh64_intdigest(line[a:b], seed) for a, b in zip(starts, last)), np.uint64, len(last)))


def low_bits(values: np.ndarray) -> list[int]:
    """The lowest bit of each value, packed, then the next one of each."""
    bits = np.zeros((2, 64 * _WORDS), np.uint8)
    bits[0, : len(values)], bits[1, : len(values)] = values & np.uint64(1), (values >> np.uint64(1)) & np.uint64(1)
    return np.packbits(bits, bitorder="little").view("<i8").tolist()


def sketch(held: np.ndarray) -> tuple[int, int, list[int], list[int]]:
    """Of a shingle set: its 64-bit name, its SimHash, a key of each band of MinHash values, and their low bits."""
    if not len(held):
        return 0, 0, [], []
    from xxhash import xxh64_intdigest

    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(held), 4096):
        part = held[at : at + 4096]
        least = np.minimum(least, ((part ^ _XOR[:, None]) * _ODD[:, None]).min(axis=1))
        ones += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    fp = int(np.packbits(2 * ones > len(held), bitorder="little").view("<i8")[0])
    values = least.reshape(BANDS, ROWS).astype("<u8")
    keys = np.array([xxh64_intdigest(v.tobytes(), k) for k, v in enumerate(values)], np.uint64).view(np.int64).tolist()
    return int(np.uint64(xxh64_intdigest(held.astype("<u8").tobytes(), SEED)).astype(np.int64)), fp, keys, low_bits(least)


def nearest(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places: all of a short list, else those of a spanning tree that joins each to the nearest SimHash."""
    if len(fps) <= SHORT_LIST:
        return np.triu_indices(len(fps), 1)
    distance, to = np.full(len(fps), 255, np.uint8), np.zeros(len(fps), np.int64)
    done = np.zeros(len(fps), bool)
    order = [0]
    for _ in range(len(fps) - 1):
        now = order[-1]
        done[now] = True
        d = np.bitwise_count(fps ^ fps[now])
        closer = (d < distance) & ~done
        distance[closer], to[closer] = d[closer], now
        distance[now] = 255
        order.append(int(distance.argmin()))
    members = np.array(order[1:])
    return members, to[members]


def index_candidates(nodes: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """From (node, fp): pairs a < b of nodes that the byte-position index joins, equal fingerprints with the least node of each."""
    first = stored(nodes.groupBy("fp").agg(F.min("node").alias("least")))
    equal = nodes.select("node", "fp").join(first, "fp").where("node != least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    one, other = first.select(F.col("fp").alias("a"), F.col("least").alias("x")), first.select(F.col("fp").alias("b"), F.col("least").alias("y"))
    met = links(first, max_bits, direct=True).distinct().join(one, "a").join(other, "b")
    return equal.union(met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))


def candidates(nodes: DataFrame) -> DataFrame:
    """From (node, fp, bands): pairs a < b of nodes that share a band, as `nearest` picks them from each list, and the list's
    key if it is a long one.  A task holds TREE members of a list at once."""
    ddl = "a long, b long, key long"
    schema = arrow_schema(ddl)
    posted = nodes.select(F.explode("bands").alias("key"), "node", "fp")
    parts = partitions(nodes)
    listed = posted.repartition(parts, "key").sortWithinPartitions("key", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        held_key, size, long_list = None, 0, False

        def close(more: bool) -> Iterator[pa.RecordBatch]:
            """Pairs of what is held; if more of the list is to come, some members stay."""
            nonlocal size, long_list
            node, fp = (np.concatenate(x) for x in zip(*held)) if held else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
            long_list = more or long_list or len(node) > SHORT_LIST
            if len(node) > 1:
                i, j = nearest(fp)
                low, high = np.minimum(node[i], node[j]), np.maximum(node[i], node[j])
                yield batches_out({"a": low, "b": high, "key": pa.array([held_key if long_list else None] * len(low), pa.int64())}, schema)
            held.clear()
            size = 0
            if more:
                stay = np.linspace(0, len(node) - 1, SHARED).astype(np.int64)
                held.append((node[stay], fp[stay]))
            else:
                long_list = False

        for batch in batches:
            if not batch.num_rows:
                continue
            key, node = batch.column("key").to_numpy(), batch.column("node").to_numpy()
            fp = batch.column("fp").to_numpy().astype(np.int64).view(np.uint64)
            edges = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]))
            sizes = np.diff(edges)
            if held_key is not None and key[0] != held_key:
                yield from close(False)
            for g in np.flatnonzero((sizes > 1) | (np.arange(len(sizes)) == 0) | (np.arange(len(sizes)) == len(sizes) - 1)).tolist():
                if g:
                    yield from close(False)
                held_key = key[edges[g]]
                held.append((node[edges[g] : edges[g + 1]], fp[edges[g] : edges[g + 1]]))
                size += int(sizes[g])
                if size > TREE:
                    yield from close(True)
        yield from close(False)

    return listed.mapInArrow(run, ddl)


def alike(x: str, y: str) -> Column:
    """Whether two nodes of a list may be similar, by the sizes of their sets, the number of shingles that each shares with any
    other node (the most that they can have in common) and the low bits of their MinHash values."""
    n, m = F.col(f"{x}.size"), F.col(f"{y}.size")
    differ = [F.get(f"{x}.bits", i).bitwiseXOR(F.get(f"{y}.bits", i)) for i in range(2 * _WORDS)]
    unlike = sum((F.bit_count(differ[i].bitwiseOR(differ[i + _WORDS])) for i in range(_WORDS)), F.lit(0))
    whole = SIMILAR[0] + SIMILAR[1]
    enough = whole * F.least(f"{x}.common", f"{y}.common") >= SIMILAR[0] * (n + m)
    return (SIMILAR[1] * F.least(n, m) >= SIMILAR[0] * F.greatest(n, m)) & enough & (unlike <= UNLIKE)


def similar(x: Column, y: Column) -> Column:
    """Whether two arrays of distinct values reach the similarity, in whole numbers."""
    both = F.size(F.array_intersect(x, y))
    return SIMILAR[1] * both >= SIMILAR[0] * (F.size(x) + F.size(y) - both)


def alone(held: DataFrame) -> DataFrame:
    """From (node, held): node, and how many of its shingles no other node holds, where there are any."""
    once = held.select("node", F.explode("held").alias("shingle")).groupBy("shingle").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("node")).where("n = 1")
    return once.groupBy("node").agg(F.count(F.lit(1)).alias("alone"))


def crossing(docs: DataFrame, text_col: str, nodes: DataFrame, crowded: DataFrame, roots: DataFrame) -> DataFrame:
    """Similar pairs (a, b) that share a list of crowded (key) and lie in different components.

    Only lists that aren't one component are looked at, and in each the members outside its
    largest component against the others; a join on the list, so AQE can split a long one.
    The shingles are compared in the join, in the first list that a pair shares, so it gives
    links and no candidates.  (If that list is a short one, the pair has been verified.)
    """
    members = nodes.select(F.explode("bands").alias("key"), "node").join(crowded, "key").join(roots, "node", "left")
    members = stored(members.select("key", "node", F.coalesce("root", "node").alias("root")))
    sizes = members.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    mixed = sizes.groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("largest"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "largest")
    members = stored(members.join(mixed, "key"))
    held = _held(docs, text_col, nodes.join(members.select("node").distinct(), "node", "left_semi"))
    known = nodes.select("node", "bands", "bits", "size").join(alone(held), "node", "left").withColumn("common", F.col("size") - F.coalesce("alone", F.lit(0)))
    # what two similar sets share is four fifths of each, or more
    known = known.drop("alone").where(SIMILAR[1] * F.col("common") >= SIMILAR[0] * F.col("size")).join(held, "node")
    dealt = stored(members.join(known, "node"))
    x, y = dealt.where("root != largest").alias("x"), dealt.alias("y")
    apart = (F.col("x.root") != F.col("y.root")) & ((F.col("y.root") == F.col("y.largest")) | (F.col("x.node") < F.col("y.node")))
    first = F.get(F.array_intersect("x.bands", "y.bands"), 0) == F.col("x.key")
    met = x.join(y, (F.col("x.key") == F.col("y.key")) & apart & alike("x", "y") & first & similar(F.col("x.held"), F.col("y.held")))
    return stored(met.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")))


def _sketched(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, h1, h2 (128 bits of the text), node, size of its shingle set, fp, bands, bits of every row."""
    ddl = "doc_id long, h1 long, h2 long, node long, size long, fp long, bands array<long>, bits array<long>"
    schema = pa.schema([*arrow_schema("doc_id long, h1 long, h2 long, node long, size long, fp long"), ("bands", pa.list_(pa.int64())), ("bits", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in text_batches(batch, "__text"):
                size, node, fp, bands, bits = zip(*((len(held), *sketch(held)) for held in map(shingles, texts)))
                kept = {c: rows.column(c) for c in ("doc_id", "h1", "h2")}
                yield batches_out({**kept, "node": node, "size": size, "fp": fp, "bands": bands, "bits": bits}, schema)

    h1, h2 = wide_hash(docs[text_col])
    return docs.select(docs[id_col].cast("long").alias("doc_id"), h1.alias("h1"), h2.alias("h2"), docs[text_col].alias("__text")).mapInArrow(run, ddl)


def _held(docs: DataFrame, text_col: str, wanted: DataFrame) -> DataFrame:
    """node, held (its shingle set) of the wanted nodes, read again from one text of each."""
    ddl = "node long, held array<long>"
    schema = pa.schema([("node", pa.int64()), ("held", pa.list_(pa.int64()))])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in text_batches(batch, "__text"):
                yield batches_out({"node": rows.column("node"), "held": [shingles(t).view(np.int64) for t in texts]}, schema)

    h1, h2 = wide_hash(docs[text_col])
    texts = docs.select(h1.alias("h1"), h2.alias("h2"), docs[text_col].alias("__text")).join(wanted.select("node", "text_hash.*"), ["h1", "h2"]).select("node", "__text")
    return stored(texts.mapInArrow(sets, ddl).dropDuplicates(["node"]))


def _verified(held: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs whose shingle sets are similar."""
    first = held.select(F.col("node").alias("a"), F.col("held").alias("x"))
    second = held.select(F.col("node").alias("b"), F.col("held").alias("y"))
    return stored(pairs.join(first, "a").join(second, "b").where(similar(F.col("x"), F.col("y"))).select("a", "b"))


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the rows of the smallest id of each component only; each row is judged by its own text.

    Two texts are linked if their sets of five-word shingles have a Jaccard similarity
    of 0.8 or more.  Candidates are joined by the byte-position index over their
    fingerprints or share one of BANDS bands of ROWS MinHash values, which
    a pair of exactly 0.8 does with a chance of 0.99999; each candidate is verified on
    its shingles.  Lists of more than SHORT_LIST members are first joined by spanning
    trees of nearest SimHashes, then :func:`crossing` brings the members that this left
    in different components together (a pair of 0.8 with a chance of 0.9999).  Equal
    sets are one node; texts without words are one node.
    Rows with a null id stay if no row with an id is in their component.
    """
    small_batches(docs.sparkSession)
    rows = stored(_sketched(docs, id_col, text_col))
    nodes = stored(rows.groupBy("node").agg(F.min("doc_id").alias("least"), F.first("fp").alias("fp"), F.first("bands").alias("bands"), F.first("size").alias("size"), F.first("bits").alias("bits"), F.min(F.struct("h1", "h2")).alias("text_hash")))
    picked = stored(candidates(nodes))
    pairs = stored(picked.select("a", "b").union(index_candidates(nodes)).distinct())
    held = _held(docs, text_col, nodes.join(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "node", "left_semi"))
    roots = components(_verified(held, pairs))
    apart = crossing(docs, text_col, nodes, picked.where("key is not null").select("key").distinct(), roots)
    if not apart.isEmpty():
        roots = components(apart.union(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    one = nodes.select("node", "least")
    labelled = roots.union(roots.select("root", "root").distinct()).join(one, "node")
    smallest = labelled.groupBy("root").agg(F.min("least").alias("component"))
    of = labelled.join(smallest, "root").select("node", "component")
    ids = stored(one.join(of, "node", "left").select("node", F.when(F.col("component").isNotNull(), F.col("component")).otherwise(F.col("least")).alias("component_id")))
    found = rows.select("doc_id", "h1", "h2", "node").join(ids, "node")
    gone = found.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__gone"), F.col("h1").alias("__h1"), F.col("h2").alias("__h2")).distinct()
    h1, h2 = wide_hash(docs[text_col])
    return docs.join(gone, docs[id_col].cast("long").eqNullSafe(gone["__gone"]) & (h1 == gone["__h1"]) & (h2 == gone["__h2"]), "left_anti")
