"""N-gram Jaccard join: components of texts whose sets of word shingles have a Jaccard similarity of 0.8 or more.

1. Equal shingle sets are one *node*.  A table of ``1 << TABLE`` counts, summed over all texts, orders shingles from rare to
   common; any order gives right results, and this one keeps common lines and passages out of the next step.
2. Two similar sets share one of their first ``size // 5 + 1`` shingles in that order (prefix filter), so each node is posted
   under those.  A posting list, sorted by size, is a *tile* of sets whose sizes can match; one with more shingles than
   TILE is cut into size bands and these into blocks, and each pair of blocks of the same or neighbouring bands is a tile.
3. A node has a bitmap signature: bit ``hash mod width`` is the parity of the shingles there.  Each bit in which two
   bitmaps differ needs a shingle that only one set holds, so the number of such bits bounds the overlap from above.  In a
   tile, pairs that pass this bound (and those of sizes and positions) are candidates.
4. Candidates are verified on their sorted arrays of shingles.

No tile emits all pairs of a group.  The first round looks at an eighth of the lists and gives at most FEW candidates a
member, else a tree through the tile; its links give first components.  The second looks at all lists that are not one
component yet, and at pairs from different components alone: again FEW candidates a member, or, where there are more, the
members themselves.  Such crowded tiles meet once more with their shingles, and give links that join components.

A shingle goes by a 64-bit hash of the 64-bit hashes of its words, a set by 128 bits.  Tasks hold one tile: at most TILE shingles, or
one pair of texts.

Defined results: null, empty or blank text has no shingles and is linked with nothing; a text of fewer words than a shingle
is one shingle; texts of any length are read whole; a component's id is the smallest id in it that isn't null (null if there
is none); each row gets a result, rows of one id each their own, equal rows equal ones; an empty table gives no rows.  Other
columns aren't read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paritas.llm.common import ASCII_SPACE, arrow_schema, batch_rows, batches_out, partitions, small_batches, stored, text_batches, wide_hash
from paritas.llm.components import components, merged

SHINGLE = 5
#: Similar: 5 * both >= 4 * either, that is 9 * both >= 4 * (sum of the sizes).
BOTH, SUM = 9, 4
#: Bits of the place in the table of counts; counts of a stored row.
TABLE, CHUNK = 20, 1 << 14
#: Shingles of a tile, what a member of a tile counts besides, candidates for each member of a large tile, and members of a
#: small one, which may give all its pairs.
TILE, ROW, FEW, SMALL = 2_000_000, 100, 4, 16
#: One list in so many is looked at in the first round.
FIRST = 8
#: Bytes that are hashed side by side, and the length from which a word goes by its XXH64.
PART, LONG = 1 << 20, 4096
_SPACE = np.isin(np.arange(256), list(ASCII_SPACE.encode()))
_LETTERS = np.random.default_rng(42).integers(0, 1 << 64, 256, np.uint64)
_BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []
_EMPTY = np.zeros(0, np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _words(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word: a polynomial in the base with a random number for each byte, by running sums; then mixed."""
    if not _powers:  # of the base and of its inverse
        _powers.extend(np.multiply.accumulate(np.array([1, *[x] * (PART - 1)], np.uint64)) for x in (_BASE, pow(_BASE, -1, 1 << 64)))
    a = np.frombuffer(raw, np.uint8)
    word = np.zeros(len(a) + 2, np.int8)
    word[1:-1] = ~_SPACE[a]
    edge = np.diff(word)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):  # words that lie within PART bytes together, or one that is longer
        first = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, first + PART, side="right")))
        if ends[to - 1] - first <= PART:
            part = a[first : ends[to - 1]]
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_LETTERS[part] * _powers[0][: len(part)])))
            s, e = starts[at:to] - first, ends[at:to] - first
            out[at:to] = _mixed((sums[e] - sums[s]) * _powers[1][s] + (e - s).astype(np.uint64))
        at = to
    for i in np.flatnonzero(ends - starts > LONG).tolist():
        from xxhash import xxh64_intdigest

        out[i] = xxh64_intdigest(raw[starts[i] : ends[i]], 42)
    return starts, out


def _joined(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of size words."""
    n = len(h) - size + 1
    out = np.full(max(0, n), size, np.uint64)
    for i in range(size):
        out = (out ^ h[i : i + n]) * np.uint64(_BASE)
        out ^= out >> np.uint64(32)
    return out


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """Sorted hashes of the distinct shingles of each text."""
    raw = [t.encode().lower() for t in texts]
    starts, h = _words(b"\n".join(raw))
    ends = np.cumsum([len(r) + 1 for r in raw])
    edges = [0, *np.searchsorted(starts, ends).tolist()]
    runs = _joined(h, SHINGLE)
    return [np.unique(runs[a : b - SHINGLE + 1]) if b - a >= SHINGLE else _joined(h[a:b], b - a) if b > a else _EMPTY for a, b in zip(edges, edges[1:])]


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def _place(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - TABLE)).astype(np.int64)


# --- the texts: shingle sets, the table of counts, nodes -----------------------------------------------------------------


def _measured(docs: DataFrame) -> DataFrame:
    """doc_id, size, s1, s2 (128 bits of the set), t1, t2 (of the text) of every row of docs (doc_id, text); and rows (chunk, counts)."""
    ddl = "doc_id long, size long, s1 long, s2 long, t1 long, t2 long, chunk int, counts binary"
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        counts = np.zeros(1 << TABLE, np.uint32)
        for batch in batches:
            for part, texts in text_batches(batch, "text"):
                sizes, names, sets = [], [], shingle_sets(texts)
                counts += np.bincount(_place(np.concatenate(sets)), minlength=len(counts)).astype(np.uint32)
                for held in sets:
                    raw = held.astype("<u8").tobytes()
                    sizes.append(len(held))
                    names.append((xxh64_intdigest(raw, 1), xxh64_intdigest(raw, 2)))
                s = np.array(names, np.uint64).view(np.int64)
                none = pa.nulls(len(texts))
                yield batches_out({"size": sizes, "s1": s[:, 0], "s2": s[:, 1], "chunk": none.cast(pa.int32()), "counts": none.cast(pa.binary())} | {c: part.column(c) for c in ("doc_id", "t1", "t2")}, schema)
        full = [k for k in range(0, len(counts), CHUNK) if counts[k : k + CHUNK].any()]
        rest = {c: pa.nulls(len(full), pa.int64()) for c in ("doc_id", "size", "s1", "s2", "t1", "t2")}
        yield batches_out(rest | {"chunk": [k // CHUNK for k in full], "counts": [counts[k : k + CHUNK].astype("<u4").tobytes() for k in full]}, schema)

    t1, t2 = wide_hash(F.col("text"))
    return docs.select("doc_id", "text", t1.alias("t1"), t2.alias("t2")).mapInArrow(run, ddl)


def _levels(measured: DataFrame) -> np.ndarray:
    """Of every place in the table, how common its shingles are: four levels to a doubling.  A table of fixed size goes to the driver."""
    ddl = "chunk int, counts binary"
    schema = arrow_schema(ddl)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, raw in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist()):
                sums[chunk] = sums.get(chunk, 0) + np.frombuffer(raw, "<u4").astype(np.int64)
        if sums:
            yield batches_out({"chunk": list(sums), "counts": [np.minimum(255, 4 * np.log2(x + 1)).astype(np.uint8).tobytes() for x in sums.values()]}, schema)

    levels = np.zeros(1 << TABLE, np.uint8)
    for row in measured.where("chunk is not null").select("chunk", "counts").repartition(8, "chunk").mapInArrow(add, ddl).collect():
        levels[row["chunk"] * CHUNK : (row["chunk"] + 1) * CHUNK] = np.frombuffer(row["counts"], np.uint8)
    return levels


def bitmap(held: np.ndarray) -> np.ndarray:
    """Parities of the shingles at each of 64 * 2**k bits, as many as shingles or more."""
    width = max(64, 1 << (len(held) - 1).bit_length())
    return np.packbits(np.bincount((held & np.uint64(width - 1)).astype(np.int64), minlength=width).astype(np.uint8) & 1, bitorder="little").view("<u8")


def _posted(texts: DataFrame, levels: np.ndarray) -> DataFrame:
    """node, size, keys (its rarest shingles, rarest first), bits of every node of texts (node, text)."""
    ddl = "node long, size int, keys array<long>, bits binary"
    schema = pa.schema([("node", pa.int64()), ("size", pa.int32()), ("keys", pa.list_(pa.int64())), ("bits", pa.binary())])
    sent = texts.sparkSession.sparkContext.broadcast(levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, some in text_batches(batch, "text"):
                sizes, keys, bits = [], [], []
                for held in shingle_sets(some):
                    order = np.argsort(sent.value[_place(held)], kind="stable")[: len(held) // 5 + 1]
                    sizes.append(len(held))
                    keys.append(_signed(held[order]))
                    bits.append(bitmap(held).tobytes())
                yield batches_out({"node": part.column("node"), "size": sizes, "keys": keys, "bits": bits}, schema)

    return texts.mapInArrow(run, ddl)


def _sets(texts: DataFrame) -> DataFrame:
    """node, held (its sorted shingles)."""
    ddl = "node long, held binary"
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, some in text_batches(batch, "text"):
                yield batches_out({"node": part.column("node"), "held": [x.astype("<u8").tobytes() for x in shingle_sets(some)]}, schema)

    return texts.mapInArrow(run, ddl)


# --- posting lists and tiles ------------------------------------------------------------------------------------------------


def _members(posted: DataFrame) -> DataFrame:
    """key, node, size, place of every posting that has a neighbour of a fitting size in its list."""
    ddl = "key long, node long, size int, place int"
    postings = posted.select("node", "size", F.posexplode("keys").alias("place", "key")).select("key", "node", "size", "place")
    listed = postings.repartition(partitions(posted), "key").sortWithinPartitions("key", "size")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: pa.RecordBatch | None = None  # the row before, and whether it has a neighbour already
        met = False
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch] if last is None else [last, batch]).combine_chunks().to_batches()[0]
            key, size = rows.column("key").to_numpy(), rows.column("size").to_numpy().astype(np.int64)
            fits = (key[1:] == key[:-1]) & (5 * size[:-1] >= 4 * size[1:])
            near = np.concatenate(([met], fits)) | np.concatenate((fits, [False]))
            met = bool(near[-1])
            yield rows.slice(0, rows.num_rows - 1).filter(pa.array(near[:-1]))
            last = rows.slice(rows.num_rows - 1)
        if last is not None and met:
            yield last

    return listed.mapInArrow(run, ddl)


def tiled(members: DataFrame) -> DataFrame:
    """members with tile: t1, t2 (which blocks of the list meet) and side (0: the first block, or both are one; 1: the second)."""
    weight = F.sum(F.col("size") + ROW)
    whole = stored(members.groupBy("key").agg(weight.alias("held")).where(F.col("held") > TILE).select("key"))
    one = [F.lit(0).alias(c) for c in ("t1", "t2", "side")]
    if whole.isEmpty():
        return members.select("*", *one)
    plain = members.join(whole, "key", "left_anti").select("*", *one)
    crowded = members.join(whole, "key", "left_semi")
    banded = crowded.withColumn("band", F.floor(F.log(F.col("size").cast("double")) / F.log(F.lit(1.25))).cast("int"))
    blocks = banded.groupBy("key", "band").agg(F.ceil(2 * weight / F.lit(TILE)).cast("int").alias("blocks"))
    own = stored(banded.join(blocks, ["key", "band"]).withColumn("block", F.col("band") * (1 << 20) + F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).drop("blocks"))
    have = own.select("key", "band", "block").distinct()
    x, y = have.alias("x"), have.alias("y")
    pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.block") <= F.col("y.block")) & (F.col("y.band") - F.col("x.band") <= 1))
    pairs = stored(pairs.select(F.col("x.key").alias("key"), F.col("x.block").alias("t1"), F.col("y.block").alias("t2")))
    sides = pairs.select("key", F.col("t1").alias("block"), "t1", "t2", F.lit(0).alias("side")).union(pairs.where("t1 != t2").select("key", F.col("t2").alias("block"), "t1", "t2", F.lit(1).alias("side")))
    return plain.unionByName(own.join(sides, ["key", "block"]).select(plain.columns))


def differing(flat: np.ndarray, at: np.ndarray, width: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """In how many bits each pair (i, j) of bitmaps differs, the wider one folded onto the other; width in words."""
    out = np.zeros(len(i), np.int64)
    low, high = np.where(width[i] <= width[j], i, j), np.where(width[i] <= width[j], j, i)
    kinds = width[low] * (1 << 32) + width[high]
    for kind in np.unique(kinds).tolist():
        w, v = kind >> 32, kind & 0xFFFFFFFF
        some = np.flatnonzero(kinds == kind)
        for a in range(0, len(some), max(1, (1 << 20) // v)):
            part = some[a : a + max(1, (1 << 20) // v)]
            x = flat[at[low[part], None] + np.arange(w)]
            y = np.bitwise_xor.reduce(flat[at[high[part], None] + np.arange(v)].reshape(len(part), v // w, w), axis=1)
            out[part] = np.bitwise_count(x ^ y).sum(axis=1)
    return out


def may_match(size: np.ndarray, place: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Of pairs whose first common shingle is that of the list: sizes and positions allow the similarity."""
    n, m = size[i], size[j]
    return BOTH * np.minimum(np.minimum(n, m), np.minimum(n - place[i], m - place[j])) >= SUM * (n + m)


class Tile:
    """Rows of some tiles, sorted by tile and size, as arrays."""

    def __init__(self, rows: pa.Table):
        column = lambda c: rows.column(c).to_numpy().astype(np.int64)
        self.node, self.size, self.place, self.side, self.root = map(column, ("node", "size", "place", "side", "root"))
        raw = rows.column("bits").to_pylist()
        self.width = np.fromiter((len(b) // 8 for b in raw), np.int64, len(raw))
        self.at = np.cumsum(self.width) - self.width
        self.flat = np.frombuffer(b"".join(raw), "<u8")
        keys = np.stack([column(c) for c in ("key", "t1", "t2")])
        self.new = np.concatenate(([True], (keys[:, 1:] != keys[:, :-1]).any(axis=0)))
        self.two = column("t1") != column("t2")

    def passing(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which of the pairs (i, j) of rows are candidates: from different components, and past all bounds."""
        ok = (self.root[i] != self.root[j]) & (~self.two[i] | (self.side[i] != self.side[j])) & may_match(self.size, self.place, i, j)
        at = np.flatnonzero(ok)
        ok[at] = self.size[i[at]] + self.size[j[at]] >= BOTH * differing(self.flat, self.at, self.width, i[at], j[at])
        return ok

    def windows(self, a: int, b: int) -> Iterator[tuple[int, np.ndarray]]:
        """Of a tile in rows a to b: each row, and later rows that are candidates with it."""
        ends = a + np.searchsorted(self.size[a:b], self.size[a:b] * 5 // 4, side="right")
        for i, end in zip(range(a, b), ends.tolist()):
            if end > i + 1:
                js = np.arange(i + 1, end)
                hit = js[self.passing(np.full(len(js), i), js)]
                if len(hit):
                    yield i, hit


def candidates(rows: pa.Table, tree: bool) -> tuple[list, list, list]:
    """Candidate pairs (places i, j) of some tiles, and the places of members of tiles that have more than FEW for each.

    Such a tile gives a tree for each set of joined members if tree is set, else none.
    """
    t = Tile(rows)
    edges = [*np.flatnonzero(t.new).tolist(), len(t.node)]
    sizes = np.diff(edges)
    small = np.repeat(sizes <= SMALL, sizes)
    of = np.cumsum(t.new) - 1
    left, right, more = [], [], []
    for d in range(1, min(SMALL, len(t.node))):
        i = np.flatnonzero(small[:-d] & (of[:-d] == of[d:]))
        if not len(i):
            break
        ok = t.passing(i, i + d)
        left.append(i[ok])
        right.append(i[ok] + d)
    for k in np.flatnonzero(sizes > SMALL).tolist():
        a, b = edges[k], edges[k + 1]
        found, total, met = [], 0, np.zeros(b - a, bool)
        limit = FEW * (b - a)
        for i, js in t.windows(a, b):
            met[i - a] = True
            met[js - a] = True
            total += len(js)
            if total <= limit:
                found.append((i, js))
            elif tree:
                met[:] = True
                break
        if total <= limit:
            for i, js in found:
                left.append(np.full(len(js), i))
                right.append(js)
        else:
            more.append(a + np.flatnonzero(met))
            if tree:
                for i, js in spanning(t, a + np.flatnonzero(met)):
                    left.append(np.array([i]))
                    right.append(np.array([js]))
    return left, right, more


def spanning(t: Tile, rows: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pairs of rows: each row with the nearest of up to 32 rows spread over the sizes, and these with one another's nearest."""
    centres = rows[np.unique(np.linspace(0, len(rows) - 1, 32).astype(np.int64))]
    best, to = np.full(len(rows), np.inf), np.zeros(len(rows), np.int64)
    for c in centres.tolist():
        others = np.full(len(rows), c)
        ok = t.passing(others, rows) & (rows != c)
        at = np.flatnonzero(ok)
        d = np.full(len(rows), np.inf)
        d[at] = differing(t.flat, t.at, t.width, others[at], rows[at]) / (t.size[others[at]] + t.size[rows[at]])
        closer = d < best
        best[closer], to[closer] = d[closer], c
        reached = [(x, c) for x in centres.tolist() if x > c and ok[np.searchsorted(rows, x)]]
        yield from reached
    for row, distance, centre in zip(rows.tolist(), best.tolist(), to.tolist()):
        if distance < np.inf:
            yield row, centre


def _sorted_tiles(batches: Iterator[pa.RecordBatch], column: str, most: int = 8_000_000) -> Iterator[pa.Table]:
    """Rows of whole tiles, some tiles at a time; rows come sorted by tile."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.column(column).nbytes
        if size > most:
            rows = pa.Table.from_batches(held).combine_chunks()
            keys = np.stack([rows.column(c).to_numpy().astype(np.int64) for c in ("key", "t1", "t2")])
            starts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            if len(starts):
                yield rows.slice(0, int(starts[-1]))
                rows = rows.slice(int(starts[-1])).combine_chunks()
            held, size = rows.to_batches(), rows.column(column).nbytes if not len(starts) else 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _round(tiles: DataFrame, posted: DataFrame, tree: bool, parts: int) -> DataFrame:
    """From tiles (members and root): candidate pairs a < b, and rows (a null b) of members of crowded tiles."""
    ddl = "a long, b long, key long, t1 int, t2 int, side int, place int"
    schema = arrow_schema(ddl)
    met = tiles.join(posted.select("node", "bits"), "node").repartition(parts, "key", "t1", "t2").sortWithinPartitions("key", "t1", "t2", "size", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _sorted_tiles(batches, "bits"):
            left, right, more = candidates(rows, tree)
            node = rows.column("node").to_numpy()
            if left:
                x, y = node[np.concatenate(left)], node[np.concatenate(right)]
                pairs = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1), axis=0)
                if len(pairs):
                    rest = {c: pa.nulls(len(pairs), schema.field(c).type) for c in ("key", "t1", "t2", "side", "place")}
                    yield batches_out({"a": pairs[:, 0], "b": pairs[:, 1], **rest}, schema)
            if more and not tree:
                some = rows.take(pa.array(np.concatenate(more))).combine_chunks()
                yield batches_out({"a": some.column("node").combine_chunks(), "b": pa.nulls(some.num_rows, pa.int64())} | {c: some.column(c).combine_chunks().cast(schema.field(c).type) for c in ("key", "t1", "t2", "side", "place")}, schema)

    return met.select("key", "t1", "t2", "side", "node", "size", "place", "root", "bits").mapInArrow(run, ddl)


def overlap(x: np.ndarray, y: np.ndarray) -> int:
    """How many values two sorted arrays of distinct values share."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x):
        return 0
    return int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())


def _similar(x: np.ndarray, y: np.ndarray) -> bool:
    return BOTH * overlap(x, y) >= SUM * (len(x) + len(y))


def _verified(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) that are similar."""
    ddl = "a long, b long"
    schema = arrow_schema(ddl)
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    held = stored(_sets(texts.join(wanted, "node", "left_semi")), "none")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, x, y = (batch.column(c) for c in ("a", "b", "x", "y"))
            ok = [_similar(np.frombuffer(p.as_buffer(), "<u8"), np.frombuffer(q.as_buffer(), "<u8")) for p, q in zip(x, y)]
            keep = pa.array(ok, pa.bool_())
            yield batches_out({"a": a.filter(keep), "b": b.filter(keep)}, schema)

    met = pairs.join(held.select(F.col("node").alias("a"), F.col("held").alias("x")), "a").join(held.select(F.col("node").alias("b"), F.col("held").alias("y")), "b")
    return stored(met.select("a", "b", "x", "y").mapInArrow(run, ddl))


def _crowded(texts: DataFrame, more: DataFrame, roots: DataFrame, parts: int) -> DataFrame:
    """Links (a, b) that join the components of crowded tiles: their members meet again, with their shingles."""
    ddl = "a long, b long"
    schema = arrow_schema(ddl)
    held = stored(_sets(texts.join(more.select("node").distinct(), "node", "left_semi")), "none")
    met = more.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).join(held, "node").withColumn("size", (F.octet_length("held") / 8).cast("int"))
    met = met.repartition(parts, "key", "t1", "t2").sortWithinPartitions("key", "t1", "t2", "size", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _sorted_tiles(batches, "held", 32_000_000):
            t = Tile(rows.append_column("bits", pa.array([bitmap(np.frombuffer(x.as_buffer(), "<u8")).tobytes() for x in rows.column("held").combine_chunks()], pa.binary())))
            sets = [np.frombuffer(x.as_buffer(), "<u8") for x in rows.column("held").combine_chunks()]
            found = []
            edges = [*np.flatnonzero(t.new).tolist(), len(t.node)]
            for a, b in zip(edges, edges[1:]):
                for i, js in t.windows(a, b):
                    for j in js.tolist():
                        if t.root[i] != t.root[j] and _similar(sets[i], sets[j]):
                            found.append((t.node[i], t.node[j]))
                            own = t.root[a:b]
                            own[own == t.root[j]] = t.root[i]  # one component from now on, as far as this tile goes
            if found:
                pairs = np.array(found, np.int64)
                yield batches_out({"a": pairs[:, 0], "b": pairs[:, 1]}, schema)

    return stored(met.select("key", "t1", "t2", "side", "node", "size", "place", "root", "held").mapInArrow(run, ddl))


# --- the join ---------------------------------------------------------------------------------------------------------------


def node_components(texts: DataFrame, posted: DataFrame) -> DataFrame:
    """(node, root) of every node that isn't its component's smallest, from all similar pairs."""
    spark, parts = posted.sparkSession, partitions(posted)
    with batch_rows(spark, 50_000):  # of 24 bytes
        members = stored(_members(posted))
    tiles = tiled(members)
    with batch_rows(spark, 5_000):
        first = _round(tiles.where(F.pmod(F.xxhash64("key"), F.lit(FIRST)) == 0).select("*", F.col("node").alias("root")), posted, True, parts)
        first = stored(first.select("a", "b").distinct())
    roots = components(_verified(texts, first))
    labelled = tiles.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = labelled.groupBy("key", "t1", "t2").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("key", "t1", "t2")
    with batch_rows(spark, 5_000):
        found = stored(_round(labelled.join(mixed, ["key", "t1", "t2"], "left_semi"), posted, False, parts))
    second = found.where("b is not null").select("a", "b").distinct().join(first, ["a", "b"], "left_anti")
    links = _verified(texts, stored(second))
    more = found.where("b is null").select("key", "t1", "t2", "side", "place", F.col("a").alias("node"))
    if not more.isEmpty():
        links = links.union(_crowded(texts, more, roots, parts))
    return roots if links.isEmpty() else merged(roots, links)


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, one row per row of docs."""
    small_batches(docs.sparkSession)
    own = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    measured = stored(_measured(own))
    rows = measured.where("chunk is null").select("doc_id", "size", "s1", "s2", "t1", "t2")
    nodes = stored(rows.where("size > 0").groupBy("s1", "s2").agg(F.min("doc_id").alias("least"), F.min(F.struct("t1", "t2", "doc_id")).alias("of")).withColumn("node", F.monotonically_increasing_id()))
    t1, t2 = wide_hash(F.col("text"))
    wanted = nodes.select("node", F.col("of.t1").alias("t1"), F.col("of.t2").alias("t2"), F.col("of.doc_id").alias("__id"))
    hashed = own.select("doc_id", "text", t1.alias("t1"), t2.alias("t2"))
    met = hashed.join(wanted, (hashed["t1"] == wanted["t1"]) & (hashed["t2"] == wanted["t2"]) & hashed["doc_id"].eqNullSafe(wanted["__id"]))
    texts = stored(met.select("node", "text").dropDuplicates(["node"]))
    posted = stored(_posted(texts, _levels(measured)))
    roots = node_components(texts, posted)
    labelled = roots.union(roots.select("root", "root").distinct()).join(nodes.select("node", "least"), "node")
    smallest = labelled.groupBy("root").agg(F.min("least").alias("component"))
    of = labelled.join(smallest, "root").select("node", "component")
    ids = nodes.join(of, "node", "left").select("s1", "s2", F.when(F.col("component").isNotNull(), F.col("component")).otherwise(F.col("least")).alias("component"))
    ids = stored(ids)
    out = rows.join(ids, ["s1", "s2"], "left")
    return out.select("doc_id", F.col("size").alias("n_shingles"), F.when(F.col("size") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))
