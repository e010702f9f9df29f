"""Removal of repeated passages, by longest-previous-factor arrays over shards of suffixes.

A byte goes if a string of ``length`` bytes that covers it also starts earlier:
in a smaller document id, or earlier in the same document.  That is, if some
position i at most length - 1 before it has a longest previous factor
LPF[i] >= length.

Suffixes are dealt so that equal strings of ``length`` bytes meet in one task.
Every such string has an anchor that depends on its bytes alone: of its k-grams,
the leftmost one whose hash is least (a minimiser; length = k + windows - 1).
Consecutive strings of a document mostly share their anchor, so a document gives
about one run of strings in 39 bytes.

1. Runs: (hash of the anchor's k-gram, document, place).  As aggregation before the
   shuffle, equal stretches of the texts at hand are told apart by their bytes, and
   all but the first are covered wholly, so that text which repeats itself, or
   copies in one file, don't pile up under one hash.  Sorted by hash, a task keeps
   those whose hash occurs twice or more (a streaming comparison of neighbours).
   A hash met more than ``SALT_ROWS`` times is dealt out further by parts.
2. The kept runs meet their documents once, and each becomes its stretch of text.
3. Stretches are dealt by (hash, part) and sorted by (hash, part, content, place).
   Equal stretches follow each other; all but the first are covered wholly.  The
   others form shards of about ``CHUNK`` bytes.  Of a shard, the suffixes that start
   a string are sorted by prefix doubling; the common prefixes of neighbours follow
   from the ranks of the doubling; the previous and the next smaller position (in
   corpus order) of each suffix are found by doubling over suffix order, with the
   least common prefix on the way, and LPF is the greater of the two.  Suffixes with
   LPF >= length are covered.
   A hash that fills more than one shard, or has parts, isn't held: of each of its
   shards the strings without a previous factor go out alone and meet again.
4. Those strings are dealt by a hash and sorted by (hash, bytes, place), which is
   suffix order again: as all are of one length, LPF reaches it exactly if the
   neighbour before, which is earlier, has the same bytes.
5. Covered intervals go back to their documents, are joined up and cut.

Hashes only choose who meets; what is removed is decided on the bytes.

Defined results: null text is empty; texts under ``length`` bytes stay whole; texts
of any length are taken whole (their anchors in pieces of ``PIECE`` bytes that
overlap).  Ties in content go to the smaller id, then the smaller start.  Documents
are ordered by (id, text), null ids first, if ids repeat or are null; equal (id,
text) rows are one document and get equal results.  An empty table gives no rows.
Other columns are carried in a struct, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from paritas.llm.common import arrow_schema, batches_out, partitions, small_batches, stored, text_batches

LENGTH, ANCHOR = 100, 24
#: Bits of a window's order that hold a position; longer texts are taken in pieces of this many bytes.
PLACE_BITS = 24
PIECE = 1 << 22
#: Bytes of stretches that get one suffix order.
CHUNK = 1 << 20
#: Runs of one anchor that are dealt to one task.
SALT_ROWS = 4_000
_PLACES = np.uint64((1 << PLACE_BITS) - 1)


def eight(data: np.ndarray) -> np.ndarray:
    """The eight bytes at each position, as a number."""
    v = data.astype(np.uint64)
    for n in (1, 2, 4):
        v = v[:-n] | (v[n:] << np.uint64(8 * n))
    return v


def anchor_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the ANCHOR bytes at each position."""
    v = eight(data)
    h = v[:-16] * np.uint64(0x9E3779B97F4A7C15)
    h += v[8:-8] * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(31)
    h += v[16:] * np.uint64(0x165667B19E3779F9)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def runs(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of strings with one anchor: its hash, start of the first string, number of strings.

    data: texts one after another; ends: where the text of each position ends.
    """
    n = len(data) - length + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = anchor_hashes(data)
    width = length - ANCHOR + 1
    low = (h & ~_PLACES) | np.arange(len(h), dtype=np.uint64)
    size = 1
    while 2 * size <= width:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < width:
        low = np.minimum(low[: len(h) - width + 1], low[width - size :])
    at = (low & _PLACES).astype(np.int64)
    inside = np.arange(n) + length <= ends[:n]
    at[~inside] = -1
    starts = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    counts = np.diff(np.concatenate((starts, [n])))
    good = at[starts] >= 0
    return h[at[starts[good]]].view(np.int64), starts[good], counts[good]


def text_runs(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(index of the text, hash, start in it, strings) of the runs of some texts; very long ones in pieces."""
    group: list[int] = []
    held = 0
    for i, text in enumerate([*texts, None]):
        if group and (text is None or held + len(text) > PIECE):
            sizes = np.array([len(texts[k]) for k in group])
            first = np.cumsum(sizes) - sizes
            data = np.frombuffer(b"".join(texts[k] for k in group), np.uint8)
            h, start, count = runs(data, np.repeat(first + sizes, sizes), length)
            which = np.searchsorted(first, start, side="right") - 1
            yield np.array(group)[which], h, start - first[which], count
            group, held = [], 0
        if text is None:
            break
        if len(text) > PIECE:
            for a in range(0, len(text), PIECE):
                data = np.frombuffer(text[a : a + PIECE + length - 1], np.uint8)
                h, start, count = runs(data, np.full(len(data), len(data)), length)
                yield np.full(len(h), i), h, start + a, count
        elif len(text) >= length:
            group.append(i)
            held += len(text)


def later_equals(texts: list[bytes], which: np.ndarray, h: np.ndarray, uid: np.ndarray, start: np.ndarray, count: np.ndarray, length: int) -> np.ndarray:
    """Which of some runs have a stretch that an earlier one of them (by document, start) has too."""
    out = np.zeros(len(h), bool)
    order = np.lexsort((start, uid, count, h))
    like = (h[order[1:]] == h[order[:-1]]) & (count[order[1:]] == count[order[:-1]])
    seen: dict[bytes, None] = {}
    group = -1
    for k in np.flatnonzero(np.concatenate((like, [False])) | np.concatenate(([False], like))).tolist():
        if k != group + 1 or not like[k - 1]:
            seen = {}
        group = k
        i = order[k]
        stretch = texts[which[i]][start[i] : start[i] + count[i] + length - 1]
        if stretch in seen:
            out[i] = True
        else:
            seen[stretch] = None
    return out


def ranks(codes: np.ndarray) -> np.ndarray:
    """Numbers in the order of the codes, equal for equal ones."""
    order = np.argsort(codes, kind="stable")
    new = np.concatenate(([0], codes[order[1:]] != codes[order[:-1]]))
    out = np.empty(len(codes), np.int32)
    out[order] = np.cumsum(new)
    return out


def joined(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return ranks(first.astype(np.int64) * (int(second.max(initial=0)) + 1) + second)


def suffix_order(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in starts in the order of their suffixes' first length bytes, and the common prefix of each with the one before (at most length).

    By prefix doubling.  The common prefix is made up of halves: as long as the ranks
    of the largest power of two agree, both move on by it.
    """
    n, size = len(data), 8
    power = {8: ranks(eight(data).byteswap())}
    while 2 * size <= length:
        rank = power[size]
        power[2 * size] = joined(rank[: n - 2 * size + 1], rank[size : n - size + 1])
        size *= 2
    rank = joined(power[size][starts], power[size][starts + length - size]) if size < length else power[size][starts]
    order = np.argsort(rank, kind="stable")
    common = np.zeros(len(order), np.int64)
    a, b = starts[order[:-1]], starts[order[1:]]
    equal = rank[order[:-1]] == rank[order[1:]]
    done = np.where(equal, length, 0)
    for half in sorted(power, reverse=True):
        ranked = power[half]
        here = ~equal & (done + half <= length)
        at = np.flatnonzero(here)
        at = at[ranked[a[at] + done[at]] == ranked[b[at] + done[at]]]
        done[at] += half
    at = np.flatnonzero(~equal)
    while len(at):  # the last bytes, fewer than eight
        at = at[(done[at] < length)]
        at = at[data[a[at] + done[at]] == data[b[at] + done[at]]]
        done[at] += 1
    common[1:] = done
    return order, common


def factor_before(when: np.ndarray, common: np.ndarray) -> np.ndarray:
    """In suffix order: the common prefix of each suffix with the nearest one before it whose place in the corpus is smaller.

    common[i] is that of i and i - 1.  Minima over 2 ** k neighbours are made first; then each suffix walks
    back over as many as are all later in the corpus, from the largest power down, and takes the least common
    prefix on its way.
    """
    n = len(when)
    when, common = when.astype(np.int32), common.astype(np.int32)
    least, prefix, size = [when], [common], 1
    while 2 * size <= n:
        least.append(np.minimum(least[-1][size:], least[-1][:-size]))
        prefix.append(np.minimum(prefix[-1][size:], prefix[-1][:-size]))
        size *= 2
    at, out = np.arange(n), np.full(n, np.iinfo(np.int32).max, np.int32)  # the smaller position, if any, is before `at`
    for k in range(len(least) - 1, -1, -1):
        span = 1 << k
        go = np.flatnonzero(at >= span)  # entries at - span .. at - 1, of which least[k][at - span] is the minimum
        go = go[least[k][at[go] - span] > when[go]]
        out[go] = np.minimum(out[go], prefix[k][at[go] - span + 1])
        at[go] -= span
    none = at == 0
    out[~none] = np.minimum(out[~none], common[at[~none]])
    out[none] = 0
    return out


def longest_previous_factors(data: np.ndarray, starts: np.ndarray, when: np.ndarray, length: int) -> np.ndarray:
    """LPF of each start, cut at length; when: the starts' order in the corpus."""
    order, common = suffix_order(data, starts, length)
    placed = when[order]
    before = factor_before(placed, common)
    after = factor_before(placed[::-1], np.concatenate(([0], common[:0:-1])))[::-1]
    out = np.empty(len(starts), np.int64)
    out[order] = np.maximum(before, after)
    return out


class Shard:
    """Different stretches of some anchors, until there are enough for a suffix order."""

    def __init__(self, length: int):
        self.length = length
        self.clear()

    def clear(self) -> None:
        self.texts: list[bytes] = []
        self.uids: list[np.ndarray] = []
        self.starts: list[np.ndarray] = []
        self.size = 0

    def add(self, texts: list[bytes], uids: np.ndarray, starts: np.ndarray) -> None:
        self.texts.extend(texts)
        self.uids.append(uids)
        self.starts.append(starts)
        self.size += sum(map(len, texts))

    def factors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of every string of the shard: its stretch, place there, document, start, LPF; the shard is empty then."""
        sizes = np.array([len(t) for t in self.texts], np.int64)
        first = np.cumsum(sizes) - sizes
        counts = sizes - self.length + 1
        own = np.repeat(np.arange(len(sizes)), counts)
        offset = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        uid, start = np.concatenate(self.uids)[own], np.concatenate(self.starts)[own] + offset
        when = np.empty(len(own), np.int64)
        when[np.lexsort((start, uid))] = np.arange(len(own))
        lpf = longest_previous_factors(np.frombuffer(b"".join(self.texts), np.uint8), first[own] + offset, when, self.length)
        self.clear()
        return own, offset, uid, start, lpf


def spans(own: np.ndarray, uid: np.ndarray, start: np.ndarray, hit: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, end) of what the marked strings cover, those next to each other in a stretch as one."""
    at = np.flatnonzero(hit)
    if not len(at):
        return (np.zeros(0, np.int64),) * 3
    fresh = np.concatenate(([True], (np.diff(at) > 1) | (np.diff(own[at]) != 0)))
    a = at[fresh]
    b = at[np.concatenate((np.flatnonzero(fresh)[1:] - 1, [len(at) - 1]))]
    return uid[a], start[a], start[b] + length


def with_order(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, bool]:
    """row (docs' columns but the text), __id, __text, and a long __uid in document order; whether that is the id itself.

    It is where ids are unique and not null; else (id, text) pairs are numbered, by ranges.
    """
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col] or [F.lit(None).alias("none")]
    base = docs.select(F.struct(*others).alias("row"), docs[id_col].cast("long").alias("__id"), F.coalesce(docs[text_col], F.lit("")).alias("__text"))
    unique = not base.groupBy("__id").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) | F.col("__id").isNull()).limit(1).count()
    if unique:
        return base.withColumn("__uid", F.col("__id")), True
    distinct = base.select("__id", "__text").distinct().repartitionByRange(partitions(docs), "__id", "__text").sortWithinPartitions("__id", "__text")
    # numbers grow from one range to the next and inside each; they have gaps
    order = stored(distinct.select(F.col("__id").alias("__oid"), F.sha2("__text", 256).alias("__of"), F.monotonically_increasing_id().alias("__uid")))
    met = base.join(order, F.col("__id").eqNullSafe(F.col("__oid")) & (F.sha2("__text", 256) == F.col("__of")))
    return met.select("row", "__id", "__text", "__uid"), False


def covered_intervals(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(uid, start, end) from docs (__uid, __text): overlapping intervals of bytes to remove, stored."""
    if not ANCHOR + 16 <= length < 1 << 20:
        raise ValueError(f"length must be {ANCHOR + 16} or more, and less than {1 << 20}")
    spark = docs.sparkSession
    small_batches(spark)
    parts = partitions(docs)
    bits = max(7, length.bit_length())  # a run holds fewer strings than the length
    run_ddl = "key long, uid long, place long"  # place: the run's start, and in its lowest bits its strings; its complement: covered wholly
    part_ddl = "key long, part int, uid long, place long"  # part: of a key with many runs, from 0; else -1
    run_schema, part_schema = arrow_schema(run_ddl), arrow_schema(part_ddl)

    def find_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in text_batches(batch, "__text", 1 << 20):
                uids = rows.column("__uid").to_numpy()
                data = [t.encode() for t in texts]
                for which, h, start, count in text_runs(data, length):
                    place = (start << bits) + count
                    later = later_equals(data, which, h, uids[which], start, count, length)
                    place[later] = ~place[later]
                    h[later] += np.arange(len(h))[later] * 0x9E3779B9  # anywhere: they are matched with nothing
                    yield batches_out({"key": h, "uid": uids[which], "place": place}, run_schema)

    def keep_repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # runs of the key that is being read, SALT_ROWS at most
        n_held, held_key, part = 0, None, -1

        def rows(key: np.ndarray, uid: np.ndarray, place: np.ndarray, part: int = -1) -> pa.RecordBatch:
            return batches_out({"key": key, "part": np.full(len(key), part, np.int32), "uid": uid, "place": place}, part_schema)

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal n_held, part
            if held:
                key, uid, place = (np.concatenate(x) for x in zip(*held))
                kept = (place < 0) | (len(key) > 1) | (part >= 0)
                yield rows(key[kept], uid[kept], place[kept], part)
            held.clear()
            n_held, part = 0, -1

        for batch in batches:
            if not batch.num_rows:
                continue
            key, uid, place = (batch.column(c).to_numpy() for c in ("key", "uid", "place"))
            edges = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]))
            a, b = edges[1], edges[-2]  # between them: keys that begin and end in this batch
            if key[0] != held_key:
                yield from close()
            held.append((key[:a], uid[:a], place[:a]))
            n_held, held_key = n_held + a, key[0]
            if len(edges) > 2:
                yield from close()
                alone = np.repeat(np.diff(edges) == 1, np.diff(edges))
                kept = ~alone | (place < 0)
                kept[:a] = kept[b:] = False
                if kept.any():
                    yield rows(key[kept], uid[kept], place[kept])
                held.append((key[b:], uid[b:], place[b:]))
                n_held, held_key = len(key) - b, key[-1]
            if n_held >= SALT_ROWS:
                now = part = part + 1
                yield from close()
                part = now
        yield from close()

    found = docs.select("__uid", "__text").mapInArrow(find_runs, run_ddl)
    repeated = stored(found.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(keep_repeated, part_ddl))

    ddl = "key long, part int, content long, uid long, start long, stretch binary"
    schema = arrow_schema(ddl)

    def stretch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        for batch in batches:
            for i in range(batch.num_rows):
                text = batch.column("__text")[i].as_py().encode()
                key, part, place = (batch.column(c)[i].values.to_numpy() for c in ("keys", "parts", "places"))
                for at in range(0, len(key), 4096):
                    start, count = place[at : at + 4096] >> bits, place[at : at + 4096] & ((1 << bits) - 1)
                    cut = [text[a : a + c + length - 1] for a, c in zip(start.tolist(), count.tolist())]
                    content = np.array([xxh3_64_intdigest(c) for c in cut], np.uint64).view(np.int64)
                    yield batches_out({"key": key[at : at + 4096], "part": part[at : at + 4096], "content": content, "uid": np.full(len(start), batch.column("__uid")[i].as_py()), "start": start, "stretch": cut}, schema)

    known = repeated.where("place < 0").select("uid", F.shiftright(F.bitwise_not("place"), bits).alias("start"), (F.shiftright(F.bitwise_not("place"), bits) + F.bitwise_not("place").bitwiseAND((1 << bits) - 1) + (length - 1)).alias("end"))
    places = repeated.where("place >= 0").groupBy("uid").agg(F.collect_list(F.struct("key", "part", "place")).alias("found")).select("uid", F.col("found.key").alias("keys"), F.col("found.part").alias("parts"), F.col("found.place").alias("places"))
    met = docs.select("__uid", "__text").join(places, F.col("__uid") == F.col("uid")).select("__uid", "__text", "keys", "parts", "places").mapInArrow(stretch, ddl)
    out_ddl = "uid long, start long, end long, h long, string binary"  # h, string: of a string that is to meet others again
    out_schema = arrow_schema(out_ddl)

    def intervals(uid: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
        return batches_out({"uid": uid, "start": start, "end": end, "h": pa.nulls(len(uid), pa.int64()), "string": pa.nulls(len(uid), pa.binary())}, out_schema)

    def judged(shard: Shard, shared: bool) -> Iterator[pa.RecordBatch]:
        """What the factors of a shard cover, and if its keys have other shards too, the strings that have none."""
        from xxhash import xxh3_64_intdigest

        texts = shard.texts
        if not texts:
            return
        own, offset, uid, start, lpf = shard.factors()
        yield intervals(*spans(own, uid, start, lpf >= length, length))
        alone = np.flatnonzero(lpf < length) if shared else ()
        for at in range(0, len(alone), 4096):
            these = alone[at : at + 4096]
            cut = [texts[k][a : a + length] for k, a in zip(own[these].tolist(), offset[these].tolist())]
            h = np.array([xxh3_64_intdigest(c) for c in cut], np.uint64).view(np.int64)
            yield batches_out({"uid": uid[these], "start": start[these], "end": start[these] + length, "h": h, "string": cut}, out_schema)

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, opened = Shard(length), Shard(length)  # stretches of keys that are whole; of the key (or part) that is being read
        shared = False  # whether the open key has other shards
        before: tuple = (None, None, None)  # key, part and stretch of the row before

        def close() -> Iterator[pa.RecordBatch]:
            if shared:
                yield from judged(opened, True)
            elif len(opened.texts) > 1:
                for row in zip([opened.texts], [np.concatenate(opened.uids)], [np.concatenate(opened.starts)]):
                    waiting.add(*row)
            opened.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            key, part, uid, start = (batch.column(c).to_numpy() for c in ("key", "part", "uid", "start"))
            texts = batch.column("stretch")
            same = np.concatenate(([before[:2] == (key[0], part[0])], (key[1:] == key[:-1]) & (part[1:] == part[:-1])))
            equal = np.asarray(pc.equal(texts[1:], texts[:-1]).to_numpy(zero_copy_only=False), bool) if len(key) > 1 else np.zeros(0, bool)
            again = same & np.concatenate(([before[2] == texts[0].as_py()], equal))
            before = (int(key[-1]), int(part[-1]), texts[-1].as_py())
            if again.any():  # as the row before, which is earlier: covered wholly
                size = np.asarray(pc.binary_length(texts))
                yield intervals(uid[again], start[again], start[again] + size[again])
            first = np.flatnonzero(~again)
            if not len(first):
                continue
            new = ~same[first]
            edges = np.concatenate(([0], np.flatnonzero(new[1:]) + 1, [len(first)]))
            for g in np.flatnonzero((np.diff(edges) > 1) | (edges[:-1] == 0) | (edges[1:] == len(first)) | (part[first[edges[:-1]]] >= 0)).tolist():
                rows = first[edges[g] : edges[g + 1]]
                if new[edges[g]]:
                    yield from close()
                    shared = bool(part[rows[0]] >= 0)
                opened.add(texts.take(pa.array(rows)).to_pylist(), uid[rows], start[rows])
                if opened.size >= CHUNK:
                    shared = True
                    yield from judged(opened, True)
            if waiting.size >= CHUNK:
                yield from judged(waiting, False)
        yield from close()
        yield from judged(waiting, False)

    def later_ones(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """In suffix order, and corpus order among equals: strings whose neighbour before has the same bytes."""
        last = None
        for batch in batches:
            if batch.num_rows:
                string = batch.column("string")
                equal = np.asarray(pc.equal(string[1:], string[:-1]).to_numpy(zero_copy_only=False), bool) if batch.num_rows > 1 else np.zeros(0, bool)
                again = np.concatenate(([last == string[0].as_py()], equal))
                last = string[-1].as_py()
                yield batch.select(["uid", "start", "end"]).filter(pa.array(again))

    dealt = met.repartition(parts, "key", "part").sortWithinPartitions("key", "part", "content", "uid", "start")
    out = stored(dealt.select("key", "part", "uid", "start", "stretch").mapInArrow(cover, out_ddl))
    left = out.where("h IS NOT NULL")
    done = out.where("h IS NULL").select("uid", "start", "end").union(known)
    if not left.limit(1).count():
        return done
    return done.union(left.repartition(parts, "h").sortWithinPartitions("h", "string", "uid", "start").select("uid", "start", "end", "string").mapInArrow(later_ones, "uid long, start long, end long"))


def merged(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of the union of intervals."""
    order = np.argsort(starts, kind="stable")
    a, b = starts[order], np.maximum.accumulate(ends[order])
    fresh = np.concatenate(([True], a[1:] > b[:-1]))
    last = np.concatenate((np.flatnonzero(fresh)[1:] - 1, [len(a) - 1]))
    return list(zip(a[fresh].tolist(), b[last].tolist()))


def _with_spans(docs: DataFrame, id_col: str, text_col: str, length: int) -> DataFrame:
    """What with_order gives, with the covered intervals (starts, ends; null: none) of every row."""
    ordered, unique = with_order(docs, id_col, text_col)
    cover = covered_intervals(ordered if unique else ordered.dropDuplicates(["__uid"]), length)
    spans = cover.groupBy("uid").agg(F.collect_list(F.struct("start", "end")).alias("spans")).select("uid", F.col("spans.start").alias("starts"), F.col("spans.end").alias("ends"))
    return ordered.join(spans, F.col("__uid") == F.col("uid"), "left")


def _cut(text: bytes, starts: pa.Scalar, ends: pa.Scalar) -> tuple[bytes, int]:
    """What is left of a text, and the number of runs removed."""
    gone = merged(starts.values.to_numpy(), ends.values.to_numpy()) if starts.is_valid else []
    at, left = 0, []
    for a, b in gone:
        left.append(text[at:a])
        at = b
    return b"".join([*left, text[at:]]), len(gone)


CUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256; a row for each row of docs."""
    met = _with_spans(docs, id_col, text_col, length).select("__id", "__text", "starts", "ends")
    schema = arrow_schema(CUT)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {name: [] for name in schema.names}
            for i in range(batch.num_rows):
                text = batch.column("__text")[i].as_py().encode()
                kept, n = _cut(text, batch.column("starts")[i], batch.column("ends")[i])
                row = (batch.column("__id")[i].as_py(), len(text), len(text) - len(kept), n, hashlib.sha256(kept).hexdigest())
                for name, value in zip(schema.names, row):
                    out[name].append(value)
            yield batches_out(out, schema)

    return met.mapInArrow(cut, CUT)


def text_without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """docs with its own columns; the text is what is left, without characters that were cut through."""
    met = _with_spans(docs, id_col, text_col, length).select("row", "__text", "starts", "ends")
    schema = StructType([met.schema["row"], StructField("kept", StringType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for i in range(batch.num_rows):
                text = batch.column("__text")[i].as_py().encode()
                kept.append(_cut(text, batch.column("starts")[i], batch.column("ends")[i])[0].decode(errors="ignore"))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(kept, pa.string())], names=["row", "kept"])

    out = met.mapInArrow(cut, schema)
    return out.select(*[(F.col("kept") if c == text_col else F.col("row").getField(c)).alias(c) for c in docs.columns])
