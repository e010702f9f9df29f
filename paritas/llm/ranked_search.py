"""Ranked lexical search over a reordered, clustered index.

1. *Documents*: each text's terms, of which those that the queries ask for are kept with their counts.
2. *Reordering* by recursive graph bisection: documents that share terms come together, by swaps that lower the cost of
   their posting lists' gaps.  The first splits are fitted on SAMPLE documents (those with the lowest hash) and every
   document is routed down them; each leaf, in slices of about SHARD documents, is then bisected itself, down to *ranges*
   of at most RANGE documents.
3. *Clustered index*: a row of a range holds its documents in the new order, its posting lists and the highest impact of
   each term, so the sum over a query's terms bounds all scores in the range.
4. *Search*: the range of the highest bound gives each query a first 10th score.  All ranges whose bound reaches it are
   read, a task's ranges in falling order of bounds; a range is left out for a query as soon as its bound is below the
   10th score so far.  Equal scores are told apart by doc_id, so a bound that equals it isn't enough to stop.

The score is exact: a term's weight times (1000000000 * tf) div (1000 * tf + 8 * m), m from the length of the document.

Queries go in blocks of about QUERIES rows and MOST_TERMS terms, each with an index of its own; what is broadcast is bounded
by these two.  A task holds a slice (while it is bisected) or some ranges.

Defined results: a text that is null or has no term is found by nothing and counts in no statistic; an item without terms,
or whose terms are nowhere, has no rows; each row of the items is a query of its own, and each row of the documents a
document of its own, whatever their ids; null doc_ids come last among equal scores; texts of any length are read whole;
empty tables give no rows.  Other columns aren't read, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paritas.llm.common import LOWER, UPPER, arrow_schema, batches_out, small_batches, stored, text_batches

TOP = 10
#: Queries and distinct terms of a block.
QUERIES, MOST_TERMS = 256, 16384
#: Documents that the first splits are fitted on, levels of these splits, documents of a slice and of a range, rounds of swaps.
SAMPLE, LEVELS, SHARD, RANGE, ROUNDS = 4096, 5, 16384, 256, 8
_ALNUM = set("0123456789" + LOWER + UPPER)
_TABLE = bytes.maketrans("".join(chr(b) for b in range(128)).encode(), "".join(chr(b).lower() if chr(b) in _ALNUM else " " for b in range(128)).encode())
_NO_ID = np.iinfo(np.int64).max


def terms_of(text: str | None) -> list[bytes]:
    """Lower-cased runs of ASCII letters and digits and of all characters beyond ASCII."""
    return (text or "").encode().translate(_TABLE).split()


def counted_docs(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, uid, n (terms with repeats), terms (sorted numbers) and times of docs (doc_id, uid, text) that have a term."""
    ddl = "doc_id long, uid long, n long, terms binary, times binary"
    schema = arrow_schema(ddl)
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = sent.value.get
        for batch in batches:
            for part, texts in text_batches(batch, "text"):
                n, terms, times = [], [], []
                for text in texts:
                    words = terms_of(text)
                    codes = np.fromiter(map(number, words, repeat(-1)), np.int32, len(words))
                    held, k = np.unique(codes[codes >= 0], return_counts=True)
                    n.append(len(words))
                    terms.append(held.tobytes())
                    times.append(k.astype(np.int32).tobytes())
                keep = pa.array(np.array(n) > 0)
                yield batches_out({"doc_id": part.column("doc_id"), "uid": part.column("uid"), "n": n, "terms": terms, "times": times}, schema).filter(keep)

    return docs.mapInArrow(run, ddl)


# --- recursive graph bisection -----------------------------------------------------------------------------------------------


class Postings:
    """Documents as the numbers of their terms, one after another."""

    def __init__(self, terms: list[bytes]):
        sizes = np.fromiter((len(t) // 4 for t in terms), np.int64, len(terms))
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.terms = np.frombuffer(b"".join(terms), np.int32).astype(np.int64)
        self.sizes = sizes

    def of(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The terms of these documents, one after another, and the place in docs that each is of."""
        sizes = self.sizes[docs]
        ends = np.cumsum(sizes)
        at = np.repeat(self.starts[docs] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
        return self.terms[at], np.repeat(np.arange(len(docs)), sizes)


def _cost(n: int, degree: np.ndarray) -> np.ndarray:
    """Bits of the gaps of lists of these lengths over n documents, about."""
    return degree * np.log2(max(n, 1) / (degree + 1.0))


def bisect(postings: Postings, docs: np.ndarray, size: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two halves of docs, and for each of size terms how much it draws a document to the second half."""
    half = len(docs) // 2
    second = np.arange(len(docs)) >= half
    terms, of = postings.of(docs)
    n = (half, len(docs) - half)
    for left in range(rounds, -1, -1):
        side = second[of]
        degree = [np.bincount(terms[~side], minlength=size).astype(float), np.bincount(terms[side], minlength=size).astype(float)]
        now = [_cost(n[k], degree[k]) for k in (0, 1)]
        more = [_cost(n[k], degree[k] + 1) - now[k] for k in (0, 1)]
        if not left:
            break
        less = [now[k] - _cost(n[k], np.maximum(degree[k] - 1, 0)) for k in (0, 1)]
        gain = np.bincount(of, np.where(side, less[1][terms] - more[0][terms], less[0][terms] - more[1][terms]), minlength=len(docs))
        a, b = np.flatnonzero(~second), np.flatnonzero(second)
        a, b = a[np.argsort(-gain[a], kind="stable")], b[np.argsort(-gain[b], kind="stable")]
        k = min(len(a), len(b))
        swaps = int((np.minimum.accumulate(gain[a[:k]] + gain[b[:k]] > 1e-9)).sum()) if k else 0
        if not swaps:
            break
        second[a[:swaps]], second[b[:swaps]] = True, False
    return docs[~second], docs[second], (more[0] - more[1]).astype(np.float32)


def fitted_splits(terms: list[bytes], size: int, levels: int = LEVELS) -> np.ndarray:
    """Weights of the terms at each split of a complete tree, split k's children at 2k + 1 and 2k + 2."""
    weights = np.zeros((2**levels - 1, size), np.float32)
    postings, open_ = Postings(terms), {0: np.arange(len(terms))}
    for k in range(len(weights)):
        docs = open_.pop(k, np.zeros(0, np.int64))
        if len(docs) > 1:
            open_[2 * k + 1], open_[2 * k + 2], weights[k] = bisect(postings, docs, size)
    return weights


def routed(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """docs with leaf, the place of the leaf that the fitted splits lead to."""
    ddl = "doc_id long, uid long, n long, terms binary, times binary, leaf int"
    schema = arrow_schema(ddl)
    sent = docs.sparkSession.sparkContext.broadcast(weights)
    levels = len(weights).bit_length()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            postings = Postings(batch.column("terms").to_pylist())
            at = np.zeros(batch.num_rows, np.int64)
            of = np.repeat(np.arange(batch.num_rows), postings.sizes)
            for _ in range(levels):
                draw = np.bincount(of, sent.value[at[of], postings.terms], minlength=batch.num_rows)
                at = 2 * at + 1 + (draw > 0)
            yield batches_out({c: batch.column(c) for c in ("doc_id", "uid", "n", "terms", "times")} | {"leaf": at - len(sent.value)}, schema)

    return docs.mapInArrow(run, ddl)


def order_of(postings: Postings, size: int, most: int) -> list[np.ndarray]:
    """Ranges of at most so many documents, in the order that recursive bisection gives."""
    out, open_ = [], [np.arange(len(postings.sizes))]
    while open_:
        docs = open_.pop()
        if len(docs) <= most:
            out.append(docs)
        else:
            terms, of = postings.of(docs)  # numbers without the terms that nobody here holds
            held, codes = np.unique(terms, return_inverse=True)
            small = Postings([])
            small.terms, small.sizes = codes, postings.sizes[docs]
            small.ends = np.cumsum(small.sizes)
            small.starts = small.ends - small.sizes
            a, b, _ = bisect(small, np.arange(len(docs)), len(held))
            open_ += [docs[b], docs[a]]
    return out


# --- the index ------------------------------------------------------------------------------------------------------------------

_INDEX = "leaf int, slice int, part int, least long, ids binary, terms binary, counts binary, best binary, places binary, impacts binary"


def impacts(times: np.ndarray, n: np.ndarray, documents: int, length: int) -> np.ndarray:
    """What an occurrence count is worth in a document of n terms, in whole numbers."""
    m = 25 + (75 * n * documents) // length
    return (1_000_000_000 * times) // (1000 * times + 8 * m)


def clustered_index(docs: DataFrame, size: int, documents: int, length: int) -> DataFrame:
    """A row for each range of the documents of counted_docs; documents and length are the corpus' N and L."""
    schema = arrow_schema(_INDEX)
    sample = docs.orderBy(F.xxhash64("doc_id", "n", "terms"), "uid").limit(SAMPLE).select("terms").toArrow()  # SAMPLE rows at most
    led = stored(routed(docs, fitted_splits(sample.column("terms").to_pylist(), size)))
    slices = led.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / F.lit(SHARD)).cast("int").alias("slices"))
    dealt = led.join(F.broadcast(slices), "leaf").withColumn("slice", F.pmod(F.xxhash64("uid"), F.col("slices")).cast("int")).drop("slices")  # a row for each of 2 ** LEVELS leaves

    def build(key: tuple, group: pa.Table) -> pa.Table:
        rows, made = group.combine_chunks(), []
        postings = Postings(rows.column("terms").to_pylist())
        times = np.frombuffer(b"".join(rows.column("times").to_pylist()), np.int32).astype(np.int64)
        worth = impacts(times, np.repeat(rows.column("n").to_numpy(), postings.sizes), documents, length)
        ids = rows.column("doc_id").fill_null(_NO_ID).to_numpy()
        for part, own in enumerate(order_of(postings, size, RANGE)):
            terms, of = postings.of(own)
            sizes = postings.sizes[own]
            ends = np.cumsum(sizes)
            imp = worth[np.repeat(postings.starts[own] - (ends - sizes), sizes) + np.arange(len(terms))]
            order = np.lexsort((of, terms))
            terms, of, imp = terms[order], of[order], imp[order]
            held, at, counts = np.unique(terms, return_index=True, return_counts=True)
            best = np.maximum.reduceat(imp, at) if len(at) else np.zeros(0, np.int64)
            row = {"leaf": key[0].as_py(), "slice": key[1].as_py(), "part": part, "least": int(ids[own].min())}
            row |= {"ids": ids[own].tobytes(), "terms": held.astype(np.int32).tobytes(), "counts": counts.astype(np.int32).tobytes(), "best": best.astype(np.int32).tobytes()}
            row |= {"places": of.astype(np.int32).tobytes(), "impacts": imp.astype(np.int32).tobytes()}
            made.append(row)
        return pa.Table.from_pylist(made, schema)

    return dealt.groupBy("leaf", "slice").applyInArrow(build, _INDEX)


def document_frequencies(index: DataFrame, size: int) -> np.ndarray:
    """In how many documents each term is."""
    ddl = "term int, n long"
    schema = arrow_schema(ddl)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(size, np.int64)
        for batch in batches:
            for terms, counts in zip(batch.column("terms").to_pylist(), batch.column("counts").to_pylist()):
                out[np.frombuffer(terms, np.int32)] += np.frombuffer(counts, np.int32)
        held = np.flatnonzero(out)
        yield batches_out({"term": held, "n": out[held]}, schema)

    out = np.zeros(size, np.int64)
    for row in index.select("terms", "counts").mapInArrow(add, ddl).groupBy("term").agg(F.sum("n").alias("n")).collect():  # MOST_TERMS rows, about
        out[row["term"]] = row["n"]
    return out


# --- search --------------------------------------------------------------------------------------------------------------------


def _bounds(weights: np.ndarray, batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """Of each row, the highest score that each query can have there."""
    for i, (terms, best) in enumerate(zip(batch.column("terms").to_pylist(), batch.column("best").to_pylist())):
        yield i, weights[:, np.frombuffer(terms, np.int32)] @ np.frombuffer(best, np.int32).astype(weights.dtype)


def first_ranges(index: DataFrame, weights) -> DataFrame:
    """For each query the range with the highest bound: leaf, slice, part, queries (their numbers)."""
    ddl = "query int, bound long, leaf int, slice int, part int"
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = weights.value.shape[0]
        most, at = np.zeros(n, np.int64), np.zeros((n, 3), np.int64)
        for batch in batches:
            for i, bound in _bounds(weights.value, batch):
                better = bound > most
                most[better] = bound[better]
                at[better] = [batch.column(c)[i].as_py() for c in ("leaf", "slice", "part")]
        hit = np.flatnonzero(most > 0)
        yield batches_out({"query": hit, "bound": most[hit], "leaf": at[hit, 0], "slice": at[hit, 1], "part": at[hit, 2]}, schema)

    best = index.select("leaf", "slice", "part", "terms", "best").mapInArrow(run, ddl).groupBy("query").agg(F.max(F.struct("bound", "leaf", "slice", "part")).alias("x"))
    return best.groupBy("x.leaf", "x.slice", "x.part").agg(F.array_sort(F.collect_list("query")).alias("queries"), F.max("x.bound").alias("most"))


def reached_ranges(index: DataFrame, weights, least: np.ndarray) -> DataFrame:
    """The ranges whose bound reaches the least score of a query, with these queries and the highest of their bounds."""
    schema = pa.schema([*arrow_schema("leaf int, slice int, part int"), ("queries", pa.list_(pa.int32())), ("most", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, bound in _bounds(weights.value, batch):
                hit = np.flatnonzero((bound > 0) & (bound >= least))
                if len(hit):
                    rows.append((*[batch.column(c)[i].as_py() for c in ("leaf", "slice", "part")], hit.astype(np.int32), int(bound[hit].max())))
            if rows:
                yield batches_out(dict(zip(schema.names, zip(*rows))), schema)

    return index.select("leaf", "slice", "part", "terms", "best").mapInArrow(run, "leaf int, slice int, part int, queries array<int>, most long")


class Best:
    """The TOP best (score, id) of each query so far."""

    def __init__(self, least: np.ndarray):
        self.least, self.held = least.copy(), {}

    def add(self, query: int, scores: np.ndarray, ids: np.ndarray) -> None:
        if query in self.held:
            scores, ids = np.concatenate((self.held[query][0], scores)), np.concatenate((self.held[query][1], ids))
        order = np.lexsort((ids, -scores))[:TOP]
        self.held[query] = scores[order], ids[order]
        if len(order) == TOP:
            self.least[query] = max(self.least[query], scores[order[-1]])


def visited(index: DataFrame, ranges: DataFrame, weights, least: np.ndarray) -> DataFrame:
    """query, doc_id, score: the best of each task's ranges, read in falling order of bounds."""
    ddl = "query int, doc_id long, score long"
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(least)
        for batch in batches:
            for i in np.argsort(-batch.column("most").to_numpy(), kind="stable").tolist():
                row = {c: batch.column(c)[i].as_py() for c in ("queries", "ids", "terms", "counts", "best", "places", "impacts")}
                ids, (terms, counts, top, places, worth) = np.frombuffer(row["ids"], np.int64), (np.frombuffer(row[c], np.int32) for c in ("terms", "counts", "best", "places", "impacts"))
                queries = np.array(row["queries"], np.int64)
                own = weights.value[queries][:, terms]
                open_ = own @ top.astype(own.dtype) >= best.least[queries]
                queries, own = queries[open_], own[open_]
                if not len(queries):
                    continue
                table = np.zeros((len(terms), len(ids)), own.dtype)
                table[np.repeat(np.arange(len(terms)), counts), places] = worth
                scores = (own @ table).astype(np.int64)
                hit = (scores > 0) & (scores >= best.least[queries, None])
                for k in np.flatnonzero(hit.any(axis=1)).tolist():
                    best.add(int(queries[k]), scores[k, hit[k]], ids[hit[k]])
        for query, (scores, ids) in best.held.items():
            yield batches_out({"query": [query] * len(ids), "doc_id": pa.array(ids, mask=ids == _NO_ID), "score": scores}, schema)

    keys = ["leaf", "slice", "part"]
    return index.join(ranges, keys).select("most", "queries", "ids", "terms", "counts", "best", "places", "impacts").mapInArrow(run, ddl)


def ranked(found: DataFrame) -> DataFrame:
    """The TOP rows of each query with their rank."""
    order = "row_number() over (partition by query order by score desc, doc_id asc nulls last)"
    return found.withColumn("rank", F.expr(order).cast("int")).where(F.col("rank") <= TOP)


def _block(docs: DataFrame, items: list[tuple]) -> DataFrame:
    """item_id, rank, doc_id, score of a block of items (id, text)."""
    spark = docs.sparkSession
    asked = [Counter(terms_of(text)) for _, text in items]
    vocabulary = {t: i for i, t in enumerate(sorted({t for a in asked for t in a}))}
    held = stored(counted_docs(docs, vocabulary))
    documents, length = held.agg(F.count(F.lit(1)), F.sum("n")).first()
    empty = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    if not documents or not vocabulary:
        return empty
    index = stored(clustered_index(held, len(vocabulary), documents, length))
    df = document_frequencies(index, len(vocabulary))
    own = [math.floor(1000 * math.log((2 * documents + 2) / (2 * k + 1))) for k in df.tolist()]
    most = max(sum(k * own[vocabulary[t]] for t, k in a.items()) for a in asked) * 1_000_000
    weights = np.zeros((len(items), len(vocabulary)), np.float64 if most < 1 << 53 else np.int64)  # doubles hold such sums exactly
    for i, a in enumerate(asked):
        for t, k in a.items():
            weights[i, vocabulary[t]] = k * own[vocabulary[t]]
    sent = spark.sparkContext.broadcast(weights)
    least = np.zeros(len(items), np.int64)
    first = ranked(visited(index, first_ranges(index, sent), sent, least))
    for row in first.where(F.col("rank") == TOP).collect():  # a row for each query of the block at most
        least[row["query"]] = row["score"]
    ranges = stored(reached_ranges(index, sent, least))
    found = ranked(visited(index, ranges, sent, least))
    names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(items)], "query int, item_id long")
    return stored(found.join(names, "query").select("item_id", "rank", "doc_id", "score"))


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the TOP documents of each item with a score above 0."""
    small_batches(docs.sparkSession)
    own = docs.select(docs[id_col].cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("uid"), docs[text_col].alias("text"))
    asked = items.select(items[item_col].cast("long").alias("item_id"), items[item_text].alias("text"), F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 30)).alias("deal"))
    n, chars = asked.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-n // QUERIES), -(-chars // (MOST_TERMS * 8)))
    asked = stored(asked) if blocks > 1 else asked
    out = None
    for b in range(blocks):
        rows = asked.where(F.col("deal") % blocks == b).select("item_id", "text").collect()  # a block of queries
        if rows:
            found = _block(own, [tuple(r) for r in rows])
            out = found if out is None else out.union(found)
    return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long") if out is None else out
