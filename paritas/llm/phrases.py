"""Phrase collocations by pivot partitioning, as in MG-FSM.

1. Words are counted for each language, and the frequent ones ordered: the rarest has the largest number.  An n-gram's
   *pivot* is the one of its words with the largest number (the leftmost occurrence, if it holds it twice).
2. Every word occurrence that is the pivot of some n-gram sends one *fragment* to the partition of that word: itself, up to
   three words to its left that are more frequent and up to three to its right that are no rarer.  Rarer words, infrequent
   words and the ends of a piece cut it.  So each n-gram occurrence lies in exactly one fragment that counts it.
3. A partition is mined bucket by bucket, level by level: an n-gram is counted only where the shorter ones around the same
   pivot are frequent, and only n-grams that hold the pivot are emitted.  Fragments of words so frequent that they would
   fill half a partition are mined where they are made; they hold more frequent words only, thus few different ones, and
   their counts are summed after a shuffle by n-gram.
4. Cuts, the drop of phrases inside longer ones, scores and ranks are joins and aggregations.

Memory: a task holds the counts of MOST_HELD words, the fragments of FLUSH words, or one bucket.  The numbers of the
MOST_WORDS most frequent words are broadcast (16 bytes each); rarer ones go by their 62-bit hash, as rarest of all.
Words are told apart by that hash of language and word.

Defined results: null text is empty; null lang is ``und``; texts of any length are read whole; a repeated row counts as
often as it is there; an empty table gives no rows.  Other columns aren't read, whatever their names.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paritas.llm.common import LOWER, UPPER, arrow_schema, batches_out, partitions, small_batches, stored, text_batches

LEAST, LONGEST, TOP, INSIDE = 30, 4, 2000, (80, 100)
#: Bounds of memory: numbered words, distinct words that a task counts, words of which the fragments are held, words of a bucket.
MOST_WORDS, MOST_HELD, FLUSH, BUCKET = 2_000_000, 1_000_000, 4_000_000, 1_000_000
#: The bytes that end a piece, and those that part words.
ENDS, BLANKS = ".,;:!?\n\x0b\x0c\r", " \t"
_TABLE = bytes.maketrans((UPPER + ENDS + BLANKS).encode(), (LOWER + "\n" * len(ENDS) + " " * len(BLANKS)).encode())
_HASHED = 1 << 62


def words_of(texts: list[str]) -> list[bytes]:
    """Lower-cased words, a line feed where a piece or text ends, and empty strings between blanks."""
    return "\n".join(texts).encode().translate(_TABLE).replace(b"\n", b" \n ").split(b" ")


def _by_lang(batch: pa.RecordBatch) -> Iterator[tuple[str, list[str]]]:
    for part, texts in text_batches(batch, "text"):
        met = defaultdict(list)
        for lang, text in zip(part.column("lang").to_pylist(), texts):
            met[lang].append(text)
        yield from met.items()


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, word, n of docs (lang, text); the row without a word has the language's total."""
    ddl = "lang string, word string, n long"
    schema = arrow_schema(ddl)

    def out(counts: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, words in counts.items():
            words.pop(b"", None)
            words.pop(b"\n", None)
            names, n = [None, *map(bytes.decode, words)], [words.total(), *words.values()]
            for at in range(0, len(n), 100_000):
                yield batches_out({"lang": [lang] * len(n[at : at + 100_000]), "word": names[at : at + 100_000], "n": n[at : at + 100_000]}, schema)
        counts.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = defaultdict(Counter)
        for batch in batches:
            for lang, texts in _by_lang(batch):
                counts[lang].update(words_of(texts))
                if sum(map(len, counts.values())) > MOST_HELD:
                    yield from out(counts)
        yield from out(counts)

    return docs.mapInArrow(run, ddl).groupBy("lang", "word").agg(F.sum("n").alias("n"))


def word_hash(lang: Column, word: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.concat(lang, F.lit("\0"), word)), 2)


class Numbers:
    """Numbers of one language's words, from the sorted hashes of all; words met before are kept."""

    def __init__(self, lang: str, hashes: np.ndarray, numbers: np.ndarray, whole: bool):
        self.prefix, self.hashes, self.numbers, self.whole = lang.encode() + b"\0", hashes, numbers, whole
        self.known: dict[bytes, int] = {b"\n": 0, b"": -1}

    def of(self, words: list[bytes]) -> np.ndarray:
        from xxhash import xxh64_intdigest

        if len(self.known) > MOST_HELD:
            self.known = {b"\n": 0, b"": -1}
        new = list(set(words) - self.known.keys())
        if new:
            h = np.fromiter((xxh64_intdigest(self.prefix + w, 42) >> 2 for w in new), np.int64, len(new))
            at = np.minimum(np.searchsorted(self.hashes, h), max(0, len(self.hashes) - 1))
            found = self.hashes[at] == h if len(self.hashes) else np.zeros(len(h), bool)
            numbers = np.where(found, self.numbers[at] if len(self.hashes) else 0, 0 if self.whole else h + _HASHED)
            self.known.update(zip(new, numbers.tolist()))
        out = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        return out[out >= 0]


def reach(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How far each word's fragment goes to the left and right (0 for both: it is no pivot); 0 in words is a cut."""
    n, most = len(words), LONGEST - 1
    wide = np.concatenate((np.zeros(most, np.int64), words, np.zeros(most, np.int64)))
    sides = []
    for sign, same in ((-1, 0), (1, 1)):  # an equal word to the left is the pivot instead
        side, open_ = np.zeros(n, np.uint8), words > 0
        for k in range(1, LONGEST):
            other = wide[most + sign * k : most + sign * k + n]
            open_ = open_ & (other > 0) & (other < words + same)
            side += open_
        sides.append(side)
    return sides[0], sides[1]


def laid_out(words: np.ndarray, at: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The words of the fragments of the pivots at these places, one after another."""
    sizes = 1 + left.astype(np.int64) + right
    ends = np.cumsum(sizes)
    return words[np.repeat(at - left - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]


def _packed(columns: list[np.ndarray]) -> list[np.ndarray]:
    """Columns of numbers below 2**32, two in each."""
    pairs = [columns[i : i + 2] for i in range(0, len(columns), 2)]
    return [(p[0].astype(np.uint64) << np.uint64(32)) | p[1].astype(np.uint64) if len(p) > 1 else p[0].astype(np.uint64) for p in pairs]


def counted(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows given by columns: the place of one row of each kind, how often each kind occurs, each row's kind."""
    keys = _packed(columns)
    order = np.argsort(keys[0], kind="stable") if len(keys) == 1 else np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.any([k[order[1:]] != k[order[:-1]] for k in keys], axis=0)
    starts = np.flatnonzero(new)
    kind = np.empty(len(order), np.int64)
    kind[order] = np.cumsum(new) - 1
    return order[starts], np.diff(np.concatenate((starts, [len(order)]))), kind


def mine(words: np.ndarray, left: np.ndarray, right: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(n-grams as rows, counts) of 2 to LONGEST words that hold their fragment's pivot and occur at least so often."""
    names = None
    if len(words) and words.max() >= 1 << 32:
        names, words = np.unique(words, return_inverse=True)
    n, most = len(left), LONGEST - 1
    sizes = 1 + left.astype(np.int64) + right
    ends = np.cumsum(sizes)
    grid = np.zeros((n, 2 * LONGEST - 1), np.uint32)
    row = np.repeat(np.arange(n), sizes)
    grid[row, np.arange(len(words)) - np.repeat(ends - sizes, sizes) + most - np.repeat(left.astype(np.int64), sizes)] = words
    #: frequent[a, b]: fragments in which the n-gram of a words to the left and b to the right is frequent
    frequent = {(0, 0): np.ones(n, bool)}
    for size in range(2, LONGEST + 1):
        spans, rows = [], []
        for a in range(size):
            b = size - 1 - a
            there = (left >= a) & (right >= b)
            for inner in ((a - 1, b), (a, b - 1)):
                if min(inner) >= 0:
                    there &= frequent[inner]
            at = np.flatnonzero(there)
            spans.append((a, b, at))
            rows.append(grid[at, most - a : most + b + 1])
        rows = np.concatenate(rows)
        one, n_of, kind = counted(list(rows.T))
        often = n_of >= least
        found = rows[one[often]]
        if len(found):
            yield (found.astype(np.int64) if names is None else names[found]), n_of[often]
        ok = often[kind]
        start = 0
        for a, b, at in spans:
            frequent[a, b] = np.zeros(n, bool)
            frequent[a, b][at[ok[start : start + len(at)]]] = True
            start += len(at)


def _planes(words: np.ndarray) -> tuple[bytes, int]:
    """Numbers byte plane by byte plane: the high bytes are mostly zero."""
    width = 4 if not len(words) or words.max() < 1 << 32 else 8
    return words.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes(), width


def _from_planes(raw: bytes, width: int) -> np.ndarray:
    return np.frombuffer(raw, np.uint8).reshape(width, -1).T.copy().view(f"<u{width}").ravel().astype(np.int64)


_GRAMS = "w1 long, w2 long, w3 long, w4 long, n long"
_GRAM_SCHEMA = arrow_schema(_GRAMS)


def _grams_out(found: Iterator[tuple[np.ndarray, np.ndarray]], hash_of: np.ndarray) -> Iterator[dict]:
    for rows, n in found:
        h = np.where(rows >= _HASHED, rows - _HASHED, hash_of[np.minimum(rows, len(hash_of)) - 1] if len(hash_of) else 0)
        yield {f"w{i + 1}": h[:, i] if i < h.shape[1] else pa.nulls(len(h), pa.int64()) for i in range(LONGEST)} | {"n": n}


def frequent_grams(docs: DataFrame, words: DataFrame, total: int, least: int = LEAST) -> DataFrame:
    """w1 to w4 (hashes of words, null beyond the n-gram's end), n of every n-gram that occurs at least so often.

    words (h, n) are the frequent words, total the number of all word occurrences.
    """
    spark = docs.sparkSession
    top = words.select("h", "n").orderBy(F.desc("n"), "h").limit(MOST_WORDS).toArrow()  # MOST_WORDS rows at most
    hash_of, times = top.column("h").to_numpy(), top.column("n").to_numpy()
    whole = len(hash_of) < MOST_WORDS
    parts = max(partitions(docs), -(-total // (16 * BUCKET)))
    buckets = max(8 * parts, total // BUCKET)
    hot = int((times > max(1000, total // (2 * parts))).sum())  # words are numbered by falling frequency, from 1
    order = np.argsort(hash_of)
    sent = spark.sparkContext.broadcast((hash_of, hash_of[order], order + 1))
    ddl = "bucket int, width int, shapes binary, words binary, " + _GRAMS
    schema = arrow_schema(ddl)
    nothing = {"w1": None, "w2": None, "w3": None, "w4": None, "n": None}

    def fragments(words: np.ndarray) -> Iterator[pa.RecordBatch]:
        left, right = reach(words)
        here = left + right > 0
        mined = np.flatnonzero(here & (words <= hot))
        for rows in _grams_out(mine(laid_out(words, mined, left[mined], right[mined]), left[mined], right[mined], 1), sent.value[0]):
            none = pa.nulls(len(rows["n"]))
            yield batches_out({**rows, "bucket": none.cast(pa.int32()), "width": none.cast(pa.int32()), "shapes": none.cast(pa.binary()), "words": none.cast(pa.binary())}, schema)
        at = np.flatnonzero(here & (words > hot))
        mixed = words[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        bucket = ((mixed >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        at, bucket = at[order], bucket[order]
        edges = np.concatenate(([0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)])) if len(bucket) else np.zeros(1, np.int64)
        made: dict[str, list] = defaultdict(list)
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            some = at[a:b]
            raw, width = _planes(laid_out(words, some, left[some], right[some]))
            for k, v in (("bucket", bucket[a]), ("width", width), ("shapes", (left[some] * LONGEST + right[some]).tobytes()), ("words", raw)):
                made[k].append(v)
            if len(made["bucket"]) == 200 or b == len(at):
                yield batches_out(made | {k: [None] * len(made["bucket"]) for k in nothing}, schema)
                made.clear()

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, hashes, numbers = sent.value
        of: dict[str, Numbers] = {}
        held: list[np.ndarray] = []
        for batch in batches:
            for lang, texts in _by_lang(batch):
                if lang not in of:
                    of[lang] = Numbers(lang, hashes, numbers, whole)
                held += [of[lang].of(words_of(texts)), np.zeros(1, np.int64)]
                if sum(map(len, held)) > FLUSH:
                    yield from fragments(np.concatenate(held))
                    held.clear()
        if held:
            yield from fragments(np.concatenate(held))

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        now = None

        def close() -> Iterator[pa.RecordBatch]:
            words, shapes = (np.concatenate(x) for x in zip(*held))
            held.clear()
            for rows in _grams_out(mine(words, shapes // LONGEST, shapes % LONGEST, least), sent.value[0]):
                yield batches_out(rows, _GRAM_SCHEMA)

        for batch in batches:
            for bucket, width, shapes, words in zip(*(batch.column(c).to_pylist() for c in ("bucket", "width", "shapes", "words"))):
                if held and bucket != now:
                    yield from close()
                now = bucket
                held.append((_from_planes(words, width), np.frombuffer(shapes, np.uint8)))
        if held:
            yield from close()

    made = stored(docs.mapInArrow(send, ddl), "lz4")
    dealt = made.where("bucket is not null").select("bucket", "width", "shapes", "words").repartition(parts, "bucket").sortWithinPartitions("bucket")
    early = made.where("bucket is null").select("w1", "w2", "w3", "w4", "n")
    grams = ["w1", "w2", "w3", "w4"]
    return dealt.mapInArrow(take, _GRAMS).union(early).groupBy(*grams).agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first phrases of each language.

    a is the phrase's count, l and r those of the parts of its lowest-scoring cut, n the language's words; the score is
    floor(2000000 * a / (l + r)).  Phrases inside a longer one that has at least four fifths of their count are left out.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(F.coalesce(docs[lang_col].cast("string"), F.lit("und")).alias("lang"), docs[text_col].alias("text"))
    counts = stored(word_counts(texts).where((F.col("n") >= least) | F.col("word").isNull()).withColumn("h", word_hash(F.col("lang"), F.col("word"))))
    totals = counts.where("word is null").select("lang", F.col("n").alias("total"))
    words = counts.where("word is not null")
    total = totals.agg(F.sum("total")).first()[0] or 0
    grams = stored(frequent_grams(texts, words, total, least))
    parts = [f"w{i}" for i in range(1, LONGEST + 1)]

    def span(first: int, size: int) -> Column:
        """Key of the sub-phrase of so many words from a place on: the hashes of its words."""
        return F.array(*[F.col(parts[i]) for i in range(first, first + size)])

    size = sum((F.col(w).isNotNull().cast("int") for w in parts), F.lit(0))
    sized = grams.withColumn("size", size)
    whole = F.when(F.col("size") == 2, span(0, 2)).when(F.col("size") == 3, span(0, 3)).otherwise(span(0, 4))
    phrases = stored(sized.select("*", whole.alias("key")))
    known = phrases.select("key", F.col("n").alias("times")).union(words.select(F.array("h"), "n"))
    cuts = None
    inner = None
    for s in range(2, LONGEST + 1):
        own = phrases.where(F.col("size") == s)
        halves = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(side).alias("side"), piece.alias("part")) for k in range(1, s) for side, piece in (("l", span(0, k)), ("r", span(k, s - k)))])
        cut = own.select("key", "n", F.inline(halves))
        cuts = cut if cuts is None else cuts.union(cut)
        if s > 2:
            inside = F.array(*[span(i, m) for m in range(2, s) for i in range(s - m + 1)])
            held = own.select(F.explode(inside).alias("key"), "n")
            inner = held if inner is None else inner.union(held)
    longest = inner.groupBy("key").agg(F.max("n").alias("longer"))
    times = cuts.join(known.withColumnRenamed("key", "part"), "part")
    both = times.groupBy("key", "n", "k").agg(F.max(F.when(F.col("side") == "l", F.col("times"))).alias("l"), F.max(F.when(F.col("side") == "r", F.col("times"))).alias("r"))
    exact = "decimal(38,0)"
    score = F.expr(f"cast(cast(2000000 as {exact}) * cast(n as decimal(20,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0))) as long)")
    scored = both.groupBy("key", "n").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    free = scored.join(longest, "key", "left").where(F.col("longer").isNull() | (INSIDE[1] * F.col("longer").cast("decimal(20,0)") < INSIDE[0] * F.col("n").cast("decimal(20,0)")))
    langs = words.select(F.col("h").alias("first"), "lang")
    kept = free.select("key", F.get("key", F.lit(0)).alias("first"), F.col("n").alias("a"), "cut.l", "cut.r", "cut.score").join(langs, "first").drop("first")
    best = stored(kept.withColumn("place", F.expr("rank() over (partition by lang order by score desc, a desc)")).where(F.col("place") <= top))
    spelt = best.select("key", F.posexplode("key").alias("i", "h")).join(words.select("h", "word"), "h").groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    ranked = best.join(spelt, "key").withColumn("rank", F.expr("row_number() over (partition by lang order by score desc, a desc, phrase)").cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
