"""Phrases, ranked search and the n-gram Jaccard join against brute force."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from paritas.llm import jaccard_join, phrases, ranked_search
from tests.llm import data
from tests.llm.test_texts import lower

SEPARATORS = re.compile(r"[.,;:!?\x0A-\x0D]")


def phrases_by_hand(rows, least, top):
    f = defaultdict(Counter)
    for lang, text in rows:
        for piece in SEPARATORS.split(lower(text or "")):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            for n in range(1, 5):
                f[lang or "und"].update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    out = []
    for lang, counts in f.items():
        n = sum(k for g, k in counts.items() if len(g) == 1)
        often = {g: k for g, k in counts.items() if len(g) > 1 and k >= least}
        longer = Counter()
        for g, k in often.items():
            for m in range(2, len(g)):
                for i in range(len(g) - m + 1):
                    longer[g[i : i + m]] = max(longer[g[i : i + m]], k)
        found = []
        for g, a in often.items():
            if 100 * longer[g] >= 80 * a:
                continue
            score, _, left, right = min((2_000_000 * a // (counts[g[:k]] + counts[g[k:]]), k, counts[g[:k]], counts[g[k:]]) for k in range(1, len(g)))
            found.append((-score, -a, " ".join(g).encode(), left, right))
        out += [(lang, i, p.decode(), -a, x, y, n, -s) for i, (s, a, p, x, y) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def phrase_rows(seed=3):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(25)] + ["Été", "ÀB", "x|y", "日本"]
    weights = [1 / (i + 1) for i in range(len(words))]
    end = lambda: r.choice([" ", " ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r", " ! "])
    rows = [(r.choice(["en", "de", None]), "".join(w + end() for w in r.choices(words, weights, k=r.randint(0, 80)))) for _ in range(60)]
    return [*rows, ("en", None), (None, ""), ("fr", " . ,"), ("en", "w0 w0 w0 w0 w0 w0 w0"), ("en", "W0 w1 W0 w1 w0 w1"), rows[0], ("de", "w1 w2 w3 " * 2000)]


@pytest.mark.parametrize(("least", "top", "numbered", "flush"), [(3, 1000, 10**6, 10**6), (2, 7, 10**6, 300), (3, 50, 9, 500), (30, 2000, 10**6, 10**6)])
def test_phrases_are_brute_force(spark, monkeypatch, least, top, numbered, flush):
    monkeypatch.setattr(phrases, "MOST_WORDS", numbered)  # the words beyond go by their hash
    monkeypatch.setattr(phrases, "FLUSH", flush)
    rows = phrase_rows()
    docs = spark.createDataFrame([(*x, 1, "k") for x in rows], "lang string, text string, n int, key string").repartition(3)
    got = phrases.collocations(docs, least=least, top=top).collect()
    assert sorted(tuple(r) for r in got) == phrases_by_hand(rows, least, top)


def test_phrases_of_a_hot_word_and_of_nothing(spark):
    rows = [("en", "the " * 3000 + "end of the line"), ("en", "the of " * 2000), ("en", "of the end " * 40)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert sorted(tuple(r) for r in phrases.collocations(docs).collect()) == phrases_by_hand(rows, 30, 2000)
    assert phrases.collocations(data.none(spark)).collect() == []
    assert phrases.collocations(spark.createDataFrame([("en", None)], "lang string, text string")).collect() == []


def test_phrases_stand_odd_rows(spark):
    docs = data.documents(spark)
    rows = [(r["lang"], r["text"]) for r in docs.collect()]
    assert sorted(tuple(r) for r in phrases.collocations(docs, least=5).collect()) == phrases_by_hand(rows, 5, 2000)


def test_fragments_hold_each_ngram_once():
    r = np.random.default_rng(1)
    words = r.integers(0, 6, 500)
    left, right = phrases.reach(words)
    at = np.flatnonzero(left + right > 0)
    got = Counter()
    for rows, n in phrases.mine(phrases.laid_out(words, at, left[at], right[at]), left[at], right[at], 1):
        got.update({tuple(g): k for g, k in zip(rows.tolist(), n.tolist())})
    want = Counter(tuple(words[i : i + n].tolist()) for n in (2, 3, 4) for i in range(len(words) - n + 1) if (words[i : i + n] > 0).all())
    assert got == want


# --- ranked search ------------------------------------------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def search_by_hand(docs, items, top=10):
    """(item, rank, doc, score); documents in the order given stand for equal ids."""
    held = [(i, TERM.findall(lower(t or ""))) for i, t in docs]
    held = [(i, Counter(w), len(w)) for i, w in held if w]
    total, count, df = sum(n for _, _, n in held), len(held), Counter(t for _, w, _ in held for t in w)
    out = []
    for item, text in items:
        found = []
        for i, w, n in held:
            score = 0
            for t, k in Counter(TERM.findall(lower(text or ""))).items():
                if w[t]:
                    weight = math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1)))
                    score += k * weight * (1_000_000_000 * w[t] // (1000 * w[t] + 8 * (25 + 75 * n * count // total)))
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(item, rank, None if null else i, -s) for rank, (s, null, i) in enumerate(sorted(found)[:top], 1)]
    return sorted(out, key=str)


def search_rows(n=400, seed=5):
    r = random.Random(seed)
    topics = [[f"t{k}w{i}" for i in range(15)] for k in range(8)]
    common = ["The", "of", "été", "42", "日本語"]
    text = lambda k: " ".join(r.choice(topics[k]) if r.random() < 0.7 else r.choice(common) for _ in range(r.randint(1, 60)))
    docs = [(i, text(i % 8)) for i in range(n)]
    docs += [(n, None), (n + 1, ""), (n + 2, "!? --"), (None, docs[3][1]), (7, docs[3][1]), (n + 3, docs[3][1]), (n + 4, docs[5][1]), (n + 5, docs[5][1]), (n + 6, "t1w1 " * 20000)]
    items = [(k, text(k % 8)) for k in range(20)] + [(20, None), (21, "zzz"), (22, ""), (3, "the The THE t1w1"), (23, docs[3][1]), (24, docs[5][1]), (None, "t2w3, t2w4")]
    return docs, items


@pytest.mark.parametrize(("size", "most", "queries"), [(16384, 256, 256), (64, 8, 256), (100, 16, 4)])
def test_ranked_search_is_brute_force(spark, monkeypatch, size, most, queries):
    for name, value in (("SHARD", size), ("RANGE", most), ("SAMPLE", size), ("LEVELS", 3), ("QUERIES", queries)):
        monkeypatch.setattr(ranked_search, name, value)
    docs, items = search_rows()
    frame = spark.createDataFrame([(*x, "a", 1) for x in docs], "doc_id long, text string, leaf string, n int").repartition(4)
    asked = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, doc_id int")
    got = ranked_search.search(frame, asked).collect()
    assert sorted(map(tuple, got), key=str) == search_by_hand(docs, items)


def test_ranked_search_of_nothing(spark):
    docs, items = search_rows(20)
    frame, asked = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert ranked_search.search(frame.where("false"), asked).collect() == []
    assert ranked_search.search(frame, asked.where("false")).collect() == []
    assert ranked_search.search(frame.where("text is null"), asked).collect() == []
    assert ranked_search.search(frame, asked.where("text is null")).collect() == []


def test_ranked_search_skips_ranges(spark, monkeypatch):
    """Documents of other topics lie in other ranges, which the bounds leave out."""
    monkeypatch.setattr(ranked_search, "RANGE", 32)
    docs, _ = search_rows(4000)
    held = ranked_search.counted_docs(spark.createDataFrame([(i, k, t) for k, (i, t) in enumerate(docs)], "doc_id long, uid long, text string"), {b"t1w%d" % i: i for i in range(15)})
    n, length = held.agg(F.count(F.lit(1)), F.sum("n")).first()
    index = ranked_search.clustered_index(held, 15, n, length)
    sent = spark.sparkContext.broadcast(np.ones((1, 15)))
    first = ranked_search.ranked(ranked_search.visited(index, ranked_search.first_ranges(index, sent), sent, np.zeros(1, np.int64))).collect()
    assert ranked_search.reached_ranges(index, sent, np.array([min(r["score"] for r in first)])).count() < index.count() / 3


def test_bisection_parts_topics():
    r = np.random.default_rng(2)
    topic = r.integers(0, 2, 200)
    terms = [np.unique(t * 10 + r.integers(0, 10, 6)).astype(np.int32).tobytes() for t in topic]
    a, b, _ = ranked_search.bisect(ranked_search.Postings(terms), np.arange(200), 20, 20)
    assert len(a) == len(b) == 100
    assert max(topic[a].mean(), topic[b].mean()) > 0.9 and sorted(np.concatenate([a, b])) == list(range(200))


# --- the n-gram Jaccard join -----------------------------------------------------------------------------------------------------


def shingles_by_hand(text, size=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
    return {" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def jaccard_by_hand(rows):
    sets = [shingles_by_hand(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            if x and sets[j] and 100 * len(x & sets[j]) >= 80 * len(x | sets[j]):
                parent[find(i)] = find(j)
    least = defaultdict(lambda: None)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = d if least[find(i)] is None else min(d, least[find(i)])
    return sorted(((d, len(sets[i]), least[find(i)] if sets[i] else d) for i, (d, _) in enumerate(rows)), key=str)


def joined(spark, rows, parts=3):
    docs = spark.createDataFrame([(*x, 1, 2, "n") for x in rows], "doc_id long, text string, node int, size int, key string").repartition(parts)
    return sorted(map(tuple, jaccard_join.jaccard_components(docs).collect()), key=str)


def edited(r, words, share):
    return [r.choice("abcdefgh") * 3 + str(r.randint(0, 999)) if r.random() < share else w for w in words]


def near_rows(seed=1, groups=25, dense=60):
    r = random.Random(seed)
    fresh = lambda n: [f"{r.choice('xyz')}{r.randint(0, 5000)}" for _ in range(n)]
    passage = fresh(40)
    texts = []
    for _ in range(groups):
        base = fresh(r.randint(6, 220))
        texts += [" ".join(edited(r, base, s)) for s in (0, 0.01, 0.02, 0.04, 0.05)] + [" ".join(base[: int(len(base) * 0.82)]), " ".join(base).upper()]
    base = fresh(150)
    texts += [" ".join(edited(r, base, r.choice([0.01, 0.02, 0.03, 0.04]))) for _ in range(dense)]
    texts += [" ".join(fresh(60) + passage + fresh(60)) for _ in range(30)] + [" ".join(passage[:20])] * 2
    texts += [None, "", " \n", "one", "One", "a b c", "a b c d e", "a  b\tc d\ne", "a b c d e f"] + [texts[0]] * 5
    r.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("tile", [2_000_000, 20_000])
def test_jaccard_join_is_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(jaccard_join, "TILE", tile)  # lists with more go block by block
    rows = near_rows(tile)
    assert joined(spark, rows) == jaccard_by_hand(rows)


def test_jaccard_join_of_a_dense_group_near_the_threshold(spark):
    """Hundreds of copies of one text of which most pairs lie just below or above the similarity, so that trees fail."""
    r = random.Random(9)
    base = [f"b{i}" for i in range(120)]
    rows = [(i, " ".join(edited(r, base, 0.022))) for i in range(250)]
    assert joined(spark, rows) == jaccard_by_hand(rows)


def test_jaccard_join_of_ids_that_repeat_or_are_null(spark):
    rows = [(i % 40 if i % 7 else None, t) for i, t in near_rows(4, 8, 10)]
    assert joined(spark, [*rows, *rows[:5], (None, None)]) == jaccard_by_hand([*rows, *rows[:5], (None, None)])


def test_jaccard_join_of_nothing_and_of_odd_rows(spark):
    assert jaccard_join.jaccard_components(data.none(spark)).collect() == []
    assert joined(spark, [(1, None), (2, ""), (3, " ")]) == [(1, 0, 1), (2, 0, 2), (3, 0, 3)]
    docs = data.documents(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted(map(tuple, jaccard_join.jaccard_components(docs).collect()), key=str) == jaccard_by_hand(rows)


def test_bitmaps_bound_the_overlap():
    r = np.random.default_rng(7)
    sets = [np.unique(r.integers(0, 1 << 62, n).astype(np.uint64)) for n in (1, 5, 63, 64, 65, 200, 500, 1000)]
    sets += [np.unique(np.concatenate([s[: len(s) * 9 // 10], r.integers(0, 1 << 62, len(s) // 10 + 1).astype(np.uint64)])) for s in sets]
    maps = [jaccard_join.bitmap(s) for s in sets]
    width = np.array([len(m) for m in maps])
    at, flat = np.cumsum(width) - width, np.concatenate(maps)
    i, j = np.triu_indices(len(sets), 1)
    differ = jaccard_join.differing(flat, at, width, i, j)
    for a, b, d in zip(i.tolist(), j.tolist(), differ.tolist()):
        both = len(np.intersect1d(sets[a], sets[b]))
        assert d <= len(sets[a]) + len(sets[b]) - 2 * both
        assert jaccard_join.overlap(sets[a], sets[b]) == both
