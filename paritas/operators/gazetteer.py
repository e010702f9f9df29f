"""Names of a table found in running text, by Aho-Corasick automata.

The names are dealt to shards of at most about SHARD_BYTES; an automaton of a shard is built once in a worker and finds all
its names in one pass over a text, however many there are.  A name counts where no letter, digit or underscore stands next
to it.  Of overlapping names the longest wins, of equal ones the leftmost.  With one shard, texts are read once and nothing is
shuffled; with more, each shard reads the texts once, and a text's finds meet by its key before the longest are chosen.

Letters are compared in lower case, character by character (one whose lower case is longer stays).  Null and empty names
and texts match nothing; a name that is given twice has the values of both rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of names in an automaton, which takes some 50 times as much in a worker.
SHARD_BYTES = 8 << 20


def lowered(text: str) -> str:
    """Lower case of the same length."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def inside_word(text: str, at: int) -> bool:
    return 0 <= at < len(text) and (text[at].isalnum() or text[at] == "_")


def automaton(names: Sequence[str]):
    import ahocorasick

    out = ahocorasick.Automaton()
    for i, name in enumerate(names):
        out.add_word(name, (i, len(name)))
    out.make_automaton()
    return out


def finds(machine, text: str) -> list[tuple[int, int, int]]:
    """(start, end, number of the name) of all names in a text, overlapping ones too."""
    low = lowered(text)
    if not len(machine):
        return []
    met = ((end + 1 - size, end + 1, i) for end, (i, size) in machine.iter(low))
    return [(a, b, i) for a, b, i in met if not inside_word(low, a - 1) and not inside_word(low, b)]


def longest(found: Sequence[tuple[int, int]]) -> list[int]:
    """Places of the (start, end) that stay when longer ones go first, then those further left; in the order of the text."""
    taken: list[int] = []
    if not found:
        return taken
    covered = np.zeros(max(b for _, b in found), bool)
    for k in sorted(range(len(found)), key=lambda k: (found[k][0] - found[k][1], found[k][0], k)):
        a, b = found[k]
        if not covered[a:b].any():
            covered[a:b] = True
            taken.append(k)
    return sorted(taken, key=lambda k: found[k][0])


def _lowered(text: Column) -> Column:
    """As lowered()."""
    one = lambda c: F.when(F.char_length(F.lower(c)) == 1, F.lower(c)).otherwise(c)
    return F.when(F.char_length(F.lower(text)) == F.char_length(text), F.lower(text)).otherwise(F.array_join(F.transform(F.regexp_extract_all(text, F.lit("(?s)(.)")), one), ""))


def _shards(names: DataFrame, name: str, value: str | None) -> list[list[tuple[str, list[str]]]]:
    """The distinct lower-cased names with their values, in shards."""
    values = F.array_sort(F.collect_set(F.col(value).cast("string"))) if value else F.array().cast("array<string>")
    known = names.where(F.char_length(name) > 0)
    rows = known.groupBy(_lowered(F.col(name)).alias("__name")).agg(values.alias("__values"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("__name")), F.lit(0))).first()[0]
    shards = max(1, -(-size // SHARD_BYTES))
    return [[(r["__name"], r["__values"]) for r in rows.where(F.pmod(F.xxhash64("__name"), F.lit(shards)) == s).collect()] for s in range(shards)]  # a bounded shard at a time


def mentions(texts: DataFrame, names: DataFrame, key: str = "doc_id", text: str = "text", name: str = "name", value: str | None = None) -> DataFrame:
    """key, mentions (an array of start, end, name, values in the order of the text) of every text; key is unique.

    Places are characters of the text, from 0; names are as found, in lower case.
    """
    spark = texts.sparkSession
    shards = _shards(names, name, value)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("name", pa.string()), ("values", pa.list_(pa.string()))]))
    ddl = "mentions array<struct<start:int,end:int,name:string,values:array<string>>>"
    out = None
    for shard in shards:
        sent = spark.sparkContext.broadcast(shard)

        def run(batches: Iterator[pa.RecordBatch], sent=sent, alone=len(shards) == 1) -> Iterator[pa.RecordBatch]:
            held = sent.value
            machine = automaton([n for n, _ in held])
            for batch in batches:
                rows = []
                for t in batch.column("__text").to_pylist():
                    found = finds(machine, t or "")
                    chosen = longest([f[:2] for f in found]) if alone else range(len(found))
                    rows.append([{"start": found[k][0], "end": found[k][1], "name": held[found[k][2]][0], "values": held[found[k][2]][1]} for k in chosen])
                yield pa.RecordBatch.from_arrays([batch.column("__key"), pa.array(rows, kind)], names=[key, "mentions"])

        asked = texts.select(F.col(key).alias("__key"), F.col(text).alias("__text"))
        met = asked.mapInArrow(run, f"{key} {asked.schema['__key'].dataType.simpleString()}, {ddl}")
        out = met if out is None else out.unionByName(met)
    if len(shards) == 1:
        return out
    gathered = out.groupBy(key).agg(F.flatten(F.collect_list("mentions")).alias("mentions"))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for found in batch.column("mentions").to_pylist():
                found = sorted(found, key=lambda f: (f["end"], f["start"]))
                rows.append([found[k] for k in longest([(f["start"], f["end"]) for f in found])])
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(rows, kind)], names=[key, "mentions"])

    return gathered.mapInArrow(choose, gathered.schema)


def gazetteer_sensor(texts: DataFrame, names: DataFrame, value: str, key: str = "doc_id", text: str = "text", name: str = "name") -> DataFrame:
    """key, values: the values of the names that each text mentions, sorted; texts without a mention have none."""
    found = mentions(texts, names, key, text, name, value)
    return found.select(key, F.array_sort(F.array_distinct(F.flatten(F.transform("mentions", lambda m: m["values"])))).alias("values"))


def entities(texts: DataFrame, names: DataFrame, label: str, value: str, key: str = "doc_id", text: str = "text", name: str = "name") -> DataFrame:
    """key, entity, label, values: a row for each mention, as entity_sensor takes them."""
    found = mentions(texts, names, key, text, name, value).select(key, F.explode("mentions").alias("m"))
    return found.select(key, F.col("m.name").alias("entity"), F.lit(label).alias("label"), F.col("m.values").alias("values"))
