"""Benchmark passages in documents, by greedy string tiling.

Words are compared in lower case, of all letters, and without ASCII marks. For each
text and item the longest match whose words are unmarked on both sides becomes a
tile, again and again, so passages that were reordered are covered piece by piece;
the longest match is found by running Karp-Rabin hashes of windows. A text leaks an
item if tiles of MIN_TILE words or more cover at least LEAST_COVER of its words. An
item of fewer words is leaked by a text that has all of it in a row.

One pass over the documents looks their runs of MIN_TILE words up in a bit map of
the benchmark's, of a fixed size, and keeps the runs that may be there. These seeds
are joined with the benchmark's runs. What an item's matched runs cover bounds what
tiles can, so most pairs end there; the others' texts and items are joined and
tiled. Texts are known by a 128-bit hash, equal ones are looked at once, and a row
leaks what its text does. Nothing of either table's size passes the driver.

Defined results: null texts are empty; rows without item_id are matched with
nothing; items are told apart by item_id and text; repeated documents give
repeated rows; other columns are ignored; an empty table on either side gives no
rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from .common import Scratch
from .minhash import SLICE, U64, Shingler
from .tokens import batches

MIN_TILE = 5
LEAST_COVER = 0.5
#: Bits of the map of the benchmark's runs.
MAP_BITS = 1 << 24
SALTS = 16
#: Larger tables aren't broadcast: rows of text hashes, and words of items.
BROADCAST_ROWS, BROADCAST_WORDS = 1_000_000, 4_000_000

TEXT, ITEM = ["h1", "h2"], ["item_id", "item_hash"]
SPAN = pa.struct([("item_start", pa.int32()), ("doc_start", pa.int32()), ("words", pa.int32())])
FOUND = pa.schema(
    [("h1", pa.int64()), ("h2", pa.int64()), ("item_id", pa.int64()), ("tiles", pa.int32()), ("tiled_words", pa.int32()), ("item_words", pa.int32()), ("coverage", pa.float64()), ("spans", pa.list_(SPAN))]
)
LEAK = "item_id long, tiles int, tiled_words int, item_words int, coverage double, spans array<struct<item_start:int,doc_start:int,words:int>>"


class Windows:
    """Hashes of all windows of any length over a sequence of words, from running sums."""

    BASE = 0xD1342543DE82EF95

    def __init__(self, words: np.ndarray):
        n = len(words)
        power = np.full(n + 1, self.BASE, dtype=U64)
        inverse = np.full(n + 1, pow(self.BASE, -1, 1 << 64), dtype=U64)
        power[0] = inverse[0] = 1
        self.inverse = np.cumprod(inverse, dtype=U64)
        self.sums = np.zeros(n + 1, dtype=U64)
        np.cumsum(words * np.cumprod(power, dtype=U64)[:n], out=self.sums[1:])

    def at(self, starts: np.ndarray, size: int) -> np.ndarray:
        return (self.sums[starts + size] - self.sums[starts]) * self.inverse[starts]


def free_runs(free: np.ndarray) -> np.ndarray:
    """How many unmarked words follow from each place on."""
    taken = np.append(np.flatnonzero(~free), len(free))
    return taken[np.searchsorted(taken, np.arange(len(free)))] - np.arange(len(free))


def covered(starts: np.ndarray, size: int, n: int) -> np.ndarray:
    """The places that windows of this size cover."""
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + size, -1)
    return np.cumsum(edge)[:n] > 0


def tile(item: np.ndarray, doc: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Tiles (start in item, start in doc, words): the longest first, then by their start in the item, then in the doc."""
    a, b = Windows(item), Windows(doc)

    def common(size: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of unmarked windows of this size that the other side has too."""
        i, j = np.flatnonzero(item_run >= size), np.flatnonzero(doc_run >= size)
        x, y = a.at(i, size), b.at(j, size)
        return i[np.isin(x, y)], j[np.isin(y, x)]

    item_free, doc_free = np.ones(len(item), dtype=bool), np.ones(len(doc), dtype=bool)
    item_run, doc_run = free_runs(item_free), free_runs(doc_free)
    i, j = common(least) if min(len(item), len(doc)) >= least else ([], [])
    if not len(i):
        return []
    # words outside of all common runs can't be in a tile
    item_free, doc_free = covered(i, least, len(item)), covered(j, least, len(doc))
    tiles: list[tuple[int, int, int]] = []
    most = len(item)
    while most >= least:
        item_run, doc_run = free_runs(item_free), free_runs(doc_free)
        low, high = least - 1, int(min(item_run.max(), doc_run.max(), most))  # the longest common window is in low..high
        while low < high:
            size = (low + high + 1) // 2
            low, high = (size, high) if len(common(size)[0]) else (low, size - 1)
        if low < least:
            break
        i, j = common(low)
        where: dict[int, list[int]] = {}
        for hash_, place in zip(b.at(j, low).tolist()[::-1], j.tolist()[::-1]):
            where.setdefault(hash_, []).append(place)  # the first place last
        for start, hash_ in zip(i.tolist(), a.at(i, low).tolist()):
            if not item_free[start : start + low].all():
                continue
            places = where[hash_]
            while places and not doc_free[places[-1] : places[-1] + low].all():
                places.pop()
            if places and (item[start : start + low] == doc[places[-1] : places[-1] + low]).all():
                place = places.pop()
                tiles.append((start, place, low))
                item_free[start : start + low] = doc_free[place : place + low] = False
        most = low - 1
    return tiles


def lowered(texts: pa.Array) -> pa.Array:
    """The texts in lower case; the Shingler by itself lowers A to Z only. Large strings, as some letters grow."""
    return pc.utf8_lower(texts.cast(pa.large_string()))


def whole_runs(words: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Of texts one after the other, the text and the hash of every run of this size."""
    text = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(words)) - (np.cumsum(counts) - counts)[text]
    good = place <= counts[text] - size
    return text[good], Shingler(size, punctuation=False).rolled(words)[good]


def listed(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values.view(np.int64)))


def text_hashes(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2")]


def items_of(benchmark: DataFrame, least: int, short: bool) -> DataFrame:
    """(item_id, item_hash, words, runs): the items; runs of ``least`` words, or the one of all words of a short item."""

    def read(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(least, punctuation=False)
        for batch in batches(incoming, SLICE):
            words, counts = shingler.words_of(lowered(batch.column("text")))
            starts = np.cumsum(counts) - counts
            runs = []
            for size in range(1, least + 1):
                text, run = whole_runs(words, counts, size)
                own = (counts[text] == size) | (size == least)
                runs.append((text[own], run[own]))
            text, run = (np.concatenate(x) for x in zip(*runs))
            order = np.argsort(text, kind="stable")
            columns = [batch.column("item_id"), batch.column("item_hash"), listed(words, counts), listed(run[order], np.bincount(text, minlength=len(counts)))]
            found = pa.RecordBatch.from_arrays(columns, names=[*ITEM, "words", "runs"])
            yield found.filter(pa.array(counts >= (1 if short else least)))

    rows = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long"), F.xxhash64("text").alias("item_hash"), "text")
    return rows.dropDuplicates(ITEM).mapInArrow(read, "item_id long, item_hash long, words array<long>, runs array<long>")


def run_map(runs: DataFrame) -> bytes:
    """A bit for each hash that runs may have, as many as the map holds."""
    words = np.zeros(MAP_BITS // 64, dtype=np.int64)
    bit = F.pmod("run", F.lit(MAP_BITS))
    rows = runs.groupBy(F.floor(bit / 64).alias("k")).agg(F.bit_or(F.expr(f"shiftleft(1L, int(pmod(run, {MAP_BITS}) % 64))")).alias("w")).toLocalIterator()
    for k, word in rows:
        words[k] = word
    return words.tobytes()


def seeds_of(docs: DataFrame, bits: bytes, sizes: list[int]) -> DataFrame:
    """(doc_id, h1, h2, runs) of the rows some of whose runs of these sizes may be the benchmark's."""

    def seed(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there = np.frombuffer(bits, dtype=np.int64).view(U64)
        for batch in batches(incoming, SLICE):
            words, counts = Shingler(1, punctuation=False).words_of(lowered(batch.column("text")))
            texts, runs = [], []
            for size in sizes:
                text, run = whole_runs(words, counts, size)
                at = run & U64(MAP_BITS - 1)
                maybe = (there[(at >> U64(6)).astype(np.int64)] >> (at & U64(63))) & U64(1) > 0
                texts.append(text[maybe])
                runs.append(run[maybe])
            text, run = np.concatenate(texts), np.concatenate(runs)
            order = np.lexsort((run, text))
            text, run = text[order], run[order]
            new = np.ones(len(text), dtype=bool)
            new[1:] = (np.diff(text) != 0) | (np.diff(run) != 0)
            some, n = np.unique(text[new], return_counts=True)
            kept = batch.take(pa.array(some))
            yield pa.RecordBatch.from_arrays([kept.column("doc_id"), kept.column("h1"), kept.column("h2"), listed(run[new], n)], names=["doc_id", *TEXT, "runs"])

    narrow = docs.select(F.col("doc_id").cast("long"), *text_hashes(F.col("text")), "text").where("text is not null")
    return narrow.mapInArrow(seed, "doc_id long, h1 long, h2 long, runs array<long>")


def salted(df: DataFrame) -> DataFrame:
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def candidates(seeds: DataFrame, items: DataFrame, least: int, cover: float) -> DataFrame:
    """(h1, h2, item_id, item_hash) of the pairs whose common runs cover enough of the item. A run that very many texts have is met under several salts."""
    known = salted(items.select(*ITEM, F.size("words").alias("n"), F.posexplode("runs").alias("place", "run")))
    asked = seeds.groupBy(*TEXT).agg(F.first("runs").alias("runs")).select(*TEXT, F.explode("runs").alias("run"), F.pmod("h1", F.lit(SALTS)).cast("int").alias("salt"))
    places = asked.join(known, ["run", "salt"]).groupBy(*TEXT, *ITEM, "n").agg(F.array_sort(F.collect_set("place")).alias("p"))
    # windows of the run's size at these places cover the gaps between them, up to that size, and the last window
    size = F.least(F.col("n"), F.lit(least))
    gaps = F.zip_with(F.slice("p", 1, F.size("p") - 1), F.slice("p", 2, F.size("p") - 1), lambda x, y: F.least(y - x, size))
    most = F.when(F.size("p") > 1, F.aggregate(gaps, F.lit(0), lambda s, g: s + g)).otherwise(F.lit(0)) + size
    return places.where(most >= F.lit(cover) * F.col("n")).select(*TEXT, *ITEM)


def tiled(pairs: DataFrame, texts: DataFrame, items: DataFrame, least: int, cover: float) -> DataFrame:
    """The pairs that leak, with their tiles."""

    def search(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(least, punctuation=False)
        for batch in batches(incoming, SLICE):
            words, counts = shingler.words_of(lowered(batch.column("text")))
            ends = np.cumsum(counts)
            rows = []
            for k in range(batch.num_rows):
                item = np.asarray(batch.column("words")[k].values).view(U64)
                tiles = tile(item, words[ends[k] - counts[k] : ends[k]], min(least, len(item)))
                total = sum(t[2] for t in tiles)
                if tiles and total >= cover * len(item) and (total == len(item) or len(item) >= least):
                    spans = [dict(zip(("item_start", "doc_start", "words"), t)) for t in tiles]
                    key = {c: batch.column(c)[k].as_py() for c in ("h1", "h2", "item_id")}
                    rows.append({**key, "tiles": len(tiles), "tiled_words": total, "item_words": len(item), "coverage": total / len(item), "spans": spans})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=FOUND)

    own = items.select(*ITEM, "words")
    if (own.agg(F.sum(F.size("words"))).first()[0] or 0) <= BROADCAST_WORDS:
        joined = pairs.join(F.broadcast(own), ITEM)
    else:
        joined = pairs.withColumn("salt", F.pmod("h1", F.lit(SALTS)).cast("int")).join(salted(own), [*ITEM, "salt"])
    return joined.join(texts, TEXT).select(*TEXT, "item_id", "words", "text").mapInArrow(search, "h1 long, h2 long, " + LEAK)


def leaking(scratch: Scratch, docs: DataFrame, benchmark: DataFrame, least: int, cover: float, short: bool) -> tuple[DataFrame, DataFrame]:
    """(seeds, found): the rows that share runs with the benchmark, and the texts that leak an item."""
    items = scratch.write(items_of(benchmark, least, short), "items")
    sizes = sorted({least, *(r[0] for r in items.select(F.least(F.size("words"), F.lit(least))).distinct().collect())})
    bits = run_map(items.select(F.explode("runs").alias("run")))
    seeds = scratch.write(seeds_of(docs, bits, sizes), "seeds")
    pairs = scratch.write(candidates(seeds, items, least, cover), "pairs")
    keys = scratch.write(pairs.select(*TEXT).distinct(), "keys")
    if keys.count() <= BROADCAST_ROWS:
        keys = F.broadcast(keys)
    texts = docs.where("text is not null").select(*text_hashes(F.col("text")), "text").join(keys, TEXT, "left_semi").dropDuplicates(TEXT)
    return seeds.select("doc_id", *TEXT), scratch.write(tiled(pairs, texts, items, least, cover), "found")


def leaks(docs: DataFrame, benchmark: DataFrame, least: int = MIN_TILE, cover: float = LEAST_COVER) -> DataFrame:
    """One row for each row of docs and item that it leaks: doc_id, item_id, the tiles and the share of the item they cover."""
    seeds, found = leaking(Scratch(docs.sparkSession, "tiling"), docs, benchmark, least, cover, short=True)
    rows = seeds.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    return rows.join(salted(found), [*TEXT, "salt"]).select("doc_id", *[c for c in found.columns if c not in TEXT])


def without_leaks(docs: DataFrame, benchmark: DataFrame, least: int = MIN_TILE, cover: float = LEAST_COVER) -> DataFrame:
    """The rows of docs whose text leaks no item of ``least`` words or more: fewer words in a row are no sign of a benchmark. All columns stay, whatever their names."""
    _, found = leaking(Scratch(docs.sparkSession, "decontaminate"), docs, benchmark, least, cover, short=False)
    dirty = found.select(*TEXT).distinct()
    h1, h2 = text_hashes(docs["text"])
    return docs.join(dirty, (h1 == dirty["h1"]) & (h2 == dirty["h2"]), "left_anti")
