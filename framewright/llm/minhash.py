"""Near-duplicate documents: SuperMinHash signatures, banding, verification on full sets, union-find grouping.

A document's set holds the distinct shingles of its lower-cased words; with
fewer words than a shingle has, the whole sequence is its only member. Documents
whose sets are equal form a class at once; only one member of each class, its
smallest doc_id, goes on. Two classes are linked if their sets' similarity
reaches the threshold.

In each bucket of a band all members are compared with one pivot, the member
that shares most buckets. Those that this leaves in another component than
the pivot's are compared with ROUNDS further members of that component, drawn by a
hash. Members that are in different components even then are compared with each
other, if they met one pivot, unless what is known of both against it rules
similarity out; so no pair of a bucket is lost.
A bucket of near copies thus costs a number of comparisons in proportion to its
size, not to its square.

Defined results: a null text, and one without words, has an empty set and is
linked with nothing. A row without doc_id is linked with nothing either, its
component_id is null and it is kept. Rows are judged one by one: repeated rows
give repeated results. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from .common import Scratch
from .components import components
from .tokens import batches

#: 40 bands of 6: a pair at similarity 0.8 meets in a bucket but for 5 in a million cases.
BANDS, ROWS = 40, 6
#: Bytes of text hashed at once.
SLICE = 1 << 20
#: Bits of a map of ids, such as of the documents whose sets are needed: so many an id, and at least and at most so many.
BITS_AN_ID, MAP_BITS, MOST_BITS = 16, 1 << 20, 1 << 25
#: Pairs of one document that one task compares, about.
PAIRS_A_TASK = 1 << 13
#: Further pivots of a bucket that members are compared with before pairs are sought among those that are left.
ROUNDS = 2
#: Tasks that the members of a class meet it in.
SALTS = 16
#: Bytes of a row of some numbers in a file, at most.
ROW_BYTES = 32

U64 = np.uint64
MULTIPLIER = 0x9E3779B97F4A7C15
EMPTY = np.iinfo(np.uint64).max


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Shingler:
    """Distinct shingle hashes of many texts at once, from their bytes."""

    def __init__(self, words: int, punctuation: bool = True):
        """punctuation: whether ASCII marks belong to words; else they part words, as white space does."""
        self.words = words
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[ord("A") : ord("Z") + 1] += 32
        self.space = np.zeros(256, dtype=bool)
        self.space[[0x20, *range(0x09, 0x0E)]] = True
        if not punctuation:
            self.space[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
        self.code = mix(np.arange(1, 257, dtype=U64) * U64(MULTIPLIER))
        self.powers = np.ones(1, dtype=U64)
        self.inverse = np.ones(1, dtype=U64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n + 1:
            base = 0xD1342543DE82EF95
            for name, factor in (("powers", base), ("inverse", pow(base, -1, 1 << 64))):
                factors = np.full(n + 1, factor, dtype=U64)
                factors[0] = 1
                setattr(self, name, np.cumprod(factors, dtype=U64))

    def word_hashes(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words, and the number of words in each text; starts: where the texts begin, with the end."""
        n = len(data)
        self._grow(n)
        data = self.lower[data]
        inside = ~self.space[data]
        edge = np.zeros(n + 1, dtype=bool)  # a word can't go on over the start of a text
        edge[starts] = True
        begin = inside.copy()
        begin[1:] &= ~inside[:-1] | edge[1:n]
        end = inside.copy()
        end[:-1] &= ~inside[1:] | edge[1:n]
        a, b = np.flatnonzero(begin), np.flatnonzero(end) + 1
        sums = np.zeros(n + 1, dtype=U64)
        np.cumsum(self.code[data] * self.powers[:n], out=sums[1:])
        words = mix((sums[b] - sums[a]) * self.inverse[a] + (b - a).astype(U64) * U64(MULTIPLIER))
        return words, np.diff(np.searchsorted(a, starts))

    def words_of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words of all texts, and the number in each (null: none)."""
        texts = texts.fill_null("").cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
        return self.word_hashes(data, offsets - offsets[0])

    def rolled(self, words: np.ndarray) -> np.ndarray:
        """Rolling hash of the shingle that starts at each word; the last few are not whole."""
        out = words.copy()
        for step in range(1, min(self.words, len(words))):
            out[: len(words) - step] = out[: len(words) - step] * U64(0xC2B2AE3D27D4EB4F) + words[step:]
        return mix(out)

    def sets(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The distinct shingle hashes of the texts, sorted within each, and their numbers (null: empty)."""
        words, counts = self.words_of(texts)
        k = self.words
        rolled = self.rolled(words)
        found, sizes = [], np.zeros(len(counts), dtype=np.int64)
        ends = np.cumsum(counts)
        for doc, (n, end) in enumerate(zip(counts.tolist(), ends.tolist())):
            if n >= k:
                own = np.unique(rolled[end - n : end - k + 1])
            elif n:
                whole = 0
                for w in words[end - n : end].tolist():
                    whole = (whole * 0x165667B19E3779F9 + w + n) % (1 << 64)
                own = mix(np.array([whole], dtype=U64))
            else:
                continue
            found.append(own)
            sizes[doc] = len(own)
        return (np.concatenate(found) if found else np.zeros(0, U64)), sizes


def super_minhash(elements: np.ndarray, sizes: np.ndarray, slots: int) -> np.ndarray:
    """Signatures (documents x slots) of sets that lie one after the other.

    Every element visits the slots in its own random order and brings level + a
    fraction to the slot of each level, so a slot that some level has filled can't
    be lowered by a later one: a document stops at the level that fills its last
    slot. Level 0 is one pass over all elements; later ones see what is left.
    """
    docs = len(sizes)
    out = np.full((docs, slots), EMPTY, dtype=U64)
    flat = out.reshape(-1)
    owner = np.repeat(np.arange(docs), sizes)
    low, width = U64(0xFFFFFFFF), U64(32)

    def draw(x: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        h = mix(x + U64((level + 1) * MULTIPLIER % (1 << 64)))
        slot = ((h & low) * U64(slots - level) >> width).astype(np.int64) + level
        return slot, (h >> width) | U64(level << 32)

    slot, value = draw(elements, 0)
    np.minimum.at(flat, owner * slots + slot, value)
    open_docs = (out == EMPTY).any(1) & (sizes > 0)
    left = np.flatnonzero(open_docs[owner])
    order = np.tile(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.uint16), (len(left), 1))
    row = np.arange(len(left))
    order[row, slot[left]] = 0
    order[:, 0] = slot[left]
    level = 1
    while len(left) and level < slots:
        k, value = draw(elements[left], level)
        here, there = order[row, level], order[row, k]
        order[row, level], order[row, k] = there, here
        np.minimum.at(flat, owner[left] * slots + there.astype(np.int64), value)
        level += 1
        ids = np.flatnonzero(open_docs)
        open_docs[ids[~(out[ids] == EMPTY).any(1)]] = False
        keep = open_docs[owner[left]]
        left, row = left[keep], row[keep]
    return out


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.zeros((len(signatures), bands), dtype=U64)
    for r in range(rows):
        keys = mix(keys * U64(MULTIPLIER) + signatures[:, r : bands * rows : rows])
    return mix(keys + np.arange(bands, dtype=U64) * U64(MULTIPLIER))


def signatures(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, a 128-bit digest of the set and the keys of the bands (none for an empty set)."""

    def sign(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches(incoming, SLICE):
            elements, sizes = shingler.sets(batch.column("text"))
            ends = np.concatenate([[0], np.cumsum(sizes)])
            digest = []
            for seed in (0x6A09E667F3BCC908, 0xBB67AE8584CAA73B):
                sums = np.concatenate([np.zeros(1, U64), np.cumsum(mix(elements ^ U64(seed)))])
                digest.append((sums[ends[1:]] - sums[ends[:-1]]).view(np.int64))
            keys = band_keys(super_minhash(elements, sizes, bands * rows), bands, rows).view(np.int64)
            some = sizes > 0
            offsets = np.concatenate([[0], np.cumsum(np.where(some, bands, 0))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[some].ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes), pa.array(digest[0]), pa.array(digest[1]), lists], names=["doc_id", "n_shingles", "d1", "d2", "keys"]
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(sign, "doc_id long, n_shingles long, d1 long, d2 long, keys array<long>")


def map_bits(n: int) -> int:
    """Bits of a map of n ids: a power of two. A full map lets more ids through and loses none."""
    return min(max(MAP_BITS, 1 << (BITS_AN_ID * n).bit_length()), MOST_BITS)


def bit_map(ids: DataFrame, bits: int) -> DataFrame:
    """(k, w): the words that aren't 0 of a bit map of hashed ids; the ids that set none of its bits are surely not among them."""
    bit = F.pmod(F.xxhash64("id"), F.lit(bits))
    return ids.groupBy(F.floor(bit / 64).alias("k")).agg(F.bit_or(F.expr("shiftleft(1L, int(pmod(xxhash64(id), 64)))")).alias("w"))


def needed_map(ids: DataFrame, bits: int) -> bytes:
    """The bit map of these ids as a whole."""
    words = [0] * (bits // 64)
    for k, word in bit_map(ids, bits).collect():
        words[k] = word
    return np.array(words, dtype=np.int64).tobytes()


def among(table: DataFrame, column: str, ids: DataFrame, bits: int) -> DataFrame:
    """The rows whose column is one of these ids, and perhaps some others: so a join that follows moves few rows besides its own."""
    bit = F.pmod(F.xxhash64(column), F.lit(bits))
    marked = table.join(F.broadcast(bit_map(ids, bits)), F.floor(bit / 64) == F.col("k"))
    return marked.where(F.expr(f"shiftright(w, int(pmod(xxhash64({column}), 64))) & 1L = 1L")).drop("k", "w")


def shingle_sets(docs: DataFrame, ids: DataFrame, words: int, bits: int) -> DataFrame:
    """(id, set) of all documents with these ids, and perhaps of some others."""
    needed = needed_map(ids, bits)

    def collect(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, there = Shingler(words), np.frombuffer(needed, dtype=np.int64).view(np.uint64)
        for batch in incoming:
            at = np.asarray(batch.column("bit"), dtype=np.int64)
            wanted = (there[at >> 6] >> (at & 63).astype(U64)) & U64(1) > 0
            for part in batches([batch.filter(pa.array(wanted))], SLICE):
                elements, sizes = shingler.sets(part.column("text"))
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(elements.view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists], names=["id", "items"])

    keyed = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), "text").withColumn("bit", F.pmod(F.xxhash64("doc_id"), F.lit(bits)))
    return keyed.mapInArrow(collect, "id long, items array<long>")


def matched(pairs: DataFrame, sets: DataFrame, bits: int) -> DataFrame:
    """The pairs (a, b), with all their columns, and both full sets x and y.

    The set of an a with very many pairs is copied under several salts, so that
    they meet it in several tasks.
    """
    side = lambda c: among(sets, "id", pairs.select(F.col(c).alias("id")), bits)
    heavy = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > PAIRS_A_TASK).select("a", F.ceil(F.col("c") / PAIRS_A_TASK).cast("int").alias("salts"))
    salts = F.coalesce("salts", F.lit(1))
    salted = pairs.join(heavy, "a", "left").withColumn("salt", F.pmod(F.xxhash64("b"), salts).cast("int")).drop("salts")
    copies = side("a").select(F.col("id").alias("a"), F.col("items").alias("x")).join(heavy, "a", "left").select("a", "x", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    return salted.join(side("b").select(F.col("id").alias("b"), F.col("items").alias("y")), "b").join(copies, ["a", "salt"])


def compared(pairs: DataFrame, sets: DataFrame, bits: int) -> DataFrame:
    """The pairs (a, b) with the sizes of their full sets and of the intersection."""
    return matched(pairs, sets, bits).select("a", "b", F.size("x").alias("na"), F.size("y").alias("nb"), F.size(F.array_intersect("x", "y")).alias("shared"))


def similar(shared: Column, n: Column, m: Column, percent: int) -> Column:
    """100 * intersection >= percent * union"""
    return F.lit(100 + percent) * shared.cast("long") >= F.lit(percent) * (n + m).cast("long")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id, kept, and class_id, the smallest doc_id with an equal set.

    Equal sets have equal keys, so a class takes them from any of its members in a
    partial aggregate. Only classes of several members are looked up by their
    digest, each under several salts and without the keys.
    """
    scratch = Scratch(docs.sparkSession, "near-duplicates")
    signed = scratch.write(signatures(docs, words, bands, rows), "signed")
    some = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    digest = ["n_shingles", "d1", "d2"]
    classes = signed.where(some).groupBy(*digest).agg(F.min("doc_id").alias("first"), F.first("keys").alias("keys"), F.count(F.lit(1)).alias("c"))
    rows_signed = signed.count()
    classes = scratch.write(classes, "classes", rows_signed * (ROW_BYTES + 8 * bands))

    shown = classes.select(F.col("first").alias("id"), F.explode("keys").alias("key"))
    size = classes.count() * bands * ROW_BYTES // 4  # most keys are not shared
    shared = scratch.write(shown.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "shared", size)
    shown = among(shown, "key", shared.select(F.col("key").alias("id")), map_bits(shared.count()))
    members = scratch.write(shown.join(shared, "key").distinct(), "members", size)
    links = all_links(scratch, docs, members, words, percent)
    groups = scratch.write(components(scratch, links.select(F.col("a").alias("child"), F.col("b").alias("parent")), "groups", size := links.count() * ROW_BYTES), "groups", size)

    again = classes.where("c > 1").select(*digest, "first").join(groups.select(F.col("node").alias("first"), F.col("component").alias("of_class")), "first", "left")
    again = again.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    classed = signed.where(some).select("doc_id", *digest, F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt")).join(again, [*digest, "salt"], "left")
    classed = scratch.write(classed.select("doc_id", "n_shingles", "first", "of_class"), "classed", rows_signed * ROW_BYTES)
    alone = signed.where(~some).select("doc_id", "n_shingles", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("component_id"))
    single = classed.where("first is null").join(groups.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left")
    single = single.select("doc_id", "n_shingles", F.col("doc_id").alias("class_id"), F.coalesce("component", "doc_id").alias("component_id"))
    several = classed.where("first is not null").select("doc_id", "n_shingles", F.col("first").alias("class_id"), F.coalesce("of_class", "first").alias("component_id"))
    result = single.unionAll(several).unionAll(alone)
    return result.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), "class_id")


def deduplicated(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that stay, with all their columns whatever their names: of each group of near duplicates the one with the smallest doc_id.

    Rows that repeat a doc_id and its text stay once; rows of a doc_id that stays
    all do if their texts differ; rows without doc_id stay.
    """
    kept = near_duplicates(docs, words, percent).where("kept and doc_id is not null").select(F.col("doc_id").alias("id")).distinct()
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    whole = whole.select("doc", F.col("doc.doc_id").cast("long").alias("id"), F.xxhash64("doc.text").alias("h"))
    once = whole.where("id is not null").join(kept, "id", "left_semi").dropDuplicates(["id", "h"]).select("doc")
    stay = once.unionAll(whole.where("id is null").select("doc"))
    return stay.select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])


def all_links(scratch: Scratch, docs: DataFrame, members: DataFrame, words: int, percent: int) -> DataFrame:
    """Verified links that connect whatever the buckets' similar pairs connect; members: (key, id, c).

    Members of a bucket all meet its pivot. So after the first comparisons rows of
    (pivot, member) stand for the buckets: one row however many buckets both share.
    """
    size = members.count() * ROW_BYTES
    weights = scratch.write(members.groupBy("id").agg(F.sum("c").alias("weight")), "weights", size)
    pivots = members.join(weights, "id").groupBy("key").agg(F.max_by("id", F.struct("weight", -F.col("id"))).alias("a"))
    first = members.join(pivots, "key").where("id <> a").groupBy("a", F.col("id").alias("b")).agg(F.max("c").alias("c"))
    first = scratch.write(first, "first_pairs", size)
    size = first.count() * ROW_BYTES
    bits = map_bits(weights.count())
    sets = scratch.write(shingle_sets(docs, weights.select("id"), words, bits), "sets")
    scored = scratch.write(compared(first.select("a", "b"), sets, bits), "scored", size)
    linked = lambda pairs: pairs.where(similar(F.col("shared"), F.col("na"), F.col("nb"), percent)).select("a", "b")
    links = linked(scored)

    def apart(rows: DataFrame, label: str) -> DataFrame:
        """The members of pivots not all of whose members are known to be of the pivot's component."""
        several = rows.groupBy("anchor").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.max(F.when(F.col("id") == F.col("anchor"), F.col("component"))).alias("home")).where("lo < hi")
        return scratch.write(rows.drop("home").join(several.select("anchor", "home"), "anchor"), label, size)

    # pairs of buckets of two have been compared; the pivot has all of its shingles in common with itself
    met = first.where("c > 2").join(scored, ["a", "b"]).select(F.col("a").alias("anchor"), F.col("b").alias("id"), F.col("nb").alias("n"), F.col("shared").alias("common"), F.col("na").alias("own"))
    alone = met.select("anchor", F.col("anchor").alias("id"), F.col("own").alias("n"), F.col("own").alias("common")).distinct()
    joined = components(scratch, links.select(F.col("a").alias("child"), F.col("b").alias("parent")), "joined", size)
    placed = met.drop("own").unionByName(alone).join(joined.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    open_ = apart(scratch.write(placed, "placed", size), "open")
    mirrored = lambda pairs: pairs.select("a", "b").unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    tested = scored.select("a", "b")
    for k in range(ROUNDS):
        other = open_.where("component = home").groupBy("anchor").agg(F.max_by("id", F.xxhash64("id", F.lit(k))).alias("a"))
        asked = open_.where("component <> home").join(other, "anchor").select("a", F.col("id").alias("b"), F.col("home").alias("to")).distinct()
        asked = scratch.write(asked.join(mirrored(tested), ["a", "b"], "left_anti"), f"asked_{k}", size)
        found = scratch.write(linked(compared(asked.select("a", "b").distinct(), sets, bits)), f"found_{k}", size)
        links, tested = links.unionAll(found), tested.unionAll(asked.select("a", "b"))
        # who is linked with such a pivot is of its component from now on
        moved = asked.join(found, ["a", "b"]).groupBy(F.col("b").alias("id")).agg(F.min("to").alias("to"))
        open_ = apart(open_.join(moved, "id", "left").withColumn("component", F.coalesce("to", "component")).drop("to"), f"open_{k}")
    last = crossing(open_, percent).unionAll(sharing(beyond(scratch, open_, sets, bits), percent)).distinct()
    last = scratch.write(last.join(mirrored(tested), ["a", "b"], "left_anti"), "last_pairs")
    links = links.unionAll(scratch.write(linked(compared(last, sets, bits)), "last_links", last.count() * ROW_BYTES))
    scratch.drop("sets")
    return links


def crossing(rest: DataFrame, percent: int) -> DataFrame:
    """Pairs that met one pivot, in different components, that may be similar though they share nothing that the pivot lacks.

    rest: (anchor, id, n, component, common, home), home being the pivot's component. Two
    sets that share no shingle outside of the pivot share at most what each has in
    common with it, which rules out most pairs of a group of near copies. One side of
    a pair is always a member outside of the pivot's component, of which few are left.
    """
    other = rest.select("anchor", *[F.col(c).alias(f"{c}2") for c in ("id", "n", "component", "common")])
    fits = F.lit(100) * F.least("n", "n2") >= F.lit(percent) * F.greatest("n", "n2")
    may = similar(F.least("common", "common2"), F.col("n"), F.col("n2"), percent)
    pairs = rest.where("component <> home").join(other, "anchor").where((F.col("component") != F.col("component2")) & fits & may)
    return pairs.select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b")).distinct()


def beyond(scratch: Scratch, rest: DataFrame, sets: DataFrame, bits: int) -> DataFrame:
    """The members of rest but the pivots, with the shingles (items) that each has and its pivot lacks; rest as for ``crossing``."""
    one = rest.where("id <> anchor")
    items = one.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("n") - F.col("common")), F.lit(0))).first()
    both = matched(one.withColumnsRenamed({"anchor": "a", "id": "b"}), sets, bits)
    lacking = both.select(F.col("a").alias("anchor"), F.col("b").alias("id"), "n", "component", "common", "home", F.array_except("y", "x").alias("items"))
    return scratch.write(lacking, "beyond", 2 * ROW_BYTES * items[0] + 8 * items[1])


def sharing(extras: DataFrame, percent: int) -> DataFrame:
    """Pairs that met one pivot, in different components, that share shingles outside of it, enough to be similar perhaps; extras as ``beyond`` gives them.

    A set of n shingles, c of them the pivot's, has to share percent * n / 100 - c of
    the others at least. So of these, the rarest first, all but so many less one are
    looked at: similar sets meet in one. What most members have and the pivot lacks
    comes last, and a member with many shingles of its own doesn't get to it.
    """
    extra = extras.withColumn("item", F.explode("items")).drop("items")
    seen = extra.groupBy("anchor", "item").agg(F.count(F.lit(1)).alias("often"), F.min("component").alias("lo"), F.max("component").alias("hi"))
    ranked = extra.join(seen, ["anchor", "item"]).withColumn("rank", F.row_number().over(Window.partitionBy("anchor", "id").orderBy("often", "item")))
    needed = F.greatest(F.ceil(F.lit(percent) * F.col("n") / 100) - F.col("common"), F.lit(1))
    first = ranked.where((F.col("rank") <= F.col("n") - F.col("common") - needed + 1) & (F.col("lo") < F.col("hi"))).select("anchor", "item", "id", "n", "component", "common", "home")
    other = first.select("anchor", "item", *[F.col(c).alias(f"{c}2") for c in ("id", "n", "component", "common")])
    fits = F.lit(100) * F.least("n", "n2") >= F.lit(percent) * F.greatest("n", "n2")
    most = F.least("common", "common2") + F.least(F.col("n") - F.col("common"), F.col("n2") - F.col("common2"))
    pairs = first.where("component <> home").join(other, ["anchor", "item"]).where((F.col("component") != F.col("component2")) & fits & similar(most, F.col("n"), F.col("n2"), percent))
    return pairs.select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b")).distinct()
