"""I-Match fingerprints of documents, with DataFrame functions only.

Terms are the distinct lower-cased words, known by their hashes. The lexicon holds
the terms whose inverse document frequency lies in a band: in at most one of FEW
documents and at least one of MANY (two documents at least), counted over all
documents. SUBSETS random subsets of the lexicon are drawn, the same for every
document whatever its size. They overlap: the first is the whole lexicon, each
other one has its own random pattern of 3 to 9 bits and holds the terms whose hash
has none of them set, so 1/8 down to 1/512 of the lexicon: some of them survive an
edit of a text of any length. For each subset a document's terms in it are sorted
and hashed; the hashes are the fingerprint's entries. A document without a term in
a subset has no entry for it; one without any term of the lexicon has a single
entry instead, the hash of all its sorted terms.

At least one document in MANY has each term of the lexicon, so it has at most
MANY times the mean number of distinct terms of a document, however many
documents there are; its size is counted before it is broadcast.

The likeness of two fingerprints is the number of equal entries over the number
of subsets that either has an entry for.

Defined results: a null text is an empty one; repeated rows (equal doc_id and
text) give repeated results and count as one for the order and the frequencies;
documents of equal doc_id are ordered by a hash of their text, null ids first;
a single document is its own next one; other columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from .common import Scratch, row_tasks

#: Bits of a term's hash, and the patterns of the subsets after the first: EACH of every number of bits.
HASH_BITS = 60
BITS, EACH = (3, 4, 5, 6, 7, 8, 9), 9
_DRAW = random.Random(0)
PATTERNS = [sum(1 << k for k in _DRAW.sample(range(HASH_BITS), n)) for n in BITS for _ in range(EACH)]
SUBSETS = 1 + len(PATTERNS)
FEW, MANY = 10, 2000
#: A larger lexicon isn't broadcast.
BROADCAST_TERMS = 1_000_000
#: present (whether there is a doc_id), doc_id or 0, hash of the text
KEY = ["p", "k", "h"]
NONE = -1  # instead of an entry
NO_TERMS = 42  # Spark's hash of an empty array, its seed


def terms(text: Column) -> Column:
    """Hashes of the distinct terms."""
    words = F.array_remove(F.split(F.lower(text), "[\\s\\p{Punct}]+"), F.lit(""))
    return F.array_distinct(F.transform(words, lambda w: F.shiftrightunsigned(F.xxhash64(w), 64 - HASH_BITS)))


def keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").isNotNull().alias("p"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("k"), F.xxhash64(text).alias("h"), text.alias("text"))


def next_documents(scratch: Scratch, rows: DataFrame) -> DataFrame:
    """(p, k, h, n, copies, next): each document with the key of the next in order; after the last comes the first.

    Documents are range-partitioned, ordered within each partition, and the last of
    a partition is followed by the first of the next one that has any.
    """
    spark = rows.sparkSession
    single = rows.select(*KEY, F.length("text").alias("n")).groupBy(*KEY).agg(F.first("n").alias("n"), F.count(F.lit(1)).alias("copies"))
    order = scratch.write(single.repartitionByRange(row_tasks(spark), *KEY).withColumn("part", F.spark_partition_id()), "order")
    firsts = order.groupBy("part").agg(F.min(F.struct(*KEY)).alias("first"))  # one row a partition
    ahead, all_parts = Window.orderBy("part"), Window.partitionBy()
    following = firsts.select("part", F.coalesce(F.lead("first").over(ahead), F.min_by("first", "part").over(all_parts)).alias("other"))
    within = Window.partitionBy("part").orderBy(*KEY)
    stepped = order.withColumn("step", F.lead(F.struct(*KEY)).over(within)).join(F.broadcast(following), "part")
    return scratch.write(stepped.select(*KEY, "n", "copies", F.coalesce("step", "other").alias("next")), "links")


def lexicon(scratch: Scratch, texts: DataFrame, documents: int) -> DataFrame:
    """(mark): the hashes of the terms within the band."""
    counts = texts.select(F.explode(terms(F.col("text"))).alias("mark")).groupBy("mark").agg(F.count(F.lit(1)).alias("df"))
    band = counts.where((F.col("df") >= max(2, documents / MANY)) & (F.col("df") <= max(2, documents / FEW)))
    return scratch.write(band.select("mark"), "lexicon")


def entries(found: Column, rest: Column) -> Column:
    """A document's entries, NONE where it has no term of a subset. found: its sorted terms of the lexicon; rest: the hash of all its sorted terms."""
    short = lambda h: F.shiftrightunsigned(h, 33).cast("int")
    some = F.size(found) > 0
    chosen = F.transform(F.array(*map(F.lit, PATTERNS)), lambda p: F.xxhash64(F.filter(found, lambda t: t.bitwiseAND(p) == 0)))
    return F.concat(
        F.array(F.when(some, short(F.xxhash64(found))).otherwise(F.lit(NONE)), F.when(some, F.lit(NONE)).otherwise(short(rest))),
        F.transform(chosen, lambda h: F.when(h == F.lit(NO_TERMS), F.lit(NONE)).otherwise(short(h))),
    )


def likeness(a: Column, b: Column) -> Column:
    both = F.arrays_zip(a.alias("x"), b.alias("y"))
    either = F.size(F.filter(both, lambda e: F.greatest(e["x"], e["y"]) != NONE))
    return F.size(F.filter(both, lambda e: (e["x"] == e["y"]) & (e["x"] != NONE))) / either


def shown(fingerprint: Column) -> Column:
    return F.array_join(F.transform(fingerprint, lambda e: F.when(e == NONE, "-").otherwise(F.lpad(F.lower(F.hex(e)), 8, "0"))), "")


#: Which texts a term is in.
OWN, EDITED, BOTH = 0, 1, 2


def edited_texts(texts: DataFrame, links: DataFrame) -> DataFrame:
    """(p, k, h, text, edited): the last quarter replaced by the start of the next document. All joins are on the text's own key, so texts are shuffled once."""
    quarter = F.expr("n div 4")
    asked = links.select(F.col("next.p").alias("p"), F.col("next.k").alias("k"), F.col("next.h").alias("h"), F.struct(*KEY).alias("before"), "n")
    starts = texts.join(asked, KEY).select(*[F.col(f"before.{c}").alias(c) for c in KEY], "n", F.substring(F.col("text"), F.lit(1), quarter).alias("start"))
    whole = texts.join(starts, KEY)
    return whole.select(*KEY, "text", F.concat(F.substring(F.col("text"), F.lit(1), F.col("n") - quarter), "start").alias("edited"))


def prints(both: DataFrame, words: DataFrame) -> DataFrame:
    """(p, k, h, sha, own, edited): the entries of both texts, and the edited one's digest.

    A document becomes one row for each term of its two texts, with two bits for
    which of them it is in. Those of the lexicon are gathered again; the rows stay
    in the document's partition while the lexicon is broadcast.
    """
    a, b, mark = F.col("a"), F.col("b"), F.shiftright("code", 2)
    coded = lambda terms, which: F.transform(terms, lambda m: F.shiftleft(m, 2).bitwiseOR(F.lit(which).cast("long")))
    rest = lambda terms: F.xxhash64(F.array_sort(terms))
    hashed = both.select(*KEY, terms(F.col("text")).alias("a"), terms(F.col("edited")).alias("b"), F.sha2(F.col("edited").cast("binary"), 256).alias("sha"))
    codes = F.concat(coded(F.array_except(a, b), OWN), coded(F.array_except(b, a), EDITED), coded(F.array_intersect(a, b), BOTH))
    each = hashed.select(*KEY, "sha", rest(a).alias("ra"), rest(b).alias("rb"), F.posexplode_outer(codes).alias("pos", "code"))
    lead = F.coalesce(F.col("pos") == 0, F.lit(True))  # the row that carries what a document has once
    each = each.select(*KEY, "code", lead.alias("lead"), *[F.when(lead, F.col(c)).alias(c) for c in ("sha", "ra", "rb")])
    known = each.join(words, mark == F.col("mark"), "left").where(F.col("lead") | F.col("mark").isNotNull())
    gathered = F.sort_array(F.collect_list(F.when(F.col("mark").isNotNull(), F.col("code")))).alias("codes")
    found = known.groupBy(*KEY).agg(gathered, *[F.max(c).alias(c) for c in ("sha", "ra", "rb")])
    of = lambda other: F.transform(F.filter("codes", lambda c: c.bitwiseAND(F.lit(3).cast("long")) != other), lambda c: F.shiftright(c, 2))
    sides = found.select(*KEY, "sha", "ra", "rb", of(EDITED).alias("a"), of(OWN).alias("b"))
    return sides.select(*KEY, "sha", entries(a, F.col("ra")).alias("own"), entries(b, F.col("rb")).alias("edited"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row."""
    scratch = Scratch(docs.sparkSession, "fingerprints")
    rows = keyed(docs)
    links = next_documents(scratch, rows)
    scratch.drop("order")
    documents, repeated = links.agg(F.count(F.lit(1)), F.coalesce(F.max("copies"), F.lit(0))).first()
    texts = rows if repeated <= 1 else rows.dropDuplicates(KEY)
    words = lexicon(scratch, texts, documents)
    if words.count() <= BROADCAST_TERMS:
        words = F.broadcast(words)
    made = scratch.write(prints(edited_texts(texts, links), words), "prints")
    after = made.select(F.struct(*KEY).alias("next"), F.col("own").alias("next_own"))
    whole = made.join(links, KEY).join(after, "next")
    if repeated > 1:
        whole = whole.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return whole.select(
        F.when(F.col("p"), F.col("k")).alias("doc_id"),
        F.col("n").cast("long").alias("n_chars"),
        F.col("sha").alias("edited_sha256"),
        shown(F.col("own")).alias("fingerprint"),
        shown(F.col("edited")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("edited")).alias("near_edited"),
        likeness(F.col("own"), F.col("next_own")).alias("near_next"),
    )
