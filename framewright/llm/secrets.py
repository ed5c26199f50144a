"""Secrets in texts, and what the whole corpus says about them, with DataFrame functions only.

Base spans are the matches of three fixed patterns. Beside them, long tokens that
mix letters of both cases with digits are candidates. Every candidate's value is
hashed, and for each hash the distinct owners and the distinct repositories that
have it are counted over the corpus: a value that many owners have is a copied
example, one that a single owner has in few repositories looks live. Such long
tokens become spans of the kind ``owned``; base spans stay, whatever their class.
Redaction takes every long token that a single owner has, in however many
repositories.

With the columns of ``documents`` an owner is a source, and a repository one
language of a source.

Defined results: a null text is an empty one; a null owner or repository counts
as one of its own; rows are judged one by one, so repeated rows give repeated
results; other columns are ignored; an empty table gives no rows. Positions
count code points, ends are exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from .common import Scratch

# The base patterns, with the letters of the first in either case.
ASSIGN = (
    "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    "[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
# A run of these that is long enough is a whole run: what fails by its length can't hide another match.
ACCESS = "AKIA[A-Z0-9]{12,}"
HEX = "[0-9a-f]{32,}"
OWNED = "[A-Za-z0-9+/_=-]{24,}"
LEAST_ASSIGNED = 8
KINDS = ("assign", "access", "hex", "owned")
#: A value of one owner in this many repositories at most looks live; one of at least so many owners is a copied example.
MOST_REPOSITORIES, COPIED_OWNERS = 2, 3
SALTS = 16

def matches(text: Column, pattern: str, kind: int, group: int = 0) -> Column:
    """The pattern's matches in order: their lengths, those of the texts before them, and the group's text as a hash and a length.

    Lengths add up to places later, over rows and not within the array, so that a
    text costs in proportion to its matches.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("p"), whole.alias("m"), value.alias("v"))

    def match(x: Column, i: Column) -> Column:
        good = F.length(x["v"]) >= LEAST_ASSIGNED if kind == 0 else mixed(x["v"]) if kind == 3 else F.lit(True)
        return F.struct(F.lit(kind).alias("kind"), i.alias("i"), F.length(x["p"]).alias("before"), F.length(x["m"]).alias("size"), F.xxhash64(x["v"]).alias("hash"), good.alias("good"))

    found = F.transform(F.filter(zipped, lambda x: x["m"].isNotNull()), match)
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(MATCHES))


MATCHES = "array<struct<kind:int,i:int,before:int,size:int,hash:bigint,good:boolean>>"


def mixed(value: Column) -> Column:
    return value.rlike("[0-9]") & value.rlike("[a-z]") & value.rlike("[A-Z]")


def scanned(docs: DataFrame, keys: list[Column | str], owner: list[str], repository: list[str]) -> DataFrame:
    """Each row's keys under a row number, its matches, owner and repository (as hashes)."""
    text = F.coalesce("text", F.lit(""))
    every = F.concat(matches(text, ASSIGN, 0, 2), matches(text, ACCESS, 1), matches(text, HEX, 2), matches(text, OWNED, 3))
    return docs.select(
        *keys, F.monotonically_increasing_id().alias("row"), every.alias("matches"), F.xxhash64(F.lit(1), *owner).alias("owner"), F.xxhash64(F.lit(2), *repository).alias("repository")
    )


def placed(found: DataFrame) -> DataFrame:
    """(row, owner, repository, kind, start, end, hash): the spans that count; long tokens only if no base span touches them.

    Running sums, the last end before and the next start after a span come from
    windows that grow by one row at a time, also within a single long text.
    """
    each = found.where(F.size("matches") > 0).select("row", "owner", "repository", F.inline("matches")).repartition("row")
    so_far = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    ends = each.withColumn("end", F.sum(F.col("before") + F.col("size")).over(so_far).cast("int")).withColumn("start", F.col("end") - F.col("size")).where("good")
    base = F.col("kind") < 3
    earlier = Window.partitionBy("row").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, 0)
    later = Window.partitionBy("row").orderBy(F.desc("start"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, 0)
    seen = ends.withColumn("reach", F.max(F.when(base, F.col("end"))).over(earlier)).withColumn("next", F.min(F.when(base, F.col("start"))).over(later))
    clear = (F.coalesce("reach", F.lit(0)) <= F.col("start")) & (F.coalesce("next", F.col("end")) >= F.col("end"))
    return seen.where(base | clear).select("row", "owner", "repository", "kind", "start", "end", "hash")


def ownership(spans: DataFrame) -> DataFrame:
    """Distinct owners and repositories of each hash; duplicates go before the shuffles, so a value that all have is no burden."""
    each = spans.select("hash", "owner", "repository").distinct().groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("r"))
    return each.groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("r").alias("repositories"))


def classified(scratch: Scratch, docs: DataFrame, keys: list[Column | str], owner: list[str], repository: list[str], spread: bool = False) -> tuple[DataFrame, DataFrame]:
    """(found, spans): each row's keys under a row number; the spans (row, start, kind, end, label) that count, with their class.

    With spread also the long tokens that a single owner has in more repositories than look live.
    """
    found = scratch.write(scanned(docs, keys, owner, repository), "found")
    every = scratch.write(placed(found), "placed")
    # a value that very many rows share meets its counts in several tasks
    counts = scratch.write(ownership(every), "ownership").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    known = every.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")).join(counts, ["hash", "salt"])
    live = (F.col("owners") == 1) & (F.col("repositories") <= MOST_REPOSITORIES)
    label = F.when(live, "live").when(F.col("owners") >= COPIED_OWNERS, "copied").otherwise("shared")
    kept = known.withColumn("label", label).where((F.col("kind") < 3) | (F.col("owners") == 1 if spread else live))
    return found, kept.select("row", "start", "kind", "end", "label")


def written(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame, owner: list[str] | None = None, repository: list[str] | None = None) -> DataFrame:
    """Per row of docs: doc_id, counts, base_sha256, spans, and how many spans look live or copied."""
    owner, repository = owner or ["source"], repository or ["source", "lang"]
    scratch = Scratch(docs.sparkSession, "secrets")
    found, spans = classified(scratch, docs, ["doc_id"], owner, repository)
    listed = F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("spans")
    counts = [F.count(F.when(condition, 1)).alias(name) for name, condition in (
        ("n_assign", F.col("kind") == 0), ("n_access", F.col("kind") == 1), ("n_hex", F.col("kind") == 2),
        ("n_live", F.col("label") == "live"), ("n_copied", (F.col("label") == "copied") & (F.col("kind") < 3)),
    )]
    whole = found.select("row", "doc_id").join(spans.groupBy("row").agg(listed, *counts), "row", "left")
    every = F.coalesce("spans", F.array().cast("array<struct<start:int,kind:int,end:int>>"))
    number = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    base = F.sha2(written(F.filter(every, lambda s: s["kind"] < 3)).cast("binary"), 256).alias("base_sha256")
    return whole.select("doc_id", number("n_assign"), number("n_access"), number("n_hex"), base, written(every).alias("spans"), number("n_live"), number("n_copied"))


def redact(docs: DataFrame, owner: list[str] | None = None, repository: list[str] | None = None, n_chars: str | None = "n_chars") -> DataFrame:
    """docs with every span replaced by a mark: of a copied example, or of a secret. All rows and columns stay, whatever their names; n_chars follows the text.

    A span that begins within an earlier one goes with it. Texts are cut in four-byte
    code points, so that a cut costs no more than what it takes.
    """
    owner, repository = owner or ["source"], repository or ["source", "lang"]
    scratch = Scratch(docs.sparkSession, "redaction")
    key = lambda doc_id, text: [F.coalesce(doc_id.cast("string"), F.lit("")).alias("id"), doc_id.isNull().alias("no_id"), F.xxhash64(text).alias("h")]
    found, spans = classified(scratch, docs, key(F.col("doc_id"), F.col("text")), owner, repository, spread=True)
    before = Window.partitionBy("row").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, -1)
    cut = spans.withColumn("from", F.coalesce(F.max("end").over(before), F.lit(0)))
    mark = F.when(F.col("label") == "copied", "[EXAMPLE-CREDENTIAL]").otherwise("[SECRET]").alias("mark")
    kept = F.collect_list(F.when(F.col("start") >= F.col("from"), F.struct("start", "from", mark)))
    cuts = cut.groupBy("row").agg(F.sort_array(kept).alias("cuts"), F.max("end").alias("tail"))
    marks = found.select("row", "id", "no_id", "h").join(cuts, "row").groupBy("id", "no_id", "h").agg(F.first(F.struct("cuts", "tail")).alias("mark"))
    marks = scratch.write(marks, "marks")

    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    whole = whole.select("doc", *key(F.col("doc.doc_id"), F.col("doc.text"))).join(marks, ["id", "no_id", "h"], "left")
    wide = "UTF-32"
    said = lambda points, start, end: F.decode(F.substring(points, F.lit(4) * start + 1, F.lit(4) * (end - start)), wide)
    text, tail = F.col("doc.text"), F.col("mark.tail")
    pieces = lambda points: F.concat(F.transform("mark.cuts", lambda c: F.concat(said(points, c["from"], c["start"]), c["mark"])), F.array(said(points, tail, F.length(text))))
    joined = F.get(F.transform(F.array(F.encode(text, wide)), lambda points: F.array_join(pieces(points), "")), F.lit(0))
    clean = whole.select("doc", F.when(F.col("mark").isNotNull(), joined).alias("clean"))
    changed = {"text": F.coalesce("clean", "doc.text")}
    if n_chars in docs.columns:
        changed[n_chars] = F.when(F.col("clean").isNull(), F.col(f"doc.{n_chars}")).otherwise(F.length("clean")).cast(docs.schema[n_chars].dataType)
    return clean.select(*[changed.get(c, F.col("doc").getField(c)).alias(c) for c in docs.columns])
