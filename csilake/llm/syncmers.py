"""Document fingerprints from closed syncmers, in DataFrame functions only.

A text's symbols are its words (white space apart); of a word of over LONG code points, as in scripts without blanks or in code, each code point is a
symbol. A K-mer of symbols is chosen if the smallest hash among its inner S-mers stands first or last in it. That depends on the K-mer
alone, so an edit moves only those anchors that touch it, and the same passage has the same anchors in any text. (A word that an edit makes
longer than LONG, or no longer so, changes as a whole.)
A text of fewer than K symbols, but not none, has one anchor: all of it.

``anchors`` lists all of them in order, each with the number of its first symbol (from 0) and its hash. The fingerprint is all distinct
hashes of a text, sorted, as hex numbers with commas; the likeness of two texts is the Jaccard index of these sets. Two empty
sets are alike (1.0), an empty one and another are not (0.0).

The edited text joins a row to the next one in descending doc_id. Rows are cut into ranges of (doc_id, hash of the text), ordered
inside each, and the first row of each range is handed to the range above: one shuffle of the texts, no global window. Equal ids are
ordered by that hash, null ids come last, a null text is empty, and a table of one row is followed by itself.
The cuts are quantiles of the keys themselves, so outlying, bunched, null or repeated ids make no larger range; only rows alike in id and
text lie in one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from csilake.llm.common import table, texts

K, S = 4, 2
LONG = 16
_IN = r"[^\x20\x09-\x0D]"
SYMBOL = rf"(?<!{_IN}){_IN}{{1,{LONG}}}(?!{_IN})|{_IN}"
#: Rows of a range, how many ranges there are at most, and sampled keys of a range.
ROWS_PER_RANGE, MOST_RANGES, PER_RANGE = 2_000, 10_000, 20


def anchors(docs: DataFrame, text: str, out: str) -> DataFrame:
    """Adds the anchors of a text column in order (array<struct<position:int,hash:bigint>>).

    Each array is made by one select and used twice or more by the next, so Catalyst keeps it instead of
    computing it anew inside the lambda.
    """
    inner = K - S + 1
    at = lambda c, i, n: F.get(F.col(c), i + F.lit(n))
    symbols = F.regexp_extract_all(F.col(text), F.lit(SYMBOL), F.lit(0))
    hashed = docs.withColumn("_h", F.transform(symbols, lambda x: F.xxhash64(x)))
    parts = F.transform(F.slice("_h", F.lit(1), F.size("_h") - (S - 1)), lambda _, i: F.xxhash64(*(at("_h", i, j) for j in range(S))))
    minor = hashed.withColumn("_s", F.when(F.size("_h") >= K, parts))

    def anchor(i: Column, hashed: Column) -> Column:
        return F.struct(i.cast("int").alias("position"), hashed.alias("hash"))

    def chosen(x: Column, i: Column) -> Column:
        edges = F.least(x, at("_s", i, inner - 1))
        middle = F.array_min(F.array(*(at("_s", i, j) for j in range(1, inner - 1))))
        return F.when(edges <= middle, anchor(i, F.xxhash64(*(at("_s", i, j) for j in range(inner)))))

    many = F.filter(F.transform(F.slice("_s", F.lit(1), F.size("_s") - (inner - 1)), chosen), F.isnotnull)
    few = F.filter(F.array(F.when(F.size("_h") > 0, anchor(F.lit(0), F.xxhash64("_h")))), F.isnotnull)
    return minor.withColumn(out, F.when(F.size("_h") >= K, many).otherwise(few)).drop("_h", "_s")


def distinct(a: str) -> Column:
    return F.array_distinct(F.col(a)["hash"])


def likeness(a: str, b: str) -> Column:
    """Of two arrays without repeats."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def as_text(a: str) -> Column:
    return F.array_join(F.transform(F.array_sort(a), lambda x: F.lower(F.hex(x))), ",")


def _order(doc: str, text: str) -> Column:
    """A text that sorts as (doc_id, hash of the text) does, a null id first."""
    hexed = lambda x: F.lpad(F.hex(x.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    return F.concat(F.coalesce(F.concat(F.lit("1"), hexed(F.col(doc))), F.lit("0")), hexed(F.xxhash64(text)))


def _cuts(keyed: DataFrame) -> list[str]:
    """Keys that cut the rows into ranges of about ROWS_PER_RANGE distinct keys; every PER_RANGE-th of a sample by hash, whose size MOST_RANGES bounds."""
    n = keyed.count()
    ranges = min(MOST_RANGES, n // ROWS_PER_RANGE)
    if ranges < 2:
        return []
    bar = int(min(1.0, PER_RANGE * ranges / n) * ((1 << 64) - 1)) - (1 << 63)
    sample = keyed.select("_key").filter(F.xxhash64("_key") <= F.lit(min(bar, (1 << 63) - 1))).distinct()
    return sorted(x["_key"] for x in sample.toLocalIterator())[PER_RANGE - 1 :: PER_RANGE]


def _cell(key: str, cuts: list[str]) -> Column:
    """How many cuts lie at or below the key, by halving steps; the cuts stand in the plan as one text, folded to an array before the run."""
    if not cuts:
        return F.lit(0)
    bounds = F.split(F.lit(",".join(cuts)), ",")
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(len(cuts).bit_length()))))
    above = lambda at, step: F.coalesce(F.get(bounds, at + step - 1) <= F.col(key), F.lit(False))
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(above(at, step), at + step).otherwise(at))


def with_next(docs: DataFrame) -> DataFrame:
    """Each row with ``next_text`` of the row after it in descending doc_id, in a circle."""
    keyed = docs.withColumn("_key", _order("doc_id", "text"))
    cells = keyed.withColumn("_cell", _cell("_key", _cuts(keyed)))
    order = Window.partitionBy("_cell").orderBy(F.desc("_key"))
    inside = cells.withColumn("next_text", F.lead("text").over(order))

    # The first row of each range, found by its key alone; there are some MOST_RANGES ranges at most.
    tops = cells.groupBy("_cell").agg(F.max("_key").alias("_key"))
    down = Window.orderBy(F.desc("_cell"))
    so_far = down.rowsBetween(Window.unboundedPreceding, 0)
    chain = tops.select("_cell", F.coalesce(F.lead("_cell").over(down), F.max("_cell").over(so_far)).alias("_below"))
    first = keyed.join(F.broadcast(tops), "_key")
    heads = first.groupBy(F.col("_cell").alias("_below")).agg(F.max("text").alias("_head"))
    follow = chain.join(heads, "_below").select("_cell", "_head")
    return inside.join(follow, "_cell", "left").select(*docs.columns, F.coalesce("next_text", "_head").alias("next_text"))


def fingerprints(docs: DataFrame) -> DataFrame:
    # anchors are made after the shuffle, of the next text too: they are longer than the texts
    half = "int(floor(length(text) / 2))"
    edited = F.expr(f"substring(text, 1, length(text) - {half}) || substring(next_text, 1, {half})")
    own = anchors(with_next(texts(docs)).withColumn("edited", edited), "text", "anchors").withColumn("own", distinct("anchors"))
    own = own.select("doc_id", F.length("text").cast("long").alias("n_chars"), "edited", "next_text", "anchors", "own")
    after = anchors(own, "next_text", "next").withColumn("next", distinct("next")).withColumn("near_next", likeness("own", "next")).drop("next_text", "next")
    out = anchors(after, "edited", "changed").withColumn("changed", distinct("changed"))
    return out.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text("own").alias("fingerprint"),
        as_text("changed").alias("edited_fingerprint"),
        likeness("own", "changed").alias("near_edited"),
        "near_next",
        "anchors",
    )


def op9_syncmers(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints(table(spark, folder, "documents"))
