"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch keeps every 5-word shingle hash below a fixed fraction (1/8) of the hash range,
whatever the document's length. Sketches of parts therefore merge by union, and the share of
a short document's hashes inside a long one estimates containment, which sketches of a
fixed size cannot do. A document with shingles but no hash below the limit keeps its least
one, so that short documents stay comparable. Fewer than five words are one shingle. Null
counts as empty; a text without words has the empty sketch, and two empty sketches are alike.

All of it is built-in column functions; hashes are the first 16 hexadecimal digits of MD5.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHINGLE = 5
#: Hashes below this hexadecimal limit are kept: 2/16 of the range.
LIMIT = "2"
_SPACE = "[ \\t-\\r]+"


def _once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def sketch(text: Column) -> Column:
    """The sorted sketch of a text, as an array of hashes."""

    def shingles(words: Column) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.size(words) - (SHINGLE - 1)), lambda i: F.md5(F.concat_ws(" ", F.slice(words, i, SHINGLE)).cast("binary")))
        few = F.array(F.md5(F.concat_ws(" ", words).cast("binary")))
        return F.when(F.size(words) >= SHINGLE, each).when(F.size(words) > 0, few).otherwise(F.array().cast("array<string>"))

    def kept(hashes: Column) -> Column:
        low = F.filter(hashes, lambda h: h < LIMIT)
        return _once(low, lambda x: F.when((F.size(x) > 0) | (F.size(hashes) == 0), x).otherwise(F.array(F.array_min(hashes))))

    words = F.filter(F.split(F.coalesce(text, F.lit("")), _SPACE), lambda w: w != "")
    hashes = _once(words, shingles)
    return F.array_sort(F.array_distinct(F.transform(_once(hashes, kept), lambda h: F.substring(h, 1, 16))))


def likeness(a: Column, b: Column) -> Column:
    """Share of common hashes among all of both sketches; 1 for two empty ones."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has; 1 for an empty a."""
    return F.when(F.size(a) == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def merged(a: Column, b: Column) -> Column:
    """The sketch of both documents' shingles together."""
    both = F.array_union(a, b)
    low = F.filter(both, lambda h: h < LIMIT)
    return F.array_sort(F.when((F.size(low) > 0) | (F.size(both) == 0), low).otherwise(F.array(F.array_min(both))))


def in_order(docs: DataFrame, parts: int) -> DataFrame:
    """``docs`` (doc_id, text) dealt into ``parts`` ranges of ids, in columns ``part`` and ``guest``.

    The first document of each range is also a guest at the end of the range before it, and the
    first of all at the end of the last: a window within a range then sees every successor.
    Ranges come from approximate percentiles of all ids; what the driver sees of them are
    ``parts`` numbers.
    """
    key = F.coalesce("doc_id", F.lit(-(1 << 63)))
    keyed = docs.withColumn("key", key)
    cuts = keyed.agg(F.percentile_approx("key", [k / parts for k in range(1, parts)] or [0.5], 10 * parts).alias("c")).first()["c"] or []
    cuts = sorted(set(cuts))[: parts - 1]
    steps = [1 << k for k in reversed(range(max(1, len(cuts).bit_length())))]
    bounds = F.array(*[F.lit(c) for c in cuts]) if cuts else F.array().cast("array<bigint>")

    def search(at: Column, step: Column) -> Column:
        return F.when(F.coalesce(F.get(bounds, at + step - 1) <= F.col("key"), F.lit(False)), at + step).otherwise(at)

    keyed = keyed.withColumn("part", F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), search))
    first = sorted((r["part"], r["least"]) for r in keyed.groupBy("part").agg(F.min("key").alias("least")).collect())
    if not first:
        return keyed.withColumn("guest", F.lit(False))
    before = [first[k - 1][0] for k in range(len(first))]
    hosts = F.create_map(*[F.lit(x) for (_, least), host in zip(first, before) for x in (least, host)])
    host = F.element_at(hosts, F.col("key"))
    seats = F.when(host.isNull(), F.array(F.struct("part", F.lit(False).alias("guest")))).otherwise(
        F.array(F.struct("part", F.lit(False).alias("guest")), F.struct(host.alias("part"), F.lit(True).alias("guest")))
    )
    return keyed.withColumn("seat", F.explode(seats)).select("doc_id", "text", "key", "seat.part", "seat.guest")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_chars, edited (text), sketch, edited_sketch, next_sketch (arrays of hashes).

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many of
    the next document in the order of ids; after the last comes the first. Rows without id
    come first, ties in the order of a hash of their texts. A table of one row follows itself.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    dealt = in_order(own, parts).repartition(parts, "part").withColumn("sketch", sketch(F.col("text")))
    order = Window.partitionBy("part").orderBy("guest", "key", F.xxhash64("text"))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    seen = dealt.withColumn("next_text", F.lead("text").over(order)).withColumn("next_sketch", F.lead("sketch").over(order)).where("not guest")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    out = seen.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "sketch", "next_sketch")
    return out.withColumn("edited_sketch", sketch(F.col("edited")))
