"""Document fingerprints of closed syncmers, in DataFrame functions alone.

The letters are words (runs of characters other than ASCII white space); in scripts that don't space their words, each
character is a letter.  Of all runs of K letters, those are chosen whose least inner run of S letters, by hash, is the
first or the last one.  The choice depends on nothing but the run itself, so a passage keeps its anchors wherever it
stands, and an edit changes only the runs that touch it.  A text of fewer than K letters is one run; where none of a text's
runs is chosen (which takes fewer than 2K - S - 1 letters), the one with the least hash is.  So only a text without letters
has the empty fingerprint.

A fingerprint has each anchor once, with the place of its first letter.  Two fingerprints are compared by place: their
common anchors, in the order of one text, lie on diagonals (the difference of their places), and count where a neighbour
lies on the same one, so a passage counts wherever it was moved to, and scattered anchors that agree by chance don't.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import let, n_partitions

K, S = 8, 2
#: Fixed ranges: South-East Asian scripts, kana, Chinese characters and their extensions.
UNSPACED = r"\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3040-\u30FF\u3400-\u9FFF\uF900-\uFAFF\x{20000}-\x{3FFFF}"
LETTER = rf"[^\x20\x09-\x0D{UNSPACED}]+|[{UNSPACED}]"
#: Of the ranges of ids that put documents in order: first-level ranges, and rows in a second-level one.
RANGES, RANGE_ROWS = 4096, 500


def _first_places(found: Column) -> Column:
    """Each anchor of found (anchor, place) once, with its least place; in the order of the anchors."""
    return let(F.array_sort(found), lambda x: F.filter(x, lambda e, i: (i == 0) | (F.get(x, i - 1)["anchor"] != e["anchor"])))


def syncmers(text: Column, k: int = K, s: int = S) -> Column:
    """A text's closed syncmers: array<struct<anchor long, place int>>, each anchor once, in the order of the anchors."""

    def chosen(h: Column) -> Column:
        def anchor(i: Column) -> Column:
            return F.struct(F.xxhash64(*[F.get(h, i + j) for j in range(k)]).alias("anchor"), i.alias("place"))

        def of(g: Column) -> Column:
            def is_chosen(i: Column) -> Column:
                edges = F.least(F.get(g, i), F.get(g, i + (k - s)))
                return edges <= F.least(*[F.get(g, i + j) for j in range(1, k - s)])

            places = F.sequence(F.lit(0), F.size(h) - k)
            at = F.filter(places, is_chosen)
            least = F.array(F.array_min(F.transform(places, anchor)))
            return let(at, lambda x: F.when(F.size(x) > 0, F.transform(x, anchor)).otherwise(least))

        grams = F.transform(h, lambda x, i: F.xxhash64(*[F.get(h, i + j) for j in range(s)]))
        whole = F.array(F.struct(F.xxhash64(h).alias("anchor"), F.lit(0).alias("place")))
        short = F.when(F.size(h) > 0, whole).otherwise(F.slice(whole, 1, 0))
        return F.when(F.size(h) < k, short).otherwise(let(grams, of))

    letters = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(LETTER), F.lit(0))
    return _first_places(let(F.transform(letters, lambda w: F.xxhash64(w)), chosen))


def as_text(fingerprint: Column) -> Column:
    """16 hexadecimal digits for each anchor and 8 for its place, in the order of the places."""
    by_place = F.array_sort(F.transform(fingerprint, lambda x: F.struct(x["place"].alias("place"), x["anchor"].alias("anchor"))))
    digits = F.transform(by_place, lambda x: F.lower(F.concat(F.lpad(F.hex(x["anchor"]), 16, "0"), F.lpad(F.hex(x["place"]), 8, "0"))))
    return F.array_join(digits, "")


def likeness(a: Column, b: Column) -> Column:
    """How much of two fingerprints agrees by place: m / (|a| + |b| - m) for m aligned common anchors; two empty ones are alike.

    A common anchor is aligned if the one before or behind it, in the order of a's text, lies on the same diagonal, or if
    it is the only common one.  Sorting, so work grows with n log n.
    """

    def side(x: Column, which: int) -> Column:
        return F.transform(x, lambda e: F.struct(e["anchor"].alias("anchor"), F.lit(which).alias("side"), e["place"].alias("place")))

    def meeting(both: Column) -> Column:
        # an anchor stands at most once in each, so those of both are neighbours, a's first
        def pair(e: Column, i: Column) -> Column:
            other = F.get(both, i + 1)
            there = (e["side"] == 0) & (other["anchor"] == e["anchor"])
            return F.when(there, F.struct(e["place"].alias("at"), (other["place"] - e["place"]).alias("diagonal")))

        return F.array_sort(F.array_compact(F.transform(both, pair)))

    def aligned(met: Column) -> Column:
        def alike(e: Column, i: Column) -> Column:
            before, behind = F.get(met, i - 1)["diagonal"], F.get(met, i + 1)["diagonal"]
            return F.coalesce(before == e["diagonal"], F.lit(False)) | F.coalesce(behind == e["diagonal"], F.lit(False))

        return F.when(F.size(met) < 2, F.size(met)).otherwise(F.size(F.filter(met, alike)))

    both = F.array_sort(F.concat(side(a, 0), side(b, 1)))
    m = let(let(both, meeting), aligned)
    return F.when(F.size(a) + F.size(b) == 0, 1.0).otherwise(let(m, lambda n: n / (F.size(a) + F.size(b) - n)))


def with_next(docs: DataFrame) -> DataFrame:
    """docs (id, text) with anchors, next_text and next_anchors: those of the document with the next id, after the last the first.

    Ids must be numbers; null ids come last, and rows with equal ids in the order of their texts.  Ids are cut into
    ranges of equal width, and crowded ranges once more between their own least and largest id, so no task sees more
    than a small part of the order; the first row of each range is handed to the range before it.
    """
    spark = docs.sparkSession
    span = docs.agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("n")).first()
    lo, width = float(span.lo or 0), (float(span.hi or 0) - float(span.lo or 0) + 1)
    rough = F.coalesce(F.floor((F.col("id") - F.lit(lo)) / F.lit(width) * RANGES).cast("int"), F.lit(RANGES))
    # at most RANGES + 1 rows
    ranges = docs.select("id", rough.alias("range")).groupBy("range").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("n"))
    per = max(RANGE_ROWS, span.n // 100_000)
    ranges = ranges.select("range", "lo", (F.col("hi") - F.col("lo") + 1).cast("double").alias("wide"), F.ceil(F.col("n") / per).alias("parts"))
    # ranges far below ``per`` rows share a group of neighbours
    group = max(1, int(per * RANGES // max(1, span.n)))
    rows = docs.withColumn("range", rough).join(F.broadcast(ranges), "range")
    part = F.coalesce(F.floor((F.col("id") - F.col("lo")) / F.col("wide") * F.col("parts")), F.lit(0)).cast("int")
    rows = rows.select("id", "text", F.floor(F.col("range") / group).cast("int").alias("range"), F.when(F.lit(group > 1), 0).otherwise(part).alias("part"))
    keys = ["range", "part"]
    firsts = rows.groupBy(*keys).agg(F.min("id").alias("first_id"))
    # one row per range, about 100,000 at most: only keys are put in order
    in_order = Window.partitionBy(F.lit(0)).orderBy(*keys)
    ends = firsts.agg(F.max(F.struct(*keys)).alias("last")).first()
    last = F.struct(*[F.lit(x).cast("int").alias(k) for k, x in zip(keys, ends["last"] or (None, None))])
    before = F.coalesce(F.lag(F.struct(*keys)).over(in_order), last)
    after = firsts.select(F.struct(*keys, F.col("first_id").alias("id")).alias("place"), before.alias("before"))
    heads = (
        rows.withColumn("place", F.struct(*keys, "id")).join(F.broadcast(after), "place")
        .groupBy("before").agg(F.min(F.struct("id", "text")).alias("head"))
        .select("head.id", "head.text", "before.range", "before.part", F.lit(1).alias("borrowed"))
    )
    every = rows.withColumn("borrowed", F.lit(0)).unionByName(heads).repartition(n_partitions(spark), *keys)
    every = every.withColumn("anchors", syncmers(F.col("text")))
    w = Window.partitionBy(*keys).orderBy("borrowed", F.asc_nulls_last("id"), "text")
    every = every.withColumns({"next_text": F.lead("text").over(w), "next_anchors": F.lead("anchors").over(w)})
    return every.where("borrowed = 0").drop("borrowed", *keys)


def edited(text: Column, next_text: Column) -> Column:
    """text with its last floor(n / 2) code points replaced by the first as many of next_text."""
    half = F.floor(F.char_length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.char_length(text) - half), F.substring(next_text, F.lit(1), half))


def compare_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Null texts count as empty; the next document of a single one is itself; an empty table gives no rows.
    """
    rows = with_next(docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")))
    rows = rows.withColumn("edited", edited(F.col("text"), F.col("next_text")))
    rows = rows.withColumn("edited_anchors", syncmers(F.col("edited")))
    return rows.select(
        "id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("anchors")).alias("fingerprint"),
        as_text(F.col("edited_anchors")).alias("edited_fingerprint"),
        likeness(F.col("anchors"), F.col("edited_anchors")).alias("near_edited"),
        likeness(F.col("anchors"), F.col("next_anchors")).alias("near_next"),
    )
