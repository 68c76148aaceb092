"""Document fingerprints by I-Match with randomised lexicons, in DataFrame functions only.

Terms are runs of digits, letters and anything beyond ASCII, A-Z lower-cased. The lexicon holds the
terms whose share of documents lies within a band of inverse document frequency: frequent ones
say nothing, rare ones change with every slip of the pen. A fingerprint is made of one hash over a
document's distinct lexicon terms, sorted, and one for each of several random subsets of
the lexicon, so that a change of a few terms leaves the hashes of subsets without them as they were.
Subsets come in chains that thin out from step to step: the dense ones tell long texts with few
changes from equal ones, the sparse ones still agree where half a text is new.

Terms are counted and looked up by 64-bit hashes. The lexicon has at most ``LEXICON_MOST`` of these
whatever the corpus: the band's lower edge rises where there would be more. It is part of the
plan as one constant, 20 bytes a term.

A null or empty text has no terms. A text with fewer than ``MIN_TERMS`` lexicon terms takes all its
terms instead, one without any term its whole self as the only one; equal texts thus have equal
fingerprints and different short ones do not. Repeated rows of a key and text are one document in
the order of keys and all come back; equal keys with different texts are ordered by the text's
hash, null keys come last. An empty table gives an empty one. Other columns stay behind.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almanac.sources.sinks import stored

# The band: terms in at least and at most this share of all documents.
LEAST_SHARE, MOST_SHARE = 1 / 400, 1 / 20
# Most terms of the lexicon, and how many share a slot of the look-up.
LEXICON_MOST = 200_000
PER_SLOT = 4
# Fewest lexicon terms that stand for a text.
MIN_TERMS = 4
# Chains of random subsets: of FAMILIES chains, each has one for every entry of STEPS, which keeps a term
# if so many bits of its hash are zero, so that each subset lies within the one before it.
FAMILIES, STEPS = 12, (1, 3, 5, 7, 9)
FAMILY_BITS = 10
# Hexadecimal digits of one subset's hash; a subset without terms of the text has dashes.
DIGITS = 6
EMPTY = "-" * DIGITS
SUBSETS = 1 + FAMILIES * len(STEPS)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NO_TERM = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def terms_of(text: Column) -> Column:
    """Hashes of the distinct terms of a text."""
    words = F.split(F.translate(text, UPPER, LOWER), NO_TERM)
    return F.array_remove(F.array_distinct(F.transform(words, lambda w: F.xxhash64(w))), F.xxhash64(F.lit("")))


def lexicon_of(docs: DataFrame, text: str = "text") -> DataFrame:
    """(term,): hashes of the terms within the band, over all documents."""
    said = docs.select(F.explode(terms_of(F.coalesce(docs[text], F.lit("")))).alias("term"))
    # A term of one document alone is never in the band.
    counted = stored(said.groupBy("term").agg(F.count("*").alias("df")).where("df >= 2"), "terms")
    pairs = counted.agg(F.sum("df")).first()[0] or 0
    documents = docs.count()
    least = max(math.ceil(documents * LEAST_SHARE), math.ceil(pairs / LEXICON_MOST))
    return counted.where((F.col("df") >= least) & (F.col("df") <= documents * MOST_SHARE)).select("term")


def lexicon_test(lexicon: DataFrame) -> Callable[[Column], Column]:
    """A function that says of a term whether it is in the lexicon: a constant array of small slots."""
    slots = 1 << math.ceil(math.log2(max(lexicon.count() / PER_SLOT, 1)))
    slot = F.pmod(F.col("term"), F.lit(slots)).alias("slot")
    filled = lexicon.groupBy(slot).agg(F.to_json(F.sort_array(F.collect_list("term"))).alias("held"))
    every = lexicon.sparkSession.range(slots).join(filled, F.col("id") == F.col("slot"), "left")
    listed = every.groupBy().agg(F.sort_array(F.collect_list(F.struct("id", F.coalesce("held", F.lit("[]")).alias("held")))).alias("all"))
    written = listed.select(F.array_join(F.transform("all", lambda s: s["held"]), ",")).first()[0]
    held = F.from_json(F.lit(f"[{written}]"), "array<array<bigint>>")

    def known(term: Column) -> Column:
        return F.array_contains(F.element_at(held, (F.pmod(term, F.lit(slots)) + 1).cast("int")), term)

    return known


def _digest(kept: Column) -> Column:
    """The last digits of one hash over all terms of a subset, in their order."""
    # With the first bit set there are always 16 digits.
    whole = F.hex(F.xxhash64(kept).bitwiseOR(F.lit(-(1 << 63)).cast("long")))
    return F.when(F.size(kept) == 0, EMPTY).otherwise(F.substring(whole, 17 - DIGITS, DIGITS))


def _thinned(family: int, bits: int) -> Callable[[Column], Column]:
    """Keeps the terms in whose hash so many bits of the family are zero."""
    half, place = divmod(family, FAMILIES // 2)
    mask = F.lit(((1 << bits) - 1) << (FAMILY_BITS * place)).cast("long")
    return lambda t: t[f"b{half}"].bitwiseAND(mask) == 0


def with_fingerprint(docs: DataFrame, text: str, name: str, known: Callable[[Column], Column]) -> DataFrame:
    """The rows with a column ``name``: the fingerprint of the column ``text``, which has no nulls."""
    columns = docs.columns
    # Each step is a projection of its own, so that no array is made twice.
    steps = docs.withColumn("_terms", terms_of(F.col(text)))
    steps = steps.withColumn("_known", F.filter("_terms", known))
    picked = F.when(F.size("_known") >= MIN_TERMS, F.col("_known")).when(F.size("_terms") > 0, F.col("_terms")).otherwise(F.array(F.xxhash64(text)))
    bits = F.transform(F.sort_array(picked), lambda h: F.struct(h.alias("term"), F.xxhash64(h, F.lit(0)).alias("b0"), F.xxhash64(h, F.lit(1)).alias("b1")))
    steps = steps.withColumn("_whole", bits)
    held = ["_whole"] * FAMILIES
    digests = [["_whole"]] + [[] for _ in range(FAMILIES)]
    for step, bits in enumerate(STEPS):
        fresh = {}
        for f in range(FAMILIES):
            fresh[f"_{f}_{step}"] = F.filter(held[f], _thinned(f, bits))
            held[f] = f"_{f}_{step}"
            digests[1 + f].append(held[f])
        steps = steps.withColumns(fresh)
    whole = F.concat(*[_digest(F.col(c)) for chain in digests for c in chain])
    return steps.select(*columns, whole.alias(name))


def likeness(a: Column, b: Column) -> Column:
    """Share of subsets whose hashes agree, of those in which either text has terms: 0 to 1."""
    places = F.array(*[F.lit(1 + DIGITS * i) for i in range(SUBSETS)])
    part = lambda c, i: c.substr(i, F.lit(DIGITS))
    asked = F.filter(places, lambda i: (part(a, i) != EMPTY) | (part(b, i) != EMPTY))
    return F.size(F.filter(asked, lambda i: part(a, i) == part(b, i))) / F.size(asked)


def fingerprint_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text, fingerprint) of every row."""
    known = lexicon_test(lexicon_of(docs, text))
    frame = docs.select(docs[key].alias(key), F.coalesce(docs[text], F.lit("")).alias("text"))
    return with_fingerprint(frame, "text", "fingerprint", known)


def _following(narrow: DataFrame) -> DataFrame:
    """(key, tag, owner, owner_tag, owner_chars): each distinct document with the one before it in
    the order of keys; the first one's is the last.

    ``narrow`` has distinct (key, tag, n_chars). It is stored in ranges; each range is put in order by a
    window, and the first rows of the ranges, one a task, are chained.
    """
    order = [F.col("key").asc_nulls_last(), F.col("tag")]
    ranged = narrow.repartitionByRange(*order).withColumn("slice", F.spark_partition_id())
    ranged = stored(ranged, "ranges")
    inside = Window.partitionBy("slice").orderBy(*order)
    me = F.struct("key", "tag")
    ranked = ranged.select("*", F.lead(me).over(inside).alias("next"), F.row_number().over(inside).alias("place"))
    firsts = ranked.where("place = 1").select("slice", me.alias("first"))
    # As many rows as ranges.
    along = Window.orderBy("slice")
    edges = firsts.select(
        "slice", F.coalesce(F.lead("first").over(along), F.first("first").over(along)).alias("over")
    )
    linked = ranked.join(edges, "slice").select(
        F.coalesce("next", "over").alias("next"), F.col("key").alias("owner"), F.col("tag").alias("owner_tag"), F.col("n_chars").alias("owner_chars")
    )
    return linked.select("next.key", "next.tag", "owner", "owner_tag", "owner_chars")


def edited_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text, fingerprint, edited, edited_fingerprint, next_fingerprint) of every row.

    ``edited`` is the text with its last floor(n / 2) characters replaced by the first as many of the
    next document in the order of keys.
    """
    known = lexicon_test(lexicon_of(docs, text))
    frame = docs.select(docs[key].alias("key"), F.coalesce(docs[text], F.lit("")).alias("text"))
    frame = frame.withColumn("tag", F.xxhash64("text"))
    links = _following(frame.select("key", "tag", F.length("text").alias("n_chars")).distinct())
    marked = with_fingerprint(frame, "text", "fingerprint", known)
    sent = (
        marked.alias("d")
        .join(links.alias("l"), F.col("d.key").eqNullSafe(F.col("l.key")) & (F.col("d.tag") == F.col("l.tag")))
        .select(
            F.col("owner").alias("key"),
            F.col("owner_tag").alias("tag"),
            F.col("text").substr(F.lit(1), F.floor(F.col("owner_chars") / 2).cast("int")).alias("head"),
            F.col("fingerprint").alias("next_fingerprint"),
        )
    )
    # Repeated rows send the same thing.
    sent = sent.groupBy("key", "tag").agg(F.max("head").alias("head"), F.max("next_fingerprint").alias("next_fingerprint"))
    both = marked.alias("d").join(sent.alias("s"), F.col("d.key").eqNullSafe(F.col("s.key")) & (F.col("d.tag") == F.col("s.tag")))
    n = F.length("text")
    edited = F.concat(F.col("text").substr(F.lit(1), n - F.floor(n / 2).cast("int")), F.col("head"))
    both = both.select(F.col("d.key"), "text", "fingerprint", edited.alias("edited"), "next_fingerprint")
    out = with_fingerprint(both, "edited", "edited_fingerprint", known)
    return out.select(F.col("key").alias(key), "text", "fingerprint", "edited", "edited_fingerprint", "next_fingerprint")
