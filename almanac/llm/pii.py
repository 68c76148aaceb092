"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score.

DataFrame functions only. Patterns are written so that matching takes time in proportion to the
text: a match starts where a run of its letters starts or where the last match ended, and no group
is tried again. That leaves the leftmost, longest and non-overlapping matches of the plain patterns
named in ``KINDS``.

A null text is empty. Every row gives one row, repeated rows included, and a text without finds
has an empty list. Offsets count code points from 0, the end excluded.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(match: Column) -> Column:
    n = F.length(digits(match))
    return n.between(13, 19) & F.call_function("luhn_check", digits(match))


def _phone(match: Column) -> Column:
    return F.length(digits(match)).between(9, 15)


def _address(match: Column) -> Column:
    part = "0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9][0-9]?)"
    return match.rlike(rf"^{part}\.{part}\.{part}\.{part}$")


def _mod97(match: Column) -> Column:
    """An account number's check: the first four characters go last, letters count from 10, and the
    number leaves 1 when divided by 97."""
    plain = F.replace(match, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4)))

    def step(rest: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code >= 65, (rest * 100 + code - 55) % 97).otherwise((rest * 10 + code - 48) % 97)

    rest = F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise(step(a, c)))
    return F.length(plain).between(15, 34) & (rest == 1)


# Lengths of account numbers by country code: the registry of ISO 13616 and countries in trial use.
ACCOUNT_LENGTHS = {
    int(n): codes.split()
    for n, codes in (x.split(":") for x in (
        "15:NO", "16:BE", "18:DK FK FO FI GL NL SD", "19:MK SI", "20:AT BA EE KZ LT LU MN XK", "21:CH HR LI LV",
        "22:BG BH CR DE GB GE IE ME RS VA", "23:AE GI IL IQ OM SO TL", "24:AD CZ ES MD PK RO SA SE SK TN VG",
        "25:AO CV GW LY MZ PT ST", "26:DZ IR IS TR", "27:BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD",
        "28:AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG",
        "29:BR EG PS QA UA", "30:JO KW MU YE", "31:MT SC", "32:LC", "33:RU",
    ))
}


def _account_pattern() -> str:
    """A country code and as many letters and digits as it has, single spaces between; for a code that
    is not listed, all that follow up to a listed code, at most 34."""
    fixed = [f"(?:{'|'.join(codes)})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, codes in ACCOUNT_LENGTHS.items()]
    listed = "|".join(c for codes in ACCOUNT_LENGTHS.values() for c in codes)
    other = rf"(?!{listed})[A-Z]{{2}}[0-9]{{2}}(?:(?! (?:{listed})[0-9]{{2}}) ?[A-Z0-9]){{11,30}}"
    return rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{'|'.join([*fixed, other])})(?![A-Za-z0-9])"


def _always(match: Column) -> Column:
    return F.lit(True)


@dataclass(frozen=True)
class Kind:
    """A kind of personal data.

    name     as reported
    pattern  proposes spans
    check    confirms them
    trigger  a text without this has none
    score    before the words nearby are looked at
    context  words nearby that raise the score by ``CONTEXT_GAIN``
    least    score from which a span is reported; 0 reports every confirmed span
    base     whether the kind belongs to the fixed set
    """

    name: str
    pattern: str
    check: object
    trigger: str
    score: float
    context: str
    least: float = 0.0
    base: bool = False


CONTEXT_GAIN = 0.35
# Code points before and after a span in which context words count.
NEARBY = 48

KINDS = [
    # The four base patterns
    #   email [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    #   ip    [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+), parts at most 255
    #   card  [0-9]([ -]?[0-9])+, 13 to 19 digits that pass Luhn
    #   phone \+[0-9][ ().0-9-]+[0-9], 9 to 15 digits
    Kind(
        "email",
        r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        _always, "@", 0.6, "mail|contact|write|kontakt|courriel|correo", base=True,
    ),
    Kind(
        "ip",
        r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        _address, ".", 0.5, "ip|address|server|host|adresse|servidor", base=True,
    ),
    Kind("card", r"[0-9](?:[ -]?+[0-9])++", _luhn, "", 0.6, "card|visa|credit|karte|carte|tarjeta", base=True),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", _phone, "+", 0.5, "phone|call|tel|mobile|fax|anruf", base=True),
    Kind(
        "iban",
        _account_pattern(),
        _mod97, "", 0.7, "iban|account|bank|konto|compte|cuenta",
    ),
    Kind(
        "ssn",
        r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])",
        _always, "-", 0.3, "ssn|social|security|sozialversicherung|seguro", least=0.5,
    ),
    Kind(
        "secret",
        r"(?i)(?<![A-Za-z0-9_])(?:token|secret|password|api[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?[A-Za-z0-9+/_-]{16,}+",
        _always, "", 0.5, "token|secret|password|key",
    ),
]
BASE_KINDS = [k.name for k in KINDS if k.base]

SPAN = "struct<kind:string,start:long,end:long,match:string,score:double>"

# Every step is linear in the text and in its finds. A place costs a walk over the code points before it, so that stretches
# of the text are cut from blocks of so many; running results are carried from chunk to chunk of so many.
BLOCK, CHUNK = 1024, 256


def _running(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """For each number of an array, the result of ``op`` over 0 and all before it."""
    zero, none = F.lit(0).cast("long"), F.array().cast("array<bigint>")

    def fold(x: Column, first: Column) -> Column:
        start = F.struct(first.alias("at"), none.alias("out"))
        step = lambda a, v: F.struct(op(a["at"], v).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out"))
        return F.aggregate(x, start, step)["out"]

    last = F.floor((F.size(values) - 1) / CHUNK).cast("int")
    chunks = F.transform(F.sequence(F.lit(0), last), lambda c: F.slice(values, c * CHUNK + 1, F.lit(CHUNK)))
    carried = fold(F.transform(chunks, lambda c: F.aggregate(c, zero, op)), zero)
    return F.when(F.size(values) > 0, F.flatten(F.zip_with(chunks, carried, fold))).otherwise(none)


def _matches(kind: Kind) -> Column:
    """All matches, each with what stands before it from the last one on."""
    text = F.col("text")
    # Splitting and finding see the same matches, so lengths add up to places.
    pairs = F.arrays_zip(F.split(text, kind.pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)).alias("match"))
    found = F.filter(pairs, lambda p: p["match"].isNotNull())
    if not kind.trigger:
        return found
    return F.when(F.contains(text, F.lit(kind.trigger)), found).otherwise(F.array().cast("array<struct<gap:string,match:string>>"))


def _proposed(frame: DataFrame) -> DataFrame:
    """The rows with the places of each kind's matches (p_kind) and the blocks of the text, none without matches."""
    names, columns = [k.name for k in KINDS], frame.columns
    found = frame.select("*", *[_matches(k).alias(f"m_{k.name}") for k in KINDS])
    size = lambda p: (F.length(p["gap"]) + F.length(p["match"])).cast("long")
    sized = found.select("*", *[F.transform(f"m_{n}", size).alias(f"l_{n}") for n in names])
    placed = sized.select("*", *[_running(F.col(f"l_{n}"), lambda x, y: x + y).alias(f"r_{n}") for n in names])

    def span(p: Column, at: Column) -> Column:
        start = at + F.length(p["gap"])
        return F.struct(start.alias("start"), (start + F.length(p["match"])).alias("end"), p["match"].alias("match"))

    spans = [F.zip_with(f"m_{n}", f"r_{n}", span).alias(f"p_{n}") for n in names]
    some = reduce(lambda a, b: a | b, [F.size(f"m_{n}") > 0 for n in names])
    blocks = F.when(some, F.regexp_extract_all("text", F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))).otherwise(F.array().cast("array<string>"))
    return placed.select(*columns, *spans, blocks.alias("blocks"))


def _stretch(start: Column, end: Column) -> Column:
    """The text from one place to another, cut from the blocks that hold it."""
    first = F.floor(start / BLOCK).cast("int")
    held = F.slice("blocks", first + 1, F.floor(end / BLOCK).cast("int") - first + 1)
    return F.substr(F.array_join(held, ""), (start - first * BLOCK + 1).cast("int"), (end - start).cast("int"))


def _scored(kind: Kind) -> Column:
    """The confirmed spans of a kind with their scores."""

    def score(s: Column) -> Column:
        before = _stretch(F.greatest(s["start"] - NEARBY, F.lit(0).cast("long")), s["start"])
        after = _stretch(s["end"], s["end"] + NEARBY)
        near = F.concat(before, F.lit(" "), after).rlike(rf"(?i)\b(?:{kind.context})\b")
        return F.when(near, kind.score + CONTEXT_GAIN).otherwise(kind.score)

    confirmed = F.filter(f"p_{kind.name}", lambda s: kind.check(s["match"]))
    spans = F.transform(
        confirmed,
        lambda s: F.struct(
            F.lit(kind.name).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["match"].alias("match"), score(s).alias("score")
        ),
    )
    return F.filter(spans, lambda s: s["score"] >= kind.least) if kind.least else spans


def find_private(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, spans): kind, start, end, match and score of all finds, by kind as listed, then place."""
    frame = docs.select(docs[key].alias("key"), F.coalesce(docs[text], F.lit("")).alias("text"))
    spans = F.concat(*[_scored(k) for k in KINDS]).cast(f"array<{SPAN}>")
    return _proposed(frame).select(F.col("key").alias(key), spans.alias("spans"))


def redact(docs: DataFrame, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """The rows with every find replaced by its kind in brackets; a null text stays null.

    Where finds overlap, the stretch they cover is replaced once, by the kind that starts
    first (the longest of these). ``length`` names a column to bring up to date, if there is one.
    """
    if length and length not in docs.columns:
        length = None
    frame = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.coalesce(docs[text], F.lit("")).alias("text"))
    spans = _proposed(frame).select("row", "text", "blocks", F.concat(*[_scored(k) for k in KINDS]).alias("spans"))
    each = lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"))
    ordered = spans.withColumn("spans", F.array_sort(F.transform("spans", each))).withColumn("ends", F.transform("spans", lambda s: -s["back"]))
    # How far the finds before each one reach; one that starts before that place is covered with them.
    reached = ordered.withColumn("reach", _running(F.col("ends"), lambda x, y: F.greatest(x, y)))
    joined = F.zip_with("spans", "reach", lambda s, r: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), r.alias("reach")))
    heads = reached.withColumn("spans", F.filter(joined, lambda s: s["start"] >= s["reach"]))
    written = F.transform("spans", lambda s: F.concat(_stretch(s["reach"], s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]")))
    done = F.concat(F.array_join(written, ""), _stretch(F.array_max("ends"), F.length("text").cast("long")))
    clean = heads.select("row", F.when(F.col("row").getField(text).isNull(), F.lit(None)).when(F.size("spans") == 0, F.col("text")).otherwise(done).alias("clean"))

    def out(c: str) -> Column:
        if c == text:
            return F.col("clean").alias(c)
        if c == length:
            kind = docs.schema[c].dataType
            return F.coalesce(F.length("clean").cast(kind), F.col("row").getField(c)).alias(c)
        return F.col("row").getField(c).alias(c)

    return clean.select(*[out(c) for c in docs.columns])


def listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def base_only(spans: Column) -> Column:
    return F.filter(spans, lambda s: reduce(lambda a, b: a | b, [s["kind"] == k for k in BASE_KINDS]))
