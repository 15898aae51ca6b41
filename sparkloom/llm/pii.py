"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score.

Everything is built-in column functions, so spans are found inside the scan's own tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Characters of an account number by country (the IBAN registry).
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_IBAN = "|".join(rf"(?:{x.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}(?![A-Z0-9])" for n, x in IBAN_LENGTHS.items())
_OTHER = rf"(?!{'|'.join(x.replace(' ', '|') for x in IBAN_LENGTHS.values())})[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]){{11,30}}+(?![A-Z0-9])"

# Fixed patterns, leftmost and non-overlapping per kind. Possessive repeats and the look-behind
# forbid backtracking, which changes no match: what follows a repeat is never in its class, and a
# run of class characters that fails from its first place fails from every later one.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": rf"(?<![A-Z0-9])(?=({_IBAN}|{_OTHER}))",  # of no width, so that a false start hides none that begins inside
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "ssn")
#: What a text must hold for a kind to be possible; spares most texts the pattern.
HINTS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]", "iban": r"[A-Z]{2}[0-9]{2}", "ssn": r"[0-9]{3}-[0-9]{2}-"}
#: Scores: of the pattern with its check, and of a context word in the CONTEXT_CHARS on either side.
PRIOR = {"email": 0.8, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.8, "ssn": 0.3}
CONTEXT = {
    "email": r"\b(?:e-?mail|mail|contact|write)\b",
    "ip": r"\b(?:ip|host|server|address|login)\b",
    "card": r"\b(?:card|visa|mastercard|amex|credit|debit|carte|karte|tarjeta)\b",
    "phone": r"\b(?:phone|tel|call|mobile|fax|t[ée]l[ée]phone|telefon|tel[ée]fono)\b",
    "iban": r"\b(?:iban|account|bank|konto|compte|cuenta)\b",
    "ssn": r"\b(?:ssn|social security)\b",
}
CONTEXT_CHARS, CONTEXT_BONUS, THRESHOLD = 48, 0.2, 0.5


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(m: Column) -> Column:
    """Whether the digits of m have a Luhn sum divisible by 10."""
    d = F.transform(F.filter(F.split(F.reverse(_digits(m)), ""), lambda c: c != ""), lambda c: c.cast("int"))
    total = F.aggregate(F.transform(d, lambda x, i: F.when(i % 2 == 0, x).when(x > 4, 2 * x - 9).otherwise(2 * x)), F.lit(0), lambda a, x: a + x)
    return total % 10 == 0


def mod97(m: Column) -> Column:
    """Whether the account number m, its first four characters moved last, is 1 modulo 97."""
    flat = F.replace(m, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(flat, F.lit(5)), F.left(flat, F.lit(4)))
    chars = F.filter(F.split(turned, ""), lambda c: c != "")
    value = lambda c: F.when(c >= "A", F.ascii(c) - 55).otherwise(F.ascii(c) - 48)
    return F.aggregate(F.transform(chars, value), F.lit(0), lambda a, v: F.when(v > 9, a * 100 + v).otherwise(a * 10 + v) % 97) == 1


def _valid(kind: str, m: Column) -> Column:
    n = F.length(_digits(m))
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: p.cast("double") <= 255)
    if kind == "card":
        return F.when(n.between(13, 19), luhn(m)).otherwise(F.lit(False))
    if kind == "phone":
        return n.between(9, 15)
    if kind == "iban":
        return mod97(m)
    if kind == "ssn":
        return ~m.rlike("^(?:000|666|9)|-00-|-0000$")
    return m.isNotNull()


def _score(kind: str, before: Column, after: Column) -> Column:
    near = F.lower(before).rlike(CONTEXT[kind]) | F.lower(after).rlike(CONTEXT[kind])
    return F.lit(PRIOR[kind]) + F.when(near, F.lit(CONTEXT_BONUS)).otherwise(F.lit(0.0))


def _found(text: Column, kind: str) -> Column:
    """array<struct<gap, len, ok, score>> of a kind's matches; gap: characters since the match before it.

    Context is taken from the text on either side, up to the neighbouring matches, which have theirs.
    """
    p, wide = F.lit(PATTERNS[kind]), F.lit(CONTEXT_CHARS)
    if kind == "iban":  # matches have no width, so a gap begins with the number before; the line feed keeps split() from dropping an empty first part
        gaps = F.transform(F.split(F.concat(F.lit("\n"), text), p, -1), lambda g, i: F.when(i == 0, F.substr(g, F.lit(2))).otherwise(g))
        found = F.regexp_extract_all(text, p, F.lit(1))
    else:
        gaps, found = F.split(text, p, -1), F.regexp_extract_all(text, p, F.lit(0))
    none = F.lit("")

    def one(x: Column, m: Column, i: Column) -> Column:
        gap, after = F.get(x["gaps"], i), F.coalesce(F.get(x["gaps"], i + 1), F.lit(""))
        before = gap
        if kind == "iban":  # the gap after begins with the match itself, that before with the number before
            last = F.when(i > 0, F.length(F.get(x["found"], i - 1))).otherwise(F.lit(0))
            before, after = F.substr(gap, last + 1), F.substr(after, F.length(m) + 1, wide)
        score = _score(kind, F.right(before, wide), F.left(after, wide))
        return F.struct(F.length(gap).alias("gap"), F.length(m).alias("len"), F.coalesce(_valid(kind, m), F.lit(False)).alias("ok"), score.alias("score"))

    return common.let(F.struct(gaps.alias("gaps"), found.alias("found")), lambda x: F.transform(x["found"], lambda m, i: one(x, m, i)))


def _apart(spans: Column) -> Column:
    """spans, in order of their starts, without those that begin within an earlier one that stays."""

    def step(acc: Column, x: Column) -> Column:
        inside = x["start"] < acc["last"]
        return F.struct(F.when(inside, acc["last"]).otherwise(x["end"]).alias("last"), F.when(inside, F.concat(acc["gone"], F.array(x["start"]))).otherwise(acc["gone"]).alias("gone"))

    none = F.array().cast("array<int>")  # two numbers that overlap and both pass their check are rare
    gone = F.aggregate(spans, F.struct(F.lit(0).alias("last"), none.alias("gone")), step, lambda acc: acc["gone"])
    return common.let(gone, lambda g: F.when(F.size(g) == 0, spans).otherwise(F.filter(spans, lambda s: ~F.array_contains(g, s["start"]))))


def spans_of(text: Column, kind: str) -> Column:
    """array<struct<start, end, score>> of a kind's confirmed spans, in code points, end exclusive."""
    step = (lambda x: x["gap"]) if kind == "iban" else (lambda x: x["gap"] + x["len"])
    none = F.array().cast("array<struct<start: int, end: int, score: double>>")

    def placed(parts: Column) -> Column:
        at = common.running(F.transform(parts, step), lambda a, b: a + b)
        spans = F.zip_with(parts, at, lambda x, a: F.struct((a + x["gap"]).alias("start"), (a + x["gap"] + x["len"]).alias("end"), x["score"].alias("score"), x["ok"].alias("ok")))
        kept = F.filter(spans, lambda s: s["ok"] & (s["score"] >= THRESHOLD) if kind in ADDED else s["ok"])
        kept = F.transform(kept, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["score"].alias("score")))
        return common.let(kept, _apart) if kind == "iban" else kept

    found = common.let(_found(text, kind), lambda parts: F.when(F.exists(parts, lambda x: x["ok"]), placed(parts)).otherwise(none))
    return F.when(text.rlike(HINTS[kind]), found).otherwise(none)


#: Characters of a piece that masked() cuts a text into, so that no place is counted from the text's start.
PIECE = 1024


def masked(text: Column, spans: Column) -> Column:
    """text with each of spans, array<struct<start, back, kind>> in order, replaced by its kind in angle brackets.

    back: minus the end. Spans that overlap are one, of the kind of the first.
    """
    n = F.lit(PIECE)

    def part(pieces: Column, a: Column, b: Column) -> Column:
        first = F.floor(a / n).cast("int")
        held = F.slice(pieces, first + 1, F.floor(b / n).cast("int") - first + 1)
        return F.substr(F.array_join(held, ""), a - first * n + 1, b - a)

    def done(x: Column) -> Column:
        label = lambda s: F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">"))
        fresh = F.zip_with(x["spans"], x["reach"], lambda s, r: F.when(s["start"] >= r, F.concat(part(x["pieces"], r, s["start"]), label(s))).otherwise(F.lit("")))
        last = F.array_max(F.transform(x["spans"], lambda s: -s["back"]))
        return F.concat(F.array_join(fresh, ""), part(x["pieces"], last, x["length"]))

    reach = common.running(F.transform(spans, lambda s: -s["back"]), lambda a, b: F.greatest(a, b))
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    held = F.struct(spans.alias("spans"), reach.alias("reach"), pieces.alias("pieces"), F.length(text).alias("length"))
    return F.when(F.size(spans) > 0, common.let(held, done)).otherwise(text)


def _labelled(text: Column, kind: str) -> Column:
    return F.transform(spans_of(text, kind), lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), F.lit(kind).alias("kind")))


def _named(kind: str) -> Column:
    return F.transform(F.col(kind), lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, scores), one per input row.

    Base kinds that pass their check always stay; iban (mod-97) and ssn (context) are added. scores
    has the score of each span in order. A null text is empty and gives empty strings of spans.
    Repeated rows and null ids keep their rows; extra columns are ignored.
    """
    src = docs.select(F.col(id_col).alias("doc_id"), common.text_or_empty(text_col).alias("text"))
    found = src.select("doc_id", *[spans_of(F.col("text"), k).alias(k) for k in (*BASE, *ADDED)])
    base = F.array_join(F.concat(*[_named(k) for k in BASE]), ",")
    every = F.array_join(F.concat(*[_named(k) for k in (*BASE, *ADDED)]), ",")
    return found.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(base.cast("binary"), 256).alias("base_sha256"),
        every.alias("spans"),
        F.concat(*[F.transform(F.col(k), lambda s: s["score"]) for k in (*BASE, *ADDED)]).alias("scores"),
    )


def mask_pii(docs: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """docs with the spans of all kinds, found on the original text, masked and, if there is one, the column of text lengths set anew.

    A null text stays null. Other columns and the order of columns stay.
    """
    text = F.col(text_col)
    spans = F.array_sort(F.concat(*[_labelled(text, k) for k in (*BASE, *ADDED)]))
    out = docs.withColumn("_spans", spans).withColumn(text_col, masked(text, F.col("_spans")))
    if chars_col and chars_col in docs.columns:
        out = out.withColumn(chars_col, F.length(text_col).cast(docs.schema[chars_col].dataType))
    return out.select(*docs.columns)
