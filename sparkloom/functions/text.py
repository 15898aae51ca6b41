"""Column functions on text: tokens, scores, truncation, line counts, identities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed pattern of an identifier or number.
IDENTIFIER = r"[A-Za-z_][A-Za-z0-9_]{2,}|[0-9]+"


def identifiers(c: Column) -> Column:
    """Identifiers and numbers in order, as written."""
    return F.regexp_extract_all(c, F.lit(IDENTIFIER), F.lit(0))


def terms(c: Column) -> Column:
    """Distinct lower-case identifiers in order of their first place."""
    return F.array_distinct(identifiers(F.lower(c)))


def occurrences(c: Column, needle: Column) -> Column:
    """How often needle occurs in c without overlap."""
    return (F.length(c) - F.length(F.replace(c, needle, F.lit("")))) / F.length(needle)


def lexical_score(query: str, text: Column) -> Column:
    """Share of the query's terms in text, and for each such term of over four letters .05 an occurrence, .25 at most; 1.5 at most."""
    import re

    wanted = sorted({t.lower() for t in re.findall(IDENTIFIER, query)})
    if not wanted:
        return F.lit(0.0)
    low = F.lower(text)

    def scored(x: Column) -> Column:
        score = F.size(x["found"]) / F.lit(float(len(wanted)))
        for t in wanted:
            if len(t) > 4:
                score = score + F.when(F.array_contains(x["found"], t), F.least(F.lit(0.25), 0.05 * occurrences(x["low"], F.lit(t)))).otherwise(0.0)
        return F.when(F.size(x["found"]) > 0, F.least(F.lit(1.5), score)).otherwise(0.0)

    # the terms are found once, however many of the parts below ask for them
    once = F.struct(F.array_intersect(F.array(*[F.lit(t) for t in wanted]), identifiers(low)).alias("found"), low.alias("low"))
    return F.get(F.transform(F.array(once), scored), F.lit(0))


def truncated(c: Column, n: int) -> Column:
    """c without outer space, cut to n characters of which the last is an ellipsis."""
    t = F.btrim(c)
    return F.when(F.length(t) > n, F.concat(F.rtrim(F.left(t, F.lit(n - 1))), F.lit("…"))).otherwise(t)


def line_of(c: Column, start: Column) -> Column:
    """1-based line of the character at 0-based start."""
    before = F.left(c, start.cast("int"))
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1


def stable_id(*parts: Column) -> Column:
    """First 20 hex digits of the SHA-1 of the parts joined by '::'; a null part reads None."""
    return F.left(F.sha1(F.concat_ws("::", *[F.coalesce(p.cast("string"), F.lit("None")) for p in parts])), F.lit(20))
