"""Records: declared projections, merging of JSON payloads, and checks that set bad rows aside."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

# ---- declared projections ----------------------------------------------------------------------


@dataclass(frozen=True)
class Field:
    """One field of a payload.

    source: a column, or a path into nested ones (`run.id`); the field's own name if None.
    kind: the Spark type it is cast to; as it is if None. Values that do not fit become null.
    default: what stands for null. digits: rounding. time: as ISO text in UTC to the second.
    fields: nested fields, of a struct or of each item of an array; an array's items keep their order.
    most: first items of an array that are kept. whole: the source is the record itself, whose columns the nested fields take.
    """

    name: str
    source: str | None = None
    kind: str | None = None
    default: object = None
    digits: int | None = None
    time: bool = False
    fields: tuple[Field, ...] = ()
    most: int | None = None
    whole: bool = False


def _kind(kind: DataType, path: str) -> DataType | None:
    """The type at a path of nested fields; None if there is none."""
    for name in path.split("."):
        kind = next((f.dataType for f in kind.fields if f.name == name), None) if isinstance(kind, StructType) else None
    return kind


def _value(f: Field, base: Column | None, kind: DataType) -> Column:
    """f's value from base (a struct of type kind), or from a row's columns if base is None."""
    if f.whole:
        return F.struct(*[_value(x, base, kind).alias(x.name) for x in f.fields])
    path = f.source or f.name
    at = _kind(kind, path)
    c = F.col(path) if base is None else reduce(lambda x, name: x[name], path.split("."), base)
    if f.most is not None:
        c = F.slice(c, 1, f.most)
    if f.fields and isinstance(at, ArrayType):
        return F.coalesce(F.transform(c, lambda x: F.struct(*[_value(g, x, at.elementType).alias(g.name) for g in f.fields])), F.array())
    if f.fields:
        return F.when(c.isNotNull(), F.struct(*[_value(g, c, at).alias(g.name) for g in f.fields]))
    if f.time:
        c = F.date_format(c.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss")
    if f.kind:
        c = c.try_cast(f.kind)
    if f.digits is not None:
        c = F.round(c, f.digits)
    return c if f.default is None else F.coalesce(c, F.lit(f.default))


@dataclass(frozen=True)
class Shape:
    """A payload as a list of fields; compiled into one projection, so that a scan reads what it names and no more."""

    fields: tuple[Field, ...]

    def _columns(self, df: DataFrame) -> list[Column]:
        return [_value(f, None, df.schema).alias(f.name) for f in self.fields]

    def of(self, df: DataFrame) -> DataFrame:
        """The payload's fields as columns, a row each."""
        return df.select(*self._columns(df))

    def json(self, df: DataFrame, keys: list[str]) -> DataFrame:
        """Rows (keys, payload): the payload as JSON text, null fields included."""
        return df.select(*keys, F.to_json(F.struct(*self._columns(df)), {"ignoreNullFields": "false"}).alias("payload"))


# ---- merging of payloads -----------------------------------------------------------------------


#: Levels of nested objects that a merge follows at most; deeper payloads are an error.
DEEPEST = 64


def _depth(text: Column) -> Column:
    """How deep objects nest in a JSON text; what stands in strings does not count."""
    braces = F.regexp_replace(F.regexp_replace(text, r'"(?:\\.|[^"\\])*"', ""), r"[^{}]", "")
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("most"))

    def step(acc: Column, c: Column) -> Column:
        at = acc["at"] + F.when(c == "{", 1).when(c == "}", -1).otherwise(0)
        return F.struct(at.alias("at"), F.greatest(acc["most"], at).alias("most"))

    return F.aggregate(F.split(braces, ""), start, step, lambda acc: acc["most"])


def deep_merged(df: DataFrame, stored: str, live: str, out: str) -> DataFrame:
    """df with the JSON text `out`: the payload in `live` merged over that in `stored`.

    Where both hold an object under a path, its keys are merged; else what live holds there stands,
    a null too. Arrays are values. Keys that live lacks stay. A null or broken text is no payload: the
    other stands alone, and null if both are. Keys come out in order. Both are parsed to VARIANT;
    one aggregate finds how deep objects nest in live, and the merge is one expression of that depth, without a shuffle.
    """
    deepest = df.agg(F.max(_depth(F.col(live))).alias("d")).first()["d"] or 0
    if deepest > DEEPEST:
        raise ValueError(f"{live} nests objects {deepest} deep, over {DEEPEST}")
    as_map = lambda c: F.try_variant_get(c, "$", "map<string,variant>")

    def merged(x: Column, y: Column, levels: int) -> Column:
        if not levels:
            return F.coalesce(y, x)
        objects = F.map_zip_with(as_map(x), as_map(y), lambda k, p, q: merged(p, q, levels - 1))
        return F.coalesce(F.to_variant_object(objects), y, x)  # null unless both are objects

    v = df.withColumns({"_stored": F.try_parse_json(stored), "_live": F.try_parse_json(live)})
    return v.withColumn(out, F.to_json(merged(F.col("_stored"), F.col("_live"), deepest))).drop("_stored", "_live")


# ---- checks ------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Check:
    """A rule of a column: its code, and what is wrong, null where nothing is. value: what the good rows hold."""

    column: str
    code: str
    wrong: Column
    value: Column | None = None


def cast_check(column: str, kind: str, required: bool = True) -> Check:
    """A text that must read as kind; null is wrong if required."""
    c = F.col(column)
    got = c.try_cast(kind)
    wrong = F.when(c.isNotNull() & got.isNull(), F.concat(F.lit(f"not a {kind}: "), F.left(c.cast("string"), F.lit(60))))
    return Check(column, "bad_type", F.coalesce(wrong, F.when(c.isNull(), "missing")) if required else wrong, got)


def range_check(column: str, low: object, high: object, kind: str = "double") -> Check:
    """A number within bounds; what does not read as one is left to its cast_check."""
    got = F.col(column).try_cast(kind)
    return Check(column, "out_of_range", F.when(~got.between(low, high), F.concat(got.cast("string"), F.lit(f" is outside {low} to {high}"))))


def checked(df: DataFrame, checks: list[Check]) -> DataFrame:
    """df with `problems`: array of (column, code, detail) in order of the checks, empty for a good row."""
    each = F.array(*[F.when(c.wrong.isNotNull(), F.struct(F.lit(c.column).alias("column"), F.lit(c.code).alias("code"), c.wrong.alias("detail"))) for c in checks])
    return df.withColumn("problems", F.array_compact(each))


def parted(df: DataFrame, checks: list[Check]) -> tuple[DataFrame, DataFrame]:
    """The good rows with their columns as the checks give them, and the quarantine: all columns as they came, and `problems`.

    Every row is in exactly one of them. Write df first if it is costly: both read it.
    """
    rows = checked(df, checks)
    values = {c.column: c.value for c in checks if c.value is not None}
    good = rows.where(F.size("problems") == 0).select(*[values.get(c, F.col(c)).alias(c) for c in df.columns])
    return good, rows.where(F.size("problems") > 0)
