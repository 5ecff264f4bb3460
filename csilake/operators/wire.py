"""The wire record: render columns to lines, and parse lines under one of two policies.

``strict`` (mobile): every field is trimmed, quotes are removed, and one bad number rejects the row.
``lenient`` (desktop): fields are bound as they came, column affinity converts them, and a bad number
leaves a null and its name in ``bad_fields``; the row is kept, with the line in ``raw``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from csilake.functions import numbers, payload, text
from csilake.schema import PACKET_TAG, WIRE_FIELDS, WIRE_NAMES

N_FIELDS = len(WIRE_FIELDS)
REJECT_REASONS = ("prefix", "field_count", "bad_number")


def render_line(fields: dict[str, Column], data_text: Column | None) -> Column:
    """One line from columns named as on the wire; without ``data_text`` the field is left out."""
    head = [fields[name].cast("string") for name in WIRE_NAMES[:-1]]
    if data_text is None:
        return F.concat_ws(",", *head)
    return F.concat_ws(",", *head, F.concat(F.lit('"'), data_text, F.lit('"')))


def has_prefix(line: Column) -> Column:
    """Prefix test, not equality: a longer tag passes too."""
    return line.startswith(PACKET_TAG)


def split_fields(line: Column) -> Column:
    """At most 25 parts: the last field holds commas of its own."""
    return F.split(line, ",", N_FIELDS)


def _plain_pattern() -> str:
    """Matches lines as the producer writes them: bare numbers that no type can overflow.

    Nearly every line is plain. Its numbers need no trimming, quote removal or per-field checks, so
    one pass of this pattern replaces about seventy small string operations per line.
    """
    shapes = {
        "string": "[0-9A-Za-z:]*",
        "int": "[+-]?[0-9]{1,9}",
        "bigint": "[+-]?[0-9]{1,18}",
        "float": r"[+-]?[0-9]{1,9}(?:\.[0-9]{1,9})?",
    }
    head = [shapes[kind] for _, kind in WIRE_FIELDS[1:-1]]
    return f"^{PACKET_TAG}[^,]*," + ",".join(head) + ","


PLAIN_LINE = _plain_pattern()


def _number_text(part: Column, index: Column, profile: str) -> Column:
    """Canonical text of a numeric field, or null where the profile reads no number in range."""
    strict = profile == "strict"
    source = text.clean_field(part) if strict else part
    as_int = numbers.strict_int if strict else numbers.lenient_int
    as_float = numbers.strict_float if strict else numbers.lenient_float
    return (
        F.when(index.isin(*_positions("float")), as_float(source).cast("string"))
        .when(index.isin(*_positions("bigint")), as_int(source, "bigint").cast("string"))
        .otherwise(as_int(source, "int").cast("string"))
    )


def _positions(*kinds: str) -> list[int]:
    return [i for i, (_, kind) in enumerate(WIRE_FIELDS) if kind in kinds]


_NUMERIC = _positions("int", "bigint", "float")


def classify_lines(lines: DataFrame, profile: str = "strict", value: str = "value") -> DataFrame:
    """All lines with typed fields, ``payload``, ``bad_fields``, ``raw`` and ``reject_reason``.

    Columns of the input other than ``value`` are carried along. Null lines are dropped.
    """
    if profile not in ("strict", "lenient"):
        raise ValueError(f"unknown profile {profile!r}")
    carried = [F.col(c) for c in lines.columns if c != value]
    raw, parts = F.col("raw"), F.col("_parts")
    plain = raw.rlike(PLAIN_LINE)

    # One array expression per rule, not one per field: 22 copies of the slow rules would make
    # generated methods too large for the JIT.
    indexes = F.array(*[F.lit(i) for i in _NUMERIC])
    bad_indexes = F.filter(indexes, lambda i: _number_text(F.get(parts, i), i, profile).isNull())
    names = F.array(*[F.lit(name) for name in WIRE_NAMES])
    reason = F.when(~has_prefix(raw), "prefix").when(F.size(parts) != N_FIELDS, "field_count")
    if profile == "strict":
        reason = reason.when(F.size(bad_indexes) > 0, "bad_number")
    as_written = _checked(parts, F.array().cast("array<string>"), F.lit(None).cast("string"))
    repaired = _checked(
        F.transform(parts, lambda p, i: _canonical(p, i, profile)),
        F.transform(bad_indexes, lambda i: F.get(names, i)),
        reason,
    )

    split = lines.where(F.col(value).isNotNull()).select(
        *carried, F.col(value).alias("raw"), split_fields(F.col(value)).alias("_parts")
    )
    # Exploding the one checked line makes it a computed value for everything above. Without that,
    # Catalyst would copy the whole check into each filter and field that uses its outcome.
    checked = split.select(
        *carried, "raw", F.explode(F.array(F.when(plain, as_written).otherwise(repaired))).alias("_line")
    )
    fields = F.col("_line.fields")
    typed = checked.select(
        *carried,
        *_typed(fields, profile),
        F.col("_line.bad_fields").alias("bad_fields"),
        "raw",
        F.col("_line.reject_reason").alias("reject_reason"),
    )
    return typed.select(
        *carried,
        *WIRE_NAMES,
        payload.payload_array(F.col("data")).alias("payload"),
        "bad_fields",
        "raw",
        "reject_reason",
    )


def _checked(fields: Column, bad_fields: Column, reason: Column) -> Column:
    return F.struct(fields.alias("fields"), bad_fields.alias("bad_fields"), reason.alias("reject_reason"))


def _canonical(part: Column, index: Column, profile: str) -> Column:
    """Slow path, one field: numbers to canonical text, strings cleaned as the profile does."""
    string = part
    if profile == "strict":
        string = F.when(index == N_FIELDS - 1, part).otherwise(text.clean_field(part))
    return F.when(index.isin(*_NUMERIC), _number_text(part, index, profile)).otherwise(string)


def _data(field: Column, profile: str) -> Column:
    """The last field without its quotes. Its usual form needs no search for blanks at the ends."""
    usual = field.startswith('"[') & field.endswith(']"')
    inner = F.substring(field, F.lit(2), F.length(field) - 2)
    if profile == "strict":
        return F.when(usual, text.remove_quotes(inner)).otherwise(text.clean_field(field))
    return F.when(usual, inner).otherwise(text.strip_quotes(field))


def data_of(raw: Column, profile: str) -> Column:
    """``data`` of a line with all its fields, as ``classify_lines`` gives it."""
    return _data(F.get(split_fields(raw), F.lit(N_FIELDS - 1)), profile)


def _typed(fields: Column, profile: str) -> list[Column]:
    columns = []
    for index, (name, kind) in enumerate(WIRE_FIELDS):
        field = F.get(fields, F.lit(index))
        if name == "type" and profile == "strict":
            column = F.lit(PACKET_TAG)
        elif name == "data":
            column = _data(field, profile)
        else:
            column = field if kind == "string" else field.try_cast(kind)
        columns.append(column.alias(name))
    return columns


def with_stored_text(rows: DataFrame) -> DataFrame:
    """Lenient rows with VARIANT columns: a number where the field is one, else its text as it came.

    That is what a column with an affinity stores: the row keeps all it was sent, and typed readers take the numbers.
    """
    parts = F.when(F.size("bad_fields") > 0, split_fields(F.col("raw")))

    def kept(index: int, name: str) -> Column:
        return F.when(F.array_contains("bad_fields", name), F.get(parts, F.lit(index)).cast("variant")).otherwise(F.col(name).cast("variant")).alias(name)

    numeric = set(_NUMERIC)
    fields = [kept(i, name) if i in numeric else F.col(name) for i, name in enumerate(WIRE_NAMES)]
    return rows.select(*(c for c in rows.columns if c not in WIRE_NAMES), *fields)


def accepted(classified: DataFrame) -> DataFrame:
    return classified.where(F.col("reject_reason").isNull()).drop("reject_reason")


def rejected(classified: DataFrame, carried: list[str]) -> DataFrame:
    return classified.where(F.col("reject_reason").isNotNull()).select(
        *carried, F.col("raw"), F.col("reject_reason").alias("reason")
    )


def parse_lines(lines: DataFrame, profile: str = "strict", value: str = "value") -> tuple[DataFrame, DataFrame]:
    """(rows, rejects)."""
    carried = [c for c in lines.columns if c != value]
    classified = classify_lines(lines, profile, value)
    return accepted(classified), rejected(classified, carried)


def reject_reasons(classified: DataFrame) -> DataFrame:
    return (
        classified.where(F.col("reject_reason").isNotNull())
        .groupBy(F.col("reject_reason").alias("reason"))
        .agg(F.count("*").alias("n"))
    )


def accept_counts(classified: DataFrame, *keys: str) -> DataFrame:
    """How many of all lines were kept."""
    return classified.groupBy(*keys).agg(
        F.count_if(F.col("reject_reason").isNull()).alias("accepted"), F.count("*").alias("total")
    )
