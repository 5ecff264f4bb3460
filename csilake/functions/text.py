"""Byte decoding, trimming, quoting, labels and entity text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters the desktop trim removes (Unicode white space plus U+001C..U+001F).
DESKTOP_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# The mobile trim removes every character up to and including the blank.
MOBILE_SPACE = "".join(map(chr, range(0x21)))

REPLACEMENT = "\ufffd"
_ESCAPE = "\U0010ffff"


def trim_line(col: Column, profile: str) -> Column:
    return F.btrim(col, F.lit(DESKTOP_SPACE if profile == "desktop" else MOBILE_SPACE))


def decode_bytes(col: Column, profile: str) -> Column:
    """Bytes to text. Desktop drops undecodable bytes, mobile substitutes U+FFFD for them."""
    text = col.cast("string")
    if profile != "desktop":
        return F.make_valid_utf8(text)
    # A U+FFFD that was really sent must survive the removal of substituted ones, so it is
    # escaped first; the escape character itself is escaped too.
    marked = F.replace(F.replace(text, F.lit(_ESCAPE), F.lit(_ESCAPE + "0")), F.lit(REPLACEMENT), F.lit(_ESCAPE + "1"))
    kept = F.replace(F.make_valid_utf8(marked), F.lit(REPLACEMENT), F.lit(""))
    plain = F.replace(F.replace(kept, F.lit(_ESCAPE + "1"), F.lit(REPLACEMENT)), F.lit(_ESCAPE + "0"), F.lit(_ESCAPE))
    return F.when(F.is_valid_utf8(text), text).otherwise(plain)


def decode_line(col: Column, profile: str) -> Column:
    return trim_line(decode_bytes(col, profile), profile)


def strip_quotes(col: Column) -> Column:
    return F.btrim(col, F.lit('"'))


def remove_quotes(col: Column) -> Column:
    return F.replace(col, F.lit('"'), F.lit(""))


def clean_field(col: Column) -> Column:
    """Strict profile, per field: trim, then remove every quote."""
    return remove_quotes(F.btrim(col, F.lit(MOBILE_SPACE)))


def second_part(col: Column) -> Column:
    """Element 1 of an unlimited comma split."""
    return F.split_part(col, F.lit(","), F.lit(2))


def after_first_dash(col: Column) -> Column:
    return F.trim(F.substring(col, F.instr(col, "-") + 1, F.length(col)))


def mac_text(octets: Column) -> Column:
    """Array of byte values to colon-separated lower-case hex."""
    return F.array_join(F.transform(octets, lambda b: F.lpad(F.lower(F.hex(b)), 2, "0")), ":")


def channel_text(channel: Column, secondary: Column) -> Column:
    return F.format_string("%d (%d)", channel, secondary)


# The two status options, by index.
STATUS_OPTIONS = ("0 - Inativo", "1 - Ativo")


def status_label(status: Column) -> Column:
    """0 selects the first option; every other value, null included, selects the second."""
    option = F.when(status == 0, F.lit(STATUS_OPTIONS[0])).otherwise(F.lit(STATUS_OPTIONS[1]))
    return after_first_dash(option)


def is_blank(col: Column) -> Column:
    return F.coalesce(F.btrim(col, F.lit(MOBILE_SPACE)), F.lit("")) == ""


def scenario_or_default(col: Column) -> Column:
    return F.coalesce(F.nullif(col, F.lit("")), F.lit("N/A"))


# The text formats of users, rooms and points.


def user_text(user_id: Column, nome: Column, apelido: Column, status: Column) -> Column:
    return F.format_string("ID: %d, Nome: %s, Apelido: %s, Status: %d", user_id, nome, apelido, status)


def room_text(room_id: Column, descricao: Column, largura: Column, comprimento: Column, status: Column) -> Column:
    return F.format_string(
        "ID: %d, Descrição: %s, Largura: %s, Comprimento: %s, Status: %d",
        room_id, descricao, largura.cast("string"), comprimento.cast("string"), status,
    )


def point_text(point_id: Column, room_id: Column, numero: Column, x: Column, y: Column, status: Column) -> Column:
    return F.format_string(
        "ID: %d, Ambiente ID: %d, Número: %d, Posição X: %s, Posição Y: %s, Status: %d",
        point_id, room_id, numero, x.cast("string"), y.cast("string"), status,
    )


def iso_text(ts: Column) -> Column:
    """Desktop session stamp: microseconds only when there are any."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(F.date_format(ts, "SSSSSS") == "000000", whole).otherwise(
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    )


def second_text(ts: Column) -> Column:
    """Mobile session stamp, cut to seconds."""
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def read_stamp(col: Column) -> Column:
    """Either stored stamp back to a zone-free timestamp."""
    return col.try_cast("timestamp_ntz")
