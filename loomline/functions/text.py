"""Text and URL functions as column expressions, and byte positions in texts.

Offsets count bytes of the UTF-8 text, as the token tables do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def path_unescape(c: Column | str) -> Column:
    """Strict %XX decoding; `+` stays; a bad escape gives null (an error row for the caller to report)."""
    return F.try_url_decode(F.replace(_col(c), F.lit("+"), F.lit("%2B")))


def query_unescape(c: Column | str) -> Column:
    """Strict decoding of a query component: `+` is a space."""
    return F.try_url_decode(_col(c))


def url_decode(c: Column | str) -> Column:
    """Lenient decoding: a bad escape is copied through."""
    safe = F.regexp_replace(_col(c), "%(?![0-9A-Fa-f]{2})", "%25")
    return F.url_decode(F.replace(safe, F.lit("+"), F.lit("%2B")))


def query_escape(c: Column | str) -> Column:
    """Upper-hex escaping of a query component; a space becomes `+`."""
    out = F.replace(F.url_encode(_col(c)), F.lit("%7E"), F.lit("~"))
    return F.replace(out, F.lit("*"), F.lit("%2A"))


def component_escape(c: Column | str) -> Column:
    """Everything but letters, digits and - _ . ~ is escaped."""
    return F.replace(query_escape(c), F.lit("+"), F.lit("%20"))


#: What stays as it is in each part of a URL, besides letters, digits and - _ . ~ (RFC 3986).
KEPT = {
    "path": "$&+,/:;=@",
    "segment": "$&+=:@",
    "host": "!$&'()*+,;=:[]<>\"",
    "zone": "!$&'()*+,;=:[]<>\"",
    "user": "$&+,;=",
    "query": "",
    "fragment": "$&+,/:;=?@!()*",
}


def escape(c: Column | str, part: str) -> Column:
    """Upper-hex escaping for one part of a URL (a key of KEPT). Only `query` writes a space as `+`."""
    if part == "query":
        return query_escape(c)
    out = component_escape(c)
    for ch in KEPT[part]:  # a percent sign in the text is %25 by now, so each code stands for its character only
        out = F.replace(out, F.lit(f"%{ord(ch):02X}"), F.lit(ch))
    return out


def unescape(c: Column | str, part: str) -> Column:
    """Strict decoding of one part of a URL; null for a bad escape.

    A host takes escapes of bytes from 128 on and %25 only; a zone those of a space, of %25 and of what may stand in it
    unescaped. Both give null for other ASCII characters that should have been escaped.
    """
    if part not in KEPT:
        raise ValueError(f"no part of a URL: {part}")
    if part == "query":
        return query_unescape(c)
    out = path_unescape(c)
    if part in ("host", "zone"):
        plain = r"A-Za-z0-9\-_.~" + "".join("\\" + ch for ch in KEPT[part])
        codes = "[89A-Fa-f][0-9A-Fa-f]|25"
        if part == "zone":
            codes = "25|20|2[DE]|3[0-9]|4[1-9A-F]|5[0-9AF]|6[1-9A-F]|7[0-9AE]|" + "|".join(f"{ord(ch):02X}" for ch in KEPT[part])
        out = F.when(_col(c).rlike(rf"\A(?:[{plain}]|[^\x00-\x7F]|%(?i:{codes}))*\z"), out)
    return out


def segment_escape(c: Column | str) -> Column:
    """A path segment: $ & + = : @ stay as they are."""
    return escape(c, "segment")


def path_encode(c: Column | str) -> Column:
    """A whole path: as a component, but slashes stay."""
    return F.replace(component_escape(c), F.lit("%2F"), F.lit("/"))


def uri_to_path(c: Column | str) -> Column:
    return url_decode(F.regexp_replace(_col(c), "^file:///", ""))


def path_to_uri(c: Column | str) -> Column:
    return F.concat(F.lit("file:///"), path_encode(F.replace(_col(c), F.lit("\\"), F.lit("/"))))


def folder_of(c: Column | str) -> Column:
    """What stands before the last slash; empty without one."""
    return F.regexp_extract(_col(c), r"(?s)^(.*)/[^/]*$", 1)


def filename_of(c: Column | str) -> Column:
    """The last part, without the source suffix, lower-cased."""
    return F.lower(F.regexp_replace(F.substring_index(_col(c), "/", -1), r"(?i)\.abap$", ""))


def hex_value(c: Column | str) -> Column:
    """Value of one hexadecimal digit; null for anything else."""
    return F.when(_col(c).rlike("^[0-9A-Fa-f]$"), F.conv(_col(c), 16, 10).cast("int"))


def hex_digit(c: Column | str) -> Column:
    """The upper-case hexadecimal digit of 0 to 15; null for anything else."""
    return F.when(_col(c).between(0, 15), F.hex(_col(c)))


def condense(c: Column | str, no_gaps: bool = False) -> Column:
    """Outer spaces go and inner runs become one space, or none with no_gaps."""
    return F.replace(_col(c), F.lit(" "), F.lit("")) if no_gaps else F.trim(F.regexp_replace(_col(c), " +", " "))


def line_starts(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, line (from 0), start, bytes: where each line of each text begins and how long it is."""
    lines = texts.select(key, F.posexplode(F.split(F.col(text), "\n", -1)).alias("line", "body"))
    size = F.octet_length("body").cast("long")
    before = Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(size + 1).over(before), F.lit(0))
    return lines.select(key, F.col("line").cast("int").alias("line"), start.cast("long").alias("start"), size.alias("bytes"))


def position_to_offset(text: Column, line: Column, column: Column) -> Column:
    """Byte offset of a line and byte column; -1 if there is no such line, cut at the line's end."""
    lines = F.split(text, "\n", -1)
    sizes = F.transform(F.slice(lines, F.lit(1), line), lambda x: F.octet_length(x) + 1)
    start = F.aggregate(sizes, F.lit(0), lambda a, x: a + x)
    inside = F.least(column, F.octet_length(F.element_at(lines, line + 1)))
    return F.when((line < 0) | (line >= F.size(lines)), F.lit(-1)).otherwise(start + inside).cast("long")


def offset_to_position(text: Column, offset: Column) -> tuple[Column, Column]:
    """Line and byte column of a byte offset, cut to the text's bytes."""
    raw = F.encode(text, "UTF-8")
    head = F.substring(raw, F.lit(1), F.least(F.greatest(offset, F.lit(0)), F.octet_length(raw)).cast("int"))
    # Latin-1 maps every byte to one character, so places in it are bytes.
    plain = F.decode(head, "ISO-8859-1")
    lines = F.split(plain, "\n", -1)
    return (F.size(lines) - 1).cast("int"), F.length(F.element_at(lines, -1)).cast("int")


def range_to_positions(text: Column, start: Column, end: Column) -> Column:
    """Line and byte column of both ends of a byte range, as a struct of start and end."""
    ends = (F.struct(line.alias("line"), col.alias("character")) for line, col in (offset_to_position(text, start), offset_to_position(text, end)))
    return F.struct(*(x.alias(name) for name, x in zip(("start", "end"), ends)))
