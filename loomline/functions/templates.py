"""Formatting options of string templates, as column expressions. Places are those of a DataFrame's values; options come as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")
#: Fixed date and time patterns by option value.
DATES = {"ISO": "yyyy-MM-dd", "RAW": "yyyyMMdd", "USER": "dd.MM.yyyy", "ENVIRONMENT": "dd.MM.yyyy"}
TIMES = {"ISO": "HH:mm:ss", "RAW": "HHmmss", "USER": "HH:mm:ss", "ENVIRONMENT": "HH:mm:ss"}
STAMPS = {"ISO": "yyyy-MM-dd'T'HH:mm:ss", "SPACE": "yyyy-MM-dd HH:mm:ss", "RAW": "yyyyMMddHHmmss", "USER": "dd.MM.yyyy HH:mm:ss", "ENVIRONMENT": "dd.MM.yyyy HH:mm:ss"}


def _numbers(value: Column, options: dict) -> Column:
    places = options.get("DECIMALS")
    text = value
    if places is not None or "NUMBER" in options:
        places = int(places or 2)
        grouped = F.format_number(value, places)
        text = grouped if options.get("NUMBER") in ("USER", "ENVIRONMENT") else F.replace(grouped, F.lit(","), F.lit(""))
    elif options.get("STYLE") in ("SCIENTIFIC", "ENGINEERING", "SCALE_PRESERVING_SCIENTIFIC"):
        text = F.format_string("%.6E", value.cast("double"))
    else:
        text = value.cast("string")
    if "EXPONENT" in options:
        text = F.format_string("%.6E", (value / F.pow(F.lit(10.0), F.lit(int(options["EXPONENT"])))).cast("double"))
    if options.get("STYLE") in ("SIMPLE",):
        text = F.regexp_replace(text, r"(\.\d*?)0+$", "$1")
        text = F.regexp_replace(text, r"\.$", "")
    sign = options.get("SIGN", "")
    bare = F.regexp_replace(text, "^-", "")
    minus = value < 0
    if sign.startswith("RIGHT"):
        text = F.concat(bare, F.when(minus, "-").otherwise("+" if sign == "RIGHTPLUS" else " " if sign == "RIGHTSPACE" else ""))
    elif sign in ("LEFTPLUS", "LEFTSPACE"):
        text = F.when(minus, text).otherwise(F.concat(F.lit("+" if sign == "LEFTPLUS" else " "), bare))
    if options.get("ZERO") == "NO":
        text = F.when(value == 0, F.lit("")).otherwise(text)
    return text


def rendered(value: Column, dtype: str, options: dict[str, str]) -> Column:
    """The value as text under the options; width and padding come last."""
    if "TIMEZONE" in options:
        value = F.from_utc_timestamp(value, options["TIMEZONE"])
    if "TIMESTAMP" in options or "TIMEZONE" in options:
        text = F.date_format(value, STAMPS[options.get("TIMESTAMP", "SPACE")])
    elif "DATE" in options:
        text = F.date_format(value, DATES[options["DATE"]])
    elif "TIME" in options:
        text = F.date_format(value, TIMES[options["TIME"]])
    elif dtype.split("(")[0] in NUMERIC and {"DECIMALS", "SIGN", "EXPONENT", "ZERO", "NUMBER", "STYLE", "CURRENCY"} & options.keys():
        text = _numbers(value, {"DECIMALS": "2"} | options if "CURRENCY" in options else options)
    else:
        text = value.cast("string")
    if options.get("ALPHA") == "OUT":
        text = F.regexp_replace(text, "^0+(?=.)", "")
    elif options.get("ALPHA") == "IN":
        width = int(options.get("WIDTH", 10))
        text = F.when(text.rlike("^[0-9]+$") & (F.length(text) < width), F.lpad(text, width, "0")).otherwise(text)
    if options.get("CASE") in ("UPPER", "LOWER"):
        text = F.upper(text) if options["CASE"] == "UPPER" else F.lower(text)
    if "WIDTH" in options:
        width, pad, align = int(options["WIDTH"]), options.get("PAD", " ") or " ", options.get("ALIGN", "LEFT")
        missing = F.greatest(F.lit(width) - F.length(text), F.lit(0))
        left = {"LEFT": F.lit(0), "RIGHT": missing, "CENTER": F.floor(missing / 2).cast("int")}[align]
        text = F.concat(F.repeat(F.lit(pad), left), text, F.repeat(F.lit(pad), missing - left))
    return text
