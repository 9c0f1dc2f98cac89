"""NMEA and OBD-II values, and the time formats of logs, as column expressions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from geotrail.functions.geo import col

#: Formulas by PID (fixed values): v is the first byte, w the first two.
FORMULAS = {
    "w / 4": ("0C", "32"),
    "v * 3": ("0A",),
    "v - 40": ("05", "0F", "46", "5C"),
    "v * 100 / 255": ("11", "2C", "2E", "2F", "45", "47", "48", "49", "4A", "4B", "4C", "04", "43", "52", "5B"),
    "w / 100": ("10",),
    "v / 2 - 64": ("0E",),
    "w": ("31", "21", "4D", "4E", "1F", "59", "63"),
    "w / 1000": ("42",),
    "w / 20": ("5E",),
    "v - 125": ("61", "62"),
    "(v - 128) * 100 / 128": ("06", "07", "08", "09", "2D"),
    "(w - 26880) / 128": ("5D",),
    "w / 10 - 40": ("3C", "3D", "3E", "3F"),
    "w * 200 / 65536": ("44",),
}


def obd_numbers(data) -> Column:
    """struct<v, w>: the first byte and the first two of data in hex; 0 where it isn't hex."""
    number = lambda text, digits: F.coalesce(F.conv(F.nullif(F.regexp_extract(text, rf"^([0-9A-Fa-f]{{{digits}}})", 1), F.lit("")), 16, 10).try_cast("long"), F.lit(0).cast("long"))
    return F.struct(number(col(data), "2").alias("v"), number(F.replace(col(data), F.lit(" "), F.lit("")), "1,4").alias("w"))


def obd_reading(pid, v, w) -> Column:
    """An integer reading from a PID (int) and the numbers of its data; divisions go towards zero."""
    values = {"v": col(v), "w": col(w)}
    out = values["v"]
    for formula, pids in FORMULAS.items():
        out = F.when(col(pid).isin(*(int(p, 16) for p in pids)), _formula(formula, values)).otherwise(out)
    return out.cast("int")


def obd_value(pid, data) -> Column:
    """``obd_reading`` of data in hex."""
    n = obd_numbers(data)
    return obd_reading(pid, n["v"], n["w"])


def _formula(text: str, values: dict[str, Column]) -> Column:
    """A formula of one value, whole numbers and + - * /, from left to right; brackets only around the first step."""
    words = text.replace("(", "").replace(")", "").split()
    out = values[words[0]]
    for sign, n in zip(words[1::2], words[2::2], strict=True):
        n = int(n)
        if sign == "/":
            out = _towards_zero(out, n)
        else:
            out = out * n if sign == "*" else out + n if sign == "+" else out - n
    return out


def _towards_zero(c: Column, n: int) -> Column:
    return F.when(c < 0, -F.floor(-c / n)).otherwise(F.floor(c / n)).cast("long")


@F.arrow_udf(IntegerType())
def _xor(body: pa.Array) -> pa.Array:
    """XOR of each text's bytes, over a batch's bytes at once; null for null."""
    raw = body.cast(pa.large_binary())
    begin = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)[begin[0] : begin[-1]]
    full = np.flatnonzero(np.diff(begin))
    out = np.zeros(len(raw), np.int32)
    if len(full):
        out[full] = np.bitwise_xor.reduceat(data, begin[full] - begin[0])
    return pa.array(out, mask=raw.is_null().to_numpy(zero_copy_only=False))


def nmea_checksum(body) -> Column:
    """XOR of a sentence's bytes in UTF-8, as an int."""
    return _xor(col(body))


def nmea_parts(raw) -> Column:
    """struct<body, sent>: what a whole line ``$...*HH`` says, and its checksum in hex; empty for other lines."""
    part = lambda k: F.regexp_extract(col(raw), r"^\$([^*$]+)\*([0-9A-Fa-f]{2})\s*$", k)
    return F.struct(part(1).alias("body"), part(2).alias("sent"))


def nmea_valid(raw) -> Column:
    """Whether a line is a whole sentence with the right checksum."""
    told = nmea_parts(raw)
    return (told["sent"] != "") & (nmea_checksum(told["body"]) == F.conv(told["sent"], 16, 10).try_cast("int"))


def nmea_degrees(value, hemisphere) -> Column:
    """``ddmm.mmmm`` or ``dddmm.mmmm`` with N, S, E or W as signed degrees; null when it isn't a number."""
    n = col(value).try_cast("double")
    whole = F.floor(n / 100)
    sign = F.when(col(hemisphere).isin("S", "W"), -1.0).when(col(hemisphere).isin("N", "E"), 1.0)
    return sign * (whole + (n - whole * 100) / 60)


def nmea_time(date, time) -> Column:
    """``ddmmyy`` and ``hhmmss.s`` as a UTC timestamp; null when they are malformed."""
    d, t = col(date), col(time)
    text = F.concat(F.lit("20"), d.substr(5, 2), F.lit("-"), d.substr(3, 2), F.lit("-"), d.substr(1, 2), F.lit(" "), t.substr(1, 2), F.lit(":"), t.substr(3, 2), F.lit(":"), t.substr(5, 20))
    fine = d.rlike(r"^\d{6}$") & t.rlike(r"^\d{6}(\.\d+)?$")
    return F.when(fine, F.concat(text, F.lit(" UTC")).try_cast("timestamp"))


def time_formats(ts) -> Column:
    """struct of the five forms that logs and tables use."""
    t = col(ts)
    form = lambda p, name: F.date_format(t, p).alias(name)
    packed = F.date_format(t, "yyyyMMddHHmmssSSS").cast("long").alias("packed")
    return F.struct(form("yyyyMMdd", "day"), form("yyyy-MM-dd", "date"), form("yyyy-MM-dd HH:mm:ss", "seconds"), form("yyyy-MM-dd-HH-mm-ss-SSS", "log"), packed)


def log_time(text) -> Column:
    """A timestamp from ``yyyy-MM-dd-HH-mm-ss-SSS``; null when malformed."""
    return F.try_to_timestamp(col(text), F.lit("yyyy-MM-dd-HH-mm-ss-SSS"))
