"""File types, capture dates and metadata summaries as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Leading bytes (hex, 1-based offset) and the extension they mean, tested in this order.
SIGNATURES = [
    ("mp4", [(5, "66747970")]),
    ("jpg", [(1, "FFD8FF")]),
    ("png", [(1, "89504E47")]),
    ("gif", [(1, "47494638")]),
    ("webp", [(1, "52494646"), (9, "57454250")]),
    ("tiff", [(1, "49492A00")]),
    ("tiff", [(1, "4D4D002A")]),
    ("bmp", [(1, "424D")]),
]
UNKNOWN_TYPE = "xxx"

# Fixed value: an XMP date-time with a zone.
XMP_DATE = r"\b\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:Z|[+\-]\d{2}:\d{2})\b"


def _has_bytes(content: Column, marks: list[tuple[int, str]]) -> Column:
    test = F.lit(True)
    for start, expected in marks:
        test = test & (F.hex(F.substring(content, start, len(expected) // 2)) == expected)
    return F.coalesce(test, F.lit(False))


def is_video(content: Column) -> Column:
    """Bytes 4-7 are ``ftyp``; NULL or short content is not a video."""
    return _has_bytes(content, SIGNATURES[0][1])


def file_type(content: Column) -> Column:
    kind = F.lit(UNKNOWN_TYPE)
    for ext, marks in reversed(SIGNATURES):
        kind = F.when(_has_bytes(content, marks), F.lit(ext)).otherwise(kind)
    return kind


def _ntz(text: Column) -> Column:
    return text.try_cast("timestamp_ntz")


def _reshape(text: Column, pattern: str, written: str) -> Column:
    """Rewrite ``text`` to an ISO date-time when it has exactly this shape, else NULL."""
    return F.when(text.rlike(pattern), F.regexp_replace(text, pattern, written))


def exif_date(digitized: Column, original: Column, modified: Column) -> Column:
    """First parsable of the three tags, ``yyyy:MM:dd HH:mm:ss``."""
    shape = r"^(\d{4}):(\d{2}):(\d{2}) (\d{2}:\d{2}:\d{2})$"
    return F.coalesce(*[_ntz(_reshape(tag, shape, "$1-$2-$3 $4")) for tag in (digitized, original, modified)])


def iptc_date(date: Column, time: Column) -> Column:
    """``yyyyMMdd`` and ``HHmmss+zz:zz``.  A time that does not parse voids the date; no time means midnight.

    The written wall clock is kept; the zone is only checked for its form.
    """
    day = _reshape(date, r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")
    clock = _reshape(time, r"^(\d{2})(\d{2})(\d{2})[+-]\d{2}:?\d{2}$", "$1:$2:$3")
    return F.when(time.isNull(), _ntz(day)).otherwise(_ntz(F.concat(day, F.lit(" "), clock)))


def xmp_date(packet: Column) -> Column:
    """First valid date-time with a zone in the packet; the zone is dropped."""
    found = F.regexp_extract_all(packet, F.lit(XMP_DATE), F.lit(0))
    in_range = F.filter(found, lambda m: m.endswith("Z") | (F.substring(m, -5, 5) <= "14:00"))
    dates = F.filter(F.transform(in_range, lambda m: _ntz(F.substring(m, 1, 19))), lambda d: d.isNotNull())
    return F.get(dates, F.lit(0))


def capture_date(meta: dict[str, Column]) -> Column:
    """Earliest of the IPTC, EXIF and XMP dates; least() skips NULLs."""
    return F.least(
        iptc_date(meta["iptc_date"], meta["iptc_time"]),
        exif_date(meta["exif_digitized"], meta["exif_original"], meta["exif_datetime"]),
        xmp_date(meta["xmp"]),
    )


def meta_summary(exif: Column, iptc: Column, icc: Column, xmp_bytes: Column) -> Column:
    """"E:12 P:3 C:9 X:2048", only the parts that exist, at most 30 characters."""
    parts = [("E", exif), ("P", iptc), ("C", icc), ("X", xmp_bytes)]
    shown = [F.when(n.isNotNull(), F.concat(F.lit(f"{tag}:"), n.cast("string"))) for tag, n in parts]
    return F.substring(F.concat_ws(" ", *shown), 1, 30)


def model_size(width: Column, height: Column, short_side: int = 384) -> Column:
    """Scaled and cropped model input: short side to ``short_side``, sides cut to a multiple of 16, at most 1024."""
    scale = (F.lit(short_side) / F.least(width, height)).cast("float")

    def scaled(side: Column) -> Column:
        return F.bround((side.cast("float") * scale).cast("double")).cast("int")

    def cropped(side: Column) -> Column:
        return F.least(F.lit(1024), (scaled(side) - scaled(side) % 16).cast("int"))

    return F.struct(scaled(width).alias("scaled_w"), scaled(height).alias("scaled_h"),
                    cropped(width).alias("crop_w"), cropped(height).alias("crop_h"))
