"""Display texts and names."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def age_text(seconds: Column) -> Column:
    """"3 days", "1 hour", "12 seconds": the largest unit that fits, singular below two of it."""
    secs = seconds.cast("double")
    # Unit names and their length in seconds, largest first.
    units = [("day", 86400.0), ("hour", 3600.0), ("minute", 60.0)]
    text = F.format_string("%.0f seconds", secs)
    for name, length in reversed(units):
        amount = secs / F.lit(length)
        text = (F.when(amount >= 2, F.format_string(f"%.0f {name}s", amount))
                .when(amount >= 1, F.format_string(f"%.0f {name}", amount))
                .otherwise(text))
    return F.when(secs.isNotNull(), text)


def size_text(size: Column) -> Column:
    """Bytes below 1 KiB, else Kb with one decimal, else Mb with four."""
    kilo = size.cast("double") / 1024
    return (F.when(size < 1024, F.format_string("%d b", size.cast("long")))
            .when(kilo < 1024, F.format_string("%.1f Kb", kilo))
            .when(kilo >= 1024, F.format_string("%.4f Mb", kilo / 1024)))


def distance_key(hash_: Column, dist: Column) -> Column:
    """Sortable text: four digits of the distance in ten-thousandths (half-even, 0-9999), then the hash.

    Stored distances are float32, so the product is too.
    """
    scaled = (dist.cast("float") * F.lit(10000).cast("float")).cast("double")
    digits = F.least(F.lit(9999), F.greatest(F.lit(0), F.bround(scaled).cast("int")))
    return F.concat(F.lpad(digits.cast("string"), 4, "0"), hash_)


def dated_name(ts: Column, name: Column, ext: Column, copy: Column | None = None) -> Column:
    """``yyyy-MM-dd/HHmmss.name[(copy)][.ext]``; copy 0 or NULL is left out."""
    parts = [F.date_format(ts, "yyyy-MM-dd/HHmmss"), F.lit("."), name]
    if copy is not None:
        parts.append(F.when(copy > 0, F.format_string("(%d)", copy)).otherwise(F.lit("")))
    parts.append(F.when(F.coalesce(ext, F.lit("")) != "", F.concat(F.lit("."), ext)).otherwise(F.lit("")))
    return F.concat(*parts)


# Fixed value: names of recycled files in the stored naming convention.
RECYCLED_NAME = r"(?i)^(\d{6})\.([0-9a-z]{16})$"


def recycled_hash(stem: Column) -> Column:
    """``dddddd.<16 letters>`` gives the 16 letters; anything else gives an empty string."""
    return F.regexp_extract(stem, RECYCLED_NAME, 2)


def shard(hash_: Column) -> Column:
    """Folder of a hash: its first two characters, one level each."""
    name = F.lower(hash_)
    return F.concat_ws("/", F.substring(name, 1, 1), F.substring(name, 2, 1))


def chunk_path(hash_: Column, root: str, ext: str = "mex") -> Column:
    return F.concat(F.lit(root.rstrip("/") + "/"), shard(hash_), F.lit("/"), F.lower(hash_), F.lit(f".{ext}"))


def file_stem(path: Column) -> Column:
    """File name without folder and without its last extension."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def file_ext(path: Column) -> Column:
    """Last extension without the dot; empty when there is none."""
    return F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"\.([^.]*)$", 1)
