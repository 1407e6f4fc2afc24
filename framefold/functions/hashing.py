"""Content hash: the first 80 bits of SHA-256 in a 32-letter alphabet, 16 characters.  Built-ins only."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# The digits Spark's conv() writes in base 32, and the alphabet of the stored hashes.
BASE32_DIGITS = "0123456789abcdefghijklmnopqrstuv"
HASH_ALPHABET = "0123456789abcdefghijkmnpqrstuvxz"


def content_hash(content: Column) -> Column:
    """Hash of a binary (or string, as UTF-8) column; NULL stays NULL."""
    digest = F.sha2(content.cast("binary"), 256)

    def half(start: int) -> Column:
        digits = F.lower(F.conv(F.substring(digest, start, 10), 16, 32))
        return F.lpad(F.translate(digits, BASE32_DIGITS, HASH_ALPHABET), 8, "0")

    return F.concat(half(1), half(11))


def is_valid_hash(value: Column) -> Column:
    """Exactly 16 characters of the alphabet.  The length test keeps a trailing newline out."""
    return F.coalesce((F.length(value) == 16) & value.rlike(f"^[{HASH_ALPHABET}]{{16}}$"), F.lit(False))


def seeded_draw(key: Column, seed: str, tag: str = "") -> Column:
    """A reproducible random order: sort by this instead of by rand()."""
    return F.md5(F.concat(key, F.lit(seed), F.lit(tag)))
