"""History text (hashes written one after another) to and from sorted arrays."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def split_history(text: Column) -> Column:
    """Cut every 16 characters; sorted and distinct.  A ragged tail is left out here and reported by V2."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?s)(.{16})"), F.lit(1))))


def join_history(peers: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(peers)), "")


def history_size(text: Column) -> Column:
    """Entries in a history text."""
    return F.floor(F.length(text) / 16)


def insert_peer(peers: Column, peer: Column) -> Column:
    """Set insert: the peer once, in order."""
    return F.array_sort(F.array_union(peers, F.array(peer)))
