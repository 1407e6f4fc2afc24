"""Catalog card: what the viewer writes under an image."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framefold.functions import text


def catalog_cards(panels: DataFrame) -> DataFrame:
    """(hash, label) from (hash, ext, hist_len, size, width, height, age_seconds, taken, meta).

    Three lines: "abcd.jpg [3]", "1.2 Mb  (640x480)", " 3 days ago  [2024-01-02] E:12".
    """
    first = F.concat(F.substring("hash", 1, 4), F.lit("."), F.col("ext"),
                     F.when(F.col("hist_len") > 0, F.format_string(" [%d]", "hist_len")).otherwise(F.lit("")))
    second = F.concat(text.size_text(F.col("size")), F.format_string("  (%dx%d)", "width", "height"))
    third = F.concat(F.lit(" "), text.age_text(F.col("age_seconds")), F.lit(" ago "),
                     F.coalesce(F.concat(F.lit(" ["), F.date_format("taken", "yyyy-MM-dd"), F.lit("]")), F.lit("")),
                     F.lit(" "), F.coalesce("meta", F.lit("")))
    return panels.select("hash", F.concat_ws("\n", first, second, third).alias("label"))
