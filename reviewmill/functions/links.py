"""Application ids out of store links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reviewmill.functions.text import strip

# The hosts and the path of a store page.
STORE_HOSTS = ["play.google.com", "market.android.com"]
STORE_PATH = "/store/apps/details"


def extract_app_id(link: Column) -> Column:
    """The id parameter of a store link, or the text itself when it looks like a package name."""
    text = strip(link)
    host = F.lower(F.try_parse_url(text, F.lit("HOST")))
    path = F.try_parse_url(text, F.lit("PATH"))
    found = F.try_url_decode(F.try_parse_url(text, F.lit("QUERY"), F.lit("id")))
    from_link = host.isin(STORE_HOSTS) & F.contains(path, F.lit(STORE_PATH)) & (F.length(found) > 0)
    looks_like_id = (
        F.contains(text, F.lit("."))
        & ~F.contains(text, F.lit("/"))
        & ~F.contains(text, F.lit(" "))
    )
    return F.when(from_link, found).when(looks_like_id, text).otherwise(F.lit(""))
