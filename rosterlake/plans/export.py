"""Results as files: JSON for programs, CSV of a shortlist, search addresses."""

from __future__ import annotations

import json
from urllib.parse import urlencode

from pyspark.sql import DataFrame

SHORTLIST = ["id", "name", "university", "department", "profile_url", "added_at"]


def as_json(rows: DataFrame | list | dict) -> str:
    body = [r.asDict(recursive=True) for r in rows.collect()] if isinstance(rows, DataFrame) else rows
    return json.dumps(body, indent=2, sort_keys=True, default=str)


def write_shortlist(rows: DataFrame, path: str, one_file: bool = True) -> None:
    """CSV with a header; values with a comma, quote or line break are quoted, quotes
    doubled; one file, as a shortlist is what a person picked by hand, or one a task."""
    rows = rows.select(SHORTLIST)
    (rows.coalesce(1) if one_file else rows).write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def search_address(base: str, **parameters) -> str:
    """An address with the parameters that are not empty, in their order."""
    kept = [(k, v) for k, v in parameters.items() if v not in (None, "")]
    return f"{base}?{urlencode(kept)}" if kept else base
