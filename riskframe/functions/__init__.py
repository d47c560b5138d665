"""Column-expression builders."""

from riskframe.functions.columns import (  # noqa: F401
    log1p, map_values, product, ratio, right_closed_bins, round6, row_percent,
    threshold, total,
)
from riskframe.functions.hashing import hash_hex, uniform  # noqa: F401
