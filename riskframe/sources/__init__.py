"""Sources and sinks."""

from riskframe.sources.tables import loans, table  # noqa: F401
