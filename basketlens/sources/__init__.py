"""Sources and sinks: Parquet scans, the fixture views, table export."""

from basketlens.sources.export import export_tables, write_parquet  # noqa: F401
from basketlens.sources.fixture import fixture_tables  # noqa: F401
from basketlens.sources.tables import Tables, catalog_tables, load, scan_projected, shop_tables  # noqa: F401
