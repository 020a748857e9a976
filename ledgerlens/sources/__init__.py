"""Sources: table schemas, parquet readers and the test-table mapping.

The analyses read no files themselves; callers pass DataFrames.  The
readers here only build lazy scans (column pruning and filter pushdown reach
parquet through Catalyst).
"""

from ledgerlens.sources.model import SCHEMAS, TABLE_NAMES  # noqa: F401
from ledgerlens.sources.tables import BankTables  # noqa: F401
