"""Plan-level building blocks that keep every stage distributed.

* ``with_totals`` / ``with_quantiles``: compare rows with whole-table
  figures without ``Window.partitionBy()`` (which moves the whole input into
  one task).  The figure is a one-row aggregate (partial aggregation on every
  task, one tiny final merge), attached to every row from a broadcast of a
  frame that is one row by construction (``attach_one_row``).
* ``sequence.scan``: lag, lead, prefix sums and running statistics over keys of any
  size, in slices that follow from the data.
* ``percent_rank`` / ``ntile`` / ``with_percentiles``: global (or per-key) ranks and exact
  percentiles over inputs of any size, scanned in the same slices.
* ``profile``: an entity left-joined to per-key measure frames, NULLs filled
  with 0 the way the analyses fill them.
"""

from ledgerlens.plans.globals import attach_one_row, with_quantiles, with_totals  # noqa: F401
from ledgerlens.plans.ranking import percent_rank, with_percentiles  # noqa: F401
from ledgerlens.plans.joins import profile  # noqa: F401
