"""ledgerlens: retail-banking analytics as lazy Spark DataFrame plans.

Every analysis is a function of DataFrames (customers, accounts,
transactions, branches, employees, loans, loan payments, credit cards, card
transactions, account beneficiaries) that returns a DataFrame without running
an action.  "Today" is always an explicit ``as_of`` date, so results are
reproducible.

Layout:
  sources/    table schemas, parquet readers, the mapping onto the test tables
  functions/  column-level building blocks (ladders, safe ratios, age bands)
  plans/      plan-level building blocks (grand totals without a one-task
              window, distributed percent_rank, fact pre-aggregation)
  operators/  the analyses, grouped by business family
  checks/     result normalisation and the DuckDB oracle SQL
"""

from ledgerlens.sources.tables import BankTables  # noqa: F401
