"""DuckDB oracle: the same analyses written independently as SQL.

Each entry is plain DuckDB SQL over the ten banking tables (plus
``transactions_dense``), kept per analysis family in ``checks/sql/``;
``oracle_sql`` prefixes the CTEs that map the test tables onto them and wraps
the result in the canonical compare form.

Conventions that mirror Spark's semantics:
* ``x / NULLIF(y, 0)`` on DOUBLE operands for ratios (Spark: try_divide);
* ``::DOUBLE`` on weights, so weighted scores are the same IEEE operations;
* ``dayofweek`` is 0..6 from Sunday (Spark: 1..7), ``NULLS FIRST`` in
  ascending window orders (Spark's default);
* ``quantile_disc`` for ``percentile_approx`` (exact on groups this small).
"""

from __future__ import annotations

import re

from ledgerlens.checks.compare import wrap_sql
from ledgerlens.checks.sql import (accounts, branches, compliance, credit, customers, reporting,
                                   transactions)
from ledgerlens.sources.testdata import MAPPINGS, cte_sql

SQL: dict[str, str] = {}
for _family in (transactions, accounts, branches, customers, credit, compliance, reporting):
    SQL.update(_family.SQL)


# ------------------------------------------------------------------ dense variants
def _dense(sql: str) -> str:
    """The same SQL over ``transactions_dense``."""
    return re.sub(r"\btransactions\b(?!_dense)", "transactions_dense", sql)


for _name in ("service_levels", "transaction_anomalies", "regulatory_compliance", "compliance_aml"):
    SQL[_name + "_dense"] = _dense(SQL[_name])


def tables_used(sql: str) -> list[str]:
    return [n for n in MAPPINGS if re.search(rf"\b{n}\b", sql)]


def oracle_sql(name: str, kinds: dict[str, str]) -> str:
    body = SQL[name]
    return cte_sql(tables_used(body)) + wrap_sql(body, kinds)
