"""Regenerate ledgerlens/checks/kinds.py from the Spark result schemas.

The canonical compare form of every registered query is read from its Spark
schema; the oracle SQL is wrapped with the same kinds.  Run after adding or
changing a query:  python tools/gen_kinds.py
"""

import os
import pprint
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ledgerlens.checks.compare import kinds  # noqa: E402
from ledgerlens.registry import registry  # noqa: E402
from ledgerlens.session import build_session  # noqa: E402
from ledgerlens.sources.tables import BankTables  # noqa: E402

OUT = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))),
                   "ledgerlens", "checks", "kinds.py")

if __name__ == "__main__":
    spark = build_session("local[4]", 4)
    t = BankTables.from_testdata(spark, "/root/testdata/sf0.001")
    result = {name: kinds(spec.build(t)) for name, spec in sorted(registry().items())}
    with open(OUT, "w") as f:
        f.write('"""Generated by tools/gen_kinds.py: canonical kind of each result column.\n\n'
                'f fractional, i integer, b boolean, d date, t timestamp, s string, a<k> array, m<k> map."""\n\n')
        f.write("KINDS = " + pprint.pformat(result, width=100, sort_dicts=False) + "\n")
    print(f"wrote {len(result)} queries to {OUT}")
