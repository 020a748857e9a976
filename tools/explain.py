"""Print the physical plan of registered queries over the test tables.

  python tools/explain.py [--sf 0.1] [--mode formatted|simple|cost] [--no-broadcast] name [name ...]

``--no-broadcast`` turns off size-based broadcast joins, to see the plan a
large input would get (every fact join a shuffle join).
"""

import argparse
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ledgerlens.registry import registry  # noqa: E402
from ledgerlens.session import build_session  # noqa: E402
from ledgerlens.sources.tables import BankTables  # noqa: E402


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("--mode", default="formatted")
    ap.add_argument("--no-broadcast", action="store_true")
    ap.add_argument("names", nargs="+")
    a = ap.parse_args()
    extra = {"spark.sql.autoBroadcastJoinThreshold": "-1",
             "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"} if a.no_broadcast else {}
    spark = build_session("local[8]", 16, extra=extra)
    tables = BankTables.from_testdata(spark, f"/root/testdata/sf{a.sf}")
    for name in a.names:
        print(f"==== {name}")
        registry()[name].build(tables).explain(a.mode)


if __name__ == "__main__":
    main()
