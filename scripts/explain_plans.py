"""Print ``explain("formatted")`` for registered queries: scan pruning, pushed filters, exchanges.

Usage: python scripts/explain_plans.py [sf_dir] name [name ...]
Iterative queries run their inner jobs while building the DataFrame; the printed plan is the last stage.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from graphsig.plans.catalog import QUERIES  # noqa: E402
from graphsig.session import build_session  # noqa: E402


def main() -> None:
    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    spark = build_session()
    for name in args or ["n1_node_sketch"]:
        print(f"===== {name}")
        QUERIES[name](spark, sf_dir).explain("formatted")
    spark.stop()


if __name__ == "__main__":
    main()
