"""Print the final physical plan of named queries after running them
(adaptive plans are final only then):

    python -m lendframe.plans.explain [sf_dir] name [name ...]
"""

from __future__ import annotations

import sys


def main(argv) -> int:
    from lendframe.plans.queries import QUERIES
    from lendframe.session import get_session
    sf_dir = argv[0] if argv and argv[0].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in argv if not a.startswith("/")]
    spark = get_session()
    for name in names:
        df = QUERIES[name](spark, sf_dir)
        # Run the DataFrame's own plan (rows are counted in the executors,
        # nothing is collected), so its adaptive plan is final.
        df._jdf.queryExecution().toRdd().count()
        print(f"=== {name}")
        df.explain("formatted")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
