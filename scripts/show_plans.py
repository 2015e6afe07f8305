"""Write PLANS.md: the physical plan of every registered batch query.

Usage: python scripts/show_plans.py [sf_dir] > PLANS.md
The plans are the initial adaptive plans (AQE may still coalesce partitions
or switch a join to broadcast at runtime after measuring a side).
"""

from __future__ import annotations

import contextlib
import io
import re
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from lexitally.plans.catalog import QUERIES  # noqa: E402
from lexitally.session import build_session  # noqa: E402


def physical(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    text = buf.getvalue()
    text = text.split("== Physical Plan ==", 1)[-1].strip()
    text = re.sub(r"#\d+L?", "", text)                  # expression ids
    text = re.sub(r", \[plan_id=\d+\]", "", text)
    text = re.sub(r"Location: [^,]*\[([^\]]*)\]", r"Location: [\1]", text)
    return text


def main(argv) -> None:
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.1"
    spark = build_session("local[8]", "lexitally-plans", shuffle_partitions=8)
    print("# Physical plans\n")
    print(f"Generated by `scripts/show_plans.py` on `{Path(sf_dir).name}` with local[8] "
          "and 8 shuffle partitions. These are the initial adaptive plans: at runtime AQE "
          "coalesces shuffle partitions and may turn a join into a broadcast once it "
          "has measured the smaller side. Streaming queries are left out, because "
          "building them runs them.\n")
    for name, fn in QUERIES.items():
        plan = physical(fn(spark, sf_dir))
        shuffles = len(re.findall(r"Exchange (hashpartitioning|rangepartitioning|"
                                  r"RoundRobinPartitioning|SinglePartition)", plan))
        schemas = sorted(set(re.findall(r"ReadSchema: (struct<[^>]*>)", plan)))
        doc = (fn.__doc__ or "").strip().splitlines()[0] if fn.__doc__ else ""
        print(f"## {name}\n\n{doc}\n\nShuffles: {shuffles}. "
              f"Scans read: {', '.join(f'`{s}`' for s in schemas) or 'derived data'}.\n")
        print("```\n" + plan + "\n```\n")
    spark.stop()


if __name__ == "__main__":
    main(sys.argv)
