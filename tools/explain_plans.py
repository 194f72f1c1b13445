"""Print the formatted physical plans of the main DataFrame plans.

    python tools/explain_plans.py [/root/testdata/sf0.1]

Shows column pruning (ReadSchema), pushed filters, partial aggregation
before each exchange, and the join strategy Spark picks.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from lowrank.operators import linalg, rows, stats  # noqa: E402
from lowrank.operators.blocks import partial_sums_df  # noqa: E402
from lowrank.session import local_session  # noqa: E402
from lowrank.sources import datasets  # noqa: E402


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = local_session(8)
    emb = datasets.embeddings_matrix(spark, sf)
    li = datasets.lineitem_matrix(spark, sf)
    cp = datasets.customer_part_matrix(spark, sf)
    import numpy as np
    w = np.ones((emb.n_cols, 3))
    plans = {
        "sparse rows (join + two groupings)": cp.df,
        "column statistics (dense)": stats.column_stats(li),
        "column statistics (sparse)": stats.column_stats(cp),
        "E-step partial sums (Arrow kernel + groupBy)": partial_sums_df(
            emb, lambda b: {"s": b.dense.sum(axis=0)}),
        "projection (Arrow kernel, no shuffle)": rows.project(emb, w),
        "projection, relational (broadcast weights)": rows.project_entries(emb, w),
        "Gram as a lazy table": linalg.gram_df(li, np.zeros(li.n_cols)),
    }
    for name, df in plans.items():
        print(f"\n==== {name}")
        df.explain("formatted")


if __name__ == "__main__":
    main()
