"""Recursive queries over an edge file: python -m quern.cli -g FILE -q sssp|reach|cc|SQL [-v START] [-p PARTITIONS]."""

from __future__ import annotations

import argparse
import time

from quern.plans.recursive_sql import RecursiveSQL
from quern.session import session
from quern.sources.files import tab_edges

#: Texts by name: least cost and reach from one vertex, and the number of labels that directed edges leave.
CANNED = {
    "sssp": "WITH RECURSIVE nearest (vertex, min() AS total) AS (SELECT {v}, 0) UNION (SELECT e.Dst, n.total + e.Cost FROM nearest n JOIN edge e ON e.Src = n.vertex) SELECT vertex, total FROM nearest",
    "reach": "WITH RECURSIVE visited (vertex) AS (SELECT {v}) UNION (SELECT e.Dst FROM visited s JOIN edge e ON e.Src = s.vertex) SELECT vertex FROM visited",
    "cc": "WITH RECURSIVE label (vertex, min() AS least) AS (SELECT DISTINCT Src, Src FROM edge) UNION (SELECT e.Dst, l.least FROM label l JOIN edge e ON e.Src = l.vertex) SELECT count(DISTINCT least) AS components FROM label",
}


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("-g", "--graph", required=True, help="tab-separated pairs of whole numbers; blank lines and those with %% are skipped")
    p.add_argument("-q", "--query", default="sssp", help="sssp, reach, cc, or a query over edge(Src, Dst, Cost)")
    p.add_argument("-p", "--partitions", type=int, default=12)
    p.add_argument("-v", "--vertex", type=int, default=1)
    a = p.parse_args(args)
    spark = session(**{"spark.sql.shuffle.partitions": str(a.partitions)})
    tab_edges(spark, a.graph).repartition(a.partitions, "Src").persist().createOrReplaceTempView("edge")
    began = time.time()
    engine = RecursiveSQL(spark)
    rows = engine.sql(CANNED.get(a.query, a.query).format(v=a.vertex) if a.query in CANNED else a.query)
    rows.show(20, truncate=False)
    print(f"{rows.count()} rows in {time.time() - began:.1f} s; " + ", ".join(f"{n}: {s.iterations} iterations" for n, s in engine.stats.items()))


if __name__ == "__main__":
    main()
