"""Walks along links, by recursion."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame


def chains(links: DataFrame, *, most: int = 100) -> DataFrame:
    """(head, last, length, ends) of the walk from each node that nothing leads to along ``links`` (a, b), a having one b at most.

    ends is ``end`` where the walk comes to a node without a link, ``loop`` where it comes back to a node that it has been at (of several a's with one b each walk
    goes on by itself), ``bound`` where it has ``most`` links and would go on. Nodes that only lie on loops have no head. Links with a null end are left out. Each step is one join of the walks that still go on, so
    there are as many as the longest walk has links; what a walk carries is its nodes.
    """
    spark, view = links.sparkSession, f"tessera_links_{uuid.uuid4().hex}"
    links.where("a is not null and b is not null").select("a", "b").createOrReplaceTempView(view)
    level, rows = "spark.sql.cteRecursionLevelLimit", "spark.sql.cteRecursionRowLimit"
    spark.conf.set(level, max(most + 2, int(spark.conf.get(level, "100"))))
    spark.conf.set(rows, "-1")
    return spark.sql(
        f"""
        WITH RECURSIVE walk(head, last, length, been, looped) AS (
          SELECT a, b, 1L, array(a, b), a = b FROM {view} WHERE NOT EXISTS (SELECT 1 FROM {view} p WHERE p.b = {view}.a)
          UNION ALL
          SELECT w.head, l.b, w.length + 1L, array_append(w.been, l.b), array_contains(w.been, l.b)
          FROM walk w JOIN {view} l ON l.a = w.last WHERE w.length < {most} AND NOT w.looped)
        SELECT w.head, w.last, w.length, CASE WHEN w.looped THEN 'loop' WHEN n.a IS NOT NULL THEN 'bound' ELSE 'end' END AS ends
        FROM walk w LEFT JOIN {view} n ON n.a = w.last
        WHERE w.looped OR n.a IS NULL OR w.length = {most}
        """
    )
