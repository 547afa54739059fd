"""Forests of parent links, folded from every node up to its root."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taleloom.sources.shared import written

#: (the column as known of the way so far, the same of the ancestor at its end) -> the column of both ways together
Join = Callable[[Column, Column], Column]


def ascended(links: DataFrame, joins: dict[str, Join]) -> DataFrame:
    """Of (id, up, ...): the nodes whose way up ends at a root (up is null), each other column joined along the way.

    Ways double: a node takes over its ancestor's way, so the rounds grow with the logarithm of the depth. A node below an
    unknown one drops out, and so do rings and what hangs below them: when a round settles none, only those are left.
    Each round is written to the shared folder.
    """
    columns = list(joins)
    links = written(links.select("id", "up", *columns))
    done, left = links.filter("up is null"), links.filter("up is not null")
    waiting = left.count()
    while waiting:
        every = done.unionByName(left).select(F.col("id").alias("of"), F.col("up").alias("next"), *[F.col(x).alias(f"their_{x}") for x in columns])
        ways = left.join(every, F.col("up") == F.col("of"))
        ways = written(ways.select("id", F.col("next").alias("up"), *[joins[x](F.col(x), F.col(f"their_{x}")).alias(x) for x in columns]))
        done, left = done.unionByName(ways.filter("up is null")), ways.filter("up is not null")
        now = left.count()
        if now == waiting:
            break
        waiting = now
    return done.select("id", *columns)
