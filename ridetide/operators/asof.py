"""As-of lookup: each request with the versions of its key that were valid at its own time.

Time is cut into cells. A version is looked up by an equi-join on key and cell, in a short list of the
versions that begin in that cell, or else in the one carried over from earlier cells. So requests are
never sorted, a hot key is spread over its cells, and a hot cell is split by adaptive execution, as the join
reads plain exchanges. Only the cells of a key, a row each, meet in one place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridetide.functions.instants import window_start_ms

_KEY, _CELL = "__key", "__cell"


def _last(versions: Column) -> Column:
    return F.get(versions, F.size(versions) - 1)


def as_of(
    requests: DataFrame,
    key: str,
    at: str,
    facts: dict[str, tuple[DataFrame, Column, Sequence[str]]],
    cell_ms: int,
) -> DataFrame:
    """The requests with a struct per fact: the last version of ``key`` that began at ``at`` or before.

    ``facts``: name -> (versions, epoch milliseconds at which a version begins, its columns). The struct
    is null where no version had begun, and for requests without a key or time. Of versions that begin together
    the greatest counts. ``cell_ms`` should hold a few versions of a key: the list of a cell is searched.
    """
    cell = window_start_ms(F.col(at), cell_ms)
    # What is asked for: a row per key and cell, combined before the shuffle.
    rows = requests.select(F.col(key).alias(_KEY), cell.alias(_CELL)).dropna().distinct()
    for name, (versions, begins, columns) in facts.items():
        version = F.struct(begins.alias("__from"), *columns)
        known = versions.where(begins.isNotNull() & F.col(key).isNotNull()).select(
            F.col(key).alias(_KEY), window_start_ms(begins, cell_ms).alias(_CELL), version.alias(name)
        )
        rows = rows.unionByName(known, allowMissingColumns=True)
    cells = rows.groupBy(_KEY, _CELL).agg(*[F.sort_array(F.collect_list(name)).alias(name) for name in facts])
    before = Window.partitionBy(_KEY).orderBy(_CELL).rowsBetween(Window.unboundedPreceding, -1)
    lookup = cells.select(
        _KEY,
        _CELL,
        *[F.col(name).alias(f"__{name}_in") for name in facts],
        *[F.last(_last(F.col(name)), ignorenulls=True).over(before).alias(f"__{name}_until") for name in facts],
    )
    own = requests.withColumn("__at", cell)
    joined = own.join(lookup, (own[key] == lookup[_KEY]) & (own["__at"] == lookup[_CELL]), "left")

    def valid(name: str) -> Column:
        begun = F.filter(f"__{name}_in", lambda version: version["__from"] <= F.col(at))
        return F.coalesce(_last(begun), F.col(f"__{name}_until")).alias(name)

    return joined.select(*[F.col(f"`{column}`") for column in requests.columns], *[valid(name) for name in facts])
