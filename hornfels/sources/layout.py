"""Storage of relations: how their rows lie while a program runs.  It never changes results.

* ``set``: as they come; Catalyst reads them from where they are;
* ``cached``: in executors' memory, or on their disks, until the evaluation is reset; lost parts are made anew;
* ``bistore``: written in the order of the columns, in ranges of the first;
* ``hexastore``: written in ranges of the second column (the attribute of a fact), then of the first.

Written rows are sorted, so that a search with literals reads only the files and row groups whose statistics admit them.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from hornfels.plans.terms import LAYOUTS, Declaration
from hornfels.sources.scratch import materialize


def lay_out(df: DataFrame, decl: Declaration) -> DataFrame:
    """``df`` in the storage that its declaration asks for."""
    if decl.storage == LAYOUTS[0] or not decl.columns:
        return df
    if decl.storage == "cached":
        return df.persist(StorageLevel.MEMORY_AND_DISK)
    keys = list(decl.columns)
    if decl.storage == "hexastore":
        keys[:2] = keys[1::-1]
    keys = [f"`{k}`" for k in keys]
    return materialize(df.repartitionByRange(*keys).sortWithinPartitions(*keys))
