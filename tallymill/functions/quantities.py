"""Resource quantity strings: CPU cores and usable memory."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# The overhead rule of memory limits, in MiB and as factors.
MIN_OVERHEAD_MIB = 384
JVM_OVERHEAD = 0.1
OTHER_OVERHEAD = 0.4

# Size of a memory unit in MiB.
MIB_PER_UNIT = {
    "Ki": 2.0**-10,
    "Mi": 1.0,
    "Gi": 2.0**10,
    "Ti": 2.0**20,
    "Pi": 2.0**30,
    "Ei": 2.0**40,
    "k": 1e3 / 2**20,
    "M": 1e6 / 2**20,
    "G": 1e9 / 2**20,
    "T": 1e12 / 2**20,
    "": 2.0**-20,
}


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def cores(quantity: str | Column) -> Column:
    """Whole cores of a CPU quantity, rounded up: ``1800m`` is 2, ``1.5`` is 2.

    Single precision throughout, as the quantities are defined. Text that is no
    quantity gives NULL.
    """
    q = _col(quantity)
    milli = F.substring_index(q, "m", 1).try_cast("float") / F.lit(1000.0)
    number = F.when(q.contains("m"), milli.cast("float")).otherwise(q.try_cast("float"))
    return F.when(number < 0, F.lit(0)).otherwise(F.ceil(number)).cast("long")


_MEMORY = r"^([0-9]*\.?[0-9]+|[0-9]+\.)([A-Za-z]*)$"


def _mebi(quantity: Column, factor: Column) -> Column:
    """Whole MiB of a memory quantity times a factor, rounded down.

    The number and the size of its unit are the same terms wherever this is
    used on a quantity, so they are computed once a row.
    """
    number = F.regexp_extract(quantity, _MEMORY, 1).try_cast("float")
    sizes = F.create_map(*(F.lit(x) for unit in MIB_PER_UNIT.items() for x in unit))
    size = F.try_element_at(sizes, F.regexp_extract(quantity, _MEMORY, 2))
    return F.floor(number * factor.cast("float") * size).cast("long")


def mib(quantity: str | Column) -> Column:
    """Whole MiB of a memory quantity; an unknown unit or no number gives NULL."""
    return _mebi(_col(quantity), F.lit(1.0))


def usable_mib(quantity: str | Column, jvm: bool | Column = True) -> Column:
    """MiB left for the heap once the memory overhead is taken off the limit.

    A limit below the smallest overhead is returned as it is.
    """
    one = np.float32(1.0)
    # The factors are single precision numbers, as the quantities are.
    jvm_share = float(one / (one + np.float32(JVM_OVERHEAD)))
    other_share = float(one / (one + np.float32(OTHER_OVERHEAD)))
    is_jvm = F.lit(jvm) if isinstance(jvm, bool) else jvm
    whole = mib(quantity)
    reduced = _mebi(_col(quantity), F.when(is_jvm, jvm_share).otherwise(other_share))
    deduction = F.greatest(F.lit(MIN_OVERHEAD_MIB), whole - reduced)
    return F.when(whole < MIN_OVERHEAD_MIB, whole).otherwise(whole - deduction)
