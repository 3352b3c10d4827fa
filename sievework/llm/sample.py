"""A bounded, repeatable sample of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F


def bounded(df: DataFrame, key: str, n: int, total: int | None = None) -> list[Row]:
    """About n rows, never more, by the hash of the whole row: all of them if there are no more.

    A threshold on the hash picks them where they lie, so what reaches the driver does not grow with the number of
    partitions, as a top-n of every partition would; a limit holds if one row is repeated very often, and which of
    its copies it takes makes no difference.
    """
    total = df.count() if total is None else total
    h = F.xxhash64(*df.columns)
    if total > n:
        df = df.where(F.pmod(h, F.lit(1 << 30)) < int((n + 4 * n**0.5) / total * (1 << 30)))
    rows = df.withColumn("_hash", h).limit(2 * n).collect()
    return sorted(rows, key=lambda r: (r["_hash"], str(r[key])))[:n]


def frequent(table: DataFrame, most: int, always: str | None = None) -> list[tuple[str, int]]:
    """(word, c) of a count table: one word always, then the most frequent, at most so many, by count and then word.

    A histogram over eighths of powers of two gives the least count that keeps to the bound, so what reaches the
    driver is the words themselves and no more.
    """
    step = F.floor(F.log2("c") * 8).cast("int")
    room, low = most - (always is not None), None
    for r in sorted(table.groupBy(step.alias("b")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r["b"]):  # some 500 rows at most
        room -= r["n"]
        if room < 0:
            break
        low = r["b"]
    picked = F.lit(False) if low is None else step >= low
    picked = picked | (F.col("word") == always) if always is not None else picked
    found = sorted(((r["word"], r["c"]) for r in table.where(picked).collect()), key=lambda t: (t[0] != always, -t[1], t[0]))
    return found or ([(always, 1)] if always is not None else [])
