"""A table with one row for each key, fed by numbered batches of changes.

Nothing is rewritten when a batch comes: it is written as a delta beside the base,
and a read folds base and deltas by key (merge on read).  ``compact`` writes the
fold as a new base, from which later reads start.  A batch that is applied again
changes nothing, so a streaming sink may repeat one after a failure.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PUT, REMOVE = "put", "remove"
#: How the values of a column are folded.  ``last`` and ``first`` skip NULLs.
KINDS = ("first", "last", "max", "min", "sum", "union")


class KeyedTable:
    """``rules`` say for each column how its values are folded, in order of batch and ``order``.

    ``first`` and ``last`` take the first or last value that is not NULL, ``max``,
    ``min`` and ``sum`` what they say, and ``union`` appends the elements of an
    array, of those alike (or with one value of field f, by ``union:f``) the first.
    A ``remove`` ends what its key had before; a later ``put`` starts anew.  Rows
    with a NULL key are left out.  Equal places in the order go to the larger value.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], rules: dict[str, str]):
        unknown = [r for r in rules.values() if r.split(":")[0] not in KINDS]
        if unknown:
            raise ValueError(f"unknown rules: {unknown}")
        self.spark, self.path, self.keys, self.rules = spark, path.rstrip("/"), list(keys), dict(rules)

    def _numbers(self, kind: str) -> list[int]:
        """Numbers of the folders of this kind that were written to their end."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        found = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}/*/_SUCCESS")
        listed = found.getFileSystem(conf).globStatus(found) or []
        return sorted(int(s.getPath().getParent().getName()) for s in listed)

    def _read(self, kind: str, number: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{kind}/{number:012d}")

    def _base(self, upto: int | None) -> int:
        return max((n for n in self._numbers("base") if upto is None or n <= upto), default=-1)

    def apply(self, batch: int, changes: DataFrame, order: str | Column, op: str | Column | None = None) -> bool:
        """Add batch number ``batch``, from 0 on; False if it is there already.

        ``order`` places the rows of a batch, ``op`` says ``put`` (as by default) or
        ``remove``.  Batches may come late, but not below a base.
        """
        if batch < 0:
            raise ValueError("batches are numbered from 0")
        if batch <= self._base(None) or batch in self._numbers("delta"):
            return False
        place = F.col(order) if isinstance(order, str) else order
        kind = F.lit(PUT) if op is None else F.col(op) if isinstance(op, str) else op
        rows = changes.select(*self.keys, *self.rules, place.alias("__order"), kind.alias("__op"))
        rows = rows.dropna(subset=self.keys)
        rows.write.mode("overwrite").parquet(f"{self.path}/delta/{batch:012d}")
        return True

    def changes(self, after: int = -1, upto: int | None = None) -> DataFrame | None:
        """Rows of the deltas after and up to these batches, with __batch; None if there are none."""
        numbers = [n for n in self._numbers("delta") if n > after and (upto is None or n <= upto)]
        frames = [self._read("delta", n).withColumn("__batch", F.lit(n).cast("bigint")) for n in numbers]
        if not frames:
            return None
        while len(frames) > 1:  # by pairs, so that the plan stays flat
            frames = [a.unionByName(b) for a, b in zip(frames[::2], frames[1::2])] + frames[len(frames) & ~1 :]
        return frames[0]

    def read(self, upto: int | None = None) -> DataFrame:
        """The rows as they are after batch ``upto``, or after all."""
        base = self._base(upto)
        fresh = self.changes(base, upto)
        if base < 0:
            if fresh is None:
                raise ValueError(f"no batch was applied to {self.path}")
            return self._fold(fresh)
        old = self._read("base", base)
        if fresh is None:
            return old
        # a base comes before every delta that is read with it
        place = F.lit(None).cast(fresh.schema["__order"].dataType)
        old = old.withColumns({"__order": place, "__op": F.lit(PUT), "__batch": F.lit(base).cast("bigint")})
        return self._fold(old.select(fresh.columns).unionByName(fresh))

    def _fold(self, rows: DataFrame) -> DataFrame:
        at = F.struct("__batch", "__order")
        gone = rows.filter(F.col("__op") == REMOVE).groupBy(*self.keys).agg(F.max(at).alias("__gone"))
        live = rows.filter(F.col("__op") == PUT).withColumn("__at", at).join(gone, self.keys, "left")
        live = live.filter("__gone is null or __at > __gone")
        folded = [self._folded(c, r).alias(c) for c, r in self.rules.items() if not r.startswith("union")]
        out = live.groupBy(*self.keys).agg(*(folded or [F.count(F.lit(1)).alias("__n")]))
        for column, rule in self.rules.items():
            if rule.startswith("union"):
                out = out.join(self._union(live, column, rule.partition(":")[2]), self.keys, "left")
        return out.select(*self.keys, *self.rules)

    @staticmethod
    def _folded(column: str, rule: str) -> Column:
        c = F.col(column)
        if rule in ("first", "last"):
            placed = F.when(c.isNotNull(), F.struct("__at", c.alias("value")))
            return (F.min if rule == "first" else F.max)(placed)["value"]
        return getattr(F, rule)(c)

    def _union(self, live: DataFrame, column: str, by: str) -> DataFrame:
        """Arrays of different elements: the first of each is found before they are collected."""
        element = F.posexplode(column).alias("__i", "__e")
        rows = live.select(*self.keys, "__at", element).filter("__e is not null")
        alike = F.col(f"__e.{by}") if by else F.col("__e")
        first = rows.groupBy(*self.keys, alike.alias("__k")).agg(F.min(F.struct("__at", "__i", "__e")).alias("__f"))
        listed = F.transform(F.array_sort(F.collect_list("__f")), lambda f: f["__e"])
        return first.groupBy(*self.keys).agg(listed.alias(column))

    def compact(self) -> int:
        """Write the fold of everything as a base; its number is that of the last batch."""
        newest = max(self._numbers("delta"), default=-1)
        base = self._base(None)
        if newest <= base:
            return base
        self.read(newest).write.mode("overwrite").parquet(f"{self.path}/base/{newest:012d}")
        return newest

    def vacuum(self) -> None:
        """Delete deltas and bases that the newest base replaces; no read of the past may be running."""
        base = self._base(None)
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for kind, numbers in (("base", self._numbers("base")), ("delta", self._numbers("delta"))):
            for n in numbers:
                if n < base or (kind == "delta" and n <= base):
                    old = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}/{n:012d}")
                    old.getFileSystem(conf).delete(old, True)

    def rename(self, batch: int, names: DataFrame, order: str | Column) -> bool:
        """Apply as batch ``batch``: the rows of old keys go to new ones, whose rows they are folded into.

        ``names`` has the keys and, as ``to_<key>``, the new ones.  Columns should
        fold alike in any order, as ``max`` of (time, value) does.
        """
        moved = self.read(batch - 1).join(names, self.keys)
        op = F.explode(F.array(F.lit(REMOVE), F.lit(PUT))).alias("__op")
        both = moved.select(*self.keys, *(f"to_{k}" for k in self.keys), *self.rules, op)
        put = F.col("__op") == PUT
        keys = {k: F.when(put, F.col(f"to_{k}")).otherwise(F.col(k)) for k in self.keys}
        return self.apply(batch, both.withColumns(keys), order, "__op")

    def feed(self, before: int | None, after: int | None = None) -> DataFrame:
        """(keys, change, old, new) of the keys that differ between two batches; None is before all."""
        now = self.read(after)
        values = F.struct(*self.rules)
        was = self.read(before) if before is not None else now.limit(0)
        both = was.select(*self.keys, values.alias("old")).join(now.select(*self.keys, values.alias("new")), self.keys, "full")
        kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed")
        return both.filter(~F.col("old").eqNullSafe(F.col("new"))).withColumn("change", kind).select(*self.keys, "change", "old", "new")

    def sink(self, shape: Callable[[DataFrame], DataFrame] | None = None, order: str = "__order", op: str | None = None) -> Callable[[DataFrame, int], None]:
        """A ``foreachBatch`` function that applies each micro-batch once, under its own number."""

        def write(batch: DataFrame, number: int) -> None:
            self.apply(number, shape(batch) if shape else batch, order, op)

        return write


