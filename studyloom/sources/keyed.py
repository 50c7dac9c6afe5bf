"""A table folder that holds the newest row of every key and is merged into, as a streaming sink needs it.

Keys are dealt by hash into ranges; each range is one folder of files. A merge rewrites the ranges that its rows touch as a new version and
then names the version of every range in a manifest, which is put in place by a rename: a reader sees the state before or after a merge,
and a merge that died leaves nothing a reader looks at. What the last two manifests do not name is deleted, so the folder does not grow
with the number of merges. Running a merge again changes nothing.
"""
import json
from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql import types as T

_RANGE, _ORDER = "__range", "__order"


class KeyedTable:
    """``ranges``: how many key ranges; a range should fit a task. Only one writer at a time."""

    def __init__(self, spark, path, keys, ranges=8):
        self.spark, self.path, self.keys, self.ranges = spark, path, list(keys), ranges
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    @staticmethod
    def ranges_for(size, of_range=16_000_000, least=8):
        """How many ranges rows of ``size`` bytes or characters want, so that the rows of a range stay the same as tables grow."""
        return max(least, -(-int(size or 0) // of_range))

    def _versions(self):
        here = self._path(f"{self.path}/manifest")
        names = [s.getPath().getName() for s in self._fs.listStatus(here)] if self._fs.exists(here) else []
        return sorted(int(n.split(".")[0]) for n in names if n.endswith(".json"))

    def _manifest(self, version):
        stream = self._fs.open(self._path(f"{self.path}/manifest/{version}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, version, schema, ranges):
        temporary, final = self._path(f"{self.path}/manifest/{version}.tmp"), self._path(f"{self.path}/manifest/{version}.json")
        stream = self._fs.create(temporary, True)
        stream.write(json.dumps({"schema": schema, "ranges": ranges}).encode())
        stream.close()
        self._fs.rename(temporary, final)

    def _files(self, version, ranges):
        return {f"{self.path}/v{v}/{_RANGE}={r}" for r, v in self._manifest(version)["ranges"].items() if ranges is None or int(r) in ranges}

    def _rows(self, version, ranges=None):
        schema = T.StructType.fromJson(json.loads(self._manifest(version)["schema"]))
        paths = sorted(self._files(version, ranges))
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def create(self, schema):
        """An empty table, unless there is one."""
        if not self._versions():
            self._publish(0, T.StructType([*schema.fields, T.StructField(_ORDER, T.LongType())]).json(), {})

    def read(self):
        """Current rows."""
        return self._rows(self._versions()[-1]).drop(_ORDER)

    def merge(self, rows, order=None):
        """Take in ``rows``: per key the row with the largest ``order`` (a bigint column) stays; without it the later merge wins."""
        self.create(rows.schema)
        last = self._versions()[-1]
        new = last + 1
        rows = rows.withColumn(_ORDER, F.col(order).cast("bigint") if order else F.lit(new).cast("bigint")).persist()
        try:
            touched = self._touched(rows)
            if not touched:
                return
            both = rows.withColumn("__new", F.lit(1)).unionByName(self._rows(last, touched).withColumn("__new", F.lit(0))).withColumn(_RANGE, self._dealt())
            values = [c for c in rows.columns if c not in self.keys]
            best = F.max_by(F.struct(*values), F.struct(_ORDER, "__new")).alias("r")
            # a range is one task from here on: grouping by range and keys needs no further shuffle
            both = both.repartition(min(len(touched), self.ranges), _RANGE).groupBy(_RANGE, *self.keys).agg(best).select(_RANGE, *self.keys, "r.*")
            self._write(both, last, new, touched)
        finally:
            rows.unpersist()

    def replace(self, gone, rows):
        """Drop all rows of the keys in ``gone`` and put ``rows`` in, of which a key may have many. Files of other ranges stay as they are."""
        self.create(rows.schema)
        last = self._versions()[-1]
        gone = gone.select(*self.keys).distinct().persist()
        try:
            touched = self._touched(gone) | self._touched(rows.select(*self.keys).distinct())
            if not touched:
                return
            same = [F.col(f"__g.{k}").eqNullSafe(F.col(f"__o.{k}")) for k in self.keys]
            kept = self._rows(last, touched).alias("__o").join(gone.alias("__g"), reduce(lambda a, b: a & b, same), "left_anti")
            both = kept.unionByName(rows.withColumn(_ORDER, F.lit(last + 1).cast("bigint"))).withColumn(_RANGE, self._dealt())
            # one task for one range: dealt by the hash of its number, several ranges would meet in a task
            self._write(both.repartitionById(self.ranges, F.col(_RANGE)), last, last + 1, touched)
        finally:
            gone.unpersist()

    def _dealt(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.ranges)).cast("int")

    def _touched(self, rows):
        if self.ranges == 1:
            return set() if rows.isEmpty() else {0}
        return {r[0] for r in rows.select(self._dealt()).distinct().toLocalIterator()}  # at most ``ranges`` numbers

    def _write(self, rows, last, new, touched):
        rows.write.mode("overwrite").partitionBy(_RANGE).parquet(f"{self.path}/v{new}")
        now = self._manifest(last)
        held = {r: v for r, v in now["ranges"].items() if int(r) not in touched}
        held |= {str(r): new for r in touched if self._fs.exists(self._path(f"{self.path}/v{new}/{_RANGE}={r}"))}
        self._publish(new, now["schema"], held)
        self._clean(new)

    def _clean(self, version):
        """Delete what neither this manifest nor the one before it names."""
        held = self._files(version, None) | self._files(version - 1, None)
        for old in (v for v in self._versions() if v < version - 1):
            for path in self._files(old, None) - held:
                self._fs.delete(self._path(path), True)
            self._fs.delete(self._path(f"{self.path}/manifest/{old}.json"), False)
