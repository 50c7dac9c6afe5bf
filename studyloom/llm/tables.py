"""Intermediate tables in the folder that the session names in ``spark.checkpoint.dir``."""
import uuid

from studyloom.session import checkpoint_dir

#: Rows in an Arrow batch at most: texts and shingle lists are long, and a Python worker holds a batch several times.
BATCH_ROWS = 1000


class Scratch:
    """Tables of one operator call. Written once, read by column; ``drop`` removes those no result depends on."""

    def __init__(self, spark):
        self.spark = spark
        self.base = f"{checkpoint_dir(spark)}/llm-{uuid.uuid4().hex}"
        self.n = 0
        rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
        now = int(spark.conf.get(rows))
        if now <= 0 or now > BATCH_ROWS:
            spark.conf.set(rows, str(BATCH_ROWS))

    def keep(self, df):
        """Write ``df`` and return it as read back: the lineage ends here, and a lost executor costs nothing before it."""
        self.n += 1
        path = f"{self.base}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, *frames):
        """Delete tables that no later step reads."""
        jvm = self.spark._jvm
        for f in frames:
            p = jvm.org.apache.hadoop.fs.Path(f.scratch_path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
