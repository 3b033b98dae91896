"""Written tables between the steps of an operator, in the shared folder, removed when no longer read."""

from __future__ import annotations

from pyspark.sql import DataFrame

from broadsheet.session import new_path


class Scratch:
    """Tables of one call of an operator.

    ``keep`` writes a frame as parquet in the folder that ``spark.checkpoint.dir``
    names and reads it back, which cuts the lineage with files that outlive any
    executor. ``drop`` removes tables that no later step reads; what the result
    itself reads stays.
    """

    def __init__(self, df: DataFrame, name: str):
        self.spark, self.name = df.sparkSession, name
        self.paths: dict[int, str] = {}

    def keep(self, df: DataFrame) -> DataFrame:
        path = new_path(self.spark, self.name)
        df.write.parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(table)] = path
        return table

    def drop(self, *tables: DataFrame) -> None:
        jvm = self.spark._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for table in tables:
            path = jvm.org.apache.hadoop.fs.Path(self.paths.pop(id(table)))
            path.getFileSystem(conf).delete(path, True)
