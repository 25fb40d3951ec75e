"""Connected components of a link table, as a sequence of Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelrank.session import scratch_path, shuffles_removed


def write_scratch(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Write ``df`` under the shared scratch folder and read it back (cuts the lineage).

    Tables written in one ``folder`` (a :func:`scratch_path`) go together with :func:`remove_scratch`."""
    path = scratch_path(df.sparkSession, name)
    if folder is not None:
        path = f"{folder}/{path.rsplit('/', 1)[1]}"
    with shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_scratch(spark: SparkSession, folder: str) -> None:
    """Delete a folder of scratch tables that no later result reads."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def connected_components(links: DataFrame, a: str = "a", b: str = "b", folder: str | None = None) -> DataFrame:
    """``(node, root)`` for every node of the undirected links; root is one node per component.

    Each round every node is merged into its smallest neighbour, the links are rewritten to
    the merged nodes, and self-links and repeats go; the rounds end when no link is left
    (a logarithmic number for ids without order, such as hashes).  Each round's links and
    merges are tables in the shared folder, so a lost executor costs one round at most and
    nothing is collected.  Null ends, self-links and repeated links are ignored; no links
    give no rows.  The result reads the rounds' tables in ``folder``.
    """
    edges = write_scratch(
        links.select(F.col(a).alias("a"), F.col(b).alias("b"))
        .filter("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links", folder)
    steps = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = write_scratch(
            both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"))
            .select("node", F.least("node", "low").alias("root")), "step", folder)
        steps.append(step)
        left, right = step.toDF("a", "ra"), step.toDF("b", "rb")
        edges = write_scratch(
            edges.join(left, "a").join(right, "b").filter("ra <> rb")
            .select(F.greatest("ra", "rb").alias("a"), F.least("ra", "rb").alias("b")).distinct(),
            "links", folder)
    if not steps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = steps[0]
    for step in steps[1:]:
        nxt = step.toDF("root", "next")
        out = out.join(nxt, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return out
