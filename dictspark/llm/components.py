"""Connected components of an edge table by repeated joins; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dictspark.llm.common import discard, materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, comp) for every id of the edges; comp is the smallest id that it reaches.

    Each round takes the least label of all neighbours, then the label of that label, so that chains shorten by
    half. Rounds go on until no label changes; each is a table in the shared folder. Edges with a null end are left
    out, repeated edges and loops do no harm, an empty table gives no rows.
    """
    ab = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    both = materialize(ab.unionByName(ab.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    labels = materialize(both.groupBy(F.col("u").alias("id")).agg(F.least(F.col("u"), F.min("v")).alias("comp"), F.lit(True).alias("moved")), "labels")
    while not labels.where("moved").isEmpty():
        near = both.join(labels.select(F.col("id").alias("v"), "comp"), "v").groupBy(F.col("u").alias("id")).agg(F.min("comp").alias("near"))
        step = labels.join(near, "id").select("id", F.col("comp").alias("was"), F.least("comp", "near").alias("to"))
        far = labels.select(F.col("id").alias("to"), F.col("comp").alias("far"))
        before, labels = labels, materialize(step.join(far, "to").select("id", F.least("to", "far").alias("comp"), (F.least("to", "far") < F.col("was")).alias("moved")), "labels")
        discard(before)
    discard(both)
    return labels.select("id", "comp")
