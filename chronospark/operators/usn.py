"""Change-journal operators: rename pairs and paths through parent references."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_DEPTH = 32
#: Update sequence numbers of the two records of one renaming lie no further apart.
DISTANCE = 1


def rename_pairs(records: DataFrame, by: list[str], order: list[str], old: str, new: str, file: str = "file", reason: str = "reason", name: str | None = None, usn: str | None = None, distance: int = DISTANCE) -> DataFrame:
    """Neighbours (old name, then new name) of one file, each record used once: ``by``, first and second order keys.

    With ``name`` both records must have one, and with ``usn`` their numbers may differ by ``distance`` at most. Runs of pairable neighbours are islands; within one, every other record begins a pair.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    pairable = (F.col(reason) == old) & (F.lead(reason).over(w) == new) & (F.col(file) == F.lead(file).over(w))
    if name:
        pairable &= F.col(name).isNotNull() & F.lead(name).over(w).isNotNull()
    if usn:
        pairable &= F.abs(F.lead(usn).over(w) - F.col(usn)) <= distance
    n = records.withColumn("pairable", F.coalesce(pairable, F.lit(False))).withColumn("second", F.lead(order[-1]).over(w)).withColumn("n", F.row_number().over(w))
    island = n.withColumn("island", F.col("n") - F.row_number().over(Window.partitionBy(*by, "pairable").orderBy(*order)))
    place = F.row_number().over(Window.partitionBy(*by, "pairable", "island").orderBy(*order))
    return island.withColumn("place", place).where("pairable AND place % 2 = 1").select(*by, F.col(order[-1]).alias("first"), "second", file)


def resolve_paths(nodes: DataFrame, separator: str = "\\", depth: int = MAX_DEPTH, order: str | None = None) -> DataFrame:
    """(id, path, complete) from (id, parent, name): the chain of names up to a node without a parent, at most ``depth``.

    Of several records of a node the first by ``order`` that has a name counts (without ``order``, that with the smallest name). An unknown parent or a chain that is too long (or circular) gives a partial path. Chains double their length each
    round, so log2(depth) joins suffice.
    """
    key = F.struct(*([order] if order else []), "name", "parent")
    known = nodes.where("name <> ''").groupBy("id").agg(F.min(F.struct(key.alias("k"), "parent", "name")).alias("x")).select("id", "x.parent", "x.name")
    now = known.select("id", F.array("name").alias("names"), F.col("parent").alias("up"))
    rounds = max(1, (depth - 1).bit_length())
    for _ in range(rounds):
        above = now.select(F.col("id").alias("a_id"), F.col("names").alias("a_names"), F.col("up").alias("a_up"))
        joined = now.join(above, now.up == above.a_id, "left")
        now = joined.select("id", F.when(F.col("a_id").isNull(), F.col("names")).otherwise(F.slice(F.concat("names", "a_names"), 1, depth)).alias("names"), F.when(F.col("a_id").isNull(), F.col("up")).otherwise(F.col("a_up")).alias("up"))
    return now.select("id", F.array_join(F.reverse("names"), separator).alias("path"), (F.col("up").isNull() & (F.size("names") <= depth)).alias("complete"))
