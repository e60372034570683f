"""The time-aware release graph: owners, validity ranges and the interval join."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import when_ms
from ..schema import NEEDS, OWNS, RELEASE, Graph
from ..sources.scratch import checkpointed
from .attrs import having


def owners(g: Graph) -> DataFrame:
    """release, artifact: the last ownership edge wins."""
    return g.label(OWNS).groupBy(F.col("dst").alias("release")).agg(F.max_by("src", "edge_seq").alias("artifact"))


def ranges(g: Graph) -> DataFrame:
    """release, artifact, lo, hi: valid from its time up to the next release's; the last is open (null)."""
    timed = owners(g).join(g.kind(RELEASE), F.col("release") == F.col("node_id")).select("artifact", "release", when_ms(F.col("timestamp")).alias("lo"), "node_seq")
    w = Window.partitionBy("artifact").orderBy("lo", "node_seq")
    return timed.select("release", "artifact", "lo", F.lead("lo").over(w).alias("hi"))


def histories(g: Graph) -> DataFrame:
    """artifact, releases: names in time order."""
    return ranges(g).groupBy("artifact").agg(F.array_sort(F.collect_list(F.struct("lo", "release"))).alias("h")).select("artifact", F.transform("h", lambda x: x["release"]).alias("releases"))


#: Dependants times releases of an artifact from which its time is cut into so many bins, so that no key holds them all.
HOT_PAIRS, BINS = 10_000_000, 256


def release_graph(g: Graph, targets: str = "all") -> DataFrame:
    """src, dst: a release that needs an artifact points to that artifact's releases out in its validity range.

    The equi-key on the artifact keeps it a hash or merge join; the range is a residual condition. The time of an
    artifact with many dependants and releases is cut into bins that are part of the key, of equal length from its
    first to its last release: a range is in each bin it meets, a release in its own.
    targets: ``all``, or ``cve`` for strictly vulnerable releases only.
    """
    r = checkpointed(ranges(g))
    needs = g.label(NEEDS).select("src", F.col("dst").alias("artifact"))
    sources = needs.join(r.select(F.col("release").alias("src"), F.col("lo").alias("from"), F.col("hi").alias("to")), "src")
    aimed = r.select("artifact", F.col("release").alias("dst"), F.col("lo").alias("ts"))
    if targets == "cve":
        aimed = aimed.join(having(g), F.col("dst") == F.col("owner"), "left_semi")
    sizes = needs.groupBy("artifact").agg(F.count("*").alias("n")).join(r.groupBy("artifact").agg(F.count("*").alias("m"), F.min("lo").alias("t0"), F.max("lo").alias("t1")), "artifact")
    hot = checkpointed(sizes.where(F.col("n") * F.col("m") >= HOT_PAIRS).select("artifact", "t0", ((F.col("t1") - F.col("t0")) / BINS + 1).cast("bigint").alias("width")))
    if not hot.isEmpty():
        spot = lambda c: F.least(F.greatest(F.floor((F.col(c) - F.col("t0")) / F.col("width")), F.lit(0)), F.lit(BINS - 1)).cast("int")
        cold = F.col("width").isNull()
        bins = F.when(cold, F.array(F.lit(-1))).otherwise(F.sequence(spot("from"), F.greatest(F.when(F.col("to").isNull(), BINS - 1).otherwise(spot("to")), spot("from"))))
        sources = sources.join(hot, "artifact", "left").select("src", "artifact", "from", "to", F.explode(bins).alias("bin"))
        aimed = aimed.join(hot, "artifact", "left").select("artifact", "dst", "ts", F.when(cold, -1).otherwise(spot("ts")).alias("bin"))
    key = ["artifact"] if "bin" not in aimed.columns else ["artifact", "bin"]
    hits = sources.join(aimed, key).where((F.col("ts") >= F.col("from")) & (F.col("to").isNull() | (F.col("ts") < F.col("to"))))
    return hits.select("src", "dst").distinct()


def two_hops(g: Graph, sources: DataFrame | None = None) -> DataFrame:
    """artifact, neighbor: artifact to release to another artifact. sources: owners that both edges must start from."""
    owns, needs = g.label(OWNS).select(F.col("src").alias("artifact"), F.col("dst").alias("release")), g.label(NEEDS).select(F.col("src").alias("release"), F.col("dst").alias("neighbor"))
    if sources is not None:
        owns = owns.join(sources, F.col("artifact") == F.col("owner"), "left_semi")
        needs = needs.join(sources, F.col("release") == F.col("owner"), "left_semi")
    return owns.join(needs, "release").where("artifact <> neighbor").select("artifact", "neighbor").distinct()


def ownership_edges(g: Graph) -> DataFrame:
    """src, dst of the dependency and ownership edges."""
    return g.edges.where(F.col("label").isin(NEEDS, OWNS)).select("src", "dst")


def adjacency(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").agg(F.array_sort(F.collect_list("dst")).alias("targets"))
