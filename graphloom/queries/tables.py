"""The driver's tables as virtual graphs."""

from __future__ import annotations

from pyspark.sql import SparkSession

from graphloom.engine import Engine
from graphloom.sources.mapping import Mapping

RESTRICTED = frozenset({"finance"})

MAPPINGS = [
    Mapping("region", "r_regionkey"),
    Mapping("nation", "n_nationkey", (("n_regionkey", "region"),)),
    Mapping("customer", "c_custkey", (("c_nationkey", "nation"),)),
    Mapping("supplier", "s_suppkey", (("s_nationkey", "nation"),), labels=RESTRICTED),
    Mapping("part", "p_partkey"),
    Mapping("orders", "o_orderkey", (("o_custkey", "customer"),)),
    Mapping("lineitem", None, (("l_orderkey", "orders"), ("l_partkey", "part"), ("l_suppkey", "supplier"))),
    Mapping("events", "event_id", (("user_id", "customer"),), ("props",)),
    Mapping("documents", "doc_id", (), ("text", "loaded_at", "created_at", "dataset_id")),
    Mapping("embeddings", "vec_id", (), ("embedding",)),
]
ALL = frozenset({"public", "finance"})


#: Table frames by session and folder: their schemas are read once.
_FRAMES: dict[tuple[str, str], dict] = {}


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    frames = _FRAMES.setdefault((spark.sparkContext.applicationId, sf_dir), {})
    return Engine.over_tables(spark, sf_dir, MAPPINGS, frames=frames)
