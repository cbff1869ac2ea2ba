"""A small cache of query results on shared storage, keyed by all that an answer depends on."""

from __future__ import annotations

import json
from hashlib import sha256

from pyspark.sql import DataFrame

from graphloom.engine import PUBLIC, Engine
from graphloom.plans.parser import parse


class ResultCache:
    """Results as Parquet under a root folder; volatile queries are never kept."""

    def __init__(self, engine: Engine, root: str, snapshot: str):
        self.engine, self.root, self.snapshot = engine, root, snapshot
        self.hits = 0

    def key(self, text: str, principal: frozenset[str]) -> str:
        query = parse(text)
        active, how = self.engine.catalog.resolve(principal, query)
        parts = [self.snapshot, repr(query), sorted(principal), sorted(active.default), sorted(active.named), how]
        return sha256(json.dumps(parts).encode()).hexdigest()

    def query(self, text: str, principal: frozenset[str] = PUBLIC) -> DataFrame:
        spark = self.engine.spark
        if parse(text).volatile or parse(text).ordered:
            return self.engine.query(text, principal)
        path = f"{self.root}/{self.key(text, principal)}"
        jvm = spark.sparkContext._jvm
        done = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        if done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
            self.hits += 1
        else:
            self.engine.query(text, principal).write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)
