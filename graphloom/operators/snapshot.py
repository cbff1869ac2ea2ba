"""Immutable snapshots of a dataset: quads, adjacency and indexes as Parquet, published by one rename of a manifest."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.graph import adjacency, capability_index, term_key
from graphloom.plans.algebra import XSD
from graphloom.plans.values import DEC, DOUBLES, INTEGERS
from graphloom.sources.rdf import normalized


class Conflict(RuntimeError):
    """Another snapshot was published first."""


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def _write(spark: SparkSession, path: str, text: str) -> None:
    fs, of = _fs(spark, path)
    tmp = of(f"{path}.{uuid.uuid4().hex}")
    out = fs.create(tmp, False)
    out.write(bytearray(text.encode()))
    out.close()
    if not fs.rename(tmp, of(path)):
        fs.delete(tmp, False)
        raise Conflict(path)


def _read(spark: SparkSession, path: str) -> str | None:
    fs, of = _fs(spark, path)
    if not fs.exists(of(path)):
        return None
    return "".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())


@dataclass(frozen=True)
class Snapshot:
    root: str
    number: int
    manifest: dict

    def quads(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.root}/{self.manifest['folder']}/quads").select("s", "p", "o", "g")

    def adjacency(self, spark: SparkSession, forward: bool = True) -> DataFrame:
        """Edges laid out and sorted by their anchor, so that a lookup of one reads few row groups."""
        return spark.read.parquet(f"{self.root}/{self.manifest['folder']}/adjacency_{'out' if forward else 'in'}")

    def closure(self, spark: SparkSession) -> DataFrame | None:
        """Consequences (s, p, o, support), if the snapshot was published with them."""
        return spark.read.parquet(f"{self.root}/{self.manifest['folder']}/closure") if self.manifest.get("closure") else None

    def capabilities(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.root}/{self.manifest['folder']}/capabilities")


def spine(quads: DataFrame, terms: DataFrame) -> DataFrame:
    """Facts as typed columns: ids of the dictionary for subjects, predicates and object IRIs or blank nodes, native values for literals.

    (fact_id, subject, predicate, object, value_bool, value_int, value_double, value_decimal, value_time, value_text, datatype, language, g).
    A literal whose text isn't of its type stays text.
    """
    facts = normalized(quads)
    d = terms.select("term_key", "id")
    for name, key in (("subject", term_key(F.col("s"))), ("predicate", F.concat(F.lit("1\0"), F.col("p"), F.lit("\0\0"))), ("object", F.when(F.col("o.k") < 3, term_key(F.col("o"))))):
        facts = facts.withColumn("__k", key).join(d.select(F.col("term_key").alias("__k"), F.col("id").alias(name)), "__k", "left").drop("__k")
    v, t = F.col("o.v"), F.col("o.d")
    native = {
        "value_bool": F.when(t == XSD + "boolean", F.when(v.isin("true", "1"), True).when(v.isin("false", "0"), False)), "value_int": F.when(t.isin(*INTEGERS), v.try_cast("bigint")),
        "value_double": F.when(t.isin(*DOUBLES), F.regexp_replace(v, "INF$", "Infinity").try_cast("double")), "value_decimal": F.when(t == XSD + "decimal", v.try_cast(DEC)), "value_time": F.when(t == XSD + "dateTime", v.try_cast("timestamp")),
    }
    facts = facts.withColumns(native)
    text = F.when((F.col("o.k") == 3) & ~F.greatest(*[F.col(c).isNotNull() for c in native]), v)
    return facts.select("fact_id", "subject", "predicate", "object", *native, text.alias("value_text"), F.when(F.col("o.k") == 3, t).alias("datatype"), F.col("o.l").alias("language"), "g")


def write_spine(quads: DataFrame, terms: DataFrame, path: str) -> None:
    """The spine as Parquet, laid out by graph, predicate and subject, so that a pattern reads few row groups."""
    spine(quads, terms).repartitionByRange("g", "predicate", "subject").sortWithinPartitions("g", "predicate", "subject").write.parquet(path)


def write_payload(rows: DataFrame, key: str, columns: list[str], path: str) -> None:
    """Payload columns by their key, laid out so that the files' statistics locate a key's rows."""
    rows.where(F.col(key).isNotNull()).select(key, *columns).repartitionByRange(key).sortWithinPartitions(key).write.parquet(path)


def publish(quads: DataFrame, root: str, expected: int | None = None, closure: DataFrame | None = None) -> Snapshot:
    """Writes a snapshot and makes it current; Conflict if the current one isn't the one expected.

    Quads are laid out by graph and predicate, so that a scope and a pattern read few row groups.
    Files are in place before their manifest is; a manifest's name is taken only once. closure: of
    materialize(), kept with the graphs that support each consequence.
    """
    spark = quads.sparkSession
    now = current(spark, root)
    number = now.number if now else 0
    if expected is not None and expected != number:
        raise Conflict(f"current is {number}, expected {expected}")
    folder = f"snapshot-{uuid.uuid4().hex}"
    facts = normalized(quads)
    (facts.repartitionByRange("g", "p", F.col("s.v")).sortWithinPartitions("g", "p", F.col("s.v")).write.parquet(f"{root}/{folder}/quads"))
    stored = spark.read.parquet(f"{root}/{folder}/quads")
    capability_index(stored).coalesce(1).write.parquet(f"{root}/{folder}/capabilities")
    for forward in (True, False):
        adjacency(stored, forward).write.parquet(f"{root}/{folder}/adjacency_{'out' if forward else 'in'}")
    if closure is not None:
        closure.repartitionByRange("p", F.col("s.v")).sortWithinPartitions("p", F.col("s.v")).write.parquet(f"{root}/{folder}/closure")
    digest = stored.agg(F.count(F.lit(1)).alias("n"), F.sum(F.conv(F.substring("fact_id", 1, 12), 16, 10).cast("decimal(38,0)")).alias("d")).first()
    manifest = {"folder": folder, "facts": digest.n, "digest": str(digest.d or 0), "closure": closure is not None}
    _write(spark, f"{root}/manifest-{number + 1:012d}.json", json.dumps(manifest))
    return Snapshot(root, number + 1, manifest)


def current(spark: SparkSession, root: str) -> Snapshot | None:
    fs, of = _fs(spark, root)
    if not fs.exists(of(root)):
        return None
    names = sorted(s.getPath().getName() for s in fs.listStatus(of(root)) if s.getPath().getName().startswith("manifest-") and s.getPath().getName().endswith(".json"))
    if not names:
        return None
    return Snapshot(root, int(names[-1][9:-5]), json.loads(_read(spark, f"{root}/{names[-1]}")))
