"""A keyed table kept as a log of batches, with levelled compaction and a manifest of day ranges.

Every batch of a stream appends a folder of its rows; nothing is rewritten in place. When a
level holds FANOUT runs, they are merged into one run of the next level, cut by month. The
manifest lists each folder with its level, its batches and the first and last day in it, so a
merge or a read for some days opens only folders whose days overlap. A new manifest is written
aside and renamed, so readers see the state before or after a batch and never between.

A replayed batch changes nothing: its number is already covered, or, if it failed before its
manifest came, its folders are overwritten with the same rows.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

#: How rows of one key from several batches become one.
RULES = ("sum", "newest", "oldest")


class BatchLog:
    """``schema`` names the key columns first, then the values; ``day`` is a date or timestamp among the keys.

    ``rule``: "sum" adds the values of a key up over batches, "newest" keeps those of the latest
    batch that has the key, "oldest" those of the first one, and stores no others.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys, day: str, rule: str = "newest", fanout: int = 4):
        if rule not in RULES:
            raise ValueError(f"rule must be one of {RULES}")
        self.spark, self.path, self.keys, self.day, self.rule, self.fanout = spark, path.rstrip("/"), list(keys), day, rule, fanout
        self.values = [f for f in schema.names if f not in self.keys]
        self.schema = schema
        self.stored = T.StructType([*schema.fields, T.StructField("batch", T.LongType()), T.StructField("month", T.StringType())])

    # --- the manifest ---

    def _fs(self):
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return root.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _versions(self) -> list[int]:
        fs, path = self._fs()
        folder = path(f"{self.path}/manifest")
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return sorted(int(n.split(".")[0]) for n in names if n.endswith(".json") and n.split(".")[0].isdigit())

    def manifest(self) -> dict:
        versions = self._versions()
        if not versions:
            return {"last_batch": -1, "entries": []}
        file = f"{self.path}/manifest/{versions[-1]:012d}.json"
        return json.loads(self.spark.read.option("wholetext", True).text(file).first().value)

    def _save(self, manifest: dict) -> None:
        fs, path = self._fs()
        version = (self._versions() or [0])[-1] + 1
        aside, place = (path(f"{self.path}/manifest/{version:012d}.{kind}") for kind in ("tmp", "json"))
        out = fs.create(aside, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if not fs.rename(aside, place):
            raise RuntimeError(f"another writer has made manifest {version} of {self.path}")

    def overlapping(self, first_day=None, last_day=None, manifest=None) -> list[dict]:
        """The folders that can hold days from ``first_day`` to ``last_day`` (ISO text; None: open)."""
        return [e for e in (manifest or self.manifest())["entries"]
                if (last_day is None or e["first_day"] <= last_day) and (first_day is None or e["last_day"] >= first_day)]

    # --- rows ---

    def _rows(self, entries, spark=None) -> DataFrame:
        spark = spark or self.spark
        if not entries:
            return spark.createDataFrame([], self.stored)
        return spark.read.schema(self.stored).parquet(*[f"{self.path}/{e['folder']}" for e in entries])

    def _merged(self, rows: DataFrame) -> DataFrame:
        """One row per key, with the newest batch in it (the oldest for "oldest")."""
        if self.rule == "sum":
            return rows.groupBy(*self.keys).agg(*[F.sum(v).alias(v) for v in self.values], F.max("batch").alias("batch"))
        pick = F.max_by if self.rule == "newest" else F.min_by
        picked = rows.groupBy(*self.keys).agg(pick(F.struct(*self.values, "batch"), "batch").alias("v"))
        return picked.select(*self.keys, "v.*")

    def _write(self, rows: DataFrame, folder: str, level: int, first: int, last: int) -> list[dict]:
        """Write ``rows`` cut by month; the entries of the folders that have rows."""
        place = f"{self.path}/{folder}"
        month = F.date_format(self.day, "yyyy-MM")
        out = rows.select(*self.schema.names, "batch", F.coalesce(month, F.lit("none")).alias("month"))
        if level:  # a month's rows from all tasks meet in a few files
            out = out.repartition("month", F.pmod(F.xxhash64(*self.keys), F.lit(8)))
        out.withColumn("part", F.col("month")).write.mode("overwrite").partitionBy("part").parquet(place)
        whole = T.StructType([*self.stored.fields, T.StructField("part", T.StringType())])
        day = F.date_format(self.day, "yyyy-MM-dd")
        ranges = rows.sparkSession.read.schema(whole).parquet(place).groupBy("part").agg(
            F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.count(F.lit(1)).alias("rows")).collect()
        return [{"folder": f"{folder}/part={r.part}", "level": level, "first_batch": first, "last_batch": last,
                 "first_day": r.first_day or "", "last_day": r.last_day or "9999", "rows": r.rows} for r in sorted(ranges)]

    def commit(self, rows: DataFrame, batch_id: int) -> None:
        """Add the rows of a batch, one per key, and compact the levels that are full."""
        manifest = self.manifest()
        if batch_id <= manifest["last_batch"]:
            return
        rows = rows.select(*self.schema.names)
        if self.rule == "oldest" and manifest["entries"]:
            day = F.date_format(self.day, "yyyy-MM-dd")
            span = rows.agg(F.min(day).alias("lo"), F.max(day).alias("hi")).first()
            known = self._rows(self.overlapping(span.lo, span.hi, manifest), rows.sparkSession)
            rows = rows.join(known.select(*self.keys), self.keys, "left_anti")
        rows = rows.withColumn("batch", F.lit(batch_id).cast("long"))
        entries = manifest["entries"] + self._write(rows, f"batch-{batch_id}", 0, batch_id, batch_id)
        level = 0
        while True:
            own = [e for e in entries if e["level"] == level]
            runs = {(e["first_batch"], e["last_batch"]) for e in own}
            if len(runs) < self.fanout:
                break
            first, last = min(r[0] for r in runs), max(r[1] for r in runs)
            merged = self._merged(self._rows(own, rows.sparkSession))
            entries = [e for e in entries if e["level"] != level] + self._write(
                merged, f"level-{level + 1}-{first}-{last}", level + 1, first, last)
            level += 1
        self._save({"last_batch": batch_id, "entries": entries})

    def read(self, first_day=None, last_day=None) -> DataFrame:
        """The table, or its rows of some days, from the folders that overlap them."""
        rows = self._rows(self.overlapping(first_day, last_day))
        day = F.to_date(self.day)
        if first_day is not None:
            rows = rows.where(day >= F.lit(first_day).cast("date"))
        if last_day is not None:
            rows = rows.where(day <= F.lit(last_day).cast("date"))
        return self._merged(rows).select(*self.schema.names)

    def vacuum(self) -> list[str]:
        """Remove the folders that the newest manifest doesn't list, and older manifests; readers of
        these must have ended. Returns what was removed."""
        fs, path = self._fs()
        used = {e["folder"].split("/")[0] for e in self.manifest()["entries"]}
        there = [s.getPath().getName() for s in fs.listStatus(path(self.path))]
        gone = [n for n in there if n.startswith(("batch-", "level-")) and n not in used]
        gone += [f"manifest/{v:012d}.json" for v in self._versions()[:-1]]
        for name in gone:
            fs.delete(path(f"{self.path}/{name}"), True)
        return gone


def run_into(stream: DataFrame, log: BatchLog, shape=lambda rows: rows, mode: str = "append") -> BatchLog:
    """Process what is there in ``mode`` and commit each batch, brought into form by ``shape``."""
    (stream.writeStream.foreachBatch(lambda rows, batch_id: log.commit(shape(rows), batch_id)).outputMode(mode)
     .option("checkpointLocation", log.path + "-checkpoint").trigger(availableNow=True).start().awaitTermination())
    return log
