"""Deliveries of micro-batches, recorded so that one that is done again sends only what was not sent.

A finding's id comes from its micro-batch, rule and place. Channels that talk to a server get rows in
``mapInPandas`` and give back which ids went out; that is a table of the ledger, so a server that fails after half of the
messages leaves a record of the half. Channels of files and tables replace what the same
micro-batch wrote before. Others are sent whole or not at all.

A task whose executor is lost while it sends leaves no record: what it sent goes out again.
"""

from __future__ import annotations

import logging
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger("redactory")
#: What the ledger keeps of a delivery.
DELIVERY = "delivery string, ok boolean, error string"
#: What a finding's id is made of, besides its micro-batch.
IDENTITY = ["database", "rule_id", "schema_name", "table_name", "column_name", "lsn", "place", "value_hash"]


class Ledger:
    """Below ``folder``, a folder for each micro-batch and channel, with a table for each attempt."""

    def __init__(self, spark: SparkSession, folder: str, job: str):
        self.spark, self.folder, self.job = spark, folder.rstrip("/"), job
        self.path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        at = self.path(folder)
        return sorted(f.getPath().getName() for f in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def forget(self, number: int) -> None:
        """Drop the records of micro-batches that can no longer be done again."""
        for name in self._names(self.folder):
            if int(name) < number - 1:
                self.fs.delete(self.path(f"{self.folder}/{name}"), True)

    def identified(self, findings: DataFrame, number: int) -> DataFrame:
        """``findings`` with ``delivery``; equal ids, which events without keys can have, are told apart by a number."""
        parts = [F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in IDENTITY if c in findings.columns]
        keys = F.to_json(F.col("primary_keys")) if "primary_keys" in findings.columns else F.lit("")
        return findings.withColumn("delivery", F.sha2(F.concat_ws("\1", F.lit(number), *parts, keys).cast("binary"), 256))

    def sent(self, number: int, channel: str) -> DataFrame | None:
        """Ids that went out in earlier attempts."""
        at = f"{self.folder}/{number}/{channel}"
        done = [f"{at}/{n}" for n in self._names(at) if self.fs.exists(self.path(f"{at}/{n}/_SUCCESS"))]
        return self.spark.read.schema(DELIVERY).parquet(*done).where("ok").select("delivery").distinct() if done else None

    def deliver(self, channel, findings: DataFrame, number: int) -> Counter:
        """Send what has not been sent; returns how many findings went out now, by ``ok`` and ``error``."""
        rows, before = self.identified(findings, number), self.sent(number, channel.name)
        if before is not None:
            rows = rows.join(before, "delivery", "left_anti")
        at = f"{self.folder}/{number}/{channel.name}"
        attempt = f"{at}/{len(self._names(at)):06d}"
        sender = channel.sender()
        if sender is None:
            rows = rows.persist()
            try:
                if rows.isEmpty():
                    return Counter()
                channel.put(rows.drop("delivery"), self.job, number)
                done = rows.select("delivery", F.lit(True).alias("ok"), F.lit(None).cast("string").alias("error"))
                done.write.parquet(attempt)
                return Counter(ok=rows.count())
            finally:
                rows.unpersist()
        return self._recorded(channel, rows.select("delivery", channel.body().alias("body")).mapInPandas(sender, DELIVERY), attempt)

    def messages(self, channel, rows: DataFrame, number: int) -> Counter:
        """The same for messages that are put together already: rows ``(shard, bodies)``."""
        named = rows.withColumn("delivery", F.sha2(F.concat_ws("\1", F.lit(number), "shard", F.to_json("bodies")).cast("binary"), 256))
        before = self.sent(number, channel.name)
        rest = named.join(before, "delivery", "left_anti") if before is not None else named
        at = f"{self.folder}/{number}/{channel.name}"
        return self._recorded(channel, rest.select("delivery", "bodies").mapInPandas(channel.message_sender(), DELIVERY), f"{at}/{len(self._names(at)):06d}")

    def _recorded(self, channel, done: DataFrame, attempt: str) -> Counter:
        done.write.parquet(attempt)
        said = self.spark.read.schema(DELIVERY).parquet(attempt).groupBy("ok").agg(F.count("*").alias("n"), F.min("error").alias("error")).collect()
        for r in said:
            if not r.ok:
                log.error("channel %s failed for %d findings: %s", channel.name, r.n, r.error)
        return Counter({"ok" if r.ok else "error": r.n for r in said})
