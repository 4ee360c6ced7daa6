"""Keys that go on from batch to batch.

A ledger folder has one small file a claim, numbered from 0: which batch, its first key and how
many. A claim is a file renamed to the next number, which a store like HDFS does for one
writer only; who loses reads on and tries the next (a local disk is for one writer). A batch that claims again, after a failure or by a second run, gets its
old block. The ledger is as long as there were batches and is read by the driver alone.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from .integrity import dense_keys


def _folder(spark: SparkSession, ledger: str):
    """The ledger's file system and path, made if it is not there."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    path = hadoop.Path(ledger)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path)
    return files, path


def claims(spark: SparkSession, ledger: str) -> list[dict]:
    """The claims of a ledger in order: batch, start, count."""
    files, path = _folder(spark, ledger)
    names = sorted(s.getPath().getName() for s in files.listStatus(path) if s.getPath().getName().endswith(".json"))
    out = []
    for name in names:
        lines = spark.sparkContext.wholeTextFiles(f"{ledger.rstrip('/')}/{name}").values().collect()
        out.append(json.loads(lines[0]))
    return out


def claim(spark: SparkSession, ledger: str, batch: str, count: int, start: int = 1) -> int:
    """The first key of a block of ``count`` keys for ``batch``: the old one if it has one, else behind all others (``start`` in an empty ledger).

    A batch that comes again with another count is refused, as its keys would not be those it had.
    """
    files, path = _folder(spark, ledger)
    hadoop = spark._jvm.org.apache.hadoop.fs
    while True:
        made = claims(spark, ledger)
        for c in made:
            if c["batch"] == batch:
                if c["count"] != count:
                    raise ValueError(f"batch {batch!r} had {c['count']} rows and now has {count}")
                return c["start"]
        first = made[-1]["start"] + made[-1]["count"] if made else start
        text = json.dumps({"batch": batch, "start": first, "count": count})
        whole = hadoop.Path(path, f"_{batch_name(batch)}-{len(made)}.tmp")
        out = files.create(whole, True)
        out.write(bytearray(text.encode()))
        out.close()
        # a rename onto a name that is there fails, so a claim is there whole or not at all
        target = hadoop.Path(path, f"{len(made):012d}.json")
        if not files.exists(target) and files.rename(whole, target):
            settled = claims(spark, ledger)
            if settled[len(made)]["batch"] == batch:
                return first


def batch_name(batch: str) -> str:
    """A batch's name as part of a file's."""
    return batch.encode().hex()


def continued_keys(df: DataFrame, order_by: Sequence[str], ledger: str, batch: str, name: str = "id", start: int = 1) -> DataFrame:
    """``integrity.dense_keys`` that go on where the batches before ended; the same batch again gets the same keys."""
    return dense_keys(df, order_by, name, claim(df.sparkSession, ledger, batch, df.count(), start))
