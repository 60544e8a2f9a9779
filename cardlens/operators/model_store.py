"""Load-or-train store of fitted models.

A version is the digest of what decides a fit: task, kind, parameters, features,
category levels, and a fingerprint of the rows.  The fingerprint
is one aggregate over all rows and the columns of the fit (count, sum and
exclusive or of row hashes), so it does not depend on the order of the rows and
changes with any value.  A model is saved beside the versions and published by one
rename; a version without its marker file is none.  Two writers of one version
may both train; the first to publish wins and the other's copy is deleted.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import delete
from .models import FittedModel, write_text

MARKER = "_PUBLISHED"


def fingerprint(rows: DataFrame, columns: list[str]) -> str:
    """Digest of the rows as a multiset of values of ``columns``."""
    h = F.xxhash64(*[F.col(f"`{c}`") for c in columns])
    again = F.xxhash64(F.lit(17), *[F.col(f"`{c}`") for c in columns])
    r = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(h.cast("decimal(38,0)")).alias("s"), F.bit_xor(again).alias("x")).first()
    return hashlib.sha256(json.dumps([columns, r["n"], str(r["s"]), r["x"]]).encode()).hexdigest()


class ModelStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _exists(self, path: str) -> bool:
        at, fs = self._at(path)
        return fs.exists(at)

    def version(self, task: str, kind: str, rows: DataFrame, columns: list[str], **facts) -> str:
        """Name of the version that a fit on these rows would have."""
        decided = json.dumps([task, kind, fingerprint(rows, columns), facts], sort_keys=True, default=str)
        return f"{task}-{kind}-{hashlib.sha256(decided.encode()).hexdigest()[:32]}"

    def has(self, version: str) -> bool:
        return self._exists(f"{self.path}/{version}/{MARKER}")

    def versions(self) -> list[str]:
        """Published versions, oldest first."""
        at, fs = self._at(self.path)
        found = [(s.getModificationTime(), s.getPath().getName()) for s in fs.listStatus(at)] if fs.exists(at) else []
        return [name for _, name in sorted(found) if self.has(name)]

    def publish(self, version: str, save: Callable[[str], None]) -> str:
        """Write a version with ``save(path)`` and publish it, unless it is there."""
        target, staging = f"{self.path}/{version}", f"{self.path}/_staging-{uuid.uuid4().hex}"
        save(staging)
        write_text(staging, MARKER, version)
        to, fs = self._at(target)
        if not fs.exists(to):
            fs.rename(self._at(staging)[0], to)
        # another writer was first: a rename onto a folder fails or moves into it
        for left in (staging, f"{target}/{staging.rpartition('/')[2]}"):
            if self._exists(left):
                delete(self.spark, left)
        return target

    def load(self, version: str) -> FittedModel:
        if not self.has(version):
            raise KeyError(f"{version} is not in the store")
        return FittedModel.load(f"{self.path}/{version}")

    def load_or_train(self, version: str, train: Callable[[], FittedModel]) -> tuple[FittedModel, bool]:
        """The stored model, else a newly trained and published one; and whether it was trained."""
        if self.has(version):
            return self.load(version), False
        model = train()
        self.publish(version, model.save)
        return model, True
