"""A5 as a stream: additional weekly batches land as files; each file is
loaded exactly once.

The reference appends an extra week's CSV to the base data before
processing.  Here a file-source stream watches the landing folder; its
checkpoint (under the shared checkpoint folder) records which files were
taken, so re-running the job -- or losing an executor mid-batch -- loads
every file exactly once.  ``trigger(availableNow=True)`` processes what
has arrived and stops, which suits a scheduled batch load; a continuous
deployment drops the trigger.

``score_batches`` continues the chain for new rows: join to the customer
dimension (D1), cleansing with statistics fitted on the base portfolio (B2-B4
need global modes, which a stream cannot recompute), and the score/band/flag
columns (C1-C6).  Accounts whose customer is not known yet wait in a pending
table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import cleanse, scoring
from ..sources.csv import REJECT, file_schema, normalize_values, shaped
from ..sources.schema import CC_SCHEMA
from ..sources.tables import conform, delete


def read_account_batches(spark: SparkSession, landing_dir: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming scan of CSV batch files (A1, A6, B1).  Columns go by the header
    of the files there at the start; a later file with other columns, or the
    same in another order, stops the query instead of being read by position.
    Lines that do not fit the schema are left out (``csv.rejects`` lists them)."""
    read, names = file_schema(spark, landing_dir, CC_SCHEMA)
    r = (spark.readStream.schema(read).option("header", True).option("enforceSchema", False)
         .option("columnNameOfCorruptRecord", REJECT))
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    raw = shaped(r.csv(landing_dir), names, CC_SCHEMA)
    return conform(cleanse.parse_dates(normalize_values(raw)), CC_SCHEMA)


def load_new_batches(spark: SparkSession, landing_dir: str, table_path: str, checkpoint_path: str,
                     available_now: bool = True) -> StreamingQuery:
    """Append every not-yet-loaded batch file to the parquet table."""
    w = (read_account_batches(spark, landing_dir).writeStream.format("parquet")
         .option("checkpointLocation", checkpoint_path).outputMode("append"))
    if available_now:
        w = w.trigger(availableNow=True)
    return w.start(table_path)


def fitted_modes(base: DataFrame) -> dict:
    """Modes of the non-numeric columns of a base (joined) portfolio."""
    return cleanse.column_modes(base, cleanse.mode_columns(base))


def score_stream(accounts: DataFrame, customers: DataFrame, modes: dict) -> DataFrame:
    """D1 (stream-static join) -> B2/B3/B4 with fitted modes -> C1-C6."""
    j = cleanse.fill_numeric(scoring.join_profile(accounts, customers))
    return scoring.add_scores(cleanse.fill_default(cleanse.apply_modes(j, {c: m for c, m in modes.items() if c in j.columns})))


def score_batches(spark: SparkSession, landing_dir: str, customers, modes: dict, table_path: str,
                  checkpoint_path: str, pending_path: str, available_now: bool = True) -> StreamingQuery:
    """Score each landed account once its customer is known.

    ``customers`` is the customer table, or a function that reads it anew for each batch.  A
    micro-batch joins its accounts and those still pending to the customers:
    matched rows are scored into ``table_path``, the others wait in
    ``pending_path`` for the next batch.  Both are written under the batch's
    number, and an attempt that is repeated overwrites its own output and drops
    what ``score_pending`` made of it since, so an account is scored exactly once
    however late its customer comes.  A batch without new files starts no job;
    ``score_pending`` takes up what waits."""
    read = customers if callable(customers) else (lambda: customers)

    def take(df: DataFrame, n: int) -> None:
        part = f"batch={n:012d}"
        for path in (table_path, pending_path):  # scored rows first: what is lost in between is still pending
            for later in _parts(spark, path, finished=False):
                if later.startswith(f"{part}-"):
                    delete(spark, f"{path}/{later}")
        _score_batch(df, part, _pending(spark, pending_path, n), read(), modes, table_path, pending_path)

    w = (read_account_batches(spark, landing_dir).writeStream.option("checkpointLocation", checkpoint_path).outputMode("append")
         .foreachBatch(take))
    if available_now:
        w = w.trigger(availableNow=True)
    return w.start()


def score_pending(spark: SparkSession, customers: DataFrame, modes: dict, table_path: str, pending_path: str) -> None:
    """Score the pending accounts whose customers have come since.  What still
    waits replaces the pending table's latest part."""
    last = _last_part(spark, pending_path)
    if last is None:
        return
    waiting = spark.read.schema(CC_SCHEMA).parquet(f"{pending_path}/{last}")
    name, _, tries = last.partition("-")
    _score_batch(None, f"{name}-{int(tries or 0) + 1:04d}", waiting, customers, modes, table_path, pending_path)


def _parts(spark: SparkSession, path: str, finished: bool = True) -> list[str]:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    done = [f.getPath() for f in fs.listStatus(at)]
    return sorted(p.getName() for p in done if p.getName().startswith("batch=")
                  and (not finished or fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))))


def _last_part(spark: SparkSession, path: str, before: str | None = None) -> str | None:
    """The latest finished part, or the latest of an earlier batch."""
    parts = [p for p in _parts(spark, path) if before is None or p.partition("-")[0] < before]
    return parts[-1] if parts else None


def _pending(spark: SparkSession, pending_path: str, n: int) -> DataFrame | None:
    last = _last_part(spark, pending_path, f"batch={n:012d}")
    return None if last is None else spark.read.schema(CC_SCHEMA).parquet(f"{pending_path}/{last}")


def _score_batch(new: DataFrame | None, part: str, waiting: DataFrame | None, customers: DataFrame, modes: dict,
                 table_path: str, pending_path: str) -> None:
    accounts = waiting if new is None else new if waiting is None else new.unionByName(waiting)
    known = customers.select("Client_Num").distinct()
    score_stream(accounts, customers, modes).write.mode("overwrite").parquet(f"{table_path}/{part}")
    accounts.join(known, "Client_Num", "left_anti").select(*CC_SCHEMA.names).write.mode("overwrite").parquet(f"{pending_path}/{part}")


def scored_accounts(spark: SparkSession, table_path: str) -> DataFrame:
    """All scored accounts."""
    return spark.read.option("basePath", table_path).option("recursiveFileLookup", True).parquet(table_path)
