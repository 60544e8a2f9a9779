"""Secret scan with corpus-wide ownership frequency (operator 3).

A scan of each text finds candidates: values assigned to a credential name,
access keys, long hex strings, and bare tokens that mix letters of both cases
and digits.  A candidate's value travels as a 128-bit hash, never in the clear.
Hashes are counted over the whole corpus by distinct repositories and owners:

* ``copied``: at least ``copied_owners`` owners or ``copied_repos`` repositories
  hold it, such as the example key of a manual, or of one owner's templates;
* ``live``: one owner alone holds it, in fewer repositories than that, and it
  looks random;
* anything between is neither.

Every base span is kept whatever its verdict.  Bare tokens become spans (kind
``live``) only when the corpus says they are one owner's.

Counting goes over distinct (value, owner, repository), then (value, owner),
then value, each summed before its shuffle, so a value copied into a third of
all documents is one row per task.  The counts are written and joined back to
the candidates, where the adaptive skew join splits a hot value.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables, frugal

#: Kinds in the order in which spans with one start are listed; the first three are the contract's.
KINDS = ("assign", "access", "hex", "live")
NAMES = ("password", "passwd", "secret", "token", "api")
ASSIGN = re.compile(r"(?ai:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=.:@-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=.:@-])")
#: Words of values that stand for a secret; fixed values.
STAND_INS = re.compile(r"(?i)example|sample|dummy|changeme|placeholder|your|test|x{4}|0{6}|1234")
CANDIDATE = "struct<kind:string,start:long,end:long,h1:long,h2:long,random:boolean>"


def entropy(value: str) -> float:
    return -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())


def looks_random(value: str, bits: float = 3.0, length: int = 16) -> bool:
    return len(value) >= length and entropy(value) >= bits and not STAND_INS.search(value)


def base_matches(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, value) of the three base kinds, by start, then kind."""
    found = []
    low = text.lower()
    if any(name in low for name in NAMES):
        found += [(m.start(), m.end(), "assign", m[1]) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access", m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(m.start(), m.end(), "hex", m[0]) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def bare_tokens(text: str, base: list) -> list[tuple[int, int, str, str]]:
    """Random-looking tokens of mixed letters and digits outside the base spans."""
    if max(map(len, text.split()), default=0) < 20:
        return []
    starts = [s for s, *_ in base]  # sorted
    reach = list(accumulate((e for _, e, *_ in base), max))  # greatest end so far

    def free(start: int, end: int) -> bool:
        before = bisect_left(starts, end)
        return not before or reach[before - 1] <= start

    return [(m.start(), m.end(), "live", m[0]) for m in TOKEN.finditer(text)
            if re.search("[a-z]", m[0]) and re.search("[A-Z]", m[0]) and re.search("[0-9]", m[0]) and looks_random(m[0], 3.5, 20)
            and free(m.start(), m.end())]


def _hashes(value: str) -> tuple[int, int]:
    digest = hashlib.blake2b(value.encode(), digest_size=16).digest()
    return int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True)


def scan(batches):
    """(doc_id, repo, owner, text) -> counts, base digest and candidates of each row."""
    for batch in batches:
        for k in range(0, batch.num_rows, 512):
            rows = batch.slice(k, 512)
            counts, digests, lists = {kind: [] for kind in KINDS[:3]}, [], []
            for text in rows.column(3).to_pylist():
                base = base_matches(text) if text else []
                kinds = [s[2] for s in base]
                for kind in counts:
                    counts[kind].append(kinds.count(kind))
                digests.append(hashlib.sha256(",".join(f"{kind}:{s}:{e}" for s, e, kind, _ in base).encode()).hexdigest())
                found = []
                for s, e, kind, value in base + (bare_tokens(text, base) if text else []):
                    h1, h2 = _hashes(value)
                    found.append({"kind": kind, "start": s, "end": e, "h1": h1, "h2": h2, "random": looks_random(value)})
                lists.append(found)
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()),
                                       ("h1", pa.int64()), ("h2", pa.int64()), ("random", pa.bool_())]))
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), rows.column(1), rows.column(2), *(pa.array(c, pa.int64()) for c in counts.values()),
                 pa.array(digests, pa.string()), pa.array(lists, kind)],
                names=["doc_id", "repo", "owner", "n_assign", "n_access", "n_hex", "base_sha256", "found"])


def ownership(candidates: DataFrame) -> DataFrame:
    """(h1, h2, owners, repos) of (h1, h2, owner, repo) rows; a null owner or
    repository is an owner or repository of its own."""
    named = candidates.select("h1", "h2", F.struct("owner").alias("owner"), F.struct("owner", "repo").alias("repo"))
    return (named.groupBy("h1", "h2", "owner", "repo").agg(F.lit(1).alias("one"))
            .groupBy("h1", "h2", "owner").agg(F.count("*").alias("repos"))
            .groupBy("h1", "h2").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos")))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "doc_id",
                 owner_col: str = "source", copied_owners: int = 3, copied_repos: int = 10) -> DataFrame:
    """``(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied, live)`` for each row.

    ``spans`` lists all spans as kind:start:end by start, then kind;
    ``n_copied`` counts base spans whose value ``copied_owners`` owners or
    ``copied_repos`` repositories or more hold, ``n_live`` the random-looking
    spans of one owner alone in fewer repositories, listed in ``live``.  A null or empty text has none.  Rows with null or repeated
    doc_ids are rows of their own; a null owner counts as one owner.  Extra
    columns are ignored; an empty table gives no rows."""
    tables = Tables(docs.sparkSession, "secrets")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(repo_col).cast("string").alias("repo"),
                       F.col(owner_col).cast("string").alias("owner"), F.col(text_col).cast("string").alias("text"))
    scanned = tables.write(rows.mapInArrow(
        frugal(scan), f"doc_id long, repo string, owner string, n_assign long, n_access long, n_hex long, base_sha256 string, "
              f"found array<{CANDIDATE}>").withColumn("rid", F.monotonically_increasing_id()), "scanned")
    found = scanned.where("size(found) > 0").select("rid", "repo", "owner", F.explode("found").alias("c")).select(
        "rid", "repo", "owner", "c.*")
    known = tables.write(ownership(found), "known")
    place = F.concat_ws(":", "kind", "start", "end")
    copied = (F.col("owners") >= copied_owners) | (F.col("repos") >= copied_repos)
    live = (F.col("owners") == 1) & ~copied & F.col("random")
    order = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    listed = lambda which: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(
        which, F.struct("start", order, place.alias("place"))))), lambda x: x["place"]), ",")
    judged = (found.join(known, ["h1", "h2"]).groupBy("rid").agg(
        listed((F.col("kind") != "live") | live).alias("spans"), listed(live).alias("live"),
        F.count_if(live).alias("n_live"),
        F.count_if((F.col("kind") != "live") & copied).alias("n_copied")))
    return scanned.drop("found").join(judged, "rid", "left").select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.coalesce("spans", F.lit("")).alias("spans"),
        F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_copied", F.lit(0)).alias("n_copied"),
        F.coalesce("live", F.lit("")).alias("live"))
