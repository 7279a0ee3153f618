"""Secret scans through an incremental blob ledger.

Every version of every text is addressed by its content (SHA-256). The ledger holds, for each blob and rule version, what the
scan found. A run looks up which pairs of blob and rule version the ledger lacks, scans one copy of each of those blobs, appends
the findings, and joins them back to every path and version (every row, by the columns that name it) that holds the blob. Unchanged
texts are so never scanned again, copies are scanned once, and a new rule version scans everything afresh without touching the
old findings. Two runs that append at once, or one that is repeated after its driver was lost, may put a pair into the ledger
twice; readers take it once.

Null texts are the empty blob. Repeated rows each get the blob's findings. An empty table gives an empty result and leaves the
ledger as it is. Extra columns are ignored. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from .common import fresh_path, map_texts, texts_of

RULE_VERSION = 1

#: The rules, in the order in which kinds are listed. Fixed values.
ASSIGN = re.compile(r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Beyond the base kinds: the first lines of private keys and signed web tokens.
PEM = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----")
JWT = re.compile(r"\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}")
KINDS = ("assign", "access", "hex", "pem", "jwt")
BASE = KINDS[:3]

_LEDGER = "blob string, rule_version int, kinds array<int>, starts array<int>, ends array<int>"


def spans_of(text: str) -> list[tuple[int, int, int]]:
    """(kind's place, start, end) of all findings, by start and then kind.

    access and hex take runs of at least the wanted length at once: what is shorter would be dropped anyway, and a run that
    fails holds no other match.
    """
    found = [(0, m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    for k, rule in ((1, ACCESS), (2, HEX), (3, PEM), (4, JWT)):
        found += [(k, m.start(), m.end()) for m in rule.finditer(text)]
    return sorted(found, key=lambda x: (x[1], x[0]))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger at path, each blob and rule version once; an empty one where nothing has been written yet."""
    try:
        return spark.read.schema(_LEDGER).parquet(path).dropDuplicates(["blob", "rule_version"])
    except AnalysisException as none:
        if "PATH_NOT_FOUND" not in str(none):
            raise
        return spark.createDataFrame([], _LEDGER)


def scan_unseen(blobs: DataFrame, ledger: str, rule_version: int = RULE_VERSION) -> None:
    """Scan the blobs (blob, text) that the ledger lacks under this rule version, one copy of each, and append the findings."""
    seen = read_ledger(blobs.sparkSession, ledger).where(F.col("rule_version") == rule_version).select("blob")
    one = blobs.groupBy("blob").agg(F.first("text").alias("text"))  # copies meet before the shuffle: a hot blob is no hot task
    unseen = one.join(seen, "blob", "left_anti")

    def make():
        def work(batch):
            rows = [list(zip(*spans_of(t), strict=True)) or [(), (), ()] for t in texts_of(batch)]
            return {"blob": batch.column("blob"), "rule_version": [rule_version] * batch.num_rows} | {c: [r[k] for r in rows] for k, c in enumerate(("kinds", "starts", "ends"))}

        return work

    map_texts(unseen, ["blob", "text"], make, _LEDGER).write.mode("append").parquet(ledger)


def with_blobs(docs: DataFrame, paths: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The columns that name a version of a path (renamed _path0, _path1, ...), blob (its content's address) and text (null as empty)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(*[F.col(p).alias(f"_path{k}") for k, p in enumerate(paths)], F.sha2(text, 256).alias("blob"), text.alias("text"))


def find_secrets(docs: DataFrame, ledger: str, rule_version: int = RULE_VERSION, paths: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The columns of paths (say path and commit), blob, and the blob's kinds, starts and ends, for every row of docs. Of these four names
    one that a path has is given out with _ in front."""
    rows = with_blobs(docs, paths, text_col)
    scan_unseen(rows.select("blob", "text"), ledger, rule_version)
    found = read_ledger(docs.sparkSession, ledger).where(F.col("rule_version") == rule_version).drop("rule_version")
    named = [F.col(f"_path{k}").alias(p) for k, p in enumerate(paths)]
    own = [F.col(c).alias(f"_{c}" if c in paths else c) for c in ("blob", "kinds", "starts", "ends")]
    return rows.drop("text").join(found, "blob").select(*named, *own)


def joined(base_only: bool):
    """kind:start:end of a row's findings, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    every = F.arrays_zip("kinds", "starts", "ends")
    if base_only:
        every = F.filter(every, lambda x: x["kinds"] < len(BASE))
    return F.array_join(F.transform(every, lambda x: F.concat_ws(":", F.get(names, x["kinds"]), x["starts"].cast("string"), x["ends"].cast("string"))), ",")


def op9_secret_ledger(spark, sf_dir: str) -> DataFrame:
    """Two runs: an earlier state (the documents whose address begins with 0) fills the ledger, then all documents are scanned on top of it."""
    docs, ledger = spark.read.parquet(f"{sf_dir}/documents.parquet"), fresh_path(spark, "secret-ledger")
    scan_unseen(with_blobs(docs).where(F.col("blob").startswith("0")).select("blob", "text"), ledger)
    found = find_secrets(docs, ledger)
    count = lambda k: F.size(F.filter("kinds", lambda x: x == k)).cast("bigint")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(joined(True), 256).alias("base_sha256"), joined(False).alias("spans"))
