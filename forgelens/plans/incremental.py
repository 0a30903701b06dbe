"""Audits kept up to date: only content that has changed is read again.

The state of an audit is a folder with three tables: the files it covered with a hash of
their content, the hits in them, and the counts of these per repository.  An update
compares the listing with the state, scans what is new, and merges its counts, and those
of what is gone with a minus sign, into the stored ones.
"""

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators import scans, tallies
from ..sources.materialize import materialize
from .audit import AuditOptions, SecurityAudit

FILE = ["repo", "path"]
LISTED = "repo string, path string, kind string, content_hash string"


class StoredAudit(SecurityAudit):
    """The results of :class:`SecurityAudit` from a state, without reading content."""

    def __init__(self, repos, manifest, hits, tallied, advisories, options):
        self._stored = hits, tallied
        super().__init__(repos, manifest, advisories, options)

    def _selected(self):
        return None

    def _scan(self, selected):
        return self._stored[0]

    def _use(self, scanned, tallied=None):
        super()._use(scanned, self._stored[1])


class AuditState:
    """The state below ``path``; None is the state before any file.

    Options that limit the number of files are refused: with them a new file can push out
    one that has not changed.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, options: AuditOptions = AuditOptions()):
        if options.max_secret_files is not None or options.max_deep_files is not None:
            raise ValueError("an audit of the first files cannot be kept up to date by changed ones")
        self.spark, self.path, self.options = spark, path, options

    def _table(self, name: str, empty: str) -> DataFrame:
        if self.path is None:
            return self.spark.createDataFrame([], empty)
        return self.spark.read.parquet(f"{self.path}/{name}")

    @property
    def manifest(self) -> DataFrame:
        return self._table("manifest", LISTED)

    @property
    def hits(self) -> DataFrame:
        return self._table("hits", "repo string, path string, kind string, key string, severity string, lineno bigint, text string")

    @property
    def tallied(self) -> DataFrame:
        columns = ", ".join(f"`{r.column}` bigint" for r in tallies.RULES)
        return self._table("tallies", f"repo string, {columns}")

    def update(
        self, listing: DataFrame, contents: Callable[[DataFrame], DataFrame], folder: str
    ) -> "AuditState":
        """The state after the files are those of ``listing(repo, path, kind, content_hash)``.

        ``contents`` is asked once for the files that are new or have another hash: it gets
        a written table (repo, path, content_hash) and returns (repo, path, kind, content).
        A file that moved is one that is gone and one that is new.  A file without a hash
        counts as changed.  The new state is written below ``folder``; this one stays.
        """
        now = listing.select(*FILE, "kind", "content_hash")
        before = self.manifest.select(*FILE, F.col("kind").alias("was_kind"), F.col("content_hash").alias("was_hash"))
        same = (F.col("content_hash") == F.col("was_hash")) & F.col("kind").eqNullSafe(F.col("was_kind"))
        compared = now.join(before.withColumn("old", F.lit(True)), FILE, "full").withColumn("same", F.coalesce(same, F.lit(False)))
        changes = materialize(compared.where("NOT same"), "changed-files")
        fresh = changes.where("kind = 'blob'").select(*FILE, "content_hash")
        gone = changes.where("old").select(*FILE)

        files = contents(fresh).select(*FILE, "kind", "content")
        audit = SecurityAudit(listing.select("repo").distinct(), files, _no_advisories(self.spark), self.options)
        found = materialize(audit.scanned, "new-hits")
        lost = materialize(self.hits.join(gone, FILE, "left_semi"), "lost-hits")
        path = f"{folder.rstrip('/')}/state-{uuid.uuid4().hex}"
        self.hits.join(gone, FILE, "left_anti").unionByName(found).write.parquet(f"{path}/hits")

        names = [r.column for r in tallies.RULES]
        tally = lambda hits: tallies.tally_hits(hits.where(F.col("kind") != scans.DEPENDENCY))
        minus = tally(lost).select("repo", *[(-F.col(n)).alias(n) for n in names])
        signed = self.tallied.select("repo", *names).unionByName(tally(found)).unionByName(minus)
        summed = signed.groupBy("repo").agg(*[F.sum(n).alias(n) for n in names])
        left = now.select("repo").distinct()
        summed.join(left, "repo", "left_semi").write.parquet(f"{path}/tallies")
        now.write.parquet(f"{path}/manifest")
        return AuditState(self.spark, path, self.options)

    def audit(self, repos: DataFrame, advisories: DataFrame) -> SecurityAudit:
        """All results over the files of this state."""
        return StoredAudit(repos, self.manifest, self.hits, self.tallied, advisories, self.options)


def _no_advisories(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], schemas.ADVISORIES)
