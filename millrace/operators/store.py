"""A store of rows by key, in versions: upserts and deletions by batches, old versions readable, conflicts seen, writers that may die.

Rows lie in buckets of a hash of their key. A version is a manifest, one small table that says for each bucket in which folder its rows
are; a batch rewrites the buckets that it touches into a new folder and then writes the manifest. A writer that dies before that
leaves a folder that no manifest names. Nothing that a version names is ever changed.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.sources.shared import settled, shared_folder
from millrace.sources.tables import table

MANIFEST = "version long, bucket int, folder string, rows long, batch string"
#: Names that chunks may be filed under, and marks that keep them out of answers.
DOMAINS, FLAGS = ("general", "clinical", "finance", "session"), ("safe", "review", "blocked")


class Conflict(Exception):
    """Someone else has written meanwhile, or a row has another revision than a change expects."""


class Store:
    """Rows of one schema, one for each key (of ``keys``; null keys are refused), with a long column ``revision``, in a shared folder."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], buckets: int = 32):
        self.spark, self.path, self.keys, self.buckets = spark, path, keys, buckets
        self.schema = StructType.fromDDL(schema + ", revision long")

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _manifests(self) -> DataFrame:
        try:
            found = self.spark.read.schema(MANIFEST).option("recursiveFileLookup", True).parquet(f"{self.path}/manifests")
            found.limit(1).collect()
            return found
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return self.spark.createDataFrame([], MANIFEST)

    def version(self) -> int:
        """The last version; 0 if nothing was written."""
        return self._manifests().agg(F.max("version")).first()[0] or 0

    def _folders(self, version: int) -> list:
        return self._manifests().where(F.col("version") == version).collect()

    def read(self, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """All rows of a version, the last by default; only some buckets' folders, if they are named."""
        version = self.version() if version is None else version
        named = [r for r in self._folders(version) if r.folder and (buckets is None or r.bucket in buckets)]
        out = self.spark.createDataFrame([], self.schema)
        paths = [f"{self.path}/rows/{r.folder}/bucket={r.bucket}" for r in named if r.rows]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else out

    def apply(self, changes: DataFrame, batch: str, expected: int | None = None) -> int:
        """Writes a batch of changes as a new version and returns that.

        changes: the store's columns but revision; optionally ``deleted`` (true: the row goes) and ``was`` (the revision that the
        row must have; null: any, 0: none). A batch that was applied before changes nothing. Several changes of one key, a null key, a row
        of another revision, or a store that isn't at version ``expected`` any more raise Conflict, and nothing is written.
        A row's revision counts its changes.
        """
        manifests = settled(self._manifests())
        done = manifests.where(F.col("batch") == batch).agg(F.max("version")).first()[0]
        if done:
            return done
        now = manifests.agg(F.max("version")).first()[0] or 0
        if expected is not None and expected != now:
            raise Conflict(f"version {now}, not {expected}")
        columns = [f.name for f in self.schema.fields if f.name != "revision"]
        extra = [F.col("deleted") if "deleted" in changes.columns else F.lit(False).alias("deleted"), F.col("was") if "was" in changes.columns else F.lit(None).cast("long").alias("was")]
        new = changes.select(*(F.col(c).cast(self.schema[c].dataType).alias(c) for c in columns), *extra).withColumn("bucket", self._bucket())
        new = settled(new)
        null = F.lit(False)
        for key in self.keys:
            null |= F.col(key).isNull()
        if not new.where(null).isEmpty() or not new.groupBy(*self.keys).count().where("count > 1").isEmpty():
            raise Conflict("null or repeated keys")
        touched = sorted(r.bucket for r in new.select("bucket").distinct().collect())
        old = self.read(now, touched).withColumn("bucket", self._bucket())
        side = lambda df, name: df.select(*self.keys, "bucket", F.struct(*(c for c in df.columns if c not in self.keys)).alias(name))
        both = settled(side(old, "o").join(side(new, "n"), [*self.keys, "bucket"], "full"))
        held = F.coalesce("o.revision", F.lit(0))
        if not both.where(F.col("n.was").isNotNull() & (F.col("n.was") != held)).isEmpty():
            raise Conflict("a row has another revision")
        changed = F.col("n").isNotNull()
        rest = [F.when(changed, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in columns if c not in self.keys]
        rows = both.where(~changed | ~F.coalesce("n.deleted", F.lit(False))).select(*self.keys, *rest, (held + F.when(changed, 1).otherwise(0)).cast("long").alias("revision"), "bucket")
        folder = uuid.uuid4().hex
        rows.select(*(f.name for f in self.schema.fields), "bucket").repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/rows/{folder}")
        counts = {r.bucket: r.rows for r in rows.groupBy("bucket").agg(F.count("*").alias("rows")).collect()}
        kept = [(now + 1, r.bucket, r.folder, r.rows, batch) for r in self._folders(now) if r.bucket not in touched]
        named = kept + [(now + 1, b, folder, counts.get(b, 0), batch) for b in touched]
        self._commit(now + 1, named or [(now + 1, -1, "", 0, batch)])
        return now + 1

    def _commit(self, version: int, named: list[tuple]) -> None:
        """Makes a version: its manifest is one file, in a folder that may not exist yet."""
        try:
            self.spark.createDataFrame(named, MANIFEST).coalesce(1).write.mode("error").parquet(f"{self.path}/manifests/version={version}")
        except Exception as error:
            if "PATH_ALREADY_EXISTS" in str(error):
                raise Conflict(f"version {version} was written meanwhile") from error
            raise

    def history(self) -> DataFrame:
        """(version, batch, rows) of all versions."""
        return self._manifests().groupBy("version", "batch").agg(F.sum("rows").alias("rows"))


def deletions(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """Changes that delete the rows of a store (or of a child of it) whose ``keys`` are among those gone."""
    return rows.join(gone.select(*keys).distinct(), keys, "left_semi").drop("revision").withColumn("deleted", F.lit(True))


def visible(chunks: DataFrame, domains: list[str] | None = None, excluded: tuple[str, ...] = ("blocked",)) -> DataFrame:
    """Chunks (corpus_domain, safety_flag) of some domains, without those of excluded marks; what has no domain is general, what has
    no mark is under review. Unknown names are errors."""
    if unknown := {*(domains or ()), *excluded} - {*DOMAINS, *FLAGS}:
        raise ValueError(f"unknown: {', '.join(sorted(unknown))}")
    domain, flag = F.coalesce("corpus_domain", F.lit("general")), F.coalesce("safety_flag", F.lit("review"))
    rows = chunks.where(~flag.isin(*excluded)) if excluded else chunks
    return rows if domains is None else rows.where(domain.isin(*domains))


def owned(rows: DataFrame, owners: DataFrame, users: DataFrame) -> DataFrame:
    """Rows (owner_id) of what belongs (owner_id, user_id) to some users (user_id): a semi-join on either side, so that no other
    user's row passes, whatever a row says of itself; rows without an owner are nobody's."""
    mine = owners.join(users.select("user_id").distinct(), "user_id", "left_semi").select("owner_id").distinct()
    return rows.join(mine, "owner_id", "left_semi")


def _customers(s, d):
    return table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").cast("long").alias("place"))


def _lived(s, d) -> Store:
    """All customers, then the suppliers over them, then some customers gone, then one batch again."""
    store = Store(s, f"{shared_folder(s)}/store-{uuid.uuid4().hex}", "id long, name string, place long", ["id"], 8)
    store.apply(_customers(s, d), "customers")
    suppliers = table(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").cast("long").alias("place"))
    store.apply(suppliers.withColumn("was", F.lit(None).cast("long")), "suppliers", expected=1)
    store.apply(deletions(store.read(), table(s, d, "nation").where("n_regionkey = 2").select(F.col("n_nationkey").cast("long").alias("place")), ["place"]), "no region 2")
    store.apply(suppliers, "suppliers")
    return store


def _chunks(s, d):
    k = F.col("doc_id") % 7
    return table(s, d, "documents").select("doc_id", F.when(k < 3, "clinical").when(k < 5, "finance").alias("corpus_domain"), F.when(k == 0, "blocked").when(k < 6, "safe").alias("safety_flag"))


QUERIES = {
    "store_rows": lambda s, d: _lived(s, d).read(),
    "store_version_1": lambda s, d: _lived(s, d).read(1),
    "store_history": lambda s, d: _lived(s, d).history(),
    "visible_chunks": lambda s, d: visible(_chunks(s, d), ["clinical", "general"]).select("doc_id"),
    "owned_orders": lambda s, d: owned(table(s, d, "orders").select("o_orderkey", F.col("o_custkey").alias("owner_id")), table(s, d, "customer").select(F.col("c_custkey").alias("owner_id"), F.col("c_nationkey").alias("user_id")), table(s, d, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("user_id"))).select("o_orderkey"),
}
_ALL = """WITH every AS (SELECT coalesce(s_suppkey, c_custkey) AS id, coalesce(s_name, c_name) AS name, coalesce(s_nationkey, c_nationkey)::BIGINT AS place, (s_suppkey IS NOT NULL)::BIGINT + (c_custkey IS NOT NULL)::BIGINT AS revision FROM customer FULL JOIN supplier ON c_custkey = s_suppkey),
left_rows AS (SELECT * FROM every WHERE place NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2))"""
ORACLE_SQL = {
    "store_rows": f"{_ALL} SELECT * FROM left_rows",
    "store_version_1": "SELECT c_custkey AS id, c_name AS name, c_nationkey::BIGINT AS place, 1::BIGINT AS revision FROM customer",
    "store_history": f"{_ALL} SELECT 1::BIGINT AS version, 'customers' AS batch, count(*)::BIGINT AS rows FROM customer UNION ALL SELECT 2, 'suppliers', count(*) FROM every UNION ALL SELECT 3, 'no region 2', count(*) FROM left_rows",
    "visible_chunks": "SELECT doc_id FROM documents WHERE doc_id % 7 <> 0 AND (doc_id % 7 < 3 OR doc_id % 7 >= 5)",
    "owned_orders": "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1))",
}
