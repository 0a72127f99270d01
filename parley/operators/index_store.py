"""Stored term index that documents are added to.

A version is one write: its documents, their term counts, the change of the totals of each term, and the places of the
documents it replaces (tombstones). A version counts once its commit row is written, so a write that failed is
written over. Weights depend on the whole corpus and are not stored: loading sums the changes of the totals, chooses
the vocabulary, and weighs the stored counts of live documents. No text is read or cut into words again, and the
result is that of an index built from all documents at once.

A document with a known doc_id replaces the older one and keeps its place (doc_ord); new ones follow behind, in the order
of their doc_ord. Within one write the last document of an id counts, at the place of the first. `compact` writes the
live rows as one version that stands for all before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.fixed import wording as fx
from parley.operators import retrieval
from parley.operators.precedents import doc_upsert
from parley.operators.topn import number_rows
from parley.session import delete_folder, path_exists, stage, staged_scope

COUNTS = "doc_ord long, doc_category string, term string, tf long, version long"
TOTALS = "term string, total long, df long, version long"
GONE = "doc_ord long, of long, version long"
COMMITS = "base long, n_docs long, last_ord long, version long"
PLACE = ["doc_ord", "version"]


class IndexStore:
    """Versions of an index below one folder. One writer at a time."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _commits(self) -> list:
        """One row per version."""
        if not path_exists(self.spark, f"{self.folder}/commits"):
            return []
        return sorted(self.spark.read.schema(COMMITS).parquet(f"{self.folder}/commits").collect(), key=lambda r: r.version)

    def _read(self, table: str, schema: str | None) -> DataFrame:
        """Rows of the versions that count. A version is a folder, so others are not opened."""
        last = self._commits()[-1]
        reader = self.spark.read.schema(schema) if schema else self.spark.read
        rows = reader.option("mergeSchema", True).parquet(f"{self.folder}/{table}")
        return rows.withColumn("version", F.col("version").cast("long")).where(F.col("version").between(last.base, last.version))

    def _live(self, rows: DataFrame) -> DataFrame:
        gone = self._read("gone", GONE).select("doc_ord", F.col("of").alias("version"))
        return rows.join(gone, PLACE, "left_anti")

    def documents(self) -> DataFrame:
        """Live documents, and the version each came with."""
        return self._live(self._read("docs", None))

    def n_documents(self) -> int:
        commits = self._commits()
        return commits[-1].n_docs if commits else 0

    def _write(self, table: str, rows: DataFrame, version: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.folder}/{table}/version={version}")

    def _commit(self, version: int, base: int, n_docs: int, last_ord: int) -> None:
        row = self.spark.createDataFrame([(base, n_docs, last_ord)], "base long, n_docs long, last_ord long")
        self._write("commits", row.coalesce(1), version)

    def upsert(self, docs: DataFrame) -> int:
        """Add documents (doc_ord, doc_id, title, category, content, ...); returns the version written."""
        commits = self._commits()
        version = commits[-1].version + 1 if commits else 0
        with staged_scope(self.spark):
            # The last row of an id, at the place of its first.
            merged = doc_upsert(docs.limit(0), docs)
            if commits:
                live = self.documents().select("doc_id", F.col("doc_ord").alias("old_ord"), F.col("version").alias("of"))
                merged = merged.join(live, "doc_id", "left")
            else:
                merged = merged.withColumns({"old_ord": F.lit(None).cast("long"), "of": F.lit(None).cast("long")})
            merged = stage(merged, "upsert")
            last_ord = commits[-1].last_ord if commits else -1
            fresh = number_rows(merged.where("old_ord is null"), ["doc_ord"]).select(
                "doc_id", (F.col("position") + last_ord).alias("doc_ord"), *[c for c in docs.columns if c not in ("doc_id", "doc_ord")]
            )
            replaced = merged.where("old_ord is not null")
            again = replaced.withColumn("doc_ord", F.col("old_ord"))
            rows = stage(fresh.select(*docs.columns).unionByName(again.select(*docs.columns)), "upsert-docs")
            n_all, n_again = rows.count(), replaced.count()
            self._write("docs", rows, version)
            body = rows.select("doc_ord", F.col("category").alias("doc_category"), retrieval.index_text().alias("body"))
            self._write("counts", retrieval.term_counts(body, ["doc_ord", "doc_category"], "body"), version)
            gone = stage(replaced.select(F.col("old_ord").alias("doc_ord"), "of"), "upsert-gone")
            self._write("gone", gone, version)
            added = self.spark.read.parquet(f"{self.folder}/counts/version={version}").select("term", "tf", F.lit(1).alias("sign"))
            if n_again:
                old = self._read("counts", COUNTS).join(gone.select("doc_ord", F.col("of").alias("version")), PLACE, "left_semi")
                added = added.unionByName(old.select("term", "tf", F.lit(-1).alias("sign")))
            change = added.groupBy("term").agg(F.sum(F.col("tf") * F.col("sign")).alias("total"), F.sum("sign").alias("df"))
            self._write("totals", change.select("term", "total", F.col("df").cast("long").alias("df")), version)
        n_docs = (commits[-1].n_docs if commits else 0) + n_all - n_again
        self._commit(version, commits[-1].base if commits else 0, n_docs, last_ord + n_all - n_again)
        return version

    def load(self, max_terms: int = fx.MAX_TERMS) -> retrieval.TermIndex:
        """The index over all live documents."""
        if not self._commits():
            raise FileNotFoundError(f"no index below {self.folder}")
        totals = self._read("totals", TOTALS).groupBy("term").agg(F.sum("total").alias("total")).where("total > 0")
        chosen = retrieval.vocabulary(totals, max_terms)
        counts = self._live(self._read("counts", COUNTS)).join(F.broadcast(chosen), "term")
        counts = stage(counts.select("doc_ord", "doc_category", "term_id", "tf"), "term-counts")
        return retrieval.weighted_index(self.documents().drop("version"), counts, chosen, self.n_documents())

    def compact(self) -> int:
        """Write the live rows as one version; returns it. Versions before it count no more, see `vacuum`."""
        last = self._commits()[-1]
        version = last.version + 1
        self._write("docs", self.documents().drop("version"), version)
        self._write("counts", self._live(self._read("counts", COUNTS)).drop("version"), version)
        totals = self._read("totals", TOTALS).groupBy("term").agg(F.sum("total").alias("total"), F.sum("df").alias("df"))
        self._write("totals", totals.where("total > 0"), version)
        self._write("gone", self._read("gone", GONE).limit(0).drop("version"), version)
        self._commit(version, version, last.n_docs, last.last_ord)
        return version

    def vacuum(self) -> None:
        """Delete the versions before the last compaction. Jobs that read them must have ended."""
        commits = self._commits()
        for old in [r.version for r in commits if r.version < commits[-1].base]:
            for table in ("docs", "counts", "totals", "gone", "commits"):
                delete_folder(self.spark, f"{self.folder}/{table}/version={old}")
