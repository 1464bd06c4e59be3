"""Incremental ingestion: a registry, chunk tables by source, and their reconciliation."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.config import DEFAULTS
from glyphmill.operators.evaluate import LANES, fingerprint_lanes, fingerprint_of, merge_lanes
from glyphmill.operators.ordered import scan
from glyphmill.sources.commits import CommitLog, Conflict

REGISTRY_SCHEMA = "source string, fingerprint string, chunk_count long, embedding_model string, updated_at timestamp"


class ModelMismatch(ValueError):
    """The index was built with another embedding model."""


def ensure_model(index_model: str | None, wanted: str) -> str:
    """The model to write with: the index's, or ``wanted`` for an index without one; another one is an error."""
    if index_model and index_model != wanted:
        raise ModelMismatch(f"the index holds {index_model}, not {wanted}; rebuild it or change the setting")
    return wanted


def recipe_state(meta: dict | None, rows: int, force: bool = False, config=DEFAULTS) -> tuple[str, dict]:
    """``(ok | written | doubtful, meta)``: the chunking recipe is noted only where it is true, for an empty index or a full rebuild."""
    recipe = {"chunk_size": config.chunk_size, "pipeline_version": config.pipeline_version}
    meta = dict(meta or {})
    if all(meta.get(k) == v for k, v in recipe.items()):
        return "ok", meta
    return ("written", meta | recipe) if force or not rows else ("doubtful", meta)


def prepare_chunks(chunks: DataFrame, source: str = "source", order: tuple[str, ...] = ("page", "chunk_no"), meta: tuple[str, ...] = (), parts: int | None = None) -> DataFrame:
    """Adds ``chunk_index`` (0-based in the document), ``chunk_id`` and a map of the columns ``meta``; a document of any size is numbered in blocks."""
    rows = scan(chunks, [source], order, parts=parts).withColumnRenamed("place", "chunk_index")
    rows = rows.withColumn("chunk_index", F.col("chunk_index").cast("int")).withColumn("chunk_id", F.concat(F.col(source), F.lit("::chunk_"), F.col("chunk_index").cast("string")))
    pairs = [x for m in meta for x in (F.lit(m), F.col(m).cast("string"))]
    return rows.withColumn("extra", F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())) if pairs else rows


def enrich(chunks: DataFrame, documents: DataFrame, source: str = "source") -> DataFrame:
    """Document metadata on each chunk; a document's non-null value overrides a chunk column of the same name."""
    extra = [c for c in documents.columns if c != source]
    d = documents.select(F.col(source).alias("__s"), *[F.col(c).alias(f"__d_{c}") for c in extra])
    joined = chunks.join(d, chunks[source] == d["__s"], "left")
    kept = [F.coalesce(f"__d_{c}", c).alias(c) if c in extra else F.col(c) for c in chunks.columns]
    return joined.select(*kept, *[F.col(f"__d_{c}").alias(c) for c in extra if c not in chunks.columns])


def up_to_date(fingerprint: Column, model: Column, registered: Column, registered_model: Column) -> Column:
    return F.coalesce((fingerprint == registered) & (model == registered_model), F.lit(False))


def plan(found: DataFrame, registry: DataFrame, model: str, force: bool = False) -> DataFrame:
    """``(source, fingerprint, chunks, status)`` for ``found(source, fingerprint, chunks)``: added, updated, unchanged or empty.

    Run it before extraction with ``chunks`` null to keep unchanged documents
    out of the extractor: nothing pushes a join below it.
    """
    r = registry.select(F.col("source").alias("rs"), F.col("fingerprint").alias("rf"), F.col("embedding_model").alias("rm"))
    joined = found.join(r, found["source"] == r["rs"], "left")
    same = up_to_date(F.col("fingerprint"), F.lit(model), F.col("rf"), F.col("rm"))
    status = (
        F.when(same & F.lit(not force), "unchanged").when(F.col("chunks") == 0, "empty").when(F.col("rs").isNotNull(), "updated").otherwise("added")
    )
    return joined.select("source", "fingerprint", "chunks", status.alias("status"))


def summary(planned: DataFrame) -> DataFrame:
    """``(status, documents, chunks)``; only added and updated documents write chunks."""
    wrote = F.when(F.col("status").isin("added", "updated"), F.col("chunks")).otherwise(0)
    return planned.groupBy("status").agg(F.count("*").alias("documents"), F.sum(wrote).cast("long").alias("chunks"))


def reconcile(disk: DataFrame, registry: DataFrame, index: DataFrame, model: str) -> DataFrame:
    """A row per known source: on disk or not, registered and indexed chunks, and its flag.

    ``not_ingested`` (no registry row, nothing indexed) comes before ``gap``
    (the counts differ); an ``orphan`` is registered but not on disk; else ``ok``.
    """
    d = disk.select("source").distinct().withColumn("on_disk", F.lit(True))
    r = registry.select("source", F.col("chunk_count").alias("registered"), F.col("embedding_model").alias("m"))
    i = index.groupBy("source").agg(F.count("*").alias("indexed"))
    rows = d.join(r, "source", "full").join(i, "source", "full")
    indexed, on_disk = F.coalesce("indexed", F.lit(0)), F.coalesce("on_disk", F.lit(False))
    flag = (
        F.when(~on_disk, "orphan").when(F.col("registered").isNull() & (indexed == 0), "not_ingested")
        .when(F.coalesce("registered", F.lit(0)) != indexed, "gap").otherwise("ok")
    )
    return rows.select(
        "source", on_disk.alias("on_disk"), F.coalesce("registered", F.lit(0)).alias("registered"), indexed.alias("indexed"),
        flag.alias("flag"), F.coalesce(F.col("m") != model, F.lit(False)).alias("other_model"),
    )


def other_models(registry: DataFrame, model: str) -> DataFrame:
    """``(source, embedding_model)`` of what was embedded with another model."""
    return registry.where(F.col("embedding_model") != model).select("source", "embedding_model")


def distinct_sources(chunks: DataFrame, source: str = "source") -> DataFrame:
    """The sources that chunks come from, without blank ones."""
    return chunks.where(F.col(source) != "").select(source).distinct()


def duplicate_names(files: DataFrame, name: str = "source") -> DataFrame:
    """Names that several files have: ``(source, n)``."""
    return files.groupBy(F.col(name).alias("source")).agg(F.count("*").alias("n")).where("n > 1")


def verify_manifest(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Anomalies ``(path, anomaly)``: missing first, else size, else sha256."""
    a = actual.select(F.col("path").alias("p"), F.col("size").alias("s"), F.col("sha256").alias("h"))
    joined = expected.join(a, expected["path"] == a["p"], "left")
    anomaly = F.when(F.col("p").isNull(), "missing").when(F.col("s") != F.col("size"), "size").when(F.col("h") != F.col("sha256"), "sha256")
    return joined.select("path", anomaly.alias("anomaly")).where("anomaly is not null")


class Store:
    """Chunks and their registry in a folder, as parts that versions list.

    Each upsert writes its chunks and its registry rows as a part of its own and
    then publishes a version with it, at once or not at all: after a crash the
    store is as it was.  Readers see the chunks that the newest registry row of
    their source came with.  Two writers of different documents both get
    through, one after the other; of two that wrote the same document the second
    gets a :class:`~glyphmill.sources.commits.Conflict`.  Nothing written is
    changed; :meth:`compact` leaves behind what is no longer seen, and
    :meth:`clear` removes it.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.log = spark, folder.rstrip("/"), CommitLog(spark, folder)
        self.chunks_path, self.errors_path = f"{self.folder}/parts/*/chunks", f"{self.folder}/errors"

    def _parts(self, version: int | None = None) -> list[str]:
        return self.log.read(version).get("parts", [])

    def _read(self, kind: str, schema: str, parts: list[str]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.folder}/parts/{p}/{kind}" for p in parts])

    def _rows(self, parts: list[str]) -> DataFrame:
        return self._read("registry", f"{REGISTRY_SCHEMA}, version string", parts)

    def _newest(self, version: int | None = None) -> DataFrame:
        """The newest row of each source, by the order in which parts were published; a row without fingerprint means it was forgotten."""
        parts = self._parts(version)
        order = F.broadcast(self.spark.createDataFrame([(p, i) for i, p in enumerate(parts)], "version string, turn int"))
        newest = self._rows(parts).join(order, "version").groupBy("source").agg(
            F.max_by(F.struct("fingerprint", "chunk_count", "embedding_model", "updated_at", "version"), F.struct("turn", "updated_at")).alias("r")
        )
        return newest.select("source", "r.*").where("fingerprint is not null")

    def registry(self, version: int | None = None) -> DataFrame:
        return self._newest(version).drop("version").orderBy("source")

    def registered(self, source: str):
        """The registry's row of a source, or None."""
        return self._newest().drop("version").where(F.col("source") == source).first()

    def chunks(self, schema: str, version: int | None = None) -> DataFrame:
        rows = self._read("chunks", f"{schema}, version string", self._parts(version))
        return rows.join(self._newest(version).select("source", "version"), ["source", "version"], "left_semi").drop("version")

    def count(self, schema: str, source: str | None = None) -> int:
        """How many chunks there are, or a source has."""
        rows = self.chunks(schema)
        return (rows if source is None else rows.where(F.col("source") == source)).count()

    def _lanes(self, name: str, base: int) -> list[int] | None:
        """By how much a written part changes the count and the lanes of all chunk ids; None where chunks have no ids."""
        ids = "source string, chunk_id string, version string"
        columns = self.spark.read.parquet(f"{self.folder}/parts/{name}/chunks").columns
        if "chunk_id" not in columns and columns != ["source", "version"]:
            return None
        written = self._rows([name]).select("source")
        replaced = self._read("chunks", ids, self._parts(base)).join(self._newest(base).select("source", "version"), ["source", "version"], "left_semi").join(written, "source", "left_semi")
        lost = fingerprint_lanes(replaced).withColumn("n", -F.col("n"))
        return list(merge_lanes(fingerprint_lanes(self._read("chunks", ids, [name])).unionByName(lost)).first())

    def fingerprint(self, version: int | None = None) -> str | None:
        """What tells the chunks of a version by their ids, from its manifest alone; None where chunks have none."""
        lanes = self.log.read(version).get("lanes", [0] * 9)
        if lanes is None:
            return None
        row = self.spark.createDataFrame([tuple(lanes)], ", ".join(f"{c} long" for c in ("n", *LANES)))
        return row.select(fingerprint_of("n", *LANES)).first()[0]

    def _publish(self, name: str, base: int) -> int:
        """Lists a written part after all that others published since version ``base``, unless one of them has a document of it too."""
        change = self._lanes(name, base)
        while True:
            version = self.log.latest()
            parts = self._parts(version)
            others = [p for p in parts if p not in set(self._parts(base))]
            if others:
                both = self._rows([name]).join(self._rows(others).select("source"), "source", "left_semi").first()
                if both:
                    raise Conflict(f"{both.source} was written by another writer since version {base}")
            lanes = self.log.read(version).get("lanes", [0] * 9)
            lanes = None if lanes is None or change is None else [lanes[0] + change[0], *[a ^ b for a, b in zip(lanes[1:], change[1:])]]
            try:
                self.log.publish(version + 1, {"parts": [*parts, name], "lanes": lanes})
                return version + 1
            except Conflict:
                continue

    def _write(self, rows: DataFrame, chunks: DataFrame, name: str) -> None:
        """A part that no version lists yet."""
        chunks.withColumn("version", F.lit(name)).write.parquet(f"{self.folder}/parts/{name}/chunks")
        columns = ("source", "fingerprint", "chunk_count", "embedding_model", "updated_at", "version")
        rows.withColumns({"version": F.lit(name), "updated_at": F.current_timestamp()}).select(*columns).write.parquet(f"{self.folder}/parts/{name}/registry")

    def upsert(self, planned: DataFrame, chunks: DataFrame, model: str, base: int | None = None) -> int:
        """Writes the chunks of added and updated documents in place of what they had; empty ones lose theirs.  The new version.

        ``base`` is the version that ``planned`` was made from, by default the newest.
        """
        name, base = uuid.uuid4().hex, self.log.latest() if base is None else base
        done = F.col("status").isin("added", "updated")
        write = chunks.join(planned.where(done).select("source"), "source", "left_semi")
        rows = planned.where(done | (F.col("status") == "empty")).select(
            "source", F.when(done, F.col("fingerprint")).alias("fingerprint"), F.when(done, F.col("chunks")).otherwise(0).cast("long").alias("chunk_count"), F.lit(model).alias("embedding_model"),
        )
        self._write(rows, write, name)
        return self._publish(name, base)

    def note_errors(self, errors: DataFrame) -> None:
        """Appends ``errors(source, error)``; such documents stay unregistered, so that the next run tries them again."""
        errors.select("source", "error", F.current_timestamp().alias("at")).write.mode("append").parquet(self.errors_path)

    def forget(self, sources: DataFrame) -> int:
        """Chunks of ``sources(source)`` are no longer seen, nor are these registered.  The new version."""
        name, base = uuid.uuid4().hex, self.log.latest()
        null = lambda kind: F.lit(None).cast(kind)
        rows = sources.select("source", null("string").alias("fingerprint"), F.lit(0).cast("long").alias("chunk_count"), null("string").alias("embedding_model"))
        self._write(rows, self.spark.createDataFrame([], "source string"), name)  # no chunks, so neither ids
        return self._publish(name, base)

    def purge(self, source: str, schema: str) -> int:
        """Forgets a document; how many chunks it had."""
        n = self.count(schema, source)
        self.forget(self.spark.createDataFrame([(source,)], "source string"))
        return n

    def compact(self, schema: str, folder: str | None = None) -> Store:
        """What is seen as one part: of this store, or of one in another, empty folder.  Whoever publishes meanwhile wins."""
        other = self if folder is None else Store(self.spark, folder)
        base, name = self.log.latest(), uuid.uuid4().hex
        path = f"{other.folder}/parts/{name}"
        self.chunks(schema, base).withColumn("version", F.lit(name)).write.parquet(f"{path}/chunks")
        self._newest(base).withColumn("version", F.lit(name)).write.parquet(f"{path}/registry")
        other.log.publish(base + 1 if other is self else 1, {"parts": [name], "lanes": self.log.read(base).get("lanes", [0] * 9)})
        return other

    def clear(self, keep: int = 1) -> list[str]:
        """Removes versions but the last ``keep`` and the parts that none of these lists, such as what a crash left; no writer may be at work."""
        return self.log.clear(keep, "parts", lambda m: m.get("parts", []))
