"""Change detection, upserts, deletions, catalogue: DataFrame algebra, and a versioned Parquet store."""

from __future__ import annotations

import json
import uuid
from bisect import bisect_right
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscan.functions.scalars import normalize_path, parent
from folioscan.operators.lexical import TERMS, summed, term_statistics
from folioscan.operators.search import in_folders
from folioscan.schema import CHUNKS, DOCUMENTS, SCHEMA_NUMBER


def statuses(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """incoming with status: inserted, updated or skipped (same path and same sha256), whatever a path's slashes.

    Rows of one path are taken in order of mtime (where there is one) and sha256, each after the one
    before it, so a path given twice with the same hash is skipped the second time.
    """
    known = existing.select(normalize_path(F.col("path")).alias("_path"), F.col("sha256").alias("_sha256"))
    rows = incoming.withColumn("_path", normalize_path(F.col("path")))
    order = Window.partitionBy("_path").orderBy(*(c for c in ("mtime", "sha256") if c in incoming.columns))
    before = F.coalesce(F.lag("sha256").over(order), F.col("_sha256"))
    status = F.when(before.isNull(), "inserted").when(before == F.col("sha256"), "skipped").otherwise("updated")
    return rows.join(known, "_path", "left").withColumn("status", status).drop("_path", "_sha256")


def latest(rows: DataFrame) -> DataFrame:
    """The last row of each path, whatever its slashes: the latest mtime, then the highest sha256."""
    order = Window.partitionBy(normalize_path(F.col("path"))).orderBy(*(F.desc(c) for c in ("mtime", "sha256", "path") if c in rows.columns))
    return rows.withColumn("_rn", F.row_number().over(order)).filter("_rn = 1").drop("_rn")


def index_stats(rows: DataFrame) -> DataFrame:
    """One row of counts by status; unknown ones are failed."""
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    known = ["inserted", "updated", "skipped"]
    return rows.agg(*map(count, known), F.count_if(~F.coalesce(F.col("status").isin(known), F.lit(False))).alias("failed"), F.count("*").alias("processed"))


def upserted(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """existing, with inserted and updated rows of incoming in place of theirs; same columns."""
    changed = statuses(existing, latest(incoming)).filter("status != 'skipped'").drop("status")
    away = changed.select(normalize_path(F.col("path")).alias("_path"))
    kept = existing.withColumn("_path", normalize_path(F.col("path"))).join(away, "_path", "left_anti").drop("_path")
    return kept.unionByName(changed.select(existing.columns))


def without(documents: DataFrame, document_id: int | None = None, path: str | None = None) -> DataFrame:
    if document_id is not None:
        return documents.filter(F.col("document_id") != document_id)
    assert path is not None
    return documents.filter(normalize_path(F.col("path")) != path.replace("\\", "/"))


def pruned(documents: DataFrame, present: DataFrame, on: str = "path") -> DataFrame:
    """Documents that are still there."""
    return documents.join(present.select(on).distinct(), on, "left_semi")


def document_list(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """documents (id, updated_at and what else they have) with chunk_count, 0 where there are none; the latest first, then by id.

    Chunks are counted before the join, so no chunk moves twice.
    """
    counts = chunks.groupBy(F.col("document_id").alias("id")).agg(F.count("*").alias("chunk_count"))
    return documents.join(counts, "id", "left").withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0)).cast("long")).orderBy(F.desc("updated_at"), "id")


def directories(documents: DataFrame) -> DataFrame:
    """path, count: documents in each folder."""
    return documents.groupBy(parent(normalize_path(F.col("path"))).alias("path")).agg(F.count("*").alias("count")).orderBy("path")


def totals(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: document_count, chunk_count, total_size."""
    d = documents.agg(F.count("*").alias("document_count"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("total_size"))
    return d.crossJoin(chunks.agg(F.count("*").alias("chunk_count")))  # one row by one row


class ConflictError(RuntimeError):
    """Another commit came first, again and again."""


def _several(parts: str | list[str]) -> list[str]:
    """A bucket's folders; older commits name one."""
    return [parts] if isinstance(parts, str) else parts


#: A data file's rows that are gone: bits by their number in the file, 64 to a word; only words that aren't 0.
VECTORS = "file string, words map<bigint,bigint>, n bigint"


class Store:
    """documents and chunks as Parquet in buckets; a commit is a small file that names each bucket's folders.

    A bucket is a range of lower-case paths, so what lies below a folder is in few buckets, and a search
    in folders reads those alone. The ranges and their number are settled by the first commit, from a
    bounded sample of its paths. A document's id has the bucket in its low digits, so its chunks have it
    too.

    A change adds files to the buckets that it touches, and marks the rows that it replaces or removes in
    deletion vectors, bitmaps for each data file that readers apply; no data file is written again for
    it. A bucket is written anew when over GONE_SHARE of its documents are gone, or when it has over
    PARTS parts.

    Commits are numbered, and a number's file is created only if it isn't there: of two writers that
    start from the same state one comes first, and the other reads again and repeats. Readers see the
    highest number that is complete, old or new. Folders that none of the last KEPT commits names are
    removed. The root's file system must create files exclusively, as HDFS and local ones do.

    A commit has the number of the schema it was written by. Commits of older kinds (without a number, one
    folder a bucket, buckets by hash, fewer columns) are read and changed as they are, columns that they
    lack being null; one of a later schema is refused.

    terms: keep statistics of the chunks' words (lexical.TERMS). A commit adds a table of differences, for
    what it adds and removes alone; after PARTS of them they become one table. Once kept they stay kept,
    whoever writes; a store without them gets them from all its chunks.
    """

    KEPT, RETRIES = 10, 20
    GONE_SHARE, PARTS = 0.2, 8
    #: Paths of the first commit that ranges are settled by, for each bucket; words of vectors that may be broadcast.
    SAMPLED, BROADCAST_GONE = 20, 5_000_000

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64, terms: bool = False) -> None:
        self.spark, self.root, self._buckets, self._with_terms = spark, root.rstrip("/"), buckets, terms

    def _fs(self):  # noqa: ANN202
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _names(self, folder: str) -> list[str]:
        fs, path = self._fs()
        at = path(f"{self.root}/{folder}")
        return sorted(n for s in (fs.listStatus(at) if fs.exists(at) else ()) if not (n := s.getPath().getName()).startswith((".", "_")))

    def _load(self, number: str) -> dict | None:
        """A commit's content; None while it isn't complete."""
        fs, path = self._fs()
        stream = fs.open(path(f"{self.root}/_commits/{number}"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text) if text.endswith("}\n") else None

    def _state(self) -> tuple[int, dict]:
        """The highest number taken, and the content of the highest complete commit."""
        names = self._names("_commits")
        for number in reversed(names):
            found = self._load(number)
            if found:
                if found.get("schema", 1) > SCHEMA_NUMBER:
                    raise ValueError(f"{self.root} has schema {found['schema']}, this library knows {SCHEMA_NUMBER}")
                return int(names[-1]), found
        return int(names[-1]) if names else 0, {"version": None, "buckets": self._buckets, "documents": {}, "chunks": {}}

    def version(self) -> str | None:
        return self._state()[1]["version"]

    def documents(self, folders: Sequence[str] | None = None) -> DataFrame:
        """All documents, or those in the folders, for which only the files that can have some are read."""
        state = self._state()[1]
        rows = self._read(state, "documents", DOCUMENTS, self._within(state, folders))
        return rows if folders is None else rows.filter(in_folders(F.col("path"), folders))

    def chunks(self) -> DataFrame:
        return self._read(self._state()[1], "chunks", CHUNKS)

    def terms(self) -> DataFrame:
        """word, chunks, occurrences (lexical.TERMS) of all chunks: the sum of what commits kept, or counted now where none did."""
        state = self._state()[1]
        kept = state.get("terms")
        if kept is None:
            return term_statistics(self._read(state, "chunks", CHUNKS).select("text"))
        return summed(self._differences(kept))

    def _differences(self, folders: Sequence[str]) -> DataFrame:
        return self.spark.read.schema(TERMS).parquet(*(f"{self.root}/{f}" for f in folders)) if folders else self.spark.createDataFrame([], TERMS)

    def searchable(self, folders: Sequence[str] | None = None) -> DataFrame:
        """Chunks with their documents' path and title, of all documents or of those in the folders."""
        state = self._state()[1]
        only = self._within(state, folders)
        documents = self._read(state, "documents", DOCUMENTS, only)
        documents = documents if folders is None else documents.filter(in_folders(F.col("path"), folders))
        return self._read(state, "chunks", CHUNKS, only).join(documents.select(F.col("id").alias("document_id"), "path", "title"), "document_id")

    def files(self, folders: Sequence[str] | None = None) -> list[str]:
        """The data files that a search in the folders reads."""
        state = self._state()[1]
        only = self._within(state, folders)
        return sorted(f for name, schema in (("documents", DOCUMENTS), ("chunks", CHUNKS)) if self._parts(state, name, only) for f in self.spark.read.schema(schema).parquet(*self._parts(state, name, only)).inputFiles())

    def _within(self, state: dict, folders: Sequence[str] | None) -> list[int] | None:
        """The buckets that can have paths in the folders; None: all. Names with other than ASCII letters find all, as their lower case is Spark's to say."""
        bounds = state.get("bounds")
        if folders is None or not bounds or not all(f.isascii() for f in folders):
            return None
        found: set[int] = set()
        for f in (f.replace("\\", "/").rstrip("/").lower() for f in folders if f.strip()):
            # Below a folder are the paths from f/ up to f0, as 0 follows / in ASCII.
            found |= {bisect_right(bounds, f or "/"), *range(bisect_right(bounds, f + "/"), bisect_right(bounds, f + "0") + 1)}
        return sorted(found)

    def _parts(self, state: dict, name: str, only: Sequence[int] | None = None) -> list[str]:
        return [f"{self.root}/{f}" for k, parts in sorted(state[name].items()) if only is None or int(k) in only for f in _several(parts)]

    def _placed(self, folders: list[str], schema) -> DataFrame:  # noqa: ANN001
        """All rows of the folders, with file and row: where they stand."""
        rows = self.spark.read.schema(schema).parquet(*folders)
        return rows.select("*", F.regexp_extract("_metadata.file_path", "data/[^/]+/[^/]+/[^/]+/[^/]+$", 0).alias("file"), F.col("_metadata.row_index").alias("row"))

    def _read(self, state: dict, name: str, schema, only: Sequence[int] | None = None) -> DataFrame:  # noqa: ANN001
        gone = {k: g for k, g in state.get("gone", {}).get(name, {}).items() if only is None or int(k) in only}
        marked = self._parts(state, name, [int(k) for k in gone])
        whole = [f for f in self._parts(state, name, only) if f not in set(marked)]
        frames = [self.spark.read.schema(schema).parquet(*whole)] if whole else []
        if marked:
            vectors = self.spark.read.schema(VECTORS).parquet(*(f"{self.root}/{g['folder']}" for g in gone.values())).select("file", "words")
            vectors = F.broadcast(vectors) if sum(g["n"] for g in gone.values()) <= self.BROADCAST_GONE else vectors
            bits = F.coalesce(F.try_element_at("words", F.shiftright("row", 6)), F.lit(0).cast("long"))
            frames.append(self._placed(marked, schema).join(vectors, "file", "left").filter(F.getbit(bits, F.col("row") % 64) == 0).select(schema.names))
        return reduce(DataFrame.unionByName, frames) if frames else self.spark.createDataFrame([], schema)

    def _bucket(self, of: Column, state: dict) -> Column:
        return F.pmod(of, F.lit(state["buckets"])).cast("int")

    def _id(self, state: dict) -> Column:
        """Of path and sha256; the remainder by the number of buckets is the path's bucket."""
        n, path = F.lit(state["buckets"]), normalize_path(F.col("path"))
        bounds = state.get("bounds")
        place = F.pmod(F.xxhash64(path), n) if bounds is None else F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.lower(path))) if bounds else F.lit(0)
        h = F.shiftright(F.xxhash64(F.concat_ws("\0", path, "sha256")), 16)
        return h - F.pmod(h, n) + place

    def _bounds(self, documents: DataFrame, state: dict) -> list[str]:
        """Where ranges of paths begin, from SAMPLED paths a bucket, those with the lowest hashes."""
        path = F.lower(normalize_path(F.col("path")))
        paths = sorted(r["p"] for r in documents.select(path.alias("p")).orderBy(F.xxhash64("p"), "p").limit(self.SAMPLED * state["buckets"]).collect())
        return sorted({paths[k * len(paths) // state["buckets"]] for k in range(1, state["buckets"])}) if paths else []

    def _written(self, df: DataFrame, names: list[str], by: str, state: dict, folder: str) -> dict[str, str]:
        """The folders of the buckets that df has rows for."""
        rows = df.select(*names, self._bucket(F.col(by), state).alias("bucket"))
        # A bucket is as many files as its rows need: adaptive execution splits and joins them.
        order = ["path"] if "path" in names else [by, "chunk_index"]
        rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", *order).write.partitionBy("bucket").parquet(f"{self.root}/{folder}")
        return self._folders(folder)

    def _folders(self, folder: str) -> dict[str, str]:
        return {n.removeprefix("bucket="): f"{folder}/{n}" for n in self._names(folder) if n.startswith("bucket=")}

    def _marked(self, state: dict, name: str, schema, by: str, ids: DataFrame, touched: list[int], folder: str) -> dict[str, dict]:  # noqa: ANN001
        """Deletion vectors of the touched buckets with the rows of ids (id) added to what they had."""
        old = [f"{self.root}/{g['folder']}" for k, g in state.get("gone", {}).get(name, {}).items() if int(k) in touched]
        folders = self._parts(state, name, touched)
        if not folders:
            return {}
        rows = self._placed(folders, schema).join(ids.select(F.col("id").alias(by)), by, "left_semi")
        words = rows.select("file", F.shiftright("row", 6).alias("word"), F.expr("shiftleft(1L, cast(row % 64 as int))").alias("bits"))
        if old:
            words = words.unionByName(self.spark.read.schema(VECTORS).parquet(*old).select("file", F.explode("words").alias("word", "bits")))
        words = words.groupBy("file", "word").agg(F.bit_or("bits").alias("bits"))
        files = words.groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("words"), F.sum(F.bit_count("bits")).cast("long").alias("n"))
        files.withColumn("bucket", F.regexp_extract("file", "bucket=([0-9]+)/", 1).cast("int")).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.root}/{folder}")
        n = {str(r["bucket"]): r["n"] for r in self.spark.read.parquet(f"{self.root}/{folder}").groupBy("bucket").agg(F.sum("n").alias("n")).collect()} if self._folders(folder) else {}
        return {k: {"folder": f, "n": n[k]} for k, f in self._folders(folder).items()}

    def _counts(self, rows: DataFrame, state: dict) -> dict[str, int]:
        """Rows (id) by bucket."""
        return {str(r["b"]): r["n"] for r in rows.groupBy(self._bucket(F.col("id"), state).alias("b")).agg(F.count("*").alias("n")).collect()}

    def _commit(self, change: Callable[[dict], tuple[DataFrame | None, DataFrame | None, dict[str, int], DataFrame] | None]) -> tuple[dict, dict] | None:
        """The states before and after. change(state): documents and chunks to add (or None), how many documents by bucket, and the ids (id) that go; None: nothing to do."""
        fs, path = self._fs()
        for _ in range(self.RETRIES):
            last, state = self._state()
            made = change(state)
            if made is None:
                return None
            documents, chunks, added, ids = made
            number = f"{last + 1:010d}"
            folder = f"data/{number}-{uuid.uuid4().hex[:8]}"
            lost = self._counts(ids, state) if state["documents"] else {}
            rows = {k: n + added.get(k, 0) for k, n in state.get("rows", {}).items()} | {k: n for k, n in added.items() if k not in state.get("rows", {})}
            before = {k: g["n"] for k, g in state.get("gone", {}).get("documents", {}).items()}
            touched = sorted({*map(int, added), *map(int, lost)})
            crowded = [k for k in touched if len(_several(state["chunks"].get(str(k), []))) >= self.PARTS]
            anew = sorted({*crowded, *(k for k in map(int, lost) if before.get(str(k), 0) + lost[str(k)] > self.GONE_SHARE * rows.get(str(k), 0))})
            content = {"version": number, "schema": SCHEMA_NUMBER, "buckets": state["buckets"], "bounds": state.get("bounds"), "gone": {}}
            for name, df, schema, by in (("documents", documents, DOCUMENTS, "id"), ("chunks", chunks, CHUNKS, "document_id")):
                new = {k: _several(f) for k, f in state[name].items() if int(k) not in anew}
                gone = {k: g for k, g in state.get("gone", {}).get(name, {}).items() if int(k) not in anew}
                further = df
                if anew:
                    live = self._read(state, name, schema, anew).join(ids.select(F.col("id").alias(by)), by, "left_anti").select(schema.names)
                    further = live if df is None else live.unionByName(df.select(schema.names))
                if further is not None:
                    for k, f in self._written(further, schema.names, by, state, f"{folder}/{name}").items():
                        new[k] = [*new.get(k, []), f]
                marked = [k for k in map(int, lost) if k not in anew]
                if marked:
                    gone |= self._marked(state, name, schema, by, ids.filter(self._bucket(F.col("id"), state).isin(marked)), marked, f"{folder}/gone-{name}")
                content[name], content["gone"][name] = new, gone
            content["rows"] = rows | {str(k): rows.get(str(k), 0) - before.get(str(k), 0) - lost.get(str(k), 0) for k in anew}
            if self._with_terms or state.get("terms") is not None:
                content["terms"] = self._changed_terms(state, ids, [k for k in map(int, lost) if k not in anew], anew, folder)
            fs.mkdirs(path(f"{self.root}/_commits"))
            try:
                stream = fs.create(path(f"{self.root}/_commits/{number}"), False)
            except Exception as e:  # noqa: BLE001  the JVM's; only this kind is a conflict
                if "AlreadyExists" not in str(e):
                    raise
                fs.delete(path(f"{self.root}/{folder}"), True)
                continue
            stream.write(bytearray(json.dumps(content).encode() + b"\n"))
            stream.close()
            self._clean()
            return state, content
        raise ConflictError(self.root)

    def _changed_terms(self, state: dict, ids: DataFrame, marked: list[int], anew: list[int], folder: str) -> list[str]:
        """The folders of the words' statistics after a commit that wrote chunks into folder, marked ids in some buckets and wrote others anew."""

        def of(rows: DataFrame, sign: int) -> DataFrame:
            return term_statistics(rows.select("text")).select("word", (F.col("chunks") * sign).alias("chunks"), (F.col("occurrences") * sign).alias("occurrences"))

        kept = state.get("terms")
        ids = ids.select(F.col("id").alias("document_id"))
        written = self._folders(f"{folder}/chunks")
        new = [f"{self.root}/{f}" for k, f in written.items() if int(k) not in anew]
        parts = [of(self.spark.read.schema(CHUNKS).parquet(*new), 1)] if new else []
        again = [f"{self.root}/{f}" for k, f in written.items() if int(k) in anew]
        if again:  # without what stays there, which was only written once more
            stays = self._read(state, "documents", DOCUMENTS, anew).select(F.col("id").alias("document_id")).join(ids, "document_id", "left_anti")
            parts.append(of(self.spark.read.schema(CHUNKS).parquet(*again).join(stays, "document_id", "left_anti"), 1))
        if kept is None:  # nothing was counted yet: all that stood there, as if it had been
            kept = []
            parts.append(of(self._read(state, "chunks", CHUNKS), 1))
        if marked or anew:
            parts.append(of(self._read(state, "chunks", CHUNKS, [*marked, *anew]).join(ids, "document_id", "left_semi"), -1))
        if len(kept) >= self.PARTS:
            parts.append(self._differences(kept))
            kept = []
        if not parts:
            return kept
        summed(reduce(DataFrame.unionByName, parts)).write.parquet(f"{self.root}/{folder}/terms")
        return [*kept, f"{folder}/terms"]

    def _clean(self) -> None:
        """Removes old commits, and the folders that no kept commit names."""
        fs, path = self._fs()
        numbers = self._names("_commits")
        if len(numbers) <= self.KEPT:
            return
        kept = [c for n in numbers[-self.KEPT :] if (c := self._load(n))]
        named = {"/".join(f.split("/")[:2]) for c in kept for t in ("documents", "chunks") for f in [*(x for parts in c[t].values() for x in _several(parts)), *(g["folder"] for g in c.get("gone", {}).get(t, {}).values())]}
        named |= {"/".join(f.split("/")[:2]) for c in kept for f in c.get("terms") or ()}
        for n in numbers[: -self.KEPT]:
            fs.delete(path(f"{self.root}/_commits/{n}"), False)
        oldest = numbers[-self.KEPT]
        for folder in self._names("data"):
            if folder < oldest and f"data/{folder}" not in named:
                fs.delete(path(f"{self.root}/data/{folder}"), True)

    def upsert(self, documents: DataFrame, chunks: DataFrame, dimension: int | None = None) -> DataFrame:
        """documents (path, title, sha256, mtime, size) and their chunks (path, chunk_index, text, metadata, page, embedding). Returns path and status.

        Of rows of one path the latest is taken. A chunk without an embedding, or with one of another
        dimension, fails the commit. Documents that are updated keep their created_at.
        """
        wrong = F.col("embedding").isNull() if dimension is None else F.coalesce(F.size("embedding") != dimension, F.lit(True))
        checked = chunks.withColumn("embedding", F.when(wrong, F.raise_error(F.lit("a chunk has no embedding of the index's dimension"))).otherwise(F.col("embedding")))
        seen: dict[str, DataFrame] = {}
        held: list[DataFrame] = []

        def once(rows: DataFrame) -> DataFrame:
            """Narrow rows that a commit reads several times, so that the documents' hashes and joins are made once for all."""
            held.append(rows.persist(StorageLevel.MEMORY_AND_DISK))
            return held[-1]

        def change(state: dict) -> tuple[DataFrame, DataFrame, dict[str, int], DataFrame] | None:
            if state["version"] is None:
                state["bounds"] = self._bounds(documents, state)
            rows = once(statuses(self._read(state, "documents", DOCUMENTS), latest(documents)).withColumn("id", self._id(state)))
            seen["rows"] = rows
            changed = rows.filter("status != 'skipped'")
            added = self._counts(changed, state)
            if not added:
                return None
            old = self._read(state, "documents", DOCUMENTS, [int(k) for k in added])
            keys = changed.select(normalize_path(F.col("path")).alias("_p"))
            gone = once(old.join(keys, normalize_path(old["path"]) == F.col("_p"), "left_semi").select("id", normalize_path(F.col("path")).alias("_p"), F.col("created_at").alias("_created")))
            now = F.current_timestamp()
            new = changed.withColumn("_p", normalize_path(F.col("path"))).join(gone.drop("id"), "_p", "left").withColumn("created_at", F.coalesce("_created", now)).withColumn("updated_at", now).select(DOCUMENTS.names)
            new_chunks = checked.join(changed.select("path", F.col("id").alias("document_id")), "path").select(CHUNKS.names)
            return new, new_chunks, added, gone.select("id")

        try:
            done = self._commit(change)
        finally:
            for rows in held:
                rows.unpersist()
        if done is None:
            return seen["rows"].select("path", "status")
        return statuses(self._read(done[0], "documents", DOCUMENTS), latest(documents)).select("path", "status")

    def _remove(self, chosen: Callable[[DataFrame], DataFrame]) -> int:
        """Removes the documents that are chosen, with their chunks; returns how many."""
        n = 0

        def change(state: dict) -> tuple[None, None, dict[str, int], DataFrame] | None:
            nonlocal n
            ids = chosen(self._read(state, "documents", DOCUMENTS)).select("id")
            n = ids.count()
            return (None, None, {}, ids) if n else None

        self._commit(change)
        return n

    def delete(self, document_id: int | None = None, path: str | None = None) -> bool:
        test = F.col("id") == document_id if document_id is not None else normalize_path(F.col("path")) == (path or "").replace("\\", "/")
        return self._remove(lambda rows: rows.filter(test)) > 0

    def prune(self, present: DataFrame) -> int:
        """Removes documents whose path isn't in present(path), whatever its slashes; returns how many."""
        there = present.select(normalize_path(F.col("path")).alias("_p")).distinct()
        return self._remove(lambda rows: rows.join(there, normalize_path(rows["path"]) == F.col("_p"), "left_anti"))
