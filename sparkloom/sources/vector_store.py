"""A flat store of vectors with JSON metadata: create, read, update, delete, pages and nearest items.

Items are (id, vector, metadata, indexed, deleted, created_at, updated_at, version).  A store lives in a folder as
Parquet with a manifest, or in memory; folders with an ``index.json`` of the older one-file form are read and written
in that form.  Changes are made on a snapshot: ``begin_update`` keeps the one before for ``cancel_update``.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterable
from dataclasses import asdict, dataclass, field
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import GraphError, IndexExists, IndexNotFound, ItemNotFound, VectorValidation
from ..functions import vectors
from .scratch import has_rows

SCHEMA = "id string, vector array<float>, metadata string, indexed string, deleted boolean, created_at timestamp, updated_at timestamp, version int"
#: Results of a search that are sent to all executors to fetch their metadata.
MOST_SENT = 10_000
NIL = "00000000-0000-0000-0000-000000000000"


@dataclass
class MetadataConfig:
    """Kept with a store and given back; nothing is enforced."""

    indexed: list[str] = field(default_factory=list)
    reserved: list[str] = field(default_factory=list)
    max_size: int = 1 << 20
    dynamic: bool = True


@dataclass
class HnswConfig:
    """Accepted and kept; searches are exact."""

    m: int = 16
    ef_construction: int = 200
    ef_search: int = 200
    max_elements: int = 10000
    max_levels: int = 16
    max_connections: int = 16
    max_connections_layer0: int = 32
    random_seed: int | None = None


@dataclass
class IndexConfig:
    version: int = 1
    delete_if_exists: bool = False
    distance_metric: str = "cosine"
    metadata_config: MetadataConfig = field(default_factory=MetadataConfig)
    hnsw_config: HnswConfig = field(default_factory=HnswConfig)


class VectorStore:
    """``VectorStore(spark, folder)``, or ``VectorStore.over(spark, df)`` for items that are a DataFrame already."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self.folder = spark, folder.rstrip("/") if folder else None
        self.config = IndexConfig()
        self._items: DataFrame | None = None
        self._before: list[DataFrame | None] = []
        self.one_file = False
        if self.folder and self.is_index_created():
            self._open()

    @classmethod
    def over(cls, spark: SparkSession, items: DataFrame) -> VectorStore:
        """A store over a DataFrame with at least ``id`` and ``vector``."""
        store = cls(spark)
        have = set(items.columns)
        now = F.lit(datetime(1970, 1, 1, tzinfo=UTC)).cast("timestamp")
        defaults = {"metadata": F.lit("{}"), "indexed": F.lit(None).cast("string"), "deleted": F.lit(False), "created_at": now, "updated_at": now, "version": F.lit(1)}
        store._items = items.select("id", F.col("vector").cast("array<float>").alias("vector"), *[F.col(c) if c in have else d.alias(c) for c, d in defaults.items()])
        return store

    # ----------------------------------------------------------------- files

    def _path(self, name: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def _exists(self, name: str) -> bool:
        fs, where = self._path(name)
        return fs.exists(where)

    def _read_text(self, name: str) -> str:
        return self.spark.read.text(f"{self.folder}/{name}", wholetext=True).first()[0]

    def _write_text(self, name: str, text: str) -> None:
        """Written beside and renamed over the old file in one step, so that readers see the old or the new one."""
        fs, where = self._path(name)
        _, temp = self._path(f".{name}.{uuid.uuid4().hex}")
        out = fs.create(temp, True)
        out.write(bytearray(text.encode()))
        out.close()
        jvm = self.spark._jvm
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(temp, where, options)

    def _open(self) -> None:
        if self._exists("manifest.json"):
            manifest = json.loads(self._read_text("manifest.json"))
            self.config = IndexConfig(manifest["version"], False, manifest["distance_metric"], MetadataConfig(**manifest["metadata_config"]), HnswConfig(**manifest["hnsw_config"]))
            if manifest["data"]:
                self._items = self.spark.read.schema(SCHEMA).parquet(f"{self.folder}/{manifest['data']}")
        else:
            self.one_file = True
            index = json.loads(self._read_text("index.json"))
            meta = index.get("metadata_config", {})
            self.config.version = index.get("version", 1)
            self.config.metadata_config = MetadataConfig(**{k: meta[k] for k in ("indexed", "reserved", "max_size", "dynamic") if k in meta})
            rows = [self._row(x) for x in index.get("items", [])]
            if rows:
                self._items = self.spark.createDataFrame(rows, SCHEMA)

    def _row(self, item: dict[str, Any]) -> tuple:
        when = lambda k: datetime.fromisoformat(item[k].replace("Z", "+00:00")) if item.get(k) else datetime.now(UTC)
        metadata = item.get("metadata")
        if item.get("metadata_file"):  # large metadata lies beside the index
            metadata = json.loads(self._read_text(item["metadata_file"]))
        dump = lambda x: None if x is None else json.dumps(x)
        return (item["id"], [float(x) for x in item["vector"]], dump(metadata) or "{}", dump(item.get("indexed")), bool(item.get("deleted", False)), when("created_at"), when("updated_at"), int(item.get("version", 1)))

    def _save(self) -> None:
        if not self.folder or self._before:
            return
        if self.one_file:
            self._save_one_file()
            return
        data = ""
        if self._items is not None:
            data = f"data-{uuid.uuid4().hex}"
            self._items.write.parquet(f"{self.folder}/{data}")
            self._items = self.spark.read.schema(SCHEMA).parquet(f"{self.folder}/{data}")
        c = self.config
        self._write_text("manifest.json", json.dumps({"version": c.version, "distance_metric": c.distance_metric, "metadata_config": asdict(c.metadata_config), "hnsw_config": asdict(c.hnsw_config), "data": data}))

    def _save_one_file(self, inline: int = 1024) -> None:
        items = []
        for r in self._items.toLocalIterator() if self._items is not None else []:
            item = {"id": r["id"], "vector": list(r["vector"]), "metadata": json.loads(r["metadata"]), "indexed": json.loads(r["indexed"]) if r["indexed"] else None, "deleted": r["deleted"], "created_at": r["created_at"].isoformat() + "Z", "updated_at": r["updated_at"].isoformat() + "Z", "version": r["version"]}
            if len(r["metadata"]) > inline:
                self._write_text(f"{r['id']}.json", r["metadata"])
                item |= {"metadata": None, "metadata_file": f"{r['id']}.json"}
            items.append(item)
        self._write_text("index.json", json.dumps({"version": self.config.version, "metadata_config": asdict(self.config.metadata_config), "items": items}))

    # ----------------------------------------------------------------- the index

    def is_index_created(self) -> bool:
        return bool(self.folder) and (self._exists("manifest.json") or self._exists("index.json"))

    def create_index(self, config: IndexConfig | None = None, one_file: bool = False) -> None:
        config = config or IndexConfig()
        if self.is_index_created():
            if not config.delete_if_exists:
                raise IndexExists(self.folder)
            self.delete_index()
        if config.distance_metric not in vectors.METRICS:
            raise GraphError(f"metric {config.distance_metric!r} is none of {', '.join(vectors.METRICS)}")
        self.config, self._items, self.one_file = config, None, one_file
        self._save()

    def delete_index(self) -> None:
        if self.folder:
            fs, where = self._path("")
            fs.delete(where, True)
        self._items = None

    def _live(self) -> DataFrame:
        if self.folder and not self.is_index_created():
            raise IndexNotFound(self.folder)
        if self._items is None:
            return self.spark.createDataFrame([], SCHEMA)
        return self._items.where(~F.col("deleted"))

    # ----------------------------------------------------------------- items

    def _checked(self, items: Iterable[dict[str, Any]]) -> list[tuple]:
        """Rows of new items; none is taken if one is invalid."""
        rows, now, length = [], datetime.now(UTC), self.dimensions()
        for item in items:
            vector = [float(x) for x in item["vector"]]
            if not vector or not all(map(math.isfinite, vector)):
                raise VectorValidation("a vector needs finite components")
            length = length or len(vector)
            if len(vector) != length:
                raise VectorValidation(f"a vector has {len(vector)} components, the index has {length}")
            given = item.get("id")
            rows.append((str(uuid.uuid4()) if given in (None, NIL) else str(given), vector, json.dumps(item.get("metadata") or {}), json.dumps(item["indexed"]) if item.get("indexed") is not None else None, False, now, now, 1))
        return rows

    def dimensions(self) -> int | None:
        if self._items is None:
            return None
        first = self._items.select(F.size("vector")).take(1)
        return first[0][0] if first else None

    def insert_item(self, vector: Iterable[float], metadata: dict[str, Any] | None = None, item_id: str | None = None) -> str:
        return self.insert_items([{"id": item_id, "vector": vector, "metadata": metadata}])[0]

    def insert_items(self, items: Iterable[dict[str, Any]]) -> list[str]:
        """New items; an id that is there already is replaced (an error in the one-file form); of equal ids the last stays."""
        self._live()
        given = self._checked(items)
        rows = list({r[0]: r for r in given}.values())
        if not rows:
            return []
        new = self.spark.createDataFrame(rows, SCHEMA)
        if self.one_file and self._items is not None and has_rows(self._items.join(new, "id", "left_semi")):
            raise GraphError("an item with this id exists")
        self._replace(new)
        return [r[0] for r in given]

    upsert_items = insert_items

    def insert_df(self, items: DataFrame) -> None:
        """New items from a DataFrame with id, vector and optionally metadata: checked in one pass over it."""
        bad = items.agg(F.coalesce(F.bool_and(vectors.is_valid(F.col("vector"))), F.lit(True)), F.min(F.size("vector")), F.max(F.size("vector"))).first()
        length = self.dimensions() or bad[1]
        if not bad[0] or bad[1] != bad[2] or (bad[1] is not None and bad[1] != length):
            raise VectorValidation("vectors need finite components and one length")
        self._replace(VectorStore.over(self.spark, items)._items)

    def _replace(self, new: DataFrame) -> None:
        """Adds items; of several with one id the last update stays."""
        last = Window.partitionBy("id").orderBy(F.col("updated_at").desc(), F.col("version").desc(), F.xxhash64("vector", "metadata"))
        new = new.select("*", F.row_number().over(last).alias("__n")).where("__n = 1").drop("__n")
        if self._items is not None:
            new = self._items.join(new.select("id"), "id", "left_anti").select(*new.columns).unionAll(new)
        self._items = new
        self._save()

    def get_item(self, item_id: str) -> DataFrame:
        return self._live().where(F.col("id") == item_id)

    def update_item(self, item_id: str, vector: Iterable[float] | None = None, metadata: dict[str, Any] | None = None) -> dict[str, Any]:
        """Another vector, and metadata merged over the old key by key; the version goes up."""
        old = self.get_item(item_id).take(1)
        if not old:
            raise ItemNotFound(item_id)
        row = old[0].asDict()
        if vector is not None:
            row["vector"] = self._checked([{"id": item_id, "vector": vector}])[0][1]
        if metadata is not None:
            row["metadata"] = json.dumps({**json.loads(row["metadata"]), **metadata})
        row |= {"updated_at": datetime.now(UTC), "version": row["version"] + 1}
        self._replace(self.spark.createDataFrame([tuple(row.values())], SCHEMA))
        return {"id": item_id, "version": row["version"]}

    def upsert_item(self, item_id: str, vector: Iterable[float], metadata: dict[str, Any] | None = None) -> str:
        if has_rows(self.get_item(item_id)):
            self.update_item(item_id, vector, metadata)
            return item_id
        return self.insert_item(vector, metadata, item_id)

    def delete_item(self, item_id: str) -> None:
        """Marks an item as deleted; one that is not there is an error in the one-file form only."""
        if self.one_file:
            if not has_rows(self.get_item(item_id)):
                raise ItemNotFound(item_id)
            self._items = self._items.where(F.col("id") != item_id)
        elif self._items is not None:
            self._items = self._items.withColumn("deleted", F.col("deleted") | (F.col("id") == item_id))
        self._save()

    def list_items(self, limit: int | None = None, offset: int = 0) -> DataFrame:
        page = self._live().orderBy("id")
        if offset:
            page = page.offset(offset)
        return page if limit is None else page.limit(limit)

    def query_items(self, vector: Iterable[float], k: int = 10, metric: str | None = None, text: str | None = None, filter: Any = None) -> DataFrame:  # noqa: A002
        """The k nearest items with their score, best first; ``text`` is accepted and not used.

        ``filter`` is an object of metadata fields and their values: only items that have them all are looked at.
        Scores are computed from ids and vectors alone; metadata is joined to the k winners.
        """
        query = [float(x) for x in vector]
        if not all(map(math.isfinite, query)):
            raise VectorValidation("a query needs finite components")
        live = self._live()
        score = vectors.similarity(metric or self.config.distance_metric, F.col("vector"), F.array(*[F.lit(x) for x in query]).cast("array<double>"))
        if filter is not None:
            if not isinstance(filter, dict):
                raise GraphError("a filter is an object of metadata fields and values")
            for name, value in filter.items():
                wanted = value if isinstance(value, str) else json.dumps(value, separators=(",", ":"))
                live = live.where(F.get_json_object("metadata", f"$['{name}']") == wanted)
        top = live.select("id", score.alias("score")).where("score is not null").orderBy(F.col("score").desc(), "id").limit(k)
        few = F.broadcast(top) if k <= MOST_SENT else top
        return live.join(few, "id").orderBy(F.col("score").desc(), "id")

    query_items_extended = query_items

    def get_stats(self) -> DataFrame:
        """One row: ``items, size, dimensions, distance_metric``."""
        return self._live().agg(
            F.count("*").alias("items"),
            F.coalesce(F.sum(4 * F.size("vector") + F.length("metadata")), F.lit(0)).cast("long").alias("size"),
            F.max(F.size("vector")).alias("dimensions"),
            F.lit(self.config.distance_metric).alias("distance_metric"),
        )

    # ----------------------------------------------------------------- updates as a whole

    def begin_update(self) -> None:
        self._before.append(self._items)

    def end_update(self) -> None:
        self._before.pop()
        self._save()

    def cancel_update(self) -> None:
        self._items = self._before.pop()
