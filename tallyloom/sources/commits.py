"""Several tables in one shared folder that change together.

A commit writes its rows as Parquet under a fresh name, then puts one numbered entry into the log, if no other writer has
put that number. The entry names the batch and what it adds to each table; a reader takes the entries
as they are, so it sees all of a commit or nothing. A writer that died before its entry leaves files that nobody reads. A
batch whose name the log holds is not committed again. A writer that finds its number taken looks at the log anew and
takes the next; changes that were worked out from the tables are then worked out again.

Rows are kept in the order of commits (column ``_commit``), so that later ones win where a reader wants the latest.
The log's entries pass the driver, a few hundred bytes each; rows never do.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

Changes = dict[str, DataFrame]
_SUFFIX = ".json"


class Store:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root, self._jvm = spark, root, spark._jvm
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _put(self, name: str, content: str) -> bool:
        """Writes a whole file under a name that nobody has; False if somebody has it."""
        fresh, to = self._path(f"_log/.{uuid.uuid4().hex}"), self._path(name)
        out = self._fs.create(fresh, False)
        out.write(bytearray(content.encode()))
        out.close()
        try:
            if self._fs.getScheme() == "file":  # a rename would replace the other's
                nio = self._jvm.java.nio.file
                at = lambda p: nio.Paths.get(self._fs.makeQualified(p).toUri())
                nio.Files.createLink(at(to), at(fresh))
            else:
                self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(to.toUri(), self._fs.getConf()).rename(fresh, to, self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0))
            return True
        except Exception as e:
            if "AlreadyExists" in str(e):
                return False
            raise
        finally:
            self._fs.delete(fresh, False)

    def entries(self) -> Iterator[dict]:
        """The log from its first entry: number, batch, tables (their folders)."""
        log = self._path("_log")
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(log)) if self._fs.exists(log) else []
        for name in names:
            if name.endswith(_SUFFIX) and not name.startswith("."):
                stream = self._fs.open(self._path(f"_log/{name}"))
                try:
                    content = bytes(stream.readAllBytes())
                finally:
                    stream.close()
                yield {"number": int(name.removesuffix(_SUFFIX))} | json.loads(content)

    def read(self, table: str, schema: StructType | None = None, up_to: int | None = None) -> DataFrame:
        """All rows of a table, with _commit and, of one commit's rows, their order _nth; up_to: as of that entry. schema: if
        none is given, that of the last rows."""
        paths: dict[int, str] = {}
        for e in self.entries():
            if table in e["tables"] and (up_to is None or e["number"] <= up_to):
                if table in e["replaced"]:
                    paths.clear()
                paths[e["number"]] = e["tables"][table]
        if schema is None:
            if not paths:
                raise ValueError(f"nothing was committed to {table}")
            schema = StructType([f for f in self.spark.read.parquet(f"{self.root}/{paths[max(paths)]}").schema if f.name != "_nth"])
        kept = StructType([*schema.fields]).add("_nth", LongType())
        if not paths:
            return self.spark.createDataFrame([], StructType([*kept.fields]).add("_commit", IntegerType()))
        # one scan of all folders; a folder's name tells its commit
        numbers = self.spark.createDataFrame([(p, n) for n, p in paths.items()], "_of string, _commit int")
        rows = self.spark.read.schema(kept).parquet(*(f"{self.root}/{p}" for p in paths.values())).withColumn("_of", F.regexp_extract("_metadata.file_path", r"(rows/[0-9a-f]{32}/[^/]+)/[^/]*$", 1))
        return rows.join(F.broadcast(numbers), "_of").drop("_of")

    def latest(self, table: str, schema: StructType, key: list[str], up_to: int | None = None) -> DataFrame:
        """The last committed row of each key."""
        order = Window.partitionBy(*key).orderBy(F.desc("_commit"), F.desc("_nth"))
        return self.read(table, schema, up_to).withColumn("_place", F.row_number().over(order)).where("_place = 1").drop("_place", "_commit", "_nth")

    def commit(self, batch: str, changes: Changes | Callable[[int], Changes], replaced: tuple[str, ...] = ()) -> int | None:
        """The number of the batch's entry, or None if the log has the batch. changes: rows by table, or a function that
        works them out from the store as of an entry's number. replaced: tables whose earlier rows go. Give rows that have an order a
        column _nth."""
        written: dict[str, str] | None = None
        while True:
            seen, known = 0, False
            for e in self.entries():
                seen, known = e["number"], known or e["batch"] == batch
            if known:
                return None
            if written is None or callable(changes):
                name = uuid.uuid4().hex
                written = {}
                for table, rows in (changes(seen) if callable(changes) else changes).items():
                    written[table] = f"rows/{name}/{table}"
                    (rows if "_nth" in rows.columns else rows.withColumn("_nth", F.lit(0).cast("long"))).write.parquet(f"{self.root}/{written[table]}")
            if self._put(f"_log/{seen + 1:020d}{_SUFFIX}", json.dumps({"batch": batch, "tables": written, "replaced": list(replaced)})):
                return seen + 1


# ---- observations

SCHEMAS = {
    "products": "offer string, name string, image string, seen_at string",
    "skus": "offer string, sku string, name string, seen_at string",
    "batches": "round_id long, shop string, offer string, seen_at string, skus array<struct<sku:string,name:string,stock:long,price:double>>",
    "versions": "shop string, offer string, seen_at string, name string, image string",
    "snapshots": "round_id long, shop string, offer string, sku string, name string, stock long, price double, seen_at string, attempt long, status string",
    "inventory": "shop string, offer string, sku string, date date, stock long, price double, seen_at string",
}
DEFAULT = "default"


def _schema(table: str) -> StructType:
    return StructType.fromDDL(SCHEMAS[table])


def observed(rows: DataFrame) -> Changes:
    """The changes that a batch of observed SKUs makes. rows: round_id, shop, offer, sku, sku_name, list_title, detail_title, image,
    stock, price, seen_at, attempt. A SKU without an id gets one from its offer and name; the name is the listed one, else the page's.
    Refuses the whole batch (ValueError) if a row lacks its offer, shop, time, SKU name or whole stock, or repeats a SKU of one
    observation."""
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    named = rows.select(
        "round_id", "attempt", *(blank(c).alias(c) for c in ("shop", "offer", "sku_name", "list_title", "detail_title", "image", "seen_at")),
        F.coalesce(blank("sku"), F.substring(F.sha1(F.concat_ws("|", "offer", F.trim("sku_name")).cast("binary")), 1, 16)).alias("sku"), F.col("stock").cast("long").alias("stock"), F.col("price").cast("double").alias("price"),
    )
    lacking = F.greatest(*(F.col(c).isNull() for c in ("shop", "offer", "sku_name", "seen_at", "stock")))
    once = ("round_id", "shop", "offer", "seen_at", "sku")
    bad = named.agg(F.count_if(lacking)).first()[0]
    repeated = named.groupBy(*once).count().where("count > 1").limit(1).count()
    if bad or repeated:
        raise ValueError(f"{bad} rows lack what an observation needs" if bad else "a SKU is repeated in one observation")
    name = F.coalesce("list_title", "detail_title")
    full = named.withColumn("name", name).withColumn("date", F.to_date(F.to_timestamp("seen_at") + F.expr("INTERVAL 8 HOURS")))
    one = ["round_id", "shop", "offer", "seen_at"]
    sku = F.struct("sku", F.col("sku_name").alias("name"), "stock", "price")
    when = F.struct("seen_at", "round_id")
    late = lambda c: F.max_by(c, when).alias(c)
    # observations of one moment and round are told apart by the value itself, so reruns agree
    known = lambda c, as_: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("seen_at", "round_id", c))).alias(as_)
    return {
        "products": full.groupBy("offer").agg(known("detail_title", "name"), known("image", "image"), F.max("seen_at").alias("seen_at")),
        "skus": full.groupBy("offer", "sku").agg(F.max_by("sku_name", F.struct("seen_at", "round_id", "sku_name")).alias("name"), F.max("seen_at").alias("seen_at")),
        "batches": full.groupBy(*one).agg(F.array_sort(F.collect_list(sku)).alias("skus")),
        "versions": full.groupBy("shop", "offer", "seen_at").agg(F.max(F.coalesce("detail_title", "name")).alias("name"), F.max("image").alias("image")),
        "snapshots": full.select("round_id", "shop", "offer", "sku", F.col("sku_name").alias("name"), "stock", "price", "seen_at", "attempt", F.lit("success").alias("status")),
        "inventory": full.groupBy("shop", "offer", "sku", "date").agg(late("stock"), late("price"), F.max("seen_at").alias("seen_at")),
    }


def failed(rows: DataFrame, status: str = "failed") -> Changes:
    """A batch of attempts without a result. rows: round_id, shop, offer, seen_at, attempt."""
    none = F.lit(None)
    return {"snapshots": rows.select("round_id", "shop", "offer", none.cast("string").alias("sku"), none.cast("string").alias("name"), none.cast("long").alias("stock"), none.cast("double").alias("price"), "seen_at", "attempt", F.lit(status).alias("status"))}


def snapshots(store: Store, up_to: int | None = None) -> DataFrame:
    """The last success of each SKU of a round, of the last observation's kind only (the product as one, or its SKUs), and the attempts
    of offers without any success since."""
    every = store.read("snapshots", _schema("snapshots"), up_to)
    offer = Window.partitionBy("round_id", "shop", "offer")
    place = F.struct("_commit", "seen_at")
    default = F.col("sku") == DEFAULT
    marked = every.withColumn("_last", F.max(F.when(F.col("status") == "success", F.struct(place.alias("at"), default.alias("one")))).over(offer))
    good = marked.where((F.col("status") == "success") & (default == F.col("_last.one")))
    last = Window.partitionBy("round_id", "shop", "offer", "sku").orderBy(F.desc("_commit"), F.desc("seen_at"))
    good = good.withColumn("_place", F.row_number().over(last)).where("_place = 1")
    tried = marked.where((F.col("status") != "success") & (F.col("_last").isNull() | (F.col("_commit") > F.col("_last.at._commit"))))
    names = _schema("snapshots").names
    return good.select(*names).unionByName(tried.select(*names))


def products(store: Store, up_to: int | None = None) -> DataFrame:
    """offer, name, image, first_seen, last_seen: what is not blank wins over what came before."""
    at = F.struct("_commit", "seen_at")
    known = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c)
    return store.read("products", _schema("products"), up_to).groupBy("offer").agg(known("name"), known("image"), F.min("seen_at").alias("first_seen"), F.max("seen_at").alias("last_seen"))


def inventory(store: Store, up_to: int | None = None) -> DataFrame:
    """The last row of each shop, offer, SKU and day, of the kind that the day's last observation had."""
    rows = store.latest("inventory", _schema("inventory"), ["shop", "offer", "sku", "date"], up_to)
    day = Window.partitionBy("shop", "offer", "date")
    default = F.col("sku") == DEFAULT
    return rows.withColumn("_last", F.max(F.struct("seen_at", default.alias("one"))).over(day)).where(default == F.col("_last.one")).drop("_last")
