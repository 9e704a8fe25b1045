"""The dataflow jobs as streams between topics. Each job is a query of its own; topics are the boundaries between them."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.columns import is_entry
from ..operators import changes, logs, parse, route
from ..plans import stats, wide
from ..schemas import CHANGE_EVENT, KEYWORD_STATS, ORDER_DETAIL, ORDER_INFO, PAGE_LOG, PAYMENT_INFO, PRODUCT_STATS, PROVINCE_STATS, VISITOR_STATS
from ..sources import rollups, topics
from ..sources.dims import DimStore
from ..sources.jdbc import JdbcSink
from . import state

#: Names of the topics that the jobs read and write.
ODS_LOG, ODS_DB, ODS_CONFIG = "ods_base_log", "ods_base_db", "ods_config"
PAGE, START, DISPLAY, DIRTY = "dwd_page_log", "dwd_start_log", "dwd_display_log", "dirty_log"
DAY_MS = 24 * 3600 * 1000
UNIQUE, BOUNCE, WIDE, PAYMENT_WIDE = "dwm_unique_visit", "dwm_user_jump_detail", "dwm_order_wide", "dwm_payment_wide"
FAVOR, CART, REFUND, COMMENT = "dwd_favor_info", "dwd_cart_info", "dwd_order_refund_info", "dwd_comment_info"

#: Column orders of the statistics' sinks.
SINKS = {"visitor_stats": VISITOR_STATS, "product_stats": PRODUCT_STATS, "province_stats": PROVINCE_STATS, "keyword_stats": KEYWORD_STATS}
#: What orders changes: time and place at the source, then place in the topic.
PLACED = {"_at": "ts_ms", "_pos": "pos", "_place": "position", "_line": "line"}

#: Columns of a change event.
CHANGES = [x.split()[0] for x in CHANGE_EVENT.split(", ")]


@contextmanager
def kept(rows: DataFrame) -> Iterator[DataFrame]:
    """Rows that several actions of a batch read, kept for them."""
    rows.persist()
    try:
        yield rows
    finally:
        rows.unpersist()


class Jobs:
    """root holds topics (folders of files, and logs), dimensions, statistics and checkpoints; every job takes what is there,
    or runs on with `every`. per_trigger: files of a micro-batch, which bounds what a visitor has in one. database: a JDBC address that takes the
    statistics, too."""

    def __init__(self, spark: SparkSession, root: str, every: str | None = None, per_trigger: int = 1000, database: str | None = None):
        self.spark, self.root, self.every, self.per_trigger, self.database = spark, root.rstrip("/"), every, per_trigger, database
        self.dims = DimStore(spark, f"{self.root}/dims")

    def raw(self, topic: str, **options) -> DataFrame:
        """A topic's records: its log, if it is there when the job starts, and files that are dropped into its folder. Spark
        runs what is there in a log as one batch; files come per_trigger at a time."""
        fs, of = topics.file_system(self.spark, folder := f"{self.root}/topics/{topic}")
        log = fs.exists(of(f"{self.root}/logs/{topic}"))
        if log and not fs.exists(of(folder)):
            return topics.logged(self.spark, topic, f"{self.root}/logs", stream=True, **options)
        files = topics.read_topic(self.spark, topic, f"{self.root}/topics", stream=True, per_trigger=self.per_trigger, **options)
        return files.unionByName(topics.logged(self.spark, topic, f"{self.root}/logs", stream=True, **options)) if log else files

    def files(self, path: str) -> DataFrame:
        """Records of all files under a path (or a pattern); there may be none yet."""
        return self.spark.readStream.format("text").option("recursiveFileLookup", True).option("maxFilesPerTrigger", self.per_trigger).load(path)

    def read(self, topic: str, schema: str, **options) -> DataFrame:
        return parse.parse_strict(self.raw(topic, **options), schema)

    def facts(self, topic: str, schema: str) -> DataFrame:
        """A fact topic: files in the topic's own folder and those that split_db routes to it. Values may be strings, as
        change events have them; one that does not fit its type fails the job."""
        raw = self.files(f"{self.root}/{{topics/{topic},facts/batch-*/topic={topic}}}")
        fields = T.StructType.fromDDL(schema).fields
        return parse.parse_strict(raw, ", ".join(f"`{f.name}` string" for f in fields)).select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in fields))

    def batches(self, topic: str, schema: str) -> DataFrame:
        """A topic that a job writes in folders of its batches; there may be none yet."""
        return parse.parse_strict(self.files(f"{self.root}/topics/{topic}/batch-*"), schema)

    def _write(self, rows: DataFrame, topic: str, job: str) -> StreamingQuery:
        return topics.stream_to_topic(rows, topic, f"{self.root}/topics", f"{self.root}/checkpoints/{job}", self.every)

    def _each(self, rows: DataFrame, each, job: str) -> StreamingQuery:
        return topics.start(rows, each, f"{self.root}/checkpoints/{job}", self.every)

    def _replace(self, rows: DataFrame, path: str, batch: int) -> None:
        """A batch's own folder, which stays as it is if the batch is run again: what others have read does not come twice."""
        topics.write_once(rows, f"{path}/batch-{batch}", lambda w, p: w.text(p))

    def _stats(self, rows: DataFrame, name: str, batch: int) -> None:
        """A batch of statistics: as files, into the sums that dashboards read, and into a database if there is one."""
        with kept(rows) as rows:
            topics.write_once(rows, f"{self.root}/stats/{name}/batch={batch}", lambda w, p: w.parquet(p))
            rollups.rollup(self.spark, self.root, name).add(rollups.prepared(name, rows), batch)
            if self.database:
                JdbcSink(self.spark, self.database, name, SINKS[name]).write(rows, batch)

    def sums(self, name: str) -> DataFrame | None:
        """The sums of a statistics table so far, for the dashboard queries."""
        return rollups.rollup(self.spark, self.root, name).read()

    def change_capture(self, feed: str) -> StreamingQuery:
        """A change-capture feed (a folder of JSON files) -> ODS changes."""
        events = parse.change_events(topics.change_feed(self.spark, feed, stream=True))
        return self._log(events, ODS_DB, "change_capture")

    def snapshot_capture(self, snapshot: str, feed: str, database: str, table: str, pk: list[str], at: int | None = None) -> StreamingQuery:
        """A table's snapshot (a folder of Parquet files, which may come one after another) and then its log -> ODS changes,
        each change once (see operators.changes.handover). Rows of the snapshot stand at the position in their column _pos,
        that of their chunk, or all `at`."""
        schema = self.spark.read.parquet(snapshot).schema
        rows = self.spark.readStream.schema(schema).parquet(snapshot)
        taken = changes.snapshot_events(rows, database, table, F.col("_pos") if "_pos" in schema.names else F.lit(at))
        log = parse.change_events(topics.change_feed(self.spark, feed, stream=True)).filter((F.col("database") == database) & (F.col("tableName") == table))
        return self._log(changes.handover(taken, log.select(*CHANGES), pk, at), ODS_DB, f"snapshot_{table}")

    def _log(self, rows: DataFrame, topic: str, job: str) -> StreamingQuery:
        """Rows to a topic's log: a batch is one commit, whatever runs again."""
        return self._each(rows, lambda b, n: topics.append_log(topics.as_records(b), f"{self.root}/logs", topic, job, n), job)

    def split_log(self) -> StreamingQuery:
        """ODS log -> dirty, start, page and display topics, with is_new repaired."""
        good, dirty = parse.parse(self.raw(ODS_LOG), PAGE_LOG)
        keyed = good.withColumns({"mid": F.col("common.mid"), "is_new": F.col("common.is_new")})
        fixed = state.repair_is_new(keyed.filter("mid is not null"), "mid", "is_new", ["ts"])
        fixed = fixed.unionByName(keyed.filter("mid is null"))  # nobody's state
        fixed = fixed.withColumn("common", F.col("common").withField("is_new", F.col("is_new"))).drop("mid", "is_new")

        def each(batch: DataFrame, n: int) -> None:
            with kept(batch):
                parts = logs.split_log(batch)
                for name, topic in (("start", START), ("page", PAGE), ("display", DISPLAY)):
                    self._replace(topics.as_records(parts[name]), f"{self.root}/topics/{topic}", n)

        self.dirty = topics.start(dirty, lambda b, n: self._replace(b.select("value"), f"{self.root}/topics/{DIRTY}", n), f"{self.root}/checkpoints/dirty_log", self.every)
        return self._each(fixed, each, "split_log")

    def pages(self) -> DataFrame:
        return parse.parse_strict(self.files(f"{self.root}/topics/{PAGE}"), PAGE_LOG)

    def unique_visit(self) -> StreamingQuery:
        entries = self.pages().filter(is_entry(F.col("page.last_page_id"))).withColumn("mid", F.col("common.mid"))
        out = state.unique_visits(state.with_day(entries), "mid", "day", ["ts"], DAY_MS if self.every else None)
        return self._write(out.drop("mid", "day"), UNIQUE, "unique_visit")

    def bounce(self, within_ms: int = 10_000) -> StreamingQuery:
        rows = self.pages().withColumns({"mid": F.col("common.mid"), "entry": is_entry(F.col("page.last_page_id")), "et": F.timestamp_millis("ts")})
        out = state.bounces(rows, "mid", "entry", "et", "ts", ["ts"], within_ms)
        return self._write(out.drop("mid", "entry"), BOUNCE, "bounce")

    def split_db(self, config: str) -> StreamingQuery:
        """Changes -> dimensions and fact topics, by the configuration (a parquet folder) as it is at each batch. Of several
        changes to a key the last at the source counts: by its time and place there, or by its place in the topic. A
        dimension is made before its first row."""
        events = self.read(ODS_DB, CHANGE_EVENT, positions=True)

        def each(batch: DataFrame, n: int) -> None:
            routes = route.current_routes(self.spark.read.parquet(config), "seq")
            with kept(route.route(topics.in_order(batch), routes)) as routed:
                self._store(routed, routes, n)
                self._facts(routed, n)

        return self._each(events, each, "split_db")

    def route_db(self, table: str = "table_process", source: str | None = ODS_CONFIG) -> StreamingQuery:
        """Changes -> dimensions and fact topics, by the configuration of each change's time. The configuration is itself a feed
        of changes to a table: in a topic of its own (source), among the others, or both. Its versions are kept (routes),
        placed as all changes are: by time and place at the source where there are such, and then by their arrival. What has
        no route at its time is set apart (unrouted), with the reason; a deleted row ends its route. It runs in place of
        split_db, with which it would share the numbers of the dimensions' versions."""
        events = self.read(ODS_DB, CHANGE_EVENT, positions=True)
        if source is not None:
            events = events.unionByName(self.read(source, CHANGE_EVENT, positions=True))

        def each(batch: DataFrame, n: int) -> None:
            place = F.struct(*(F.col(c).alias(k) for k, c in PLACED.items()))
            with kept(topics.in_order(batch)) as rows:
                changed = route.route_changes(rows.filter(F.col("tableName").eqNullSafe(table)), place)
                if not changed.isEmpty():
                    topics.write_once(changed, f"{self.root}/routes/batch={n}", lambda w, p: w.parquet(p))
                fs, of = topics.file_system(self.spark, self.root)
                known = self.spark.createDataFrame([], changed.schema)
                if fs.exists(of(f"{self.root}/routes")):
                    known = self.spark.read.schema(changed.schema).parquet(f"{self.root}/routes").filter(F.col("batch") <= n).drop("batch")
                history = route.route_history(known)
                with kept(route.route_at(rows.filter(~F.col("tableName").eqNullSafe(table)), history, place)) as met:
                    routed = met.filter("status = 'routed'")
                    self._store(routed, history.filter("sinkType is not null"), n)
                    self._facts(routed, n)
                    apart = topics.as_records(met.filter("status <> 'routed'").select("status", *CHANGES))
                    self._replace(apart, f"{self.root}/unrouted", n)

        return self._each(events, each, "route_db")

    def _store(self, routed: DataFrame, routes: DataFrame, n: int) -> None:
        """The dimensions of the routes, with the routed rows of a batch."""
        rows = route.split_routed(routed)["dim"]
        known = routes.filter("sinkType = 'hbase'").select("sinkTable", F.coalesce("sinkPk", F.lit("id")).alias("pk"), F.coalesce("sinkColumns", F.lit("")).alias("names"), "sinkExtend").distinct().collect()  # as many as configured tables
        for table, pk in sorted({(r.sinkTable, r.pk) for r in known}):
            own = [r for r in known if (r.sinkTable, r.pk) == (table, pk)]
            names = sorted({x for r in own for x in r.names.split(",") if x} | {pk})
            if any(r.names for r in own):
                self.dims.create(table, ",".join(names), pk, next((r.sinkExtend for r in own if r.sinkExtend), None))
            new = rows.filter((F.col("sinkTable") == table) & (F.col("sinkPk") == pk)).select(*(F.col("after")[c].alias(c) for c in names), *(F.col(x).alias(k) for k, x in PLACED.items()))
            if not new.filter(F.col(pk).isNotNull()).isEmpty():
                self.dims.upsert(table, new, [pk], list(PLACED), n)

    def _facts(self, routed: DataFrame, n: int) -> None:
        """The fact topics of a batch: records are after images."""
        facts = route.split_routed(routed)["fact"].select(F.coalesce("sinkTable", F.lit("DWD_DEFAULT")).alias("topic"), F.to_json("after").alias("value"))
        topics.write_once(facts, f"{self.root}/facts/batch-{n}", lambda w, p: w.partitionBy("topic").text(p))

    def order_wide(self, info: str = "dwd_order_info", detail: str = "dwd_order_detail", before: str = "5 seconds", after: str = "5 seconds", delay: str = "0 seconds") -> StreamingQuery:
        i = wide.with_times(self.facts(info, ORDER_INFO)).withWatermark("et", delay)
        d = wide.with_times(self.facts(detail, ORDER_DETAIL)).withWatermark("et", delay)
        joined = wide.order_wide(i, d, before, after)
        names = {"user": "dim_user_info", "province": "dim_base_province", "sku": "dim_sku_info", "spu": "dim_spu_info", "trademark": "dim_base_trademark", "category3": "dim_base_category3"}

        def each(batch: DataFrame, n: int) -> None:
            with kept(batch):
                current = {k: self.dims.dim(t) for k, t in names.items()}  # as they are now
                self._replace(topics.as_records(wide.with_dims(batch, current)), f"{self.root}/topics/{WIDE}", n)

        return self._each(joined, each, "order_wide")

    def payment_wide(self, payment: str = "dwd_payment_info", before: str = "15 minutes", after: str = "5 seconds", delay: str = "0 seconds") -> StreamingQuery:
        p = wide.with_times(self.facts(payment, PAYMENT_INFO)).withWatermark("et", delay)
        schema = (
            "detail_id bigint, order_id bigint, sku_id bigint, order_price decimal(16,2), sku_num bigint, sku_name string, split_total_amount decimal(16,2), split_activity_amount decimal(16,2), "
            "split_coupon_amount decimal(16,2), province_id bigint, order_status string, user_id bigint, total_amount decimal(16,2), activity_reduce_amount decimal(16,2), coupon_reduce_amount decimal(16,2), "
            "original_total_amount decimal(16,2), feight_fee decimal(16,2), split_feight_fee decimal(16,2), expire_time string, create_time string, operate_time string, create_date string, create_hour string, "
            "et timestamp, user_age int, user_gender string, province_name string, province_area_code string, province_iso_code string, province_3166_2_code string, category3_id bigint, spu_id bigint, "
            "tm_id bigint, spu_name string, tm_name string, category3_name string"
        )
        orders = self.batches(WIDE, ", ".join(f"{x.split()[0]} string" for x in schema.split(", ")))
        orders = orders.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(schema).fields)).withWatermark("et", delay)
        joined = wide.payment_wide(p, orders, before, after)
        return self._each(joined, lambda b, n: self._replace(topics.as_records(b), f"{self.root}/topics/{PAYMENT_WIDE}", n), "payment_wide")

    def product_stats(self, size: str = "10 seconds", delay: str = "2 seconds") -> StreamingQuery:
        """The seven sources, aggregated; names are looked up afterwards, as they are at each batch."""
        acted = "sku_id bigint, create_time string"
        rows = stats.product_sources(
            logs.clicks_and_displays(self.batches(PAGE, PAGE_LOG)),
            self.facts(FAVOR, acted),
            self.facts(CART, acted),
            self.batches(WIDE, f"{acted}, et timestamp, order_id bigint, sku_num bigint, total_amount decimal(16,2)"),
            self.batches(PAYMENT_WIDE, "sku_id bigint, payment_create_time string, et timestamp, split_total_amount decimal(16,2), order_id bigint"),
            self.facts(REFUND, f"{acted}, order_id bigint, refund_amount decimal(16,2)"),
            self.facts(COMMENT, f"{acted}, appraise string"),
        )
        out = stats.product_stats(rows, size, delay)

        def each(batch: DataFrame, n: int) -> None:
            with kept(batch):
                found = (self.dims.dim(t) for t in ("dim_sku_info", "dim_spu_info", "dim_base_category3", "dim_base_trademark"))
                self._stats(stats.product_dims(batch, *found), "product_stats", n)

        return self._each(out, each, "product_stats")

    def visitor_stats(self, size: str = "10 seconds", delay: str = "11 seconds") -> StreamingQuery:
        unique, bounce = (self.read(t, PAGE_LOG) for t in (UNIQUE, BOUNCE))
        out = stats.visitor_stats(stats.visitor_rows(self.pages(), unique, bounce), size, delay)
        return self._each(out, lambda b, n: self._stats(b.select(*VISITOR_STATS), "visitor_stats", n), "visitor_stats")

    def province_stats(self, size: str = "10 seconds", delay: str = "1 second") -> StreamingQuery:
        raw = self.files(f"{self.root}/topics/{WIDE}")
        schema = "order_id bigint, split_total_amount decimal(16,2), province_id bigint, province_name string, province_area_code string, province_iso_code string, province_3166_2_code string, et timestamp"
        out = stats.province_stats(self.spark, parse.parse_strict(raw, schema), size, delay)
        return self._each(out, lambda b, n: self._stats(b.select(*PROVINCE_STATS), "province_stats", n), "province_stats")

    def keyword_stats(self, splitter: str | None = None, size: str = "10 seconds", delay: str = "1 second") -> StreamingQuery:
        out = stats.keyword_stats(self.spark, stats.searches(self.pages()), splitter, size, delay)
        return self._each(out, lambda b, n: self._stats(b, "keyword_stats", n), "keyword_stats")
