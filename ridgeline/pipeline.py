"""Import of raw files into the month-partitioned layers, and export of the mart."""

from __future__ import annotations

import argparse
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from datetime import UTC, datetime
from functools import partial, reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline import config
from ridgeline.config import Settings
from ridgeline.operators import ads, dwd
from ridgeline.plans import mart
from ridgeline.sources import raw, snapshots, staging, tables

_REGISTRY = "kind string, path string, sha256 string, status string, error string, imported_at timestamp_ntz"
#: Layers by month.
MONTHLY = ("ods_orders", "dwd_orders", *[f"ads_{n}" for n in ads.TABLES])
STAGES = ("preprocess", "stage", "merge", "build", "publish", "export")


@dataclass
class Result:
    run_id: str
    status: str = "success"
    message: str = ""
    files: int = 0
    skipped: int = 0
    failed: int = 0
    months: list[str] = field(default_factory=list)
    seconds: dict[str, float] = field(default_factory=dict)
    data_version: str | None = None
    mart_rows: dict[str, int] = field(default_factory=dict)


def outcome(failed_files: int, export_error: str | None = None, error: str | None = None) -> tuple[str, str]:
    """Status and message of a run: an export that fails does not undo an import."""
    if error:
        return "failed", error
    message = f"{failed_files} file(s) failed" if failed_files else "import finished"
    if export_error:
        message += f"; export failed: {export_error}"
    return ("partial_success" if failed_files else "success"), message


def version_name(now: datetime, run_id: str) -> str:
    return f"v{now:%Y%m%d%H%M%S}_{run_id[:8]}"


def months_to_build(touched: set[str], known: set[str], rosters_changed: bool, missing_layers: bool) -> list[str]:
    """The months to build: those touched, or all where rosters changed or a layer is missing."""
    return sorted(touched | known) if rosters_changed or missing_layers else sorted(touched)


class Warehouse:
    """The layers and control tables, and the run over them.

    A run sees its own writes; all others see them from its commit on, all at once.  Only the log of runs is written beside that.
    """

    def __init__(self, spark: SparkSession, cfg: Settings):
        self.spark, self.cfg = spark, cfg
        self.root = cfg.table_root.rstrip("/")
        self.snapshots = snapshots.Snapshots(spark, self.root)
        self._run: snapshots.Run | None = None

    @contextmanager
    def writing(self, name: str) -> Iterator[snapshots.Run]:
        """A run that is committed at the end, and leaves no trace for readers if it fails."""
        self._run = self.snapshots.begin(name)
        try:
            yield self._run
            self._run.commit()
        finally:
            self._run = None

    def state(self) -> snapshots.State:
        return self._run.state if self._run else self.snapshots.latest()[1]

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, name: str, months: list[str] | None = None) -> DataFrame:
        return self.snapshots.table(self.state(), name, months)

    def has(self, name: str) -> bool:
        return bool(self.snapshots.there(self.state(), name))

    def run(self, force: bool = False) -> Result:
        """Import what is new under the raw root: raw layer by month, rosters, fact, metrics, version, mart."""
        result = Result(uuid.uuid4().hex)
        clock = time.time()

        def mark(stage: str) -> None:
            nonlocal clock
            result.seconds[stage] = round(time.time() - clock, 3)
            clock = time.time()

        export_error = None
        try:
            with self.writing(result.run_id) as run:
                todo = self._preprocess(result, force)
                mark("preprocess")
                staged, rosters, log = self._stage(result, todo, run)
                mark("stage")
                touched = self._merge(staged, rosters, run)
                mark("merge")
                known = self._months("ods_orders")
                told = self._tell_again(run)
                result.months = months_to_build(touched | self._stale(known), known, bool(rosters) or told, self._incomplete())
                self.build(result.months, run, result.run_id)
                if log:
                    run.append("registry", self.spark.createDataFrame(log, _REGISTRY))  # a run that fails leaves its files to the next one
                mark("build")
                result.data_version = self._version(result.run_id, run)
            self.snapshots.collect()
            mark("publish")
            try:
                result.mart_rows = self.export()
            except Exception as e:  # noqa: BLE001  an export that fails is told, and the import stands
                export_error = str(e)
            mark("export")
            result.status, result.message = outcome(result.failed, export_error)
        except Exception as e:
            result.status, result.message = outcome(result.failed, None, str(e))
            raise
        finally:
            self._log(result)
        return result

    def _months(self, name: str) -> set[str]:
        """Months of a layer whose folders are there."""
        return set(self.snapshots.there(self.state(), name))

    def _incomplete(self) -> bool:
        """Whether a layer is missing, or holds nothing while the raw layer does."""
        return self.has("ods_orders") and not all(self.has(n) for n in ("dwd_orders", "ads_admin_day", "ads_direct_hour"))

    def _stale(self, known: set[str]) -> set[str]:
        """Months of the raw layer that the fact lacks, or whose layers hold other rows than were written."""
        return (known - self._months("dwd_orders")) | {month for layer, month in self.damaged() if layer != "ods_orders" and month in known}

    def profile(self, layers: list[str], months: list[str] | None = None) -> DataFrame:
        """``layer, month, rows, digest`` of layers by month: their rows, and a digest of their keys in any order."""
        state = self.state()
        paths = [self.snapshots.folder(n, r, m) for n in layers for m, runs in self.snapshots.there(state, n).items() if months is None or m in months for r in runs]
        if not paths:
            return self.spark.createDataFrame([], "layer string, month string, rows long, digest long")
        # all layers by one scan of their keys; files tell by their place what they are of
        found = self.spark.read.schema("order_id string, metric_key string").option("recursiveFileLookup", True).parquet(*paths)
        place = F.regexp_extract_all("_metadata.file_path", F.lit("/([^/]+)/run=[^/]+/order_month=([^/]+)/[^/]+$"), F.lit(0))
        part = F.split(F.get(place, F.lit(0)), "/")
        keyed = found.select(F.get(part, F.lit(1)).alias("layer"), F.substring_index(F.get(part, F.lit(3)), "=", -1).alias("month"), F.coalesce("metric_key", "order_id").alias("key"))
        return keyed.groupBy("layer", "month").agg(F.count(F.lit(1)).alias("rows"), F.bit_xor(F.xxhash64("key")).alias("digest"))

    def damaged(self) -> list[tuple[str, str]]:
        """Layers and months that do not hold what their profile says was written."""
        if not self.has("profiles"):
            return []
        layers = [n for n in MONTHLY if self.has(n)]
        if not layers:
            return []
        now = self.profile(layers).alias("n")
        then = tables.latest_by(self.table("profiles"), ["layer", "month"], F.desc("profiled_at")).alias("t")
        odd = now.join(then, ["layer", "month"]).filter((F.col("n.rows") != F.col("t.rows")) | (F.col("n.digest") != F.col("t.digest")))
        return [(r.layer, r.month) for r in odd.select("layer", "month").collect()]

    def _tell_again(self, run: snapshots.Run) -> bool:
        """Fill the raw layer's fields from the rows' payloads where a whole group of them is missing; whether it was."""
        if not self.has("ods_orders"):
            return False
        raw = self.table("ods_orders")

        def none(*fields: str) -> bool:
            return raw.filter(" OR ".join(f"{f} IS NOT NULL" for f in fields)).isEmpty()

        if "payload" not in raw.columns or not (none("order_source", "accept_time", "amount_paid", "employment_status") or none("rider_income", "partner_income")):
            return False
        found = staging.told_again(raw, staging.ORDER_FIELDS)
        if found.filter(" OR ".join(f"{f} IS NOT NULL" for f in ("order_source", "accept_time", "amount_paid", "employment_status", "rider_income", "partner_income"))).isEmpty():
            return False  # the files did not have them
        run.replace_months("ods_orders", found)
        return True

    def registry(self) -> DataFrame:
        """The latest entry of each file."""
        return tables.latest_by(self.table("registry"), ["kind", "path"], F.desc("imported_at"))

    def _preprocess(self, result: Result, force: bool) -> list[tuple[str, str, str, int]]:
        found = staging.discover(self.cfg.raw_root)
        result.files = len(found)
        if not found:
            return []
        prints = {r.path: r for r in raw.fingerprints(self.spark, [p for _, p in found]).collect()}
        files = self.spark.createDataFrame([(k, p, prints[p].sha256, prints[p].size) for k, p in found], "kind string, path string, sha256 string, size long")
        if self.has("registry"):
            files = staging.pending(files, self.registry(), force)
        todo = [(r.kind, r.path, r.sha256, r.size) for r in files.orderBy("kind", "path").collect()]
        result.skipped = len(found) - len(todo)
        return todo

    def _stage(self, result: Result, todo: list[tuple[str, str, str, int]], run: snapshots.Run) -> tuple[DataFrame | None, dict[str, DataFrame], list[tuple]]:
        """Orders and rosters of the files as rows of the raw layer, each kind by one plan, and the files' log."""
        if not todo:
            return None, {}, []
        now = datetime.now(UTC).replace(tzinfo=None)
        run.replace("staged_pieces", raw.survey(self.spark, [(k, p, size) for k, p, _, size in todo]))
        pieces = self.table("staged_pieces")
        errors = {r.path: r.error for r in pieces.filter("error IS NOT NULL").select("path", "error").distinct().collect()}
        log = [(kind, path, sha, "failed" if path in errors else "success", errors.get(path), now) for kind, path, sha, _ in todo]
        result.failed = len(errors)
        whole = {kind for kind, path, *_ in todo if path not in errors}

        def rows(kind: str) -> DataFrame:
            return raw.rows(pieces.filter(F.col("kind") == kind))

        rosters = {k: staging.stage_roster(rows(k), k, F.col("path")).withColumn("imported_at", F.lit(now)) for k in staging.ROSTER_FIELDS if k in whole}
        if "orders" not in whole:
            return None, rosters, log
        run.replace("staged_orders", staging.stage_orders(rows("orders"), F.col("path")).withColumn("imported_at", F.lit(now)))
        staged = self.table("staged_orders")  # read once, whatever is asked of it
        run.append("abnormal_orders", staging.abnormal(staged).withColumn("run_id", F.lit(result.run_id)))
        return staged, rosters, log

    def _merge(self, staged: DataFrame | None, rosters: dict[str, DataFrame], run: snapshots.Run) -> set[str]:
        for kind, df in rosters.items():  # the rows of all files stay, and the latest of an id counts
            run.append(f"ods_{kind}", df)
            run.replace(kind, staging.typed_roster(self.table(f"ods_{kind}"), kind))
        return set() if staged is None else set(run.replace_months("ods_orders", staging.accepted(staged)))

    def _roster(self, kind: str) -> DataFrame:
        if self.has(kind):
            return self.table(kind)
        fields = staging.ROSTER_FIELDS[kind]
        extra = ("province", "city", "district") if kind == "partners" else ()
        schema = ", ".join(f"{n} {'date' if n.endswith('_date') else 'string'}" for n in (*fields, *extra))
        return self.spark.createDataFrame([], schema)

    def build(self, months: list[str], run: snapshots.Run, batch_id: str = "") -> None:
        """Rebuild fact and metric tables of some months."""
        if not months or not self.has("ods_orders"):
            return
        orders = tables.drop_partners(staging.typed_orders(self.table("ods_orders", months)), self.cfg.excluded_partners)
        rosters = {k: self._roster(k) for k in ("riders", "merchants", "partners")}

        def written(layer: str, df: DataFrame) -> None:
            run.drop_months(layer, set(months))  # a month may have no rows any more
            run.replace_months(layer, df)

        written("dwd_orders", dwd.build(orders, cfg=self.cfg, **rosters))
        fact = self.table("dwd_orders", months) if self._months("dwd_orders") & set(months) else None
        if fact is None:
            return

        def metrics(name: str) -> None:
            make = ads.TABLES[name]
            df = make(fact, rosters[ads.WITH_ROSTER[name]]) if name in ads.WITH_ROSTER else make(fact)
            written(f"ads_{name}", ads.keyed(name, df, batch_id))

        tables.together([partial(metrics, name) for name in ads.TABLES])
        now = datetime.now(UTC).replace(tzinfo=None)
        held = [n for n in MONTHLY if self._months(n) & set(months)]
        run.append("profiles", self.profile(held, months).withColumn("profiled_at", F.lit(now)))

    def _version(self, run_id: str, run: snapshots.Run) -> str | None:
        if not self.has("ads_partner_day"):
            return None
        now = datetime.now(UTC).replace(tzinfo=None)
        month = max(self._months("ads_partner_day"))
        name = version_name(now, run_id)
        run.append("versions", self.spark.createDataFrame([(name, run_id, month, now)], "data_version string, run_id string, latest_ready_month string, published_at timestamp_ntz"))
        return name

    def _log(self, result: Result) -> None:
        now = datetime.now(UTC).replace(tzinfo=None)
        rows = [(result.run_id, s, result.seconds.get(s), result.status, result.message, now) for s in STAGES]
        tables.append(self.spark.createDataFrame(rows, "run_id string, stage string, seconds double, status string, message string, logged_at timestamp_ntz"), self.path("runs"))

    def layers(self) -> mart.Layers:
        return mart.Layers(self.table("dwd_orders"), self._roster("riders"), self._roster("merchants"), self._roster("partners"), self.cfg)

    def export(self) -> dict[str, int]:
        """Publish the mart's sixteen tables under their labels."""
        x = self.layers()
        out = {label: mart.labelled(make(x)) for label, make in mart.TABLES.values()}
        if self.has("versions"):
            out["数据版本"] = mart.version(self.table("versions"))
        return tables.publish(out, self.cfg.export_root)

    def status(self) -> dict[str, DataFrame]:
        """The latest run's stages and the last fifty files."""
        runs = tables.read(self.spark, self.path("runs"))
        last = runs.agg(F.max_by("run_id", "logged_at").alias("run_id"))
        runs = runs.join(F.broadcast(last), "run_id").drop("logged_at")
        files = self.registry().orderBy(F.desc("imported_at"), "path").limit(50)
        out = {"runs": runs, "files": files}
        return out | {"version": mart.version(self.table("versions"))} if self.has("versions") else out

    def info(self) -> DataFrame:
        """One row on the state of the data: the last run, its stages and seconds, the latest date, the version, and when each kind of roster last came."""
        def only(df: DataFrame | None, **columns: Column) -> DataFrame:
            own = [c.alias(n) for n, c in columns.items()]
            return df.agg(*own) if df is not None else self.spark.range(1).agg(*[F.first(F.lit(None)).alias(n) for n in columns])

        has_runs = tables.exists(self.spark, self.path("runs"))
        runs = self.status()["runs"] if has_runs else None
        if has_runs:
            at = tables.read(self.spark, self.path("runs")).agg(F.max("logged_at").alias("at"))
        stages = F.map_from_entries(F.collect_list(F.struct("stage", F.coalesce("seconds", F.lit(0.0)))))
        rosters = self.registry().filter("status = 'success' AND kind <> 'orders'").groupBy("kind").agg(F.max("imported_at").alias("at")) if self.has("registry") else None
        parts = [
            only(runs, latest_run_id=F.max("run_id"), last_import_status=F.max("status"), total_seconds=F.round(F.sum("seconds"), 3), stage_seconds=stages),
            only(at if has_runs else None, last_import_time=F.max("at")),
            only(self.table("ads_partner_day") if self.has("ads_partner_day") else None, latest_data_date=F.max("date")),
            only(rosters, roster_versions=F.map_from_entries(F.collect_list(F.struct("kind", "at")))),
            only(mart.version(self.table("versions")) if self.has("versions") else None, data_version=F.max("data_version"), latest_ready_month=F.max("latest_ready_month")),
        ]
        row = reduce(lambda a, b: a.join(b, F.lit(True)), parts)  # one row each
        return row.withColumn("last_import_status", F.coalesce(F.col("last_import_status").cast("string"), F.lit("never_run")))

    def rebuild(self) -> list[str]:
        """Build all from the raw layer anew: fields under the headers that count now, rosters, the fact and the metrics."""
        with self.writing(uuid.uuid4().hex) as run:
            for kind in staging.ROSTER_FIELDS:
                if self.has(f"ods_{kind}"):
                    run.replace(kind, staging.typed_roster(self.table(f"ods_{kind}"), kind))
            months = sorted(self._months("ods_orders"))
            if months:
                run.replace_months("ods_orders", staging.told_again(self.table("ods_orders"), staging.ORDER_FIELDS))
                self.build(months, run)
        return months

    def validate(self) -> DataFrame:
        """``layer, month, rows`` of the raw layer, the fact and each metric table."""
        layers = [n for n in MONTHLY if self.has(n)]
        counts = [self.table(n).groupBy(F.col("order_month").alias("month")).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("layer"), "month", "rows") for n in layers]
        return staging.union_all(counts).orderBy("layer", "month")

    def check(self) -> DataFrame:
        """Riders that orders name by an id the roster lacks, most orders first."""
        fact = self.table("dwd_orders").filter("rider_id IS NOT NULL")
        lost = fact.join(self._roster("riders").select("rider_id"), "rider_id", "left_anti")
        return lost.groupBy("rider_id").agg(F.max("rider_name").alias("rider_name"), F.count(F.lit(1)).alias("orders")).orderBy(F.desc("orders"), "rider_id").limit(10)


def main(argv: list[str] | None = None) -> int:
    """``import`` (``--mode auto|force``), ``export``, ``check``, ``rebuild`` or ``validate``, with ``--config`` for a settings file."""
    parser = argparse.ArgumentParser(prog="ridgeline")
    parser.add_argument("command", choices=("import", "export", "check", "rebuild", "validate"))
    parser.add_argument("--mode", choices=("auto", "force"), default="auto")
    parser.add_argument("--config")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("ridgeline").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    house = Warehouse(spark, config.load(args.config if args.config and Path(args.config).exists() else None))
    if args.command == "import":
        result = house.run(args.mode == "force")
        print(result)
        return 0 if result.status != "failed" else 1
    if args.command == "export":
        print(house.export())
    elif args.command == "rebuild":
        print(house.rebuild())
    elif args.command == "validate":
        house.validate().show(200)
    else:
        house.check().show()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
