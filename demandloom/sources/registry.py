"""The model registry as tables of one versioned snapshot, models saved beside them.

A change that depends on what is registered (the next version, the champion) is computed from one
snapshot and committed as its successor; if another writer came first it is computed anew.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandloom.operators.registry import (
    CHAMPION,
    candidate_aliases,
    current_aliases,
    promoted_aliases,
    register_candidate,
)
from demandloom.operators.stores import latest_per_key
from demandloom.session import staged
from demandloom.sources.snapshots import Conflict, Part, Snapshot, Store

TABLES = {
    "versions": "model_name string, version long, run_id string, model_path string, created_at timestamp",
    "aliases": "model_name string, alias string, version long, assigned_at timestamp",
    "runs": "run_id string, started_at timestamp",
    "metrics": "run_id string, name string, value double",
    "params": "run_id string, name string, value string",
    "tags": "run_id string, name string, value string",
}


@dataclass(frozen=True)
class Registry:
    spark: SparkSession
    path: str

    @property
    def store(self) -> Store:
        return Store(self.spark, self.path)

    def create(self) -> Registry:
        """An empty registry needs nothing; an existing one is left as it is."""
        return self

    def table(self, name: str, snapshot: Snapshot | None = None) -> DataFrame:
        """A table of one version, the newest if none is given."""
        return self.store.read(name, TABLES[name], snapshot)

    def write(self, name: str, rows: DataFrame) -> Part:
        """Rows of a table for a commit."""
        fields = self.spark.createDataFrame([], TABLES[name]).schema
        return self.store.write(rows.select(*[F.col(f.name).cast(f.dataType) for f in fields]), name)

    def append(self, name: str, rows: DataFrame) -> None:
        part = self.write(name, rows)
        self.store.transact(lambda base: base.with_parts(part))
        self.store.fold(name, TABLES[name])

    def log_run(
        self,
        run_id: str,
        model: PipelineModel,
        metrics: DataFrame,
        params: Mapping[str, object],
        tags: Mapping[str, str],
    ) -> str:
        """Save the model and everything known about its run, in one commit; returns the model path."""
        model_path = f"{self.path}/models/{run_id}"
        model.write().overwrite().save(model_path)
        started = self.spark.createDataFrame([(run_id, datetime.now(timezone.utc))], TABLES["runs"])
        parts = [self.write("runs", started), self.write("metrics", metrics.withColumn("run_id", F.lit(run_id)))]
        for name, values in (("params", params), ("tags", tags)):
            rows = [(run_id, k, str(v)) for k, v in values.items()]
            parts.append(self.write(name, self.spark.createDataFrame(rows, TABLES[name])))
        self.store.transact(lambda base: base.with_parts(*parts))
        for part in parts:
            self.store.fold(part.table, TABLES[part.table])
        return model_path

    def register(self, model_name: str, run_id: str, model_path: str, base: Snapshot | None = None) -> int:
        """Next version of the model, with the candidate alias on it.

        Both are one commit on the snapshot that the version was counted from. When another writer has
        committed in between, the version is counted again from the newest snapshot, so no version is
        given twice. `base` is the snapshot to try first.
        """
        run = self.spark.createDataFrame(
            [(model_name, run_id, model_path)],
            "model_name string, run_id string, model_path string",
        )
        return self.register_all(run, base)[model_name]

    def register_all(self, runs: DataFrame, base: Snapshot | None = None) -> dict[str, int]:
        """Next versions for the runs of some models `(model_name, run_id, model_path)`, in one commit.

        Returns the version that became the candidate of each model; runs come from one writer, so
        their models are few.
        """
        written: list[Part] = []

        def change(now: Snapshot) -> Snapshot:
            versions, _ = register_candidate(self.table("versions", now), runs, datetime.now(timezone.utc))
            part = self.write("versions", versions)
            stored = self.spark.read.schema(TABLES["versions"]).parquet(f"{self.path}/{part.folder}")
            # The alias rows repeat the written versions, so they cannot point at others.
            aliases = self.write("aliases", candidate_aliases(latest_per_key(stored, "model_name", "version")))
            written[:] = [aliases]
            return now.with_parts(part, aliases)

        if base is not None:
            try:
                self.store.commit(base, change(base))
            except Conflict:
                self.store.transact(change)
        else:
            self.store.transact(change)
        named = self.spark.read.schema(TABLES["aliases"]).parquet(f"{self.path}/{written[0].folder}")
        return {r["model_name"]: r["version"] for r in named.select("model_name", "version").collect()}

    def promote(self, decide: Callable[[Snapshot], DataFrame]) -> DataFrame:
        """Decide on one snapshot, move the champion alias of the promoted models, return the decisions.

        The decisions are written down before they are applied: moving an alias changes their input.
        """
        made: list[DataFrame] = []

        def change(now: Snapshot) -> Snapshot:
            decisions = staged(decide(now), "decisions")
            made[:] = [decisions]
            part = self.write("aliases", promoted_aliases(decisions, datetime.now(timezone.utc)))
            return now.with_parts(part) if part.rows else now

        self.store.transact(change)
        return made[0]

    def champion(self, model_name: str) -> tuple[int, str] | None:
        """Version and model path of the champion, None before the first promotion."""
        now = self.store.snapshot()
        found = (
            current_aliases(self.table("aliases", now).where(F.col("model_name") == model_name))
            .where(F.col("alias") == CHAMPION)
            .join(self.table("versions", now), ["model_name", "version"])
            .select("version", "model_path")
            .first()
        )
        return (found["version"], found["model_path"]) if found else None

    def path_of(self, model_name: str, version: int) -> str | None:
        """Where the model of a version is saved."""
        mine = (F.col("model_name") == model_name) & (F.col("version") == version)
        found = self.table("versions").where(mine).select("model_path").first()
        return found["model_path"] if found else None
