"""Inputs of every registered query: the driver's tables shaped into the report model."""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from reportlake.constants import FIXTURE_NOW_MS
from reportlake.operators.dedupe import dedupe_reports
from reportlake.session import ensure_checkpoint_dir
from reportlake.sources import adapters


@dataclass
class Inputs:
    spark: SparkSession
    sf_dir: str
    now_ms: int = FIXTURE_NOW_MS
    store: str | None = None  # stored tables written by :func:`reportlake.sinks.ingest_all`

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def raw_reports(self) -> DataFrame:
        """Report rows before dedupe (with ``line_no``)."""
        return adapters.reports_from_events(self.table("events"))

    @cached_property
    def reports(self) -> DataFrame:
        """The fact table: first writer wins on TX_HASH (read from ``store`` when one is given)."""
        if self.store:
            from reportlake import sinks

            return sinks.open_store(self.spark, self.store)
        return dedupe_reports(self.raw_reports)

    def _stored(self, name: str) -> DataFrame | None:
        return self.spark.read.parquet(f"{self.store}/{name}") if self.store else None

    @cached_property
    def registry(self) -> DataFrame:
        return self._stored("registry") or adapters.registry_from_customers(self.table("customer"), self.now_ms)

    @cached_property
    def supplier_registry(self) -> DataFrame:
        """A registry that doesn't cover all reporters: one row per supplier."""
        return adapters.registry_from_suppliers(self.table("supplier"), self.now_ms)

    @cached_property
    def mappings(self) -> DataFrame:
        return self._stored("mappings") or adapters.mappings_from_events(self.table("events"))

    @cached_property
    def snapshots(self) -> DataFrame:
        return self._stored("snapshots") or adapters.snapshots_from_reports(self.raw_reports)

    def scratch(self, name: str) -> str:
        """A fresh folder under the shared checkpoint folder (``spark.checkpoint.dir``)."""
        base = ensure_checkpoint_dir(self.spark).rstrip("/")
        return f"{base}/reportlake-{name}-{uuid.uuid4().hex[:12]}"
