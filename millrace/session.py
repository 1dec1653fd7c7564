"""Sessions with the settings that the dialect's semantics rest on."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Settings:
    """UTC and case-sensitive names, ANSI errors, and adaptive execution with splitting of skewed joins."""

    app: str = "millrace"
    master: str | None = None
    extra: dict[str, str] = field(default_factory=dict)

    def conf(self) -> dict[str, str]:
        return {
            "spark.sql.session.timeZone": "UTC",
            "spark.sql.caseSensitive": "true",
            "spark.sql.ansi.enabled": "true",
            "spark.sql.adaptive.enabled": "true",
            "spark.sql.adaptive.skewJoin.enabled": "true",
            "spark.sql.adaptive.coalescePartitions.enabled": "true",
            "spark.sql.parquet.filterPushdown": "true",
        } | self.extra


def build_session(settings: Settings | None = None) -> SparkSession:
    settings = settings or Settings()
    builder = SparkSession.builder.appName(settings.app)
    if settings.master:
        builder = builder.master(settings.master)
    for key, value in settings.conf().items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
