"""Run settings and the platform list."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Platform:
    id: object
    name: str
    description: str = ""
    catalog: str | None = None
    schema: str | None = None
    seed_file: str | None = None
    seed_table: str | None = None


@dataclass(frozen=True)
class Settings:
    catalog: str = "harmonised"
    schema: str = "mapping"
    platforms: tuple[Platform, ...] = ()
    gold_catalog: str | None = None
    gold_schema: str = "gold"
    high_min: float = 85
    medium_min: float = 60
    exact_confidence: int = 95
    near_confidence: int = 90
    rationale_length: int = 500
    model: str = "model"
    max_calls: int = 8
    attempts: int = 3

    def platform_frame(self, spark: SparkSession) -> DataFrame:
        return platform_frame(spark, self.platforms, self.catalog)


def platform_frame(spark, platforms, default_catalog="harmonised") -> DataFrame:
    """The configured platforms as an ordered relation."""
    rows = [
        (i, p.id, p.name, p.description, f"{p.catalog or default_catalog}.{p.schema or p.id}")
        for i, p in enumerate(platforms)
    ]
    id_type = "bigint" if rows and isinstance(rows[0][1], int) else "string"
    return spark.createDataFrame(
        rows, f"ord int, platform_id {id_type}, name string, description string, location string"
    )


def settings_from_dict(cfg: dict, main_section: str = "main") -> Settings:
    """Settings from the nested configuration mapping: the section naming catalog and schema
    (its name is up to the file), `platforms`, `gold`, `agent` and `llm`."""
    main, agent, gold = (cfg.get(k) or {} for k in (main_section, "agent", "gold"))
    base = Settings()
    catalog = main.get("catalog", base.catalog)
    return Settings(
        catalog=catalog,
        schema=main.get("schema", base.schema),
        platforms=tuple(
            Platform(
                id=p["id"],
                name=p["name"],
                description=p.get("description", ""),
                catalog=p.get("source_catalog"),
                schema=p.get("source_schema"),
                seed_file=p.get("seed_csv"),
                seed_table=p.get("seed_table"),
            )
            for p in cfg.get("platforms") or []
        ),
        gold_catalog=gold.get("catalog", catalog),
        gold_schema=gold.get("schema", base.gold_schema),
        high_min=agent.get("confidence_high_min", base.high_min),
        medium_min=agent.get("confidence_medium_min", base.medium_min),
        exact_confidence=agent.get("deterministic_exact_confidence", base.exact_confidence),
        near_confidence=agent.get("deterministic_near_confidence", base.near_confidence),
        rationale_length=agent.get("max_rationale_length", base.rationale_length),
        max_calls=agent.get("max_concurrent_llm_calls", base.max_calls),
        attempts=agent.get("llm_attempts", base.attempts),
        model=(cfg.get("llm") or {}).get("endpoint", base.model),
    )


def read_settings(path: str, main_section: str = "main") -> Settings:
    """Settings from a JSON file, or a YAML file where a YAML reader is installed."""
    text = Path(path).read_text()
    if str(path).endswith(".json"):
        return settings_from_dict(json.loads(text), main_section)
    try:
        import yaml
    except ImportError as exc:
        raise RuntimeError("reading YAML settings needs the yaml module; use a .json file") from exc
    return settings_from_dict(yaml.safe_load(text) or {}, main_section)
