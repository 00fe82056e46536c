"""What a training run starts from: a checked dataset, a cleaned copy of it and a configuration."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import validate
from ..operators.rules import Options
from ..sources import jsonl
from . import clean, report

#: Settings that a run may give, by their name in the configuration.
SETTINGS = {"lora_r": "lora_r", "lora_alpha": "lora_alpha", "learning_rate": "learning_rate", "epochs": "num_epochs", "max_seq_len": "max_seq_len"}


def run_id(spark: SparkSession, name: str, now: datetime | None = None) -> str:
    """The time to the second and a slug of the name."""
    at = (now or datetime.now(UTC)).strftime("%Y-%m-%dT%H-%M-%S")
    return f"{at}-" + spark.range(1).select(text.slug(F.lit(name))).first()[0]


def config(model_path: str, data_path: str, output_dir: str, device: str = "cpu", dtype: str = "auto", **settings) -> dict:
    """Only settings that are given, and not None, are part of it."""
    if unknown := set(settings) - set(SETTINGS):
        raise TypeError(f"unknown settings: {', '.join(sorted(unknown))}")
    given = {SETTINGS[k]: v for k, v in settings.items() if v is not None}
    return {"model_path": model_path, "data_path": data_path, "output_dir": output_dir, "device": device, "dtype": dtype} | given


def prepare(spark: SparkSession, dataset: str, root: str, model_path: str, cleaned: bool = False, name: str | None = None, now: datetime | None = None, **settings) -> dict:
    """Checks the dataset, writes a cleaned copy if asked for, and the configuration, under root/runs/<run id>.

    ValueError if the dataset isn't valid, or if cleaning leaves nothing.
    """
    found = validate.require_valid(jsonl.scan(spark, dataset), "train on")
    run = run_id(spark, name or dataset.rstrip("/").rsplit("/", 1)[-1].removesuffix(".jsonl"), now)
    out, data, summary = f"{root.rstrip('/')}/runs/{run}", dataset, None
    if cleaned:
        data = f"{out}/cleaned.jsonl"
        validate.require_kept(clean.clean_file(spark, dataset, data, Options(), dry_run=True))
        summary = clean.clean_file(spark, dataset, data, Options())
    made = config(model_path, data, out, **settings)
    report.write_json(spark, made, f"{out}/config.json")
    return {"run_id": run, "output_dir": out, "config": made, "dataset": found, "cleaning": summary, "samples": summary["kept_lines"] if summary else found["lines"]}
