"""The daily tag job: pick the day's inputs, add yesterday's result, run, write by prefix."""

from __future__ import annotations

import configparser
import os
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession

from ..operators.tagging import user_tags
from ..sources.io import lines, non_empty, save_by_prefix

#: Jobs that run at the same time.
AT_ONCE = 5


def read_config(path: str, export: bool = False) -> dict[str, str]:
    """All keys of all sections of an INI file; with ``export`` they become environment variables too."""
    parser = configparser.ConfigParser()
    with open(path, encoding="utf-8") as f:
        parser.read_file(f)
    out = {k: v for s in parser.sections() for k, v in parser.items(s)}
    if export:
        os.environ.update(out)
    return out


def day_paths(spark: SparkSession, day: date, inputs: Iterable[str], result: str) -> list[str]:
    """The non-empty inputs of the day and, if there is one, yesterday's result.  Paths hold {day}."""
    stamp, before = f"{day:%Y%m%d}", f"{day - timedelta(days=1):%Y%m%d}"
    found = [p for p in (i.format(day=stamp) for i in inputs) if non_empty(spark, p)]
    if not found:
        raise FileNotFoundError(f"no input for {stamp}")
    previous = result.format(day=before) + "/*"
    return found + ([previous] if non_empty(spark, previous) else [])


def run_day(spark: SparkSession, inputs: Iterable[str], result: str, url_dictionary: DataFrame, agent_dictionary: DataFrame, day: date | None = None) -> str:
    """Tags of ``day`` (yesterday by default), written in folders by the first two characters of the adsl."""
    day = day or date.today() - timedelta(days=1)
    tags = user_tags(lines(spark, day_paths(spark, day, inputs, result)), url_dictionary, agent_dictionary)
    out = result.format(day=f"{day:%Y%m%d}")
    save_by_prefix(tags, out, "adsl", "tags")
    return out


def run_jobs(jobs: Iterable[Callable[[], object]], at_once: int = AT_ONCE) -> list[object]:
    """Runs jobs side by side, so many at once; their results in order.  An error stops the rest."""
    with ThreadPoolExecutor(at_once) as pool:
        return list(pool.map(lambda job: job(), jobs))
