"""The OCR engine's settings and the hook that runs an engine over image variants."""

from __future__ import annotations

import os
import shutil
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Environment settings: the engine's command and its language data.
COMMAND, LANGUAGES = "OCR_TESSERACT_CMD", "OCR_TESSDATA_PREFIX"
#: Errors that concern every image alike.
LANGUAGE_ERRORS = ("Failed loading language", "Error opening data file")


class EngineMissing(RuntimeError):
    """The engine or its language data can't be used; no image could be read."""


def read_settings(text: str) -> dict[str, str]:
    """NAME=value lines; blank ones, comments and lines without = don't count, quotes around values go."""
    out = {}
    for line in map(str.strip, text.splitlines()):
        name, equals, value = line.partition("=")
        if equals and not line.startswith("#"):
            out[name.strip()] = value.strip().strip('"').strip("'")
    return out


def settings(path: str = ".env") -> dict[str, str | None]:
    """The engine's settings; the environment wins over the file."""
    found = {}
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            found = read_settings(f.read())
    return {name: os.environ.get(name) or found.get(name) or None for name in (COMMAND, LANGUAGES)}


def available(found: dict[str, str | None], program: str = "tesseract") -> str:
    """The engine's command, or EngineMissing; to be called on the driver before a job."""
    if found.get(COMMAND):
        if not os.path.exists(found[COMMAND]):
            raise EngineMissing(f"{COMMAND} is set, but the file does not exist: {found[COMMAND]}")
        return found[COMMAND]
    command = shutil.which(program)
    if command is None:
        raise EngineMissing(f"{program} isn't on the path; install it or set {COMMAND}")
    return command


def recognised(images: DataFrame, engine: Callable[[bytes, str], str], *keys: str) -> DataFrame:
    """(keys..., name, text, status, error) of image variants (keys..., name, content, config, run_ocr).

    Variants with run_ocr false are left out. An image that can't be read is a row with status runtime_error and an empty
    text; an error that concerns the engine or its languages ends the job. config and run_ocr may be missing or null.
    """
    have = images if "run_ocr" not in images.columns else images.where(F.coalesce("run_ocr", F.lit(True)))
    config = F.coalesce("config", F.lit("")) if "config" in images.columns else F.lit("")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for content, setting in zip(pdf["content"], pdf["config"], strict=True):
                try:
                    rows.append((engine(content, setting), "ok", None))
                except EngineMissing:
                    raise
                except Exception as e:  # noqa: BLE001
                    if any(m in str(e) for m in LANGUAGE_ERRORS):
                        raise EngineMissing(str(e)) from e
                    rows.append(("", "runtime_error", str(e)))
            got = pd.DataFrame(rows, columns=["text", "status", "error"])
            yield pd.concat([pdf[[*keys, "name"]].reset_index(drop=True), got], axis=1)

    kept = ", ".join(f"`{k}` {images.schema[k].dataType.simpleString()}" for k in (*keys, "name"))
    return have.select(*keys, "name", "content", config.alias("config")).mapInPandas(run, f"{kept}, text string, status string, error string")
