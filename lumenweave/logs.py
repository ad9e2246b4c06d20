"""Logging: everything to a file, information and above to the console."""

from __future__ import annotations

import logging
from pathlib import Path


def configure(folder: str | Path, name: str = "lumenweave") -> logging.Logger:
    """A logger with one file handler (debug) and one console handler (info); called again, it adds none."""
    log = logging.getLogger(name)
    log.setLevel(logging.DEBUG)
    if not log.handlers:
        Path(folder).mkdir(parents=True, exist_ok=True)
        shape = logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s")
        for handler, level in ((logging.FileHandler(Path(folder) / f"{name}.log", encoding="utf-8"), logging.DEBUG), (logging.StreamHandler(), logging.INFO)):
            handler.setLevel(level)
            handler.setFormatter(shape)
            log.addHandler(handler)
    return log
