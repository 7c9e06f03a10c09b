"""What a run says: a rotating log file, and lines for parameters, stages and the head."""

import logging
from logging.handlers import RotatingFileHandler
from pathlib import Path

LINE = "%(asctime)s %(levelname)s %(message)s"


def file_logger(folder: str, name: str = "roadweave", size: int = 5 * 1024 * 1024, kept: int = 3) -> logging.Logger:
    """The driver's logger, writing to ``folder``/name.log, with so many older files of that size. Asking again changes nothing."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    log, at = logging.getLogger(name), str(Path(folder, f"{name}.log").resolve())
    if not any(isinstance(h, RotatingFileHandler) and h.baseFilename == at for h in log.handlers):
        handler = RotatingFileHandler(at, maxBytes=size, backupCount=kept, encoding="utf-8")
        handler.setFormatter(logging.Formatter(LINE))
        log.addHandler(handler)
        log.setLevel(logging.INFO)
    return log


def manifest_path(folder: str) -> str:
    return str(Path(folder, "runs"))


def params_line(params: dict, defaults: dict | None = None) -> str:
    """Parameters by name; with defaults only those that differ."""
    return " ".join(f"{k}={v}" for k, v in sorted(params.items()) if defaults is None or v != defaults.get(k)) or "defaults"


def stage_line(name: str, seconds: float, **counts) -> str:
    return " ".join([f"{name} {seconds:.1f} s", *(f"{k}={v}" for k, v in counts.items() if v is not None)])


def head_line(version: str, source: str, libraries: dict[str, str]) -> str:
    return f"version {version}; input {source}; " + ", ".join(f"{k} {v}" for k, v in sorted(libraries.items()))
