"""Structured logging: levels, key=value fields, a scope; silent unless a handler is given."""

from __future__ import annotations

import logging
import sys
from datetime import UTC, datetime

TRACE = 5
logging.addLevelName(TRACE, "TRACE")
LEVELS = {"trace": TRACE, "debug": logging.DEBUG, "info": logging.INFO, "warn": logging.WARNING, "error": logging.ERROR}


class TextHandler(logging.StreamHandler):
    """``time level [scope] message key=value`` to standard error."""

    def format(self, record: logging.LogRecord) -> str:
        fields = "".join(f" {k}={str(v).lower() if isinstance(v, bool) else v}" for k, v in getattr(record, "fields", {}).items())
        stamp = datetime.fromtimestamp(record.created, UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
        return f"{stamp} {record.levelname.lower()} [{record.name.removeprefix('graphloom.')}] {record.getMessage()}{fields}"


def logger(scope: str, level: str | None = None, handler: logging.Handler | None = None) -> logging.Logger:
    out = logging.getLogger(f"graphloom.{scope}")
    if not logging.getLogger("graphloom").handlers:
        logging.getLogger("graphloom").addHandler(logging.NullHandler())
        logging.getLogger("graphloom").propagate = False
    if level is not None:
        out.setLevel(LEVELS[level])
    if handler is not None:
        out.addHandler(handler)
    return out


def log(out: logging.Logger, level: str, message: str, **fields) -> None:
    out.log(LEVELS[level], message, extra={"fields": fields})


def by_verbosity(count: int) -> str:
    return ("warn", "info", "debug", "trace")[min(count, 3)]


def stderr(level: str) -> logging.Handler:
    h = TextHandler(sys.stderr)
    h.setLevel(LEVELS[level])
    return h
