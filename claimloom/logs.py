"""Log lines as JSON on standard error; CLAIMLOOM_LOG_LEVEL names the level and CLAIMLOOM_LOG_OFF silences them."""

from __future__ import annotations

import json
import logging
import os
import sys


class _Lines(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        given = {k: v for k, v in record.__dict__.items() if k == "fields"}
        return json.dumps({"time": self.formatTime(record), "level": record.levelname.lower(), "logger": record.name, "event": record.getMessage(), **given.get("fields", {})}, default=str, ensure_ascii=False)


def get(name: str) -> logging.Logger:
    log = logging.getLogger(name)
    if not log.handlers:
        out = logging.StreamHandler(sys.stderr)
        out.setFormatter(_Lines())
        log.addHandler(out)
        log.propagate = False
    log.setLevel(os.environ.get("CLAIMLOOM_LOG_LEVEL", "INFO").upper())
    log.disabled = bool(os.environ.get("CLAIMLOOM_LOG_OFF"))
    return log
