"""Where log records go: what is below a warning to the standard output, the rest to the standard error."""

from __future__ import annotations

import logging
import sys


class _Below(logging.Filter):
    def filter(self, record: logging.LogRecord) -> bool:
        return record.levelno < logging.WARNING


def to_streams(name: str = "cablewright", level: int = logging.INFO) -> logging.Logger:
    """The driver's logger of that name with both handlers, once."""
    logger = logging.getLogger(name)
    for h in list(logger.handlers):
        logger.removeHandler(h)
    low, high = logging.StreamHandler(sys.stdout), logging.StreamHandler(sys.stderr)
    low.addFilter(_Below())
    high.setLevel(logging.WARNING)
    for h in (low, high):
        h.setFormatter(logging.Formatter("%(levelname)s %(name)s: %(message)s"))
        logger.addHandler(h)
    logger.setLevel(level)
    logger.propagate = False
    return logger
