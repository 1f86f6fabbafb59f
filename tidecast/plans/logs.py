"""Where the library's messages go."""

from __future__ import annotations

import logging
import sys

FORMAT = "%(asctime)s %(levelname)s %(name)s: %(message)s"


def configure_logging(level: str | int = "INFO", file_level: str | int = "DEBUG", path: str | None = None) -> logging.Logger:
    """Messages from ``level`` on to standard error, and from ``file_level`` on to a file on the driver if one is named.

    Calling it again replaces the handlers that it has set, and nothing else's.
    """
    log = logging.getLogger("tidecast")
    for h in [h for h in log.handlers if getattr(h, "_of_tidecast", False)]:
        log.removeHandler(h)
        h.close()
    handlers = [(logging.StreamHandler(sys.stderr), level)] + ([(logging.FileHandler(path, encoding="utf-8"), file_level)] if path else [])
    for h, own in handlers:
        h._of_tidecast = True
        h.setLevel(own)
        h.setFormatter(logging.Formatter(FORMAT))
        log.addHandler(h)
    log.setLevel(min(h.level for h, _ in handlers))
    return log
