"""Logging of the driver: INFO to the console, DEBUG to a rotating file where a folder is given."""

from __future__ import annotations

import logging
import os
from logging.handlers import RotatingFileHandler

FORMAT = "%(asctime)s %(levelname)s %(name)s: %(message)s"
FILE_BYTES, FILES = 5 << 20, 3


def logger(name: str = "scriptorium", folder: str | None = None) -> logging.Logger:
    """The logger of that name; its handlers are set once, and a file once a folder."""
    out = logging.getLogger(name)
    out.setLevel(logging.DEBUG)
    out.propagate = False
    if not any(type(h) is logging.StreamHandler for h in out.handlers):
        console = logging.StreamHandler()
        console.setLevel(logging.INFO)
        console.setFormatter(logging.Formatter(FORMAT))
        out.addHandler(console)
    if folder:
        path = os.path.abspath(os.path.join(folder, f"{name}.log"))
        if not any(isinstance(h, RotatingFileHandler) and h.baseFilename == path for h in out.handlers):
            os.makedirs(folder, exist_ok=True)
            file = RotatingFileHandler(path, maxBytes=FILE_BYTES, backupCount=FILES, encoding="utf-8")
            file.setFormatter(logging.Formatter(FORMAT))
            out.addHandler(file)
    return out
