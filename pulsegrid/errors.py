"""Exceptions, and small helpers for the driver side of a pipeline."""

from __future__ import annotations

import functools
import logging
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager


class PulsegridError(Exception):
    """Base of all errors of this package."""


class ConfigurationError(PulsegridError):
    """A setting is missing or wrong."""


class SourceError(PulsegridError):
    """An input cannot be read."""


class SinkError(PulsegridError):
    """An output cannot be written."""


class ValidationError(PulsegridError):
    """Data break a rule."""


def retry(attempts: int = 3, delay: float = 0.5, backoff: float = 2.0, on: type[Exception] = Exception) -> Callable:
    """Calls a function again after an error, waiting longer each time. For driver work; Spark repeats tasks itself."""

    def wrap(f: Callable) -> Callable:
        @functools.wraps(f)
        def call(*args, **kwargs):
            wait = delay
            for left in range(attempts - 1, -1, -1):
                try:
                    return f(*args, **kwargs)
                except on:
                    if not left:
                        raise
                    time.sleep(wait)
                    wait *= backoff

        return call

    return wrap


def logged(f: Callable) -> Callable:
    """Logs how long a driver step took, and its error if it fails."""

    @functools.wraps(f)
    def call(*args, **kwargs):
        log, began = logging.getLogger(f.__module__), time.monotonic()
        try:
            result = f(*args, **kwargs)
        except Exception:
            log.exception("%s failed after %.2f s", f.__name__, time.monotonic() - began)
            raise
        log.info("%s took %.2f s", f.__name__, time.monotonic() - began)
        return result

    return call


def handled(on: type[Exception] | tuple[type[Exception], ...] = Exception, default: object = None, reraise: bool = False) -> Callable:
    """Logs an error of a driver step and gives `default` in its place, or raises it again."""

    def wrap(f: Callable) -> Callable:
        @functools.wraps(f)
        def call(*args, **kwargs):
            try:
                return f(*args, **kwargs)
            except on:
                logging.getLogger(f.__module__).exception("%s failed", f.__name__)
                if reraise:
                    raise
                return default

        return call

    return wrap


class ErrorReport:
    """Errors of the steps of a run, kept so that the other steps go on."""

    def __init__(self) -> None:
        self.errors: list[tuple[str, Exception]] = []

    @contextmanager
    def step(self, name: str, on: type[Exception] | tuple[type[Exception], ...] = Exception) -> Iterator[None]:
        """Notes an error of the block instead of raising it."""
        try:
            yield
        except on as e:
            logging.getLogger(__name__).error("%s: %s", name, e)
            self.errors.append((name, e))

    def counts(self) -> dict[str, int]:
        """Errors by kind."""
        out: dict[str, int] = {}
        for _, e in self.errors:
            out[type(e).__name__] = out.get(type(e).__name__, 0) + 1
        return out

    def check(self) -> None:
        """Raises if there was an error."""
        if self.errors:
            raise PulsegridError("; ".join(f"{n}: {e}" for n, e in self.errors)) from self.errors[0][1]


def set_up_logging(level: str = "INFO", path: str | None = None) -> logging.Logger:
    """The package's logger with one handler to the console and one to a file if named; calling it again replaces them."""
    log = logging.getLogger("pulsegrid")
    log.setLevel(level)
    for old in list(log.handlers):
        log.removeHandler(old)
        old.close()
    for h in [logging.StreamHandler(), *([logging.FileHandler(path)] if path else [])]:
        h.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s %(message)s"))
        log.addHandler(h)
    return log


class Progress:
    """Logs how many of a number of driver steps are done, at every tenth."""

    def __init__(self, total: int, name: str = "steps"):
        self.total, self.name, self.done = max(total, 1), name, 0

    def step(self, n: int = 1) -> None:
        before, self.done = self.done * 10 // self.total, self.done + n
        if self.done * 10 // self.total > before:
            logging.getLogger(__name__).info("%s: %d of %d", self.name, self.done, self.total)
