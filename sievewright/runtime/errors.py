"""Errors: what counts as a violated unique key, and calls that log, fall back or try again without duplicates."""

from __future__ import annotations

import logging
from collections.abc import Callable, Mapping
from typing import TypeVar

X = TypeVar("X")
LOG = logging.getLogger("sievewright")
_UNIQUE = ("unique constraint", "unique violation", "duplicate key", "duplicate entry", "unique key exists")


def log_error(context: str, error: BaseException, details: Mapping[str, object] | None = None) -> None:
    LOG.error("%s: %s%s", context, error, f" {dict(details)}" if details else "")


def is_unique_violation(error: BaseException) -> bool:
    """Whether an error's text says that a unique key exists already, in the words of this engine or of a database."""
    text = str(error).lower()
    return any(x in text for x in _UNIQUE)


def without_duplicates(call: Callable[[], X], again: Callable[[], X], context: str) -> X:
    """call(), or again() where that violates a unique key. Other errors, and those of again(), are logged and raised."""
    try:
        return call()
    except Exception as e:
        if not is_unique_violation(e):
            log_error(context, e)
            raise
    try:
        return again()
    except Exception as e:
        log_error(f"{context}, again", e)
        raise


def guarded(call: Callable[[], X], context: str, fallback: Callable[[], X] | None = None) -> X:
    """call(); an error is logged, and then fallback() counts, if there is one."""
    try:
        return call()
    except Exception as e:
        log_error(context, e)
        if fallback is None:
            raise
    try:
        return fallback()
    except Exception as e:
        log_error(f"{context}, fallback", e)
        raise
