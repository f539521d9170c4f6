"""Decorators that log how long a function takes, that it is called, or what it gives back."""

from __future__ import annotations

import functools
import logging
import time as clock
from collections.abc import Callable

log = logging.getLogger("graphloom")


def _wrapped(before: Callable | None, after: Callable | None):
    def decorate(f):
        @functools.wraps(f)
        def run(*args, **kwargs):
            began = clock.perf_counter()
            if before:
                before(f, args, kwargs)
            out = f(*args, **kwargs)
            if after:
                after(f, out, clock.perf_counter() - began)
            return out

        return run

    return decorate


#: Log the seconds a call takes.
time = _wrapped(None, lambda f, out, s: log.info("%s: %.3f s", f.__qualname__, s))
#: Log every call with its arguments.
call = _wrapped(lambda f, a, k: log.info("%s(%s)", f.__qualname__, ", ".join([*map(repr, a), *(f"{n}={v!r}" for n, v in k.items())])), None)
#: Log what a call gives back.
result = _wrapped(None, lambda f, out, s: log.info("%s = %r", f.__qualname__, out))
