"""What a Python worker keeps from task to task: one thing at a time, as Spark uses its workers again for later stages."""
import ctypes
import gc

_HELD = {}


def keep(key, make):
    """The thing of this key, made at its first use. What was held before goes."""
    if key not in _HELD:
        release()
        _HELD[key] = make()
    return _HELD[key]


def release():
    """Let go of what is held, and give memory that is free back to the system where the C library can."""
    _HELD.clear()
    gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
