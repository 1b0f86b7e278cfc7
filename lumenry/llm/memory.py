"""Python workers give freed memory back.

glibc raises the size above which freed blocks return to the system each time
such a block is freed, up to 32 MB; a worker that is used again then keeps the
largest arrays that it ever had.  Importing this module fixes that size.
"""

from __future__ import annotations

import contextlib
import ctypes

_M_MMAP_THRESHOLD = -3


def _fix_threshold(size: int = 1 << 20) -> None:
    with contextlib.suppress(OSError, AttributeError):  # not glibc
        ctypes.CDLL(None).mallopt(_M_MMAP_THRESHOLD, size)


_fix_threshold()
