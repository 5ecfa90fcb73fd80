"""Plain readings of the contracts' words."""

import math

BLANK = "\x20\x09\x0a\x0b\x0c\x0d"


def words(text):
    """Runs of anything but ASCII white space."""
    out, now = [], []
    for c in text or "":
        if c in BLANK:
            if now:
                out.append("".join(now))
            now = []
        else:
            now.append(c)
    return out + (["".join(now)] if now else [])


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def near(a, b, rel=1e-9):
    return math.isclose(a, b, rel_tol=rel, abs_tol=1e-7)
