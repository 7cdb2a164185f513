"""The personal-data contract, one text at a time with Python's re."""

import hashlib
import re

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    s = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        s += x - 9 if x > 9 else x
    return s % 10 == 0


def valid(kind, v):
    d = re.sub("[^0-9]", "", v)
    if kind == "ip":
        return all(int(p) <= 255 for p in v.split("."))
    if kind == "card":
        return 16 <= len(d) <= 19 and luhn(d)
    if kind == "phone":
        return 8 <= len(d) <= 15
    return True


def base(text):
    """(kind, start, end) of the contract's spans."""
    return [(k, m.start(), m.end()) for k, p in PLAIN.items() for m in re.finditer(p, text or "") if valid(k, m.group())]


def digest(text):
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in base(text)).encode()).hexdigest()
