"""Strict JSON (RFC 8259) on the workers, and one canonical form of its values."""

import json
from decimal import Decimal


def _refuse(name: str):
    raise ValueError(f"not strict JSON: {name}")


def _integer(digits: str):
    return int(digits) if len(digits) < 4000 else Decimal(digits)


def _real(text: str):
    x = float(text)
    if x.is_integer() and abs(x) < 2**53:
        return int(x)
    return x if abs(x) < 1e300 else Decimal(text)


_DECODER = json.JSONDecoder(parse_constant=_refuse, parse_int=_integer, parse_float=_real)
INVALID = object()
_SPACE = " \t\n\r"


def loads(text: str | None):
    """The value of a strict JSON text, or INVALID.

    NaN and Infinity, control characters in strings, a byte order mark and
    anything after the value are refused. Numbers of equal value come out
    equal (1.0 as 1). Text nested deeper than the decoder can follow counts as
    invalid.
    """
    if text is None:
        return INVALID
    try:
        at = len(text) - len(text.lstrip(_SPACE))
        value, end = _DECODER.raw_decode(text, at)
    except (ValueError, RecursionError, ArithmeticError):
        return INVALID
    return INVALID if text[end:].strip(_SPACE) else value


def canonical(value) -> str:
    """One text for each JSON value, whatever its layout, key order and escapes were."""
    return json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"), default=str)


def clean(text: str) -> str:
    """Text that can be stored as UTF-8: lone surrogates become U+FFFD."""
    try:
        text.encode()
        return text
    except UnicodeEncodeError:
        return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def label(value) -> str:
    """A scalar as text: '' for null, strings as they are, anything else as JSON."""
    if value is None:
        return ""
    return clean(value if isinstance(value, str) else canonical(value))
