"""strftime and strptime patterns as Spark patterns."""

from __future__ import annotations

from ..errors import QueryError

# What each conversion prints. Any other letter prints itself.
PRINTED = {"Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "j": "DDD", "b": "MMM", "h": "MMM", "B": "MMMM", "a": "E", "A": "EEEE", "p": "a", "z": "xx", "Z": "z", "F": "yyyy-MM-dd", "T": "HH:mm:ss", "R": "HH:mm", "D": "MM/dd/yy", "f": "SSS"}
#: What is read; one letter takes one digit or two.
READ = {"Y": "yyyy", "y": "yy", "m": "M", "d": "d", "e": "d", "H": "H", "I": "h", "M": "m", "S": "s", "j": "D", "b": "MMM", "B": "MMMM", "a": "E", "A": "EEEE", "p": "a", "z": "xx", "F": "yyyy-M-d", "T": "H:m:s", "R": "H:m", "D": "M/d/yy", "f": "SSS"}
ONE_SIGN = {"%": "%", "n": "\n", "t": "\t"}


def _parts(pattern: str) -> list[tuple[str, str]]:
    """('%', letter) for conversions and ('', text) for text."""
    out, i = [], 0
    while i < len(pattern):
        if pattern[i] == "%" and i + 1 < len(pattern):
            out.append(("", ONE_SIGN[pattern[i + 1]]) if pattern[i + 1] in ONE_SIGN else ("%", pattern[i + 1]))
            i += 2
        else:
            out.append(("", pattern[i]))
            i += 1
    return out


def _text(text: str) -> str:
    return "''" if text == "'" else f"'{text}'" if text.isalpha() or text in "[]{}#" else text


def print_pattern(pattern: str) -> str:
    """For date_format; an unknown conversion prints its letter."""
    return "".join(PRINTED.get(x) or _text(x) if mark else _text(x) for mark, x in _parts(pattern))


def read_pattern(pattern: str) -> str:
    """For to_timestamp; conversions that touch each other take two digits each."""
    parts, out = _parts(pattern), []
    for i, (mark, x) in enumerate(parts):
        if not mark:
            out.append(_text(x))
            continue
        if x not in READ:
            raise QueryError(f"to_date can't read %{x}")
        touches = i and parts[i - 1][0] or i + 1 < len(parts) and parts[i + 1][0]
        out.append(READ[x] * 2 if touches and len(READ[x]) == 1 else READ[x])
    return "".join(out)
