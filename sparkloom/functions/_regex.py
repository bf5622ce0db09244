"""Word boundaries by ASCII letters, digits and underscores.

``\\b`` of Java 17 and of Python counts every Unicode letter as part of a word;
the rules here count ASCII only, as the SQL engine of the tests does. Patterns
are written with ``\\b`` and pass through ``ascii_bounds`` on their way to a
regular-expression function.
"""

from __future__ import annotations

import re

_WORD = "[A-Za-z0-9_]"
_BOUND = f"(?:(?<!{_WORD})(?={_WORD})|(?<={_WORD})(?!{_WORD}))"


def ascii_bounds(pattern: str) -> str:
    """The pattern with each ``\\b`` as a boundary of ASCII words; a doubled backslash stays what it is."""
    return re.sub(r"\\(.)", lambda m: _BOUND if m[1] == "b" else m[0], pattern, flags=re.S)
