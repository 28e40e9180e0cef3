"""Small builders for SQL expressions."""

from __future__ import annotations

#: ASCII white space between words, as a Spark SQL string literal (which has no escape \f) and as a regex class.
SPACES = r"' \t\n\u000B\u000C\r'"
SPACE_CLASS = r"[ \\t\\n\\x0B\\f\\r]"


def let(name: str, value: str, body: str) -> str:
    """Evaluate `value` once and use it as `name` in `body`, whatever the optimizer makes of it."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def lets(*bindings: tuple[str, str], then: str) -> str:
    for name, value in reversed(bindings):
        then = let(name, value, then)
    return then


def quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"
