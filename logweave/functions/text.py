"""Patterns over log messages: masking of what varies, captures, timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What an address and a path look like.
IP = r"(?:\d{1,3}\.){3}\d{1,3}"
WHOLE_IP = rf"^{IP}$"
PATH = r"(?:[A-Za-z]:\\|/)[^\s,;]+"

# What is masked, in this order, and the keys whose numbers stay.
# Each begins with a look ahead, so that most places fail before the costlier looks behind.
_MASKS = (
    (r"(?U)(?=\d)(?<![A-Za-z0-9])(?:\d{1,3}\.){3}\d{1,3}(?![A-Za-z0-9])", "<IP>"),
    (r"(?iU)(?=[0-9a-f]{8}-)\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b", "<UUID>"),
    (r"(?iU)(?=0x)\b0x[0-9a-f]{6,}\b", "<HEX>"),
)
_MASKABLE = r"[\p{Nd}-]"  # each mask needs a digit, but for a UUID of letters
_NUMBER = r"(?U)(?=\d)(?<![A-Za-z_])\d+(?![A-Za-z_])"
_KEPT = r"(?iU)(?=\d)(?<==)(?<=(?:eventid|status|result|action)=)"


def mask(message: Column) -> Column:
    """The message with addresses, UUIDs, long hex numbers and other numbers replaced by placeholders.

    Numbers right after eventid=, status=, result= or action= stay, in any case, however long: a message
    that has one is cut there, and each piece but the first keeps the digits that it begins with. A message
    without a digit or a hyphen has nothing to mask.
    """
    plain = message
    for pattern, to in _MASKS:
        message = F.regexp_replace(message, pattern, to)
    numbers = lambda text: F.regexp_replace(text, _NUMBER, "<NUM>")

    def after_key(piece: Column) -> Column:
        kept = F.regexp_extract(piece, r"(?U)^\d+", 0)
        return F.concat(kept, numbers(F.substring(piece, F.length(kept) + 1, F.length(piece))))

    pieces = F.split(message, _KEPT)
    cut = F.array_join(F.transform(pieces, lambda p, i: F.when(i == 0, numbers(p)).otherwise(after_key(p))), "")
    return F.when(~F.regexp_like(plain, F.lit(_MASKABLE)), plain).when(F.regexp_like(message, F.lit(_KEPT)), cut).otherwise(numbers(message))


def squeezed(text: Column) -> Column:
    """White space of any kind collapsed to one space, none at the ends."""
    return F.btrim(F.regexp_replace(text, r"(?U)\s+", " "))


def template_fingerprint(template: Column) -> Column:
    """SHA-256 of the squeezed, lower-cased template."""
    return F.sha2(F.lower(squeezed(template)).cast("binary"), 256)


def captured(text: Column, pattern: str, group: int = 1) -> Column:
    """The first match's group without .,;) at its end; null if nothing matches or nothing is left. Case and Unicode as (?iU)."""
    return non_empty(F.rtrim(F.regexp_extract(text, f"(?iU){pattern}", group), F.lit(".,;)")))


def non_empty(text: Column) -> Column:
    """The text, or null where it has no characters."""
    return F.nullif(text, F.lit(""))


def is_blank(text: Column) -> Column:
    """Null, or nothing but white space."""
    return F.coalesce(~F.regexp_like(text, F.lit(r"(?U)\S")), F.lit(True))


def any_in(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def ladder(text: Column, steps: tuple[tuple[tuple[str, ...], str], ...], otherwise: str) -> Column:
    """The value of the first step with a word that `text` contains."""
    first, *rest = steps
    out = F.when(any_in(text, first[0]), first[1])
    for words, value in rest:
        out = out.when(any_in(text, words), value)
    return out.otherwise(otherwise)


def timestamp_anywhere(line: Column) -> Column:
    """The first ISO-like date and time in the line, or null."""
    return non_empty(F.regexp_extract(line, r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?", 0))


# Fixed value: where event lines keep their time.
_EVENT_TIME = r"(?i)(?:TimeCreated[^>]+SystemTime='|UtcTime'?>|timestamp[=:])\s*([^<'\s,]+(?:[ T][^<'\s,]+)?)"


def timestamp_of_event(line: Column) -> Column:
    """The value of SystemTime='…', UtcTime>… or timestamp=/timestamp:, in any case, or null."""
    return non_empty(F.regexp_extract(line, _EVENT_TIME, 1))


def leading_timestamp(line: Column) -> tuple[Column, Column]:
    """(timestamp, rest): a first word like a date and time, and what follows it; without one, null and the whole line."""
    pattern = r"^(\d{4}-\d{2}-\d{2}T[^ ]+)\s+(.*)"
    has = F.regexp_like(line, F.lit(pattern))
    return F.when(has, F.regexp_extract(line, pattern, 1)), F.when(has, F.regexp_extract(line, pattern, 2)).otherwise(line)


def iso_time(text: Column) -> Column:
    """A timestamp from ISO text, Z or an offset or neither, which is UTC; null if it is none. The session's zone must be UTC."""
    return F.try_to_timestamp(text)
