"""Line-first cleaning: rules judge lines, failing lines go, and documents that lose too much go too.

Punctuation: a line of over 20 words without any stop fails. So does a menu: three or more lines on
end of few words and no stop, which each alone could be headings. Navigation: separators that stand
as words. Boilerplate: phrases of page furniture in a short line, and in any language a short line
that a text has more than three times. Symbols and shouting are shares of a line. Texts in scripts
without any of STOPS need rules of their own, with max_words_without_stop and min_menu_lines raised.

Counts over the whole text are kept beside the verdict. One pass over the rows, no shuffle: each
document is judged alone.
"""

from __future__ import annotations

import re
import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.llm.arrow import small
from logweave.llm.words import SPACES

SYMBOLS = "#*$%&|<>"

#: Phrases of page furniture. A short line with one of them is boilerplate.
BOILERPLATE = (
    "accept cookies", "all rights reserved", "click here", "cookie policy", "enable javascript",
    "forgot your password", "log in to", "lorem ipsum", "page not found", "privacy policy", "read more",
    "share this", "sign up", "skip to content", "subscribe to", "terms of service", "terms of use",
)


@dataclass(frozen=True)
class Rules:
    """Limits of the rules. A line or text at its limit passes."""

    min_words: int = 10
    max_repeat_percent: int = 20
    window: int = 5
    max_symbol_share: float = 0.08
    max_bang_share: float = 0.3
    max_upper_share: float = 0.7
    min_letters: int = 20
    max_separator_share: float = 0.2
    min_separators: int = 2
    max_boilerplate_words: int = 12
    max_words_without_stop: int = 20
    max_menu_words: int = 8
    min_menu_lines: int = 3
    max_copies: int = 3
    min_copied_words: int = 3
    max_lost_share: float = 0.5


SEPARATORS = ("|", ">", "»", "•", "·")
STOPS = ".!?,;:…。！？،؟।"
_bang = re.compile(r"[!?]{2,}|!")
_stop = re.compile(f"[{STOPS}]")
_letters = string.ascii_letters.encode()
_bars = [c.encode() for c in SEPARATORS]
_upper = string.ascii_uppercase.encode()


def line_fault(line: str, rules: Rules = Rules()) -> str | None:
    """Which rule a line fails by itself: symbols, shouting, navigation, boilerplate, punctuation; None if it passes."""
    line = line.strip(SPACES)
    if not line:
        return None
    raw = line.encode("utf-8", "surrogatepass")
    words = raw.split()
    bars = sum(map(words.count, _bars)) if any(map(line.count, SEPARATORS)) else 0
    if bars >= rules.min_separators and bars > rules.max_separator_share * len(words):
        return "navigation"
    if sum(map(line.count, SYMBOLS)) > rules.max_symbol_share * len(line):
        return "symbols"
    if "!" in line and len(words) >= 3 and len(_bang.findall(line)) > rules.max_bang_share * len(words):
        return "shouting"
    letters = len(raw) - len(raw.translate(None, _letters))
    if letters >= rules.min_letters and len(raw) - len(raw.translate(None, _upper)) > rules.max_upper_share * letters:
        return "shouting"
    if len(words) <= rules.max_boilerplate_words and any(p in line.lower() for p in BOILERPLATE):
        return "boilerplate"
    if len(words) > rules.max_words_without_stop and not _stop.search(line):
        return "punctuation"
    return None


def line_faults(lines: list[str], rules: Rules = Rules()) -> list[str | None]:
    """Which rule each line of a text fails, by itself or beside the others; lines without a word pass."""
    seen = Counter(lines)
    known = {line: line_fault(line, rules) for line in seen}
    out, run = [known[line] for line in lines], 0
    for i, line in enumerate([*lines, ""]):
        n = len(line.encode("utf-8", "surrogatepass").split())
        if n and n <= rules.max_menu_words and not _stop.search(line):
            run += 1
        else:
            if run >= rules.min_menu_lines:
                out[i - run : i] = [f or "navigation" for f in out[i - run : i]]
            run = 0
        if i < len(lines) and seen[line] > rules.max_copies and rules.min_copied_words <= n <= rules.max_boilerplate_words:
            out[i] = out[i] or "boilerplate"
    return out


def repeated_words(words: list, window: int) -> int:
    """Words that lie in a window of `window` words found twice or more in the text, its first place included."""
    grams = list(zip(*(words[i:] for i in range(window)), strict=False))
    if len(set(grams)) == len(grams):
        return 0
    first, last, total = {}, 0, 0
    marked = bytearray(len(grams))
    for i, g in enumerate(grams):
        j = first.setdefault(g, i)
        if j != i:
            marked[i] = marked[j] = 1
    for i, m in enumerate(marked):
        if m:
            total += i + window - max(i, last)
            last = i + window
    return total


def judge(text: str | None, rules: Rules = Rules()) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_lines, n_bad_lines, lost_chars, cleaned)."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    lines = text.split("\n")
    full = [line for line in lines if line.strip(SPACES)]
    chars = lambda t: len(t) - sum(map(t.count, SPACES))
    n_chars, repeats = chars(text), repeated_words(words, rules.window)
    faults = line_faults(lines, rules)
    bad = [line for line, fault in zip(lines, faults, strict=True) if fault]
    lost = sum(map(chars, bad))
    failed = len(words) < rules.min_words or 100 * repeats > rules.max_repeat_percent * len(words)
    return (
        len(words), n_chars, sum(map(text.count, SYMBOLS)), len(full) - len(set(full)), repeats, failed,
        not failed and lost <= rules.max_lost_share * n_chars,
        len(lines), len(bad), lost, "\n".join(line for line, fault in zip(lines, faults, strict=True) if not fault) if bad else text,
    )


FIELDS = (
    ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()),
    ("kept", pa.bool_()), ("n_lines", pa.int64()), ("n_bad_lines", pa.int64()), ("lost_chars", pa.int64()), ("cleaned", pa.string()),
)
SQL_TYPES = {pa.int64(): "bigint", pa.bool_(): "boolean", pa.string(): "string"}


def quality_rules(docs: DataFrame, text: str | Column = "text", rules: Rules = Rules(), carry: list[str | Column] | None = None, cleaned: bool = False) -> DataFrame:
    """The columns in `carry` (all, by default) and one column for each of FIELDS; `cleaned`, the text without failing lines, only if asked for.

    A null or empty text has no words, so base_failed is true and kept false. Repeated rows are
    judged alike and all stay. Columns of `docs` that have the name of a result column are replaced.
    """
    fields = [f for f in FIELDS if cleaned or f[0] != "cleaned"]
    names = [n for n, _ in fields]
    base = docs.select((text if isinstance(text, Column) else F.col(text)).cast("string").alias("__text"), *(carry if carry is not None else ["*"]))
    base = base.drop(*names)
    rest = [f for f in base.schema.fields if f.name != "__text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            rows = [judge(t, rules) for t in batch.column(0).to_pylist()]
            columns = list(zip(*rows, strict=True)) or [()] * len(FIELDS)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *(pa.array(c, k) for c, (_, k) in zip(columns, fields, strict=False))], [f.name for f in rest] + names)

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rest] + [f"{n} {SQL_TYPES[k]}" for n, k in fields])
    return base.mapInArrow(run, schema)
