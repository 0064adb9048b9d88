"""String columns.

`ascii_*` looks at ASCII characters only, `utf8_*` at Unicode ones. Predicates are false on the empty string, null on null.
Padding never truncates. Positions count from 0; a search that finds nothing gives -1.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_LOWER, _UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_CLASS = {
    "ascii_is_alnum": "[A-Za-z0-9]+", "ascii_is_alpha": "[A-Za-z]+", "ascii_is_decimal": "[0-9]+", "ascii_is_printable": "[\\x20-\\x7E]+", "ascii_is_space": "[\\x09-\\x0D\\x20]+",
    "utf8_is_alnum": "[\\p{L}\\p{N}]+", "utf8_is_alpha": "\\p{L}+", "utf8_is_decimal": "\\p{Nd}+", "utf8_is_digit": "[\\p{Nd}\\p{No}]+", "utf8_is_numeric": "\\p{N}+",
    "utf8_is_printable": "[^\\p{C}\\p{Zl}\\p{Zp}\\p{Zs}]*( [^\\p{C}\\p{Zl}\\p{Zp}\\p{Zs}]*)*", "utf8_is_space": "[\\p{Z}\\x09-\\x0D\\x1C-\\x1F\\x85]+",
}


def _quoted(text: str) -> str:
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def matches_class(c: Column, name: str) -> Column:
    """One of the class predicates by name, e.g. ascii_is_alnum."""
    return c.rlike(f"^(?:{_CLASS[name]})\\z")


def ascii_is_lower(c: Column) -> Column:
    return c.rlike("[a-z]") & ~c.rlike("[A-Z]")


def ascii_is_upper(c: Column) -> Column:
    return c.rlike("[A-Z]") & ~c.rlike("[a-z]")


def utf8_is_lower(c: Column) -> Column:
    return c.rlike("\\p{Ll}") & ~c.rlike("[\\p{Lu}\\p{Lt}]")


def utf8_is_upper(c: Column) -> Column:
    return c.rlike("\\p{Lu}") & ~c.rlike("[\\p{Ll}\\p{Lt}]")


def ascii_is_title(c: Column) -> Column:
    return c.rlike("[A-Za-z]") & ~c.rlike("[A-Za-z][A-Z]|(?<![A-Za-z])[a-z]")


def utf8_is_title(c: Column) -> Column:
    return c.rlike("\\p{L}") & ~c.rlike("\\p{L}\\p{Lu}|(?<!\\p{L})\\p{Ll}")


def is_ascii(c: Column) -> Column:
    return F.octet_length(c) == F.char_length(c)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def ascii_upper(c: Column) -> Column:
    return F.translate(c, _LOWER, _UPPER)


def ascii_swapcase(c: Column) -> Column:
    return F.translate(c, _UPPER + _LOWER, _LOWER + _UPPER)


def utf8_lower(c: Column) -> Column:
    return F.lower(c)


def utf8_upper(c: Column) -> Column:
    return F.upper(c)


def _each(c: Column, f) -> Column:
    return F.array_join(F.transform(F.split(c, ""), f), "")


def utf8_swapcase(c: Column) -> Column:
    return _each(c, lambda x: F.when(x == F.upper(x), F.lower(x)).otherwise(F.upper(x)))


def utf8_capitalize(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 2147483647)))


def ascii_capitalize(c: Column) -> Column:
    return F.concat(ascii_upper(F.substring(c, 1, 1)), ascii_lower(F.substring(c, 2, 2147483647)))


def _title(c: Column, letter: str, up, low) -> Column:
    """Each run of letters with its first letter in upper case; anything between runs stays."""
    runs = F.regexp_extract_all(c, F.lit(f"({letter}+|[^{letter[1:-1] if letter[0] == '[' else letter}]+)"), 1)
    return F.array_join(F.transform(runs, lambda x: F.concat(up(F.substring(x, 1, 1)), low(F.substring(x, 2, 2147483647)))), "")


def ascii_title(c: Column) -> Column:
    return _title(c, "[A-Za-z]", ascii_upper, ascii_lower)


def utf8_title(c: Column) -> Column:
    return _title(c, "\\p{L}", F.upper, F.lower)


def reverse(c: Column) -> Column:
    return F.reverse(c)


def binary_length(c: Column) -> Column:
    return F.octet_length(c)


def utf8_length(c: Column) -> Column:
    return F.char_length(c)


def binary_repeat(c: Column, n: int) -> Column:
    return F.repeat(c, n)


def replace_slice(c: Column, start: int, stop: int, replacement: str) -> Column:
    """Characters [start, stop) replaced; bounds may be negative and are clipped."""
    n = F.char_length(c)
    a = F.least(F.greatest(F.lit(start) + (n if start < 0 else F.lit(0)), F.lit(0)), n)
    b = F.greatest(F.least(F.greatest(F.lit(stop) + (n if stop < 0 else F.lit(0)), F.lit(0)), n), a)
    return F.concat(F.substring(c, F.lit(1), a), F.lit(replacement), F.substring(c, b + 1, n - b))


def replace_substring(c: Column, pattern: str, replacement: str, max_replacements: int = -1) -> Column:
    """The first max_replacements occurrences replaced, or all for -1."""
    if max_replacements < 0:
        return F.replace(c, F.lit(pattern), F.lit(replacement))
    parts = F.split(c, _quoted(pattern), -1)
    k = max_replacements + 1
    done = F.array_join(F.slice(parts, 1, k), replacement)
    return F.when(F.size(parts) <= k, done).otherwise(F.concat(done, F.lit(pattern), F.array_join(F.slice(parts, F.lit(k + 1), F.greatest(F.size(parts) - k, F.lit(0))), pattern)))


def replace_substring_regex(c: Column, pattern: str, replacement: str) -> Column:
    return F.regexp_replace(c, pattern, replacement)


def lpad(c: Column, width: int, pad: str = " ") -> Column:
    return F.when(F.char_length(c) >= width, c).otherwise(F.lpad(c, width, pad))


def rpad(c: Column, width: int, pad: str = " ") -> Column:
    return F.when(F.char_length(c) >= width, c).otherwise(F.rpad(c, width, pad))


def center(c: Column, width: int, pad: str = " ") -> Column:
    """Padded on both sides; an odd place goes to the right."""
    gap = F.greatest(F.lit(width) - F.char_length(c), F.lit(0))
    left = F.floor(gap / 2).cast("int")
    return F.concat(F.repeat(F.lit(pad), left), c, F.repeat(F.lit(pad), (gap - left).cast("int")))


def trim(c: Column, chars: str) -> Column:
    return F.btrim(c, F.lit(chars))


def ltrim(c: Column, chars: str) -> Column:
    return F.ltrim(c, F.lit(chars))


def rtrim(c: Column, chars: str) -> Column:
    return F.rtrim(c, F.lit(chars))


_SPACE = {"ascii": "[\\x09-\\x0D\\x20]+", "utf8": "[\\p{Z}\\x09-\\x0D\\x1C-\\x1F\\x85]+"}


def ltrim_whitespace(c: Column, kind: str = "utf8") -> Column:
    return F.regexp_replace(c, f"^{_SPACE[kind]}", "")


def rtrim_whitespace(c: Column, kind: str = "utf8") -> Column:
    return F.regexp_replace(c, f"{_SPACE[kind]}\\z", "")


def trim_whitespace(c: Column, kind: str = "utf8") -> Column:
    return rtrim_whitespace(ltrim_whitespace(c, kind), kind)


def split_regex(c: Column, pattern: str, max_splits: int = -1, from_end: bool = False) -> Column:
    """Split at matches, at most max_splits times (all for -1), from either end."""
    if max_splits < 0:
        return F.split(c, pattern, -1)
    if not from_end:
        return F.split(c, pattern, max_splits + 1)
    parts, seps = F.split(c, pattern, -1), F.regexp_extract_all(c, F.lit(f"({pattern})"), 1)
    head = F.greatest(F.size(parts) - max_splits, F.lit(1))
    glued = F.aggregate(F.sequence(F.lit(2), F.greatest(head, F.lit(2))), parts[0], lambda s, i: F.when(i <= head, F.concat(s, seps[i - 2], parts[i - 1])).otherwise(s))
    return F.concat(F.array(F.when(head > 1, glued).otherwise(parts[0])), F.slice(parts, head + 1, F.lit(max(max_splits, 1)))) if max_splits else F.array(c)


def split_pattern(c: Column, pattern: str, max_splits: int = -1, from_end: bool = False) -> Column:
    return split_regex(c, _quoted(pattern), max_splits, from_end)


def split_whitespace(c: Column, kind: str = "utf8", max_splits: int = -1, from_end: bool = False) -> Column:
    return split_regex(c, _SPACE[kind], max_splits, from_end)


def extract_regex(c: Column, pattern: str, names: list[str]) -> Column:
    """Struct of the pattern's groups, named in order; null where it doesn't match."""
    groups = F.struct(*[F.regexp_extract(c, pattern, k + 1).alias(n) for k, n in enumerate(names)])
    return F.when(c.rlike(pattern), groups)


def slice_codeunits(c: Column, start: int, stop: int | None = None, step: int = 1) -> Column:
    """Python's slice of the characters, for a positive step."""
    n = F.char_length(c)
    a = F.least(F.greatest(F.lit(start) + (n if start < 0 else F.lit(0)), F.lit(0)), n)
    end = n if stop is None else F.least(F.greatest(F.lit(stop) + (n if stop < 0 else F.lit(0)), F.lit(0)), n)
    part = F.substring(c, a + 1, F.greatest(end - a, F.lit(0)))
    return part if step == 1 else F.array_join(F.filter(F.split(part, ""), lambda x, i: i % step == 0), "")


# The directives of strptime and strftime that have a counterpart among Java's patterns.
DIRECTIVES = {"%Y": "yyyy", "%y": "yy", "%m": "MM", "%d": "dd", "%H": "HH", "%I": "hh", "%M": "mm", "%S": "ss", "%f": "SSSSSS", "%p": "a", "%j": "DDD", "%b": "MMM", "%B": "MMMM", "%a": "EEE", "%A": "EEEE", "%z": "xx", "%Z": "VV", "%F": "yyyy-MM-dd", "%T": "HH:mm:ss"}


def java_pattern(fmt: str) -> str:
    """A strftime format as a Java pattern; an unknown directive raises."""
    out, k = [], 0
    while k < len(fmt):
        if fmt[k] == "%":
            pair = fmt[k : k + 2]
            if pair == "%%":
                out.append("%")
            elif pair in DIRECTIVES:
                out.append(DIRECTIVES[pair])
            else:
                raise ValueError(f"no counterpart for {pair!r}")
            k += 2
        else:
            out.append(f"'{fmt[k]}'" if fmt[k].isalpha() else "''" if fmt[k] == "'" else fmt[k])
            k += 1
    return "".join(out)


def strptime(c: Column, fmt: str, error_is_null: bool = False) -> Column:
    f = F.try_to_timestamp if error_is_null else F.to_timestamp
    return f(c, F.lit(java_pattern(fmt)) if error_is_null else java_pattern(fmt)).cast("timestamp_ntz")


def count_substring(c: Column, pattern: str, ignore_case: bool = False) -> Column:
    return F.regexp_count(c, F.lit(("(?iu)" if ignore_case else "") + _quoted(pattern)))


def count_substring_regex(c: Column, pattern: str, ignore_case: bool = False) -> Column:
    return F.regexp_count(c, F.lit(("(?iu)" if ignore_case else "") + pattern))


def find_substring(c: Column, pattern: str) -> Column:
    """Byte offset of the first occurrence, or -1."""
    at = F.instr(c, pattern)
    return F.when(at == 0, F.lit(-1)).otherwise(F.octet_length(F.substring(c, F.lit(1), at - 1)))


def find_substring_regex(c: Column, pattern: str) -> Column:
    at = F.regexp_instr(c, F.lit(pattern))
    return F.when(at == 0, F.lit(-1)).otherwise(F.octet_length(F.substring(c, F.lit(1), at - 1)))


def match_substring(c: Column, pattern: str, ignore_case: bool = False) -> Column:
    return F.contains(F.lower(c), F.lit(pattern.lower())) if ignore_case else F.contains(c, F.lit(pattern))


def match_substring_regex(c: Column, pattern: str, ignore_case: bool = False) -> Column:
    return c.rlike(("(?iu)" if ignore_case else "") + pattern)


def match_like(c: Column, pattern: str, ignore_case: bool = False) -> Column:
    return c.ilike(pattern) if ignore_case else c.like(pattern)


def starts_with(c: Column, pattern: str, ignore_case: bool = False) -> Column:
    return F.startswith(F.lower(c), F.lit(pattern.lower())) if ignore_case else F.startswith(c, F.lit(pattern))


def ends_with(c: Column, pattern: str, ignore_case: bool = False) -> Column:
    return F.endswith(F.lower(c), F.lit(pattern.lower())) if ignore_case else F.endswith(c, F.lit(pattern))
