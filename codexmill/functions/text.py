"""Column functions over paths, names and texts. White space is Unicode's unless said otherwise."""

from __future__ import annotations

import codecs
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The suffixes of parsed files and the languages they stand for.
LANGUAGES = {
    ".sol": "solidity", ".rs": "rust", ".c": "cpp", ".cpp": "cpp", ".cxx": "cpp", ".cc": "cpp", ".h": "cpp", ".hpp": "cpp", ".hxx": "cpp",
    ".move": "move", ".go": "go", ".py": "python",
}
PARSED_SUFFIXES = (".sol", ".rs", ".move", ".c", ".cpp", ".cxx", ".cc", ".C", ".h", ".hpp", ".hxx", ".go", ".py")
#: Solidity test files are left out.
SKIPPED_SUFFIX = ".t.sol"
CHAPTERS = (r"第[一二三四五六七八九十\d]+章", r"Chapter\s+\d+", r"^#{1,3}\s+", r"^\d+\.\s+[A-Z]")

_SPACE = r"(?U)\s+"


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value worked out once however often the body names it, inside of lambdas too."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def not_blank(text: Column) -> Column:
    return F.rlike(text, F.lit(r"(?U)\S"))


def words(text: Column) -> Column:
    """The runs between white space, in order."""
    return F.filter(F.split(text, _SPACE), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def unix_path(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def base_name(path: Column) -> Column:
    return F.substring_index(unix_path(path), "/", -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


def extension(path: Column) -> Column:
    """The last dot and what follows in a file name; empty for names without one, or with one at the start only."""
    return F.regexp_extract(base_name(path), r"^.+(\.[^.]+)$", 1)


def path_suffix(path: Column) -> Column:
    """The last two parts of a path, or all of it if it has one."""
    return F.substring_index(unix_path(path), "/", -2)


def same_path_end(a: Column, b: Column) -> Column:
    """Whether two paths name the same file in the same folder; the file alone if either has no folder. False for nulls and empty paths."""
    both = (F.instr(unix_path(a), "/") > 0) & (F.instr(unix_path(b), "/") > 0)
    same = F.when(both, path_suffix(a) == path_suffix(b)).otherwise(base_name(a) == base_name(b))
    return F.coalesce((a != "") & (b != "") & same, F.lit(False))


def language_of(path: Column) -> Column:
    """The language that a path's suffix stands for, in any case; null for others."""
    low, out = F.lower(path), F.lit(None).cast("string")
    for suffix, name in reversed(LANGUAGES.items()):
        out = F.when(F.endswith(low, F.lit(suffix)), name).otherwise(out)
    return out


def is_parsed(path: Column) -> Column:
    """Whether a file of this name is parsed; suffixes count as written."""
    any_of = F.lit(False)
    for suffix in PARSED_SUFFIXES:
        any_of = any_of | F.endswith(path, F.lit(suffix))
    return any_of & ~F.endswith(path, F.lit(SKIPPED_SUFFIX))


def short_name(name: Column) -> Column:
    """What follows the last dot."""
    return F.substring_index(name, ".", -1)


def prefix(name: Column) -> Column:
    """What precedes the last dot; null without one."""
    return F.when(F.instr(name, ".") > 0, F.regexp_replace(name, r"\.[^.]*$", ""))


def sanitized(name: Column) -> Column:
    return F.regexp_replace(name, "[^a-zA-Z0-9_.:-]", "_")


def or_else(first: Column, second: Column) -> Column:
    """The first unless it is null or empty."""
    return F.coalesce(F.nullif(first, F.lit("")), second)


def called_in(name: Column, content: Column) -> Column:
    """Whether a text holds the name, in any case, followed by an opening parenthesis."""
    return F.contains(F.lower(content), F.lower(name)) & F.rlike(F.lower(content), F.concat(F.lit("\\Q"), F.replace(F.lower(name), F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E\\s*\\(")))


def has_chapters(text: Column) -> Column:
    found = F.lit(False)
    for pattern in CHAPTERS:
        found = found | F.rlike(text, F.lit("(?m)" + pattern))
    return found


def clean_long_text(text: Column) -> Column:
    """Line feeds only, lines stripped, one blank line for several, and room before chapter headings."""
    lines = F.transform(F.split(F.regexp_replace(text, "\r\n|\r", "\n"), "\n"), strip)
    plain = bound(lines, lambda x: F.array_join(F.filter(x, lambda line, i: (line != "") | (i == 0) | (F.element_at(x, i) != "")), "\n"))

    def spaced(x: Column) -> Column:
        x = F.regexp_replace(F.regexp_replace(x, "(" + CHAPTERS[0] + ")", "\n\n$1"), "(" + CHAPTERS[1] + ")", "\n\n$1")
        return F.regexp_replace(x, "(?m)(" + CHAPTERS[2] + ")", "\n\n$1")

    return bound(plain, lambda x: F.when(has_chapters(x), spaced(x)).otherwise(x))


def paragraph_count(text: Column) -> Column:
    """Pieces between pairs of line feeds; line ends of other systems count as line feeds."""
    return F.size(F.split(F.regexp_replace(text, "\r\n|\r", "\n"), "\n\n"))


_SPARK_ENCODINGS = frozenset("iso-8859-1 utf-16 utf-16be utf-16le utf-32".split())


def _known(encoding: str) -> bool:
    try:
        return codecs.lookup(encoding)._is_text_encoding
    except (LookupError, ValueError):
        return False


def _by_codec(content: Column, encoding: str) -> Column:
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(lambda x: None if x is None else bytes(x).decode(encoding, "ignore"))

    return F.pandas_udf(run, "string")(content)


def decode_lenient(content: Column, encoding: str = "utf-8") -> Column:
    """Bytes as text without what isn't valid in the encoding; an encoding that nobody knows gives way to utf-8.

    utf-8, us-ascii, iso-8859-1 and those of 16 and 32 bits are Spark's own; others, as gbk and cp1252, are decoded by Python in Arrow batches.
    """
    name = {"latin1": "iso-8859-1", "latin-1": "iso-8859-1", "ascii": "us-ascii", "utf8": "utf-8"}.get(encoding.lower(), encoding.lower())
    if name == "utf-8":
        return F.replace(F.make_valid_utf8(content.cast("string")), F.lit("\ufffd"), F.lit(""))
    if name == "us-ascii":
        # ISO-8859-1 maps each byte to the character of its number, so none is lost before the filter
        return F.regexp_replace(F.decode(content, "iso-8859-1"), r"[^\x00-\x7f]", "")
    if name not in _SPARK_ENCODINGS:
        return _by_codec(content, name) if _known(name) else decode_lenient(content)
    if name in ("utf-16", "utf-16be", "utf-16le"):
        content = F.substring(content, F.lit(1), (F.octet_length(content) - F.octet_length(content) % 2).cast("int"))  # half a unit at the end
    return F.try_validate_utf8(F.decode(content, name))
