"""Scalar text functions as Column expressions: Column in, Column out, inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_EDGE = r"^[\s\u0085\p{Z}]+|[\s\u0085\p{Z}]+$"


def trim_all(value: Column) -> Column:
    """Without white space of any script at both ends (``trim`` takes blanks only)."""
    return F.regexp_replace(value, _EDGE, "")


def safe_name(value: Column) -> Column:
    return F.when(trim_all(value) == "", "(unnamed)").otherwise(trim_all(value))


def safe_value(value: Column) -> Column:
    """Line feeds become blanks and bars slashes, so that a value fits a table cell."""
    return F.translate(value, "\n|", " /")


def prompt_tokens(text: Column) -> Column:
    """Estimated tokens of a prompt: 1.2 tokens for four characters, rounded down; 1 at least unless empty."""
    return F.greatest(F.when(F.length(text) > 0, 1).otherwise(0), F.floor(F.length(text).cast("long") * 3 / 10).cast("int"))


def chunk_tokens(text: Column) -> Column:
    """Estimated tokens as the chunker counts them: a token for four characters, rounded down."""
    return F.floor(F.length(text) / 4).cast("int")


def truncate_to_tokens(text: Column, limit: int) -> Column:
    """As many characters as ``limit`` prompt tokens stand for; none if the limit isn't positive."""
    return F.substring(text, 1, int(limit / 1.2 * 4)) if limit > 0 else F.lit("")


def token_breakdown(parts: Column) -> Column:
    """The prompt tokens of each entry of a map of texts."""
    return F.transform_values(parts, lambda _, text: prompt_tokens(text))


def preview(text: Column, most: int = 200) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def sample_cell(text: Column, most: int = 80) -> Column:
    """A cell of a sample row; long ones are cut by characters, so none is split."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)


def mask(secret: Column) -> Column:
    """A secret's first and last three characters; six stars for short ones; empty stays empty."""
    shown = F.concat(F.substring(secret, 1, 3), F.lit("****"), F.substring(secret, -3, 3))
    return F.when(F.length(secret) == 0, "").when(F.length(secret) <= 6, "******").otherwise(shown)


def dry_run_id(prompt: Column) -> Column:
    return F.concat(F.lit("sim_"), F.substring(F.sha1(prompt), 1, 12))


def slug(name: Column) -> Column:
    """A name for a file: lower-case letters and digits, parted by single-character dashes."""
    kept = F.regexp_replace(F.regexp_replace(F.lower(name), "[ _-]", "-"), "[^a-z0-9-]", "")
    plain = F.regexp_replace(kept, "^-+|-+$", "")
    return F.when(plain == "", "sheet").otherwise(plain)


def normalize_markdown(text: Column) -> Column:
    """Line feeds only, and at most one empty line in a row."""
    return F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), r"\n{3,}", "\n\n")


def strip_tags(markup: Column) -> Column:
    """Text without tags (each becomes nothing), trimmed, at most one empty line in a row."""
    return trim_all(F.regexp_replace(normalize_markdown(F.regexp_replace(markup, "<[^>]+>", "")), r"\n{3,}", "\n\n"))


def paragraphs(text: Column) -> Column:
    """The trimmed, non-empty parts between empty lines."""
    return F.filter(F.transform(F.split(text, "\n\n"), trim_all), lambda p: p != "")


def fixed_pieces(text: Column, size: int) -> Column:
    """A text in pieces of ``size`` characters; none of an empty text."""
    whole = trim_all(text)
    n = F.ceil(F.length(whole) / size).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(whole, i * size + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def contains_fold(text: Column, part: str) -> Column:
    return F.contains(F.lower(text), F.lit(part.lower()))


def contains_all_fold(text: Column, parts: list[str]) -> Column:
    found = F.lit(True)
    for part in parts:
        found &= contains_fold(text, part)
    return found


def contains_any_fold(text: Column, parts: list[str]) -> Column:
    found = F.lit(False)
    for part in parts:
        found |= contains_fold(text, part)
    return found


def glob_pattern(glob: str) -> str | None:
    """A shell pattern as a regular expression for a whole name; ``*`` and ``?`` stop at slashes. None if
    the pattern is malformed, which matches nothing."""
    out, i = [], 0
    special = set(r".^$+{}()|[]\*?")
    quoted = lambda c: "\\" + c if c in special else c
    while i < len(glob):
        c = glob[i]
        i += 1
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "\\":
            if i == len(glob):
                return None
            out.append(quoted(glob[i]))
            i += 1
        elif c == "[":
            end = i + 1 + glob[i : i + 1].count("^")
            while end < len(glob) and glob[end] != "]":
                end += 1 + (glob[end] == "\\")
            if end >= len(glob):
                return None
            body = glob[i:end]
            negated = body.startswith("^")
            out.append("[" + "^" * negated + body[negated:].replace("[", "\\[").replace("&&", "&\\&") + "]")
            i = end + 1
        else:
            out.append(quoted(c))
    return "^" + "".join(out) + "$"


def allowed(name: Column, include: list[str] = (), exclude: list[str] = ()) -> Column:
    """Whether a name matches one of ``include`` (if there are any) and none of ``exclude``."""

    def matches(globs: list[str]) -> Column:
        found = F.lit(False)
        for pattern in filter(None, (glob_pattern(g) for g in globs if g)):
            found |= name.rlike(pattern)
        return found

    kept = matches(include) if list(include) else F.lit(True)
    return kept & ~matches(exclude)


def is_dataset_document(name: Column, description: Column) -> Column:
    low = F.lower(F.coalesce(description, F.lit("")))
    return F.contains(low, F.lit("dataset")) | F.contains(low, F.lit("summary")) | F.endswith(name, F.lit(".summary.md"))
