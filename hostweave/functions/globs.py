"""Glob patterns as Java regular expressions, built as Column expressions.

Literal process patterns fold to one constant regex, compiled once. Patterns held in
a specification table are translated there, one regex per specification row. Two flavours exist:

* process globs: no ``*``/``?`` means a case-insensitive substring; otherwise the
  whole name, case-sensitive. Patterns are read by character, so non-ASCII globs match.
* path globs: shell-style on one path element with ``[...]`` classes and ``\\``
  escapes; wildcards never cross ``/`` and a malformed pattern matches nothing.
"""

from pyspark.sql import Column, functions as F

# One unit inside a path-glob class, and one token of a path glob.
_UNIT = r"(?:\\[\s\S]|[^\\\]\-])"
_SPAN = rf"{_UNIT}(?:-{_UNIT})?"
_CLASS = rf"\[\^?(?:{_SPAN})+\]"
_TOKEN = rf"(?:\\[\s\S]|{_CLASS}|[^\\\[])"

_NO_MATCH = "(?!)"


def _quote(text: Column) -> Column:
    return F.regexp_replace(text, r"(\p{Punct})", r"\\$1")


def process_glob_regex(pattern: Column) -> Column:
    """Regex for one process pattern, to be searched for (not anchored by the caller)."""
    quoted = _quote(pattern)
    whole = F.regexp_replace(
        F.regexp_replace(quoted, r"\\\*", r"[^\\n]*"), r"\\\?", r"[^\\n]"
    )
    return F.when(
        pattern.rlike(r"[*?]"), F.concat(F.lit(r"\A"), whole, F.lit(r"\z"))
    ).otherwise(F.concat(F.lit("(?iu:"), quoted, F.lit(")")))


def any_process_glob(patterns: Column) -> Column:
    """One regex for a list of patterns; NULL for an empty or missing list."""
    return F.when(
        F.size(patterns) > 0, F.array_join(F.transform(patterns, process_glob_regex), "|")
    )


def any_process_glob_of(patterns: list[str]) -> Column | None:
    """As :func:`any_process_glob` for literals; folds to one constant regex."""
    if not patterns:
        return None
    return F.concat_ws("|", *[process_glob_regex(F.lit(p)) for p in patterns])


def matches_any_process_glob(name: Column, patterns: Column) -> Column:
    """True where any pattern matches; an empty list keeps every row."""
    regex = any_process_glob(patterns)
    return F.when(regex.isNull(), F.lit(True)).otherwise(F.rlike(name, regex))


def _unescape(unit: Column) -> Column:
    return F.regexp_replace(unit, r"\A\\([\s\S])\z", "$1")


def _class_regex(token: Column) -> Column:
    negated = token.startswith("[^")
    # The leading "[" or "[^" is cut by position: either could also occur in the body.
    body = F.regexp_extract(token, r"\A\[\^?([\s\S]*)\]\z", 1)
    spans = F.regexp_extract_all(body, F.lit(f"({_SPAN})"), F.lit(1))
    span_shape = rf"\A({_UNIT})(?:-({_UNIT}))?\z"

    def span(text: Column) -> Column:
        low = _unescape(F.regexp_extract(text, span_shape, 1))
        high = _unescape(F.regexp_extract(text, span_shape, 2))
        return (
            F.when(high == "", _quote(low))
            .when(low <= high, F.concat(_quote(low), F.lit("-"), _quote(high)))
            .otherwise(F.lit(""))  # an inverted range holds no character
        )

    inner = F.array_join(F.transform(spans, span), "")
    return (
        F.when((inner == "") & negated, F.lit("[^/]"))
        .when(inner == "", F.lit(_NO_MATCH))
        .when(negated, F.concat(F.lit("[^"), inner, F.lit("/]")))
        .otherwise(F.concat(F.lit("[["), inner, F.lit("]&&[^/]]")))
    )


def path_glob_regex(pattern: Column) -> Column:
    """Regex for one path element; NULL for a malformed pattern."""
    tokens = F.regexp_extract_all(pattern, F.lit(f"({_TOKEN})"), F.lit(1))

    def token_regex(token: Column) -> Column:
        return (
            F.when(token == "*", F.lit("[^/]*"))
            .when(token == "?", F.lit("[^/]"))
            .when(token.startswith("\\"), _quote(F.substring(token, 2, 2)))
            .when(token.startswith("[") & (F.length(token) > 1), _class_regex(token))
            .otherwise(_quote(token))
        )

    return F.when(
        pattern.rlike(rf"\A{_TOKEN}*\z"), F.array_join(F.transform(tokens, token_regex), "")
    )


def any_path_element_regex(patterns: Column) -> Column:
    """Regex finding an element of a relative path that any pattern matches.

    NULL when no valid pattern is given, so callers can skip the match.
    """
    valid = F.filter(F.transform(patterns, path_glob_regex), lambda r: r.isNotNull())
    return F.when(
        F.size(valid) > 0,
        F.concat(F.lit(r"(?:\A|/)(?:"), F.array_join(valid, "|"), F.lit(r")(?:/|\z)")),
    )
