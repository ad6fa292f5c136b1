"""Text functions: missing-value tokens and title case."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staylens.schemas import NA_TOKENS

# A run of cased letters or a run of anything else (letters without case, as in
# CJK or Hebrew, start a new word like any other sign); title case works run by run.
_RUNS = r"([\p{Lu}\p{Ll}\p{Lt}]+|[^\p{Lu}\p{Ll}\p{Lt}]+)"


def null_tokens(c: Column | str, tokens: Iterable[str] = NA_TOKENS, trim: bool = False) -> Column:
    """Missing-value tokens of a text field (empty, `NA`, `None`, ...) -> NULL.

    A CSV reader drops these on load; a plain Spark read keeps all but the
    empty field as text. Matching is exact unless `trim` is set.
    """
    if isinstance(c, str):
        # one SQL expression per column: a single call, and Catalyst turns the
        # long IN list into a hash set lookup (InSet)
        ref = "`" + c.replace("`", "``") + "`"
        probe = f"trim({ref})" if trim else ref
        return F.expr(f"CASE WHEN {probe} IN ({_sql_list(tokens)}) THEN CAST(NULL AS STRING) ELSE {ref} END")
    probe = F.trim(c) if trim else c
    return F.when(probe.isin(list(tokens)), F.lit(None).cast("string")).otherwise(c)


def _sql_list(tokens: Iterable[str]) -> str:
    return ", ".join("'" + t.replace("\\", "\\\\").replace("'", "\\'") + "'" for t in tokens)


def with_null_tokens(df: DataFrame, columns: Iterable[str] | None = None,
                     tokens: Iterable[str] = NA_TOKENS, trim: bool = False) -> DataFrame:
    """Apply `null_tokens` to the given (default: all string) columns."""
    names = list(columns) if columns is not None else [
        f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    tokens = list(tokens)
    return df.withColumns({n: null_tokens(n, tokens, trim) for n in names})


def title_case(c: Column | str) -> Column:
    """Title case that starts a new word after any non-letter.

    `o'BRIEN mary-jane 3rd` -> `O'Brien Mary-Jane 3Rd`; plain `initcap` only
    splits on blanks. Each letter run gets `initcap`, other runs pass as is.
    NULL stays NULL, the empty string stays empty.
    """
    col = F.col(c) if isinstance(c, str) else c
    runs = F.regexp_extract_all(col, F.lit(_RUNS), 1)
    return F.array_join(F.transform(runs, lambda r: F.initcap(r)), "")
