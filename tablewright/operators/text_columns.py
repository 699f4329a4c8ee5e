"""Columns made from long texts: links of a page, a model's answer, fields of a JSON answer."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import quote, urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.text import col

# Fixed value: printable ASCII that a URL keeps as it is.
URL_SAFE = "!#$%&'()*+,/:;=?@[]~|^\\"
# What is put behind the base's site as it stands: an absolute path of safe characters only,
# without an empty, ``.`` or ``..`` step.
PLAIN_PATH = r"^/(?!/)(?!.*/\.{1,2}(/|$|[?#]))[A-Za-z0-9_.\-~!#$%&'()*+,/:;=?@|^]*$"
SITE = r"^[A-Za-z][A-Za-z0-9+.\-]*://[A-Za-z0-9_.\-~:@]+"


def resolve_urls(base: pd.Series, link: pd.Series) -> pd.Series:
    """Each link against its base; the link itself where the two make no URL."""
    def one(b: str | None, u: str | None) -> str | None:
        if b is None or u is None:
            return u
        try:
            return quote(urljoin(b, u.strip()), safe=URL_SAFE)
        except ValueError:
            return u

    return pd.Series([one(b, u) for b, u in zip(base, link)], index=link.index, dtype=object)


def extract_links(df: DataFrame, body: str, pattern: str, base_url: str | None = None, out: str = "link") -> DataFrame:
    """One row per match of the pattern's first group in the whole body. With ``base_url`` a
    match that starts with ``/`` or has no ``://`` is resolved against that column; one that
    cannot be resolved stays as it was matched."""
    found = df.select(*[col(c) for c in df.columns if c != body],
                      F.explode(F.regexp_extract_all(col(body), F.lit(pattern), F.lit(1))).alias(out))
    if base_url is None:
        return found
    link, base = col(out), col(base_url)
    relative = link.startswith("/") | ~link.contains("://")
    plain = link.rlike(PLAIN_PATH) & base.rlike(SITE + "([/?#]|$)")
    hard = F.coalesce(relative & ~plain, F.lit(False))
    resolve = F.pandas_udf(resolve_urls, T.StringType())
    # Python gets nulls, which it passes over, for links that need no work.
    resolved = found.withColumn("__url", resolve(F.when(hard, base), F.when(hard, link)))
    joined = F.when(hard, F.coalesce("__url", link)).when(relative & plain, F.concat(F.regexp_extract(base, SITE, 0), link)).otherwise(link)
    return resolved.withColumn(out, joined).drop("__url")


def _answers(texts: pd.Series, complete: Callable[[str], str], pool: ThreadPoolExecutor) -> pd.Series:
    def one(text: str | None) -> str:
        if not text:
            return ""
        try:
            return complete(text).strip()
        except Exception as error:  # a failed call must not fail the row's partition
            return f"Error: {error}"

    return pd.Series(list(pool.map(one, texts)), index=texts.index, dtype=object)


def completion(c: Column, make: Callable[[], Callable[[str], str]], threads: int = 4) -> Column:
    """The answer of a completion function to each text. ``make`` builds the function, once
    per partition; calls of a batch overlap on a few threads. '' stays ''."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        complete = make()
        with ThreadPoolExecutor(threads) as pool:
            for texts in batches:
                yield _answers(texts, complete, pool)

    return run(c.cast("string"))


def map_text(df: DataFrame, column: str, make: Callable[[], Callable[[str], str]], out: str | None = None,
             threads: int = 4) -> DataFrame:
    """A new text column, ``<column>_summary`` by default, with a model's answer per row."""
    return df.withColumn(out or f"{column}_summary", completion(col(column), make, threads))


def parse_fields(answer: Column, fields: Sequence[str]) -> Column:
    """A map of text values from an answer that is JSON, with or without code fences."""
    body = F.regexp_replace(F.trim(answer), r"^(```json)?(```)?", "")
    body = F.trim(F.regexp_replace(body, r"```$", ""))
    return F.from_json(body, "map<string,string>")


def extract_fields(df: DataFrame, column: str, fields: Sequence[str] | Mapping,
                   make: Callable[[], Callable[[str], str]] | None = None, threads: int = 4) -> DataFrame:
    """One text column per field, '' where the answer lacks it or does not parse. Without
    ``make`` the column holds the answers already."""
    names = list(fields)
    answer = completion(col(column), make, threads) if make else col(column)
    parsed = df.withColumn("__fields", parse_fields(answer, names))
    found = F.col("__fields")
    cells = {n: F.when(F.map_contains_key(found, F.lit(n)), F.coalesce(found[n], F.lit("None"))) for n in names}
    return parsed.withColumns({n: F.coalesce(c, F.lit("")) for n, c in cells.items()}).drop("__fields")
