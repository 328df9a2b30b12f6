"""Text expressions. What SQL functions can say stays in the JVM; Unicode normal forms need a pandas UDF."""

from __future__ import annotations

import hashlib
import json
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def collapsed(c: str | Column) -> Column:
    """White space of any script to one space, trimmed; \\s alone knows ASCII only."""
    return F.trim(F.regexp_replace(col(c), r"(?U)\s+", " "))


def required(c: str | Column, most: int) -> Column:
    """Collapsed text; null, which marks a rejected row, where it is blank or too long."""
    x = collapsed(c)
    return F.when((F.length(x) > 0) & (F.length(x) <= most), x)


def optional(c: str | Column, most: int) -> Column:
    """Collapsed text, cut to a length; null where it is blank."""
    x = collapsed(c)
    return F.when(F.length(x) > 0, F.substring(x, 1, most))


def unsafe(c: str | Column) -> Column:
    """Whether there are control characters."""
    return col(c).rlike("[\\x00-\\x1F\\x7F-\\x9F]")


@F.pandas_udf(StringType())
def nfkc_casefold(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).casefold())


def title_fingerprint(c: str | Column) -> Column:
    """SHA-256 of the title in NFKC, collapsed and case-folded."""
    return F.sha2(collapsed(nfkc_casefold(col(c))), 256)


def ascii_title_fingerprint(c: str | Column) -> Column:
    """The same for ASCII titles, without Python."""
    return F.sha2(collapsed(F.lower(col(c))), 256)


def security_key(c: str | Column) -> Column:
    """Letters and digits of the folded key."""
    return F.regexp_replace(nfkc_casefold(col(c)), r"(?U)[^\p{Alnum}]", "")


@F.pandas_udf(StringType())
def _folded_start(s: pd.Series, most: pd.Series) -> pd.Series:
    # ASCII is its own normal form
    return pd.Series([None if t is None else t[:n].lower() if t.isascii() else unicodedata.normalize("NFKC", t)[:n].casefold() for t, n in zip(s, most)])


def words_only(c: str | Column, most: int = 8000) -> Column:
    """The first `most` characters in NFKC, case-folded, with each run of other characters than letters and digits as a
    space."""
    return F.trim(F.regexp_replace(_folded_start(F.coalesce(col(c), F.lit("")), F.lit(most)), r"(?U)[\W_]+", " "))


def like_escaped(c: str | Column) -> Column:
    """Text in which what LIKE takes for wildcards, and its escape, stand for themselves."""
    return F.regexp_replace(col(c), r"([\\%_])", r"\\$1")


def snippet(c: str | Column, most: int = 500) -> Column:
    return F.substring(collapsed(c), 1, most)


def first_line(c: str | Column) -> Column:
    return F.substring_index(col(c), "\n", 1)


def neutral_cell(c: str | Column, most: int = 500) -> Column:
    """A CSV cell that no spreadsheet takes for a formula."""
    x = F.substring(F.coalesce(col(c).cast("string"), F.lit("")), 1, most)
    return F.when(x.rlike(r"^[\t\r\n]|^[\x00-\x20]*[=+\-@]"), F.concat(F.lit("'"), x)).otherwise(x)


def sanitized(c: str | Column, most: int = 200) -> Column:
    """Diagnostics without control characters, secrets in key=value form, and line breaks."""
    x = F.regexp_replace(col(c), r"(?i)(password|passwd|secret|token|api[_-]?key|authorization)(\s*[=:]\s*)\S+", "$1$2[redacted]")
    return F.substring(collapsed(F.regexp_replace(x, r"[\x00-\x1F\x7F]+", " ")), 1, most)


def canonical_json(value) -> str:
    """Sorted keys, no spaces, no escapes, no NaN."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


@F.pandas_udf(StringType())
def canonical_json_sha256(s: pd.Series) -> pd.Series:
    """Of JSON texts of any shape; null where a text is not JSON. to_json neither sorts keys nor keeps nulls."""

    def one(text):
        try:
            return hashlib.sha256(canonical_json(json.loads(text)).encode()).hexdigest()
        except (TypeError, ValueError):
            return None

    return s.map(one)


#: Keys, folded, whose values never leave a payload.
SENSITIVE = {"password", "passwd", "secret", "token", "apikey", "authorization", "cookie", "credential", "credentials", "privatekey", "session"}


@F.pandas_udf(StringType())
def safe_payload(s: pd.Series) -> pd.Series:
    """A JSON object without sensitive keys, in canonical form; null if it is no object, or too large."""

    def clean(v, depth=0):
        if depth > 8:
            raise ValueError("too deep")
        if isinstance(v, dict):
            return {k: clean(x, depth + 1) for k, x in list(v.items())[:50] if "".join(filter(str.isalnum, unicodedata.normalize("NFKC", k).casefold())) not in SENSITIVE}
        return [clean(x, depth + 1) for x in v[:100]] if isinstance(v, list) else v

    def one(text):
        try:
            v = json.loads(text)
            out = canonical_json(clean(v)) if isinstance(v, dict) else None
        except (TypeError, ValueError):
            return None
        return out if out is not None and len(out.encode()) <= 8192 else None

    return s.map(one)


def free_of_markup(c: str | Column) -> Column:
    """Whether no tag shows up however often the references in a text are decoded, three times at most."""
    x = col(c)
    for _ in range(3):
        for ref, char in (("&lt;", "<"), ("&gt;", ">"), ("&#60;", "<"), ("&#62;", ">"), ("&amp;", "&")):
            x = F.replace(x, F.lit(ref), F.lit(char))
    return ~x.rlike(r"<\s*/?\s*[a-zA-Z!][^>]*>")


def digest_key(*parts: str | Column) -> Column:
    """An idempotency key of its parts."""
    return F.sha2(F.concat_ws("|", *(F.coalesce(col(p).cast("string"), F.lit("")) for p in parts)), 256)


def lock_key(c: str | Column) -> Column:
    """A signed 64-bit number of the first 16 hex digits of a digest."""
    return F.conv(F.substring(col(c), 1, 16), 16, -10).cast("long")


def plain_text(c: str | Column) -> Column:
    """HTML to text: elements that hold no text go, tags become spaces, common references are decoded."""
    x = F.regexp_replace(col(c), r"(?is)<!--.*?-->|<(script|style|noscript|template|svg)\b.*?</\1\s*>", " ")
    x = F.regexp_replace(x, r"(?s)<[^>]*>", " ")
    for ref, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")):
        x = F.replace(x, F.lit(ref), F.lit(char))
    return collapsed(x)


def page_title(c: str | Column) -> Column:
    return F.regexp_extract(col(c), r"(?is)<title[^>]*>(.*?)</title>", 1)


def alias_identity(c: str | Column) -> Column:
    return F.sha2(collapsed(nfkc_casefold(col(c))), 256)
