"""Redaction, error messages and HTML to plain text."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Credential patterns and their replacements, applied in this order. Blanks and
# word boundaries follow Unicode. The last part lists lower-case substrings of which a text
# must hold one for the rule to match.
REDACTION_RULES: tuple[tuple[str, str, tuple[str, ...]], ...] = (
    (r"""(?iU)\bpostgres(?:ql)?://[^\s'"`<>]+""", "[REDACTED_DATABASE_URL]", ("postgres",)),
    (r"(?U)\bvercel_blob_[A-Za-z0-9_-]+", "[REDACTED]", ("vercel_blob_",)),
    (r"(?U)\bGOCSPX-[A-Za-z0-9_-]+", "[REDACTED]", ("gocspx-",)),
    (r"""(?iU)\bBearer\s+[^\s,'"`<>]+""", "Bearer [REDACTED]", ("bearer",)),
    (r"(?U)\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\b", "[REDACTED]", ("eyj",)),
    (
        r"(?iU)([?&](?:access_token|api_key|auth|client_secret|password|secret|signature|token|x-amz-signature)=)[^&#\s]+",
        "$1[REDACTED]",
        ("token=", "api_key=", "auth=", "secret=", "password=", "signature="),
    ),
    (
        r"""(?iU)("(?:access_token|api_key|authorization|client_secret|password|private_key|secret|token)"\s*:\s*")[^"]*(")""",
        "$1[REDACTED]$2",
        ('token"', '_key"', 'authorization"', 'secret"', 'password"'),
    ),
    (
        r"""(?iU)(\b(?:access[_-]?token|api[_-]?key|authorization|client[_-]?secret|password|private[_-]?key|secret|signature|token)\s*[:=]\s*)(?:"[^"]*"|'[^']*'|[^\s,;'"`<>}\]]+)""",
        "$1[REDACTED]",
        ("token", "key", "authorization", "secret", "password", "signature"),
    ),
)

# The shorter rules for messages shown to operators.
SHORT_RULES: tuple[tuple[str, str], ...] = (
    (r"(?iU)(postgres(?:ql)?://)[^@\s]+@", "$1•••@"),
    (r"(?i)\bvercel_blob_[a-z0-9_=-]+\b", "•••"),
    (r"(?iU)([?&](?:access_?token|api_?key|password|secret|token)=)[^&\s]+", "$1•••"),
)


def _without_secrets(text: Column, secrets: Sequence[str]) -> Column:
    for secret in sorted((s for s in secrets if s), key=len, reverse=True):
        text = F.replace(text, F.lit(secret), F.lit("[REDACTED]"))
    return text


def redact(text: Column, secrets: Sequence[str] = ()) -> Column:
    """Remove configured secrets, longest first, then everything that looks like a credential."""
    text = _without_secrets(text, secrets)
    for pattern, replacement, _ in REDACTION_RULES:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def redact_texts(df: DataFrame, column: str, secrets: Sequence[str] = ()) -> DataFrame:
    """Same result over a table of long texts: a rule runs only where one of its substrings occurs.

    Substring tests on the folded text are far cheaper than the expressions, and no replacement
    can create a substring that was not there before.
    """
    # letters that fold to ASCII in a case-insensitive rule, such as the long s
    folded = F.translate(F.lower(column), "\u017f\u212a\u0131\u0130", "skii")
    rows = df.withColumn(column, _without_secrets(F.col(column), secrets)).withColumn("_folded", folded)
    for pattern, replacement, needles in REDACTION_RULES:
        suspect = reduce(lambda a, b: a | b, [F.col("_folded").contains(n) for n in needles])
        rows = rows.withColumn(column, F.when(suspect, F.regexp_replace(column, pattern, replacement)).otherwise(F.col(column)))
    return rows.drop("_folded")


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def safe_error_message(text: Column, secrets: Sequence[str] = (), limit: int = 2000) -> Column:
    return bounded_message(redact(text, secrets), limit)


def bounded_message(redacted: Column, limit: int = 2000) -> Column:
    message = squeeze(redacted)
    return F.substring(F.when(message == "", "Unknown error").otherwise(message), 1, limit)


def short_error(text: Column, limit: int = 220) -> Column:
    """Operator-facing form; NULL for a missing or blank error."""
    out = text
    for pattern, replacement in SHORT_RULES:
        out = F.regexp_replace(out, pattern, replacement)
    return F.when(F.trim(text) != "", F.substring(squeeze(out), 1, limit))


# One token: script and style elements whole, comments, declarations, tags (a quoted ``>`` does not
# end them), text, a lone ``<``.
_TOKEN = (
    r"""(?is)<(?:script|style)\b[^>]*+>.*?</(?:script|style)\s*+>|<!--.*?(?:-->|\z)|<[!?][^>]*+>|</?[a-z](?:[^>"']++|"[^"]*+"|'[^']*+')*+>|[^<]++|<"""
)
_BLOCK = r"""(?i)^</?(?:div|li|p|tr)(?:[\s/>])|^<br[\s/>]"""
_REFERENCE = r"&(?:#[0-9]++;?|#[xX][0-9a-fA-F]++;?|[A-Za-z][A-Za-z0-9]*;?)|[^&]++|&"


def _windows(code: int) -> str:
    """What old pages mean by the codes 80 to 9F."""
    try:
        return bytes([code]).decode("cp1252")
    except UnicodeDecodeError:
        return chr(code)


def _number(digits: Column, base: int) -> Column:
    """The value of digits of any length; one too large for a character stands for all of those."""
    short = F.regexp_replace(digits, "^0+(?=.)", "")
    return F.when(F.length(short) <= 7, F.conv(short, base, 10).cast("bigint")).otherwise(F.lit(0x110000).cast("bigint"))


def _scalar(number: Column) -> Column:
    """The character of a code point: U+FFFD where there is none, nothing for control and non-characters."""
    valid = (number > 0) & (number <= 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
    void = number.between(1, 8) | (number == 0xB) | number.between(0xE, 0x1F) | (number == 0x7F)
    void = void | number.between(0xFDD0, 0xFDEF) | (number.bitwiseAND(0xFFFE) == 0xFFFE)
    code = F.when(valid, number).otherwise(F.lit(0xFFFD))
    old = F.try_element_at(F.array(*[F.lit(_windows(k)) for k in range(0x80, 0xA0)]), (number - 0x7F).cast("int"))
    return (
        F.when(number.between(0x80, 0x9F), old)
        .when(valid & void, F.lit(""))
        .otherwise(F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
    )


def _decoded(text: Column) -> Column:
    """Character references replaced: numbers, the named ones, and the old names without semicolon."""
    names = {k: v for k, v in html5.items()}
    table = F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*map(F.lit, names.values())))
    old = "|".join(sorted((k for k in names if not k.endswith(";")), key=lambda k: (-len(k), k)))

    def one(piece: Column) -> Column:
        digits = F.regexp_extract(piece, "^&#([0-9]+)", 1)
        hexed = F.regexp_extract(piece, "^&#[xX]([0-9a-fA-F]+)", 1)
        name = F.substring(piece, 2, 64)  # no name is longer
        prefix = F.regexp_extract(name, f"^(?:{old})", 0)
        rest = F.substr(piece, F.length(prefix) + 2)
        return (
            F.when(~piece.startswith("&") | (piece == "&"), piece)
            .when(digits != "", _scalar(_number(digits, 10)))
            .when(hexed != "", _scalar(_number(hexed, 16)))
            .when(F.try_element_at(table, name).isNotNull(), F.try_element_at(table, name))
            .when(prefix != "", F.concat(F.try_element_at(table, prefix), rest))
            .otherwise(piece)
        )

    pieces = F.regexp_extract_all(text, F.lit(_REFERENCE), F.lit(0))
    return F.when(text.contains("&"), F.array_join(F.transform(pieces, one), "")).otherwise(text)


def html_to_text(html: Column | str) -> Column:
    """Compact plain text: block tags become blanks, other tags go, references are decoded.

    Scripts and styles keep their raw text, comments and declarations go, blanks are squeezed; NULL
    gives an empty text.
    """
    html = F.col(html) if isinstance(html, str) else html

    def one(token: Column) -> Column:
        raw = F.regexp_replace(token, r"(?is)^<(?:script|style)\b[^>]*+>|</(?:script|style)\s*+>$", "")
        return (
            F.when(~token.startswith("<") | (token == "<"), _decoded(token))
            .when(token.rlike(r"(?i)^<(?:script|style)\b.*"), raw)
            .when(token.rlike(_BLOCK), F.lit(" "))
            .otherwise(F.lit(""))
        )

    tokens = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(_TOKEN), F.lit(0))
    return squeeze(F.array_join(F.transform(tokens, one), ""))
