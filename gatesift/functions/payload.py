"""File payloads: base64, size and type checks, lenient decoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatesift import rules
from gatesift.functions.text import quote

PDF_MAGIC_HEX = "25504446"  # fixed value: "%PDF"

# Neither printable nor white space.
_UNPRINTABLE = (
    r"[\p{Cc}\p{Cf}\p{Cs}\p{Co}\p{Cn}\p{Zl}\p{Zp}\p{Zs}&&[^\s\p{Z}\x1C-\x1F\x85]]"
)
_NOT_ASCII = r"[^\x00-\x7F]"
_NOT_ALPHABET = "[^A-Za-z0-9+/=]+"
_DIGIT = "[A-Za-z0-9+/]"
_PLAIN = rf"^{_DIGIT}*={{0,2}}\z"
# Whole quads with stray padding between their characters, then one padded quad whose
# padding ends the data, or stray padding only. Possessive: no deep backtracking.
_STRAY = (
    rf"^((?:=*{_DIGIT}=*{_DIGIT}=?{_DIGIT}{_DIGIT})*+)"
    rf"(?:(=*{_DIGIT}=*{_DIGIT}(?:==|=?{_DIGIT}=)).*|=*)\z"
)


def _is_clean_sql(payload: str) -> str:
    return f"({payload} RLIKE {quote(_PLAIN)} AND octet_length({payload}) % 4 = 0)"


def with_decoded_base64(df: DataFrame, payload: str, output: str) -> DataFrame:
    """Add the bytes of a base64 payload; NULL if it is not valid.

    Decodes as a forgiving MIME reader does: characters outside the alphabet are
    skipped, text after complete padding is ignored; wrong padding or a non-ASCII
    character makes the payload invalid. Clean and line-broken payloads never reach
    the regular expressions of the others. ``payload`` is a column or SQL expression.
    """
    kept = df.columns
    staged = df.withColumn(
        "_gs_b64", F.expr(f"replace(replace({payload}, '\\r', ''), '\\n', '')"))
    staged = staged.withColumn("_gs_clean", F.expr(_is_clean_sql("_gs_b64")))
    staged = staged.withColumn("_gs_b64_kept", F.expr(
        f"CASE WHEN NOT _gs_clean AND NOT _gs_b64 RLIKE {quote(_NOT_ASCII)} "
        f"THEN regexp_replace(_gs_b64, {quote(_NOT_ALPHABET)}, '') END"))
    # the characters of whole quads, if the padding is right
    staged = staged.withColumn("_gs_b64_data", F.expr(
        f"CASE WHEN {_is_clean_sql('_gs_b64_kept')} THEN _gs_b64_kept "
        f"WHEN _gs_b64_kept RLIKE {quote(_STRAY)} THEN replace(concat("
        f"regexp_extract(_gs_b64_kept, {quote(_STRAY)}, 1), "
        f"regexp_extract(_gs_b64_kept, {quote(_STRAY)}, 2)), '=', '') END"))
    decoded = ("CASE WHEN _gs_clean THEN unbase64(_gs_b64) "
               "WHEN _gs_b64_data IS NOT NULL THEN unbase64(rpad(_gs_b64_data, "
               "cast(ceil(length(_gs_b64_data) / 4) * 4 AS int), '=')) END")
    return staged.select(*kept, F.expr(decoded).alias(output))


def too_large_sql(content: str, max_bytes: int = rules.MAX_BYTES) -> str:
    return f"octet_length({content}) > {max_bytes}"


def is_pdf_sql(content: str) -> str:
    return f"hex(substring({content}, 1, 4)) = '{PDF_MAGIC_HEX}'"


def decode_leniently_sql(content: str) -> str:
    """UTF-8 text with invalid bytes dropped.

    The validator marks invalid bytes with U+FFFD. Where the input has that character
    itself, it is escaped first and put back afterwards.
    """
    text = f"cast({content} AS string)"
    escaped = f"replace(replace({text}, '\\u0001', '\\u0001a'), '\\uFFFD', '\\u0001b')"
    cleaned = f"replace(make_valid_utf8({escaped}), '\\uFFFD', '')"
    restored = f"replace(replace({cleaned}, '\\u0001b', '\\uFFFD'), '\\u0001a', '\\u0001')"
    return (f"CASE WHEN is_valid_utf8({text}) THEN {text} "
            f"WHEN contains({text}, '\\uFFFD') THEN {restored} "
            f"ELSE replace(make_valid_utf8({text}), '\\uFFFD', '') END")


def decode_leniently(content: str) -> Column:
    return F.expr(decode_leniently_sql(content))


def with_file_kind(df: DataFrame, content: str, output: str,
                   condition: str = "true") -> DataFrame:
    """Add ``pdf``, ``text`` or NULL for anything else, where the condition holds.

    PDFs start with their magic bytes. Text is what has more than 85 % printable or
    white-space characters in its first KiB.
    """
    kept = df.columns
    sample = decode_leniently_sql(f"substring({content}, 1, {rules.SAMPLE_BYTES})")
    staged = df.withColumn("_gs_sample", F.expr(f"CASE WHEN {condition} THEN {sample} END"))
    # an empty sample divides by NULL, which makes the test fail
    ratio = (f"length(regexp_replace(_gs_sample, {quote(_UNPRINTABLE)}, '')) "
             "/ nullif(length(_gs_sample), 0)")
    return staged.select(*kept, F.expr(
        f"CASE WHEN NOT ({condition}) THEN NULL WHEN {is_pdf_sql(content)} THEN 'pdf' "
        f"WHEN {ratio} > {rules.MIN_PRINTABLE_RATIO}D THEN 'text' END").alias(output))
