"""Cache keys, lifetimes and key patterns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from gatesift import rules

KEY_PREFIX = "validation"  # fixed value


def cache_key(content: Column, analysis_type: Column, level: Column) -> Column:
    """``validation:{type}:{level}:{sha256 of the UTF-8 content}``; NULL content, NULL key."""
    return F.concat(F.lit(KEY_PREFIX + ":"), analysis_type, F.lit(":"), level, F.lit(":"),
                    F.sha2(content.cast("binary"), 256))


def ttl_seconds(analysis_type: Column, explicit: Column | None = None,
                text_ttl: int = rules.TEXT_TTL_SECONDS,
                file_ttl: int = rules.FILE_TTL_SECONDS) -> Column:
    """The explicit lifetime if given, else the one of the analysis type."""
    default = F.when(analysis_type == "text", F.lit(text_ttl)).otherwise(F.lit(file_ttl))
    return default if explicit is None else F.coalesce(explicit.cast("int"), default)


def glob_to_regex(pattern: str) -> str:
    r"""An anchored regex for a key glob: ``*``, ``?``, ``[a-c]``, ``[^a]`` and ``\`` escapes."""
    out, i = [], 0
    while i < len(pattern):
        char = pattern[i]
        end = pattern.find("]", i + 2) if char == "[" else -1
        if char == "*":
            out.append(".*")
        elif char == "?":
            out.append(".")
        elif end > 0:
            body = pattern[i + 1:end]
            negated = body.startswith("^")
            body = re.sub(r"([\\\[\]&^])", r"\\\1", body[1:] if negated else body)
            out.append(f"[{'^' if negated else ''}{body}]")
            i = end
        elif char == "\\" and i + 1 < len(pattern):
            i += 1
            out.append(re.escape(pattern[i]))
        else:
            out.append(re.escape(char))
        i += 1
    return "(?s)^" + "".join(out) + "$"


def glob_segments(pattern: str) -> dict[str, str]:
    """Partition values that a glob pins down: ``validation:text:*`` gives the type."""
    parts = pattern.split(":")
    pinned = {}
    if parts[0] == KEY_PREFIX:
        for name, part in zip(("analysis_type", "security_level"), parts[1:-1]):
            if re.fullmatch(r"\w+", part) is None:
                break
            pinned[name] = part
    return pinned


def key_kind(key: Column) -> Column:
    """The part of a key before its first colon."""
    return F.split_part(key, F.lit(":"), F.lit(1))
