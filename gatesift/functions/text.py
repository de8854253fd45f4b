"""Text predicates and folding, as Spark SQL expressions.

Functions named ``*_sql`` take and give SQL text; the others give Columns. Texts are
named by a column name or any SQL expression. One parsed expression per column keeps
plans with hundreds of signatures quick to build from Python.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Unicode word characters and white space, spelled out so that the regex engine's
# own idea of \w, \b and \s does not matter.
WORD = r"[\p{L}\p{N}_]"
NOT_WORD = r"[^\p{L}\p{N}_]"
SPACE = r"[\s\p{Z}\x1C-\x1F\x85]"
NOT_SPACE = r"[^\s\p{Z}\x1C-\x1F\x85]"

# Characters that are rare in prose, rarest first. A signature is searched for only
# in texts that contain its anchor: the first of these characters that it contains,
# or a full stop that is followed by a letter.
RARE = "`$|{}@#<>[]\\%&;*=_!?(/:'\")"
DOT = "."
DOT_REGEX = r"\.[a-z]"

NO_STRINGS = "cast(array() AS array<string>)"


def quote(value: str) -> str:
    """A SQL string literal. Dollar signs are escaped: ``${x}`` would be substituted."""
    escaped = value.replace("\\", "\\\\").replace("'", "\\'").replace("$", "\\u0024")
    return f"'{escaped}'"


def string_array(values: Iterable[str]) -> str:
    items = [quote(v) for v in values]
    return f"array({', '.join(items)})" if items else NO_STRINGS


def has_content_sql(text: str) -> str:
    return f"coalesce({text} RLIKE {quote(NOT_SPACE)}, false)"


def has_content(text: str) -> Column:
    """True unless the text is NULL, empty or Unicode white space only."""
    return F.expr(has_content_sql(text))


def unicode_lower_sql(text: str) -> str:
    return f"lower({text})"


def ascii_lower_sql(text: str) -> str:
    """Lower-case so that substring tests with ASCII signatures are byte-wise.

    Only U+212A and U+0130 have lower-case forms with ASCII letters; with them out
    of the way, Unicode lower-casing gives the same ASCII hits and is much faster
    than a character map.
    """
    return f"lower(replace(replace({text}, '\\u212A', '\\uFFFD'), '\\u0130', '\\uFFFD'))"


def fold_sql(text: str, profile: str) -> str:
    return unicode_lower_sql(text) if profile == "text" else ascii_lower_sql(text)


def anchor(pattern: str) -> str | None:
    """The anchor of a (lower-case) signature, if it has any."""
    rare = next((c for c in RARE if c in pattern), None)
    if rare is None and re.search(DOT_REGEX, pattern):
        return DOT
    return rare


def anchor_test_sql(text: str, mark: str) -> str:
    if mark == DOT:
        return f"{text} RLIKE {quote(DOT_REGEX)}"
    return f"contains({text}, {quote(mark)})"


def anchors_of(patterns: Iterable[str]) -> list[str]:
    used = {anchor(p) for p in patterns}
    return [c for c in RARE + DOT if c in used]


def rare_regex(marks: Iterable[str]) -> str:
    """One character class for all anchors but the full stop."""
    return "[" + "".join("\\" + m for m in marks if m != DOT) + "]"


def any_of_sql(conditions: Iterable[str]) -> str:
    """Short-circuiting OR; nested in pairs, which keeps deep plans shallow."""
    items = list(conditions) or ["false"]
    while len(items) > 1:
        items = [f"({' OR '.join(items[i:i + 2])})" for i in range(0, len(items), 2)]
    return items[0]


def minimal(patterns: Iterable[str]) -> list[str]:
    """Signatures that contain no other one: enough to decide whether any matches."""
    distinct = list(dict.fromkeys(patterns))
    return [p for p in distinct if not any(q != p and q in p for q in distinct)]


def anchored_sql(text: str, patterns: Iterable[str], test: Callable[[str], str],
                 flags: dict[str, str] | None = None) -> str:
    """OR of ``test(pattern)``, each tried only where the pattern's anchor occurs.

    ``flags`` may name columns "the text contains this anchor"; other anchors are
    tested in place.
    """
    groups: dict[str | None, list[str]] = {}
    for pattern in patterns:
        groups.setdefault(anchor(pattern), []).append(pattern)
    tests = []
    for mark, members in groups.items():
        hit = any_of_sql(test(p) for p in members)
        if mark is not None:
            flag = (flags or {}).get(mark) or anchor_test_sql(text, mark)
            hit = flag if members == [mark] else f"({flag} AND {hit})"
        tests.append(hit)
    return any_of_sql(tests)


def contains_any_sql(text: str, patterns: Iterable[str],
                     flags: dict[str, str] | None = None) -> str:
    """True if any signature is a substring of the text."""
    return anchored_sql(text, minimal(patterns), lambda p: f"contains({text}, {quote(p)})", flags)


def matching_sql(text: str, patterns: Iterable[str]) -> str:
    """All signatures that the text contains, in list order, repeats kept."""
    return f"filter({string_array(patterns)}, p -> contains({text}, p))"


def keyword_boundary_regex(keyword: str) -> str:
    """A regex for one keyword between Unicode word boundaries.

    A boundary next to a word character means "no word character beyond"; next to
    any other character, such as a parenthesis, it means "a word character beyond".
    """
    before = f"(?<!{WORD})" if _is_word(keyword[0]) else f"(?<={WORD})"
    after = f"(?!{WORD})" if _is_word(keyword[-1]) else f"(?={WORD})"
    return before + re.sub(r"([^\w\s])", r"\\\1", keyword) + after


def _is_word(char: str) -> bool:
    return char.isalnum() or char == "_"


def is_single_token(keyword: str) -> bool:
    return all(_is_word(c) for c in keyword)


def tokens_sql(folded: str) -> str:
    """Maximal runs of word characters."""
    return f"split({folded}, {quote(NOT_WORD + '+')})"


def runs_sql(folded: str) -> str:
    """Maximal runs of word characters and of others, in order."""
    return f"regexp_extract_all({folded}, {quote(WORD + '+|' + NOT_WORD + '+')}, 0)"


# Different characters that a place of a piece may be told by; with more, any character fits.
PLACE_CHARACTERS = 200


def places_regex(places: Iterable[Iterable[int]]) -> str:
    """A regex for as many characters as there are places: each is one of the code points of its place."""
    classes = []
    for points in map(sorted, map(set, places)):
        members = "".join(f"\\x{{{p:x}}}" for p in points)
        classes.append(f"[{members}]" if len(points) <= PLACE_CHARACTERS else r"[\s\S]")
    return "".join(classes)


def run_windows_sql(folded: str, n: int, word: bool, places: Iterable[Iterable[int]]) -> str:
    """All that ``n`` consecutive runs spell and that a whole-word match may equal.

    The first run is one of word characters, or else of others; the first characters are of the code
    points of their ``places``. A match that begins or ends with other characters needs a word
    character beyond them.
    """
    kinds = [word == (i % 2 == 0) for i in range(n)]
    runs = "".join(f"{WORD if kind else NOT_WORD}++" for kind in kinds)
    # a letter beyond U+FFFF: without one, Java looks behind by halves of such characters
    behind = WORD[:-1] + "\U0001D49C]"
    before = f"(?<!{behind})" if word else f"(?<={behind})"
    after = "" if kinds[-1] else f"(?={WORD})"
    regex = f"(?={places_regex(places)}){before}(?=({runs}){after})"
    return f"regexp_extract_all({folded}, {quote(regex)}, 1)"


def whole_word_sql(folded: str, keyword: str) -> str:
    """Substring test first; only hits are checked for word boundaries."""
    return (f"(contains({folded}, {quote(keyword)}) "
            f"AND {folded} RLIKE {quote(keyword_boundary_regex(keyword))})")


def split_keywords(keywords: Iterable[str]) -> tuple[list[str], list[str]]:
    """Distinct lower-case keywords: those of one token, and the others."""
    words = list(dict.fromkeys(k.lower() for k in keywords if k))
    return [w for w in words if is_single_token(w)], \
           [w for w in words if not is_single_token(w)]


def contains_keyword_sql(folded: str, keywords: Iterable[str],
                         flags: dict[str, str] | None = None) -> str:
    """True if any keyword occurs as a whole word in the lower-cased text.

    One-word keywords are looked up among the tokens of the text.
    """
    single, other = split_keywords(keywords)
    tests = []
    if single:
        tests.append(f"arrays_overlap({tokens_sql(folded)}, {string_array(single)})")
    if other:
        tests.append(anchored_sql(folded, other, lambda w: whole_word_sql(folded, w), flags))
    return any_of_sql(tests)


def barrier(df: DataFrame, kept: list[str], computed: dict[str, str]) -> DataFrame:
    """Select ``kept`` and ``computed`` columns, the latter fixed at this point of the plan.

    A later filter on a computed column would otherwise be pushed below the projections
    that compute it, and each of its uses would expand to the whole expression and be
    evaluated again. Filters do not pass a generator's output, so the columns go through
    one that yields exactly one row. Filters on kept columns still reach the scan.
    """
    fields = ", ".join(f"'{name}', {sql}" for name, sql in computed.items())
    packed = df.select(*kept, F.expr(f"named_struct({fields})").alias("_gs_packed"))
    return packed.select(*kept, F.expr("inline_outer(array(_gs_packed))"))
