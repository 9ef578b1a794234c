"""Text functions over log messages, as plain column expressions.

Patterns are compiled with three inline flags: ``d`` ('.' stops at line feeds
only), ``U`` (Unicode classes and word boundaries) and, where the match ignores
case, ``i``. Patterns stay literals, so each is compiled once per task.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from netsilt import rules
from netsilt.functions.columns import col, sql_literal


def rx(pattern: str, ignore_case: bool = False) -> str:
    return ("(?idU)" if ignore_case else "(?dU)") + pattern


def search_text(description: str | Column = "description", raw_message: str | Column = "raw_message") -> Column:
    empty = F.lit("")
    return F.concat(F.coalesce(col(description), empty), F.lit(" "), F.coalesce(col(raw_message), empty))


def find_all(text: str | Column, pattern: str, group: int = 0, ignore_case: bool = False) -> Column:
    return F.regexp_extract_all(col(text), F.lit(rx(pattern, ignore_case)), F.lit(group))


def needed_words(pattern: str) -> list[str] | None:
    """Lower-case words of which one is in every text that the pattern matches, ignoring case: the longest
    plain stretch of each alternative. None where groups, coded letters or an alternative without one leave it open."""
    if not pattern.isascii() or re.search(r"[()]|\\[0-9xucNkQE]", pattern):
        return None
    words = []
    for alternative in re.sub(r"\\.|\[(?:\\.|[^]\\])*\]", ".", pattern).split("|"):
        # a character that may be repeated or left out is not part of a stretch
        stretches = re.findall(r"[a-z0-9%]+", re.sub(r".[?*+]|.\{[^}]*\}", ".", alternative.lower()))
        if not stretches:
            return None
        words.append(max(stretches, key=len))
    return words


def plain_text(text: str | Column, lower_text: str | Column) -> Column:
    """The lower-case text if the text is ASCII, else null: letters of other scripts may match ASCII ones."""
    return F.when(F.length(col(text)) == F.octet_length(col(text)), col(lower_text))


def found(text: str | Column, pattern: str, ignore_case: bool = True, plain: str | Column | None = None) -> Column:
    """Whether the pattern occurs in the text. With ``plain`` (see ``plain_text``) it runs only where one of its
    needed words occurs, or where the text is not plain."""
    hit = col(text).rlike(rx(pattern, ignore_case))
    words = needed_words(pattern) if plain is not None and ignore_case else None
    if not words:
        return hit
    return reduce(Column.__or__, [F.contains(col(plain), F.lit(w)) for w in words], F.isnull(col(plain))) & hit


def first_match(text: str | Column, patterns: Sequence[str], ignore_case: bool = True, plain: str | None = None) -> Column:
    """1-based number of the first pattern found in the text, null if none is.

    One lazy CASE: a row stops at its first hit.
    """
    out = None
    for number, pattern in enumerate(patterns, start=1):
        hit = found(text, pattern, ignore_case, plain)
        out = F.when(hit, F.lit(number)) if out is None else out.when(hit, F.lit(number))
    return out


def keyword_hits(lower_text: str, words: Sequence[str]) -> Column:
    """How many of the words occur as substrings.

    One small loop over a constant list: a hundred inlined ``contains`` calls make
    the generated method too large to be compiled.
    """
    return F.expr(f"size(filter({sql_literal(list(words))}, w -> contains({lower_text}, w)))")


def any_keyword(lower_text: str, words: Sequence[str]) -> Column:
    return F.expr(f"exists({sql_literal(list(words))}, w -> contains({lower_text}, w))")


def message_template(text: str | Column) -> Column:
    """Message with its variable parts replaced by place holders, lower-cased last."""
    out = F.regexp_replace(col(text), rx(rules.IPV4), "<IP>")
    out = F.regexp_replace(out, rx(rules.TEMPLATE_HEX, True), "<HEX>")
    out = F.regexp_replace(out, rx(rules.TEMPLATE_INTERFACE, True), "<IFACE>")
    out = F.regexp_replace(out, rx(rules.TEMPLATE_NUMBER), "<NUM>")
    out = F.regexp_replace(out, rx(r"\s+"), " ")
    return F.lower(F.trim(out))


def iocs(text: str | Column) -> Column:
    """Indicators of compromise as struct(ips, ports, domains, hashes).

    Every list is distinct, in order of first occurrence in the whole text.
    """
    ports = F.transform(find_all(text, rules.PORT, 1), lambda p: p.try_cast("int"))
    return F.struct(
        F.array_distinct(find_all(text, rules.IPV4)).alias("ips"),
        F.array_distinct(F.filter(ports, lambda p: p <= rules.MAX_PORT)).alias("ports"),
        F.array_distinct(find_all(text, rules.DOMAIN, 0, True)).alias("domains"),
        F.array_distinct(find_all(text, rules.FILE_HASH, 0, True)).alias("hashes"),
    )


def impacted_components(text: str | Column, lower_text: str) -> Column:
    """Named interfaces, then the distinct of the first three addresses, then
    components any of whose words occurs; at most ten entries."""
    interfaces = F.array_distinct(find_all(text, rules.NAMED_INTERFACE, 0, True))
    addresses = F.array_distinct(F.slice(find_all(text, rules.IPV4), 1, rules.MAX_COMPONENT_IPS))
    components = F.array_compact(F.array(*[
        F.when(any_keyword(lower_text, words), F.lit(name)) for name, words in rules.COMPONENT_KEYWORDS.items()
    ]))
    return F.slice(F.concat(interfaces, addresses, components), 1, rules.MAX_COMPONENTS)


def software_version(version: str | Column, text: str | Column) -> Column:
    """The given version, else the first version pattern found in the text."""
    blank = F.lit("")
    found = [F.nullif(F.regexp_extract(col(text), rx(p, True), 0), blank) for p in rules.VERSION_PATTERNS]
    return F.coalesce(F.nullif(col(version), blank), *found, F.lit(rules.UNKNOWN_VERSION))


def parse_timestamp(text: str | Column) -> Column:
    """ISO-8601 text to timestamp, null where it cannot be read."""
    return col(text).try_cast("timestamp")
