"""Text column functions.

Patterns carry the Java flag ``(?U)`` where word and space classes must follow Unicode.
A plain substring test comes before a costly pattern where it can rule most texts out.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tidemark.schemas import REMOVED_MARKERS

# --- fixed values: patterns and lists that decide the results ----------------
URL_PATTERN = r"(?U)https?://\S+|www\.\S+"
IMAGE_PATTERN = r"!\[img\]\(emote\|[^)]+\)"
LINK_PATTERN = r"\[([^\]]+)\]\([^)]+\)"
USER_PATTERN = r"(?U)/u/\w+|u/\w+"
SUBREDDIT_PATTERN = r"(?U)/r/\w+|r/\w+"
MARKER_PATTERN = r"(?i)\[deleted\]|\[removed\]"
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
DUMP_ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x200B;", ""))
NAMED_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"),
                  ("&amp;", "&"))
LOW_QUALITY_PATTERNS = (
    r"(?i)^(lol|lmao|wtf|omg|this|nice|cool|wow|ok|okay)\.?$",
    r"(?iU)^\w{1,2}$",
    r"(?iU)^[\W_]+$",
)
UNSAFE_PATH_CHARS = '/\\:*?"<>|\n\r\t'


def text(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column) -> Column:
    """Trim all white space, not only blanks."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def words(c: Column) -> Column:
    """White-space separated words, none for blank text."""
    return F.array_remove(F.split(c, r"(?U)\s+"), "")


def word_count(c: Column) -> Column:
    return F.size(words(c))


def count_chars(c: Column, chars: str) -> Column:
    """How many characters of the text are among ``chars``."""
    return F.regexp_count(c, F.lit(f"[{chars}]"))


def count_capitals(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"\p{IsUppercase}"))


def count_segments(c: Column, ends: str) -> Column:
    """Non-blank pieces between runs of the ``ends`` characters."""
    return F.regexp_count(c, F.lit(rf"(?U)[^{ends}\s][^{ends}]*"))


def _replace_all(c: Column, pairs) -> Column:
    for old, new in pairs:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def clean_dump_text(c: Column | str) -> Column:
    """Dump text: five entities decoded, white space collapsed, removed markers emptied."""
    c = F.coalesce(text(c), F.lit(""))
    decoded = F.when(c.contains("&"), _replace_all(c, DUMP_ENTITIES)).otherwise(c)
    cleaned = strip(collapse_whitespace(decoded))
    return F.when(c.isin("nan", *REMOVED_MARKERS), "").otherwise(cleaned)


def decode_named_entities(c: Column | str) -> Column:
    """The common entities, decoded inside the JVM; ampersand goes last so nothing decodes twice."""
    return _replace_all(text(c), NAMED_ENTITIES)


def entity_names() -> dict[str, list[tuple[str, str]]]:
    """Named entities by their first two letters, longest names first; names without a semicolon are names too."""
    from html.entities import html5

    table: dict[str, list[tuple[str, str]]] = {}
    for name in sorted(html5, key=lambda n: (-len(n), n)):
        table.setdefault(name[:2], []).append((name, html5[name]))
    return table


def _code_point(number: Column) -> Column:
    """The number behind ``#`` in decimal or, after an x, in hexadecimal; beyond all characters where it is too long."""
    digits = F.regexp_replace(F.regexp_replace(number, "^[xX]", ""), "^0+(?=.)", "")
    beyond = F.lit(1 << 40)
    in_hex = F.when(F.length(digits) <= 8, F.conv(digits, 16, 10).try_cast("bigint")).otherwise(beyond)
    plain = F.when(F.length(digits) <= 12, digits.try_cast("bigint")).otherwise(beyond)
    return F.when(F.lower(F.substring(number, 1, 1)) == "x", in_hex).otherwise(plain)


def _utf8(cp: Column) -> Column:
    """A character from its code point, by the bytes of its encoding."""
    def six(shift):
        return F.shiftright(cp, shift).bitwiseAND(F.lit(63).cast("bigint"))

    two = 0xC080 + F.shiftright(cp, 6) * 256 + six(0)
    three = 0xE08080 + F.shiftright(cp, 12) * 65536 + six(6) * 256 + six(0)
    four = 0xF0808080 + F.shiftright(cp, 18) * 16777216 + six(12) * 65536 + six(6) * 256 + six(0)
    code = F.when(cp < 0x80, cp).when(cp < 0x800, two).when(cp < 0x10000, three).otherwise(four)
    return F.decode(F.unhex(F.lpad(F.hex(code), F.when(cp < 0x80, 2).otherwise(F.length(F.hex(code))), F.lit("0"))), "UTF-8")


def _numbered(cp: Column) -> Column:
    """What a numeric entity stands for: 128 to 159 mean the Windows character, non-characters vanish."""
    windows = F.array(*[F.lit(bytes([n]).decode("cp1252", "ignore") or chr(n)) for n in range(128, 160)])
    gone = (cp.between(1, 8) | (cp == 11) | cp.between(14, 31) | (cp == 127) | cp.between(0xFDD0, 0xFDEF)
            | (cp.bitwiseAND(F.lit(0xFFFE).cast("bigint")) == 0xFFFE))
    return (F.when((cp == 0) | cp.between(0xD800, 0xDFFF) | (cp > 0x10FFFF), "\ufffd")
            .when(cp.between(128, 159), F.get(windows, (cp - 128).cast("int"))).when(gone, "").otherwise(_utf8(cp)))


def decode_all_entities(c: Column | str) -> Column:
    """Every named and numeric entity, with or without a semicolon, decoded once.

    The text is split at its ampersands; each piece begins with a number or with the longest name that fits.
    """
    import json

    c = text(c)
    kind = "map<string,array<struct<n:string,v:string>>>"
    table = F.from_json(F.lit(json.dumps({k: [{"n": n, "v": v} for n, v in rows] for k, rows in entity_names().items()})), kind)
    numeric = "^#([0-9]+|[xX][0-9a-fA-F]+);?"

    def decoded(piece: Column) -> Column:
        number = F.regexp_extract(piece, numeric, 1)
        after = F.length(F.regexp_extract(piece, numeric, 0)) + 1
        best = F.get(F.filter(F.try_element_at(table, F.substring(piece, 1, 2)), lambda x: F.startswith(piece, x["n"])), 0)
        return (F.when(number != "", F.concat(_numbered(_code_point(number)), F.substr(piece, after)))
                .when(best.isNotNull(), F.concat(best["v"], F.substr(piece, F.length(best["n"]) + 1)))
                .otherwise(F.concat(F.lit("&"), piece)))

    pieces = F.split(c, "&")
    rest = F.transform(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))), decoded)
    return F.when(c.contains("&"), F.concat(F.get(pieces, 0), F.array_join(rest, ""))).otherwise(c)


def remove_urls(c: Column | str) -> Column:
    return F.regexp_replace(text(c), URL_PATTERN, "")


def remove_markup(c: Column | str) -> Column:
    """Drop embedded images, keep the label of links."""
    return F.regexp_replace(F.regexp_replace(text(c), IMAGE_PATTERN, ""), LINK_PATTERN, "$1")


def remove_user_mentions(c: Column | str) -> Column:
    return F.regexp_replace(text(c), USER_PATTERN, "")


def remove_subreddit_mentions(c: Column | str) -> Column:
    return F.regexp_replace(text(c), SUBREDDIT_PATTERN, "")


def remove_deleted_markers(c: Column | str) -> Column:
    return F.regexp_replace(text(c), MARKER_PATTERN, "")


def collapse_whitespace(c: Column | str) -> Column:
    # single blanks, by far the most frequent case, stay untouched
    return F.regexp_replace(text(c), r"(?U)\s{2,}|[^\S ]", " ")


def truncate(c: Column | str, max_length: int) -> Column:
    c = text(c)
    short = F.concat(F.substring(c, 1, max_length - 3), F.lit("..."))
    return F.when(F.length(c) > max_length, short).otherwise(c)


def clean_comment(
    c: Column | str,
    *,
    entities: str = "all",
    urls: bool = True,
    markup: bool = True,
    user_mentions: bool = False,
    subreddit_mentions: bool = False,
    deleted_markers: bool = True,
    whitespace: bool = True,
    max_length: int | None = None,
) -> Column:
    """Comment clean-up in a fixed order.

    ``entities`` is ``"all"``, ``"named"`` (the common ones) or ``"none"``.
    """
    c = F.coalesce(text(c), F.lit(""))
    if entities == "all":
        c = decode_all_entities(c)
    elif entities == "named":
        c = decode_named_entities(c)
    steps = (
        (urls, remove_urls),
        (markup, remove_markup),
        (user_mentions, remove_user_mentions),
        (subreddit_mentions, remove_subreddit_mentions),
        (deleted_markers, remove_deleted_markers),
        (whitespace, collapse_whitespace),
    )
    for wanted, step in steps:
        if wanted:
            c = step(c)
    if max_length:
        c = truncate(c, max_length)
    return strip(c)


def text_metrics(c: Column | str) -> dict[str, Column]:
    """Length, word, sentence and line counts, link and mention flags, capitals, punctuation."""
    c = text(c)
    return {
        "length": F.length(c),
        "word_count": word_count(c),
        "sentence_count": count_segments(c, "."),
        "contains_urls": (c.contains("http") | c.contains("www.")) & c.rlike(URL_PATTERN),
        "contains_user_mentions": c.contains("u/") & c.rlike(USER_PATTERN),
        "contains_subreddit_mentions": c.contains("r/") & c.rlike(SUBREDDIT_PATTERN),
        "line_count": count_chars(c, "\n") + 1,
        "uppercase_ratio": F.try_divide(count_capitals(c), F.length(c)),
        "punctuation_count": count_chars(c, "!?.,;:"),
    }


def is_low_quality(c: Column | str, min_words: int = 3) -> Column:
    c = F.coalesce(text(c), F.lit(""))
    trimmed = strip(c)
    verdict = trimmed == ""
    for pattern in LOW_QUALITY_PATTERNS:
        verdict = verdict | trimmed.rlike(pattern)
    return verdict | (word_count(c) < min_words)


def normalise_ticker(c: Column | str, strip_dollar: bool = True) -> Column:
    c = text(c)
    if strip_dollar:
        c = F.replace(c, F.lit("$"), F.lit(""))
    return F.trim(F.upper(c))


def scored_line(body: Column, score: Column, kind: str, with_score: bool = True) -> Column:
    """``kind: body (score n)``; an unreadable score shows as unknown, a missing one as 0."""
    if not with_score:
        return F.concat(F.lit(f"{kind}: "), body)
    number = F.coalesce(score.cast("string"), F.lit("0")).try_cast("double").try_cast("bigint")
    label = F.coalesce(number.cast("string"), F.lit("unknown"))
    return F.concat(F.lit(f"{kind}: "), body, F.lit(" (score "), label, F.lit(")"))


def safe_path_value(c: Column | str, max_length: int = 200) -> Column:
    """A partition value that every file system accepts; a longer one ends in a digest of the whole."""
    c = F.translate(text(c), UNSAFE_PATH_CHARS, "_" * len(UNSAFE_PATH_CHARS))
    c = F.btrim(c, F.lit(". "))
    cut = F.concat(F.substring(c, 1, max_length - 17), F.lit("-"), F.substring(F.md5(c), 1, 16))
    return F.when(c == "", "unnamed").when(F.length(c) > max_length, cut).otherwise(c)


def prompt(template: str, title: Column, body: Column, comment: Column) -> Column:
    """Fill ``{title}``, ``{body}`` and ``{comment}`` with fallbacks for empty parts."""
    parts = {
        "title": F.coalesce(title, F.lit("")),
        "body": F.coalesce(F.nullif(body, F.lit("")), F.lit("No submission body")),
        "comment": F.coalesce(F.nullif(comment, F.lit("")), F.lit("No comments")),
    }
    pieces: list[Column] = []
    rest = template
    while rest:
        cut = rest.find("{")
        if cut < 0:
            pieces.append(F.lit(rest))
            break
        if cut:
            pieces.append(F.lit(rest[:cut]))
        end = rest.index("}", cut)
        pieces.append(parts[rest[cut + 1 : end]])
        rest = rest[end + 1 :]
    return F.concat(*pieces)


def labelling_text(fields: dict[str, Column], max_length: int) -> tuple[Column, Column]:
    """``name: value`` lines, title and body first; cut at a late newline when too long.

    Returns the text and a flag that says whether it was cut.
    """
    first = [k for k in fields if k in ("title", "selftext", "body")]
    order = first + [k for k in fields if k not in first]
    full = F.concat_ws(
        "\n",
        *[F.concat(F.lit(f"{k}: "), F.coalesce(fields[k].cast("string"), F.lit("None"))) for k in order],
    )
    head = F.substring(full, 1, max_length)
    from_end = F.instr(F.reverse(head), "\n")
    last_newline = F.when(from_end > 0, F.length(head) - from_end).otherwise(-1)
    backed_off = F.when(
        last_newline > max_length * 0.8, F.substring(head, F.lit(1), last_newline)
    ).otherwise(head)
    too_long = F.length(full) > max_length
    cut = F.concat(backed_off, F.lit("\n[TEXT TRUNCATED]"))
    return F.when(too_long, cut).otherwise(full), too_long
