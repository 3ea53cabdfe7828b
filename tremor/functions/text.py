"""Post-text cleaning chain as native column expressions.

Every step is a ``Column -> Column`` function so Catalyst keeps the whole
chain inside one projection (whole-stage codegen, no Python on the hot
path). ``clean_text`` applies the steps in the reference order.

Regex dialect notes: Java's ``.`` and ``\\s`` differ from Python's, so the
patterns spell out the classes they mean. The same pattern strings are valid
RE2 (DuckDB), which is how the SQL oracles reuse them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values that must equal the reference --------------------------------
# Literal removed by T2.
LINK_MARKER = "O网页链接"
# Video marker removed by T3 (greedy within a line).
VIDEO_END = "的微博视频"
VIDEO_PATTERN = f"L([^\n]+){VIDEO_END}"
# Forward marker and lazy reply prefix removed by T7.
FORWARD_PATTERN = "转发微博|回复@[^\n]*?:"
# Full-width -> half-width punctuation (T8), 13 working pairs, in map order.
PUNCT_FULL = "，。！？；：（）【】、《》"
PUNCT_HALF = ",.!?;:()[],<>"
# Characters Python's str.split()/\s treats as whitespace (Unicode White_Space
# plus the information separators U+001C..U+001F).
WS_CLASS = (r"\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
            r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")
# -------------------------------------------------------------------------------

WS = f"[{WS_CLASS}]"
# T4 tokens, tried in this order at each position: a closed tag, a run
# without `#`, a lone `#`.
HASHTAG_TOKEN_PATTERN = "#[^#]+#|[^#]+|#"
NON_WS = f"[^{WS_CLASS}]"

# T5: our own platform cleaner (the third-party one is not part of the
# reference, so parity is not claimed). One rule per pattern.
MARKDOWN_LINK_PATTERN = rf"\[([^\[\]]+)\]\([^(){WS_CLASS}]+\)"
URL_PATTERN = r"(?i)https?://[a-z0-9\-._~:/?#@!$&'*+,;=%]+"
# An address begins where a run of its characters does, or where the one before it ended: no
# search starts inside a run, and none gives a character of the run back.
EMAIL_PATTERN = r"(?:(?<![A-Za-z0-9_.+-])|\G)[A-Za-z0-9_.+-]++@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}"
MENTION_PATTERN = f"(?:回复)?(?://)?@[^@:：{WS_CLASS}]+[:：]?"
TAG_PATTERN = r"<[A-Za-z/!][^<>]*>"

# Default emoji -> name table (Chinese CLDR short names). Callers pass
# their own table for full coverage; the reference's table is a third-party
# package that is not in the tree.
DEFAULT_EMOJI_NAMES = {
    "\U0001F602": "笑哭了",
    "❤️": "红心",
    "❤": "红心",
    "\U0001F44D": "拇指向上",
    "\U0001F64F": "双手合十",
    "\U0001F62D": "放声大哭",
    "\U0001F621": "怒火中烧",
    "\U0001F525": "火焰",
    "\U0001F468‍\U0001F469‍\U0001F467": "家庭: 男人女人女孩",
}


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _bound(col: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn`` of a value that is computed once, however often ``fn`` refers to it."""
    return F.element_at(F.transform(F.array(col), fn), 1)


def _where(col: Column | str, found: Callable[[Column], Column], fn: Callable[[Column], Column]) -> Column:
    """A rule for the texts that ``found`` holds for; it cannot match in the others, which stay as they are."""
    return _bound(_c(col), lambda t: F.when(found(t), fn(t)).otherwise(t))


def _holding(*pieces: str) -> Callable[[Column], Column]:
    def found(t: Column) -> Column:
        out = F.contains(t, F.lit(pieces[0]))
        for piece in pieces[1:]:
            out = out | F.contains(t, F.lit(piece))
        return out
    return found


def fill_missing(col: Column | str) -> Column:
    """Missing -> '' otherwise string."""
    return F.coalesce(_c(col).cast("string"), F.lit(""))


def remove_links(col: Column | str) -> Column:
    """Drop the literal link marker."""
    return F.replace(_c(col), F.lit(LINK_MARKER), F.lit(""))


def remove_video(col: Column | str) -> Column:
    """Drop `L...的微博视频` greedily within one line."""
    return _where(col, _holding(VIDEO_END), lambda t: F.regexp_replace(t, VIDEO_PATTERN, ""))


def dedupe_hashtags(col: Column | str) -> Column:
    """T4: `#x#` -> `x ` on first sight, removed when seen before.

    A left-to-right scan for `#x#` (x non-empty, may span lines) is exactly
    the tag rule: an empty or unclosed part is not a tag, and a closing `#`
    cannot open the next tag. So one ``regexp_extract_all`` cuts the text into
    tokens (a tag, a run without `#`, or a lone `#`) in a single pass. Sorted by
    (token, place), equal tokens are neighbours and the first one's place comes
    first; sorted back by place, each tag knows whether it is the first of its
    kind: n log n in the tokens, nothing is looked up or rebuilt per tag. Texts
    without `#` stay as they are.
    """
    def first_flags(tokens: Column) -> Column:
        placed = F.sort_array(F.transform(tokens, lambda t, i: F.struct(t.alias("t"), i.alias("i"))))
        return _bound(placed, lambda by: F.sort_array(F.transform(by, lambda e, k: F.struct(
            e["i"].alias("i"), e["t"].alias("t"), ((k == 0) | (F.get(by, k - 1)["t"] != e["t"])).alias("first")))))

    def piece(e: Column) -> Column:
        t = e["t"]
        is_tag = (F.length(t) >= 3) & t.startswith("#")
        body = F.substring(t, F.lit(2), F.length(t) - 2)
        return F.when(is_tag & e["first"], F.concat(body, F.lit(" "))).when(is_tag, F.lit("")).otherwise(t)

    def rewrite(t: Column) -> Column:
        tokens = F.regexp_extract_all(t, F.lit(HASHTAG_TOKEN_PATTERN), 0)
        return F.array_join(F.transform(first_flags(tokens), piece), "")

    return _where(col, _holding("#"), rewrite)


def remove_markdown_links(col: Column | str) -> Column:
    """T5: `[text](target)` -> `text`."""
    return _where(col, _holding("]("), lambda t: F.regexp_replace(t, MARKDOWN_LINK_PATTERN, "$1"))


def remove_urls(col: Column | str) -> Column:
    """T5: drop http(s) addresses; closing brackets are not part of one."""
    return _where(col, _holding("://"), lambda t: F.regexp_replace(t, URL_PATTERN, ""))


def remove_emails(col: Column | str) -> Column:
    """T5: drop e-mail addresses."""
    return _where(col, _holding("@"), lambda t: F.regexp_replace(t, EMAIL_PATTERN, ""))


def remove_mentions(col: Column | str) -> Column:
    """T5: `@name`, `//@name:` and `回复@name:` -> one blank."""
    return _where(col, _holding("@"), lambda t: F.regexp_replace(t, MENTION_PATTERN, " "))


def remove_tags(col: Column | str) -> Column:
    """T5: drop HTML tags."""
    return _where(col, _holding("<"), lambda t: F.regexp_replace(t, TAG_PATTERN, ""))


def dedupe_ws(col: Column | str) -> Column:
    """T5: a whitespace run becomes its first character; ends are stripped."""
    t = F.regexp_replace(_c(col), f"({WS}){WS}*", "$1")
    return F.regexp_replace(t, f"^{WS}+|{WS}+\\z", "")


def platform_clean(col: Column | str, whitespace: bool = True) -> Column:
    """T5: Markdown links, URLs, e-mails, mentions, tags, whitespace runs (unless they are left to a later step)."""
    t = remove_tags(remove_mentions(remove_emails(remove_urls(remove_markdown_links(col)))))
    return dedupe_ws(t) if whitespace else t


def _emoji_alternation(names: dict[str, str]) -> str:
    import re as _re
    keys = sorted(names, key=len, reverse=True)
    return "(" + "|".join(_re.escape(k).replace("\\‍", "‍") for k in keys) + ")"


def demojize(col: Column | str, names: dict[str, str] | None = None) -> Column:
    """Emoji -> `:name:`, longest sequence first.

    The text is cut into table sequences, runs of characters that begin none,
    and single characters; each token is looked up in a literal map that
    Catalyst folds to a constant, other tokens stay.
    """
    names = DEFAULT_EMOJI_NAMES if names is None else names  # a table of any size: lexicon.demojize_table
    if not names:
        return _c(col)
    first = "".join(sorted({k[0] for k in names}))
    token = f"(?s){_emoji_alternation(names)}|[^{first}]+|."
    lookup = F.create_map(*[x for k, v in names.items() for x in (F.lit(k), F.lit(f":{v}:"))])

    def rewrite(t: Column) -> Column:
        pieces = F.regexp_extract_all(t, F.lit(token), 0)
        return F.array_join(F.transform(pieces, lambda s: F.coalesce(F.try_element_at(lookup, s), s)), "")
    return _where(col, lambda t: t.rlike(f"[{first}]"), rewrite)


def remove_forward(col: Column | str) -> Column:
    """Drop `转发微博` and the lazy `回复@...:` prefix."""
    return _where(col, _holding("转发微博", "回复@"), lambda t: F.regexp_replace(t, FORWARD_PATTERN, ""))


def halfwidth_punct(col: Column | str, strict_compat: bool = False) -> Column:
    """Full-width -> half-width punctuation.

    ``strict_compat`` reproduces the reference's literal quirk where one map
    key became the 5-char string `: "'", ` mapped to a single quote.
    """
    if not strict_compat:
        return _where(col, lambda t: t.rlike(f"[{PUNCT_FULL}]"), lambda t: F.translate(t, PUNCT_FULL, PUNCT_HALF))
    t = F.translate(_c(col), PUNCT_FULL[:6], PUNCT_HALF[:6])
    t = F.replace(t, F.lit(': "\'", '), F.lit("'"))
    return F.translate(t, PUNCT_FULL[6:], PUNCT_HALF[6:])


def collapse_ws(col: Column | str) -> Column:
    """Whitespace runs (Python's notion) -> one space, then strip."""
    return F.trim(F.regexp_replace(_c(col), f"{WS}+", " "))


def clean_before_emoji(col: Column | str, strict_compat: bool = False) -> Column:
    """T1-T5. Whitespace runs are left to T9, which makes each of them one blank; a step in between
    that sees the difference (T7's reply rule ends at a line break) needs them shortened first."""
    t = dedupe_hashtags(remove_video(remove_links(fill_missing(col))))
    if strict_compat:
        return platform_clean(t)
    return _where(platform_clean(t, whitespace=False), _holding("回复@"), dedupe_ws)


def clean_after_emoji(col: Column | str, strict_compat: bool = False) -> Column:
    """T7-T9."""
    return collapse_ws(halfwidth_punct(remove_forward(col), strict_compat))


def clean_text(col: Column | str, emoji_names: dict[str, str] | None = None,
               strict_compat: bool = False) -> Column:
    """T1-T9 in the reference order (T10 = use it in a projection)."""
    return clean_after_emoji(demojize(clean_before_emoji(col, strict_compat), emoji_names), strict_compat)


def is_valid(col: Column | str) -> Column:
    """non-blank text (``text.strip() != ''``): one non-whitespace
    character exists; the regex search stops at the first one."""
    return F.coalesce(_c(col).rlike(NON_WS), F.lit(False))


def truncate_len(col: Column | str, n: int | None) -> Column:
    """P6 helper: first ``n`` code points (no-op when ``n`` is None)."""
    return _c(col) if n is None else F.substring(_c(col), 1, n)


def char_length(col: Column | str) -> Column:
    """Length in code points."""
    return F.length(_c(col))


def token_count(col: Column | str, segmenter: Callable[[Column], Column] | None = None) -> Column:
    """Number of tokens: those of ``segmenter`` (text -> ARRAY<STRING>, blank tokens not
    counted; see ``operators.lexicon.dictionary_segmenter``), else the non-empty pieces between
    whitespace runs.
    """
    if segmenter is not None:
        return F.size(F.filter(segmenter(_c(col)), is_valid))
    single = F.trim(F.regexp_replace(_c(col), f"{WS}+", " "))
    return _bound(single, lambda t: F.when(t == "", F.lit(0)).otherwise(F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit(""))) + 1))
