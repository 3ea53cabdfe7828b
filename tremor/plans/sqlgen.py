"""DuckDB SQL twins of the column functions, used to write the oracles.

Patterns, tokens and tables are written out here once more, not imported from
the functions under test, so a wrong value on one side does not pass.
"""

from __future__ import annotations


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


# pandas' default missing tokens, white space as Python's str.split() sees it.
NA_LIST = """('', '#N/A', '#N/A N/A', '#NA', '-1.#IND', '-1.#QNAN', '-NaN', '-nan', '1.#IND', '1.#QNAN', '<NA>', 'N/A', 'NA', 'NULL', 'NaN', 'None', 'n/a', 'nan', 'null')"""
SPACES = r"\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
WS = f"[{SPACES}]"


def na(col: str) -> str:
    return f"(CASE WHEN {col} IN {NA_LIST} THEN NULL ELSE {col} END)"


NUMBER = r"^[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|[iI][nN][fF]|[iI][nN][fF][iI][nN][iI][tT][yY]|[nN][aA][nN])$"
FULL_TIME = r"([0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}" + WS + r"+[0-9]{1,2}:[0-9]{1,2}(:[0-9]{1,2})?)"
SHORT_TIME = r"([0-9]{1,2}[-/][0-9]{1,2}" + WS + r"+[0-9]{1,2}:[0-9]{1,2}(:[0-9]{1,2})?)"


def to_number(col: str) -> str:
    s = f"trim({col}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
    v = f"TRY_CAST({s} AS DOUBLE)"
    return (f"(CASE WHEN regexp_matches({s}, {q(NUMBER)}) AND NOT isnan({v}) "
            f"THEN coalesce({v}, 0.0) ELSE 0.0 END)")


def normalize_time(col: str, year: int) -> str:
    full = f"nullif(regexp_extract({col}, {q(FULL_TIME)}, 1), '')"
    short = f"nullif(regexp_extract({col}, {q(SHORT_TIME)}, 1), '')"
    return f"coalesce(replace({full}, '/', '-'), '{year}-' || replace({short}, '/', '-'))"


def post_time(col: str, year: int) -> str:
    norm = f"regexp_replace({normalize_time(col, year)}, {q(WS + '+')}, ' ', 'g')"
    return f"try_strptime({norm}, ['%Y-%m-%d %H:%M:%S', '%Y-%m-%d %H:%M'])"


def is_valid(col: str) -> str:
    return f"coalesce(regexp_matches({col}, {q('[^' + SPACES + ']')}), false)"


def words(col: str) -> str:
    return f"len(list_filter(regexp_split_to_array({col}, {q(WS + '+')}), lambda x: x <> ''))"


# ----------------------------------------------------------------------------- text chain

def fill_missing(col: str) -> str:
    return f"coalesce(CAST({col} AS VARCHAR), '')"


def remove_links(col: str) -> str:
    return f"replace({col}, 'O网页链接', '')"


def remove_video(col: str) -> str:
    return f"regexp_replace({col}, {q('L([^' + chr(10) + ']+)的微博视频')}, '', 'g')"


def dedupe_hashtags(col: str) -> str:
    parts = f"string_split({col}, '#')"
    return (
        f"list_reduce(list_transform({parts}, lambda x, i: {{'p': x, 'i': i}}),"
        f" lambda acc, e: CASE WHEN e.i = 1 THEN acc"
        f" WHEN NOT acc.open THEN {{'out': acc.out || e.p, 'open': true, 'seen': acc.seen}}"
        f" WHEN e.p = '' OR e.i = len({parts}) THEN {{'out': acc.out || '#' || e.p, 'open': true, 'seen': acc.seen}}"
        f" WHEN list_contains(acc.seen, e.p) THEN {{'out': acc.out, 'open': false, 'seen': acc.seen}}"
        f" ELSE {{'out': acc.out || e.p || ' ', 'open': false, 'seen': list_append(acc.seen, e.p)}} END,"
        f" {{'out': {parts}[1], 'open': true, 'seen': []::VARCHAR[]}}).out"
    )


def remove_markdown_links(col: str) -> str:
    return f"regexp_replace({col}, {q(chr(92) + '[([^' + chr(92) + '[' + chr(92) + ']]+)' + chr(92) + ']' + chr(92) + '([^()' + SPACES + ']+' + chr(92) + ')')}, '\\1', 'g')"


def remove_urls(col: str) -> str:
    return f"regexp_replace({col}, '[hH][tT][tT][pP][sS]?://[A-Za-z0-9._~:/?#@!$&*+,;=%''-]+', '', 'g')"


def remove_emails(col: str) -> str:
    return f"regexp_replace({col}, '[A-Za-z0-9_.+-]+@([A-Za-z0-9-]+[.])+[A-Za-z][A-Za-z]+', '', 'g')"


def remove_mentions(col: str) -> str:
    return f"regexp_replace({col}, {q('(回复)?(//)?@[^@:：' + SPACES + ']+[:：]?')}, ' ', 'g')"


def remove_tags(col: str) -> str:
    return f"regexp_replace({col}, '<[A-Za-z/!][^<>]*>', '', 'g')"


def dedupe_ws(col: str) -> str:
    t = f"regexp_replace({col}, {q('(' + WS + ')' + WS + '*')}, '\\1', 'g')"
    return f"regexp_replace({t}, {q('^' + WS + '+|' + WS + '+' + chr(92) + 'z')}, '', 'g')"


def platform_clean(col: str) -> str:
    return dedupe_ws(remove_tags(remove_mentions(remove_emails(remove_urls(remove_markdown_links(col))))))


# Emoji names, longest sequences first.
EMOJI = [("👨‍👩‍👧", "家庭: 男人女人女孩"), ("❤️", "红心"), ("❤", "红心"), ("😂", "笑哭了"), ("👍", "拇指向上"), ("🙏", "双手合十"),
         ("😭", "放声大哭"), ("😡", "怒火中烧"), ("🔥", "火焰")]


def demojize(col: str) -> str:
    for sequence, name in EMOJI:
        col = f"replace({col}, {q(sequence)}, {q(':' + name + ':')})"
    return col


def remove_forward(col: str) -> str:
    return f"regexp_replace({col}, {q('转发微博|回复@[^' + chr(10) + ']*?:')}, '', 'g')"


def halfwidth_punct(col: str) -> str:
    return f"translate({col}, '，。！？；：（）【】、《》', ',.!?;:()[],<>')"


def collapse_ws(col: str) -> str:
    return f"trim(regexp_replace({col}, {q(WS + '+')}, ' ', 'g'), ' ')"


def clean_text(col: str) -> str:
    t = fill_missing(col)
    for f in (remove_links, remove_video, dedupe_hashtags, platform_clean, demojize, remove_forward,
              halfwidth_punct, collapse_ws):
        t = f(t)
    return t


def severity_level(col: str) -> str:
    return f"CAST(CASE {col} WHEN '轻微' THEN 0 WHEN '一般' THEN 1 WHEN '中等' THEN 1 WHEN '严重' THEN 2 END AS INTEGER)"


def level_label(col: str) -> str:
    return f"(CASE {col} WHEN 0 THEN '轻微' WHEN 1 THEN '中等' WHEN 2 THEN '严重' END)"


def uniform(seed: int, *parts: str) -> str:
    key = "concat_ws(':', " + ", ".join([q(str(seed))] + [f"CAST({p} AS VARCHAR)" for p in parts]) + ")"
    return f"(CAST(('0x' || substr(md5({key}), 1, 13)) AS BIGINT) / {float(16 ** 13)})"


def log_softmax_list(col: str) -> str:
    m = f"list_max({col})"
    lse = f"ln(list_sum(list_transform({col}, lambda x: exp(x - {m}))))"
    return f"list_transform({col}, lambda x: x - {m} - {lse})"
