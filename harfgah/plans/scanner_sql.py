"""The scanner in DuckDB SQL, written for RE2, which knows neither look-ahead nor the emoji properties.

Two marks are set before the scan. 1 stands where a run of capitals (and digits) has to stop before its last character,
as a small letter follows; 2 before two capitals with a small letter behind, which are no run of capitals at all. All
other patterns let the marks pass, and they are taken out of the tokens.
"""

from __future__ import annotations

from functools import cache

import regex

M = r"\x01\x02"
#: A letter or digit run of a name, marks let through.
L = rf"[{M}]?[A-Za-z](?:[{M}]?[A-Za-z])*"
BLANK = r"\t\n\v\f\r \x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
URL_CHAR = rf"[^{BLANK}<>()\[\]{{}}\"']"


@cache
def emoji() -> tuple[str, str]:
    """Ranges of pictographs, and of what else is shown as an emoji, from the properties themselves."""

    def ranges(prop: str) -> str:
        p, out, last = regex.compile(rf"\p{{{prop}}}"), [], -2
        for c in [*range(0xA0, 0x3400), *range(0x1F000, 0x20000)]:
            if p.match(chr(c)):
                if c == last + 1:
                    out[-1][1] = c
                else:
                    out.append([c, c])
                last = c
        return "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in out)

    return ranges("Extended_Pictographic"), ranges("Emoji_Presentation")


@cache
def patterns() -> list[tuple[str, str]]:
    pictograph, shown = emoji()
    return [
        ("code", "`[^`]*`"),
        ("url", rf"[{M}]?[A-Za-z][A-Za-z0-9+.{M}-]*://{URL_CHAR}+|[{M}]?[Ww][Ww][Ww]\.{URL_CHAR}+"),
        ("url", rf"[{M}]?[A-Za-z0-9](?:[A-Za-z0-9{M}-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9{M}-]+)*\.[{M}]?(?i:com|org|net|io|dev|ir|co|app|ai|me|sh|xyz|edu|gov)(?:/{URL_CHAR}*)?"),
        ("email", rf"[A-Za-z0-9._%+{M}-]+@[A-Za-z0-9.{M}-]+\.[A-Za-z{M}]{{2,}}"),
        ("mention", rf"@[A-Za-z0-9_.{M}]{{1,40}}"),
        ("hashtag", rf"#[\p{{L}}\p{{N}}_{M}]{{1,60}}"),
        ("number", rf"[{M}]?[+-]?[0-9][0-9,._:/-]*[0-9]%?|[{M}]?[+-]?[0-9]%?"),
        ("identifier", rf"[{M}]?[A-Za-z][A-Za-z0-9{M}]*(?:_[A-Za-z0-9{M}]+)+|[{M}]?[a-z]+[{M}]?[A-Z][A-Za-z0-9{M}]*|[A-Z][A-Z]+[0-9]*|{L}[0-9]+[A-Za-z0-9{M}]*"),
        ("emoji", rf"[{pictograph}{shown}](?:\x{{fe0f}}|\x{{200d}}[{pictograph}]|[\x{{1f3fb}}-\x{{1f3ff}}])*"),
        ("other-script", r"[^\p{Latin}\p{P}\p{Z}\p{N}\p{C}]+"),
        ("word", rf"{L}(?:['’]{L})*"),
        ("space", f"[{BLANK}]+"),
        ("punct", r"[\p{P}\p{S}]+"),
    ]


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def marked(x: str) -> str:
    runs = rf"regexp_replace({x}, '([A-Z][A-Z]+[0-9]*)([A-Z0-9][a-z])', '\1' || chr(1) || '\2', 'g')"
    return rf"regexp_replace({runs}, '(^|[^A-Z])([A-Z][A-Z][a-z])', '\1' || chr(2) || '\2', 'g')"


def kinds_sql(t: str) -> str:
    return "case " + " ".join(f"when regexp_full_match({t}, {_quoted(p)}) then {_quoted(k)}" for k, p in patterns()) + " else 'punct' end"


def token_list(x: str) -> str:
    scan = _quoted("|".join(p for _, p in patterns()) + "|(?s:.)")
    return f"list_filter(list_transform(regexp_extract_all({marked(x)}, {scan}, 0), lambda t: translate(t, chr(1) || chr(2), '')), lambda t: t <> '')"


def tokens_sql(source: str, key: str, text: str) -> str:
    """key, pos, tok, kind, start of every token."""
    return f"""(select {key}, pos, tok, {kinds_sql('tok')} as kind, coalesce(sum(length(tok)) over (partition by {key} order by pos rows between unbounded preceding and 1 preceding), 0)::bigint as start
 from (select {key}, unnest(l) as tok, unnest(range(len(l)))::bigint as pos from (select {key}, {token_list(text)} as l from {source})))"""
