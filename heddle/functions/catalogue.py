"""The declared functions of the query language, and its dialect's spellings."""

from __future__ import annotations

import re

NUMBER, ANY, TRUTH = "number", "any", "truth"
#: Name -> (arguments, result). Comparisons take two values of comparable types.
CATALOGUE: dict[str, tuple[tuple[str, ...], str]] = {
    **{f: ((NUMBER,), NUMBER) for f in ("SUM", "AVG", "MIN", "MAX")},
    **{f: ((ANY,), NUMBER) for f in ("COUNT", "COUNT_DISTINCT")},
    **{f: ((NUMBER, NUMBER), NUMBER) for f in ("PLUS", "MINUS", "MULTIPLY", "DIVIDE")},
    **{f: ((TRUTH, TRUTH), TRUTH) for f in ("AND", "OR")},
    **{f: ((ANY, ANY), TRUTH) for f in ("EQ", "NOT_EQ", "GTH", "LTH", "GEQ", "LEQ", "IS")},
}
_KINDS = {"INTEGER": "number", "DECIMAL": "number", "DATE": "text", "TEXT": "text"}


def comparable(a: str, b: str) -> bool:
    """Whether two declared types compare: numbers with numbers, dates with texts."""
    return _KINDS[a] == _KINDS[b]


_PARTS = re.compile(r"(?P<text>'(?:[^']|'')*'|\"[^\"]*\")|(?P<note>--[^\n]*|/\*.*?\*/)|(?P<unequal>\^=)|(?P<distinct>\bCOUNT_DISTINCT\s*\(\s*)", re.I | re.S)
_SPELT = {"note": " ", "unequal": "<>", "distinct": "COUNT(DISTINCT "}


_QUOTED = re.compile(r"'(?:[^']|'')*'|\"[^\"]*\"|`[^`]*`")
_TERM = r"(?:-?[\w.]*\([^()]*\)|-?[\w.]+|\x00\d+\x00)"
_OPERAND = rf"(?P<left>{_TERM}(?:\s*[-+*/%]\s*{_TERM})*)"
_QUANTIFIED = re.compile(rf"{_OPERAND}\s*(?P<op><>|!=|<=|>=|=|<|>)\s*(?P<how>ANY|SOME|ALL)\s*\((?=\s*SELECT\b)", re.I)
_IS = re.compile(rf"{_OPERAND}\s+IS\s+(?P<no>NOT\s+)?(?P<what>NAN|INFINITE)\b", re.I)


def _closing(text: str, at: int) -> int:
    """Place behind the parenthesis that closes one opened just before `at`."""
    depth = 1
    for k in range(at, len(text)):
        depth += (text[k] == "(") - (text[k] == ")")
        if not depth:
            return k + 1
    raise ValueError("a sub-query isn't closed")


def _compared(left: str, op: str, every: bool, query: str) -> str:
    """A comparison with any or all rows of a sub-query, from its extremes: no row meets each other row.

    Nulls and empty sub-queries count as in SQL.
    """
    if op == "=" and not every:
        return f"{left} IN ({query})"
    if op == "<>" and every:
        return f"{left} NOT IN ({query})"
    of = lambda what: f"(SELECT {what} FROM ({query}) AS t(v))"
    if op in ("=", "<>"):
        test = f"({left} {op} {of('MIN(v)')} {'AND' if every else 'OR'} {left} {op} {of('MAX(v)')})"
    else:
        test = f"({left} {op} {of('MAX(v)' if (op[0] == '>') == every else 'MIN(v)')})"
    sure = f"NOT {test} THEN FALSE" if every else f"{test} THEN TRUE"
    return f"(CASE WHEN {of('COUNT(*)')} = 0 THEN {str(every).upper()} WHEN {sure} WHEN {of('COUNT(*) > COUNT(v)')} THEN NULL ELSE {test} END)"


def _quantifiers(text: str) -> str:
    done = ""
    while m := _QUANTIFIED.search(text):
        end = _closing(text, m.end())
        op = "<>" if m["op"] == "!=" else m["op"]
        done += text[: m.start()] + _compared(m["left"], op, m["how"].upper() == "ALL", _quantifiers(text[m.end() : end - 1]))
        text = text[end:]
    return done + text


def _finite(m: re.Match) -> str:
    value = f"CAST({m['left']} AS DOUBLE)"
    test = f"isnan({value})" if m["what"].upper() == "NAN" else f"(abs({value}) = CAST('Infinity' AS DOUBLE))"
    return f"(NOT {test})" if m["no"] else test


def normalise(query: str) -> str:
    """A query in Spark's spelling; no comments; quoted text stays.

    ^= becomes <>, COUNT_DISTINCT(x) COUNT(DISTINCT x), IS [NOT] NAN and INFINITE tests,
    ANY, SOME and ALL with a sub-query (not a correlated one) IN or a comparison with its extremes.
    """
    plain = _PARTS.sub(lambda m: _SPELT.get(m.lastgroup, m[0]), query).strip().rstrip(";").strip()
    texts: list[str] = []
    masked = _QUOTED.sub(lambda m: texts.append(m[0]) or f"\x00{len(texts) - 1}\x00", plain)
    masked = _IS.sub(_finite, _quantifiers(masked))
    return re.sub(r"\x00(\d+)\x00", lambda m: texts[int(m[1])], masked)
