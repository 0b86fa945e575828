"""Operator 1: format-preserving Feistel pseudonyms, in SQL functions alone.

One expression finds the candidates in a text; each is validated by its own rule
(Luhn, mod 97, ranges of octets, calendar, numbering plan) and, if valid, permuted
by a keyed Feistel network over exactly its format's valid values. A permutation
maps equal values to equal pseudonyms and different ones to different pseudonyms,
so values stay linked across documents, and a pseudonym is valid in its turn.

kind     valid if                              permuted within
card     13-19 digits, Luhn holds              all but first and check digit; check digit anew
led      4-4-4-4 or 4-6-5 digits ahead of      likewise; the digits behind stay
         others, and Luhn holds for them alone
iban     check digits 02-98, mod 97 is 1       the digits of the account part; check digits anew
ssn      area, group and serial are assigned   all assigned numbers
phone    NANP, or + and 7-15 digits that       valid NANP numbers, or the digits behind the country code
         aren't a +1 number
ipv4     four octets up to 255                 all addresses
ipv6     eight groups, or up to seven and ::   the hexadecimal digits in place
date     a day of 1800-2199                    all those days (400 Gregorian years: 189 * 773 days)
         d/m/y that can't be m/d/y             those after the 12th of a month (9 * 9833 days)
email    an address                            letters and digits of the part ahead of the @, in place

Separators, brackets and the length of digit groups stay, but for IPv4 octets.
Anything invalid stays as it is. A slash date is m/d/y where it can be, so that both readings
keep to strings of their own.

Contract: doc_id, text, n_replaced for every row.

* null text: null and 0; empty text: empty and 0. Very long texts are scanned whole.
* ties: equal values anywhere get equal pseudonyms; repeated rows are returned each.
* empty table: empty result. Other columns are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import unused

ROUNDS = 8
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "ipv6": r"(?<![\p{L}\p{N}:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\p{L}\p{N}:])(?!\.[0-9])",
    "ipv4": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9])(?!\.[0-9])",
    "iso": r"(?<![0-9-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9-])",
    "dmy": r"(?<![0-9./])[0-9]{1,2}([/.])[0-9]{1,2}\1[0-9]{4}(?![0-9])(?![./][0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![0-9+])\+[0-9]{7,15}(?![0-9])|(?<![0-9+])\+[1-9][0-9]{0,2}(?:[ .-]?\([0-9]{1,4}\))?(?:[ .-]?[0-9]{1,12}){1,7}(?![0-9])",
    "card": r"(?<![\p{L}\p{N}])[0-9](?:[ -]?[0-9]){12,18}(?![\p{L}\p{N}])",
}
CANDIDATE = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Texts without these hold no candidate.
HINT = "[0-9@]"


def _text(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _prf(key: str, tag: str, i: str, x: str) -> str:
    return f"cast(conv(substr(sha2(concat({_text(key + '|' + tag + '|')}, {i}, '|', {x}), 256), 1, 15), 16, 10) AS bigint)"


def _feistel(key: str, tag: str, left: str, a: str, right: str, b: str) -> str:
    """SQL struct (l, r): the network over 0 .. a-1 and 0 .. b-1, by alternate modular additions."""
    return (
        f"aggregate(sequence(0, {ROUNDS - 1}), named_struct('l', cast({left} AS bigint), 'r', cast({right} AS bigint)), (s, i) -> "
        f"if(i % 2 = 0, named_struct('l', (s.l + {_prf(key, tag, 'i', 's.r')}) % cast({a} AS bigint), 'r', s.r), "
        f"named_struct('l', s.l, 'r', (s.r + {_prf(key, tag, 'i', 's.l')}) % cast({b} AS bigint))))"
    )


def _let(value: str, name: str, body: str) -> str:
    """body with name bound to value, evaluated once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _power(n: str) -> str:
    return f"cast(rpad('1', cast({n} AS int) + 1, '0') AS bigint)"


def _digits(key: str, tag: str, d: str) -> str:
    """The digits d (1 to 36 of them) permuted among digits of that length."""
    u = f"(length({d}) DIV 2)"
    half = f"if({u} = 0, '0', substr({d}, 1, cast({u} AS int)))"
    body = f"concat(if({u} = 0, '', lpad(cast(f.l AS string), cast({u} AS int), '0')), lpad(cast(f.r AS string), cast(length({d}) - {u} AS int), '0'))"
    return _let(_feistel(key, tag, half, _power(u), f"substr({d}, cast({u} AS int) + 1)", _power(f"length({d}) - {u}")), "f", body)


def _refill(shape: str, digits: str) -> str:
    """shape with its digits replaced by those given, in order."""
    return (
        f"aggregate(regexp_extract_all({shape}, '(?s).', 0), named_struct('o', '', 'k', 1), (z, c) -> if(c BETWEEN '0' AND '9', "
        f"named_struct('o', concat(z.o, substr({digits}, z.k, 1)), 'k', z.k + 1), named_struct('o', concat(z.o, c), 'k', z.k))).o"
    )


def _only(x: str, what: str = "0-9") -> str:
    return f"regexp_replace({x}, '[^{what}]', '')"


def _mod97(x: str) -> str:
    """Of an IBAN without spaces whose first four signs have moved to the end."""
    return f"aggregate(regexp_extract_all({x}, '.', 0), 0, (z, c) -> if(c BETWEEN '0' AND '9', z * 10 + ascii(c) - 48, z * 100 + ascii(c) - 55) % 97)"


def _kind(m: str) -> str:
    """SQL: which kind of valid value a candidate is, or null."""
    d = _only(m)
    full = lambda k: f"{m} RLIKE {_text('^(?:' + PATTERNS[k] + ')$')}"
    nanp = f"{d} RLIKE '^1?[2-9][0-9]{{2}}[2-9][0-9]{{6}}$' AND ({m} NOT LIKE '+%' OR {d} RLIKE '^1[0-9]{{10}}$')"
    day = lambda y, mo, da: f"coalesce(try_cast(concat_ws('-', {y}, lpad({mo}, 2, '0'), lpad({da}, 2, '0')) AS date) BETWEEN DATE'1800-01-01' AND DATE'2199-12-31', false)"
    p = lambda k: f"split({m}, '[./]')[{k}]"
    bare = f"replace({m}, ' ', '')"
    groups = f"size(filter(split({m}, ':'), g -> g != ''))"
    lead = _lead(m)
    return (
        f"CASE WHEN {full('email')} THEN 'email' "
        f"WHEN {full('ipv6')} THEN if({m} RLIKE '[0-9]' AND ({m} NOT LIKE '%::%' OR {groups} < 8), 'ipv6', NULL) "
        f"WHEN {full('iban')} THEN if(length({bare}) BETWEEN 15 AND 34 AND substr({bare}, 3, 2) BETWEEN '02' AND '98' AND {_mod97(f'concat(substr({bare}, 5), substr({bare}, 1, 4))')} = 1, 'iban', NULL) "
        f"WHEN {full('ipv4')} THEN if(forall(split({m}, '[.]'), o -> cast(o AS int) < 256), 'ipv4', NULL) "
        f"WHEN {full('iso')} THEN if({day(f'substr({m}, 1, 4)', f'substr({m}, 6, 2)', f'substr({m}, 9, 2)')}, 'iso', NULL) "
        f"WHEN {full('dmy')} THEN CASE WHEN {m} LIKE '%/%' AND {day(p(2), p(0), p(1))} THEN 'mdy' WHEN {day(p(2), p(1), p(0))} THEN 'dmy' END "
        f"WHEN {full('ssn')} THEN if({m} RLIKE '^(?!000|666|9)[0-9]{{3}}-(?!00)[0-9]{{2}}-(?!0000)[0-9]{{4}}$', 'ssn', NULL) "
        f"WHEN {full('phone')} THEN CASE WHEN {nanp} THEN 'nanp' WHEN {m} LIKE '+%' AND length({d}) BETWEEN 7 AND 15 AND {d} NOT RLIKE '^1[0-9]{{10}}$' THEN 'phone' END "
        f"WHEN length({d}) BETWEEN 13 AND 19 AND luhn_check({d}) THEN 'card' "
        f"WHEN {lead} != '' AND luhn_check({_only(lead)}) THEN 'led' END"
    )


def _lead(m: str) -> str:
    """SQL: a card in its usual groups ahead of other digits, or nothing."""
    return f"regexp_extract({m}, '^([0-9]{{4}}([ -])(?:[0-9]{{4}}\\\\2[0-9]{{4}}\\\\2[0-9]{{4}}|[0-9]{{6}}\\\\2[0-9]{{5}}))[ -]', 1)"


def _hex(key: str, m: str) -> str:
    """Hexadecimal digits shift by what the other half of them gives; upper case if any of them is."""
    d = f"lower(regexp_replace({m}, ':', ''))"
    shift = lambda s, h: (
        f"array_join(transform(regexp_extract_all({s}, '.', 0), (c, j) -> substr('0123456789abcdef', 1 + "
        f"(instr('0123456789abcdef', c) - 1 + cast(conv(substr({h}, 1 + j, 1), 16, 10) AS int)) % 16, 1)), '')"
    )
    hash_ = lambda x: f"sha2(concat({_text(key + '|ipv6|')}, i, '|', {x}), 256)"
    h = "cast(length(q) DIV 2 AS int)"
    both = (
        f"aggregate(sequence(0, {ROUNDS - 1}), named_struct('l', substr(q, 1, {h}), 'r', substr(q, {h} + 1)), (s, i) -> "
        f"if(i % 2 = 0, named_struct('l', s.l, 'r', {_let(hash_('s.l'), 'x', shift('s.r', 'x'))}), named_struct('l', {_let(hash_('s.r'), 'x', shift('s.l', 'x'))}, 'r', s.r)), "
        f"s -> concat(s.l, s.r))"
    )
    laid = (
        f"aggregate(regexp_extract_all({m}, '.', 0), named_struct('o', '', 'k', 1), (z, c) -> if(c = ':', "
        f"named_struct('o', concat(z.o, c), 'k', z.k), named_struct('o', concat(z.o, substr(w, z.k, 1)), 'k', z.k + 1))).o"
    )
    return f"if({m} RLIKE '[A-F]', upper({_let(d, 'q', _let(both, 'w', laid))}), {_let(d, 'q', _let(both, 'w', laid))})"


def _email(key: str, m: str) -> str:
    """Letters and digits ahead of the @ shift within their alphabets by what the other half gives."""
    shift = lambda s, h: (
        f"array_join(transform(regexp_extract_all({s}, '(?s).', 0), (c, j) -> "
        + _let(
            f"cast(conv(substr({h}, 1 + (j * 2) % 62, 2), 16, 10) AS int)",
            "n",
            "CASE WHEN c BETWEEN 'a' AND 'z' THEN chr(97 + (ascii(c) - 97 + n) % 26) WHEN c BETWEEN 'A' AND 'Z' THEN chr(65 + (ascii(c) - 65 + n) % 26) WHEN c BETWEEN '0' AND '9' THEN chr(48 + (ascii(c) - 48 + n) % 10) ELSE c END",
        )
        + "), '')"
    )
    hash_ = lambda x: f"sha2(concat({_text(key + '|email|')}, i, '|', {x}), 256)"
    local, h = f"split({m}, '@')[0]", f"cast(length(split({m}, '@')[0]) DIV 2 AS int)"
    return (
        f"concat(aggregate(sequence(0, {ROUNDS - 1}), named_struct('l', substr({local}, 1, {h}), 'r', substr({local}, {h} + 1)), (s, i) -> "
        f"if(i % 2 = 0, named_struct('l', s.l, 'r', {_let(hash_('s.l'), 'x', shift('s.r', 'x'))}), named_struct('l', {_let(hash_('s.r'), 'x', shift('s.l', 'x'))}, 'r', s.r)), "
        f"s -> concat(s.l, s.r)), substr({m}, instr({m}, '@')))"
    )


def _pseudonym(key: str, kind: str, m: str) -> str:
    """SQL: the pseudonym of a valid value."""
    d = _only(m)
    luhn = "pmod(-aggregate(reverse(regexp_extract_all(concat(b, '0'), '.', 0)), named_struct('t', 0, 'k', 0), (z, c) -> named_struct('t', z.t + if(z.k % 2 = 0, int(c), int(c) * 2 - if(int(c) > 4, 9, 0)), 'k', z.k + 1)).t, 10)"
    card_of = lambda m, d: _let(f"concat(substr({d}, 1, 1), {_let(f'substr({d}, 2, length({d}) - 2)', 'q', _digits(key, 'card', 'q'))})", "b", _refill(m, f"concat(b, cast({luhn} AS string))"))
    card = card_of(m, d)
    # a card ahead of other digits walks on while they are a card together
    lead, behind = _lead(m), f"substr({m}, length({_lead(m)}) + 1)"
    led = f"concat(aggregate(sequence(0, 31), {lead}, (u, y) -> if(y = 0 OR luhn_check({_only(f'concat(u, {behind})')}), {card_of('u', _only('u'))}, u)), {behind})"
    bare = f"replace({m}, ' ', '')"
    account = _let(_only(f"substr({bare}, 5)"), "q", f"if(q = '', q, {_digits(key, 'iban', 'q')})")
    tail = _let(account, "g", _refill(f"substr({bare}, 5)", "g"))
    anew = f"lpad(cast(98 - {_mod97(f'concat(t, substr({bare}, 1, 2), chr(48), chr(48))')} AS string), 2, '0')"
    spaced = f"aggregate(regexp_extract_all({m}, '.', 0), named_struct('o', '', 'k', 1), (z, c) -> if(c = ' ', named_struct('o', concat(z.o, c), 'k', z.k), named_struct('o', concat(z.o, substr(w, z.k, 1)), 'k', z.k + 1))).o"
    iban = _let(tail, "t", _let(f"concat(substr({bare}, 1, 2), {anew}, t)", "w", spaced))
    octet = lambda k: f"cast(split({m}, '[.]')[{k}] AS bigint)"
    ipv4 = _let(_feistel(key, "ipv4", f"{octet(0)} * 256 + {octet(1)}", "65536", f"{octet(2)} * 256 + {octet(3)}", "65536"), "f", "concat_ws('.', f.l DIV 256, f.l % 256, f.r DIV 256, f.r % 256)")
    day = lambda t: _let(
        f"cast(datediff({t}, DATE'1800-01-01') AS bigint)", "n", _let(_feistel(key, "date", "n DIV 773", "189", "n % 773", "773"), "f", "date_add(DATE'1800-01-01', cast(f.l * 773 + f.r AS int))")
    )
    p = lambda k: f"split({m}, '[./]')[{k}]"
    made = lambda y, mo, da: f"try_cast(concat_ws('-', {y}, lpad({mo}, 2, '0'), lpad({da}, 2, '0')) AS date)"
    show = lambda pad, one: f"date_format(v, if(length({m}) = 10, '{pad}', '{one}'))"
    dot = f"if({m} LIKE '%.%', {show('dd.MM.yyyy', 'd.M.yyyy')}, {show('dd/MM/yyyy', 'd/M/yyyy')})"
    # an address without digits might be a word: it walks on
    ipv6 = f"aggregate(sequence(0, 31), {m}, (u, y) -> if(y = 0 OR u NOT RLIKE '[0-9]', {_hex(key, 'u')}, u))"
    # days after the 12th, numbered: those before month n of the 4800 are `start`
    base, start = "DATE'1800-01-01'", "(datediff(add_months(DATE'1800-01-01', n), DATE'1800-01-01') - 12 * n)"
    month = "((year(v) - 1800) * 12 + month(v) - 1)"
    guess = "cast(floor(t * 4800 / 88497) AS int)"
    later = lambda v: _let(
        v, "v", _let(
            _let(f"cast(datediff(v, {base}) - 12 * ({month} + 1) AS bigint)", "x", _feistel(key, "late", "x DIV 9833", "9", "x % 9833", "9833")), "f",
            _let("cast(f.l * 9833 + f.r AS int)", "t", _let(f"element_at(filter(sequence(greatest(0, {guess} - 1), {guess} + 1), n -> {start} <= t), -1)", "n", f"date_add(add_months({base}, n), t - {start} + 12)")),
        ),
    )
    area = f"cast(substr({d}, 1, 3) AS bigint)"
    ssn = _let(
        _feistel(key, "ssn", f"{area} - if({area} > 666, 2, 1)", "898", f"(cast(substr({d}, 4, 2) AS bigint) - 1) * 9999 + cast(substr({d}, 6) AS bigint) - 1", "989901"),
        "f",
        "concat_ws('-', lpad(cast(f.l + if(f.l >= 665, 2, 1) AS string), 3, '0'), lpad(cast(f.r DIV 9999 + 1 AS string), 2, '0'), lpad(cast(f.r % 9999 + 1 AS string), 4, '0'))",
    )
    nanp = _let(
        f"right({d}, 10)", "q",
        _let(
            _feistel(key, "nanp", "cast(substr(q, 1, 3) AS bigint) - 200", "800", "cast(substr(q, 4) AS bigint) - 2000000", "8000000"), "f",
            _refill(m, f"concat(substr({d}, 1, length({d}) - 10), cast(f.l + 200 AS string), cast(f.r + 2000000 AS string))"),
        ),
    )
    cc = f"if({m} RLIKE '^[+][0-9]{{1,3}}[^0-9]', length(regexp_extract({m}, '^[+]([0-9]{{1,3}})', 1)), 2)"
    phone = _let(f"substr({d}, {cc} + 1)", "q", _refill(m, f"concat(substr({d}, 1, {cc}), {_digits(key, 'phone', 'q')})"))
    return (
        f"CASE {kind} WHEN 'email' THEN {_email(key, m)} WHEN 'iban' THEN {iban} WHEN 'ipv4' THEN {ipv4} "
        f"WHEN 'iso' THEN {_let(day(made(f'substr({m}, 1, 4)', f'substr({m}, 6, 2)', f'substr({m}, 9, 2)')), 'v', 'cast(v AS string)')} "
        f"WHEN 'mdy' THEN {_let(day(made(p(2), p(0), p(1))), 'v', show('MM/dd/yyyy', 'M/d/yyyy'))} "
        f"WHEN 'dmy' THEN if({m} LIKE '%/%', {_let(later(made(p(2), p(1), p(0))), 'v', dot)}, {_let(day(made(p(2), p(1), p(0))), 'v', dot)}) "
        f"WHEN 'ssn' THEN {ssn} WHEN 'nanp' THEN {nanp} WHEN 'phone' THEN {phone} WHEN 'card' THEN {card} WHEN 'led' THEN {led} WHEN 'ipv6' THEN {ipv6} ELSE {m} END"
    )


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", count_col: str | None = "n_replaced") -> DataFrame:
    """docs with every valid value in its text replaced, and how many there were."""
    text = F.col(text_col)
    name = text_col.replace("`", "``")
    pattern = _text(CANDIDATE)
    valid = f"transform(regexp_extract_all(`{name}`, {pattern}, 0), m -> named_struct('m', m, 'kind', {_kind('m')}))"
    after = f"transform(v, x -> {_let('x.kind', 'kind', _let('x.m', 'm', _pseudonym(key, 'kind', 'm')))})"
    joined = f"array_join(flatten(zip_with(split(`{name}`, {pattern}, -1), {after}, (a, b) -> array(a, coalesce(b, '')))), '')"
    both = F.expr(_let(valid, "v", f"named_struct('t', {joined}, 'n', size(filter(v, x -> x.kind IS NOT NULL)))"))
    own = unused(docs, "_pii")
    out = docs.withColumn(own, F.when(text.rlike(HINT), both))
    out = out.withColumn(text_col, F.coalesce(F.col(f"{own}.t"), text))
    if count_col:
        out = out.withColumn(count_col, F.coalesce(F.col(f"{own}.n"), F.lit(0)).cast("long"))
    return out.drop(own)


#: The queries' key; a production run passes a secret of its own.
QUERY_KEY = "heddle-query-key"


def op1_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pseudonymise(docs, QUERY_KEY)
