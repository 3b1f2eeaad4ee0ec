"""Format-preserving pseudonyms for personal data, in SQL functions only.

One pass marks the matches of one pattern in a text, which is cut at the marks.
Each match is validated (date exists, check digits hold, octets fit, and so on)
and replaced by a pseudonym of its format:

- numbers (accounts and cards, phones, social security numbers, IP addresses,
  IBANs) and dates go through a keyed Feistel network over exactly the values
  of their format: two halves a and b are added to keyed hashes of each other,
  modulo the halves' ranges, so the map is a permutation and needs no cycle
  walking. Check digits are made to hold again, separators stay in place, and
  the value is taken without its separators, so that equal values written
  differently stay linked.
- e-mail addresses and secrets, whose formats are open, get a keyed hash in the
  same alphabet.

An account or card is 12 to 19 digits whose Luhn check digit holds; order numbers
and time stamps without it stay. IBANs and accounts written in groups are found first,
apart from the other formats: of the strings that start where one may, the one of its
country's length, or else the longest, whose check holds. Only these are the IBANs and
spaced accounts of the row's pattern, so a string that merely looks like one is left to
the other formats.

A date is written year first, day first, or month first where day first does not
exist. Days 1 to 12 of the months of 1800 to 2199 permute among themselves (400 * 144),
and so do the later ones (9 * 9,833): the written order that a date needs to be read
stays the same, so in no format two days share a pseudonym, and all formats agree.

A match that fails its validation stays as it is. The key reaches executors as a literal of
the plan: keep event logs as safe as the key.

Defined results: a null text stays null and an empty one empty, with no matches;
repeated rows get the same pseudonyms; other columns are kept as they are, whatever their names.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
KINDS = ("email", "secret", "iban", "date", "ip", "ssn", "phone", "account")

_OPEN, _CLOSE = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: All matches start after something else than a letter or digit, which is tested once.
_BEFORE_IBAN = (
    r"(?<![._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)*\.\p{L}{2,}+",
    r"[0-9a-fA-F]{32,128}+" + _CLOSE,
    r"(?=[A-Za-z0-9+/_-]{16})(?<=(?i:token|secret|passwd|password|api[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?)[A-Za-z0-9+/_-]{16,}+",
)
_AFTER_IBAN = (
    r"(?:\d{4}[-/.]\d{2}[-/.]\d{2}|\d{1,2}[-/.]\d{1,2}[-/.]\d{4})" + _CLOSE,
    r"(?<!\d\.)" + rf"{_OCTET}(?:\.{_OCTET}){{3}}" + r"(?![\p{L}\p{N}]|\.\d)",
    r"\d{3}-\d{2}-\d{4}" + _CLOSE,
    r"\+1[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}" + _CLOSE,
    r"\+(?!1[ .(-])\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,3}" + _CLOSE,
    r"(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}" + _CLOSE,
    r"\d{12,19}" + _CLOSE,
)
PATTERN = _OPEN + "(?:" + "|".join(_BEFORE_IBAN + _AFTER_IBAN) + ")"
#: The same with a row's IBANs and spaced accounts between these two.
_HEAD = _OPEN + "(?:" + "|".join(_BEFORE_IBAN) + "|(?=[A-Z0-9]{4})(?:"
_TAIL = ")" + _CLOSE + "|" + "|".join(_AFTER_IBAN) + ")"

#: Marks in a text: a lone first one is escaped, so the pair of the second line stands at matches only.
_MARK, _ESCAPED, _EDGE = "\x01", "\x01\x02", "\x01\x03"

_IBAN = r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?"
#: The longest string of an IBAN's shape from each place where one may start; they may overlap.
_MAYBE_IBAN = r"(?=[A-Z]{2}[0-9])" + _OPEN + rf"(?=({_IBAN}){_CLOSE})[A-Z]{{2}}"
_ACCOUNT = r"\d{4}(?:[ -]\d{4}){2,3}(?:[ -]\d{1,3})?"
_MAYBE_ACCOUNT = r"(?=\d{4}[ -]\d)" + _OPEN + rf"(?=({_ACCOUNT}){_CLOSE})\d{{4}}"
#: The lengths of IBANs by country.
_LENGTHS = (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HN28 HR21 "
    "HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 "
    "RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30"
)


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(name: str, value: str, body: str) -> str:
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


class _Keyed:
    """SQL for keyed functions; the key is stretched to two block-long parts."""

    def __init__(self, key: str):
        self.inner, self.outer = (hashlib.sha256(f"{side}:{key}".encode()).hexdigest() for side in ("inner", "outer"))

    def hex(self, message: str) -> str:
        return f"sha2(concat('{self.outer}', sha2(concat('{self.inner}', {message}), 256)), 256)"

    def number(self, message: str) -> str:
        return f"CAST(conv(substr({self.hex(message)}, 1, 15), 16, 10) AS BIGINT)"

    def feistel(self, tweak: str, left: str, right: str, a: str, b: str) -> str:
        """A struct (l, r): the permutation of (left, right) in range(a) x range(b)."""
        f = lambda x: self.number(f"concat({tweak}, '|', i, '|', {x})")
        return (
            f"aggregate(sequence(1, {ROUNDS}), named_struct('l', CAST({left} AS BIGINT), 'r', CAST({right} AS BIGINT)), (s, i) -> "
            f"IF(i % 2 = 1, named_struct('l', (s.l + {f('s.r')} % {a}) % {a}, 'r', s.r), named_struct('l', s.l, 'r', (s.r + {f('s.l')} % {b}) % {b})))"
        )

    def digits(self, kind: str, d: str) -> str:
        """A permutation of the digit strings of d's length (one digit stays)."""
        ten = lambda n: f"CAST(rpad('1', {n} + 1, '0') AS BIGINT)"
        h, rest = f"(length({d}) DIV 2)", f"(length({d}) - length({d}) DIV 2)"
        mixed = self.feistel(f"concat('{kind}:', length({d}))", f"substr({d}, 1, {h})", f"substr({d}, {h} + 1)", ten(h), ten(rest))
        return f"IF(length({d}) < 2, {d}, {_let('f', mixed, f'concat(lpad(CAST(f.l AS STRING), {h}, "0"), lpad(CAST(f.r AS STRING), {rest}, "0"))')})"


def _only_digits(m: str) -> str:
    return f"regexp_replace({m}, '[^0-9]', '')"


def _refill(m: str, d: str) -> str:
    """m with its digits replaced, in order, by those of d."""
    return (
        f"array_join(transform(sequence(1, length({m})), j -> IF(substr({m}, j, 1) BETWEEN '0' AND '9', "
        f"substr({d}, length({_only_digits(f'substr({m}, 1, j)')}), 1), substr({m}, j, 1))), '')"
    )


def _luhn(d: str) -> str:
    """The Luhn check digit that belongs after the digits d."""
    total = (
        f"aggregate(sequence(1, length({d})), 0, (t, j) -> t + {_let('x', f'CAST(substr(reverse({d}), j, 1) AS INT) * (1 + j % 2)', 'CAST(x DIV 10 + x % 10 AS INT)')})"
    )
    return f"((10 - {total} % 10) % 10)"


def _iban_rest(s: str) -> str:
    """The remainder modulo 97 of an IBAN's characters, letters as 10 to 35."""
    return (
        f"aggregate(sequence(1, length({s})), 0, (t, j) -> {_let('c', f'substr({s}, j, 1)', 'IF(c BETWEEN "0" AND "9", (t * 10 + CAST(c AS INT)) % 97, (t * 100 + ascii(c) - 55) % 97)')})"
    )


def _iban_holds(m: str) -> str:
    squeezed = f"replace({m}, ' ', '')"
    return f"(length({squeezed}) BETWEEN 15 AND 34 AND {_iban_rest(f'concat(substr({squeezed}, 5), substr({squeezed}, 1, 4))')} = 1)"


def _checked(text: str) -> str:
    """The distinct valid IBANs of a text (from each start that of its country's length, or else the longest) and its valid accounts in groups of digits (the longest)."""
    here = f"substr(w, n + 1, 1) IN ('', ' ') AND substr(w, 1, n) RLIKE {_text(f'^{_IBAN}$')} AND {_iban_holds('substr(w, 1, n)')}"
    known = f"contains('{_LENGTHS}', concat(substr(w, 1, 2), length(replace(substr(w, 1, n), ' ', ''))))"
    tried = f"transform(filter(sequence(15, greatest(15, length(w))), n -> {here}), n -> named_struct('known', {known}, 'n', n, 'm', substr(w, 1, n)))"
    ibans = f"transform(regexp_extract_all({text}, {_text(_MAYBE_IBAN)}, 1), w -> array_max({tried}).m)"
    holds = f"substr(w, n + 1, 1) IN ('', ' ', '-') AND substr(w, 1, n) RLIKE {_text(f'^{_ACCOUNT}$')} AND luhn_check({_only_digits('substr(w, 1, n)')})"
    accounts = f"transform(regexp_extract_all({text}, {_text(_MAYBE_ACCOUNT)}, 1), w -> substr(w, 1, array_max(filter(sequence(14, length(w)), n -> {holds}))))"
    return f"array_distinct(filter(concat({ibans}, {accounts}), p -> p IS NOT NULL))"


def _by_pattern(checked: str, use: str) -> str:
    """SQL with `{}` for the pattern of a row with these IBANs and accounts; the pattern of most rows, without any, is a literal."""
    longest_first = f"transform(array_sort(transform({checked}, p -> named_struct('n', -length(p), 'm', p))), p -> p.m)"
    own = f"concat({_text(_HEAD)}, array_join({longest_first}, '|'), {_text(_TAIL)})"
    return f"IF(size({checked}) <= 0, {use.replace('{}', _text(PATTERN))}, {use.replace('{}', own)})"


def _date(m: str) -> str:
    """The date that m writes, day first unless only month first exists; null if none."""
    parts = f"split({m}, '[-/.]')"
    part = lambda i, n: f"lpad(element_at({parts}, {i}), {n}, '0')"
    made = lambda y, mo, d: f"try_to_date(concat({part(y, 4)}, '-', {part(mo, 2)}, '-', {part(d, 2)}), 'yyyy-MM-dd')"
    return f"IF({m} RLIKE '^[0-9]{{4}}', {made(1, 2, 3)}, coalesce({made(3, 2, 1)}, {made(3, 1, 2)}))"


def _other_day(day: str, keyed: _Keyed) -> str:
    """A permutation of the days from 1800 to 2199 that keeps days 1 to 12 of months, and the later ones, among themselves."""
    first = "DATE'1800-01-01'"
    early = _let("f", keyed.feistel("'date'", f"year({day}) - 1800", f"month({day}) * 12 + day({day}) - 13", "400L", "144L"), "make_date(CAST(f.l AS INT) + 1800, CAST(f.r DIV 12 AS INT) + 1, CAST(f.r % 12 AS INT) + 1)")
    before = lambda month: f"datediff(add_months({first}, {month}), {first}) - 12 * {month}"  # noqa: E731  the later days of all months before
    number = f"datediff({day}, {first}) - 12 * (year({day}) * 12 + month({day}) - 21600)"
    month = _let("e", "CAST(q * 4800 DIV 88497 AS INT)", f"array_max(filter(sequence(greatest(e - 1, 0), least(e + 1, 4799)), k -> {before('k')} <= q))")
    mixed = _let("n", f"CAST({number} AS BIGINT)", _let("f", keyed.feistel("'late date'", "n DIV 9833", "n % 9833", "9L", "9833L"), "f.l * 9833 + f.r"))
    late = _let("q", mixed, _let("k", month, f"date_add(add_months({first}, k), CAST(q AS INT) - ({before('k')}) + 12)"))
    return f"IF(day({day}) <= 12, {early}, {late})"


def _kind(m: str) -> str:
    d = _only_digits(m)
    return f"""CASE
      WHEN contains({m}, '@') THEN 'email'
      WHEN {m} RLIKE '^[0-9a-fA-F]{{32,}}$' THEN 'secret'
      WHEN {m} RLIKE '^[A-Z]{{2}}[0-9]{{2}}[A-Z0-9 ]+$' AND {_iban_holds(m)} THEN 'iban'
      WHEN {m} RLIKE '^([0-9]{{4}}[-/.][0-9]{{2}}[-/.][0-9]{{2}}|[0-9]{{1,2}}[-/.][0-9]{{1,2}}[-/.][0-9]{{4}})$' THEN IF({_date(m)} BETWEEN DATE'1800-01-01' AND DATE'2199-12-31', 'date', NULL)
      WHEN {m} RLIKE '^[0-9]{{1,3}}([.][0-9]{{1,3}}){{3}}$' THEN 'ip'
      WHEN {m} RLIKE '^[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}$' THEN IF({m} RLIKE '^(000|666|9)' OR {m} RLIKE '-00-' OR {m} RLIKE '-0000$', NULL, 'ssn')
      WHEN {m} RLIKE '^[+(]' AND length({d}) BETWEEN 7 AND 15 THEN 'phone'
      WHEN {m} RLIKE '^[0-9]{{3}}[ .-][0-9]{{3}}[ .-][0-9]{{4}}$' THEN 'phone'
      WHEN {m} RLIKE '^[0-9 -]+$' AND length({d}) BETWEEN 12 AND 19 THEN IF(luhn_check({d}), 'account', NULL)
      WHEN NOT {m} RLIKE ' ' AND length({m}) >= 16 THEN 'secret'
    END"""


def _replacement(kind: str, m: str, keyed: _Keyed) -> str:
    """SQL for the pseudonym of match m of a kind."""
    account = _let("moved", keyed.digits("account", "substr(d, 1, length(d) - 1)"), f"concat(moved, CAST({_luhn('moved')} AS STRING))")
    fixed = f"IF({m} RLIKE '^[+]1[^0-9]' OR ({m} RLIKE '^[+]1' AND length(d) = 11), 1, IF({m} RLIKE '^[+]', coalesce(nullif(length(regexp_extract({m}, '^[+]([0-9]{{1,3}})[ .(-]', 1)), 0), 2), 0))"
    phone = _let("cc", fixed, f"concat(substr(d, 1, cc), {_let('own', 'substr(d, cc + 1)', keyed.digits('phone', 'own'))})")
    area = "CAST(substr(d, 1, 3) AS BIGINT)"
    ssn = _let("f", keyed.feistel("'ssn'", f"{area} - IF({area} > 666, 2, 1)", "(CAST(substr(d, 4, 2) AS BIGINT) - 1) * 9999 + CAST(substr(d, 6) AS BIGINT) - 1", "898L", "989901L"),
        "concat(lpad(CAST(f.l + IF(f.l >= 665, 2, 1) AS STRING), 3, '0'), lpad(CAST(f.r DIV 9999 + 1 AS STRING), 2, '0'), lpad(CAST(f.r % 9999 + 1 AS STRING), 4, '0'))")
    ip = _let("o", f"transform(split({m}, '[.]'), x -> CAST(x AS BIGINT))",
        _let("f", keyed.feistel("'ip'", "o[0] * 256 + o[1]", "o[2] * 256 + o[3]", "65536L", "65536L"), "concat_ws('.', f.l DIV 256, f.l % 256, f.r DIV 256, f.r % 256)"))
    second = f"regexp_extract({m}, '[-/.][0-9]+([-/.])', 1)"
    sep = f"regexp_extract({m}, '[-/.]', 0)"
    month_first = f"NOT ({m} RLIKE '^[0-9]{{4}}') AND CAST(element_at(split({m}, '[-/.]'), 2) AS INT) > 12"
    short = f"{m} RLIKE '^[0-9][-/.]|[-/.][0-9][-/.]'"
    two = lambda x: f"IF({short}, CAST({x} AS STRING), lpad(CAST({x} AS STRING), 2, '0'))"
    date = _let("p", _let("v", _date(m), _other_day("v", keyed)), f"CASE WHEN {m} RLIKE '^[0-9]{{4}}' THEN concat(CAST(year(p) AS STRING), {sep}, lpad(CAST(month(p) AS STRING), 2, '0'), {second}, lpad(CAST(day(p) AS STRING), 2, '0')) "
        f"WHEN {month_first} THEN concat({two('month(p)')}, {sep}, {two('day(p)')}, {second}, CAST(year(p) AS STRING)) ELSE concat({two('day(p)')}, {sep}, {two('month(p)')}, {second}, CAST(year(p) AS STRING)) END")  # fmt: skip
    iban = _let("z", f"concat(substr({m}, 1, 2), '00', {_refill(f'substr({m}, 5)', 'e')})", _let("q", "replace(z, ' ', '')",
        f"concat(substr({m}, 1, 2), lpad(CAST(98 - {_iban_rest('concat(substr(q, 5), substr(q, 1, 4))')} AS STRING), 2, '0'), substr(z, 5))"))
    halves = _let("h", "IF(length(g) > 18, substr(g, 1, 18), g)", f"concat({keyed.digits('iban', 'h')}, {_let('k', 'substr(g, 19)', keyed.digits('iban-rest', 'k'))})")
    low = f"lower({m})"
    secret = _let("x", f"substr(repeat({keyed.hex(f'concat("secret:", {low})')}, 1 + length({m}) DIV 64), 1, length({m}))", f"IF({m} = upper({m}), upper(x), x)")
    digits = lambda body: _let("d", _only_digits(m), _let("e", body, _refill(m, "e")))
    return {
        "email": _let("x", keyed.hex(f"concat('email:', {low})"), f"{_let('y', f'concat("u", substr(x, 1, 12), "@", substr({keyed.hex(f"concat('domain:', substring_index({low}, '@', -1))")}, 1, 8), ".example")', f'IF({m} = upper({m}), upper(y), y)')}"),
        "secret": secret,
        "iban": _let("g", _only_digits(f"substr({m}, 5)"), _let("e", halves, iban)),
        "date": date,
        "ip": ip,
        "ssn": digits(ssn),
        "phone": digits(phone),
        "account": digits(account),
    }[kind]


def find(text: str = "text") -> Column:
    """The text cut at its matches: structs (kind, m), every second one a match, with its kind if it is valid."""
    safe = f"replace({text}, '{_MARK}', '{_ESCAPED}')"
    marked = _let("b", _checked(text), _by_pattern("b", f"regexp_replace({safe}, {{}}, '{_EDGE}$0{_EDGE}')"))
    return F.expr(f"transform(split({marked}, '{_EDGE}', -1), (m, i) -> named_struct('kind', IF(i % 2 = 1, {_kind('m')}, NULL), 'm', m))")


def replace(found: str, text: str, key: str) -> Column:
    """The text with each found match replaced by its pseudonym."""
    keyed = _Keyed(key)
    cases = " ".join(f"WHEN '{k}' THEN {_replacement(k, 'v.m', keyed)}" for k in KINDS)
    fresh = f"transform({found}, v -> CASE WHEN v.kind IS NULL THEN v.m ELSE CASE v.kind {cases} END END)"
    return F.expr(f"IF({text} IS NULL OR size({found}) <= 1, {text}, replace(array_join({fresh}, ''), '{_ESCAPED}', '{_MARK}'))")


def pseudonymize(docs: DataFrame, key: str, column: str = "text") -> DataFrame:
    """docs with personal data in a text column replaced, all columns kept."""
    found = "__pii"
    while found in map(str.lower, docs.columns):
        found += "_"
    rows = docs.withColumn(found, find(f"`{column}`"))
    return rows.withColumn(column, replace(found, f"`{column}`", key)).drop(found)


def report(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, the pseudonymized text, and the number of replacements of each kind."""
    rows = docs.select("doc_id", "text", find("text").alias("__pii"))
    counts = [F.expr(f"CAST(greatest(0, size(filter(__pii, v -> v.kind = '{k}'))) AS BIGINT)").alias(f"n_{k}") for k in KINDS]
    return rows.select("doc_id", replace("__pii", "text", key).alias("text"), *counts)
