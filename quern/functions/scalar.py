"""MySQL's scalar functions as Spark SQL.

FUNCTIONS maps a name to a builder that takes the arguments as SQL text and
returns SQL text, so that Catalyst sees plain built-in expressions. Names that
Spark has with the same meaning map to themselves.
"""

from __future__ import annotations

import re

from collections.abc import Callable

Builder = Callable[..., str]
FUNCTIONS: dict[str, Builder] = {}


def _same(*names: str) -> None:
    for n in names:
        FUNCTIONS[n] = lambda *a, n=n: f"{n.lower()}({', '.join(a)})"


def _as(name: str, template: str) -> None:
    """A template with {0}, {1}, ... for the arguments."""
    for n in name.split():
        FUNCTIONS[n] = lambda *a, t=template: "(" + t.format(*a) + ")"


def define(*names: str) -> Callable[[Builder], Builder]:
    def put(f: Builder) -> Builder:
        for n in names:
            FUNCTIONS[n] = f
        return f

    return put


# --- strings
_same("CONCAT", "CONCAT_WS", "LOWER", "UPPER", "REPLACE", "LOCATE", "INSTR", "REVERSE", "REPEAT", "SPACE", "LPAD", "RPAD", "FIND_IN_SET", "ELT", "ASCII", "MD5", "SHA1", "SHA2", "BIN", "CONV", "LTRIM", "RTRIM", "SUBSTRING_INDEX", "BIT_LENGTH", "OCTET_LENGTH", "CHAR_LENGTH", "UNHEX", "UUID", "COALESCE", "NULLIF")
_as("LCASE", "lower({0})")
_as("UCASE", "upper({0})")
_as("LENGTH", "octet_length({0})")
_as("CHARACTER_LENGTH", "char_length({0})")
_as("LEFT", "CASE WHEN {1} <= 0 THEN '' ELSE substring({0}, 1, {1}) END")
_as("RIGHT", "CASE WHEN {1} <= 0 THEN '' WHEN {1} >= char_length({0}) THEN {0} ELSE substring({0}, -({1})) END")
_as("INSERT", "CASE WHEN {1} < 1 OR {1} > char_length({0}) THEN {0} ELSE concat(substring({0}, 1, {1} - 1), {3}, CASE WHEN {2} < 0 OR {1} + {2} > char_length({0}) THEN '' ELSE substring({0}, {1} + {2}) END) END")
_as("HEX", "hex({0})")
_as("OCT", "conv({0}, 10, 8)")
_as("ORD", "cast(conv(hex(encode(substring({0}, 1, 1), 'UTF-8')), 16, 10) AS bigint)")
_as("TO_BASE64", "base64(cast({0} AS binary))")
_as("FROM_BASE64", "try_to_binary({0}, 'base64')")
_as("QUOTE", r"coalesce(concat('\'', replace(replace({0}, '\\', '\\\\'), '\'', '\\\''), '\''), 'NULL')")
_as("STRCMP", "CASE WHEN {0} < {1} THEN -1 WHEN {0} = {1} THEN 0 WHEN {0} > {1} THEN 1 END")
_as("SHA", "sha1({0})")
_as("CRC32", "crc32(cast({0} AS binary))")
_as("IS_UUID", r"({0} RLIKE '^([0-9a-fA-F]{{32}}|[{{]?[0-9a-fA-F]{{8}}(-[0-9a-fA-F]{{4}}){{3}}-[0-9a-fA-F]{{12}}[}}]?)$')")
_as("REGEXP_LIKE", "({0} RLIKE {1})")
_as("UUID_SHORT", "(monotonically_increasing_id() + 1)")


@define("SUBSTRING", "SUBSTR", "MID")
def _substring(s: str, p: str, n: str | None = None) -> str:
    cut = f"substring({s}, {p})" if n is None else f"substring({s}, {p}, greatest({n}, 0))"
    return f"(CASE WHEN {p} = 0 OR {p} < -char_length({s}) THEN '' ELSE {cut} END)"


@define("TRIM")
def _trim(s: str, side: str = "BOTH", what: str | None = None) -> str:
    if what is None:
        return f"{ {'BOTH': 'trim', 'LEADING': 'ltrim', 'TRAILING': 'rtrim'}[side] }({s})"
    quoted = f"concat('\\\\Q', {what}, '\\\\E')"
    out = s
    if side in ("BOTH", "LEADING"):
        out = f"regexp_replace({out}, concat('^(?:', {quoted}, ')+'), '')"
    if side in ("BOTH", "TRAILING"):
        out = f"regexp_replace({out}, concat('(?:', {quoted}, ')+$'), '')"
    return out


@define("FIELD")
def _field(x: str, *of: str) -> str:
    return f"coalesce(cast(array_position(array({', '.join(of)}), {x}) AS int), 0)"


@define("CHAR")
def _char(*codes: str) -> str:
    parts = ", ".join(f"unhex(CASE WHEN length(hex(cast({c} AS bigint))) % 2 = 1 THEN concat('0', hex(cast({c} AS bigint))) ELSE hex(cast({c} AS bigint)) END)" for c in codes)
    return f"concat({parts})"


@define("FORMAT")
def _format(x: str, d: str, *_: str) -> str:
    """Doubles by their binary value and with their sign, as they are printed; exact numbers rounded half up."""
    return f"(CASE WHEN typeof({x}) IN ('double', 'float') THEN format_number({x}, {d}) ELSE format_number(round({x}, {d}), {d}) END)"


@define("MAKE_SET")
def _make_set(bits: str, *names: str) -> str:
    return "concat_ws(',', " + ", ".join(f"CASE WHEN (cast({bits} AS bigint) & {1 << i}L) > 0 THEN {n} END" for i, n in enumerate(names)) + ")"


@define("EXPORT_SET")
def _export_set(bits: str, on: str, off: str, sep: str = "','", n: str = "64") -> str:
    return f"array_join(transform(sequence(0, {n} - 1), i -> CASE WHEN (shiftright(cast({bits} AS bigint), i) & 1) = 1 THEN {on} ELSE {off} END), {sep})"


@define("SOUNDEX")
def _soundex(s: str) -> str:
    """Without the cap of four characters: digits of the letters, no repeats, vowels and H, W, Y dropped."""
    letters = f"regexp_replace(upper({s}), '[^A-Z]', '')"
    digits = f"translate({letters}, 'BFPVCGJKQSXZDTLMNRAEIOUHWY', '11112222222233455600000000')"
    kept = f"regexp_replace(regexp_replace({digits}, '0', ''), '(.)\\\\1+', '$1')"
    first = f"translate(substring({letters}, 1, 1), 'BFPVCGJKQSXZDTLMNRAEIOUHWY', '11112222222233455600000000')"
    tail = f"CASE WHEN {first} <> '0' AND substring({kept}, 1, 1) = {first} THEN substring({kept}, 2) ELSE {kept} END"
    return f"(CASE WHEN {letters} = '' THEN '' ELSE rpad(concat(substring({letters}, 1, 1), {tail}), greatest(4, 1 + length({tail})), '0') END)"


@define("REGEXP_REPLACE")
def _regexp_replace(s: str, p: str, r: str, pos: str = "1", occurrence: str = "0", flags: str | None = None) -> str:
    p = p if flags is None else f"concat('(?', {flags}, ')', {p})"
    if occurrence.strip() == "0":
        return f"regexp_replace({s}, {p}, {r}, {pos})"
    # replace what lies at the n-th match only: gaps and matches alternate
    rest, head = f"substring({s}, {pos})", f"substring({s}, 1, {pos} - 1)"
    gaps, found = f"split({rest}, {p}, -1)", f"regexp_extract_all({rest}, {p}, 0)"
    return f"concat({head}, array_join(zip_with({gaps}, transform({found}, (m, i) -> CASE WHEN i = {occurrence} - 1 THEN regexp_replace(m, {p}, {r}) ELSE m END), (g, m) -> concat(g, coalesce(m, ''))), ''))"


@define("REGEXP_SUBSTR")
def _regexp_substr(s: str, p: str, pos: str = "1", occurrence: str = "1", flags: str | None = None) -> str:
    p = p if flags is None else f"concat('(?', {flags}, ')', {p})"
    return f"try_element_at(regexp_extract_all(substring({s}, {pos}), {p}, 0), cast({occurrence} AS int))"


@define("REGEXP_INSTR")
def _regexp_instr(s: str, p: str, pos: str = "1", occurrence: str = "1", option: str = "0", flags: str | None = None) -> str:
    p = p if flags is None else f"concat('(?', {flags}, ')', {p})"
    rest = f"substring({s}, {pos})"
    gaps, found = f"split({rest}, {p}, -1)", f"regexp_extract_all({rest}, {p}, 0)"
    before = f"aggregate(slice(zip_with({gaps}, {found}, (g, m) -> length(g) + coalesce(length(m), 0)), 1, {occurrence} - 1), 0, (a, x) -> a + x)"
    own = f"length(try_element_at({gaps}, {occurrence})) + CASE WHEN {option} = 1 THEN length(try_element_at({found}, {occurrence})) ELSE 0 END"
    return f"(CASE WHEN size({found}) < {occurrence} THEN 0 ELSE {pos} + {before} + {own} END)"


# --- numbers
_same("ABS", "CEIL", "FLOOR", "EXP", "LOG2", "LOG10", "SIN", "COS", "TAN", "COT", "ATAN2", "DEGREES", "RADIANS", "PI", "RAND", "MOD", "SIGN")
_as("SIGN", "cast(signum({0}) AS int)")
_as("CEILING", "ceil({0})")
_as("POW POWER", "power({0}, {1})")
_as("SQRT", "CASE WHEN {0} >= 0 THEN sqrt({0}) END")
_as("LN", "ln({0})")
_as("ASIN", "CASE WHEN abs({0}) <= 1 THEN asin({0}) END")
_as("ACOS", "CASE WHEN abs({0}) <= 1 THEN acos({0}) END")
_as("BIT_COUNT", "bit_count(cast({0} AS bigint))")


@define("ATAN")
def _atan(x: str, y: str | None = None) -> str:
    return f"atan({x})" if y is None else f"atan2({x}, {y})"


@define("LOG")
def _log(x: str, y: str | None = None) -> str:
    return f"ln({x})" if y is None else f"(CASE WHEN {x} > 0 AND {x} <> 1 AND {y} > 0 THEN log({x}, {y}) END)"


@define("ROUND")
def _round(x: str, d: str = "0") -> str:
    return f"round({x}, {d})"


@define("TRUNCATE")
def _truncate(x: str, d: str) -> str:
    return f"(signum({x}) * floor(abs(cast({x} AS decimal(38, 12))) * power(cast(10 AS double), {d})) / power(cast(10 AS double), {d}))"


for _n in ("GREATEST", "LEAST"):
    FUNCTIONS[_n] = lambda *a, n=_n: "(CASE WHEN " + " OR ".join(f"{x} IS NULL" for x in a) + f" THEN NULL ELSE {n.lower()}({', '.join(a)}) END)"


@define("INTERVAL")
def _interval(n: str, *bounds: str) -> str:
    return f"(CASE WHEN {n} IS NULL THEN -1 ELSE " + " + ".join(f"CASE WHEN {n} >= {b} THEN 1 ELSE 0 END" for b in bounds) + " END)"


# --- conditions
_as("IFNULL", "coalesce({0}, {1})")
_as("ISNULL", "CASE WHEN {0} IS NULL THEN 1 ELSE 0 END")
_as("IF", "CASE WHEN {0} THEN {1} ELSE {2} END")

# --- network
_IPV4 = r"^((25[0-5]|2[0-4][0-9]|1[0-9]{{2}}|[1-9]?[0-9])\\.){{3}}(25[0-5]|2[0-4][0-9]|1[0-9]{{2}}|[1-9]?[0-9])$"
_as("IS_IPV4", f"CASE WHEN {{0}} RLIKE '{_IPV4}' THEN 1 ELSE 0 END")
_as("INET_ATON", r"CASE WHEN {0} RLIKE '^[0-9]+(\\.[0-9]+){{0,3}}$' THEN aggregate(slice(split({0}, '\\.'), 1, size(split({0}, '\\.')) - 1), 0L, (a, x) -> a * 256 + cast(x AS bigint)) * cast(power(256, 5 - size(split({0}, '\\.'))) AS bigint) + cast(element_at(split({0}, '\\.'), -1) AS bigint) END")
_as("INET_NTOA", "CASE WHEN {0} BETWEEN 0 AND 4294967295 THEN concat_ws('.', shiftright(cast({0} AS bigint), 24) & 255, shiftright(cast({0} AS bigint), 16) & 255, shiftright(cast({0} AS bigint), 8) & 255, cast({0} AS bigint) & 255) END")
_as("IS_IPV4_COMPAT", "CASE WHEN hex({0}) RLIKE '^0{{24}}' AND NOT hex({0}) RLIKE '^0{{28}}(0000|0001)$' AND octet_length({0}) = 16 THEN 1 ELSE 0 END")
_as("IS_IPV4_MAPPED", "CASE WHEN hex({0}) RLIKE '^0{{20}}FFFF' AND octet_length({0}) = 16 THEN 1 ELSE 0 END")


@define("UUID_TO_BIN")
def _uuid_to_bin(u: str, swap: str = "0") -> str:
    h = f"replace(replace(replace({u}, '-', ''), '{{', ''), '}}', '')"
    h = h.replace("{{", "{").replace("}}", "}")
    return f"unhex(CASE WHEN {swap} = 1 THEN concat(substring({h}, 13, 4), substring({h}, 9, 4), substring({h}, 1, 8), substring({h}, 17)) ELSE {h} END)"


@define("BIN_TO_UUID")
def _bin_to_uuid(b: str, swap: str = "0") -> str:
    h = f"lower(hex({b}))"
    h = f"(CASE WHEN {swap} = 1 THEN concat(substring({h}, 9, 8), substring({h}, 5, 4), substring({h}, 1, 4), substring({h}, 17)) ELSE {h} END)"
    return f"concat_ws('-', substring({h}, 1, 8), substring({h}, 9, 4), substring({h}, 13, 4), substring({h}, 17, 4), substring({h}, 21))"


# --- dates
_same("YEAR", "MONTH", "HOUR", "MINUTE", "SECOND", "QUARTER", "DAYOFWEEK", "WEEKDAY", "DAYOFYEAR", "WEEKOFYEAR", "LAST_DAY", "DATEDIFF")
_as("DAY DAYOFMONTH", "dayofmonth({0})")
_as("NOW CURRENT_TIMESTAMP SYSDATE LOCALTIME LOCALTIMESTAMP", "localtimestamp()")
_as("CURDATE CURRENT_DATE", "current_date()")
_as("CURTIME CURRENT_TIME", "date_format(current_timestamp(), 'HH:mm:ss')")
_as("UTC_TIMESTAMP", "to_utc_timestamp(current_timestamp(), current_timezone())")
_as("UTC_DATE", "to_date(to_utc_timestamp(current_timestamp(), current_timezone()))")
_as("UTC_TIME", "date_format(to_utc_timestamp(current_timestamp(), current_timezone()), 'HH:mm:ss')")
_as("DATE", "to_date({0})")
_as("MICROSECOND", "cast(date_format({0}, 'SSSSSS') AS int)")
_as("DAYNAME", "date_format({0}, 'EEEE')")
_as("MONTHNAME", "date_format({0}, 'MMMM')")
_as("TO_DAYS", "datediff({0}, date'1970-01-01') + 719528")
_as("FROM_DAYS", "date_add(date'1970-01-01', cast({0} AS int) - 719528)")
_as("TO_SECONDS", "(datediff({0}, date'1970-01-01') + 719528L) * 86400 + hour({0}) * 3600 + minute({0}) * 60 + second({0})")
_as("PERIOD_DIFF", "(({0} div 100) * 12 + {0} % 100) - (({1} div 100) * 12 + {1} % 100)")
_as("PERIOD_ADD", "((({0} div 100) * 12 + {0} % 100 - 1 + {1}) div 12) * 100 + (({0} div 100) * 12 + {0} % 100 - 1 + {1}) % 12 + 1")
_as("MAKEDATE", "CASE WHEN {1} > 0 THEN date_add(make_date({0}, 1, 1), cast({1} AS int) - 1) END")
_as("UNIX_TIMESTAMP", "unix_timestamp({0})")
_as("CONVERT_TZ", "convert_timezone({1}, {2}, cast({0} AS timestamp_ntz))")

#: A TIME is text [-]HHH:MM:SS[.ffffff] here; its carrier in arithmetic is microseconds.
_SPAN = r"(CASE WHEN {0} LIKE '-%' THEN -1 ELSE 1 END * (abs(cast(split({0}, ':')[0] AS bigint)) * 3600000000 + cast(split({0}, ':')[1] AS bigint) * 60000000 + cast(cast(split({0}, ':')[2] AS decimal(8, 6)) * 1000000 AS bigint)))"


def time_to_micros(x: str) -> str:
    """Microseconds of a time text, or of a timestamp's time of day."""
    return _SPAN.format(f"cast(CASE WHEN cast({x} AS string) LIKE '____-__-__ %' THEN substring(cast({x} AS string), 12) ELSE cast({x} AS string) END AS string)")


def micros_to_time(us: str) -> str:
    """Text of a time of so many microseconds, held to +-838:59:59."""
    held = f"greatest(least({us}, 3020399000000L), -3020399000000L)"
    frac = f"CASE WHEN abs({held}) % 1000000 <> 0 THEN concat('.', lpad(cast(abs({held}) % 1000000 AS string), 6, '0')) ELSE '' END"
    two = lambda x: f"lpad(cast({x} AS string), 2, '0')"
    hours = f"abs({held}) div 3600000000"
    return f"concat(CASE WHEN {held} < 0 THEN '-' ELSE '' END, CASE WHEN {hours} < 100 THEN {two(hours)} ELSE cast({hours} AS string) END, ':', {two(f'abs({held}) div 60000000 % 60')}, ':', {two(f'abs({held}) div 1000000 % 60')}, {frac})"


FUNCTIONS["TIME"] = lambda x: micros_to_time(time_to_micros(x))
FUNCTIONS["TIME_TO_SEC"] = lambda x: f"({time_to_micros(x)} div 1000000)"
FUNCTIONS["SEC_TO_TIME"] = lambda x: micros_to_time(f"cast(cast({x} AS decimal(18, 6)) * 1000000 AS bigint)")
FUNCTIONS["MAKETIME"] = lambda h, m, s: f"(CASE WHEN {m} BETWEEN 0 AND 59 AND {s} >= 0 AND {s} < 60 THEN {micros_to_time(f'(CASE WHEN {h} < 0 THEN -1 ELSE 1 END * cast(cast(abs({h}) * 3600 + {m} * 60 + {s} AS decimal(18, 6)) * 1000000 AS bigint))')} END)"


@define("TIMEDIFF")
def _timediff(a: str, b: str) -> str:
    moment = lambda x: f"cast({x} AS string) LIKE '____-__-__ %'"
    return f"(CASE WHEN {moment(a)} AND {moment(b)} THEN {micros_to_time(f'timestampdiff(MICROSECOND, cast({b} AS timestamp), cast({a} AS timestamp))')} ELSE {micros_to_time(f'({time_to_micros(a)} - {time_to_micros(b)})')} END)"


def _add_time(sign: str) -> Builder:
    def build(x: str, t: str) -> str:
        us = time_to_micros(t)
        moment = f"cast({x} AS string) LIKE '____-__-__ %'"
        return f"(CASE WHEN {moment} THEN date_format(cast({x} AS timestamp) {sign} make_dt_interval(0, 0, 0, cast({us} AS decimal(18, 6)) / 1000000), 'yyyy-MM-dd HH:mm:ss') ELSE {micros_to_time(f'({time_to_micros(x)} {sign} {us})')} END)"

    return build


FUNCTIONS["ADDTIME"], FUNCTIONS["SUBTIME"] = _add_time("+"), _add_time("-")


@define("TIMESTAMP")
def _timestamp(x: str, t: str | None = None) -> str:
    return f"cast({x} AS timestamp)" if t is None else f"(cast({x} AS timestamp) + make_dt_interval(0, 0, 0, cast({time_to_micros(t)} AS decimal(18, 6)) / 1000000))"


@define("FROM_UNIXTIME")
def _from_unixtime(n: str, fmt: str | None = None) -> str:
    return f"timestamp_seconds({n})" if fmt is None else date_format(f"timestamp_seconds({n})", fmt)


def week_number(d: str, mode: int) -> tuple[str, str]:
    """(week, year) of WEEK(d, mode); modes 0 to 7 differ in the first day, the range and the rule for week 1.

    Day one of the week-year is the first Sunday or Monday, or the one of the
    week that holds at least four days of January.
    """
    monday, iso = bool(mode & 1), bool(mode & 1) != bool(mode & 4)
    always_from_one = bool(mode & 2)

    def first(year: str) -> str:
        """The first day of week 1 of a year."""
        jan1 = f"make_date({year}, 1, 1)"
        back = f"weekday({jan1})" if monday else f"(dayofweek({jan1}) - 1)"  # days since the week began
        start = f"date_sub({jan1}, {back})"
        return f"(CASE WHEN {back} {'<= 3' if iso else '= 0'} THEN {start} ELSE date_add({start}, 7) END)"

    y = f"year({d})"
    this = f"(datediff({d}, {first(y)}) div 7 + 1)"
    before = f"datediff({d}, {first(y)}) < 0"
    if not always_from_one:
        return f"(CASE WHEN {before} THEN 0 ELSE {this} END)", y
    last = f"(datediff({d}, {first(f'{y} - 1')}) div 7 + 1)"
    after = f"datediff({d}, {first(f'{y} + 1')}) >= 0"
    week = f"(CASE WHEN {before} THEN {last} WHEN {after} THEN 1 ELSE {this} END)"
    return week, f"(CASE WHEN {before} THEN {y} - 1 WHEN {after} THEN {y} + 1 ELSE {y} END)"


@define("WEEK")
def _week(d: str, mode: str = "0") -> str:
    return week_number(d, int(mode))[0]


@define("YEARWEEK")
def _yearweek(d: str, mode: str = "0") -> str:
    week, year = week_number(d, int(mode) | 2)
    return f"({year} * 100 + {week})"


#: DATE_FORMAT directives: fixed values of the dialect, with the Java patterns that mean the same.
DIRECTIVES = {
    "Y": "yyyy", "y": "yy", "m": "MM", "c": "M", "d": "dd", "e": "d", "H": "HH", "k": "H", "h": "hh", "I": "hh", "l": "h",
    "i": "mm", "s": "ss", "S": "ss", "f": "SSSSSS", "p": "a", "M": "MMMM", "b": "MMM", "W": "EEEE", "a": "EEE", "j": "DDD",
    "T": "HH:mm:ss", "r": "hh:mm:ss a",
}


def date_format(d: str, fmt: str) -> str:
    """DATE_FORMAT for a literal format (SQL text with quotes)."""
    if fmt[:1] not in "'\"":
        raise ValueError("DATE_FORMAT needs a literal format")
    body, parts, i = fmt[1:-1], [], 0
    while i < len(body):
        if body[i] == "%" and i + 1 < len(body):
            c, i = body[i + 1], i + 2
            if c in DIRECTIVES:
                parts.append(f"date_format({d}, '{DIRECTIVES[c]}')")
            elif c == "w":
                parts.append(f"cast(dayofweek({d}) - 1 AS string)")
            elif c == "D":
                day = f"dayofmonth({d})"
                parts.append(f"concat({day}, CASE WHEN {day} BETWEEN 11 AND 13 THEN 'th' WHEN {day} % 10 = 1 THEN 'st' WHEN {day} % 10 = 2 THEN 'nd' WHEN {day} % 10 = 3 THEN 'rd' ELSE 'th' END)")
            elif c in "UuVv":
                week = week_number(d, {"U": 0, "u": 1, "V": 2, "v": 3}[c])[0]
                parts.append(f"lpad(cast({week} AS string), 2, '0')")
            elif c in "Xx":
                parts.append(f"lpad(cast({week_number(d, {'X': 2, 'x': 3}[c])[1]} AS string), 4, '0')")
            else:
                parts.append(f"'{c}'")
        else:
            j = body.find("%", i)
            j = len(body) if j < 0 else j
            if j == i:
                j = i + 1
            parts.append(f"'{body[i:j]}'")
            i = j
    return f"concat({', '.join(parts) or repr('')})"


FUNCTIONS["DATE_FORMAT"] = date_format
FUNCTIONS["TIME_FORMAT"] = lambda t, fmt: date_format(f"cast(concat('1970-01-01 ', {t}) AS timestamp)", fmt)


@define("STR_TO_DATE")
def _str_to_date(s: str, fmt: str) -> str:
    body, out, i, timed, dated = fmt[1:-1], "", 0, False, False
    while i < len(body):
        if body[i] == "%" and i + 1 < len(body):
            c = body[i + 1]
            out += DIRECTIVES.get(c, c)
            timed |= c in "HkhIlisSfpTr"
            dated |= c in "YymcdeMbj"
            i += 2
        else:
            out += f"''{body[i]}''".replace("''", "\\'") if body[i].isalpha() else body[i]
            i += 1
    moment = f"try_to_timestamp({s}, '{out}')"
    return moment if timed and dated else f"date_format({moment}, 'HH:mm:ss')" if timed else f"to_date({moment})"


_GET_FORMAT = {  # fixed values of the dialect
    ("DATE", "USA"): "%m.%d.%Y", ("DATE", "JIS"): "%Y-%m-%d", ("DATE", "ISO"): "%Y-%m-%d", ("DATE", "EUR"): "%d.%m.%Y", ("DATE", "INTERNAL"): "%Y%m%d",
    ("DATETIME", "USA"): "%Y-%m-%d %H.%i.%s", ("DATETIME", "JIS"): "%Y-%m-%d %H:%i:%s", ("DATETIME", "ISO"): "%Y-%m-%d %H:%i:%s", ("DATETIME", "EUR"): "%Y-%m-%d %H.%i.%s", ("DATETIME", "INTERNAL"): "%Y%m%d%H%i%s",
    ("TIME", "USA"): "%h:%i:%s %p", ("TIME", "JIS"): "%H:%i:%s", ("TIME", "ISO"): "%H:%i:%s", ("TIME", "EUR"): "%H.%i.%s", ("TIME", "INTERNAL"): "%H%i%s",
}
FUNCTIONS["GET_FORMAT"] = lambda kind, where: f"'{_GET_FORMAT[kind.upper().replace('TIMESTAMP', 'DATETIME'), where.strip(chr(39)).upper()]}'"

# --- JSON that built-in functions express
_as("JSON_VALID", "CASE WHEN {0} IS NULL THEN NULL WHEN try_parse_json({0}) IS NOT NULL THEN 1 ELSE 0 END")
_as("JSON_QUOTE", "regexp_replace(to_json(named_struct('v', {0})), '^.\"v\":(.*).$', '$1')")
_as("JSON_UNQUOTE", "CASE WHEN {0} LIKE '\"%\"' THEN get_json_object(concat('{{\"v\":', {0}, '}}'), '$.v') ELSE {0} END")
_as("JSON_VALUE", "get_json_object({0}, {1})")


@define("JSON_LENGTH")
def _json_length(j: str, path: str | None = None) -> str:
    j = j if path is None else f"get_json_object({j}, {path})"
    return f"(CASE WHEN {j} IS NULL THEN NULL WHEN ltrim({j}) LIKE '[%' THEN json_array_length({j}) WHEN ltrim({j}) LIKE '{{%' THEN size(json_object_keys({j})) ELSE 1 END)"


@define("JSON_KEYS")
def _json_keys(j: str, path: str | None = None) -> str:
    j = j if path is None else f"get_json_object({j}, {path})"
    order = "(a, b) -> CASE WHEN octet_length(a) <> octet_length(b) THEN octet_length(a) - octet_length(b) WHEN a < b THEN -1 WHEN a > b THEN 1 ELSE 0 END"
    keys = f"array_sort(array_distinct(json_object_keys({j})), {order})"
    return f"(CASE WHEN json_object_keys({j}) IS NOT NULL THEN concat('[', array_join(transform({keys}, k -> concat('\"', k, '\"')), ', '), ']') END)"


def json_exists(doc: str, path: str) -> str:
    """Whether there is anything, a JSON null included, at a path."""
    if re.fullmatch(r"'\$(\.\w+|\[\d+\])+'", path):
        return f"(try_variant_get(try_parse_json({doc}), {path}, 'variant') IS NOT NULL)"
    return f"({doc} IS NOT NULL)" if path == "'$'" else f"(get_json_object({doc}, {path}) IS NOT NULL)"


@define("JSON_CONTAINS_PATH")
def _json_contains_path(j: str, how: str, *paths: str) -> str:
    one = how.strip("'\"").lower() == "one"
    tests = (" OR " if one else " AND ").join(json_exists(j, p) for p in paths)
    return f"(CASE WHEN {j} IS NULL THEN NULL WHEN {tests} THEN 1 ELSE 0 END)"


# --- session
_as("DATABASE SCHEMA", "current_database()")
_as("VERSION", "'8.4.0-quern'")
_as("USER CURRENT_USER SESSION_USER SYSTEM_USER", "concat(current_user(), '@%')")
_as("CONNECTION_ID", "1L")
_as("CURRENT_ROLE", "'NONE'")
_as("ROW_COUNT", "-1L")
_as("LAST_INSERT_ID", "0L")
_as("CHARSET", "'utf8mb4'")
_as("COLLATION", "'utf8mb4_0900_ai_ci'")
_as("COERCIBILITY", "4")
