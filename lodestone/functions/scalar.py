"""Scalar functions, Column in and Column out. NULL in gives NULL out unless stated."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


# --- strings -------------------------------------------------------------

def substr(s: Column, start, length=None) -> Column:
    """1-based; negative counts from the end; start 0 stands before the first character and takes up a place."""
    start, n = _c(start), None if length is None else _c(length)
    if n is None:
        return F.when(start == 0, s).otherwise(F.substring(s, start, F.length(s)))
    return F.when(start == 0, F.substring(s, F.lit(1), n - 1)).otherwise(F.substring(s, start, n))


def sql_like(s: Column, pattern: str, escape: str | None = None) -> Column:
    """LIKE without regard to case."""
    return s.ilike(pattern) if escape is None else F.ilike(s, F.lit(pattern), F.lit(escape))


def glob(s: Column, pattern: str) -> Column:
    """GLOB: * any run, ? one character, [..] a class, ^ in it negates; case counts."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 2 + (pattern[i + 1 : i + 2] == "^")) if c == "[" else -1
        if c == "*":
            out += "(?s:.*)"
        elif c == "?":
            out += "(?s:.)"
        elif end > 0:
            body = pattern[i + 1 : end]
            out += "[" + ("^" if body[0] == "^" else "") + body.lstrip("^").replace("\\", "\\\\").replace("[", "\\[").replace("]", "\\]") + "]"
            i = end
        else:
            out += re.escape(c)
        i += 1
    return s.rlike(f"^(?:{out})$(?!\n)")


def quote(s: Column) -> Column:
    """A SQL literal; NULL gives the word NULL."""
    return F.coalesce(F.concat(F.lit("'"), F.replace(s, F.lit("'"), F.lit("''")), F.lit("'")), F.lit("NULL"))


def char(*codes) -> Column:
    """A string of code points."""
    return F.concat(*[F.decode(F.unhex(F.lpad(F.hex(_c(c).cast("long")), 8, "0")), "UTF-32") for c in codes])


def text_lpad(s: Column, n: int, pad: str = " ") -> Column:
    """Pads but never cuts."""
    return F.when(F.length(s) >= n, s).otherwise(F.lpad(s, n, pad))


def text_rpad(s: Column, n: int, pad: str = " ") -> Column:
    return F.when(F.length(s) >= n, s).otherwise(F.rpad(s, n, pad))


def text_split(s: Column, sep: str, n: int) -> Column:
    """The n-th part from 1; '' out of range."""
    if n < 1:
        return F.when(s.isNotNull(), "")
    if sep == "":
        return s if n == 1 else F.when(s.isNotNull(), "")
    return F.split_part(s, F.lit(sep), F.lit(n))


# --- numbers -------------------------------------------------------------

def no_nan(c: Column) -> Column:
    """NaN as NULL, as the math functions answer outside their domain."""
    return F.when(~F.isnan(c), c)


def scalar_max(*cols: Column) -> Column:
    """The largest argument; NULL if any is."""
    some_null = cols[0].isNull()
    for c in cols[1:]:
        some_null |= c.isNull()
    return F.when(~some_null, F.greatest(*cols))


def scalar_min(*cols: Column) -> Column:
    some_null = cols[0].isNull()
    for c in cols[1:]:
        some_null |= c.isNull()
    return F.when(~some_null, F.least(*cols))


def trunc(x: Column) -> Column:
    """Towards zero, as a double."""
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("double")


def cot(x: Column) -> Column:
    return F.when(x != 0, 1 / F.tan(x))


def int_div(a: Column, b: Column) -> Column:
    """Integer division towards zero; by zero NULL."""
    return F.when(b != 0, F.call_function("div", a, F.nullif(b, F.lit(0))))


def zorder(*dims: Column) -> Column:
    """Interleaved bits of 2 to 24 non-negative integers: bit i of the result is of dimension i mod N; 63 bits, else an error."""
    n = len(dims)
    if not 2 <= n <= 24:
        raise ValueError("zorder takes 2 to 24 dimensions")
    per = [(63 - d + n - 1) // n for d in range(n)]
    z, over = F.lit(0).cast("long"), F.lit(False)
    for d, c in enumerate(dims):
        c = c.cast("long")
        over |= (c < 0) | (F.shiftright(c, per[d]) != 0)
        for b in range(per[d]):
            z = z.bitwiseOR(F.shiftleft(F.shiftright(c, b).bitwiseAND(F.lit(1).cast("long")), b * n + d))
    return F.when(over, F.raise_error(F.lit("zorder: value out of range")).cast("long")).otherwise(z)


def unzorder(z: Column, n: int, i: int) -> Column:
    """Dimension `i` of a value made by `zorder` with `n` dimensions."""
    if not (2 <= n <= 24 and 0 <= i < n):
        raise ValueError("unzorder: dimension out of range")
    z, out = z.cast("long"), F.lit(0).cast("long")
    for b in range((63 - i + n - 1) // n):
        out = out.bitwiseOR(F.shiftleft(F.shiftright(z, b * n + i).bitwiseAND(F.lit(1).cast("long")), b))
    return F.when(z < 0, F.raise_error(F.lit("unzorder: negative value")).cast("long")).otherwise(out)


# --- dates and times -----------------------------------------------------

#: strftime directive -> date_format pattern; %w, %j, %s, %J and %f are made apart
_STRFTIME = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "F": "yyyy-MM-dd", "T": "HH:mm:ss", "R": "HH:mm", "e": "d", "I": "hh", "p": "a", "k": "H", "l": "h"}


def strftime(fmt: str, t: Column) -> Column:
    """SQL strftime for timestamps."""
    parts = []
    for lit, d in re.findall(r"([^%]+)|%(.)", fmt):
        if lit:
            parts.append(F.lit(lit))
        elif d in _STRFTIME:
            parts.append(F.date_format(t, _STRFTIME[d]))
        elif d == "w":
            parts.append((F.dayofweek(t) - 1).cast("string"))
        elif d == "u":
            parts.append((F.pmod(F.dayofweek(t) + 5, F.lit(7)) + 1).cast("string"))
        elif d == "j":
            parts.append(F.lpad(F.dayofyear(t).cast("string"), 3, "0"))
        elif d == "f":
            parts.append(F.date_format(t, "ss.SSS"))
        elif d == "s":
            parts.append(unixepoch(t).cast("string"))
        elif d == "J":
            parts.append(julianday(t).cast("string"))
        elif d == "%":
            parts.append(F.lit("%"))
        else:
            raise ValueError(f"strftime: %{d} isn't known")
    return F.concat(*parts) if parts else F.lit("")


def unixepoch(t: Column) -> Column:
    return F.unix_seconds(t.cast("timestamp"))


def julianday(t: Column) -> Column:
    return F.unix_micros(t.cast("timestamp")) / F.lit(86_400e6) + F.lit(2_440_587.5)


def modify(t: Column, *modifiers: str) -> Column:
    """Date modifiers in turn: 'start of year|month|day', '+N days|hours|minutes|seconds|months|years', 'weekday N'.

    Months and years that end on a day the month lacks roll over into the next.
    """
    t = t.cast("timestamp_ntz")
    for m in modifiers:
        if x := re.fullmatch(r"start of (year|month|day)", m):
            t = F.date_trunc(x[1], t).cast("timestamp_ntz")
        elif x := re.fullmatch(r"weekday ([0-6])", m):
            ahead = F.pmod(F.lit(int(x[1])) - (F.dayofweek(t) - 1), F.lit(7))
            t = t + F.make_dt_interval(ahead)
        elif x := re.fullmatch(r"([+-]?\d+(?:\.\d+)?) (second|minute|hour|day|month|year)s?", m):
            if x[2] in ("month", "year"):
                n = int(float(x[1])) * (12 if x[2] == "year" else 1)
                first = F.date_trunc("month", t).cast("timestamp_ntz")
                moved = first + F.make_ym_interval(F.lit(0), F.lit(n))
                t = moved + (t - first)
            else:
                seconds = float(x[1]) * {"second": 1, "minute": 60, "hour": 3600, "day": 86_400}[x[2]]
                t = t + F.expr(f"make_dt_interval(0, 0, 0, {seconds:.6f})")
        else:
            raise ValueError(f"modifier {m!r} isn't known")
    return t


_UNIT = {"h": 3_600_000_000, "m": 60_000_000, "s": 1_000_000, "ms": 1_000, "us": 1, "µs": 1, "ns": 0.001}


def duration_micros(d: str) -> int:
    """Microseconds of a duration such as '1h30m' or '-2.5s'."""
    x = re.fullmatch(r"([+-]?)((?:\d+(?:\.\d*)?(?:h|ms|m|us|µs|ns|s))+|0)", d)
    if not x:
        raise ValueError(f"bad duration {d!r}")
    total = sum(float(n) * _UNIT[u] for n, u in re.findall(r"(\d+(?:\.\d*)?)(h|ms|m|us|µs|ns|s)", x[2]))
    return round(-total if x[1] == "-" else total)


def time_add(t: Column, d: str) -> Column:
    return F.timestamp_micros(F.unix_micros(t.cast("timestamp")) + duration_micros(d)).cast("timestamp_ntz")


def time_diff(a: Column, b: Column) -> Column:
    """Seconds from b to a."""
    return (F.unix_micros(a.cast("timestamp")) - F.unix_micros(b.cast("timestamp"))) / F.lit(1e6)


#: microseconds from 0001-01-01 to the epoch, the origin that times are cut from
_ZERO = 62_135_596_800_000_000


def time_trunc(t: Column, d: str) -> Column:
    """Down to a multiple of the duration since the year 1."""
    n = duration_micros(d)
    us = F.unix_micros(t.cast("timestamp"))
    return t.cast("timestamp_ntz") if n <= 0 else F.timestamp_micros(us - F.pmod(us + _ZERO, F.lit(n))).cast("timestamp_ntz")


def time_part(t: Column, field: str) -> Column:
    """year, month, day, hour, minute, second, nanosecond, weekday (0 = Sunday), yearday, as a long."""
    made = {
        "year": F.year(t), "month": F.month(t), "day": F.dayofmonth(t), "hour": F.hour(t), "minute": F.minute(t), "second": F.second(t),
        "nanosecond": F.pmod(F.unix_micros(t.cast("timestamp")), F.lit(1_000_000)) * 1000, "weekday": F.dayofweek(t) - 1, "yearday": F.dayofyear(t),
    }
    if field not in made:
        raise ValueError(f"time_part: {field!r} isn't known")
    return made[field].cast("long")


#: reference layout element -> date_format pattern, longest first
_LAYOUT = {"2006": "yyyy", "January": "MMMM", "Jan": "MMM", "Monday": "EEEE", "Mon": "EEE", "01": "MM", "02": "dd", "15": "HH", "03": "hh", "04": "mm", "05": "ss", "06": "yy", "PM": "a", "Z07:00": "XXX", "-07:00": "xxx", ".000000": ".SSSSSS", ".000": ".SSS", "1": "M", "2": "d", "3": "h", "4": "m", "5": "s"}


def time_format(t: Column, layout: str) -> Column:
    """Formats by an example of the moment 2006-01-02 15:04:05."""
    names = "|".join(re.escape(k) for k in sorted(_LAYOUT, key=len, reverse=True))
    out = []
    for lit, el in re.findall(rf"((?:(?!{names})(?s:.))+)|({names})", layout):
        out.append(_LAYOUT[el] if el else "'" + lit.replace("'", "''") + "'")
    return F.date_format(t, "".join(out))


# --- JSON ----------------------------------------------------------------

def json_valid(j: Column) -> Column:
    """1 or 0; what stands behind a value makes the text invalid, which the brackets bring to light."""
    held = F.try_parse_json(F.concat(F.lit("["), j, F.lit("]")))
    one = F.try_parse_json(j).isNotNull() & held.isNotNull() & F.try_variant_get(held, "$[1]", "variant").isNull()
    return F.when(j.isNotNull(), one.cast("int"))


def json_arrow(j: Column, path: str) -> Column:
    """The JSON text at a path (strings keep their quotes)."""
    return F.to_json(F.try_variant_get(F.parse_json(j), path, "variant"))


def json_type(j: Column, path: str = "$") -> Column:
    """null, true, false, integer, real, text, array or object."""
    v = F.try_variant_get(F.parse_json(j), path, "variant")
    kind = F.schema_of_variant(v)
    return (
        F.when(kind == "VOID", "null").when(kind == "BOOLEAN", F.to_json(v)).when(kind.isin("BIGINT"), "integer")
        .when(kind.startswith("DECIMAL") | (kind == "DOUBLE"), "real").when(kind == "STRING", "text").when(kind.startswith("ARRAY"), "array").when(kind.startswith("OBJECT"), "object")
    )


def json_quote(c: Column, kind: str = "string") -> Column:
    """A scalar as JSON."""
    quoted = F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r"^\{\"v\":(?s:(.*))\}$", 1) if kind == "string" else c.cast("string")
    return F.when(c.isNull(), "null").otherwise(quoted)


# --- regular expressions -------------------------------------------------

def regexp_substr(t: Column, p: str, start: int = 1, nth: int = 1, group: int = 0) -> Column:
    """The nth match, '' if there is none."""
    found = F.regexp_extract_all(F.substring(t, F.lit(start), F.length(t)), F.lit(p), F.lit(group))
    return F.when(t.isNotNull(), F.coalesce(F.get(found, F.lit(nth - 1)), F.lit("")))


def regexp_count(t: Column, p: str, start: int = 1) -> Column:
    return F.regexp_count(F.substring(t, F.lit(start), F.length(t)), F.lit(p)).cast("long")


def regexp_instr(t: Column, p: str, start: int = 1, nth: int = 1, end: bool = False) -> Column:
    """Byte position from 1 of the nth match (or of what follows it); 0 if there is none."""
    s = F.substring(t, F.lit(start), F.length(t))
    parts, found = F.split(s, p, -1), F.regexp_extract_all(s, F.lit(p), F.lit(0))
    head = F.octet_length(F.substring(t, F.lit(1), F.lit(start - 1)))
    lead = F.octet_length(F.concat(F.array_join(F.slice(parts, 1, nth), ""), F.array_join(F.slice(found, 1, nth - 1), "") if nth > 1 else F.lit("")))
    at = head + lead + 1 + (F.octet_length(F.get(found, F.lit(nth - 1))) if end else 0)
    return F.when(F.size(found) >= nth, at).otherwise(F.when(t.isNotNull(), 0)).cast("long")


def literal_prefix(p: str) -> str:
    """The literal text that every match of an anchored pattern starts with; '' if it isn't anchored."""
    if not p.startswith("^"):
        return ""
    x = re.match(r"\^((?:[^\\.^$*+?()\[\]{}|]|\\[^\w\s])*)", p)
    got, rest = x[1], p[x.end() :]
    if "|" in p:
        return ""
    if rest[:1] in ("*", "?", "{") and got:
        got = got[:-2] if len(got) > 1 and got[-2] == "\\" else got[:-1]
    return re.sub(r"\\(.)", r"\1", got)


def prefix_rlike(t: Column, p: str) -> Column:
    """rlike with the literal prefix as a test that the Parquet scan can use."""
    prefix = literal_prefix(p)
    return t.startswith(prefix) & t.rlike(p) if prefix else t.rlike(p)


# --- encodings that the engine has ---------------------------------------

def base64url(b: Column) -> Column:
    return F.translate(F.base64(b), "+/", "-_")


def md5_raw(x: Column) -> Column:
    return F.unhex(F.md5(x))


def soundex(s: Column) -> Column:
    """Letters only; '' has no code."""
    letters = F.regexp_replace(s, "[^A-Za-z]", "")
    return F.when(letters != "", F.soundex(letters)).otherwise(F.when(s.isNotNull(), ""))


def hamming(a: Column, b: Column) -> Column:
    """Places that differ; unequal lengths are an error."""
    cut = lambda s: F.filter(F.split(s, ""), lambda x: x != "")
    n = F.aggregate(F.zip_with(cut(a), cut(b), lambda x, y: (~x.eqNullSafe(y)).cast("long")), F.lit(0).cast("long"), lambda acc, x: acc + x)
    return F.when(F.length(a) == F.length(b), n).when(a.isNotNull() & b.isNotNull(), F.raise_error(F.lit("hamming: lengths differ")).cast("long"))


def lsmode(mode: Column) -> Column:
    """Permission bits as text, such as drwxr-xr-x."""
    bit = lambda b, c: F.when(mode.bitwiseAND(F.lit(b)) != 0, c).otherwise("-")
    kind = F.when(mode.bitwiseAND(F.lit(0o170000)) == 0o040000, "d").when(mode.bitwiseAND(F.lit(0o170000)) == 0o120000, "l").otherwise("-")
    return F.concat(kind, *[bit(1 << (8 - i), "rwx"[i % 3]) for i in range(9)])


# --- clocks --------------------------------------------------------------

def time_now() -> Column:
    """The moment in UTC, such as 2024-01-02T03:04:05.000006Z."""
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def now_as(kind: str = "utc") -> Column:
    """The moment as a time without zone: in UTC, or for localtime in the session's zone."""
    if kind not in ("utc", "localtime"):
        raise ValueError(f"now_as: {kind!r} isn't known")
    t = F.current_timestamp()
    return (F.to_utc_timestamp(t, F.current_timezone()) if kind == "utc" else t).cast("timestamp_ntz")


def time_unix(t: Column) -> Column:
    return F.unix_seconds(t.cast("timestamp"))


def time_from_unix(n: Column) -> Column:
    """Seconds since the epoch as text in UTC."""
    return F.date_format(F.to_utc_timestamp(F.timestamp_seconds(n), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def like_unicode(s: Column, pattern: str, escape: str | None = None) -> Column:
    """LIKE for any script: case is folded, _ is a character, % any text with line ends."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if escape and c == escape and i + 1 < len(pattern):
            i += 1
            out += re.escape(pattern[i])
        else:
            out += {"%": ".*", "_": "."}.get(c) or re.escape(c)
        i += 1
    return s.rlike(rf"(?isu)\A{out}\z")


# --- UUID texts ----------------------------------------------------------

def uuid_str(u: Column) -> Column:
    """Canonical text of a UUID in any usual spelling."""
    h = F.regexp_replace(F.lower(u), r"[^0-9a-f]", "")
    return F.when(F.length(h) == 32, F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"))


def uuid_blob(u: Column) -> Column:
    return F.unhex(F.replace(uuid_str(u), F.lit("-")))


def uuid_version(u: Column) -> Column:
    return F.conv(F.substring(uuid_str(u), 15, 1), 16, 10).cast("long")


def uuid_timestamp(u: Column) -> Column:
    """Seconds since the epoch of versions 1, 6 and 7, else NULL."""
    h = F.replace(uuid_str(u), F.lit("-"))
    num = lambda *parts: F.conv(F.concat(*[F.substring(h, a, n) for a, n in parts]), 16, 10).cast("decimal(20,0)").cast("long")
    v = uuid_version(u)
    ticks = F.when(v == 1, num((14, 3), (9, 4), (1, 8))).when(v == 6, num((1, 12), (14, 3)))
    return F.when(v == 7, F.floor(num((1, 12)) / 1000)).otherwise(F.floor((ticks - 122_192_928_000_000_000) / 10_000_000)).cast("long")


def uuid_domain(u: Column) -> Column:
    """person, group or org of version 2, else NULL."""
    d = F.conv(F.substring(uuid_str(u), 22, 2), 16, 10).cast("int")
    return F.when(uuid_version(u) == 2, F.get(F.array(F.lit("person"), F.lit("group"), F.lit("org")), d))


def uuid_id(u: Column) -> Column:
    """The local id of version 2, else NULL."""
    return F.when(uuid_version(u) == 2, F.conv(F.substring(uuid_str(u), 1, 8), 16, 10).cast("long"))


# --- IPv4 ----------------------------------------------------------------

def ipfamily(a: Column) -> Column:
    """4 or 6, of an address, prefix or address with port."""
    return F.when(a.rlike(r"^\d+\.\d+\.\d+\.\d+(:\d+)?(/\d+)?$"), 4).when(F.instr(a, ":") > 0, 6).cast("long")


def ipv4_number(a: Column) -> Column:
    p = F.split(F.split_part(F.split_part(a, F.lit("/"), F.lit(1)), F.lit(":"), F.lit(1)), "\\.")
    return F.aggregate(F.transform(p, lambda x: x.cast("long")), F.lit(0).cast("long"), lambda acc, x: acc * 256 + x)


def ipmasklen(p: Column) -> Column:
    return F.split_part(p, F.lit("/"), F.lit(2)).cast("long")


def ipv4_contains(prefix: Column, ip: Column) -> Column:
    shift = (32 - ipmasklen(prefix)).cast("int")
    cut = lambda n: F.call_function("shiftright", n, shift)
    return cut(ipv4_number(prefix)) == cut(ipv4_number(ip))


# --- exact decimals ------------------------------------------------------

def plain(d: Column) -> Column:
    """Decimal text without zeros at its end."""
    s = d.cast("string")
    return F.when(F.instr(s, ".") > 0, F.regexp_replace(F.regexp_replace(s, "0+$", ""), "\\.$", "")).otherwise(s)


def decimal_cmp(a: Column, b: Column) -> Column:
    return F.when(a > b, 1).when(a < b, -1).when(a == b, 0).cast("long")


def money(x: Column) -> Column:
    """Two places, half away from zero, as text."""
    return F.round(x.cast("decimal(38,6)"), 2).cast("decimal(36,2)").cast("string")


def money_add(a: Column, b: Column) -> Column:
    return money(a.cast("decimal(38,6)") + b.cast("decimal(38,6)"))


def money_sub(a: Column, b: Column) -> Column:
    return money(a.cast("decimal(38,6)") - b.cast("decimal(38,6)"))


def money_format(x: Column, symbol: str = "$") -> Column:
    d = F.round(x.cast("decimal(38,6)"), 2).cast("decimal(36,2)")
    return F.concat(F.when(d < 0, "-").otherwise(""), F.lit(symbol), F.format_number(F.abs(d), 2))


#: Caverphone 2.0 in order: what is replaced by what; 2 marks a silent place, 3 a vowel.
_CAVERPHONE = [
    ("[^a-z]", ""), ("^cough", "cou2f"), ("^rough", "rou2f"), ("^tough", "tou2f"), ("^enough", "enou2f"), ("^trough", "trou2f"), ("^gn", "2n"), ("mb$", "m2"),
    ("cq", "2q"), ("ci", "si"), ("ce", "se"), ("cy", "sy"), ("tch", "2ch"), ("c", "k"), ("q", "k"), ("x", "k"), ("v", "f"), ("dg", "2g"), ("tio", "sio"), ("tia", "sia"), ("d", "t"), ("ph", "fh"), ("b", "p"), ("sh", "s2"), ("z", "s"),
    ("^[aeiou]", "A"), ("[aeiou]", "3"), ("j", "y"), ("^y3", "Y3"), ("^y", "A"), ("y", "3"), ("3gh3", "3kh3"), ("gh", "22"), ("g", "k"), ("s+", "S"), ("t+", "T"), ("p+", "P"), ("k+", "K"), ("f+", "F"), ("m+", "M"), ("n+", "N"),
    ("w3", "W3"), ("wh3", "Wh3"), ("w$", "3"), ("w", "2"), ("^h", "A"), ("h", "2"), ("r3", "R3"), ("r$", "3"), ("r", "2"), ("l3", "L3"), ("l$", "3"), ("l", "2"), ("2", ""), ("3$", "A"), ("3", ""),
]


def caverphone(s: Column) -> Column:
    """Caverphone 2.0 with a final e sounded, ten characters; a text without letters is all 1."""
    out = F.lower(s)
    for p, r in _CAVERPHONE:
        out = F.regexp_replace(out, p, r)
    return F.substring(F.concat(out, F.lit("1111111111")), 1, 10)
