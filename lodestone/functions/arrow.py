"""Scalar functions that Spark's built-ins can't express, as Arrow-batched UDFs. NULL in gives NULL out."""

import base64
import functools
import hashlib
import ipaddress
import json
import re
import unicodedata
import uuid as _uuid
from decimal import ROUND_HALF_UP, Decimal, localcontext
from fractions import Fraction

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.functions import ArrowUDFType
from pyspark.sql.pandas.types import to_arrow_type


_TYPES = {"long": T.LongType(), "double": T.DoubleType(), "string": T.StringType(), "binary": T.BinaryType(), "boolean": T.BooleanType(), "array<string>": T.ArrayType(T.StringType())}


_ROWS = 256  # of a batch that are Python's at a time


def _udf(kind: str):
    """An Arrow UDF that isn't called for rows with a NULL argument."""

    def wrap(f):
        made_of = to_arrow_type(_TYPES[kind])

        def guarded(*a: pa.Array) -> pa.Array:
            parts = [pa.array([], made_of)]
            for low in range(0, len(a[0]), _ROWS):
                rows = zip(*[c.slice(low, _ROWS).to_pylist() for c in a], strict=True)
                parts.append(pa.array([None if any(x is None for x in r) else f(*r) for r in rows], made_of))
            return pa.concat_arrays(parts)

        guarded.__name__ = f.__name__
        made = F.arrow_udf(guarded, _TYPES[kind], ArrowUDFType.SCALAR)
        made.__doc__ = f.__doc__
        return made

    return wrap


# --- fuzzy ---------------------------------------------------------------

def osa(a, b) -> int:
    """Edit distance with swaps of neighbours, each place edited once."""
    two, one = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(one[j] + 1, row[-1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, two[j - 2] + 1)
            row.append(d)
        two, one = one, row
    return one[-1]


@_udf("long")
def damerau_levenshtein(a, b):
    return osa(a, b)


def jaro_of(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used, hits = [False] * len(b), []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == x:
                used[j] = True
                hits.append(x)
                break
    if not hits:
        return 0.0
    m = len(hits)
    t = sum(x != y for x, y in zip(hits, (b[j] for j in range(len(b)) if used[j]), strict=True)) // 2  # whole numbers
    return (m / len(a) + m / len(b) + (m - t) / m) / 3


@_udf("double")
def jaro(a, b):
    return jaro_of(a, b)


@_udf("double")
def jaro_winkler(a, b):
    """Prefix of up to 4, weight 0.1, without a threshold."""
    j = jaro_of(a, b)
    p = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4], strict=False)) if x != y), min(4, len(a), len(b)))
    return j + p * 0.1 * (1 - j)


# --- stemming ------------------------------------------------------------

#: Suffixes of Porter's steps 2 to 4, longest match first, with what takes their place.
_STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "logi": "log", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = {x: "" for x in "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()}


def _shape(w: str) -> str:
    """v and c for each vowel and consonant; y is a vowel after a consonant."""
    out = ""
    for i, x in enumerate(w):
        out += "v" if x in "aeiou" or (x == "y" and i and out[-1] == "c") else "c"
    return out


def _measure(w: str) -> int:
    return len(re.findall("v+c+", _shape(w)))


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c"


def _cvc(w: str) -> bool:
    return _shape(w)[-3:] == "cvc" and w[-1] not in "wxy"


def _swap(w: str, table: dict[str, str], least: int) -> str:
    for k in sorted((k for k in table if w.endswith(k)), key=len, reverse=True)[:1]:
        base = w[: -len(k)]
        if _measure(base) > least and (k != "ion" or base[-1:] in ("s", "t")):
            return base + table[k]
    return w


def stem(w: str) -> str:
    """Porter's stem of a lower-case word; words of other letters, of 2 or of over 64 characters stay."""
    if not 3 <= len(w) <= 64 or not (w.isascii() and w.isalpha()):
        return w
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        cut = next((k for k in ("ed", "ing") if w.endswith(k) and "v" in _shape(w[: -len(k)])), None)
        if cut:
            w = w[: -len(cut)]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif _double(w) and w[-1] not in "lsz":
                w = w[:-1]
            elif _measure(w) == 1 and _cvc(w):
                w += "e"
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    w = _swap(_swap(_swap(w, _STEP2, 0), _STEP3, 0), _STEP4, 1)
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _cvc(w[:-1])):
            w = w[:-1]
    return w[:-1] if _double(w) and w[-1] == "l" and _measure(w[:-1]) > 1 else w


@functools.lru_cache(1 << 18)
def _stem_kept(w: str) -> str:
    return stem(w)


def stem_words(words):
    """Stems of an array of words; a batch's words become Python's once each, and a worker keeps the stems of those it met last."""

    def of(batch: pa.Array) -> pa.Array:
        found = batch.values.dictionary_encode()
        stems = pa.array([None if w is None else _stem_kept(w) for w in found.dictionary.to_pylist()], pa.string())
        return pa.ListArray.from_arrays(batch.offsets, stems.take(found.indices), mask=batch.is_null() if batch.null_count else None)

    return F.arrow_udf(of, T.ArrayType(T.StringType()))(words)


# --- Unicode -------------------------------------------------------------

@_udf("string")
def casefold(s):
    """Full case folding."""
    return s.casefold()


@_udf("string")
def unaccent(s):
    if s.isascii():
        return s
    return unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", s) if unicodedata.category(c) != "Mn"))


@_udf("string")
def normalize(s, form):
    form = form.upper()
    return s if unicodedata.is_normalized(form, s) else unicodedata.normalize(form, s)


# --- encodings and hashes ------------------------------------------------

_TO_HEX32 = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", b"0123456789ABCDEFGHIJKLMNOPQRSTUV")


@_udf("string")
def encode(data, kind):
    """base64, base64url, base32, base32hex, base16, hex, ascii85, base85 or url; another kind is an error."""
    from urllib.parse import quote_plus

    made = {
        "base64": base64.b64encode, "base64url": base64.urlsafe_b64encode, "base32": base64.b32encode, "base32hex": lambda x: base64.b32encode(x).translate(_TO_HEX32),
        "base16": lambda x: x.hex().encode(), "hex": lambda x: x.hex().encode(), "ascii85": base64.a85encode, "base85": base64.a85encode, "url": lambda x: quote_plus(x).encode(),
    }
    if kind not in made:
        raise ValueError(f"encode: unknown format {kind!r}")
    return made[kind](bytes(data)).decode()


@_udf("binary")
def decode(text, kind):
    from urllib.parse import unquote_plus

    made = {
        "base64": base64.b64decode, "base64url": base64.urlsafe_b64decode, "base32": base64.b32decode, "base32hex": base64.b32hexdecode,
        "base16": bytes.fromhex, "hex": bytes.fromhex, "ascii85": base64.a85decode, "base85": base64.a85decode, "url": lambda x: unquote_plus(x).encode(),
    }
    if kind not in made:
        raise ValueError(f"decode: unknown format {kind!r}")
    return made[kind](text)


@_udf("binary")
def digest(data, kind):
    """Raw digest: ripemd160, sha512_224, sha512_256, sha3_224 .. sha3_512, blake2s, blake2b and hashlib's others."""
    return hashlib.new(kind, bytes(data)).digest()


@_udf("binary")
def xxh64(data):
    """Seed 0, big-endian."""
    return xxhash.xxh64(bytes(data)).digest()


# --- UUID ----------------------------------------------------------------

_SPACES = {"dns": _uuid.NAMESPACE_DNS, "fqdn": _uuid.NAMESPACE_DNS, "url": _uuid.NAMESPACE_URL, "oid": _uuid.NAMESPACE_OID, "x500": _uuid.NAMESPACE_X500}


def _space(ns: str) -> _uuid.UUID:
    return _SPACES.get(ns.lower()) or _uuid.UUID(ns)


@_udf("string")
def uuid3(ns, name):
    return str(_uuid.uuid3(_space(ns), name))


@_udf("string")
def uuid5(ns, name):
    return str(_uuid.uuid5(_space(ns), name))


def uuid_now(version: int):
    """A random or time-based UUID per row: versions 1, 4, 6, 7."""

    def make(_):
        import os
        import time

        if version in (1, 6):
            u = _uuid.uuid1()
            if version == 1:
                return str(u)
            t = (u.time_hi_version & 0x0FFF) << 48 | u.time_mid << 32 | u.time_low
            return str(_uuid.UUID(int=(t >> 12) << 80 | 6 << 76 | (t & 0xFFF) << 64 | (u.int & (2**64 - 1))))
        if version == 7:
            raw = int.from_bytes(os.urandom(10)) & (2**76 - 1)
            v = time.time_ns() // 1_000_000 << 80 | raw
            return str(_uuid.UUID(int=v & ~(0xF << 76) & ~(3 << 62) | 7 << 76 | 2 << 62))
        return str(_uuid.uuid4())

    return F.udf(make, T.StringType(), useArrow=True).asNondeterministic()


@_udf("string")
def uuid2(domain, ident):
    """DCE security UUID of a domain (person, group, org or 0, 1, 2) and a 32-bit id."""
    d = {"person": 0, "group": 1, "org": 2}.get(str(domain).lower())
    d = int(domain) if d is None else d
    u = _uuid.uuid1()
    return str(_uuid.UUID(fields=(int(ident) & 0xFFFFFFFF, u.time_mid, (u.time_hi_version & 0x0FFF) | 0x2000, u.clock_seq_hi_variant, d, u.node)))


# --- IP ------------------------------------------------------------------

def _host(a: str) -> str:
    a = a.split("/")[0]
    if a.startswith("["):
        return a[1 : a.index("]")]
    return a.split(":")[0] if a.count(":") == 1 else a


@_udf("boolean")
def ipcontains(prefix, ip):
    n, a = ipaddress.ip_network(prefix, strict=False), ipaddress.ip_address(_host(ip))
    return n.version == a.version and a in n


@_udf("boolean")
def ipoverlaps(p, q):
    a, b = (ipaddress.ip_network(x, strict=False) for x in (p, q))
    return a.version == b.version and a.overlaps(b)


@_udf("string")
def iphost(a):
    return str(ipaddress.ip_address(_host(a)))


@_udf("string")
def ipnetwork(p):
    return str(ipaddress.ip_network(p, strict=False))


# --- decimals of any precision -------------------------------------------

def to_fraction(x) -> Fraction:
    s = str(x).strip()
    return Fraction(s)


def fraction_text(q: Fraction, places: int = 30) -> str:
    """Exact if the decimals end, else `places` of them, half away from zero; no zeros at the end."""
    d = q.denominator
    twos = fives = 0
    while d % 2 == 0:
        d, twos = d // 2, twos + 1
    while d % 5 == 0:
        d, fives = d // 5, fives + 1
    n = max(twos, fives) if d == 1 else places
    return _fixed(q, n).rstrip("0").rstrip(".") if n else str(q.numerator // q.denominator)


def _fixed(q: Fraction, n: int) -> str:
    scaled = abs(q) * 10**n
    whole = (2 * scaled.numerator + scaled.denominator) // (2 * scaled.denominator)
    s = str(whole).rjust(n + 1, "0")
    s = f"{s[:-n]}.{s[-n:]}" if n else s
    return f"-{s}" if q < 0 and whole else s


@_udf("string")
def decimal_text(x):
    return fraction_text(to_fraction(x))


@_udf("string")
def decimal_add(a, b):
    return fraction_text(to_fraction(a) + to_fraction(b))


@_udf("string")
def decimal_sub(a, b):
    return fraction_text(to_fraction(a) - to_fraction(b))


@_udf("string")
def decimal_mul(a, b):
    return fraction_text(to_fraction(a) * to_fraction(b))


@_udf("string")
def decimal_div(a, b):
    """30 places where the quotient doesn't end; division by zero is an error."""
    return fraction_text(to_fraction(a) / to_fraction(b))


@_udf("string")
def decimal_round(x, n):
    return _fixed(to_fraction(x), max(0, n))


@F.pandas_udf(T.StringType())
def decimal_sum(v: pd.Series) -> str:
    """Exact sum as text; '0' of nothing."""
    return fraction_text(sum((to_fraction(x) for x in v.dropna()), Fraction(0)))


def money_mul_text(a, b) -> str:
    with localcontext() as c:
        c.prec = 60
        return str((Decimal(a) * Decimal(b)).quantize(Decimal("0.01"), ROUND_HALF_UP))


money_mul = _udf("string")(money_mul_text)


# --- JSON with any path --------------------------------------------------

def _steps(path: str) -> list:
    return [int(i) if i else k for k, i in re.findall(r'\.("[^"]*"|[^.\[]+)|\[(\d+)\]', path) for k in [k.strip('"')]]


def _edit(j: str, path: str, value: str | None, how: str) -> str:
    doc, steps = json.loads(j), _steps(path)
    if not steps:
        return json.dumps(json.loads(value), separators=(",", ":"), ensure_ascii=False) if how in ("set", "replace") else j
    at = doc
    for s in steps[:-1]:
        try:
            at = at[s]
        except (KeyError, IndexError, TypeError):
            return json.dumps(doc, separators=(",", ":"), ensure_ascii=False)
    last = steps[-1]
    there = last in at if isinstance(at, dict) else isinstance(last, int) and isinstance(at, list) and last < len(at)
    if how == "remove":
        if there:
            del at[last]
    elif (there and how in ("set", "replace")) or (not there and how in ("set", "insert")):
        if isinstance(at, list) and not there:
            if last == len(at):
                at.append(json.loads(value))
        else:
            at[last] = json.loads(value)
    return json.dumps(doc, separators=(",", ":"), ensure_ascii=False)


def json_edit(how: str):
    """set, insert, replace (json, path, value as JSON) or remove (json, path)."""
    if how == "remove":
        return _udf("string")(lambda j, p: _edit(j, p, None, "remove"))
    return _udf("string")(lambda j, p, v: _edit(j, p, v, how))


# --- regular expressions -------------------------------------------------

@_udf("string")
def regexp_replace_nth(t, p, r, nth):
    """Replaces the nth match (all for 0); $1 and ${name} stand for groups."""
    repl = re.sub(r"\$\{(\w+)\}|\$(\d+)", lambda m: rf"\g<{m[1] or m[2]}>", r)
    if nth <= 0:
        return re.sub(p, repl, t)
    for i, m in enumerate(re.finditer(p, t), 1):
        if i == nth:
            return t[: m.start()] + m.expand(repl) + t[m.end() :]
    return t
