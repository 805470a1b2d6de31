"""Format-preserving pseudonyms for personal data, by keyed Feistel networks in column expressions.

Every value is validated (checksums, calendar, ranges) and permuted inside its own format under a secret key, so the same
value gets the same pseudonym in every document and no table of pairs is kept. Separators stay where they were.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

ROUNDS = 8

# Characters of an IBAN by country; what follows a value is never taken into it. Other countries: the longest end that is valid.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL SD FK", 19: "MK SI", 20: "AT BA EE KZ LT LU XK MN", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM TL SO", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
KNOWN_IBAN = "|".join(f"(?:{c.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items())

# Candidates by kind, in the order in which they are tried at a position; lengths are bounded so that no search backtracks far.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}",
    "access_key": r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])(?=[A-Z]{2}[0-9]{2})(?:" + KNOWN_IBAN + r"|[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})(?![A-Za-z0-9])",
    "ip": r"(?<![0-9.])[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?![0-9]|\.[0-9])",
    "iso_date": r"(?<![0-9-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9-])",
    "day_date": r"(?<![0-9.])[0-9]{2}\.[0-9]{2}\.[0-9]{4}(?![0-9]|\.[0-9])",
    "month_date": r"(?<![0-9/])[0-9]{2}/[0-9]{2}/[0-9]{4}(?![0-9/])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9A-Za-z+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}(?![0-9])"
    r"|(?<![0-9A-Za-z(])(?:\([0-9]{3}\) ?|[0-9]{3}-)[0-9]{3}-[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9-])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])",
}
CANDIDATE = "|".join(f"(?:{p})" for p in PATTERNS.values())
MAYBE = r"@|AKIA|[0-9][0-9 ./()-]{5,}[0-9]|[A-Z]{2}[0-9]{2}"  # every candidate has such a part


def _noise(key: str, tag: str, round_: Column, *seen: Column) -> Column:
    """48 keyed bits that depend on the round and on the half that is not changed."""
    text = F.concat_ws("|", F.lit(key), F.lit(tag), round_.cast("string"), *[s.cast("string") for s in seen])
    return F.conv(F.substring(F.sha2(text, 256), 1, 12), 16, 10).cast("bigint")


def _halves(x: Column, y: Column, a: Column, b: Column, key: str, tag: str) -> Column:
    """Permutes the pair (x, y) of {0..a-1} x {0..b-1}; struct x, y."""

    def turn(acc: Column, r: Column) -> Column:
        even = r % 2 == 0
        return F.struct(
            F.when(even, (acc["x"] + _noise(key, tag, r, acc["y"])) % a).otherwise(acc["x"]).alias("x"),
            F.when(even, acc["y"]).otherwise((acc["y"] + _noise(key, tag, r, acc["x"])) % b).alias("y"),
        )

    start = F.struct(x.cast("bigint").alias("x"), y.cast("bigint").alias("y"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)


def _code(c: Column, low: str, size: int, h: Column) -> Column:
    return F.chr(F.lit(ord(low)) + (F.ascii(c) - ord(low) + h) % size)


def _like(text: Column, key: str, tag: str) -> Column:
    """Permutes a text among those with digits, capitals and small letters in the same places."""

    def mixed(x: Column, y: Column, r: Column) -> Column:
        def shift(c: Column, i: Column) -> Column:
            h = _noise(key, tag, r, y, i)
            return (
                F.when(c.between("0", "9"), _code(c, "0", 10, h))
                .when(c.between("a", "z"), _code(c, "a", 26, h))
                .when(c.between("A", "Z"), _code(c, "A", 26, h))
                .otherwise(c)
            )

        return F.array_join(F.transform(F.split(x, ""), shift), "")

    def turn(acc: Column, r: Column) -> Column:
        even = r % 2 == 0
        return F.struct(
            F.when(even, mixed(acc["x"], acc["y"], r)).otherwise(acc["x"]).alias("x"),
            F.when(even, acc["y"]).otherwise(mixed(acc["y"], acc["x"], r)).alias("y"),
        )

    half = F.floor(F.length(text) / 2).cast("int")
    start = F.struct(F.substr(text, F.lit(1), half).alias("x"), F.substr(text, half + 1, F.length(text)).alias("y"))
    done = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)
    return F.concat(done["x"], done["y"])


def _filled(template: Column, symbols: Column, kept: str) -> Column:
    """The template with its characters of the class ``kept`` replaced by ``symbols`` in order."""
    start = F.struct(F.lit("").alias("s"), F.lit(1).alias("k"))

    def put(acc: Column, c: Column) -> Column:
        hit = c.rlike(kept)
        return F.struct(
            F.concat(acc["s"], F.when(hit, F.substr(symbols, acc["k"], F.lit(1))).otherwise(c)).alias("s"),
            F.when(hit, acc["k"] + 1).otherwise(acc["k"]).alias("k"),
        )

    return F.aggregate(F.split(template, ""), start, put)["s"]


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Checksum of the digits; 0 for a valid number."""

    def add(s: Column, i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i, F.lit(1)).cast("int") * (1 + i % 2)
        return s + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10


def _mod97(text: Column) -> Column:
    """Remainder by 97 of an account number read with letters as 10 to 35."""

    def add(acc: Column, c: Column) -> Column:
        return F.when(c.between("0", "9"), (acc * 10 + (F.ascii(c) - 48)) % 97).otherwise((acc * 100 + (F.ascii(c) - 55)) % 97)

    return F.aggregate(F.split(text, ""), F.lit(0), add)


def _valid_iban(m: Column) -> Column:
    plain = F.regexp_replace(m, " ", "")
    return (F.length(plain) >= 15) & (_mod97(F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4)))) == 1)


def _valid_card(m: Column) -> Column:
    d = _digits(m)
    return (F.length(d) >= 13) & (_luhn(d) == 0) & d.rlike("[1-9]")


def _valid_end(m: Column, valid) -> Column:
    """Length of the longest valid beginning of a candidate that ends before a separator or with the candidate; null if none."""
    n = F.length(m)
    ends = F.filter(F.sequence(F.lit(13), n), lambda e: (e == n) | F.substr(m, e + 1, F.lit(1)).isin(" ", "-"))
    return F.array_max(F.filter(ends, lambda e: valid(F.substr(m, F.lit(1), e))))


def _email(m: Column, key: str) -> Column:
    return F.concat(_like(F.substring_index(m, "@", 1), key, "email"), F.lit("@"), F.substring_index(m, "@", -1))


def _access_key(m: Column, key: str) -> Column:
    return F.concat(F.lit("AKIA"), _like(F.substr(m, F.lit(5)), key, "access_key"))


def _iban(m: Column, key: str) -> Column:
    plain = F.regexp_replace(m, " ", "")
    country, body = F.substr(plain, F.lit(1), F.lit(2)), F.substr(plain, F.lit(5))
    new = _like(body, key, "iban")
    check = F.lpad((F.lit(98) - _mod97(F.concat(new, country, F.lit("00")))).cast("string"), 2, "0")
    return _filled(m, F.concat(country, check, new), "[A-Z0-9]")


def _ip(m: Column, key: str) -> Column:
    o = F.split(m, r"\.")
    part = [F.get(o, F.lit(i)).cast("int") for i in range(4)]
    plain = ~m.rlike(r"(^|\.)0[0-9]")
    valid = reduce(lambda a, b: a & b, [p < 256 for p in part], plain)
    # One struct inside a one-element array: evaluated once, read twice.
    pair = F.array(_halves(part[0] * 256 + part[1], part[2] * 256 + part[3], F.lit(65536), F.lit(65536), key, "ip"))
    text = F.transform(pair, lambda p: F.concat_ws(".", *[x.cast("string") for x in (
        F.floor(p["x"] / 256), p["x"] % 256, F.floor(p["y"] / 256), p["y"] % 256)]))
    return F.when(valid, F.get(text, F.lit(0)))


def _date(iso: Column, pattern: str, key: str) -> Column:
    """A calendar day among those of its century."""
    day = iso.try_cast("date")
    century = F.floor(F.year(day) / 100).cast("int")
    leap = century % 4 == 0
    # Days of a century as a product, so that the permutation needs no second try: 75 * 487 and 92 * 397.
    a, b = F.when(leap, 75).otherwise(92), F.when(leap, 487).otherwise(397)
    first = F.make_date(century * 100, F.lit(1), F.lit(1))
    at = F.datediff(day, first)
    pair = F.array(_halves(F.floor(at / b), at % b, a, b, key, "date"))
    moved = F.transform(pair, lambda p: F.date_format(F.date_add(first, (p["x"] * b + p["y"]).cast("int")), pattern))
    return F.when(day.isNotNull() & F.year(day).between(1000, 2999), F.get(moved, F.lit(0)))


def _ssn(m: Column, key: str) -> Column:
    area, group, serial = [F.substr(m, F.lit(p), F.lit(n)).cast("int") for p, n in ((1, 3), (5, 2), (8, 4))]
    valid = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    rank = F.when(area > 666, area - 2).otherwise(area - 1)  # 898 areas
    pair = F.array(_halves(rank * 99 + group - 1, serial - 1, F.lit(898 * 99), F.lit(9999), key, "ssn"))

    def text(p: Column) -> Column:
        r = F.floor(p["x"] / 99)
        areas = F.when(r >= 665, r + 2).otherwise(r + 1)
        return F.concat_ws("-", F.lpad(areas.cast("string"), 3, "0"), F.lpad((p["x"] % 99 + 1).cast("string"), 2, "0"),
                           F.lpad((p["y"] + 1).cast("string"), 4, "0"))

    return F.when(valid, F.get(F.transform(pair, text), F.lit(0)))


def _phone(m: Column, key: str) -> Column:
    d = _digits(m)
    own = F.substr(d, F.length(d) - 9, F.lit(10))  # the last ten digits
    area, exchange, line = [F.substr(own, F.lit(p), F.lit(n)).cast("int") for p, n in ((1, 3), (4, 3), (7, 4))]
    lead = F.substr(d, F.lit(1), F.length(d) - 10)
    american = ((F.length(d) == 10) | ((F.length(d) == 11) & m.startswith("+1"))) & (area >= 200) & (exchange >= 200)
    x, y = (area - 200) * 100 + F.floor(line / 100), (exchange - 200) * 100 + line % 100
    pair = F.array(_halves(x, y, F.lit(80000), F.lit(80000), key, "phone"))

    def text(p: Column) -> Column:
        a, e = F.floor(p["x"] / 100) + 200, F.floor(p["y"] / 100) + 200
        return F.concat(lead, a.cast("string"), e.cast("string"), F.lpad(((p["x"] % 100) * 100 + p["y"] % 100).cast("string"), 4, "0"))

    country = F.least(F.lit(3), F.length(F.regexp_extract(m, r"^\+([0-9]+)", 1)))
    other = F.concat(F.substr(d, F.lit(1), country), _like(F.substr(d, country + 1, F.length(d)), key, "phone"))
    valid = american | (m.startswith("+") & F.length(d).between(8, 15))
    return F.when(valid, _filled(m, F.when(american, F.get(F.transform(pair, text), F.lit(0))).otherwise(other), "[0-9]"))


def _card(m: Column, key: str) -> Column:
    d = _digits(m)
    new = F.concat(F.substr(d, F.lit(1), F.lit(1)), _like(F.substr(d, F.lit(2), F.length(d) - 2), key, "card"))
    check = F.transform(F.array(new), lambda p: F.concat(p, ((F.lit(10) - _luhn(F.concat(p, F.lit("0")))) % 10).cast("string")))
    return _filled(m, F.get(check, F.lit(0)), "[0-9]")


def _beginning(m: Column, key: str, valid, new) -> Column:
    """The candidate with its longest valid beginning replaced; null if none is valid."""
    end = F.array(_valid_end(m, valid))
    return F.get(F.transform(end, lambda e: F.when(e.isNotNull(), F.concat(new(F.substr(m, F.lit(1), e), key), F.substr(m, e + 1, F.length(m))))), F.lit(0))


def _replacement(m: Column, key: str) -> Column:
    """struct(kind, text) of a candidate; the kind is null and the text unchanged where it is not valid."""
    day = F.concat_ws("-", F.substr(m, F.lit(7), F.lit(4)), F.substr(m, F.lit(4), F.lit(2)), F.substr(m, F.lit(1), F.lit(2)))
    month = F.concat_ws("-", F.substr(m, F.lit(7), F.lit(4)), F.substr(m, F.lit(1), F.lit(2)), F.substr(m, F.lit(4), F.lit(2)))
    new = {
        "email": _email(m, key), "access_key": _access_key(m, key), "iban": _beginning(m, key, _valid_iban, _iban), "ip": _ip(m, key),
        "iso_date": _date(m, "yyyy-MM-dd", key), "day_date": _date(day, "dd.MM.yyyy", key),
        "month_date": _date(month, "MM/dd/yyyy", key), "ssn": _ssn(m, key), "phone": _phone(m, key), "card": _beginning(m, key, _valid_card, _card),
    }
    # Lookarounds see only the candidate here; what they ask of its surroundings held when it was found.
    kind = reduce(lambda c, k: c.when(m.rlike(f"^(?:{PATTERNS[k]})$"), k), PATTERNS, F)

    def made(k: Column) -> Column:
        text = F.array(reduce(lambda c, name: c.when(k == name, new[name]), PATTERNS, F))
        return F.get(F.transform(text, lambda t: F.struct(F.when(t.isNotNull(), k).alias("kind"), F.coalesce(t, m).alias("text"))), F.lit(0))

    # Values that are read twice go through one-element arrays, so that they are computed once.
    return F.get(F.transform(F.array(kind), made), F.lit(0))


def pseudonymised(docs: DataFrame, key: str, text: str = "text", counts: str | None = None) -> DataFrame:
    """The documents with every validated value in ``text`` replaced; all columns and rows stay.

    ``counts`` names a new map column kind -> number of values replaced (empty where there are none); it must not clash.
    Null stays null, empty stays empty, invalid candidates stay as they are, equal values get equal pseudonyms.
    """
    t = F.col(f"`{text}`")
    found = F.when(t.rlike(MAYBE), F.regexp_extract_all(t, F.lit(CANDIDATE), F.lit(0)))
    names = {"found": "_pii_found", "new": "_pii_new"}
    staged = docs.withColumn(names["found"], found)
    new = F.when(F.size(names["found"]) > 0, F.transform(names["found"], lambda m: _replacement(m, key)))
    staged = staged.withColumn(names["new"], new)
    n = F.col(names["new"])
    parts = F.split(t, CANDIDATE, -1)
    joined = F.array_join(F.transform(parts, lambda p, i: F.concat(p, F.coalesce(F.get(n["text"], i), F.lit("")))), "")
    out = staged.withColumn(text, F.when(n.isNotNull(), joined).otherwise(t))
    if counts:
        per_kind = F.map_from_arrays(
            F.array(*[F.lit(k) for k in PATTERNS]),
            F.array(*[F.size(n["kind"]) - F.size(F.array_remove(F.transform(n["kind"], lambda k: F.coalesce(k, F.lit(""))), k)) for k in PATTERNS]))
        none = F.create_map().cast("map<string,int>")
        out = out.withColumn(counts, F.when(n.isNotNull(), F.map_filter(per_kind, lambda _, v: v > 0)).otherwise(none))
    return out.drop(*names.values())
