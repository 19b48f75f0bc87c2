"""Format-preserving pseudonyms of personal data; DataFrame functions only.

One scan finds e-mail addresses, payment cards, telephone numbers, IPv4 and IPv6 addresses, social security numbers, IBANs
and dates. What validates (Luhn, ISO 7064, octets to 255, issued area numbers, calendar dates) is permuted by a keyed Feistel
network within its format: digits stay digits and letters letters of their case, cards keep their first digit and IBANs
their country and both get valid check digits, octets stay octets, addresses keep their top-level domain, dates stay dates of
1900-2099 in the same notation (dd/mm, or mm/dd where the day is above 12). The permutation depends on the key and the format
alone, so equal values get equal pseudonyms in every document, and different values of a format different ones. What doesn't
validate is left alone, as are telephone numbers without any sign of being one (ten bare digits).

The key is the caller's to keep: whoever has it can undo the permutation. The query takes it from the session's
``spark.foliospark.pii.key``; only where that is unset, as in tests, a demonstration key stands in.

Cases: null text stays null and has no counts (0); texts without hits stay as they are, byte for byte; repeated
rows and ids give a row each; other columns stay, but for ``pii``, which is set; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

KEY_SETTING, DEMO_KEY = "spark.foliospark.pii.key", "demonstration only"
ROUNDS = 8
#: Alternatives in order of precedence at one place; each is one group.
PATTERNS = {
    "email": r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])",
    "ipv6": r"(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![0-9A-Za-z:]|\.[0-9])",
    "date": r"(?<![0-9A-Za-z/-])(?:(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/(?:19|20)[0-9]{2})(?![0-9/-])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "card": r"(?<![0-9A-Za-z])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])",
    "phone": r"(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|(?<![0-9])[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])"
    r"|\+[1-9](?:[ .-]?\(?[0-9]\)?){7,14}(?![0-9])|(?<![0-9A-Za-z.,+-])0[0-9]{2,4}[ -][0-9]{3,4}[ -]?[0-9]{3,4}(?![0-9])",
}
# From its 14th digit on a card ends where something of another kind begins, so that it does not swallow that.
_OTHERS = "|".join(p for n, p in PATTERNS.items() if n != "card")
PATTERNS["card"] = rf"(?<![0-9A-Za-z])[0-9](?:[ -]?[0-9]){{12}}(?:[ -]?(?!{_OTHERS})[0-9]){{0,6}}(?![0-9A-Za-z])"
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
CLASSES, HEX_LOWER, HEX_UPPER = (LOWER, UPPER, DIGITS), (DIGITS + LOWER[:6],), (DIGITS + UPPER[:6],)


def _stream(key: str, label: str, rnd: Column, data: Column) -> Column:
    """64 hex digits of the round function: a hash of the key, the format, the round and the other half, hashed again with the key."""
    head = F.concat(F.lit(f"{key}|{label}|"), rnd.cast("string"), F.lit("|"))
    return F.sha2(F.concat(F.lit(f"{key}|{label}|"), F.sha2(F.concat(head, data), 256)), 256)


def _number(stream: Column) -> Column:
    return F.conv(F.substring(stream, 1, 13), 16, 10).cast("long")


def _shift(char: Column, by: Column, classes: tuple[str, ...]) -> Column:
    """A character moved within its class; others stay."""
    out = char
    for alphabet in classes:
        spot = F.instr(F.lit(alphabet), char)
        moved = F.substr(F.lit(alphabet), F.pmod(spot - 1 + by, F.lit(len(alphabet))) + 1, F.lit(1))
        out = F.when(spot > 0, moved).otherwise(out)
    return out


def _let(value: Column, body) -> Column:
    """Binds a value once: a lambda variable is not evaluated anew for each use, and the plan stays small."""
    return F.transform(F.array(value), body)[0]


def _rounds() -> Column:
    return F.array(*[F.lit(i) for i in range(ROUNDS)])


def permute_text(value: Column, label: str, key: str, classes: tuple[str, ...] = CLASSES) -> Column:
    """A Feistel network over the two halves of a string, adding key-stream digits within each character's class.

    In each round the half that moves is shifted by a stream made from the other half, so every round can be undone.
    """
    def shifted(target, stream):
        wide = F.concat(stream, F.sha2(stream, 256))  # 32 places of 4 hex digits
        def moved(wide):
            def at(c, i):
                return _let(F.conv(F.substr(wide, F.pmod(i, F.lit(32)) * 4 + 1, F.lit(4)), 16, 10).cast("int"), lambda by: _shift(c, by, classes))
            return F.array_join(F.transform(F.filter(F.split(target, ""), lambda c: c != ""), at), "")
        return _let(wide, moved)
    def halves(v):
        half = F.floor(F.length(v) / 2).cast("int")
        begin = F.struct(F.substr(v, F.lit(1), half).alias("a"), F.substr(v, half + 1, F.length(v)).alias("b"))
        return F.aggregate(
            _rounds(), begin, lambda s, r: F.struct(s["b"].alias("a"), shifted(s["a"], _stream(key, label, r, s["b"])).alias("b")), lambda s: F.concat(s["a"], s["b"])
        )
    return _let(value, halves)


def permute_pair(a: Column, b: Column, n_a: int, n_b: int, label: str, key: str) -> Column:
    """struct<a, b>: a Feistel network over [0, n_a) x [0, n_b) by modular addition."""
    def step(s, r):
        def add(to, of, n):
            return F.pmod(to + F.pmod(_number(_stream(key, label, r, of.cast("string"))), F.lit(n)), F.lit(n))
        return F.when(r % 2 == 0, F.struct(s["a"].alias("a"), add(s["b"], s["a"], n_b).alias("b"))).otherwise(F.struct(add(s["a"], s["b"], n_a).alias("a"), s["b"].alias("b")))
    return F.aggregate(_rounds(), F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")), step)


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of a string of digits whose last one is the check digit."""
    chars = F.reverse(F.filter(F.split(digits, ""), lambda c: c != ""))
    worth = F.transform(
        chars,
        lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)),
    )
    return F.aggregate(worth, F.lit(0), lambda s, x: s + x)


def _refill(mask: Column, digits: Column, places: str = "[0-9]") -> Column:
    """Puts digits, in turn, where the mask has digits (or what ``places`` matches): the separators stay."""
    chars = F.filter(F.split(mask, ""), lambda c: c != "")
    done = F.aggregate(
        chars,
        F.struct(F.lit("").alias("out"), F.lit(1).alias("at")),
        lambda s, c: F.when(
            c.rlike(places), F.struct(F.concat(s["out"], F.substr(digits, s["at"], F.lit(1))).alias("out"), (s["at"] + 1).alias("at"))
        ).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["at"].alias("at"))),
    )
    return done["out"]


def _only_digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _card(m: Column, key: str) -> Column:
    def body(d):
        first, rest = F.substr(d, F.lit(1), F.lit(1)), F.substr(d, F.lit(2), F.length(d) - 2)
        def checked(payload):
            return _refill(m, F.concat(payload, F.pmod(-luhn_sum(F.concat(payload, F.lit("0"))), F.lit(10)).cast("string")))
        return _let(F.concat(first, permute_text(rest, "card", key)), checked)
    return _let(_only_digits(m), body)


def _valid_card(m: Column) -> Column:
    """struct<at, card>: the first, longest run of whole groups of digits that is a card, since an expiry date or a
    security code may stand next to it; null without any."""
    def spans(c):
        n = F.length(c)
        edge = lambda i: F.substr(c, i, F.lit(1)).rlike("^[ -]?$")
        every = F.sequence(F.lit(1), n)
        starts = F.filter(every, lambda i: (i == 1) | edge(i - 1))
        ends = F.reverse(F.filter(every, lambda i: (i == n) | edge(i + 1)))
        each = F.transform(starts, lambda a: F.transform(ends, lambda e: F.struct(a.alias("at"), F.substr(c, a, F.greatest(e - a + 1, F.lit(0))).alias("card"))))
        def good(x):
            return _let(_only_digits(x["card"]), lambda d: F.length(d).between(13, 19) & (F.pmod(luhn_sum(d), F.lit(10)) == 0) & ~d.rlike("^0+$"))
        return F.get(F.filter(F.flatten(each), good), F.lit(0))
    return _let(m, spans)


def _card_within(m: Column, key: str) -> Column:
    def body(v):
        return F.concat(F.substr(m, F.lit(1), v["at"] - 1), _card(v["card"], key), F.substr(m, v["at"] + F.length(v["card"]), F.length(m)))
    return _let(_valid_card(m), body)


def _octets(m: Column) -> Column:
    return F.transform(F.split(m, r"\."), lambda x: x.cast("int"))


def _ip(m: Column, key: str) -> Column:
    def body(o):
        return permute_pair(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, "ip", key)
    def written(p):
        return F.concat_ws(".", F.floor(p["a"] / 256), F.pmod(p["a"], F.lit(256)), F.floor(p["b"] / 256), F.pmod(p["b"], F.lit(256)))
    return _let(_let(_octets(m), body), written)


def _hex(m: Column, key: str) -> Column:
    """The hexadecimal digits of an address in its own case; colons stay."""
    return F.when(m.rlike("[A-F]"), permute_text(m, "ipv6", key, HEX_UPPER)).otherwise(permute_text(m, "ipv6", key, HEX_LOWER))


def _mod97(text: Column) -> Column:
    """ISO 7064: letters count as 10 to 35."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    worth = lambda c: F.instr(F.lit(DIGITS + UPPER), c) - 1
    return F.aggregate(chars, F.lit(0), lambda s, c: F.pmod(F.when(worth(c) < 10, s * 10 + worth(c)).otherwise(s * 100 + worth(c)), F.lit(97)))


def _turned(c: Column) -> Column:
    return F.concat(F.substr(c, F.lit(5)), F.substr(c, F.lit(1), F.lit(4)))


def _valid_iban(m: Column) -> Column:
    return _let(F.regexp_replace(m, " ", ""), lambda c: F.length(c).between(15, 34) & (_mod97(_turned(c)) == 1))


def _iban(m: Column, key: str) -> Column:
    def written(body):
        country = F.substr(m, F.lit(1), F.lit(2))
        check = F.lpad((98 - _mod97(F.concat(body, country, F.lit("00")))).cast("string"), 2, "0")
        return _refill(m, F.concat(country, check, body), "[0-9A-Z]")
    return _let(permute_text(F.substr(F.regexp_replace(m, " ", ""), F.lit(5)), "iban", key), written)


def _as_date(m: Column) -> Column:
    return F.coalesce(F.try_to_date(m, "yyyy-MM-dd"), F.try_to_date(m, "dd/MM/yyyy"), F.try_to_date(m, "MM/dd/yyyy"))


#: 1900-01-01 to 2099-12-31 is 73,049 days: 17 x 4,297.
_DAY0, _DAYS_A, _DAYS_B = "1900-01-01", 17, 4297


def _date(m: Column, key: str) -> Column:
    """mm/dd dates are those whose second number is above 12: they are permuted until the day is again."""
    def again(n, label):
        pair = permute_pair(F.floor(n / _DAYS_B), F.pmod(n, F.lit(_DAYS_B)), _DAYS_A, _DAYS_B, label, key)
        return _let(pair, lambda p: (p["a"] * _DAYS_B + p["b"]).cast("int"))
    def day(n):
        return F.date_add(F.lit(_DAY0).cast("date"), n)
    def walk(n):
        state = lambda n, done: F.struct(n.alias("n"), done.alias("done"))
        step = lambda s, _: F.when(s["done"], s).otherwise(_let(again(s["n"], "date mm/dd"), lambda k: state(k, F.dayofmonth(day(k)) > 12)))
        return F.aggregate(F.sequence(F.lit(1), F.lit(64)), state(n, F.lit(False)), step, lambda s: s["n"])
    def written(n):
        return F.when(~m.contains("/"), _let(again(n, "date"), lambda k: F.date_format(day(k), "yyyy-MM-dd"))).otherwise(
            F.when(F.substr(m, F.lit(4), F.lit(2)).cast("int") > 12, _let(walk(n), lambda k: F.date_format(day(k), "MM/dd/yyyy")))
            .otherwise(_let(again(n, "date"), lambda k: F.date_format(day(k), "dd/MM/yyyy")))
        )
    return _let(F.datediff(_as_date(m), F.lit(_DAY0).cast("date")), written)


def _ssn(m: Column, key: str) -> Column:
    """Areas 001-665 and 667-899, groups 01-99, serials 0001-9999."""
    def body(d):
        area = F.substr(d, F.lit(1), F.lit(3)).cast("int")
        ranked = F.when(area > 666, area - 2).otherwise(area - 1)
        return permute_pair(ranked * 99 + F.substr(d, F.lit(4), F.lit(2)).cast("int") - 1, F.substr(d, F.lit(6), F.lit(4)).cast("int") - 1, 898 * 99, 9999, "ssn", key)
    def written(p):
        area = F.floor(p["a"] / 99)
        area = F.when(area >= 665, area + 2).otherwise(area + 1)
        return F.format_string("%03d-%02d-%04d", area, F.pmod(p["a"], F.lit(99)) + 1, p["b"] + 1)
    return _let(_let(_only_digits(m), body), written)


def _phone(m: Column, key: str) -> Column:
    """The last ten digits, or all but the first of a shorter number, are permuted; a country code stays."""
    def body(d):
        n = F.length(d)
        own = F.least(n - 1, F.lit(10))
        return _refill(m, F.concat(F.substr(d, F.lit(1), n - own), permute_text(F.substr(d, n - own + 1, own), "phone", key)))
    return _let(_only_digits(m), body)


def _email(m: Column, key: str) -> Column:
    """Local part and domain are permuted apart, so that addresses of one domain stay together; the top-level domain stays."""
    local, domain, top = (F.regexp_extract(m, r"^([^@]+)@(.+)(\.[^.]+)$", k) for k in (1, 2, 3))
    return F.concat(_let(local, lambda x: permute_text(x, "email", key)), F.lit("@"), _let(domain, lambda x: permute_text(x, "domain", key)), top)


def _whole(name: str) -> str:
    return "^(?:" + PATTERNS[name] + ")$"


def kind_of(m: Column) -> Column:
    """The kind of a match that validates, else null."""
    return (
        F.when(m.contains("@"), F.lit("email"))
        .when(m.rlike(_whole("ip")) & (F.aggregate(_octets(m), F.lit(0), lambda a, x: F.greatest(a, x)) < 256), F.lit("ip"))
        .when(m.rlike(_whole("ipv6")), F.lit("ipv6"))
        .when(m.rlike(_whole("date")) & _as_date(m).isNotNull(), F.lit("date"))
        .when(m.rlike(_whole("ssn")) & ~m.rlike("^(?:000|666|9..)|-00-|-0000$"), F.lit("ssn"))
        .when(m.rlike(_whole("iban")) & _valid_iban(m), F.lit("iban"))
        .when(m.rlike(_whole("card")) & _valid_card(m).isNotNull(), F.lit("card"))
        .when(m.rlike(_whole("phone")), F.lit("phone"))
    )


def pseudonym(m: Column, key: str) -> Column:
    """struct<kind, out> of a match."""
    def body(kind):
        out = (
            F.when(kind == "email", _email(m, key)).when(kind == "card", _card_within(m, key)).when(kind == "phone", _phone(m, key))
            .when(kind == "ipv6", _hex(m, key)).when(kind == "iban", _iban(m, key)).when(kind == "ip", _ip(m, key)).when(kind == "ssn", _ssn(m, key)).when(kind == "date", _date(m, key)).otherwise(m)
        )
        return F.struct(kind.alias("kind"), out.alias("out"))
    return _let(kind_of(m), body)


def pseudonymize(docs: DataFrame, key: str) -> DataFrame:
    """The rows with ``text`` rewritten and ``pii``: array<struct<kind, out>>, an entry for each match in turn. Map-only."""
    text = F.col("text").cast("string")
    maybe = text.rlike("@|[0-9][^A-Za-z]{5}|[0-9A-Fa-f]:[0-9A-Fa-f:]{2}")
    hits = F.when(maybe, F.regexp_extract_all(text, F.lit(ANY), 0)).otherwise(F.array().cast("array<string>"))
    found = docs.withColumn("pii", F.transform(hits, lambda m: pseudonym(m, key)))
    gaps = F.split(text, ANY, -1)
    woven = F.array_join(F.zip_with(gaps, F.transform("pii", lambda x: x["out"]), lambda g, p: F.concat(g, F.coalesce(p, F.lit("")))), "")
    return found.withColumn("text", F.when(F.size("pii") > 0, woven).otherwise(text))


def op10_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = pseudonymize(docs, spark.conf.get(KEY_SETTING, DEMO_KEY))
    def count(kind):
        return F.coalesce(F.size(F.filter("pii", lambda x: x["kind"] == kind)), F.lit(0)).cast("long").alias(f"n_{kind}")
    return got.select(F.col("doc_id").cast("long"), "text", *[count(k) for k in PATTERNS])
