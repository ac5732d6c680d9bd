"""PII: format-preserving Feistel pseudonyms, in DataFrame expressions only.

Found and validated: card numbers (13 to 19 digits, also in groups, that pass the Luhn test), telephone numbers, IPv4
addresses (octets up to 255), e-mail addresses, and calendar dates (ISO, or day/month/year with dots or slashes; they
must exist, from 1900 to 2099), international account numbers (remainder 1 modulo 97) and social security numbers in
3-2-4 form (no area 000, 666 or 9xx, no group 00, no serial 0000). Each is permuted within its own format by a keyed Feistel network whose round function
is SHA-256, so equal values get equal pseudonyms in every document and different values different ones:

* digits (and, in the local part of an address, letters) are shifted place by place modulo 10 (or 26) by a keyed digest
  of the other half; the halves change places each of ROUNDS rounds; separators stay;
* spaces, dashes, dots and brackets of cards, telephone and account numbers are spelling: the same number spelled otherwise
  has the same pseudonym in that spelling; likewise addresses that differ in case; a country code written or left out
  makes two numbers; the domain of an address stays;
* cards and account numbers keep valid check digits; octets are shifted modulo 256; the country code of a telephone number in + form stays;
* dates are numbered by day and permuted on Z_a x Z_b with a * b days, so the result is a date in the same notation.

What fails validation (a long number that is no card, 300.1.1.1, 31.02.2020) stays as it is. The permutation never
returns a value itself unless the digest says so by chance, once in the size of its format.

Null texts stay null, empty ones empty; their counts are 0. Repeated rows give repeated rows. Columns besides doc_id and
text are ignored by the query and kept by pseudonymize(), whatever their names; only a column `pii` is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, table

ROUNDS = 8
#: The key of the query op6_pii alone, open to anyone who reads this; a job passes a secret of its own.
TEST_KEY = "not a secret"

#: One alternative a kind, tried in this order at each place. Runs of unbounded length are matched without giving back and
#: begin only where no such character stands before, so time is linear in the text and no group recurses.
PATTERN = (
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?<=[A-Za-z0-9])@[A-Za-z0-9-]++\.[A-Za-z0-9-](?:[A-Za-z0-9.-]*[A-Za-z0-9-])?"
    r"|(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![0-9A-Za-z])"
    r"|(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"
    r"|(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])"
    r"|(?<![0-9A-Za-z])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9A-Za-z-])"
    r"|(?<![0-9A-Za-z./])[0-9]{2}([./])[0-9]{2}\1[0-9]{4}(?![0-9A-Za-z])"
    r"|(?<![0-9A-Za-z])[0-9]{4}(?:[ -][0-9]{4}){2}[ -][0-9]{1,7}(?![0-9A-Za-z])"
    r"|(?<![0-9A-Za-z])[0-9]{13,19}(?![0-9A-Za-z])"
    r"|\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9A-Za-z])"
    r"|(?<![0-9A-Za-z])\(?[0-9]{3}\)?[ .-][0-9]{3}[.-][0-9]{4}(?![0-9A-Za-z])"
)
KINDS = ("email", "iban", "ssn", "ip", "iso_date", "date", "card", "phone")
#: Days from 1900-01-01: the first _A * _B of the two centuries, and the rest on a square of _C.
_A, _B, _C, _DAYS = 250, 292, 7, 73049


def _turned(m: Column) -> Column:
    """An account number without spaces, its country and check digits last."""
    plain = F.regexp_replace(m, " ", "")
    return F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))


def _mod97(s: Column) -> Column:
    """The number that the digits and letters (10 to 35) of s spell, modulo 97."""
    value = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(_chars(s), F.lit(0), lambda a, c: (a * F.when(value(c) > 9, 100).otherwise(10) + value(c)) % 97)


def _iban(m: Column, tweak: Column) -> Column:
    """The account permuted in its places, country and spacing kept, check digits made to fit."""
    head = F.array(_spelled(F.substring(m, F.lit(5), F.length(m)), F.lit(0), F.concat_ws(":", tweak, F.substring(m, 1, 2)), spaced=False))

    def fit(rest: Column) -> Column:
        check = 98 - _mod97(F.concat(F.regexp_replace(rest, " ", ""), F.substring(m, 1, 2), F.lit("00")))
        return F.concat(F.substring(m, 1, 2), F.lpad(check.cast("string"), 2, "0"), rest)

    return F.get(F.transform(head, fit), F.lit(0))


def _kind(m: Column) -> Column:
    """The kind of a match, null where validation fails."""
    digits = F.regexp_replace(m, "[^0-9]", "")
    octets = F.transform(F.split(m, r"\."), lambda x: F.try_to_number(x, F.lit("999")).cast("int"))
    day = F.coalesce(F.try_to_date(m, "yyyy-MM-dd"), F.try_to_date(F.translate(m, "/", "."), "dd.MM.yyyy"))
    real = day.isNotNull() & F.year(day).between(1900, 2099)
    return (
        F.when(m.contains("@"), "email")
        .when(m.rlike("^[A-Z]{2}"), F.when(_mod97(_turned(m)) == 1, "iban"))
        .when(m.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), F.when(~m.rlike("^(000|666|9)|-00-|-0000$"), "ssn"))
        .when(m.rlike(r"^[0-9]+(\.[0-9]+){3}$"), F.when(F.forall(octets, lambda x: x <= 255), "ip"))
        .when(m.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.when(real, "iso_date"))
        .when(m.rlike(r"^[0-9]{2}[./][0-9]{2}[./][0-9]{4}$"), F.when(real, "date"))
        .when(m.rlike(r"^[0-9 -]+$") & (F.length(digits) >= 13), F.when((F.length(digits) <= 19) & F.call_function("luhn_check", digits), "card"))
        .when(m.rlike("^[+(0-9]"), "phone")
    )


def _feistel(values: Column, bases: Column, tweak: Column) -> Column:
    """values (array of int) permuted place by place below bases; equal formats share one permutation for each tweak."""
    n = F.size(values)
    half = F.floor(n / 2).cast("int")
    whole = lambda a, s, c: F.slice(a, s + 1, c)
    start = F.struct(whole(values, F.lit(0), half).alias("l"), whole(values, half, n - half).alias("r"), whole(bases, F.lit(0), half).alias("bl"), whole(bases, half, n - half).alias("br"))

    def step(s: Column, i: Column) -> Column:
        hashed = F.sha2(F.concat_ws(":", tweak, i.cast("string"), F.array_join(F.transform(s["r"], lambda x: x.cast("string")), ",")), 256)
        moved = F.transform(s["l"], lambda x, j: ((x + F.conv(F.substring(hashed, (j % 15) * 4 + 1, F.lit(4)), 16, 10).cast("int") + F.floor(j / 15)) % F.get(s["bl"], j)).cast("int"))
        return F.struct(s["r"].alias("l"), moved.alias("r"), s["br"].alias("bl"), s["bl"].alias("br"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda s: F.concat(s["l"], s["r"]))


def _chars(m: Column) -> Column:
    return F.filter(F.split(m, ""), lambda c: c != "")


def _spelled(m: Column, keep: Column, tweak: Column, spaced: bool = True) -> Column:
    """m with its digits and letters permuted in their places, but for the first `keep` characters.

    spaced: other characters are part of the value (an address); else they are spelling, and the value is the same without.
    """
    code = lambda c: F.ascii(c)
    base = lambda c: F.when(c.rlike("[0-9]"), 10).when(c.rlike("[A-Za-z]"), 26).otherwise(0)
    first = lambda c: F.when(c.rlike("[0-9]"), 48).when(c.rlike("[a-z]"), 97).otherwise(65)
    chars = _chars(F.substring(m, keep + 1, F.length(m)))
    live = F.filter(chars, lambda c: base(c) > 0)
    put = _feistel(F.transform(live, lambda c: code(c) - first(c)), F.transform(live, base), F.concat_ws(":", tweak, F.array_join(F.transform(chars, lambda c: F.when(base(c) > 0, base(c).cast("string")).otherwise(c if spaced else F.lit(""))), "")))
    # in turn: a fixed character, or the next permuted one (wrapped in arrays, so that put is evaluated once)
    joined = F.transform(F.array(put), lambda p: F.aggregate(chars, F.struct(F.lit("").alias("s"), F.lit(0).alias("i")), lambda a, c: F.when(base(c) > 0, F.struct(F.concat(a["s"], F.char(F.get(p, a["i"]) + first(c))).alias("s"), (a["i"] + 1).alias("i"))).otherwise(F.struct(F.concat(a["s"], c).alias("s"), a["i"].alias("i"))), lambda a: a["s"]))
    return F.concat(F.substring(m, F.lit(1), keep), F.get(joined, F.lit(0)))


def _card(m: Column, tweak: Column) -> Column:
    """All digits but the last permuted, the last such that the Luhn test passes."""
    head = _spelled(F.substring(m, F.lit(1), F.length(m) - 1), F.lit(0), tweak, spaced=False)

    def fit(h: Column) -> Column:
        d = F.regexp_replace(h, "[^0-9]", "")
        return F.concat(h, F.get(F.filter(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda x: x.cast("string")), lambda x: F.call_function("luhn_check", F.concat(d, x))), F.lit(0)))

    return F.get(F.transform(F.array(head), fit), F.lit(0))


def _date(m: Column, iso: bool, tweak: Column) -> Column:
    day = F.datediff(F.try_to_date(m, "yyyy-MM-dd") if iso else F.try_to_date(F.translate(m, "/", "."), "dd.MM.yyyy"), F.lit("1900-01-01").cast("date"))
    most = _A * _B
    pair = lambda d, a: F.array((d % a).cast("int"), F.floor(d / a).cast("int"))
    new = F.transform(F.array(F.when(day < most, _feistel(pair(day, _A), F.array(F.lit(_A), F.lit(_B)), tweak)).otherwise(_feistel(pair(day - most, _C), F.array(F.lit(_C), F.lit(_C)), tweak))), lambda p: F.when(day < most, F.get(p, F.lit(0)) + _A * F.get(p, F.lit(1))).otherwise(most + F.get(p, F.lit(0)) + _C * F.get(p, F.lit(1))))
    at = F.date_add(F.lit("1900-01-01").cast("date"), F.get(new, F.lit(0)))
    return F.date_format(at, "yyyy-MM-dd") if iso else F.when(m.contains("/"), F.date_format(at, "dd/MM/yyyy")).otherwise(F.date_format(at, "dd.MM.yyyy"))


def _ip(m: Column, tweak: Column) -> Column:
    octets = F.transform(F.split(m, r"\."), lambda x: x.cast("int"))
    return F.array_join(F.transform(_feistel(octets, F.array_repeat(F.lit(256), 4), tweak), lambda x: x.cast("string")), ".")


def pseudonym(m: Column, kind: Column, key: str) -> Column:
    """The pseudonym of a match of a kind; the match itself where the kind is null."""
    tweak = lambda k: F.lit(f"{key}:{k}")
    return (
        F.when(kind == "email", F.concat(_spelled(F.substring_index(m, "@", 1), F.lit(0), tweak("email")), F.lit("@"), F.substring_index(m, "@", -1)))
        .when(kind == "ip", _ip(m, tweak("ip")))
        .when(kind == "iso_date", _date(m, True, tweak("date")))
        .when(kind == "date", _date(m, False, tweak("date")))
        .when(kind == "card", _card(m, tweak("card")))
        .when(kind == "phone", _spelled(m, F.when(m.startswith("+"), F.length(F.regexp_extract(m, r"^\+[0-9]{1,3}(?=[ .(-])", 0))).otherwise(0), tweak("phone"), spaced=False))
        .when(kind == "iban", _iban(m, tweak("iban")))
        .when(kind == "ssn", _spelled(m, F.lit(0), tweak("ssn"), spaced=False))
        .otherwise(m)
    )


def pseudonymize(docs: DataFrame, key: str) -> DataFrame:
    """docs with pseudonyms under a secret key in text, and pii: an array of (kind, value, pseudonym) in order of place."""
    found = F.coalesce(F.regexp_extract_all("text", F.lit(f"({PATTERN.replace(chr(92) + '1', chr(92) + '2')})"), F.lit(1)), F.array().cast("array<string>"))
    m, k, p = (free_name(docs, x) for x in ("_matches", "_kinds", "_pseudonyms"))
    named = docs.withColumn(m, found).withColumn(k, F.transform(m, lambda x: F.struct(x.alias("value"), _kind(x).alias("kind"))))
    done = named.withColumn(p, F.transform(k, lambda x: F.struct(x["kind"].alias("kind"), x["value"].alias("value"), pseudonym(x["value"], x["kind"], key).alias("pseudonym"))))
    gaps = F.split("text", PATTERN, -1)
    text = F.when(F.size(m) == 0, F.col("text")).otherwise(F.array_join(F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.get(p, i)["pseudonym"], F.lit("")))), ""))
    return done.withColumn("text", text).withColumn("pii", F.filter(p, lambda x: x["kind"].isNotNull())).drop(m, k, p)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_pii, n_email, n_ip, n_date, n_card, n_phone, n_iban, n_ssn, text_sha256, pseudonyms) of every document.

    n_pii counts what identifies a person by itself: all kinds but dates.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    count = lambda *kinds: F.size(F.filter("pii", lambda x: x["kind"].isin(*kinds))).cast("long")
    return pseudonymize(docs, TEST_KEY).select("doc_id", count("email", "ip", "card", "phone", "iban", "ssn").alias("n_pii"), count("iban").alias("n_iban"), count("ssn").alias("n_ssn"), count("email").alias("n_email"), count("ip").alias("n_ip"), count("date", "iso_date").alias("n_date"), count("card").alias("n_card"), count("phone").alias("n_phone"), F.sha2("text", 256).alias("text_sha256"), F.array_join(F.transform("pii", lambda x: F.concat_ws(":", x["kind"], x["pseudonym"])), ",").alias("pseudonyms"))
