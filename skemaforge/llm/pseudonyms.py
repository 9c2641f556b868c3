"""Format-preserving pseudonyms for personal values in text. DataFrame functions only, no shuffle.

One pattern finds candidates; each is validated by its kind and permuted by a keyed Feistel network within its format, so an
equal value gets an equal pseudonym in every document, two values of one format never share one, and whoever has the key
can undo it (``undo=True``). Text around the values stays as it is. A card, phone or IBAN is its digits and letters: the spaces
and dashes in which they are grouped stay and don't matter.

- e-mail: the letters (Latin with accents and Cyrillic ones too; of other scripts they stay) and digits of the local part, whatever
  their case, which stays; the domain stays
- phone in international form: the digits after the country code, however they are grouped; a trunk zero in brackets stays
- IBAN under right check digits (mod 97): its account part, with new check digits
- payment card: 13 to 19 digits under a right Luhn sum, also within a longer run of digit groups (beside an expiry date, a check
  value or another number); the pseudonym's sum is right too
- IPv4: four octets to 255, as one 32-bit number
- date (year first with ``-``, ``/`` or ``.``; or year last with ``/`` or ``.``): real days of the years 1800 to 2199, permuted among
  those 146,097 days
- access keys (``AKIA`` and 16 characters); hexadecimal secrets of 32 characters or more and keys that begin with ``sk-`` in an assignment
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import named, unused

KEY = "replace this key"
ROUNDS = 8

EMAIL = r"(?<![\p{L}\p{M}0-9._%+\-])[\p{L}\p{M}0-9._%+\-]{1,64}@[\p{L}0-9\-]+(?:\.[\p{L}0-9\-]+)*\.\p{L}{2,24}(?![\p{L}0-9])"
IPV4 = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])"
PHONE = r"(?<![0-9A-Za-z+])\+[0-9]{1,3}[ .\-]?(?:\(0\)[ .\-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[ .\-]?[0-9]{2,4}){2,3}(?![0-9])"
DATE = r"(?<![0-9A-Za-z])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{4}\.[0-9]{2}\.[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9A-Za-z])"
#: A run of digit groups with 13 digits or more, up to where another kind begins; possessive, so a long run takes no stack.
CARD = rf"(?<![0-9A-Za-z])(?=[0-9](?:[ \-]?[0-9]){{12}})[0-9]{{1,19}}+(?![0-9A-Za-z])(?:[ \-](?!{EMAIL}|{IPV4}|(?=(?:1[89]|2[01])[0-9]{{2}}|[0-9]{{2}}[/.]){DATE})[0-9]{{1,19}}+(?![0-9A-Za-z]))*+"
#: How cards are usually written; such a part of a run goes before others.
USUAL = r"^(?=[346]|2[2-7]|5[0-8])(?:[0-9]{13,19}|[0-9]{4}([ \-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{4}([ \-])[0-9]{6}\2[0-9]{4,5})$"
ACCESS = r"(?<![0-9A-Za-z])AKIA[0-9A-Z]{16}(?![0-9A-Za-z])"
SECRET = r"(?<=(?:[Tt]oken|TOKEN|[Ss]ecret|SECRET|[Kk]ey|KEY|[Pp]assword|PASSWORD)[\"']? ?[=:] ?[\"']?)(?:[0-9a-f]{32,128}|sk-[A-Za-z0-9]{16,128})(?![0-9A-Za-z])"
#: Countries with IBANs; country calling codes of one and two digits (all others have three).
IBAN_COUNTRIES = "AD AE AL AT AZ BA BE BG BH BR BY CH CR CY CZ DE DK DO EE EG ES FI FO FR GB GE GI GL GR GT HR HU IE IL IQ IS IT JO KW KZ LB LC LI LT LU LV LY MC MD ME MK MR MT MU NL NO PK PL PS PT QA RO RS SA SC SD SE SI SK SM ST SV TL TN TR UA VA VG XK".split()
ONE_DIGIT_CODES = "1 7".split()
TWO_DIGIT_CODES = "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
IBAN = rf"(?<![0-9A-Za-z])(?:{'|'.join(IBAN_COUNTRIES)})[0-9]{{2}}(?: ?[0-9A-Z]{{4}}){{2,7}}(?: ?[0-9A-Z]{{1,3}})?(?![0-9A-Za-z])"
ANY = "|".join((EMAIL, IPV4, PHONE, DATE, IBAN, CARD, ACCESS, SECRET))
#: No value of any kind is without one of these.
SOME = "[0-9@]"
#: A found value's replacement and how many values it holds.
NEW = "struct<text:string,n:int>"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _round(key: str, kind: str, r: Column, half: Column) -> Column:
    """128 hexadecimal digits from the key, the format, the round and the other half."""
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), r.cast("string"), half), 512)


def _number(digest: Column, at, digits: int = 8) -> Column:
    return F.conv(F.substr(digest, at, F.lit(digits)), 16, 10).cast("long")


#: Further classes of lower-case letters, each permuted within itself.
ALPHABETS = ("àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþ", "абвгдежзийклмнопрстуфхцчшщъыьэюя")


def _shifted(c: Column, by: Column, letters: int) -> Column:
    """The character moved within its class: digits, a-z (or its first ``letters``), A-Z, one of ``ALPHABETS``; any other stays."""
    turn = lambda base, size: F.char(F.pmod(F.ascii(c) - base + by, F.lit(size)) + base)
    out = F.when(c.between("0", "9"), turn(48, 10)).when(c.between("a", "z"), turn(97, letters)).when(c.between("A", "Z"), turn(65, 26))
    for a in ALPHABETS:
        out = out.when(F.lit(a).contains(c), F.substr(F.lit(a), F.pmod(F.instr(F.lit(a), c) - 1 + by, F.lit(len(a))).cast("int") + 1, F.lit(1)))
    return out.otherwise(c)


def _rounds(undo: bool) -> Column:
    return F.sequence(F.lit(ROUNDS), F.lit(1)) if undo else F.sequence(F.lit(1), F.lit(ROUNDS))


def permuted_text(s: Column, kind: str, key: str = KEY, letters: int = 26, undo: bool = False) -> Column:
    """A Feistel network on a string's two halves: each round shifts one half's characters by amounts drawn from the other half."""
    sign = -1 if undo else 1
    source, target = ("a", "b") if undo else ("b", "a")

    def step(pair: Column, r: Column) -> Column:
        shift = lambda d: F.array_join(F.transform(F.split(pair[target], ""), lambda c, i: _shifted(c, sign * _number(d, i % 32 * 4 + 1, 4), letters)), "")
        moved = _let(_round(key, kind, r, pair[source]), shift)
        moved = F.when(F.length(pair[target]) == 0, F.lit("")).otherwise(moved)
        return F.struct(moved.alias("a"), pair["a"].alias("b")) if undo else F.struct(pair["b"].alias("a"), moved.alias("b"))

    cut = F.floor(F.length(s) / 2).cast("int")
    start = F.struct(F.substr(s, F.lit(1), cut).alias("a"), F.substr(s, cut + 1, F.length(s)).alias("b"))
    return F.aggregate(_rounds(undo), start, step, lambda p: F.concat(p["a"], p["b"]))


def permuted_pair(a: Column, b: Column, sizes: tuple[int, int], kind: str, key: str, done, undo: bool = False) -> Column:
    """A Feistel network on a pair of numbers below ``sizes``, ended by ``done`` of the pair."""
    drawn = lambda r, other: _number(_round(key, kind, r, other.cast("string")), F.lit(1))

    def step(pair: Column, r: Column) -> Column:
        if undo:
            y = F.pmod(pair["b"] - drawn(-r, pair["a"]), F.lit(sizes[1])).cast("long")
            x = F.pmod(pair["a"] - drawn(r, y), F.lit(sizes[0]))
        else:
            x = F.pmod(pair["a"] + drawn(r, pair["b"]), F.lit(sizes[0])).cast("long")
            y = F.pmod(pair["b"] + drawn(-r, x), F.lit(sizes[1]))
        return F.struct(x.cast("long").alias("a"), y.cast("long").alias("b"))

    return F.aggregate(_rounds(undo), F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")), step, done)


def luhn_sum(digits: Column, doubled: int) -> Column:
    """Sum over digits from the right; those at odd (doubled=1) or even (doubled=0) places from the right, counted from 0, count twice."""

    def one(x: Column, i: Column) -> Column:
        d = x.cast("int")
        return F.when(i % 2 == doubled, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), one), F.lit(0), lambda s, x: s + x)


def refilled(shape: Column, signs: Column, letters: bool = False) -> Column:
    """``shape`` with its digits (and its ``letters``) replaced in order by those of ``signs``."""

    def put(acc: Column, c: Column) -> Column:
        own = c.between("0", "9") | (c.between("A", "Z") if letters else F.lit(False))
        return F.struct(F.concat(acc["out"], F.when(own, F.substr(signs, acc["k"], F.lit(1))).otherwise(c)).alias("out"), (acc["k"] + F.when(own, 1).otherwise(0)).alias("k"))

    return F.aggregate(F.split(shape, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("k")), put, lambda a: a["out"])


def _email(m: Column, key: str, undo: bool) -> Column:
    local = F.substring_index(m, "@", 1)
    recased = lambda new: F.array_join(F.zip_with(F.split(local, ""), F.split(new, ""), lambda c, d: F.when(c != F.lower(c), F.upper(d)).otherwise(d)), "")
    return F.concat(_let(permuted_text(F.lower(local), "email", key, undo=undo), recased), F.lit("@"), F.substring_index(m, "@", -1))


def _phone(m: Column, key: str, undo: bool) -> Column:
    def renew(d: Column) -> Column:
        size = F.when(F.substr(d, F.lit(1), F.lit(1)).isin(ONE_DIGIT_CODES), 1).when(F.substr(d, F.lit(1), F.lit(2)).isin(TWO_DIGIT_CODES), 2).otherwise(3)
        new = F.concat(F.substr(d, F.lit(1), size), permuted_text(F.substr(d, size + 1, F.length(d)), "phone", key, undo=undo))
        return _let(new, lambda n: F.replace(refilled(bare, n), F.lit("()"), F.lit("(0)")))

    bare = F.replace(m, F.lit("(0)"), F.lit("()"))  # the trunk zero isn't part of the number
    return _let(_digits(bare), renew)


def mod97(signs: Column) -> Column:
    """The remainder of digits and letters (A is 10, Z 35) read as one number."""

    def step(acc: Column, c: Column) -> Column:
        return F.when(c.between("0", "9"), (acc * 10 + F.ascii(c) - 48) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97).cast("int")

    return F.aggregate(F.split(signs, ""), F.lit(0), step)


def _iban(m: Column, key: str, undo: bool) -> Column:
    def renew(s: Column) -> Column:
        land, account = F.substr(s, F.lit(1), F.lit(2)), F.substr(s, F.lit(5), F.length(s))
        right = mod97(F.concat(account, F.substr(s, F.lit(1), F.lit(4)))) == 1
        checked = lambda new: F.concat(land, F.lpad((98 - mod97(F.concat(new, land, F.lit("00")))).cast("string"), 2, "0"), new)
        full = _let(permuted_text(account, "iban", key, undo=undo), checked)
        return F.when(right, _let(full, lambda n: refilled(m, n, letters=True))).otherwise(m)

    return _let(F.replace(m, F.lit(" "), F.lit("")), renew)


def _is_card(digits: Column) -> Column:
    return F.length(digits).between(13, 19) & (luhn_sum(digits, 1) % 10 == 0)


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _swept(parts: Column) -> Column:
    """Of ``parts`` (from, to, ...) in order, each that begins after the last one taken."""
    none = F.slice(parts, 1, 0)
    step = lambda acc, p: F.when(p["from"] > acc["last"], F.struct(F.concat(acc["taken"], F.array(p)).alias("taken"), p["to"].alias("last"))).otherwise(acc)
    return F.aggregate(parts, F.struct(none.alias("taken"), F.lit(0).alias("last")), step, lambda acc: acc["taken"])


def _card_parts(groups: Column) -> Column:
    """The cards among digit groups (each with the separator after it), as (from, to, usual) counted from 1.

    Every run of groups of 13 to 19 digits is tried. Where right ones overlap, those in a usual writing go first, then the one that
    begins first, then the longest.
    """
    n = F.size(groups)

    def begun(i: Column) -> Column:
        # from the longest to the shortest: nineteen groups at most
        ends = F.reverse(F.sequence(i, F.least(i + 18, n)))
        part = lambda j: F.array_join(F.slice(groups, i, j - i + 1), "")
        right = F.filter(ends, lambda j: _let(_digits(part(j)), _is_card))
        return F.transform(right, lambda j: F.struct(i.alias("from"), j.alias("to"), F.regexp_replace(part(j), "[ \\-]$", "").rlike(USUAL).alias("usual")))

    def chosen(right: Column) -> Column:
        def both(usual: Column) -> Column:
            free = F.filter(right, lambda p: ~F.exists(usual, lambda u: (u["from"] <= p["to"]) & (p["from"] <= u["to"])))
            return F.array_sort(F.concat(usual, _swept(free)))

        return _let(_swept(F.filter(right, lambda p: p["usual"])), both)

    return _let(F.flatten(F.transform(F.sequence(F.lit(1), n), begun)), chosen)


def _cards(m: Column, key: str, undo: bool) -> Column:
    """A run of digit groups with its cards renewed, as NEW. A run that is right as a whole is one card."""

    def renew(part: Column) -> Column:
        def with_check(d: Column) -> Column:
            body = permuted_text(F.substr(d, F.lit(1), F.length(d) - 1), "card", key, undo=undo)
            return _let(_let(body, lambda b: F.concat(b, F.pmod(10 - luhn_sum(b, 0) % 10, F.lit(10)).cast("string"))), lambda new: refilled(part, new))

        return _let(_digits(part), with_check)

    def renewed(groups: Column) -> Column:
        text = lambda i, j: F.array_join(F.slice(groups, i, j - i + 1), "")
        step = lambda acc, p: F.struct(F.concat(acc["out"], text(acc["at"], p["from"] - 1), _let(text(p["from"], p["to"]), renew)).alias("out"), (p["to"] + 1).alias("at"))
        one = F.array(F.struct(F.lit(1).alias("from"), F.size(groups).alias("to"), F.lit(True).alias("usual")))
        parts = F.when(_let(_digits(m), _is_card), one).otherwise(_card_parts(groups))
        done = lambda parts: F.aggregate(parts, F.struct(F.lit("").alias("out"), F.lit(1).alias("at")), step, lambda acc: F.struct(F.concat(acc["out"], text(acc["at"], F.size(groups))).alias("text"), F.size(parts).alias("n")).cast(NEW))
        return _let(parts, done)

    return _let(F.regexp_extract_all(m, F.lit(r"[0-9]+[ \-]?"), F.lit(0)), renewed)


def _ip(m: Column, key: str, undo: bool) -> Column:
    def renew(o: Column) -> Column:
        part = lambda i: F.element_at(o, i).cast("int")
        valid = F.forall(o, lambda x: (x.cast("int") <= 255) & ((F.length(x) == 1) | ~x.startswith("0")))
        write = lambda p: F.concat_ws(".", *(F.floor(x).cast("string") for h in ("a", "b") for x in (p[h] / 256, p[h] % 256)))
        return F.when(valid, permuted_pair(part(1) * 256 + part(2), part(3) * 256 + part(4), (65536, 65536), "ip", key, write, undo)).otherwise(m)

    return _let(F.split(m, r"\."), renew)


def _date(m: Column, key: str, undo: bool) -> Column:
    """Day numbers in a 400-year cycle, 146,097 = 189 * 773, as a pair below (189, 773)."""
    sep = F.regexp_extract(m, "([^0-9])", 1)

    def renew(p: Column) -> Column:
        year_first = F.length(F.element_at(p, 1)) == 4
        second_month = F.element_at(p, 2).cast("int") <= 12  # else month, day, year
        y = F.when(year_first, F.element_at(p, 1)).otherwise(F.element_at(p, 3))
        mo = F.when(year_first | second_month, F.element_at(p, 2)).otherwise(F.element_at(p, 1))
        d = F.when(year_first, F.element_at(p, 3)).when(second_month, F.element_at(p, 1)).otherwise(F.element_at(p, 2))
        day = F.try_to_date(F.concat_ws("-", y, mo, d), "yyyy-MM-dd")
        first = F.to_date(F.lit("1800-01-01"))

        def write(pair: Column) -> Column:
            new = F.date_add(first, (pair["a"] * 773 + pair["b"]).cast("int"))
            form = lambda *f: F.concat_ws("", *(F.date_format(new, x) if x != "" else sep for x in f))
            return F.when(year_first, form("yyyy", "", "MM", "", "dd")).when(second_month, form("dd", "", "MM", "", "yyyy")).otherwise(form("MM", "", "dd", "", "yyyy"))

        n = F.datediff(day, first)
        inside = day.isNotNull() & y.between("1800", "2199")
        return F.when(inside, permuted_pair(F.floor(n / 773), n % 773, (189, 773), "date", key, write, undo)).otherwise(m)

    return _let(F.split(m, "[^0-9]"), renew)


def pseudonym(m: Column, key: str = KEY, undo: bool = False) -> Column:
    """The pseudonym of one found value (or with ``undo`` the value of a pseudonym), as NEW; a value that isn't valid stays."""
    whole = lambda p: m.rlike(f"^(?:{p})$")
    one = (
        F.when(m.contains("@"), _email(m, key, undo))
        .when(whole(IPV4), _ip(m, key, undo))
        .when(m.startswith("+"), _phone(m, key, undo))
        .when(whole(DATE), _date(m, key, undo))
        .when(m.startswith("AKIA"), F.concat(F.lit("AKIA"), permuted_text(F.substr(m, F.lit(5), F.length(m)), "access", key, undo=undo)))
        .when(m.startswith("sk-"), F.concat(F.lit("sk-"), permuted_text(F.substr(m, F.lit(4), F.length(m)), "access", key, undo=undo)))
        .when(m.rlike("^[A-Z]"), _iban(m, key, undo))
        .when(m.rlike("^[0-9a-f]{32,}$"), permuted_text(m, "secret", key, letters=6, undo=undo))
    )
    # what no branch takes is a run of digits
    return F.coalesce(_let(one, lambda new: F.when(new.isNotNull(), F.struct(new.alias("text"), (new != m).cast("int").alias("n")).cast(NEW))), _cards(m, key, undo))


def pseudonymise(df: DataFrame, text: str = "text", key: str = KEY, undo: bool = False) -> DataFrame:
    """``df`` with personal values in ``text`` replaced, and ``n_values``: how many were (a column of that name is replaced).

    With ``undo`` pseudonyms are turned back into their values, under the same key. Null text stays null and has 0 values. Repeated
    rows are equal in the result too. Row by row, so an empty table gives an empty result and length doesn't matter beyond one text.
    """
    t = named(text)
    found, new, changed = unused(df, "found_values", "new_values", "changed_values")
    some = F.when(t.rlike(SOME), F.regexp_extract_all(t, F.lit(ANY), F.lit(0)))
    out = df.withColumn(found, F.when(F.size(some) > 0, some)).withColumn(new, F.transform(found, lambda m: pseudonym(m, key, undo)))
    # n matches lie between n + 1 pieces
    joined = F.array_join(F.zip_with(F.split(t, ANY, -1), F.col(new), lambda a, b: F.concat(a, F.coalesce(b["text"], F.lit("")))), "")
    out = out.withColumn(changed, F.coalesce(F.aggregate(new, F.lit(0), lambda n, b: n + b["n"]), F.lit(0)))
    names = [c for c in df.columns if c.lower() != "n_values"]
    return out.select(*(F.when(F.col(found).isNull(), t).otherwise(joined).alias(text) if c == text else named(c) for c in names), F.col(changed).alias("n_values"))


def op5_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pseudonymise(docs)
