"""Format-preserving pseudonyms for personal data, as column expressions only.

Values are found by pattern, validated (card and account check digits, octets, calendar dates, social
security areas, telephone plans) and replaced by a keyed permutation of the same format: a Feistel
network whose round function is SHA-256 of the key, the kind, the round and the other half. Where
only a part of a format's values is valid, the network is applied again until it gives a valid one
(cycle walking), so valid values are permuted among themselves. A permutation maps equal values to
equal pseudonyms and different values of a format to different ones, so values stay linked across
documents; lengths, separators, letter case, country codes, mail domains and check digits' validity
stay. Values that fail validation are no personal data and stay as they are. Where a card or account
number's pattern took in groups beside it, the longest run of whole groups that is valid is the
value, and the rest is searched again. Dates with the year last are read day first, and month first
where that is no date; their years are 1900 to 2099.

A telephone number has a country code after a plus sign and 8 to 15 digits in all, or begins with a
trunk 0 and has 9 to 11, or has three figures of area and three of exchange, neither beginning with 0
or 1, and four more. A mail domain has 127 labels at most; of a longer one the first count.

The key is a text or a column; a column that is read from a file shows in no plan.

A null text stays null, an empty one empty. Texts of any length are rewritten whole. Columns other
than the text column are untouched. Rows that repeat are rewritten alike; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: Turns of cycle walking; a domain of which a share q is valid is missed with (1 - q) ** WALK.
WALK = 64

#: Fixed patterns, in order of precedence.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+){0,125}\.[A-Za-z]{2,24}",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])",
    "ymd": r"(?<![0-9./-])[0-9]{4}([-/.])[0-9]{2}\1[0-9]{2}(?![0-9]|[-/.][0-9])",
    "dmy": r"(?<![0-9./-])[0-9]{2}([-/.])[0-9]{2}\2[0-9]{4}(?![0-9]|[-/.][0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])",
    "phone": r"(?<![0-9])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])|(?<![0-9])\+[0-9]{8,15}(?![0-9])",
}
ANY = "|".join(PATTERNS.values())
#: Card and account numbers.
NUMBER = f"{PATTERNS['iban']}|{PATTERNS['card']}"
#: Stands around a number that was told from the groups beside it, while a text is searched; of
#: noncharacters, which texts do not have.
MARK = "\ufdd0\ufdd1\ufdd2\ufdd0"
#: Days that dates are permuted among: 1900-01-01 to 2100-01-01, 150 * 487.
FIRST_DAY, DAYS = "1900-01-01", (150, 487)


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _digest(key: str | Column, kind: str, turn: Column, half: Column) -> Column:
    key = F.lit(key) if isinstance(key, str) else key
    return F.sha2(F.concat(key, F.lit(f"|{kind}|"), turn.cast("string"), F.lit("|"), half.cast("string")), 256)


def walked(value: Column, permuted, valid) -> Column:
    """permuted(value), and again permuted until it is valid: a permutation of the valid values."""
    again = lambda x, _: F.when(valid(x), x).otherwise(permuted(x))
    return F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), permuted(value), again)


def _shifted(c: Column, k: Column) -> Column:
    """A letter or digit moved k places within its kind; anything else as it is."""
    def move(first: int, n: int) -> Column:
        return F.chr((F.ascii(c) - first + k) % n + first)

    return F.when(c.between("0", "9"), move(48, 10)).when(c.between("a", "z"), move(97, 26)).when(c.between("A", "Z"), move(65, 26)).otherwise(c)


def permuted_text(value: Column, key: str | Column, kind: str) -> Column:
    """A keyed permutation of strings that keeps length and each place's kind of character."""
    half = F.floor(F.length(value) / 2).cast("int")

    def move(part: Column, stream: Column) -> Column:
        byte = lambda s, i: F.conv(F.substring(s, (2 * i) % 64 + 1, F.lit(2)), 16, 10).cast("int")
        return let(stream, lambda s: F.array_join(F.transform(F.split(part, ""), lambda c, i: _shifted(c, byte(s, i))), ""))

    start = F.struct(F.substring(value, F.lit(1), half).alias("a"), F.substring(value, half + 1, F.length(value)).alias("b"))
    step = lambda acc, turn: F.struct(acc["b"].alias("a"), move(acc["a"], _digest(key, kind, turn, acc["b"])).alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda acc: F.concat(acc["a"], acc["b"]))


def permuted_number(value: Column, sizes: tuple, key: str | Column, kind: str) -> Column:
    """A keyed permutation of 0 .. sizes[0] * sizes[1] - 1; sizes are numbers or columns."""
    m, n = (F.lit(x).cast("long") if isinstance(x, int) else x for x in sizes)
    start = F.struct(F.floor(value / n).cast("long").alias("a"), F.pmod(value, n).cast("long").alias("b"), m.alias("m"), n.alias("n"))
    key_of = lambda turn, half: F.conv(F.substring(_digest(key, kind, turn, half), 1, 12), 16, 10).cast("long")
    step = lambda acc, turn: F.struct(acc["b"].alias("a"), F.pmod(acc["a"] + key_of(turn, acc["b"]), acc["m"]).cast("long").alias("b"), acc["n"].alias("m"), acc["m"].alias("n"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda acc: acc["a"] * n + acc["b"])


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn_sum(number: Column) -> Column:
    """Luhn sum of a number whose last digit is the check digit."""
    doubled = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    figures = F.transform(F.split(F.reverse(number), ""), lambda c, i: F.when(i % 2 == 1, doubled(c.cast("int"))).otherwise(c.cast("int")))
    return F.aggregate(figures, F.lit(0), lambda s, x: s + x)


def mod97(account: Column) -> Column:
    """An IBAN's remainder; 1 for valid ones."""
    moved = F.concat(F.substring(account, F.lit(5), F.length(account)), F.substring(account, 1, 4))
    value = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.transform(F.split(moved, ""), value), F.lit(0), lambda s, x: (s * F.when(x > 9, 100).otherwise(10) + x) % 97)


def in_places(template: Column, figures: Column, kind: str) -> Column:
    """figures, in order, at the places of template's characters of that kind."""
    place = lambda i: F.length(F.regexp_replace(F.substring(template, F.lit(1), i + 1), f"[^{kind}]", ""))
    put = lambda f: lambda c, i: F.when(c.rlike(f"^[{kind}]$"), F.substring(f, place(i), F.lit(1))).otherwise(c)
    return let(figures, lambda f: F.array_join(F.transform(F.split(template, ""), put(f)), ""))


def _email(m: Column, key: str | Column) -> Column:
    local = F.substring_index(m, "@", 1)
    return F.concat(permuted_text(local, key, "email"), F.substring(m, F.length(local) + 1, F.length(m)))


def _iban(m: Column, key: str | Column) -> Column:
    plain = F.regexp_replace(m, " ", "")
    country = F.substring(plain, 1, 2)
    inner = permuted_text(F.substring(plain, F.lit(5), F.length(plain)), key, "iban")
    whole = let(inner, lambda x: F.concat(country, F.lpad((98 - mod97(F.concat(country, F.lit("00"), x))).cast("string"), 2, "0"), x))
    return F.when(mod97(plain) == 1, in_places(m, whole, "A-Z0-9")).otherwise(m)


def _ip(m: Column, key: str | Column) -> Column:
    """Each octet stays among those of as many digits: 0-9, 10-99, 100-255."""
    octets = F.transform(F.split(m, r"\."), lambda x: F.struct(
        x.cast("long").alias("value"),
        F.when(F.length(x) == 1, 0).when(F.length(x) == 2, 10).otherwise(100).cast("long").alias("least"),
        F.when(F.length(x) == 1, 10).when(F.length(x) == 2, 90).otherwise(156).cast("long").alias("n"),
    ))

    def whole(o: Column) -> Column:
        place = lambda i: o[i]["value"] - o[i]["least"]
        sizes = (o[0]["n"] * o[1]["n"], o[2]["n"] * o[3]["n"])
        number = (place(0) * o[1]["n"] + place(1)) * sizes[1] + place(2) * o[3]["n"] + place(3)

        def text(n: Column) -> Column:
            left, right = F.floor(n / sizes[1]).cast("long"), n % sizes[1]
            parts = [F.floor(left / o[1]["n"]).cast("long"), left % o[1]["n"], F.floor(right / o[3]["n"]).cast("long"), right % o[3]["n"]]
            return F.concat_ws(".", *[(p + o[i]["least"]).cast("string") for i, p in enumerate(parts)])

        return let(permuted_number(number, sizes, key, "ip"), text)

    valid = F.forall(octets, lambda o: (o["value"] >= o["least"]) & (o["value"] < o["least"] + o["n"]))
    return F.when(valid, let(octets, whole)).otherwise(m)


def _date(m: Column, key: str | Column, year_first: bool) -> Column:
    part = lambda a, n: F.substring(m, a, n)
    sign = part(5, 1) if year_first else part(3, 1)
    year, month, day = (part(1, 4), part(6, 2), part(9, 2)) if year_first else (part(7, 4), part(4, 2), part(1, 2))
    first = F.lit(FIRST_DAY).cast("date")

    def number(month: Column, day: Column) -> Column:
        n = F.datediff(F.try_to_date(F.concat_ws("-", year, month, day), "yyyy-MM-dd"), first)
        return F.when(n.between(0, DAYS[0] * DAYS[1] - 1), n)

    def text(*form: str):
        def write(n: Column) -> Column:
            a, b, c = (F.date_format(F.date_add(first, n.cast("int")), f) for f in form)
            return F.concat(a, sign, b, sign, c)

        return write

    def permuted(n: Column) -> Column:
        return permuted_number(n, DAYS, key, "date")

    def late(n: Column) -> Column:
        """Permuted among the days from the 13th on, which only are read month first."""
        return walked(n, permuted, lambda x: F.dayofmonth(F.date_add(first, x.cast("int"))) > 12)

    if year_first:
        return F.coalesce(let(permuted(number(month, day)), text("yyyy", "MM", "dd")), m)
    return F.coalesce(
        let(permuted(number(month, day)), text("dd", "MM", "yyyy")),
        F.when(day.cast("int") <= 12, let(late(number(day, month)), text("MM", "dd", "yyyy"))),
        m,
    )


def _card(m: Column, key: str | Column) -> Column:
    number = digits(m)
    body = permuted_text(F.substring(number, F.lit(1), F.length(number) - 1), key, "card")
    whole = let(body, lambda b: F.concat(b, ((10 - luhn_sum(F.concat(b, F.lit("0"))) % 10) % 10).cast("string")))
    return F.when(luhn_sum(number) % 10 == 0, in_places(m, whole, "0-9")).otherwise(m)


def _ssn(m: Column, key: str | Column) -> Column:
    valid = lambda x: ~x.rlike("^(000|666|9)|^...00|0000$")
    new = walked(digits(m), lambda x: permuted_text(x, key, "ssn"), valid)
    return F.when(valid(digits(m)), in_places(m, new, "0-9")).otherwise(m)


#: National numbers by their figures, and how those of the second plan are written.
TRUNK, PLAN = "^0[0-9]{8,10}$", "^[2-9][0-9]{2}[2-9][0-9]{6}$"
WRITTEN = r"^(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}$"


def _phone(m: Column, key: str | Column) -> Column:
    """Behind a country code (three figures, where none is told from the rest) and behind a trunk 0 all
    figures go round, elsewhere those of the same plan."""
    permuted = lambda x: permuted_text(x, key, "phone")
    told = F.regexp_extract(m, r"^\+[0-9]{1,3}(?=[ .(-])", 0)
    country = F.when(told == "", F.substring(m, 1, 4)).otherwise(told)
    rest = F.substring(m, F.length(country) + 1, F.length(m))
    abroad = F.when(digits(m).rlike("^[1-9][0-9]{7,14}$"), F.concat(country, in_places(rest, permuted(digits(rest)), "0-9"))).otherwise(m)
    within = lambda plan: in_places(m, walked(digits(m), permuted, lambda x: x.rlike(plan)), "0-9")
    trunk = in_places(m, F.concat(F.lit("0"), permuted(F.substring(digits(m), F.lit(2), F.length(m)))), "0-9")
    return F.when(m.startswith("+"), abroad).when(digits(m).rlike(TRUNK), trunk).when(m.rlike(WRITTEN) & digits(m).rlike(PLAN), within(PLAN)).otherwise(m)


def _is(m: Column, kind: str) -> Column:
    return m.rlike(f"^(?:{PATTERNS[kind]})$".replace(r"\2", r"\1"))


def pseudonym(m: Column, key: str | Column) -> Column:
    """The pseudonym of a value that one of PATTERNS matched."""
    return (
        F.when(m.contains("@"), _email(m, key))
        .when(_is(m, "iban"), _iban(m, key))
        .when(_is(m, "ip"), _ip(m, key))
        .when(_is(m, "ymd"), _date(m, key, True))
        .when(_is(m, "dmy"), _date(m, key, False))
        .when(_is(m, "ssn"), _ssn(m, key))
        .when(_is(m, "card"), _card(m, key))
        .otherwise(_phone(m, key))
    )


def _told(m: Column, separators: str, valid) -> Column:
    """m with MARK around its longest run of whole groups that is valid, the first such; m if none."""
    groups = F.split(m, f"[{separators}]")
    sizes = F.transform(groups, lambda g: F.length(g) + 1)
    upto = lambda i: F.aggregate(F.slice(sizes, F.lit(1), i), F.lit(0), lambda s, x: s + x)
    one = lambda i, j: F.struct((upto(j) - upto(i) - 1).alias("n"), (-upto(i)).alias("back"))
    runs = F.flatten(F.transform(F.sequence(F.lit(0), F.size(groups) - 1), lambda i: F.transform(F.sequence(i + 1, F.size(groups)), lambda j: one(i, j))))
    best = F.array_max(F.filter(runs, lambda r: valid(F.substring(m, 1 - r["back"], r["n"]))))
    cut = lambda b: F.concat(F.substring(m, F.lit(1), -b["back"]), F.lit(MARK), F.substring(m, 1 - b["back"], b["n"]), F.lit(MARK), F.substring(m, 1 - b["back"] + b["n"], F.length(m)))
    return F.coalesce(let(best, cut), m)


def _pieces(text: Column, change) -> Column:
    """text with change(m) for each m that one of PATTERNS matched."""
    between, values = F.split(text, ANY, -1), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))
    return F.array_join(F.zip_with(between, values, lambda p, m: F.concat(p, F.coalesce(change(m), F.lit("")))), "")


def told_apart(text: Column) -> Column:
    """text with MARK around card and account numbers. What is freed beside one may be part of the
    next, so this is repeated until nothing changes, a turn for each number at most."""
    card = lambda v: _is(v, "card") & (luhn_sum(digits(v)) % 10 == 0)
    iban = lambda v: _is(v, "iban") & (mod97(F.regexp_replace(v, " ", "")) == 1)
    mark = lambda m: F.when(m.contains("@"), m).when(_is(m, "iban"), _told(m, " ", iban)).when(_is(m, "card"), _told(m, " -", card)).otherwise(m)
    once = lambda t: F.regexp_replace(_pieces(t, mark), f"(?:{MARK})+", MARK)

    def turn(state: Column, _: Column) -> Column:
        marked = let(state["text"], lambda t: let(once(t), lambda new: F.struct(new.alias("text"), (new == t).alias("done"))))
        return F.when(state["done"], state).otherwise(marked)

    turns = F.sequence(F.lit(0), F.size(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0))))
    return F.aggregate(turns, F.struct(text.alias("text"), F.lit(False).alias("done")), turn, lambda state: state["text"])


def pseudonymized(text: Column, key: str | Column) -> Column:
    """text with every validated value replaced."""
    replaced = lambda t: _pieces(t, lambda m: pseudonym(m, key))
    numbers = F.replace(let(told_apart(text), replaced), F.lit(MARK), F.lit(""))
    return F.when(text.rlike(NUMBER), numbers).when(text.rlike("[0-9@]") & text.rlike(ANY), replaced(text)).otherwise(text)


def with_pseudonyms(docs: DataFrame, key: str | Column, column: str = "text") -> DataFrame:
    """docs with the column rewritten; all other columns stay."""
    return docs.withColumn(column, pseudonymized(F.col(column).cast("string"), key))
