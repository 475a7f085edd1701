"""Format-preserving pseudonyms for personal data, in DataFrame expressions only.

Values are found by pattern, validated (card checksum, bank account checksum, address octets,
calendar dates), and replaced by a keyed permutation of their own format: an alternating Feistel
network over their digits and letters. Equal values get equal pseudonyms in every document, other
values of the format others, and separators, check digits and letter case stay in order.

No Python runs on the executors: a text without any character that the patterns need passes a native
test unchanged; any other is split at the matches, and the matches alone go through the network.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rateflow.llm import common

ROUNDS = 10

# Linear patterns: every start is anchored by a look-behind, long runs are possessive.
_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+(?<=\.[A-Za-z]{2,24})"
# A secret runs to white space, a quote or a bracket of markup: eight characters, or five with a digit.
_NAMED = r"(?i:password|passwd|passphrase|pwd|token|secret|api[_-]?key)[\"']?\s{0,16}[=:]\s{0,16}[\"']?"
_BEARER = r"(?i:authorization)[\"']?\s{0,16}[=:]\s{0,16}[\"']?(?i:bearer|basic|token)\s{1,16}"
_ASSIGNED = rf"(?<![A-Za-z0-9])(?:{_NAMED}|{_BEARER})(?=[^\s\"'<>]{{8}}|[^\s\"'<>]{{0,4}}[0-9])[^\s\"'<>]{{5,}}+"
_ACCESS = r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])"
_HEX = r"(?<![A-Za-z0-9])(?=[a-fA-F]*+[0-9])[0-9a-fA-F]{32,}+(?![A-Za-z0-9])"
_DATE = r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9]|[./-][0-9])"
_ADDRESS = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])"
# Eight groups, or four and more with a double colon and a digit.
_ADDRESS6 = r"(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=[A-Fa-f:]*[0-9])(?=(?:[0-9A-Fa-f]{1,4}:)+:)(?:[0-9A-Fa-f]{1,4}::?){3,7}[0-9A-Fa-f]{1,4})(?![0-9A-Za-z:])"
_SOCIAL = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])"
_PHONE = r"(?<![A-Za-z0-9+])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![0-9])"
# Groups of a card or account number go on to the end of the row of groups, but not into a value of another kind.
_OTHER = "|".join([_EMAIL, _HEX, _DATE, _ADDRESS, _SOCIAL, _PHONE])
_IBAN = rf"(?<![A-Za-z0-9])[A-Z]{{2}}[0-9]{{2}}(?:[A-Z0-9]{{11,30}}|(?: (?!{_OTHER})[A-Z0-9]{{4}}(?![A-Za-z0-9])){{2,}}+(?: (?!{_OTHER})[A-Z0-9]{{1,3}}(?![A-Za-z0-9]))?+)(?![A-Za-z0-9])"
_CARD = rf"(?<![A-Za-z0-9])(?=[0-9](?:[ -]?[0-9]){{12}})[0-9]++(?![A-Za-z])(?:(?:-| (?!{_OTHER}))[0-9]++(?![A-Za-z]))*+"
# How the groups of a card are printed; other groups may be a card too, but these come first.
_PRINTED = r"^[2-6](?:[0-9]{12,18}|[0-9]{3}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{3}([ -])[0-9]{6}\2[0-9]{4,5})$"

PATTERN = "|".join([_EMAIL, _ASSIGNED, _ADDRESS6, _ACCESS, _HEX, _IBAN, _DATE, _ADDRESS, _SOCIAL, _PHONE, _CARD])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once."""
    return F.transform(F.array(value), body)[0]


def _chars(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def _digest(key: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), *parts).cast("binary"), 512)


def _symbol(c: Column, hexadecimal: bool) -> Column:
    """(value, radix) of a letter or digit; lower-case hexadecimal digits count up to 16."""
    if hexadecimal:
        return F.struct((F.instr(F.lit("0123456789abcdef"), c) - 1).cast("int").alias("v"), F.lit(16).alias("r"))
    a = F.ascii(c)
    return F.when(c.between("0", "9"), F.struct((a - 48).alias("v"), F.lit(10).alias("r"))).when(
        c.between("a", "z"), F.struct((a - 97).alias("v"), F.lit(26).alias("r"))
    ).otherwise(F.struct((a - 65).alias("v"), F.lit(26).alias("r")))


def _alphanumeric(c: Column) -> Column:
    return c.between("0", "9") | c.between("a", "z") | c.between("A", "Z")


def permute(s: Column, key: str, kind: str, hexadecimal: bool = False) -> Column:
    """Permute the letters and digits of ``s`` within the strings of the same character classes.

    Rounds alternate between the halves of the symbols: each symbol of one half is shifted, modulo
    its radix, by a keyed digest of the other half, the round and the classes.
    """
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(s, "[^A-Za-z0-9]", ""), "[0-9]", "0"), "[a-z]", "a"), "[A-Z]", "A")
    tweak = F.lit(kind) if hexadecimal else F.concat(F.lit(kind + ":"), classes)

    def rounds(symbols: Column, tweak: Column) -> Column:
        n = F.size(symbols)
        u = F.floor(n / 2).cast("int")
        start = F.struct(F.slice(symbols, F.lit(1), u).alias("a"), F.slice(symbols, u + 1, n - u).alias("b"))

        def step(acc: Column, i: Column) -> Column:
            shown = F.array_join(F.transform(acc["b"], lambda x: x["v"].cast("string")), ",")
            # a long half is digested once, not in each block
            half = F.when(F.size(acc["b"]) > 64, F.sha2(shown.cast("binary"), 512)).otherwise(shown)
            blocks = let(half, lambda other: F.transform(F.sequence(F.lit(0), F.floor(F.size(acc["a"]) / 32).cast("int")), lambda k: _digest(key, tweak, i.cast("string"), k.cast("string"), other)))

            def shift(digests: Column) -> Column:
                return F.transform(acc["a"], lambda x, j: F.struct(
                    F.pmod(x["v"] + F.conv(F.substring(digests[F.floor(j / 32).cast("int")], (j % 32) * 4 + 1, F.lit(4)), 16, 10).cast("int"), x["r"]).alias("v"), x["r"].alias("r")))

            return F.struct(acc["b"].alias("a"), let(blocks, shift).alias("b"))

        return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda acc: F.concat(acc["a"], acc["b"]))

    def shown(c: Column, v: Column) -> Column:
        if hexadecimal:
            return F.substring(F.lit("0123456789abcdef"), v + 1, F.lit(1))
        return F.chr(v + F.when(c.between("0", "9"), 48).when(c.between("a", "z"), 97).otherwise(65))

    def rebuilt(both: Column) -> Column:
        places = F.transform(both["chars"], lambda c, i: F.struct(i.alias("i"), c.alias("c")))
        filled = F.zip_with(F.filter(places, lambda x: _alphanumeric(x["c"])), both["new"], lambda x, y: F.struct(x["i"].alias("i"), shown(x["c"], y["v"]).alias("c")))
        return F.array_join(F.transform(F.sort_array(F.concat(filled, F.filter(places, lambda x: ~_alphanumeric(x["c"])))), lambda x: x["c"]), "")

    chars = _chars(s)
    symbols = F.transform(F.filter(chars, _alphanumeric), lambda c: _symbol(c, hexadecimal))
    new = let(F.struct(symbols.alias("s"), tweak.alias("t")), lambda x: rounds(x["s"], x["t"]))
    return let(F.struct(chars.alias("chars"), new.alias("new")), rebuilt)


def _refill(s: Column, digits: Column) -> Column:
    """``s`` with its digits replaced, in order, by ``digits``."""
    return let(digits, lambda d: F.aggregate(_chars(s), F.struct(F.lit("").alias("out"), F.lit(1).alias("k")), lambda acc, c: F.when(
        c.between("0", "9"), F.struct(F.concat(acc["out"], F.substring(d, acc["k"], F.lit(1))).alias("out"), (acc["k"] + 1).alias("k"))
    ).otherwise(F.struct(F.concat(acc["out"], c).alias("out"), acc["k"].alias("k"))), lambda acc: acc["out"]))


def _swapped(text: Column, pattern: str, swap: Callable[[Column], Column]) -> Column:
    """``text`` with ``swap`` applied to the matches of ``pattern``."""
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.array_join(F.zip_with(gaps, F.transform(found, swap), lambda g, m: F.concat(g, F.coalesce(m, F.lit("")))), "")


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(payload: Column) -> Column:
    """The check digit of a digit string."""
    def add(acc: Column, x: Column) -> Column:
        return acc + x

    doubled = F.transform(F.reverse(_chars(payload)), lambda c, i: let(c.cast("int") * F.when(i % 2 == 0, 2).otherwise(1), lambda d: F.when(d > 9, d - 9).otherwise(d)))
    return F.pmod(-F.aggregate(doubled, F.lit(0), add), F.lit(10)).cast("string")


def _valid_card(d: Column) -> Column:
    return F.length(d).between(13, 19) & (F.regexp_replace(d, "0", "") != "") & (_luhn(F.substring(d, F.lit(1), F.length(d) - 1)) == F.right(d, F.lit(1)))


def _card(m: Column, key: str) -> Column:
    """A valid card, its last digit computed anew."""
    return let(_digits(m), lambda d: _refill(m, let(permute(F.substring(d, F.lit(1), F.length(d) - 1), key, "card"), lambda p: F.concat(p, _luhn(p)))))


def _cards(m: Column, key: str) -> Column:
    """A row of digit groups with every card in it replaced: whole groups of 13 to 19 digits that pass.

    From the left, a span printed as cards are comes first, then the longest that reaches into none.
    What a printed span shares with the one before it and leaves over is replaced as well.
    """
    def spans(groups: Column, i: Column) -> Column:
        """The valid spans from group ``i``: (size, is printed as a card)."""
        tries = F.transform(F.sequence(F.lit(1), F.least(F.lit(19), F.size(groups) - i)), lambda n: F.struct(n.alias("n"), F.array_join(F.slice(groups, i + 1, n), "").alias("s")))
        valid = F.filter(tries, lambda x: let(_digits(x["s"]), _valid_card))
        return F.transform(valid, lambda x: F.struct(x["n"].alias("n"), F.regexp_replace(x["s"], "[ -]$", "").rlike(_PRINTED).alias("printed")))

    def taken(all_spans: Column) -> Column:
        """By group: (groups of the card from here or 0, groups left over after it)."""
        printed = F.transform(all_spans, lambda x: F.coalesce(F.array_max(F.transform(F.filter(x, lambda y: y["printed"]), lambda y: y["n"])), F.lit(0)))

        def one(x: Column, i: Column, p: Column) -> Column:
            free = F.filter(x, lambda y: ~F.exists(F.slice(p, i + 2, y["n"] - 1), lambda z: z > 0))
            size = F.when(p[i] > 0, p[i]).otherwise(F.coalesce(F.array_max(F.transform(free, lambda y: y["n"])), F.lit(0)))
            return let(size, lambda n: F.struct(n.alias("n"), F.when(n > 1, F.array_max(F.transform(F.slice(p, i + 2, n - 1), lambda z, j: F.when(z > 0, z + j + 1 - n).otherwise(0)))).otherwise(0).alias("more")))

        return let(printed, lambda p: F.transform(all_spans, lambda x, i: one(x, i, p)))

    def walked(x: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            here = x["t"][i]
            more = F.greatest(here["more"], F.lit(0))
            part = F.concat(_card(F.array_join(F.slice(x["g"], i + 1, here["n"]), ""), key), F.when(more > 0, permute(F.array_join(F.slice(x["g"], i + 1 + here["n"], more), ""), key, "card")).otherwise(""))
            return F.when(acc["skip"] > 0, F.struct(acc["out"].alias("out"), (acc["skip"] - 1).alias("skip"))).when(
                here["n"] > 0, F.struct(F.concat(acc["out"], part).alias("out"), (here["n"] + more - 1).alias("skip"))
            ).otherwise(F.struct(F.concat(acc["out"], x["g"][i]).alias("out"), F.lit(0).alias("skip")))

        return F.aggregate(F.sequence(F.lit(0), F.size(x["g"]) - 1), F.struct(F.lit("").alias("out"), F.lit(0).alias("skip")), step, lambda acc: acc["out"])

    def replaced(g: Column) -> Column:
        return let(F.transform(F.sequence(F.lit(0), F.size(g) - 1), lambda i: spans(g, i)), lambda all_spans: let(F.struct(g.alias("g"), taken(all_spans).alias("t")), walked))

    return let(F.regexp_extract_all(m, F.lit("[0-9]+[ -]?"), F.lit(0)), replaced)


def _mod97(s: Column) -> Column:
    def add(acc: Column, c: Column) -> Column:
        return F.when(c.between("0", "9"), (acc * 10 + F.ascii(c) - 48) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(_chars(s), F.lit(0), add)


def _iban(m: Column, key: str) -> Column:
    """A valid account number, its check digits computed anew."""
    def swap(bare: Column) -> Column:
        country, body = F.substring(bare, 1, 2), F.substring(bare, F.lit(5), F.length(bare) - 4)
        made = let(permute(body, key, "iban"), lambda b: F.concat(country, F.lpad((98 - _mod97(F.concat(b, country, F.lit("00")))).cast("string"), 2, "0"), b))
        return let(made, lambda x: F.when(F.contains(m, F.lit(" ")), F.rtrim(F.regexp_replace(x, "(.{4})", "$1 "))).otherwise(x))

    return let(F.regexp_replace(m, " ", ""), swap)


def _numbers(m: Column, key: str) -> Column:
    """A row of groups with every account number and card in it replaced.

    Account numbers come first: from the left, the most groups (of at most 34 letters and digits)
    that pass. Cards are sought in what lies between.
    """
    def fit(groups: Column, i: Column) -> Column:
        n = F.size(groups)
        tries = F.transform(F.sequence(F.least(F.lit(9), n - i), F.lit(1), F.lit(-1)), lambda k: F.struct(k.alias("k"), F.array_join(F.slice(groups, i + 1, k), "").alias("bare")))

        def valid(x: Column) -> Column:
            size, bare = F.length(x["bare"]), x["bare"]
            whole = size.between(15, 34) | ((i == 0) & (x["k"] == n) & (size > 4))
            return whole & ((x["k"] == 1) == (F.length(groups[i]) > 4)) & (_mod97(F.concat(F.substring(bare, F.lit(5), size - 4), F.substring(bare, 1, 4))) == 1)

        return F.when(groups[i].rlike("^[A-Z]{2}[0-9]{2}([A-Z0-9]{11,30})?$"), F.coalesce(F.get(F.filter(tries, valid), F.lit(0))["k"], F.lit(0))).otherwise(0)

    def marked(x: Column) -> Column:
        """The groups in a row, account numbers between marks."""
        def step(acc: Column, i: Column) -> Column:
            gap, k = F.when(i > 0, " ").otherwise(""), x["k"][i]
            return F.when(acc["skip"] > 0, F.struct(acc["out"].alias("out"), (acc["skip"] - 1).alias("skip"))).when(
                k > 0, F.struct(F.concat(acc["out"], gap, F.lit("\x01"), F.array_join(F.slice(x["g"], i + 1, k), " "), F.lit("\x01")).alias("out"), (k - 1).alias("skip"))
            ).otherwise(F.struct(F.concat(acc["out"], gap, x["g"][i]).alias("out"), F.lit(0).alias("skip")))

        return F.aggregate(F.sequence(F.lit(0), F.size(x["g"]) - 1), F.struct(F.lit("").alias("out"), F.lit(0).alias("skip")), step, lambda acc: acc["out"])

    row = let(F.split(m, " "), lambda g: let(F.struct(g.alias("g"), F.transform(g, lambda _, i: fit(g, i)).alias("k")), marked))
    parts = F.split(F.when(m.rlike("^[0-9]"), m).otherwise(row), "\x01", -1)
    return F.array_join(F.transform(parts, lambda x, i: F.when(i % 2 == 1, _iban(x, key)).otherwise(_swapped(x, _CARD, lambda c: _cards(c, key)))), "")


def _address(m: Column, key: str) -> Column:
    octets = F.transform(F.split(m, r"\."), lambda o: o.cast("int"))
    flat = F.array_join(F.transform(octets, lambda o: F.lower(F.lpad(F.hex(o), 2, "0"))), "")
    made = let(permute(flat, key, "address", True), lambda h: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.conv(F.substring(h, 2 * i + 1, F.lit(2)), 16, 10)), "."))
    return F.when(F.forall(octets, lambda o: o <= 255), made).otherwise(m)


def _date(m: Column, key: str) -> Column:
    """A valid date moves within its hundred years (from 1950 on, and so before and after).

    Such a span has 36,525 days (75 x 487) or 36,524 (92 x 397); the day number is permuted as a
    pair of those radices. Slashed dates are read day first, or month first where only that is valid.
    """
    iso, dotted = m.contains("-"), m.contains(".")
    spread = F.split(m, r"[./-]")
    ymd = F.when(iso, m).otherwise(F.concat_ws("-", spread[2], spread[1], spread[0]))
    mdy = F.when(~iso & ~dotted, F.concat_ws("-", spread[2], spread[0], spread[1]))

    def moved(x: Column) -> Column:
        first = F.make_date((F.floor((F.year(x["day"]) - 1950) / 100) * 100 + 1950).cast("int"), F.lit(1), F.lit(1))
        days = F.datediff(F.add_months(first, F.lit(1200)), first)
        wide = F.when(days == 36525, 487).otherwise(397)
        narrow = F.when(days == 36525, 75).otherwise(92)

        def rounds(y: Column) -> Column:
            start = F.struct(F.floor(y["n"] / y["w"]).cast("int").alias("a"), y["s"].alias("ra"), F.pmod(y["n"], y["w"]).cast("int").alias("b"), y["w"].alias("rb"))

            def step(acc: Column, i: Column) -> Column:
                f = F.conv(F.substring(_digest(key, F.lit("date"), y["first"].cast("string"), i.cast("string"), acc["b"].cast("string")), 1, 8), 16, 10).cast("bigint")
                return F.struct(acc["b"].alias("a"), acc["rb"].alias("ra"), F.pmod(acc["a"] + f, acc["ra"]).cast("int").alias("b"), acc["ra"].alias("rb"))

            return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda acc: F.date_add(y["first"], acc["a"] * y["w"] + acc["b"]))

        new = let(F.struct(F.datediff(x["day"], first).alias("n"), first.alias("first"), wide.alias("w"), narrow.alias("s")), rounds)
        return let(new, lambda d: F.when(iso, F.date_format(d, "yyyy-MM-dd")).when(dotted, F.date_format(d, "dd.MM.yyyy")).when(x["month_first"], F.date_format(d, "MM/dd/yyyy")).otherwise(F.date_format(d, "dd/MM/yyyy")))

    day = F.try_to_date(ymd, "yyyy-MM-dd")
    found = F.struct(F.coalesce(day, F.try_to_date(mdy, "yyyy-MM-dd")).alias("day"), day.isNull().alias("month_first"))
    return let(found, lambda x: F.when(x["day"].isNotNull() & (F.year(x["day"]) >= 1050), moved(x)).otherwise(m))


def _token(m: Column, key: str) -> Column:
    """A secret value: hexadecimal digits stay so, other values keep their character classes."""
    return F.when(m.rlike("^[0-9a-f]+$"), permute(m, key, "hex", True)).when(
        m.rlike("^[0-9A-F]+$"), F.upper(permute(F.lower(m), key, "hex", True))
    ).otherwise(permute(m, key, "token"))


def _after(m: Column, head: str, swap: Callable[[Column], Column]) -> Column:
    """Apply ``swap`` to what follows the text that ``head`` matches."""
    return let(F.length(F.regexp_extract(m, head, 0)), lambda n: F.concat(F.substring(m, F.lit(1), n), swap(F.substring(m, n + 1, F.length(m)))))


def pseudonym(m: Column, key: str) -> Column:
    """The pseudonym of one match of ``PATTERN``; a match that is not valid stays as it is."""
    return (
        F.when(m.rlike(f"^(?:{_NAMED}|{_BEARER})"), _after(m, f"^(?:{_BEARER}|{_NAMED})", lambda s: _token(s, key)))
        .when(m.rlike(f"^(?:{_ADDRESS6})$"), permute(F.lower(m), key, "address6", True))
        .when(m.contains("@"), F.concat(permute(F.substring_index(m, "@", 1), key, "email"), F.lit("@"), F.substring_index(m, "@", -1)))
        .when(m.rlike("^(AKIA|ASIA)[A-Z0-9]{16}$"), F.concat(F.substring(m, 1, 4), permute(F.substring(m, 5, 16), key, "access")))
        .when(m.rlike("^[0-9a-fA-F]{32,}$"), _token(m, key))
        .when(m.rlike(f"^(?:{_DATE})$"), _date(m, key))
        .when(m.rlike(r"^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+$"), _address(m, key))
        .when(m.rlike(f"^(?:{_SOCIAL})$"), permute(m, key, "social"))
        .when(m.rlike("^[A-Z]{2}[0-9]{2}|^[0-9][0-9 -]*$") & ~m.rlike("^[0-9]{3}-[0-9]{3}-[0-9]{4}$"), _numbers(m, key))
        .otherwise(_after(m, r"^(?:\+[0-9]{1,3}[ .(-])?", lambda s: permute(s, key, "phone")))
    )


def pseudonymised(text: Column, key: str) -> Column:
    """``text`` with every valid match replaced; null stays null."""
    return F.when(text.rlike("[0-9@=:]|AKIA|ASIA"), _swapped(text, PATTERN, lambda m: pseudonym(m, key))).otherwise(text)


def mask(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with pseudonyms in text, and n_chars (where present) set to the new length.

    Whoever has ``key`` can compute the permutation backwards: keep it as a secret. The domain of a
    mail address stays. Texts of any length go through whole; an empty table stays empty.
    Rows and all other columns are unchanged; repeated rows, empty texts and null texts stay.
    """
    changed = {"text": pseudonymised(F.col("text"), key)}
    out = docs.withColumns(changed)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kind)))
    return out


def op3_feistel_pii(spark, sf_dir: str) -> DataFrame:
    """All documents with pseudonyms for their personal data (under a test key)."""
    return mask(common.table(spark, sf_dir, "documents").select("doc_id", "text"), "test key, not secret")
