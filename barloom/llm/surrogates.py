"""Surrogates for personal data, as column expressions only.

Entities are found by one pattern. An entity's canonical form (lower case for addresses
and names, bare digits for numbers) is what coreference goes by: all spellings of one
entity get the same surrogate, each in its own format. The surrogate is a function of
(secret key, type, canonical form, attempt): digits stay digits, letters stay letters of
their script and case, separators stay, an IPv4 address stays one, a card number keeps
its issuer digit and its checksum state, names follow the title's gender and the script.

Since it is a function, texts are never shuffled for it. Distinctness is checked on the
distinct entities of the whole corpus: two entities with one surrogate, or a surrogate
that is somebody's real entity, give the loser another attempt until none is left. Only
these exceptions (none or few) are joined back to the texts that hold them.

Defined results: null and empty texts stay as they are; extra columns pass through; a
text that repeats is changed alike in every row; an empty table stays empty.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import small_side, stored

# Titles by gender, and name parts to build surrogates from.
TITLES = {
    "m": ["Mr", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "Господин"],
    "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа"],
    "n": ["Dr", "Prof"],
}
FIRST_NAMES = {
    ("latin", "m"): ["Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Georg", "Hugo",
                     "Ivan", "Jonas", "Karel", "Leon", "Martin", "Nils", "Oscar", "Paul"],
    ("latin", "f"): ["Alma", "Berta", "Clara", "Diana", "Elena", "Flora", "Greta", "Hanna",
                     "Irene", "Julia", "Karin", "Laura", "Maria", "Nora", "Olga", "Paula"],
    ("latin", "n"): ["Alex", "Andrea", "Chris", "Dana", "Eli", "Gabriel", "Jan", "Kim",
                     "Luca", "Max", "Nico", "Robin", "Sam", "Sasha", "Toni", "Val"],
    ("cyrillic", "m"): ["Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Кирилл"],
    ("cyrillic", "f"): ["Анна", "Вера", "Галина", "Дарья", "Елена", "Ирина", "Ксения", "Мария"],
    ("cyrillic", "n"): ["Саша", "Женя", "Валя", "Слава"],
}
SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga go ka ke ko la le lo ma me mo na ne no pa pe po ra re "
             "ro sa se so ta te to va ve vo wa we za".split(),
    "cyrillic": "ба бе бо да де до га го ка ко ла ле ло ма ме мо на не но па по ра ре ро са со "
                "та те то ва ве во за зе зо".split(),
}
ALPHABETS = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789",
             "абвгдежзийклмнопрстуфхцчшщыэюя", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЫЭЮЯ",
             "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ",
             "的一是不了人我在有他这为之大来以个中上们"]

_TITLE = "|".join(t for ts in TITLES.values() for t in ts)
_SECRET = "password|passwd|token|secret|api_key|apikey"
#: (type, pattern). The order decides where two could start at the same place.
PATTERNS = [
    ("email", r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+"),
    ("aws_key", r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9])"),
    ("secret", rf"(?<=(?:{_SECRET})\s{{0,2}}[=:]\s{{0,2}}[\"']?)"
               r"[A-Za-z0-9+/_-]{8,}"),
    ("hex_key", r"(?<![A-Za-z0-9])[0-9a-fA-F]{32,64}(?![A-Za-z0-9])"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    ("ipv4", r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\d|\.\d)"),
    ("card", r"(?<![\d+])\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{1,7}(?!\d)"),
    ("ssn", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"),
    ("phone", r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,5}(?:[ .-]?\d{2,5}){1,4}(?!\d)"
              r"|(?<!\d)\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\d.-])\d{3}[.-]\d{3}[.-]\d{4}(?!\d)"),
    ("name", rf"(?<![\p{{L}}])(?:{_TITLE})\.? \p{{Lu}}\p{{Ll}}+(?: \p{{Lu}}\p{{Ll}}+)?"),
]
ANY = "|".join(f"(?:{p})" for _, p in PATTERNS)
MAYBE = (rf"[0-9@]|(?:{_TITLE})\.? \p{{Lu}}|(?:{_SECRET})\s{{0,2}}[=:]|(?:AKIA|ASIA)[A-Z]{{16}}"
         r"|[a-fA-F]{32}")
#: The same forms once more, for one entity by itself, where no neighbours are seen.
_KINDS = [
    ("email", r"^[^@\s]+@[^@\s]+$"), ("aws_key", r"^(?:AKIA|ASIA)[0-9A-Z]{16}$"),
    ("ipv4", r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$"), ("ssn", r"^\d{3}-\d{2}-\d{4}$"),
    ("phone", r"^[+(][\d .()-]+$|^\d{3}[.-]\d{3}[.-]\d{4}$"), ("hex_key", r"^[0-9a-fA-F]{32,64}$"),
    ("card", r"^[\d -]{13,22}$"), ("iban", r"^[A-Z]{2}\d{2}[A-Z0-9 ]+$"),
    ("name", rf"^(?:{_TITLE})\.? "),
]


def kind(entity: Column) -> Column:
    tests = reduce(lambda c, k: c.when(entity.rlike(k[1]), k[0]), _KINDS[1:],
                   F.when(entity.rlike(_KINDS[0][1]), _KINDS[0][0]))
    return tests.otherwise("secret")


def let(value: Column, body) -> Column:
    """`body` of a value that is computed once, however often `body` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _canonical(entity: Column, k: Column) -> Column:
    return (F.when(k == "email", F.lower(entity))
            .when(k.isin("card", "phone", "ssn"), F.regexp_replace(entity, r"\D", ""))
            .when(k == "iban", F.replace(entity, F.lit(" "), F.lit("")))
            .when(k == "name", F.lower(F.regexp_replace(entity, r"^\S+ ", "")))
            .otherwise(entity))


def canonical(entity: Column) -> Column:
    """What all spellings of one entity share."""
    return let(kind(entity), lambda k: _canonical(entity, k))


def _draws(seed: Column, n: Column) -> Column:
    """At least n keyed numbers below 2^32; one digest gives 8."""
    def eight(i):
        return let(F.sha2(F.concat(seed, F.lit("|"), i.cast("string")), 256), lambda h: F.transform(
            F.sequence(F.lit(0), F.lit(7)),
            lambda j: F.conv(F.substring(h, j * 8 + 1, F.lit(8)), 16, 10).cast("long")))
    return F.flatten(F.transform(F.sequence(F.lit(0), F.floor(n / 8)), eight))


def _at(items: Column, n: Column) -> Column:
    """The (n mod size)-th item."""
    return F.element_at(items, (F.pmod(n, F.size(items)) + 1).cast("int"))


def _names(items: list[str]) -> Column:
    return F.split(F.lit(" ".join(items)), " ")


def _same_shape(text: Column, draws: Column, kept: Column, hexadecimal: bool = False) -> Column:
    """Each character after the first `kept` ones replaced by one of its script and case."""
    tests = [r"^[a-zß-ɏ]$", r"^[A-ZÀ-Þ]$", r"^[0-9]$", r"^[а-џ]$", r"^[Ѐ-Я]$",
             r"^[ά-ώ]$", r"^[Ά-Ϋ]$", r"^[一-鿿]$"]
    alphabets = ["abcdef", *ALPHABETS[1:]] if hexadecimal else ALPHABETS

    def one(i):
        def other(c):
            letters = F.when(i <= kept, c)
            for test, alphabet in zip(tests, alphabets):
                letters = letters.when(c.rlike(test), F.lit(alphabet))
            return let(letters.otherwise(c), lambda a: F.substring(
                a, (F.pmod(_at(draws, i.cast("long")), F.char_length(a)) + 1).cast("int"), F.lit(1)))
        return let(F.substring(text, i, F.lit(1)), other)

    n = F.char_length(text)
    return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(1), n), one), "")).otherwise(text)


def _luhn(digits: Column) -> Column:
    """The checksum of a digit string (0: it holds)."""
    doubled = F.transform(F.split(F.reverse(digits), ""), lambda c, i: c.cast("int")
                          * F.when(F.pmod(i, F.lit(2)) == 1, 2).otherwise(1))
    return F.pmod(F.aggregate(doubled, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x)),
                  F.lit(10))


def _card(digits: Column, draws: Column) -> Column:
    """First digit kept; the checksum holds if it held before, and fails otherwise."""
    def close(body):
        due = 10 - _luhn(F.concat(body, F.lit("0")))
        off = F.when(_luhn(digits) == 0, F.lit(0)).otherwise(F.pmod(_at(draws, F.lit(0)), F.lit(9)) + 1)
        return F.concat(body, F.pmod(due + off, F.lit(10)).cast("int").cast("string"))
    return let(_same_shape(F.substring(digits, F.lit(1), F.char_length(digits) - 1), draws, F.lit(1)), close)


def _refill(shape: Column, digits: Column) -> Column:
    """The digits written into the places that digits have in `shape`."""
    start = F.struct(F.lit("").alias("s"), F.lit(1).alias("k"))
    return let(digits, lambda d: F.aggregate(
        F.split(shape, ""), start,
        lambda a, c: F.struct(
            F.concat(a["s"], F.when(c.rlike("[0-9]"), F.substring(d, a["k"], F.lit(1))).otherwise(c)).alias("s"),
            (a["k"] + F.when(c.rlike("[0-9]"), 1).otherwise(0)).alias("k")),
        lambda a: a["s"]))


def _name(entity: Column, draws: Column, attempt: Column) -> Column:
    """Title kept; as many names as before, for its gender, in its script.

    A further attempt lengthens the surname, so the supply of names never ends.
    """
    bare = F.regexp_extract(entity, r"^[^. ]+", 0)

    def named(rest):
        cyrillic = rest.rlike(r"\p{IsCyrillic}")
        pool = F.when(F.lit(False), _names(["-"]))
        for (script, gender), items in FIRST_NAMES.items():
            fits = bare.isin(TITLES[gender]) & (cyrillic if script == "cyrillic" else ~cyrillic)
            pool = pool.when(fits, _names(items))
        parts = F.when(cyrillic, _names(SYLLABLES["cyrillic"])).otherwise(_names(SYLLABLES["latin"]))
        last = F.initcap(F.array_join(F.transform(
            F.sequence(F.lit(1), attempt + 3), lambda i: _at(parts, _at(draws, i.cast("long")))), ""))
        first = F.when(rest.contains(" "), F.concat(_at(pool, _at(draws, F.lit(0))), F.lit(" ")))
        return F.concat(F.regexp_extract(entity, r"^\S+ ", 0), F.coalesce(first, F.lit("")), last)

    return let(F.regexp_replace(entity, r"^\S+ ", ""), named)


def _email(entity: Column, canon: Column, draws: Column, key: str, attempt: Column) -> Column:
    """Users of one host stay users of one host; the top-level domain stays."""
    def with_host(host):
        top = F.concat(F.lit("."), F.substring_index(host, ".", -1))
        name = F.substring(host, F.lit(1), F.char_length(host) - F.char_length(top))
        seed = F.concat_ws("|", F.lit(key), F.lit("host"), host, attempt.cast("string"))
        return F.concat(let(_draws(seed, F.char_length(host)), lambda d: _same_shape(name, d, F.lit(0))), top)
    return F.concat(_same_shape(F.substring_index(entity, "@", 1), draws, F.lit(0)), F.lit("@"),
                    let(F.substring_index(canon, "@", -1), with_host))


def _drawn(entity: Column, k: Column, canon: Column, draws: Column, key: str, attempt: Column) -> Column:
    octets = F.array_join(F.transform(F.slice(draws, 1, 4), lambda d: F.pmod(d, F.lit(256)).cast("string")), ".")
    country = F.char_length(F.regexp_extract(entity, r"^\+(\d{1,3})(?=[ .(-])", 1))
    return (F.when(k == "email", _email(entity, canon, draws, key, attempt))
            .when(k == "ipv4", octets)
            .when(k == "card", _refill(entity, _card(canon, draws)))
            .when(k.isin("phone", "ssn"), _refill(entity, _same_shape(canon, draws, country)))
            .when(k == "name", _name(entity, draws, attempt))
            .when(entity.rlike("^[0-9a-f]+$"), _same_shape(entity, draws, F.lit(0), True))
            .otherwise(_same_shape(entity, draws, F.when(k == "aws_key", 4).when(k == "iban", 2).otherwise(0))))


def surrogate(entity: Column, key: str, attempt: Column) -> Column:
    """The replacement of one entity, in the format in which it stands."""
    return let(kind(entity), lambda k: let(_canonical(entity, k), lambda c: let(
        _draws(F.concat_ws("|", F.lit(key), k, c, attempt.cast("string")), F.char_length(entity) + 8),
        lambda d: _drawn(entity, k, c, d, key, attempt))))


def _entities(text: Column) -> Column:
    # The cheap test first. Every match of a pattern holds a digit, an @, a title, or one of
    # the forms that letters alone can make: a secret's keyword, a key's prefix, hex letters.
    maybe = text.rlike(MAYBE)
    return F.when(maybe, F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(
        F.array().cast("array<string>"))


def collisions(entities: DataFrame, key: str, rounds: int = 20) -> DataFrame:
    """Entities (kind, canon, entity: a spelling) whose first surrogate won't do, with the
    attempt that will. The result is stored and usually empty."""
    def drawn(e):
        return stored(e.withColumn("new", canonical(surrogate(F.col("entity"), key, F.col("attempt")))))

    now = drawn(entities.withColumn("attempt", F.lit(0)))
    for _ in range(rounds):
        twice = (now.groupBy("kind", "new").agg(F.min("canon").alias("_first"), F.count(F.lit(1)).alias("_n"))
                 .where("_n > 1").select("kind", "new", "_first"))
        real = now.select("kind", F.col("canon").alias("new")).withColumn("_real", F.lit(True))
        lost = (now.join(twice, ["kind", "new"], "left").join(real, ["kind", "new"], "left")
                .where("_real or canon != _first").select("kind", "canon"))
        lost = stored(lost)
        if lost.isEmpty():
            return now.where("attempt > 0").select("kind", "canon", "attempt")
        again = now.join(lost.withColumn("_lost", F.lit(1)), ["kind", "canon"], "left")
        now = drawn(again.select("kind", "canon", "entity",
                                 (F.col("attempt") + F.coalesce("_lost", F.lit(0))).alias("attempt")))
    raise ValueError(f"surrogates still collide after {rounds} attempts")


def replace_private_data(docs: DataFrame, key: str, text: str = "text",
                         count: str = "n_entities") -> DataFrame:
    """The rows of `docs` with entities in `text` replaced; `count` has their number."""
    t = F.col(text)
    found = docs.select(F.explode(F.array_distinct(_entities(t))).alias("entity"))
    distinct = (found.select(kind(F.col("entity")).alias("kind"), canonical(F.col("entity")).alias("canon"),
                             "entity")
                .groupBy("kind", "canon").agg(F.min("entity").alias("entity")))
    exceptions = collisions(stored(distinct), key)
    out = docs.withColumn("_barloom_ents", _entities(t))
    if exceptions.isEmpty():
        out = out.withColumn("_barloom_tries", F.lit(None).cast("map<string,int>"))
    else:
        # Attempts by text, for the few texts that hold an exception.
        held = (docs.select(F.md5(t).alias("_barloom_h"), F.explode(F.array_distinct(_entities(t))).alias("entity"))
                .select("_barloom_h", kind(F.col("entity")).alias("kind"), canonical(F.col("entity")).alias("canon"))
                .join(small_side(exceptions), ["kind", "canon"]).distinct())
        tries = stored(held.groupBy("_barloom_h").agg(F.map_from_entries(F.collect_set(
            F.struct(F.concat_ws("|", "kind", "canon"), F.col("attempt")))).alias("_barloom_tries")))
        out = out.withColumn("_barloom_h", F.md5(t)).join(small_side(tries), "_barloom_h", "left").drop("_barloom_h")
    pieces = F.split(t, ANY, -1)
    new = F.transform("_barloom_ents", lambda e: surrogate(e, key, F.coalesce(
        F.try_element_at("_barloom_tries", F.concat_ws("|", kind(e), canonical(e))), F.lit(0))))
    both = F.zip_with(pieces, new, lambda p, n: F.concat(p, F.coalesce(n, F.lit(""))))
    done = F.when(F.size("_barloom_ents") > 0, F.array_join(both, "")).otherwise(t)
    return (out.withColumn(text, done).withColumn(count, F.greatest(F.size("_barloom_ents"), F.lit(0)).cast("long"))
            .select(*docs.columns, count))
