"""PII replaced by surrogates, in DataFrame functions only.

Entities are found by one pattern over the text. Every different entity, in a
canonical form, gets one surrogate for the whole table, drawn by a keyed digest:
digits become digits and letters letters, card numbers keep their check digit
right (or wrong), addresses stay addresses, and names keep title, gender and
script. So the same entity has the same surrogate in every document and however
it is written (``+1 (389) 555-5010`` and ``+1 389 555 5010``).

Persons are found by their titles, and then, in the same document, wherever
their names stand without one, in capitals too. A given name's gender is that of the title;
where a person (given name and surname) has a title of one gender anywhere in
the table, it is theirs wherever they stand with another title or none. A
surname is the same with and without given name.

A table of all surrogates is checked: where two entities drew the same, or one
drew a real entity, all but the first draw again, until every surrogate is
distinct; from the fourth attempt on surrogates get longer within their format,
so that short entities run out of no surrogates. Then each text is cut at its
entities and joined again around their surrogates.

Formats have bounds, and patterns theirs: a name has 64 letters at most, an
address of mail 64 before the sign and 127 labels of 63 behind it. A longer word
behind a title is no name, a longer label no address, and of more labels the
first 127 count. Secrets may be of any length. All steps are linear in a text's
length, and no pattern's depth grows with it.

Defined cases: null texts stay null and have no entities; texts without
entities are untouched; repeated rows get equal texts; an empty table gives an
empty result; with titles of both genders a person's other mentions are of none;
columns named like a result are replaced. A table that after ``ATTEMPTS`` rounds
still has two entities with one surrogate is an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

# Names that stand for others, by gender and script.
GIVEN = {
    "f_latin": "Alice Anna Clara Diana Elena Emma Eva Grace Hanna Helena Ida Irene Julia Karin Laura Lea Lena Lucia Maria Marta Mia Nina Nora Olga Paula Rosa Ruth Sara Sofia Vera".split(),
    "m_latin": "Adam Alan Albert Anton Bruno Carl Daniel David Emil Erik Felix Frank Hugo Ivan Jan Jonas Karl Leo Lukas Marco Martin Max Oscar Otto Paul Peter Simon Theo Tomas Victor".split(),
    "x_latin": "Alex Andrea Charlie Chris Dominique Eli Francis Jamie Jean Jo Kim Lee Lou Morgan Nico Noa Pat Robin Rowan Sam Sascha Sidney Toni Val".split(),
    "f_cyrillic": "Анна Вера Галина Дарья Елена Зоя Ирина Лидия Мария Нина Ольга Софья".split(),
    "m_cyrillic": "Антон Борис Виктор Глеб Денис Иван Кирилл Лев Максим Олег Павел Роман".split(),
    "x_cyrillic": "Саша Женя Валя Слава Шура Паша".split(),
    "f_greek": "Άννα Ελένη Ιωάννα Κατερίνα Μαρία Νίκη Σοφία Χριστίνα".split(),
    "m_greek": "Αλέξης Γιάννης Δημήτρης Κώστας Μιχάλης Νίκος Πέτρος Σταύρος".split(),
    "x_greek": "Μάκης Βίκη Λάκης Τζένη".split(),
}
SURNAMES = {
    "latin": "Abel Baker Berger Carter Castillo Dubois Ellis Fischer Fontaine Garnier Hansen Hoffmann Iverson Jansen Keller Lambert Lindgren Marchetti Mercer Navarro Novak Ortega Palmer Petersen Quinn Richter Romero Sanders Schubert Tanner Thorne Ullmann Vargas Vidal Wagner Weber Winter Young Zeller".split(),
    "cyrillic": "Белов Волков Громов Дубов Зимин Козлов Лебедев Морозов Новиков Орлов Петров Соколов".split(),
    "greek": "Αγγέλου Βασιλείου Γεωργίου Ιωάννου Κώστα Νικολάου Παππά Χρήστου".split(),
}
TITLES = {
    "f": ("Mrs", "Ms", "Miss", "Madam", "Lady", "Frau", "Madame", "Mme", "Mlle", "Señora", "Señorita", "Sra", "Srta", "Doña", "госпожа", "г-жа", "κυρία"),
    "m": ("Mr", "Sir", "Herr", "Monsieur", "Señor", "Sr", "Don", "господин", "г-н", "κύριος"),
    "x": ("Dr", "Prof", "Professor", "Doctor"),
}

OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
#: Every repetition of a group has a bound, as what it stands for has; repetitions of one kind of character need none.
NAME = r"\p{Lu}(?:\p{L}|['’-](?=\p{L})(?!s(?!\p{L}))){1,63}(?!\p{L}|['’-](?=\p{L})(?!s(?!\p{L})))"
TITLE = rf"(?<![\p{{L}}\p{{N}}])(?:{'|'.join(sorted((t for ts in TITLES.values() for t in ts), key=len, reverse=True))})\.?"
#: In order: of two that begin at the same place, the first counts.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}+\.){1,126}[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "secret": r"""(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])|(?<=(?i:password|passwd|secret|token|api_key|apikey) ?[=:] ?"?)[^\s"=]{8,}""",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": r"(?<![\d.+-])\d{4}([ -]?)\d{4}\1\d{4}\1\d{1,7}(?![\d-])|(?<![\d.+-])3\d{3}[ -]?\d{6}[ -]?\d{5}(?![\d-])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)|(?<![\w(])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\d.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])",
    "ip": rf"(?<![A-Za-z\d.]){OCTET}(?:\.{OCTET}){{3}}(?!\.?\d)",
    "person": rf"{TITLE}\s{NAME}(?:\s{NAME})?",
}
KINDS = tuple(PATTERNS)
#: No entity begins inside a word, unless with a digit after a letter: most places are passed over by this alone.
GUARD = r"(?:(?<![A-Za-z0-9])|(?<=[A-Za-z])(?=\d))"
PATTERN = GUARD + "(?:" + "|".join(f"(?:{p})" for p in PATTERNS.values()).replace(r"([ -]?)\d{4}\1\d{4}\1", r"(?: ?\d{4} ?|-?\d{4}-?)\d{4}[ -]?") + ")"


def kind_of(value: Column) -> Column:
    """The kind of a found entity: the first whose whole pattern it fits."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    return (
        F.when(value.rlike(r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+$"), "email")
        .when(value.rlike(rf"^{TITLE}\s"), "person")
        .when(value.rlike(r"^(?:AKIA|ASIA)[A-Z0-9]{16}$"), "secret")
        .when(value.rlike(r"^[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?$"), "iban")
        .when(value.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$"), "ip")
        .when(value.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when(value.rlike(r"^[0-9 -]+$") & F.length(digits).between(13, 19), "card")
        .when(value.rlike(r"^[+(0-9][0-9 ().-]+$") & F.length(digits).between(7, 15), "phone")
        .otherwise("secret")
    )


def canonical(value: Column, kind: Column) -> Column:
    """What entities have in common however they are written."""
    return F.when(kind == "email", F.lower(value)).when(kind.isin("card", "ssn", "phone", "iban"), F.regexp_replace(value, "[^0-9A-Za-z]", "")).otherwise(value)


def script_of(name: Column) -> Column:
    return F.when(name.rlike(r"\p{IsCyrillic}"), "cyrillic").when(name.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def title_of(value: Column) -> Column:
    return F.regexp_extract(value, rf"^{TITLE}\s", 0)


def gender_of(value: Column) -> Column:
    title = F.regexp_replace(F.trim(title_of(value)), r"\.$", "")
    return F.when(title.isin(*TITLES["f"]), "f").when(title.isin(*TITLES["m"]), "m").otherwise("x")


def names_of(value: Column) -> Column:
    return F.split(F.regexp_replace(value, rf"^{TITLE}\s", ""), r"\s")


def parts_of(each: DataFrame, scratch: common.Scratch) -> DataFrame:
    """(mark, len, key, kind, value) from (mark, len, m, kind): what to draw for each entity of a text. ``key`` is how the text asks for it."""
    plain = canonical(F.col("m"), F.col("kind"))
    others = each.filter("kind <> 'person'").select("mark", "len", F.concat_ws("|", "kind", plain).alias("key"), "kind", plain.alias("value"))
    names = names_of(F.col("m"))
    persons = each.filter("kind = 'person'").select("mark", "len", gender_of(F.col("m")).alias("gender"), F.when(F.size(names) > 1, names[0]).alias("given"), F.element_at(names, -1).alias("surname"))
    persons = scratch.save(persons.distinct(), "persons")
    surnames = persons.select("mark", "len", F.concat_ws("|", F.lit("surname"), "surname").alias("key"), F.concat(F.lit("surname_"), script_of(F.col("surname"))).alias("kind"), F.col("surname").alias("value"))
    full = persons.filter("given IS NOT NULL")
    known = scratch.save(full.groupBy("given", "surname").agg(F.bool_or(F.col("gender") == "f").alias("f"), F.bool_or(F.col("gender") == "m").alias("m")), "genders")
    sure = F.when(F.col("f") & ~F.col("m"), "f").when(F.col("m") & ~F.col("f"), "m")
    told = full.join(known.hint("merge"), ["given", "surname"]).withColumns({"own": F.coalesce(sure, "gender"), "other": F.coalesce(sure, F.lit("x"))})
    first = lambda df, gender, *key: df.select("mark", "len", F.concat_ws("|", F.lit("given"), *key).alias("key"), F.concat_ws("_", F.lit("given"), gender, script_of(F.col("given"))).alias("kind"), F.col("given").alias("value"))
    alone = told.groupBy("mark", "len", "given").agg(F.min("other").alias("least"), F.max("other").alias("most"))
    titled = first(told, F.col("own"), "gender", "given", "surname")
    untitled = first(told, F.col("other"), F.lit("-"), "given", "surname")
    bare = first(alone, F.when(F.col("least") == F.col("most"), F.col("least")).otherwise("x"), F.lit("-"), "given", F.lit(""))
    return others.unionByName(surnames).unionByName(titled).unionByName(untitled).unionByName(bare).distinct()


def names_pattern(known: Column) -> Column:
    """The names of a text's persons, wherever they stand alone; null if there are none. Names consist of letters, apostrophes and hyphens."""
    keys = F.map_keys(known)
    last = F.filter(F.transform(keys, lambda k: F.when(k.startswith("surname|"), F.substring_index(k, "|", -1))), lambda n: n.isNotNull())
    given = F.filter(F.transform(keys, lambda k: F.when(k.rlike(r"^given\|-\|[^|]*\|$"), F.substring_index(F.substring_index(k, "|", 3), "|", -1))), lambda n: n.isNotNull())
    longest = lambda names: F.array_join(F.reverse(F.array_sort(names)), "|")  # noqa: E731  a name before those it begins with
    full = F.when(F.size(given) > 0, F.concat(F.lit("(?:"), longest(given), F.lit(r")\s(?:"), longest(last), F.lit(")|"))).otherwise("")
    either = longest(F.concat(last, given))  # in capitals as well: the map has them
    return F.when(F.size(last) > 0, F.concat(F.lit(r"(?<![\p{L}\p{N}])(?:"), full, F.lit("(?:"), either, F.lit(r"))(?![\p{L}\p{N}])")))


def in_capitals(key: Column, surrogate: Column) -> Column:
    """A key and its surrogate; where it is a name that stands without a title, also both in capitals."""
    plain = F.struct(key.alias("key"), surrogate.alias("surrogate"))
    name = F.regexp_replace(key, r"^(?:surname|given\|-)\|", "")
    loud = F.struct(F.concat(F.substr(key, F.lit(1), F.length(key) - F.length(name)), F.upper(name)).alias("key"), F.upper(surrogate).alias("surrogate"))
    return F.when((F.length(name) < F.length(key)) & (F.upper(name) != name) & (F.length(F.upper(name)) == F.length(name)), F.array(plain, loud)).otherwise(F.array(plain))


def matches_of(text: Column, pattern: Column | None = None) -> Column:
    return F.regexp_extract_all(text, F.lit(PATTERN) if pattern is None else pattern, F.lit(0))


def stream(key: str, kind: Column, value: Column, attempt: Column, size: Column) -> Column:
    """Two hexadecimal digits for each of ``size`` places, as an array, from keyed digests."""
    seed = F.sha2(F.concat_ws("|", F.lit(key), kind, value, attempt.cast("string")), 256)
    # the seed is an element, not part of the function: it is digested once
    blocks = F.transform(F.array_repeat(seed, F.floor((F.greatest(size, F.lit(1)) - 1) / 32).cast("int") + 1), lambda s, b: F.sha2(F.concat_ws("|", F.lit(key), F.sha2(F.concat_ws("|", F.lit(key), s, b.cast("string")), 256)), 256))
    return F.regexp_extract_all(F.array_join(blocks, ""), F.lit(".."), F.lit(0))


def byte_at(hexes: Column, i: int) -> Column:
    return F.conv(F.element_at(hexes, i + 1), 16, 10).cast("int")


def like(value: Column, hexes: Column) -> Column:
    """The value with other digits for digits and other letters of the same case for letters; a leading digit stays from 1 to 9."""
    lower, upper = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

    def others(span: int) -> Column:
        def other(c: Column, h: Column) -> Column:
            b = F.conv(h, 16, 10).cast("int")
            letter = lambda s: F.substr(F.lit(s), b % span + 1, F.lit(1))
            return F.when(c.rlike("[0-9]"), (b % 10).cast("string")).when(c.rlike("[a-z]"), letter(lower)).when(c.rlike("[A-Z]"), letter(upper)).otherwise(c)

        chars = F.split(value, "(?!^)(?=.)")
        return F.array_join(F.zip_with(chars, F.slice(hexes, F.lit(1), F.size(chars)), other), "")

    drawn = F.when(value.rlike("^[0-9a-f]+$") | value.rlike("^[0-9A-F]+$"), others(6)).otherwise(others(26))  # hexadecimal stays so
    return F.when(value.rlike("^[1-9]"), F.concat((byte_at(hexes, 0) % 9 + 1).cast("string"), F.substr(drawn, F.lit(2), F.length(drawn)))).otherwise(drawn)


def luhn(digits: Column) -> Column:
    """The sum whose last digit is 0 if a card number's check digit is right."""
    n = F.length(digits)

    def term(c: Column, i: Column) -> Column:
        d = c.cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return F.when((n - i) % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.transform(F.split(digits, "(?!^)(?=.)"), term), F.lit(0), lambda a, t: a + t)


def mod97(value: Column) -> Column:
    """What an IBAN without its check digits, country and two zeros behind it, leaves when letters count from 10 on; 98 less this are its digits."""
    moved = F.concat(F.substr(value, F.lit(5), F.length(value)), F.substr(value, F.lit(1), F.lit(2)), F.lit("00"))
    return F.aggregate(F.split(moved, "(?!^)(?=.)"), F.lit(0), lambda a, c: F.when(c.rlike("[0-9]"), a * 10 + c.cast("int")).otherwise(a * 100 + F.ascii(c) - 55) % 97)


def check_digits(value: Column) -> Column:
    return F.lpad((98 - mod97(value)).cast("string"), 2, "0")


def pick(names: list[str], hexes: Column, at: int) -> Column:
    number = F.conv(F.array_join(F.slice(hexes, at * 4 + 1, 4), ""), 16, 10).cast("long")
    return F.element_at(F.array(*map(F.lit, names)), (number % len(names) + 1).cast("int"))


def draw(key: str, kind: Column, value: Column, attempt: Column) -> Column:
    """The surrogate of a canonical entity at an attempt; later attempts at a name take double names, then spell new ones,
    and with each further four attempts all but addresses of machines are a letter or digit longer."""
    grown = F.floor(attempt / 4).cast("int")
    right = luhn(value) % 10 == 0
    sound = F.substr(value, F.lit(3), F.lit(2)) == check_digits(value)  # an IBAN whose check digits are right keeps that
    drawn_from = F.when(kind == "email", F.concat(F.repeat(F.lit("a"), grown), value)).when(kind.isin("card", "ssn", "phone", "iban"), F.concat(value, F.repeat(F.lit("1"), grown))).otherwise(F.concat(value, F.repeat(F.lit("a"), grown)))
    size = F.greatest(F.length(value) + grown, F.lit(32))
    hexes = stream(key, kind, value, attempt, size)
    value = drawn_from
    general = like(value, hexes)
    local, host = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    domain = F.concat(like(F.substring_index(host, ".", 1), F.reverse(hexes)), F.lit(".example."), pick(["com", "net", "org"], hexes, 3))
    body = F.concat(F.substr(value, F.lit(1), F.lit(1)), F.substr(general, F.lit(2), F.length(value) - 2))
    check = (10 - luhn(F.concat(body, F.lit("0"))) % 10) % 10
    wrong = F.when(right, 0).otherwise(byte_at(hexes, 31) % 9 + 1)
    plain = F.concat(F.substr(value, F.lit(1), F.lit(2)), F.substr(general, F.lit(3), F.length(value)))
    octets = F.concat_ws(".", *[(byte_at(hexes, k) % (223 if k == 0 else 254) + 1).cast("string") for k in range(4)])
    code = F.when(F.substr(value, F.lit(1), F.lit(1)) == "1", F.lit(1)).otherwise(F.lit(2))  # the country's digits stay
    phone = F.concat(F.substr(value, F.lit(1), code), F.substr(general, code + 1, F.length(value)))
    out = (
        F.when(kind == "email", F.concat(like(local, hexes), F.lit("@"), domain))
        .when(kind == "card", F.concat(body, ((check + wrong) % 10).cast("string")))
        .when(kind == "ip", octets)
        .when(kind == "phone", phone)
        .when(kind == "ssn", F.concat(F.lit("9"), F.substr(general, F.lit(2), F.length(value))))
        .when(kind == "iban", F.when(sound, F.concat(F.substr(plain, F.lit(1), F.lit(2)), check_digits(plain), F.substr(plain, F.lit(5), F.length(plain)))).otherwise(plain))
        .when(kind == "secret", F.when(value.rlike("^(?:AKIA|ASIA)"), F.concat(F.substr(value, F.lit(1), F.lit(4)), F.substr(general, F.lit(5), F.length(value)))).otherwise(general))
    )
    for names, prefix in ((GIVEN, "given_"), (SURNAMES, "surname_")):
        for group, some in names.items():
            spelt = F.concat(pick(some, hexes, 0), F.lit("-"), pick(some, hexes, 1), F.lit("-"), F.initcap(like(F.concat(F.lit("abcdefgh"), F.repeat(F.lit("a"), grown)), hexes)))
            name = F.when(attempt == 0, pick(some, hexes, 0)).when(attempt < 4, F.concat(pick(some, hexes, 0), F.lit("-"), pick(some, hexes, 1))).otherwise(spelt)
            out = out.when(kind == f"{prefix}{group}", name)
    return out.otherwise(general)


#: Rounds of drawing: by then surrogates are 16 letters or digits longer, and only addresses of machines can have run out.
ATTEMPTS = 64
#: The session's setting with the key.
KEY_SETTING = "spark.arborix.pii.key"


def surrogate_table(entities: DataFrame, key: str, scratch: common.Scratch) -> DataFrame:
    """(kind, value, surrogate) for distinct (kind, value), all surrogates of a kind distinct and none an entity."""
    name = lambda kind: F.substring_index(kind, "_", 1)  # noqa: E731  given names of all genders are one kind here
    parts = common.partitions(entities)
    # drawing costs far more than the rows are long: by their bytes alone Spark would give them to a few tasks
    dealt = entities.repartition(parts, F.xxhash64("kind", "value"))
    drawn = scratch.save(dealt.withColumn("attempt", F.lit(0)).withColumn("surrogate", draw(key, F.col("kind"), F.col("value"), F.col("attempt"))), "drawn0")
    real = entities.select(name(F.col("kind")).alias("k"), F.col("value").alias("surrogate")).distinct()
    for k in range(ATTEMPTS):
        named = drawn.withColumn("k", name(F.col("kind")))
        first = named.groupBy("k", "surrogate").agg(F.min(F.struct("attempt", "kind", "value")).alias("first"), F.count("*").alias("n"))
        clash = first.filter("n > 1").select("k", "surrogate", "first")
        again = named.join(clash, ["k", "surrogate"]).filter(F.struct("attempt", "kind", "value") != F.col("first")).select("kind", "value")
        taken = named.join(real, ["k", "surrogate"], "left_semi").select("kind", "value")
        redo = scratch.save(again.unionByName(taken).distinct().withColumn("redo", F.lit(True)), f"redo{k}")
        if redo.isEmpty():
            return drawn.select("kind", "value", "surrogate")
        moved = drawn.join(redo, ["kind", "value"], "left").withColumn("attempt", F.col("attempt") + F.when(F.col("redo"), 1).otherwise(0))
        redrawn = F.when(F.col("redo"), draw(key, F.col("kind"), F.col("value"), F.col("attempt"))).otherwise(F.col("surrogate"))
        drawn = scratch.save(moved.withColumn("surrogate", redrawn).drop("redo"), f"drawn{k + 1}")
        scratch.drop(f"drawn{k}", f"redo{k}")
    raise RuntimeError(f"entities still share surrogates after {ATTEMPTS} attempts")


def in_format(value: Column, surrogate: Column) -> Column:
    """A canonical surrogate of digits and letters, with the other characters of the entity where they stood; what is longer follows."""
    return F.aggregate(
        F.split(value, "(?!^)(?=.)"),
        F.struct(F.lit("").alias("s"), F.lit(1).alias("k")),
        lambda a, c: F.when(c.rlike("[0-9A-Za-z]"), F.struct(F.concat(a["s"], F.substr(surrogate, a["k"], F.lit(1))).alias("s"), (a["k"] + 1).alias("k"))).otherwise(F.struct(F.concat(a["s"], c).alias("s"), a["k"].alias("k"))),
        lambda a: F.concat(a["s"], F.substr(surrogate, a["k"], F.length(surrogate))),
    )


def asked(m: Column, known: Column) -> Column:
    """(kind, what stands for it) of an entity found in a text; known: map from key to surrogate."""
    kind, names = kind_of(m), names_of(m)
    titled = m.rlike(rf"^{TITLE}\s")
    gender = F.when(titled, gender_of(m)).otherwise("-")
    look = lambda *key: F.element_at(known, F.concat_ws("|", *key))
    last = look(F.lit("surname"), F.element_at(names, -1))
    both = F.concat(look(F.lit("given"), gender, names[0], F.element_at(names, -1)), F.lit(" "), last)
    person = F.when(F.size(names) > 1, F.concat(title_of(m), both)).when(titled, F.concat(title_of(m), last)).otherwise(F.coalesce(last, look(F.lit("given"), F.lit("-"), names[0], F.lit(""))))
    other = look(kind, canonical(m, kind))
    formatted = F.when(kind.isin("card", "ssn", "phone", "iban"), in_format(m, other)).otherwise(other)
    is_person = titled | other.isNull()
    return F.struct(F.when(is_person, "person").otherwise(kind).alias("kind"), F.coalesce(F.when(is_person, person).otherwise(formatted), m).alias("new"))


def replaced(text: Column, known: Column) -> Column:
    """(text around its entities' surrogates, kinds of the entities)."""
    pattern = F.coalesce(F.concat(F.lit(f"(?:{PATTERN})|(?:"), names_pattern(known), F.lit(")")), F.lit(PATTERN))
    found = F.transform(matches_of(text, pattern), lambda m: asked(m, known))
    # each step once: an array of one
    cut = F.transform(F.array(F.struct(F.split(text, pattern, -1).alias("between"), found.alias("found"))), lambda r: F.struct(
        F.array_join(F.zip_with(r["between"], F.concat(F.transform(r["found"], lambda e: e["new"]), F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "").alias("text"),
        F.transform(r["found"], lambda e: e["kind"]).alias("kinds"),
    ))
    return cut[0]


@common.shielded
def replace_pii(documents: DataFrame, *, text: str = "text", key: str | None = None) -> DataFrame:
    """Documents with their text's entities replaced and a column n_<kind> for each kind; columns of these names are replaced.

    ``key`` is secret: who has it can draw the same surrogates. By default it is the session's ``KEY_SETTING``; without either it is an error.
    """
    spark = documents.sparkSession
    key = key or spark.conf.get(KEY_SETTING, None)
    if not key:
        raise ValueError(f"surrogates need a key: an argument, or {KEY_SETTING} of the session")
    body = F.col(f"`{text}`")
    with common.Scratch(spark, "pii") as scratch:
        found = documents.select(body.alias("t")).withColumn("m", matches_of(F.col("t"))).filter(F.size("m") > 0)
        # a text is known by its hash and length: copies share one row of surrogates
        each = found.select(F.xxhash64("t").alias("mark"), F.length("t").alias("len"), F.explode(F.array_distinct("m")).alias("m")).withColumn("kind", kind_of(F.col("m")))
        parts = scratch.save(parts_of(scratch.save(each, "each"), scratch), "parts")
        names = surrogate_table(parts.select("kind", "value").distinct(), key, scratch)
        pairs = F.collect_set(F.struct("key", "surrogate"))
        named = parts.join(names, ["kind", "value"]).select("mark", "len", F.explode(in_capitals(F.col("key"), F.col("surrogate"))).alias("k")).select("mark", "len", "k.*")
        maps = scratch.keep(named.groupBy(F.col("mark").alias("__mark"), F.col("len").alias("__len")).agg(F.map_from_entries(pairs).alias("__known")))
    on = (F.xxhash64(body) == F.col("__mark")) & (F.length(body) == F.col("__len"))
    joined = documents.join(maps.hint("merge"), on, "left")  # the same join at every size
    out = joined.withColumn("__new", F.when(F.col("__known").isNotNull(), replaced(body, F.col("__known"))))
    number = lambda k: F.coalesce(F.size(F.filter("__new.kinds", lambda x: x == k)), F.lit(0)).cast("long")
    counts = {f"n_{k}": F.when(F.col("__new").isNull(), F.lit(0).cast("long")).otherwise(number(k)) for k in KINDS}
    new = F.when(F.col("__new").isNull(), body).otherwise(F.col("__new.text"))
    return out.withColumns(counts | {text: new}).select(*common.columns(documents, but=list(counts)), *counts)


def op4_pii_surrogates(documents: DataFrame) -> DataFrame:
    """(doc_id, n_entities, n_<kind> for each kind, text, text_sha256) of each document. Where the session has no key, one that
    is no secret serves this query, so that it can be tried out."""
    out = replace_pii(documents.select("doc_id", "text"), key=documents.sparkSession.conf.get(KEY_SETTING, None) or "surrogates")
    total = sum((F.col(f"n_{k}") for k in KINDS), F.lit(0).cast("long"))
    return out.withColumns({"n_entities": total, "text_sha256": F.sha2(F.col("text").cast("binary"), 256)})
