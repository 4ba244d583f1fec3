"""Surrogates for personal data and secrets, in DataFrame operations only.

One pattern finds e-mail addresses, telephone numbers, IPv4 addresses, card numbers, access keys, passwords,
tokens and names after a form of address; mentions of a name's words elsewhere in the same document are replaced too, but not counted. Each entity's replacement is drawn by
HMAC-SHA256 under the caller's key from the kind and the entity: digits become digits and letters letters of the same case, separators stay, an IPv4
address stays a valid one, a card number keeps its first digit and its Luhn remainder, a name takes a name of the
same script and gender, word by word (so that the same surname stays the same).
Equal entities so get equal surrogates in all documents, with no table to look up. A secret is found with its key
(``password=``), which stays; a secret with fewer than six letters and digits gets a longer surrogate, so that enough of them exist.

Coreference of names: a name's gender is what its form of address tells; after a form that tells none (``Dr``) it is that of the same
name after one that does, where all such forms in the corpus agree. So ``Mr John Smith`` and ``Dr John Smith`` get one name.

Collision check: the distinct surname words of the whole corpus get surrogates first, then its distinct entities; where two of a kind share
one, or one equals an entity that occurs, all but the smallest move to the next attempt, until none is
left. A name that moves changes its given name alone, so whoever shared its surname still does. Later attempts draw from larger spaces (longer
names, more digits, in the end IPv6 addresses), so every corpus comes to an end. Documents are rewritten where they lie as long as all entities have
their first surrogate; else the documents that hold entities, and only those, take their surrogates from a join.

Defined cases: a null text stays null, an empty one empty; texts without an entity stay as they are; repeated rows
give repeated results; null ids pass; an empty table gives an empty one; columns other than the text pass unchanged, whatever their names.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import documents, free, spool

KEY_SETTING = "spark.graphloom.pii.key"  # where the query looks for the secret key
PUBLIC_KEY = "not-a-secret"  # the query's without that setting: good for tests, hides nothing

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
FEMALE = "Mrs|Ms|Miss|Frau|Mme|Madame|Señora|Sra|Г-жа|Κυρία"
MALE = "Mr|Herr|Monsieur|Señor|Sr|Г-н|Κύριος"
NEUTRAL = "Dr|Prof"
EMAIL = r"(?<![\w\p{L}.%+-])[\w\p{L}.%+-]++@(?:[A-Za-z0-9-]++\.)+[A-Za-z]{2,}+"
_SEP = r"(?: ?\(|\)[ .-]?|[ ./-])?"
_DATE = r"\d{2}[./-]\d{2}[./-]\d{2}(?:\d{2})?(?![./-]?\d)"
_INTERNATIONAL = rf"(?<![\w+])\+(?:\d{{1,3}}[ .-]?\(?\d{{2,4}}\)?[ .-]?\d{{3,4}}[ .-]?\d{{4}}(?!\d|[ .-]\d{{2}})|\d(?:{_SEP}\d){{6,14}}(?!\d))|(?<![\w+.,-])00[ -]?[1-9](?:{_SEP}\d){{7,13}}(?!\d)"
_NATIONAL = rf"(?<![\w+.])(?:1[ .-])?(?:\([2-9]\d{{2}}\)[ .-]?|[2-9]\d{{2}}[ .-])\d{{3}}[ .-]\d{{4}}(?!\w|[.-]\d)|(?<![\w+.,/:-])(?!{_DATE})\(?0[1-9](?:{_SEP}\d){{7,10}}(?!\w|[ .:/-]\d)"
PHONE = f"{_INTERNATIONAL}|{_NATIONAL}"
IPV4 = rf"(?<![\w.]){_OCTET}(?:\.{_OCTET}){{3}}(?![\w]|\.\d)"
_CARD = r"(?:\d(?:\d{15}|\d{3}(?:[ -]\d{4}){3})|(?:3[47]\d\d|2131|1800)(?:\d{11}|[ -]\d{6}[ -]\d{5})|3[0689]\d\d(?:\d{10}|[ -]\d{6}[ -]\d{4}))"
CARD = rf"(?<![\w.-]){_CARD}(?!\w|[.-]\d)"
ACCESS_KEY = r"\bAKIA[0-9A-Z]{16}\b"
_KEYWORD = r"(?iu:passw(?:or)?d|passwort|passphrase|passcode|kennwort|contraseña|пароль|pwd|token|secret|(?:api|access|secret|private|auth)[_ -]?key)"
_KEY = rf"(?:{_KEYWORD}[\"']?\s{{0,3}}(?:=>|:=|={{1,3}}|:)\s{{0,3}}|(?i:bearer) (?=[\w.~+/-]{{16}}))"
_BARE = r"[^\s\"'<&,;]"
SECRET = rf"{_KEY}(?:\"(?=[^\"\r\n]*[\p{{L}}\p{{N}}])[^\"\r\n]++(?=\")|'(?=[^'\r\n]*[\p{{L}}\p{{N}}])[^'\r\n]++(?=')|(?=[^\s\"'<\p{{L}}\p{{N}}]*[\p{{L}}\p{{N}}]){_BARE}++(?:[&,;](?!\w+[=:]){_BARE}++)*+)"
_WORD = r"\p{Lu}(?:[\p{L}\p{M}]++|(?=['’-]))(?:(?:-|['’](?!s(?!\p{L})))\p{L}[\p{L}\p{M}]*+)*+"
_PARTICLE = "(?:van|von|der|den|de|del|della|la|las|los|le|di|da|dos|du|zu|ten|ter|bin|ibn|al|el) "
_PART = rf"(?:{_PARTICLE}|\p{{Lu}}\. ){{0,5}}{_WORD}"
NAME = rf"(?<!\p{{L}})(?:{FEMALE}|{MALE}|{NEUTRAL})\.? {_PART}(?: {_PART}){{0,4}}(?!\p{{L}})"
MENTION = rf"(?<![\p{{L}}\p{{M}}'’-]){_WORD}(?![\p{{L}}\p{{M}}])"
# each with the signs that it can begin with, so that most places fail at once
_BEGINS = {EMAIL: r"[\w\p{L}.%+-]", f"(?:{PHONE})|{IPV4}|{CARD}": r"[+(\d]", ACCESS_KEY: "A", SECRET: "[PpKkCcПпTtSsAaBb]", NAME: r"[\p{Lu}]"}
PATTERN = "|".join(f"(?={b})(?:{p})" for p, b in _BEGINS.items())

DIGITS, LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
#: Given names by script and gender, and syllables for surnames.
GIVEN = {
    "latin": {
        "f": "Anna Clara Diana Elena Flora Greta Helen Irene Julia Karla Laura Maria Nadia Olivia Paula Rosa Sara Tessa Vera Wanda Alma Berta Celia Dora Emma Frida Gina Hanna Ida Jana Lina Mona".split(),
        "m": "Adam Bruno Carl David Erik Felix Georg Hugo Ivan Jonas Karl Leon Marco Nils Oscar Paul Ralf Simon Tom Victor Albert Bernd Cesar Daniel Emil Frank Gustav Henry Isaac Julio Lars Max".split(),
        "n": "Alex Andrea Chris Dominique Eden Kim Robin Sascha Toni Uli Jules Noa Remy Sam Sidney Charlie".split(),
    },
    "cyrillic": {"f": "Анна Вера Дарья Елена Ирина Мария Ольга Татьяна".split(), "m": "Антон Борис Виктор Дмитрий Егор Иван Михаил Павел".split(), "n": "Саша Женя Валя Слава".split()},
    "greek": {"f": "Άννα Ελένη Ζωή Μαρία Σοφία Ειρήνη Δάφνη Κλειώ".split(), "m": "Άρης Γιώργος Νίκος Πέτρος Σπύρος Ηλίας Μάρκος Λουκάς".split(), "n": "Αλεξ Χαρις Φωτης Ρενα".split()},
}
SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga go ka ke ko la le lo ma me mo na ne no pa pe ra re ro sa se ta te va".split(),
    "cyrillic": "ба бо ва во га го да де ка ко ла ле ма мо на но".split(),
    "greek": "βα γα δα δε κα κο λα λε μα μο να νο πα ρα σα τα".split(),
}


def kind_of(v: Column) -> Column:
    return (
        F.when(v.rlike(rf"^(?:{FEMALE}|{MALE}|{NEUTRAL})\.? "), "name")
        .when(v.rlike(f"^(?:{SECRET})"), "secret")
        .when(v.rlike(f"^(?:{EMAIL})$"), "email")
        .when(v.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"), "ipv4")
        .when(v.rlike(f"^{_CARD}$"), "card")
        .when(v.rlike(f"^(?:{PHONE})$"), "phone")
        .when(v.rlike("^AKIA[0-9A-Z]{16}$"), "access_key")
        .otherwise("secret")
    )


def _hmac(key: str, *parts: Column) -> Column:
    """HMAC-SHA256 of the parts, in hexadecimal."""
    secret = key.encode() if len(key.encode()) <= 64 else hashlib.sha256(key.encode()).digest()
    inner, outer = (F.lit(bytes(b ^ pad for b in secret.ljust(64, b"\0"))) for pad in (0x36, 0x5C))
    message = F.concat_ws("\x1f", *parts).cast("binary")
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message), 256))), 256)


def _pick(choices: str, seed: Column, i: Column) -> Column:
    """The character of ``choices`` that the seed gives at place i."""
    return F.substr(F.lit(choices), (F.pmod(F.xxhash64(seed, i), F.lit(len(choices))) + 1).cast("int"), F.lit(1))


def _longer(choices: str, seed: Column, attempt: Column, every: int) -> Column:
    """One more character for every ``every`` attempts: what makes a space too small for its entities larger."""
    n = F.floor(attempt / every).cast("int")
    return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: _pick(choices, seed, i + 1000)), "")).otherwise("")


def _like(v: Column, seed: Column, hexadecimal: Column | None = None, digits: str = DIGITS) -> Column:
    """Each digit, lower and upper letter becomes one of its kind; letters beyond a-z become Latin ones."""

    def one(c, i):
        out = F.when(c.rlike(r"^\d$"), _pick(digits, seed, i)).when(c.rlike(r"^\p{Lu}$"), _pick(LOWER.upper(), seed, i)).when(c.rlike(r"^\p{L}$"), _pick(LOWER, seed, i)).otherwise(c)
        return out if hexadecimal is None else F.when(hexadecimal, _pick("0123456789abcdef", seed, i)).otherwise(out)

    return F.array_join(F.transform(F.split(v, ""), one), "")


def _luhn(digits: Column) -> Column:
    """The Luhn sum of a string of digits; the last counts once."""
    n = F.length(digits)
    return F.aggregate(
        F.transform(F.split(digits, ""), lambda c, i: F.when((n - i) % 2 == 1, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0))),
        F.lit(0), lambda a, x: a + x,
    )


def gender_of(v: Column) -> Column:
    """What a name's form of address tells: f, m or n."""
    return F.when(v.rlike(rf"^(?:{FEMALE})\.? "), "f").when(v.rlike(rf"^(?:{MALE})\.? "), "m").otherwise("n")


def _by_script(w: Column, make) -> Column:
    return F.when(w.rlike(r"\p{IsCyrillic}"), make("cyrillic")).when(w.rlike(r"\p{IsGreek}"), make("greek")).otherwise(make("latin"))


def _choice(choices: list[str], seed: Column, i: Column) -> Column:
    """The one of ``choices`` that the seed gives at place i; one constant in the plan, however many there are."""
    return F.element_at(F.split(F.lit(" ".join(choices)), " "), (F.pmod(F.xxhash64(seed, i), F.lit(len(choices))) + 1).cast("int"))


def _syllables(w: Column, seed: Column, n: Column) -> Column:
    drawn = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: _by_script(w, lambda script: _choice(SYLLABLES[script], seed, k)))
    return F.when(n > 0, F.array_join(drawn, "")).otherwise("")


def surname(w: Column, key: str, attempt: Column) -> Column:
    """The surrogate of a surname word: five syllables of its script, and one more with each attempt."""
    return _bind(_hmac(key, F.lit("surname"), w, attempt.cast("string")), lambda own: F.initcap(_syllables(w, own, attempt.cast("int") + 5)))


def given(w: Column, key: str, attempt: Column, gender: Column) -> Column:
    """The surrogate of a given name: a name of its script and the gender, from the second attempt on with syllables added."""

    def drawn(own: Column) -> Column:
        of = lambda script: F.when(gender == "f", _choice(GIVEN[script]["f"], own, F.lit(0))).when(gender == "m", _choice(GIVEN[script]["m"], own, F.lit(0))).otherwise(_choice(GIVEN[script]["n"], own, F.lit(0)))
        return F.concat(_by_script(w, of), _syllables(w, own, F.floor(attempt / 2).cast("int")))

    return _bind(_hmac(key, F.lit("given"), w, attempt.cast("string")), drawn)


INITIAL = r"^\p{Lu}\.$"


def is_surname(words: Column, w: Column, i: Column) -> Column:
    """Whether word i of a name with its form of address is replaced by ``surname``."""
    is_given = (F.size(words) >= 3) & (i == 1)
    return (i > 0) & ~is_given & ~w.rlike(INITIAL) & ~F.concat(w, F.lit(" ")).rlike(f"^{_PARTICLE}$")


def surrogate(v: Column, key: str, attempt: Column, gender: Column | None = None, surnames: Column | None = None) -> Column:
    """The replacement of an entity at an attempt; ``gender`` and ``surnames`` (word -> surrogate) say what differs from a name's own gender and its words' first surrogates."""
    seed = _hmac(key, kind_of(v), v, attempt.cast("string"))
    local, domain = F.substring_index(v, "@", 1), F.substring_index(v, "@", -1)
    top = F.substring_index(domain, ".", -1)
    site = F.substr(domain, F.lit(1), F.length(domain) - F.length(top))
    # a site keeps its surrogate however often an address at it moves
    email = F.concat(_like(local, seed), _longer(LOWER, seed, attempt, 4), F.lit("@"), _like(site, _hmac(key, F.lit("site"), site)), top)
    country = F.regexp_extract(v, r"^\+\d{1,3}(?=[ .(-])|^\+\d|^00[ -]?[1-9]\d?|^\(?0", 0)
    phone = F.concat(country, _like(F.substr(v, F.length(country) + 1), seed, digits="23456789"), _longer(DIGITS, seed, attempt, 8))
    octets = F.array_join(F.transform(F.split(v, r"\."), lambda c, i: (F.pmod(F.xxhash64(seed, i), F.lit(254)) + 1).cast("string")), ".")
    ipv4 = F.concat(F.when(attempt >= 16, F.concat(F.lit("fd"), F.substr(seed, F.lit(1), F.lit(2)), F.lit(":"), F.substr(seed, F.lit(3), F.lit(4)), F.lit("::"))).otherwise(""), octets)
    # a card number: first digit kept, last one sets the Luhn remainder to what it was
    drawn = F.concat(F.substr(v, F.lit(1), F.lit(1)), _like(F.substr(v, F.lit(2), F.length(v) - 2), seed))
    plain = lambda x: F.regexp_replace(x, "[ -]", "")
    last = F.pmod(_luhn(plain(v)) - _luhn(F.concat(plain(drawn), F.lit("0"))), F.lit(10))
    card = F.concat(drawn, last.cast("string"))
    access_key = F.concat(F.lit("AKIA"), F.array_join(F.transform(F.split(F.substr(v, F.lit(5)), ""), lambda c, i: _pick(LOWER.upper() + DIGITS, seed, i)), ""))
    # a secret's surrogate depends on its value, not on how its key is written; other scripts' letters and digits become Latin letters
    value = F.regexp_extract(v, rf"^{_KEY}[\"']?(.*)$", 1)
    own = _hmac(key, F.lit("secret"), value, attempt.cast("string"))
    latin = F.regexp_replace(value, r"(?![0-9A-Za-z])[\p{L}\p{N}]", "x")
    long = F.length(F.regexp_replace(latin, "[^0-9A-Za-z]", "")) >= 6
    drawn_value = F.concat(_like(F.when(long, latin).otherwise("xxxxxxxxxxxx"), own, hexadecimal=long & value.rlike("^[0-9a-f]*$")), _longer(LOWER, own, attempt, 4))
    secret = F.concat(F.substr(v, F.lit(1), F.length(v) - F.length(value)), drawn_value)
    words, first = F.split(v, " "), F.lit(0)
    gender = gender_of(v) if gender is None else gender

    def name_word(w: Column, i: Column) -> Column:
        last_name = surname(w, key, first) if surnames is None else F.coalesce(F.element_at(surnames, w), surname(w, key, first))
        # an initial that would have to move often becomes a whole name
        initial, movable = w.rlike(INITIAL), (F.size(words) >= 3) & (i == 1) & ~F.concat(w, F.lit(" ")).rlike(f"^{_PARTICLE}$")
        own = _hmac(key, F.lit("initial"), w, F.when(i == 1, attempt).otherwise(0).cast("string"))
        letter = F.concat(F.upper(F.left(_by_script(w, lambda script: _choice(SYLLABLES[script], own, i)), F.lit(1))), F.lit("."))
        return F.when(is_surname(words, w, i), last_name).when(movable & (~initial | (attempt >= 8)), given(w, key, attempt, gender)).when(initial, letter).otherwise(w)

    kind = kind_of(v)
    name = F.array_join(F.transform(words, name_word), " ")
    return F.when(kind == "email", email).when(kind == "phone", phone).when(kind == "ipv4", ipv4).when(kind == "card", card).when(kind == "access_key", access_key).when(kind == "name", name).otherwise(secret)


def entities(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))


def _bind(value: Column, f) -> Column:
    """f(value), with the value computed once although f's lambdas use it often."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _woven(text: Column, pattern: str, replacements: Column, between=lambda x: x) -> Column:
    """The text with the matches of a pattern, in order, replaced."""
    return F.array_join(F.flatten(F.zip_with(F.split(text, pattern, -1), replacements, lambda a, b: F.array(between(a), F.coalesce(b, F.lit(""))))), "")


def _rebuild(text: Column, found: Column, replacements: Column) -> Column:
    """The text with its entities, in order, replaced, and with them the words of its names where they stand alone; what else lies between them stays."""

    def pairs(x: Column) -> Column:
        words = F.transform(F.filter(F.arrays_zip(x["v"], x["s"]), lambda p: kind_of(p["v"]) == "name"), lambda p: F.slice(F.zip_with(F.split(p["v"], " "), F.split(p["s"], " "), lambda w, s: F.struct(w.alias("w"), s.alias("s"))), 2, 99))
        return F.filter(F.flatten(words), lambda p: p["w"].rlike(f"^{_WORD}$"))

    def mentions(piece: Column, known: Column) -> Column:
        return _woven(piece, MENTION, F.transform(F.regexp_extract_all(piece, F.lit(MENTION), F.lit(0)), lambda m: F.coalesce(F.get(F.filter(known, lambda p: p["w"] == m), F.lit(0))["s"], m)))

    def whole(x: Column) -> Column:
        return _bind(pairs(x), lambda known: F.when(F.size(known) > 0, _woven(text, PATTERN, x["s"], lambda a: mentions(a, known))).otherwise(_woven(text, PATTERN, x["s"])))

    return _bind(F.struct(found.alias("v"), replacements.alias("s")), whole)


def _settled(table: DataFrame, again) -> DataFrame:
    """``table`` (v, kind, attempt, sur, ...), each v once, with attempts raised until every sur of a kind is one v's and no v; ``again()`` gives sur at an attempt."""
    known = table.select("kind", F.col("v").alias("sur"))
    while True:
        shared = table.groupBy("kind", "sur").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("attempt", "v")).alias("first")).where("n > 1")
        clash = table.join(shared, ["kind", "sur"]).where("v != first.v").select("v").unionByName(table.join(known, ["kind", "sur"], "left_semi").select("v")).distinct()
        clash = spool(clash, "pii-clashes")
        if clash.isEmpty():
            return table
        moved = table.join(clash, "v", "left_semi").withColumn("attempt", F.col("attempt") + 1).withColumn("sur", again())
        table = spool(table.join(clash, "v", "left_anti").unionByName(moved.select(*table.columns)), "pii-entities")


def exceptions(found: DataFrame, key: str) -> DataFrame:
    """(v, sur) of the entities that don't have their first surrogate; ``found`` has each distinct entity once, in v."""
    v, attempt, zero = F.col("v"), F.col("attempt"), F.lit(0)
    found = spool(found.select("v", kind_of(v).alias("kind")), "pii-found")
    # a surrogate takes long beside the size of its row: even parts, not as few as the bytes would need
    parts = max(8, found.count() // 2000)
    names = found.where("kind = 'name'").select("v", F.split("v", " ").alias("w"))
    words = names.select("v", F.explode(F.filter(F.transform("w", lambda w, i: F.when(is_surname(F.col("w"), w, i), w)), lambda w: w.isNotNull())).alias("word"))
    listed = words.select(F.col("word").alias("v")).distinct().select("v", F.lit("word").alias("kind"), zero.alias("attempt"))
    listed = _settled(spool(listed.withColumn("sur", surname(v, key, zero)), "pii-words"), lambda: surname(v, key, attempt)).where("attempt > 0")
    other = words.join(listed.select(F.col("v").alias("word"), "sur"), "word").groupBy("v").agg(F.map_from_entries(F.collect_set(F.struct("word", "sur"))).alias("surnames"))
    # one person, one gender, where the forms of address agree
    told = names.select("v", F.expr("array_join(slice(w, 2, size(w)), ' ')").alias("person"), gender_of(v).alias("own"))
    known = told.where("own != 'n'").groupBy("person").agg(F.min("own").alias("g"), F.max("own").alias("h")).where("g = h").select("person", "g")
    agreed = told.where("own = 'n'").join(known, "person").select("v", "g")
    table = found.join(agreed, "v", "left").join(other, "v", "left").select("v", "kind", F.coalesce("g", gender_of(v)).alias("gender"), F.coalesce("surnames", F.create_map().cast("map<string,string>")).alias("surnames"), (F.col("g").isNotNull() | F.col("surnames").isNotNull()).alias("differs"), zero.alias("attempt"))
    make = lambda n: surrogate(v, key, n, F.col("gender"), F.col("surnames"))
    return _settled(spool(table.repartition(parts, "v").withColumn("sur", make(zero)), "pii-entities"), lambda: make(attempt)).where("attempt > 0 OR differs").select("v", "sur")


def replace(docs: DataFrame, key: str, text_col: str = "text", count: str | None = "n_entities") -> DataFrame:
    """``docs`` with surrogates in its text column; the number of entities is added as ``count``, if not None, with underscores behind it where the name is taken."""
    columns, text = docs.columns, F.col(text_col)
    found, row, place, names = (free(c, columns) for c in ("__e", "__rid", "__i", "__s"))
    # the pattern's one pass over the texts; all later steps read its lists
    rows = spool(docs.select("*", F.coalesce(entities(text), F.array().cast("array<string>")).alias(found)), "pii-rows")
    moved = exceptions(rows.select(F.explode(found).alias("v")).distinct(), key)
    n = [] if count is None else [F.size(found).cast("long").alias(free(count, columns))]

    def rewritten(replacements: Column) -> list[Column]:
        return [F.when(F.size(found) > 0, _rebuild(text, F.col(found), replacements)).otherwise(text).alias(c) if c == text_col else F.col(c) for c in columns]

    if moved.isEmpty():
        return rows.select(*rewritten(F.transform(found, lambda v: surrogate(v, key, F.lit(0)))), *n)
    # some entities moved: documents with entities, and only those, meet the exceptions
    some = spool(rows.where(F.size(found) > 0).withColumn(row, F.monotonically_increasing_id()), "pii-some")
    pairs = some.select(row, F.posexplode(found).alias(place, "v")).join(moved, "v", "left").select(row, place, F.coalesce("sur", surrogate(F.col("v"), key, F.lit(0))).alias("sur"))
    lists = pairs.groupBy(row).agg(F.transform(F.sort_array(F.collect_list(F.struct(place, "sur"))), lambda x: x["sur"]).alias(names))
    return rows.where(F.size(found) == 0).select(*columns, *n).unionByName(some.join(lists, row).select(*rewritten(F.col(names)), *n))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace(documents(spark, sf_dir), spark.conf.get(KEY_SETTING, PUBLIC_KEY)).select("doc_id", "text", "n_entities")
