"""Surrogates for personal data and secrets, in DataFrame functions only.

Method: surrogate generation.  One pattern finds the entities of a text: mail
addresses, IP addresses, payment cards (of a known issuer, with a valid check digit), accounts,
social security and phone numbers, access keys, the values of assigned secrets,
and names after a form of address or a known given name.  Every different
entity of the corpus, in a canonical form, gets one surrogate of its type from
a keyed hash, so that equal entities stay equal everywhere (coreference).  A
table of all entities checks collisions: a surrogate that is an entity of the
corpus, or that two entities claim, goes to the next attempt, until all differ
(distinctness).  The surrogate then takes on the surface: digits go where the
digits were and separators stay (format), letters keep their case, names keep
gender and script.

The main path has no Python on the executors.  Texts with their entities are
written once; only texts that have entities are shuffled, by row.  Entities
are made distinct before they are numbered, and a text's replacements are no
more than its own entities.

Cases: a null text stays null, a text without entities stays as it is; a card
number without a valid check digit is a phone if it looks like one, else no entity; repeated rows and null ids are
treated row by row; an empty table gives no rows; all other columns stay,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, require, with_row_ids

KEY = "surrogate-key"
MOST_ATTEMPTS = 64

# Forms of address and given names that mark a person, by gender.
ADDRESS_MALE = ("Mr", "Herr", "Sr", "Señor", "Monsieur", "Sir", "Господин", "Κύριος")
ADDRESS_FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Sra", "Señora", "Mme", "Madame", "Госпожа", "Κυρία")
ADDRESS_ANY = ("Dr", "Prof")
GIVEN_MALE = ("James", "John", "Robert", "Michael", "William", "David", "Richard", "Thomas", "Charles", "Daniel", "Matthew", "Peter",
              "Paul", "Hans", "Klaus", "Jürgen", "Pierre", "Jacques", "Carlos", "Miguel", "Иван", "Сергей", "Дмитрий", "Алексей",
              "Γιώργος", "Νίκος")
GIVEN_FEMALE = ("Mary", "Patricia", "Jennifer", "Linda", "Elizabeth", "Barbara", "Susan", "Jessica", "Sarah", "Karen", "Emily", "Julia",
                "Sabine", "Ursula", "Monique", "Françoise", "Carmen", "Lucía", "Мария", "Ольга", "Наталья", "Елена", "Μαρία", "Ελένη")

# How the numbers of payment cards begin.
ISSUERS = r"\A(?:4|5[1-5]|2[2-7]|3[04-8]|6011|62|64[4-9]|65)"

#: Syllables from which names are built, by script: inner ones, endings of given names of men and of women, of surnames.
SYLLABLES = {
    "latin": (("ba", "de", "fi", "go", "ka", "le", "mi", "no", "pa", "ri", "sa", "te", "vi", "wo", "ze", "lu"),
              ("ron", "dan", "vin", "mar", "tos", "lef", "nik", "gor"), ("na", "lia", "ra", "sia", "tha", "mina", "dora", "vea"),
              ("berg", "son", "field", "mann", "ley", "wick", "stone", "ford")),
    "cyrillic": (("ба", "де", "фи", "го", "ка", "ле", "ми", "но", "па", "ри", "са", "те", "ви", "во", "зе", "лу"),
                 ("рон", "дан", "вин", "мар", "тос", "леф", "ник", "гор"), ("на", "лия", "ра", "сия", "та", "мина", "дора", "вея"),
                 ("енко", "ских", "ович", "инчук", "енков", "ых", "арь", "адзе")),
    "greek": (("βα", "δε", "φι", "γο", "κα", "λε", "μι", "νο", "πα", "ρι", "σα", "τε", "βι", "λο", "ζε", "λυ"),
              ("ρος", "δας", "νης", "μος", "τος", "λης", "κης", "γος"), ("να", "λια", "ρα", "σια", "θεα", "μινα", "δωρα", "βη"),
              ("ιδης", "ακης", "ογλου", "πουλος", "ατος", "ελης", "ινος", "αρης")),
}

_CAP = r"\p{Lu}[\p{L}\p{M}]*+(?:['’-]\p{Lu}[\p{L}\p{M}]*+)*+"


def _any(words: tuple[str, ...]) -> str:
    return "(?:" + "|".join(words) + ")"


_ADDRESSES = {g: w + tuple(x.upper() for x in w) for g, w in (("male", ADDRESS_MALE), ("female", ADDRESS_FEMALE), ("any", ADDRESS_ANY))}
_ADDRESS = _any(sum(_ADDRESSES.values(), ())) + r"\.? "
_GIVEN = _any(GIVEN_MALE + GIVEN_FEMALE)
#: Phones with groups of one and two digits: a country's code or a leading 0, then groups with one separator between all of them.
_SHORT_GROUPS = "|".join(rf"(?<![\w.+(-])(?:(?:\+|00)[1-9]\d{{0,2}}[ .-]?(?:\(0\)[ .-]?)?\d{{1,2}}|0[1-9]\d{{0,2}})(?:{x}\d\d){{4}}(?![\w-])"
                         rf"|(?<![\w.+(-])(?=\d(?:{x}?\d){{8}})0[1-9]\d{{0,3}}(?:{x}\d{{2,3}}){{3}}(?![\w-])" for x in (" ", r"\.", "-"))
#: In order of preference at one place.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]++\.){1,126}[A-Za-z]{2,}+(?![A-Za-z0-9])",
    "key": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])",
    "secret": r"(?<=(?:[pP]assword|PASSWORD|[pP]asswd|[sS]ecret|SECRET|[tT]oken|TOKEN|[aA]pi[_-]?[kK]ey|API_KEY|[aA]ccess_[kK]ey)"
              r"[\"']?[ \t]{0,3}[:=][ \t]{0,3}[\"']?)[A-Za-z0-9+/_.~-]{5,}[A-Za-z0-9+/_=~]",
    "ip": r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d{1,2})\.){3}(?:25[0-5]|2[0-4]\d|1?\d{1,2})(?!\.?\w)",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": r"(?<![\w.+-])[1-9](?:[ -]?\d){12,18}(?![\w-])",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    # no place but these needs a look at the alternatives
    "phone": rf"(?=[+(0-9])(?:{_SHORT_GROUPS}"
             r"|(?<![\w.+(-])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,5}\)[ .-]?|\d{2,5}[ .-])(?:\d{2,4}[ .-]){0,2}\d{3,4}[ .-]\d{3,4}(?![\w-])"
             r"|(?<![\w.+(-])\+\d{1,3}(?:[ .-]?\(?\d{2,5}\)?){2,4}(?!\w)|(?<![\w.+(-])\+\d{8,14}(?!\w)"
             r"|(?<![\w.+(-])(?:\+|00)[1-9]\d{0,2}[ .-]\(?\d\)?(?:[ .-]?\d{2,5}){2,4}(?!\w)"
             r"|(?<![\w.+(-])00[1-9]\d{0,2}[ .-]\(?\d{2,5}\)?(?:[ .-]?\(?\d{2,5}\)?){1,3}(?!\w))",
    "person": rf"(?<!\p{{L}})(?=\p{{Lu}})(?:{_ADDRESS}{_CAP}(?: {_CAP}){{0,2}}|{_GIVEN}(?: \p{{Lu}}\.)? {_CAP})",
}
#: The only capturing group tells secrets, which their place marks and not their shape.
EVERY = "|".join(f"({p})" if kind == "secret" else f"(?:{p})" for kind, p in PATTERNS.items())


def _re(pattern: str) -> Column:
    return F.lit(pattern)


def _whole(surface: Column, kind: str) -> Column:
    # found at a place that fitted it; look-around does not matter any more
    return surface.rlike(rf"\A(?:{_SHAPES[kind]})\z")


_SHAPES = {
    "email": r"[^@\s]+@[^@\s]+",
    "key": r"(?:AKIA|ASIA)[A-Z0-9]{16}",
    "ip": r"\d{1,3}(?:\.\d{1,3}){3}",
    "iban": r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?",
    "card": r"\d(?:[ -]?\d){12,18}",
    "ssn": r"\d{3}-\d{2}-\d{4}",
    "phone": r"\+?[\d() .-]+",
    "person": rf"(?:{_ADDRESS})?{_CAP}(?: \p{{Lu}}\.)?(?: {_CAP})*",
}


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, r"[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the check digit is right."""
    doubled = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
        d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda a, b: a + b) % 10 == 0


def find(text: Column) -> Column:
    """The surfaces that the pattern finds, in order; texts without any mark of one are not searched."""
    marks = text.rlike(r"[0-9@=:]") | text.rlike(rf"(?<!\p{{L}})(?=\p{{Lu}})(?:{_ADDRESS}|{_GIVEN} )")
    return F.when(marks, F.regexp_extract_all(text, _re(EVERY), F.lit(0))).otherwise(F.array().cast("array<string>"))


def kind_of(surface: Column, secret: Column) -> Column:
    """The type of a surface; null for what only looks like an entity.
    ``secret`` is what the pattern's group holds of it, empty if nothing."""
    found = F.when(secret != "", "secret").when(_whole(surface, "email"), "email").when(_whole(surface, "key"), "key").when(_whole(surface, "ip"), "ip") \
        .when(_whole(surface, "ssn"), "ssn")
    card = _digits(surface).rlike(ISSUERS) & _luhn(_digits(surface))
    # what only looks like a card may be a phone; phones have at most 15 digits after 00
    phone = surface.rlike(rf"\A(?:{PATTERNS['phone']})\z") & (F.length(F.regexp_replace(_digits(surface), r"\A00(?=[1-9])", "")) <= 15)
    found = found.when(_whole(surface, "card"), F.when(card, "card").when(phone, "phone"))
    found = found.when(_whole(surface, "iban"), "iban").when(_whole(surface, "phone"), "phone")
    return found.when(_whole(surface, "person"), "person")


def canonical(kind: Column, surface: Column) -> Column:
    """What equal entities have in common."""
    return F.when(kind == "email", F.lower(surface)).when(kind.isin("card", "ssn", "phone"), _digits(surface)) \
        .when(kind == "iban", F.replace(surface, F.lit(" "), F.lit(""))).when(kind.isin("male", "female", "surname"), F.initcap(surface)) \
        .otherwise(surface)


def script_of(c: Column) -> Column:
    return F.when(c.rlike(r"\p{IsCyrillic}"), "cyrillic").when(c.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def _hash(key: str, kind: Column, value: Column, attempt: int, salt: str = "") -> Column:
    """64 hexadecimal digits."""
    return F.sha2(F.concat_ws("\u0001", F.lit(key), kind, value, F.lit(str(attempt)), F.lit(salt)), 256)


def _number(hexa: Column, at: int) -> Column:
    """28 bits of a hash as a long."""
    return F.conv(F.substring(hexa, 1 + 7 * at, 7), 16, 10).cast("long")


def _stream(hexa: Column, i: Column) -> Column:
    """Two digits' worth of the hash for place i: 0 to 255."""
    return F.conv(F.substring(hexa, (i * 2) % 62 + 1, F.lit(2)), 16, 10).cast("int")


def _shaped(value: Column, hexa: Column, hex_only: Column) -> Column:
    """Digits for digits, letters for letters of the same case; the rest as it is."""
    def one(c: Column, i: Column) -> Column:
        n = _stream(hexa, i) + i * 7
        return F.when(c.rlike("[0-9]"), (n % 10).cast("string")) \
            .when(c.rlike("[a-z]"), F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), F.when(hex_only, n % 6).otherwise(n % 26) + 1, F.lit(1))) \
            .when(c.rlike("[A-Z]"), F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), F.when(hex_only, n % 6).otherwise(n % 26) + 1, F.lit(1))) \
            .otherwise(c)
    return F.array_join(F.transform(F.split(value, ""), one), "")


def _name(script: Column, hexa: Column, ending: int, attempt: int) -> Column:
    """A name of two syllables, each attempt one more: in the end more names than any corpus holds."""
    def build(parts: tuple) -> Column:
        inner, ends = F.array(*map(F.lit, parts[0])), F.array(*map(F.lit, parts[ending]))
        # after the first four places a digit of the hash each, none that another place uses
        digits = [_number(hexa, k) if k < 4 else F.conv(F.substring(hexa, 25 + k, 1), 16, 10).cast("long") for k in range(min(25, 1 + attempt))]
        return F.initcap(F.concat(*[F.element_at(inner, (d % len(parts[0]) + 1).cast("int")) for d in digits],
                                  F.element_at(ends, (_number(hexa, 7) % len(parts[ending]) + 1).cast("int"))))
    return F.when(script == "cyrillic", build(SYLLABLES["cyrillic"])).when(script == "greek", build(SYLLABLES["greek"])) \
        .otherwise(build(SYLLABLES["latin"]))


def candidate(kind: Column, value: Column, key: str, attempt: int) -> Column:
    """The surrogate, in canonical form, that an entity asks for at an attempt."""
    h = _hash(key, kind, value, attempt)
    more = F.substring(h, 33, min(24, 2 * max(0, attempt - 3)))  # what the shape cannot hold goes behind it
    hex_only = F.lower(value).rlike(r"\A[0-9a-f]+\z")
    shaped = F.concat(_shaped(value, h, hex_only), more)
    local, domain = F.substring_index(value, "@", 1), F.element_at(F.array(*map(F.lit, ("com", "net", "org"))),
                                                                  (_number(h, 8) % 3 + 1).cast("int"))
    email = F.concat(_shaped(local, h, F.lit(False)), more, F.lit("@example."), domain)
    octets = F.array(*[_number(h, k) % 256 for k in range(4)])
    ip = F.concat_ws(".", *[(F.element_at(octets, 1) % 16 + 240 if k == 1 and attempt < 8 else F.element_at(octets, k)).cast("string")
                            for k in (1, 2, 3, 4)])
    digits = _shaped(value, h, F.lit(False))
    # what leads a phone's last ten digits is its country's code, which stays; the first digit after it is no 0 or 1
    code = F.greatest(F.length(value) - 10, F.lit(0))
    phone = F.concat(F.substring(value, F.lit(1), code), F.translate(F.substring(digits, code + 1, F.lit(1)), "01", "24"),
                     F.substring(digits, code + 2, F.length(digits)))
    body = F.concat(F.substring(value, 1, 4), F.substring(digits, F.lit(5), F.length(digits) - 5))  # the issuer stays
    check = F.aggregate(F.transform(F.split(F.reverse(body), ""), lambda d, i: F.when(i % 2 == 1, d.cast("int")).otherwise(
        d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0))), F.lit(0), lambda a, b: a + b)
    card = F.concat(body, F.pmod(F.lit(10) - check % 10, F.lit(10)).cast("string"))
    ssn = F.concat(F.lit("9"), F.substring(digits, F.lit(2), F.length(digits)))
    script = script_of(value)
    return F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "phone", phone).when(kind == "card", card) \
        .when(kind == "ssn", ssn).when(kind.isin("key", "iban"), F.concat(F.substring(value, 1, 4), F.substring(shaped, F.lit(5), F.length(shaped)))) \
        .when(kind == "male", _name(script, h, 1, attempt)).when(kind == "female", _name(script, h, 2, attempt)) \
        .when(kind == "surname", _name(script, h, 3, attempt)).otherwise(shaped)


def rendered(kind: Column, surface: Column, canon: Column) -> Column:
    """The canonical surrogate in the format of the surface."""
    slots = F.split(surface, "")
    # digit after digit of the surrogate into the surface's places; the i-th place takes as many as digits came before
    placed = F.array_join(F.transform(slots, lambda c, i: F.when(c.rlike("[0-9]"), F.substring(
        canon, F.length(_digits(F.array_join(F.slice(slots, F.lit(1), i + 1), ""))), F.lit(1))).otherwise(c)), "")
    # an account's blanks: in front of place i there are as many blanks as the surface has up to it
    spaced = F.array_join(F.transform(slots, lambda c, i: F.when(c == " ", c).otherwise(F.substring(
        canon, F.length(F.replace(F.array_join(F.slice(slots, F.lit(1), i + 1), ""), F.lit(" "), F.lit(""))), F.lit(1)))), "")
    upper = (surface == F.upper(surface)) & (surface != F.lower(surface)) & (F.length(surface) > 1)
    return F.when(kind.isin("card", "ssn", "phone"), placed).when(kind == "iban", spaced) \
        .when(kind.isin("email", "male", "female", "surname") & upper, F.upper(canon)).otherwise(canon)


def _parts(pos: Column, surface: Column, kind: Column) -> Column:
    """An entity as parts (pos, part, kind, surface): a person is given names and
    a surname of their own, so that a surname alone meets the full name."""
    words = F.split(surface, " ")
    first = F.regexp_replace(F.element_at(words, 1), r"\.\z", "")
    address = first.isin(*sum(_ADDRESSES.values(), ()))
    known = F.element_at(words, F.when(address & (F.size(words) > 2), 2).otherwise(1))
    gender = F.when(first.isin(*_ADDRESSES["female"]) | known.isin(*GIVEN_FEMALE), "female").otherwise("male")
    person = F.transform(words, lambda w, i: F.struct(
        pos.alias("pos"), i.cast("int").alias("part"),
        F.when((i == 0) & address, F.lit(None).cast("string")).when(i == F.size(words) - 1, "surname").otherwise(gender).alias("kind"),
        w.alias("surface")))
    whole = F.array(F.struct(pos.alias("pos"), F.lit(0).alias("part"), kind.alias("kind"), surface.alias("surface")))
    return F.when(kind == "person", person).otherwise(whole)


def surrogates(entities: DataFrame, key: str = KEY, most_attempts: int = MOST_ATTEMPTS) -> DataFrame:
    """(kind, canon, surrogate) for every different (kind, canon): no two of a
    kind share a surrogate and none is an entity of its kind.

    An attempt shuffles the entities that are still open; almost all settle at the first."""
    entities = materialize(entities.distinct(), "entities")
    taken, pending = None, entities
    for attempt in range(most_attempts):
        asked = pending.withColumn("surrogate", candidate(F.col("kind"), F.col("canon"), key, attempt))
        # one claimant each; none if it is an entity itself
        per = asked.groupBy("kind", "surrogate").agg(F.min("canon").alias("canon"))
        real = entities.withColumnRenamed("canon", "surrogate")
        won = per.join(real, ["kind", "surrogate"], "left_anti")
        if taken is not None:
            won = won.join(taken.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
        won = materialize(won.select("kind", "canon", "surrogate"), "surrogates")
        taken = won if taken is None else taken.unionByName(won)
        pending = materialize(pending.join(won.select("kind", "canon"), ["kind", "canon"], "left_anti"), "open")
        if pending.isEmpty():
            return taken
    raise RuntimeError(f"entities without a surrogate of their own after {most_attempts} attempts")


def replace_entities(docs: DataFrame, text_col: str = "text", key: str = KEY, count_name: str | None = None) -> DataFrame:
    """``docs`` with surrogates in the text; ``count_name`` adds the number of replaced entities."""
    require(docs, text_col)
    names = docs.columns
    at = f"c{names.index(text_col)}"
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    stored = materialize(with_row_ids(plain.withColumn("found", find(F.col(at).cast("string")))), "found")
    has = F.coalesce(F.size("found") > 0, F.lit(False))
    # the second look at a text with entities tells which of them are secrets
    hits = stored.where(has).withColumn("secrets", F.regexp_extract_all(F.col(at), _re(EVERY), F.lit(1))) \
        .select("rid", F.posexplode(F.arrays_zip("found", "secrets")).alias("pos", "hit"))
    hits = hits.select("rid", "pos", F.col("hit.found").alias("surface"), kind_of(F.col("hit.found"), F.col("hit.secrets")).alias("kind")) \
        .where("kind is not null")
    parts = hits.select("rid", F.explode(_parts(F.col("pos"), F.col("surface"), F.col("kind"))).alias("p")).select("rid", "p.*")
    parts = materialize(parts.withColumn("canon", canonical(F.col("kind"), F.col("surface"))), "parts")
    named = surrogates(parts.where("kind is not null").select("kind", "canon"), key)
    # a corpus-wide hot entity is one key of this join; adaptive execution splits it
    put = parts.where("kind is not null").join(named, ["kind", "canon"]) \
        .select("rid", "pos", "part", rendered(F.col("kind"), F.col("surface"), F.col("surrogate")).alias("new")) \
        .unionByName(parts.where("kind is null").select("rid", "pos", "part", F.col("surface").alias("new")))
    per = put.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("pos", "part", "new"))).alias("put"))
    # surfaces by place: the parts of one place joined by a blank, places without parts as found
    pieces = F.split(F.col(at), EVERY, -1)
    new_at = lambda i: F.array_join(F.transform(F.filter("put", lambda p: p.pos == i), lambda p: p.new), " ")
    fresh = F.transform("found", lambda s, i: F.when(F.exists("put", lambda p: p.pos == i), new_at(i)).otherwise(s))
    text = F.array_join(F.flatten(F.zip_with("pieces", "fresh", lambda a, b: F.array(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))))), "")
    changed = stored.where(has).join(per, "rid").withColumn("pieces", pieces).withColumn("fresh", fresh) \
        .withColumn("count", F.size(F.array_distinct(F.transform("put", lambda p: p.pos)))).withColumn(at, text)
    same = stored.where(~has).withColumn("count", F.lit(0)) \
        .unionByName(stored.where(has).join(per.select("rid"), "rid", "left_anti").withColumn("count", F.lit(0)))
    columns = [*plain.columns, *(["count"] if count_name else [])]
    return changed.select(columns).unionByName(same.select(columns)).toDF(*names, *([count_name] if count_name else []))
