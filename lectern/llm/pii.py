"""Operator 6: surrogates for personal data, with built-in functions only.

Entities (e-mail addresses, phone, card and social security numbers, IBANs, IP
addresses, secrets, person names with a title or a usual given name) are found by
pattern, in one scan that is written down. Numbers that only look like cards fail the
card check and stay. Each distinct entity, in a canonical form, gets a surrogate
derived from a secret key: the same kind, length and separators, letters of the same
script and case, valid check digits of cards and IBANs, addresses from reserved
ranges, names in the script of the name and given names of its gender. A check over
all surrogates of the corpus makes them distinct, whatever their kind: one that two
entities would share, or that is itself an entity of the corpus, is drawn again with
the next attempt number, which also widens what names and addresses are drawn from.
So equal entities stay equal and different ones stay different, within and across
documents; where a name is found in a document, its bare mentions there (as it stands
or in capitals) take its surrogate, too. A name that is an ordinary word as well (by a list,
or because the document has it in small letters) is taken as mentioned only where the text
goes on as it does of persons; elsewhere such a word stays.

Edge cases: a null text stays null and has no entities; texts without entities pass
unchanged and are never shuffled; very long texts are scanned whole; repeated rows
come back repeated, changed alike; an entity written in another case or with other
separators keeps its surrogate and its own format; a name ends before a possessive s, has
up to four parts, and small words between them (von, de la) stay; where entities overlap, the one
that begins first counts, of two that begin together the one named first in ``KINDS``;
of two draws of one surrogate the earlier attempt, then the smaller entity keeps it; a
null id is a valid row; an empty table gives an empty result; other columns of
``surrogates`` are carried as they are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm.common import table, written

KEY = "lectern-surrogates"
#: Draws for one entity before giving up; the space of names and addresses has grown long before.
MAX_ATTEMPTS = 60
#: Attempts after which names get longer and addresses leave the reserved range.
NARROW = 2

_BEFORE, _AFTER = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_FEMALE, _MALE = r"(?:Mrs|MRS\.|Ms|Miss|Frau|Madame|Mme|Señora|Sra)", r"(?:Mr|MR\.|Herr|Monsieur|Señor|Sr)"
_TITLE = rf"(?:{_FEMALE}|{_MALE}|Dr|DR\.|Prof|PROF\.|Doctor|Professor)"
_TITLES = rf"(?:{_TITLE}\.? )+"
#: A name; an apostrophe belongs to it unless a possessive s follows.
_NAME = r"\p{Lu}(?:[\p{L}\-]|['\x{2019}](?![sS](?![\p{L}\p{N}])))+"
#: Small words between the parts of a name, which stay.
_PARTICLES = r"(?:(?:al|bin|da|de|del|della|den|der|di|dos|du|la|las|los|ten|ter|van|von|zu|y) ){0,3}"
_MORE = rf"(?: {_PARTICLES}{_NAME})"

#: Usual given names, by gender: a name that begins with one is found without a title.
GIVEN = {
    "given_f": "Alice Amelia Anna Barbara Carmen Charlotte Christine Clara Elena Elizabeth Emily Emma Hannah Helen Irene Jane Jennifer Jessica Julia Karen Katharina Laura Linda Lisa Lucia Margaret Maria Marie Martha Mary Monika Nicole Nora Olga Olivia Patricia Paula Petra Rachel Rebecca Sabine Sandra Sarah Sofia Sophie Susan Teresa Ursula Victoria Анна Елена Ирина Мария Наталья Ольга Светлана Татьяна Άννα Ελένη Κατερίνα Μαρία Σοφία".split(),
    "given_m": "Adam Alexander Andreas Andrew Anthony Anton Antonio Benjamin Bruno Carlos Charles Christopher Daniel David Edward Felix George Hans Heinrich Henry Hugo Jacob James John Jonas Joseph José Juan Klaus Lukas Luis Marco Markus Martin Michael Miguel Nicolas Oliver Oscar Patrick Paul Pedro Peter Pierre Richard Robert Samuel Simon Stefan Stephen Thomas Victor William Алексей Андрей Дмитрий Иван Михаил Николай Пётр Сергей Γιάννης Γιώργος Δημήτρης Κώστας Νίκος".split(),
}
_SYLLABLES = {
    "latin": "ba ber bor da del dor fa fen gar gol ha hel kal kor la len lin lor mar men mor na nel nor pal per ra ren ros sal sen sor ta ten tor val ven vor wal zen".split(),
    "marked": "bä dé fö gå hé jö kü lé mö né ñá pé rü sé té vö".split(),
    "cyrillic": "ба бел вор га гор да дол за зор ка кол ла лен ма мир на нов па пол ра рос са сол та тор фа хар чер".split(),
    "greek": "βα βελ γα γορ δα δελ θα καλ κορ λα λεν μα μιρ να νορ πα πελ ρα ροσ σα σελ τα τορ φα χαρ".split(),
}
#: Country codes of one and two digits; all others have three.
_COUNTRY = r"^\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
#: What follows a word such as "token": a quoted value, or a bare one with a digit in it.
_VALUE = r"""(?:"[^"\s]{8,}"|'[^'\s]{8,}'|(?=[^"'\s,;]{0,200}\d)[^"'\s,;]{8,})"""
_KEYWORD = r"""(?i:token|secret|passwd|password|pwd|api[_\-]?key)["']?[ \t]{0,3}[=:][ \t]{0,3}"""
#: Patterns by kind; each begins where no letter or digit stands before it.
KINDS = {
    "email": r"[\p{L}\p{N}_%+][\p{L}\p{N}._%+\-]{0,63}+@[\p{L}\p{N}\-]+(?:\.[\p{L}\p{N}\-]+)*\.\p{L}{2,}",
    "ip": r"(?<!\d\.)(?:" + _OCTET + r"\.){3}" + _OCTET + r"(?!\.?\d)" + _AFTER + r"|(?<![:.])(?=[0-9A-Fa-f]{0,4}:)(?=[0-9A-Fa-f:]{0,39}\d)(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\p{L}\p{N}:])",
    "ssn": r"(?<!-)\d{3}-\d{2}-\d{4}(?!-)" + _AFTER,
    "phone": r"(?:(?=(?:\d[ .\-/]?){9,11}(?!\d))(?!\d\d[.\-/]\d\d[.\-/]\d{4}(?!\d))0\d{1,4}(?<sep>[ .\-/])\d{2,4}(?:\k<sep>\d{2,4}){1,3}|\+\d{1,3}[ .\-/]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .\-/]?\d{2,4}){2,4}|(?<!\()\(\d{3}\) ?\d{3}[\-. ]\d{4}|\d{3}[\-.]\d{3}[\-.]\d{4}|[2-9]\d\d [2-9]\d\d \d{4}|0[1-9]\d{1,3}[ /\-]\d{5,9})" + _AFTER,
    "card": r"\d(?:[ \-]?\d){12,18}" + _AFTER,
    "iban": r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?" + _AFTER,
    "secret": _KEYWORD + _VALUE + r"|AKIA[0-9A-Z]{16}" + _AFTER,
    "person": rf"(?:{_TITLES}{_PARTICLES}{_NAME}{_MORE}{{0,3}}|(?:{'|'.join(sorted(GIVEN['given_f'] + GIVEN['given_m'], reverse=True))}){_MORE}{{1,3}})" + _AFTER,
}


def _any(kinds: list[str]) -> str:
    """One pattern of several kinds; what can follow is looked at before the kinds are tried."""
    first = {"ip": r"[0-9A-Fa-f:]", "ssn": r"\d", "phone": r"[\d+(]", "card": r"\d", "iban": "[A-Z]", "secret": "[TtSsPpAa]", "person": r"\p{Lu}"}
    return _BEFORE + "(?:" + "|".join((f"(?={first[k]})" if k in first else "") + f"(?:{KINDS[k]})" for k in kinds) + ")"


_ANY = _any(list(KINDS))
#: For texts without an at sign: e-mail addresses are tried at every word.
_NO_EMAIL = _any([k for k in KINDS if k != "email"])
#: Names that are ordinary words, too.
_WORDS = "april august bill black brown church day english field fields forest french glass grace grant green gray grey hall hill hope house joy june king lake lane long love march mark may moon night north page park penny price rich rivers rose rush sharp short sky snow south star stone summer sun wall waters west white will winter wise wood woods young".split()
#: A bare mention of such a word is the person only where the text goes on as it does of persons, and not after what stands before times and places.
_NOT_AFTER = r"(?<!\b(?i:in|of|on|at|by|since|until|till|last|next|this|early|late|mid|from|to|for|the|a|an) )"
_PERSONAL = r"(?=['\x{2019}][sS](?![\p{L}])|,? (?i:was|is|has|had|will|would|did|does|said|says|told|asked|wrote|went|came|thinks|thought|knew|knows|made|took|gave|called|replied|answered|who|whose)(?![\p{L}]))"
#: No entity is in a text without one of these.
_HINT = rf"[@0-9]|{_BEFORE}(?:(?=\p{{Lu}})(?:{_TITLE}|{'|'.join(sorted(GIVEN['given_f'] + GIVEN['given_m'], reverse=True))})\.? |(?=[TtSsPpAa])(?i:token|secret|passw|pwd|api[_\-]?key))"

#: Letters by script and case; a letter is replaced by one of its own list.
ALPHABETS = [
    "0123456789",
    "abcdefghijklmnopqrstuvwxyz",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "àâäçèéêëîïñóôöúùûüß",
    "ÀÂÄÇÈÉÊËÎÏÑÓÔÖÚÙÛÜ",
    "абвгдежзийклмнопрстуфхцчшщэюя",
    "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЭЮЯ",
    "αβγδεζηθικλμνξοπρστυφχψω",
    "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ",
]


def found(text: Column) -> Column:
    """All that the patterns match in a text, in order; texts without a hint skip the search."""
    hits = F.when(text.contains("@"), F.regexp_extract_all(text, F.lit(_ANY), F.lit(0))).otherwise(F.regexp_extract_all(text, F.lit(_NO_EMAIL), F.lit(0)))
    return F.when(text.rlike(_HINT), hits).otherwise(F.array().cast("array<string>"))


def _digit_values(digits: Column) -> Column:
    """Of a card number the values that its check adds, from the last digit on."""
    d = F.transform(F.split(F.reverse(digits), ""), lambda c: c.cast("int"))
    return F.transform(d, lambda x, i: F.when(i % 2 == 1, F.when(x * 2 > 9, x * 2 - 9).otherwise(x * 2)).otherwise(x))


def _card_sum(digits: Column) -> Column:
    return F.aggregate(_digit_values(digits), F.lit(0), lambda a, x: a + x)


def _mod97(characters: Column) -> Column:
    """The remainder of an IBAN-like string, letters counting 10 to 35."""
    step = lambda a, c: F.pmod(F.when(c.rlike("[0-9]"), a * 10 + c.cast("int")).otherwise(a * 100 + F.ascii(c) - 55), F.lit(97))
    return F.aggregate(F.split(characters, ""), F.lit(0), step)


def kind_of(value: Column) -> Column:
    """The kind of a match, or null for a number that is no card."""
    is_card = F.pmod(_card_sum(F.regexp_replace(value, r"\D", "")), F.lit(10)) == 0
    shape = lambda k: value.rlike(rf"^(?:{KINDS[k]})$")
    kinds = [(k, shape(k)) for k in ("email", "ip", "ssn", "phone")] + [("card", shape("card") & is_card), (None, shape("card"))] + [(k, shape(k)) for k in ("iban", "secret")]
    return reduce(lambda rest, k: F.when(k[1], F.lit(k[0])).otherwise(rest), reversed(kinds), F.lit("person"))


def _known(name: Column, gender: str) -> Column:
    return F.lower(name).isin(*[n.lower() for n in GIVEN[gender]])


def parts_of(value: Column, kind: Column) -> Column:
    """(place, kind, canonical, shown, before) of each part of an entity that has a surrogate of its own; what stands before it is no part."""
    part = lambda place, k, canon, shown, before: F.struct(place.cast("int").alias("place"), k.alias("kind"), canon.alias("canon"), shown.alias("shown"), before.alias("before"))
    title = F.regexp_extract(value, f"^(?:{_TITLES})?{_PARTICLES}", 0)
    # Small words stand behind the part before them.
    names = F.split(F.substring(value, F.length(title) + 1, F.length(value)), r" (?=\p{Lu})")
    name, small = lambda n: F.substring_index(n, " ", 1), lambda i: F.regexp_extract(F.get(names, i - 1), r"^\S+( .*)?$", 1)
    by_title = F.when(title.rlike(rf"(?<!\p{{L}}){_FEMALE}\.? "), "given_f").when(title.rlike(rf"(?<!\p{{L}}){_MALE}\.? "), "given_m").otherwise("given_n")
    gender = lambda n: F.when(_known(n, "given_f"), "given_f").when(_known(n, "given_m"), "given_m").otherwise(by_title)
    persons = F.transform(names, lambda n, i: part(i, F.when(i < F.size(names) - 1, gender(name(n))).otherwise("surname"), F.lower(name(n)), name(n), F.when(i == 0, title).otherwise(F.concat(small(i), F.lit(" ")))))
    told = F.when(kind == "secret", F.regexp_extract(value, rf"^(?:{_KEYWORD}[\"']?)?", 0)).otherwise("")
    shown = F.substring(value, F.length(told) + 1, F.length(value))
    digits = F.regexp_replace(value, r"\D", "")
    # A North American number is the same with and without its country code; another code is part of what a number says.
    phone = F.when(digits.rlike(r"^1\d{10}$"), F.substring(digits, F.lit(2), F.lit(10))).when(value.startswith("+"), F.concat(F.lit("+"), digits)).otherwise(digits)
    canon = F.when(kind == "phone", phone).when(kind.isin("card", "ssn"), digits).when(kind == "iban", F.regexp_replace(value, " ", "")).when(kind == "secret", F.regexp_replace(shown, "[\"']$", "")).otherwise(F.lower(value))
    return F.when(kind == "person", persons).otherwise(F.array(part(F.lit(0), kind, canon, shown, told)))


def _draw(seed: Column, i: Column, n: int) -> Column:
    return (F.pmod(F.xxhash64(seed, i), F.lit(n)) + 1).cast("int")


def _one(seed: Column, i: Column, of: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in of]), _draw(seed, i, len(of)))


def scrambled(value: Column, seed: Column, alphabets: list[str] | None = None) -> Column:
    """Every letter and digit replaced by a drawn one of its script and case; all else stays."""

    def one(c: Column, i: Column) -> Column:
        # Letters beyond the listed alphabets are drawn from their own block of 32 code points.
        far = F.when(c.rlike(r"[\p{L}\p{N}]"), F.decode(F.unhex(F.lpad(F.hex(_block(c) + _draw(seed, i, 32) - 1), 8, "0")), "UTF-32"))
        drawn = far.otherwise(c)
        for a in reversed(alphabets or ALPHABETS):
            drawn = F.when(F.instr(F.lit(a), c) > 0, F.substring(F.lit(a), _draw(seed, i, len(a)), F.lit(1))).otherwise(drawn)
        return drawn

    return F.array_join(F.transform(F.split(value, ""), one), "")


def _block(c: Column) -> Column:
    code = F.conv(F.hex(F.encode(c, "UTF-32BE")), 16, 10).cast("long")
    return code - F.pmod(code, F.lit(32))


def _with_card_digit(digits: Column) -> Column:
    """The digits with the last replaced so that the card check holds."""
    start = F.substring(digits, F.lit(1), F.length(digits) - 1)
    return F.concat(start, F.pmod(F.lit(10) - F.pmod(_card_sum(F.concat(start, F.lit("0"))), F.lit(10)), F.lit(10)).cast("string"))


def _with_iban_digits(iban: Column) -> Column:
    """The IBAN with check digits that hold."""
    country, rest = F.substring(iban, 1, 2), F.substring(iban, F.lit(5), F.length(iban))
    return F.concat(country, F.lpad((F.lit(98) - _mod97(F.concat(rest, country, F.lit("00")))).cast("string"), 2, "0"), rest)


def _named(canon: Column, kind: Column, seed: Column, attempt: Column, plain: Column) -> Column:
    """A name in the script of the canonical one; later attempts are longer."""
    longer = F.greatest(attempt - NARROW, F.lit(0))
    more = lambda script, n: F.array_join(F.transform(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), lambda i: _one(seed, i, _SYLLABLES[script])), "")

    def of(script: str, like: str) -> Column:
        pool = {k: [n.lower() for n in names if _script(n) == script] for k, names in GIVEN.items()}
        given = lambda names: F.concat(_one(seed, F.lit(0), names), more(script, longer))
        surname = F.concat(F.when(canon.rlike(r"[^\x00-\x7F]"), _one(seed, F.lit(0), _SYLLABLES["marked"])).otherwise("") if script == "latin" else F.lit(""), more(script, attempt + 3))
        name = F.when(kind == "surname", surname).when(kind == "given_f", given(pool["given_f"])).when(kind == "given_m", given(pool["given_m"])).otherwise(given(pool["given_f"] + pool["given_m"]))
        return F.when(canon.rlike(rf"^[{like}'\x{{2019}}\-]+$"), name)

    return F.coalesce(of("latin", r"\p{IsLatin}"), of("cyrillic", r"\p{IsCyrillic}"), of("greek", r"\p{IsGreek}"), plain)


def _script(name: str) -> str:
    return "cyrillic" if "Ѐ" <= name[-1] < "Ԁ" else "greek" if "Ͱ" <= name[-1] < "Ѐ" else "latin"


def surrogate(kind: Column, canon: Column, attempt: Column, key: str) -> Column:
    """The surrogate of a canonical entity at an attempt."""
    seed = F.sha2(F.concat_ws("\x00", F.lit(key), kind, attempt.cast("string"), canon, F.lit(key)), 256)
    plain = scrambled(canon, seed)
    number = lambda i, n: (_draw(seed, F.lit(1000 + i), n) - 1).cast("string")
    rest = F.substring(plain, F.lit(2), F.length(plain))
    tail = F.substring(plain, F.lit(3), F.length(plain))
    # Reserved addresses first, then any; the private block of the longer kind has room for all.
    octet = F.when(attempt <= NARROW, (F.lit(239) + _draw(seed, F.lit(1000), 16)).cast("string")).otherwise(number(0, 256))
    groups = F.transform(F.sequence(F.lit(1), F.lit(7)), lambda i: F.lower(F.lpad(F.hex(_draw(seed, i, 65536) - 1), 4, "0")))
    wide = F.concat(F.lit("fd"), F.lower(F.lpad(F.hex(_draw(seed, F.lit(0), 256) - 1), 2, "0")), F.lit(":"), F.array_join(groups, ":"))
    # Area codes and exchanges do not begin with 0 or 1; a trunk zero stays.
    lead = lambda at: F.translate(F.substring(plain, at, 1), "01", "23")
    code = F.regexp_extract(canon, _COUNTRY, 0)
    national = F.when(canon.startswith("0"), F.concat(F.lit("0"), rest)).when(F.length(canon) == 10, F.concat(lead(1), F.substring(plain, 2, 2), lead(4), F.substring(plain, 5, 6))).otherwise(plain)
    return (
        F.when(kind == "email", F.concat(scrambled(F.substring_index(canon, "@", 1), seed), F.lit("@mail"), number(0, 1_000_000), F.lit(".example.org")))
        .when(kind == "ip", F.when(canon.contains(":"), wide).otherwise(F.concat_ws(".", octet, number(1, 256), number(2, 256), number(3, 256))))
        .when(kind == "card", _with_card_digit(F.concat(F.substring(canon, 1, 1), rest)))
        .when(kind == "ssn", F.concat(F.lit("9"), rest))
        .when(kind == "phone", F.when(canon.startswith("+"), F.concat(code, F.substring(plain, F.length(code) + 1, F.length(plain)))).otherwise(national))
        .when(kind == "iban", _with_iban_digits(F.concat(F.substring(canon, 1, 2), tail)))
        .when(kind.isin("surname", "given_f", "given_m", "given_n"), _named(canon, kind, seed, attempt, plain))
        .otherwise(F.when(canon.rlike("^[0-9a-f]+$"), scrambled(canon, seed, ["0123456789", "abcdef"])).when(canon.rlike("^[0-9A-F]+$"), scrambled(canon, seed, ["0123456789", "ABCDEF"])).otherwise(plain))
    )


def drawn(entities: DataFrame, key: str = KEY) -> DataFrame:
    """kind, canon, fake for distinct (kind, canon) rows, all fakes distinct and none of them an entity of any kind."""
    made = written(entities.select("kind", "canon", F.lit(0).alias("attempt"), surrogate(F.col("kind"), F.col("canon"), F.lit(0), key).alias("fake")))
    taken = entities.select(F.col("canon").alias("c")).distinct()
    for _ in range(MAX_ATTEMPTS):
        real = made.join(taken, F.col("fake") == F.col("c"), "left")
        # The first of those that share a fake keeps it, the earlier attempt first: what is settled stays settled.
        again = F.col("c").isNotNull() | (F.row_number().over(W.partitionBy("fake").orderBy("attempt", "canon", "kind")) > 1)
        judged = written(real.withColumn("again", again).drop("c"))
        if judged.filter("again").isEmpty():
            return judged.select("kind", "canon", "fake")
        attempt = F.col("attempt") + 1
        made = judged.filter("NOT again").select("kind", "canon", "attempt", "fake").unionByName(judged.filter("again").select("kind", "canon", attempt.alias("attempt"), surrogate(F.col("kind"), F.col("canon"), attempt, key).alias("fake")))
    raise ValueError("surrogates stay ambiguous; widen their formats")


def shown_as(kind: Column, fake: Column, shown: Column) -> Column:
    """A surrogate in the format of the entity it stands for: its separators and its case."""
    own, digits = F.regexp_replace(shown, r"\D", ""), F.regexp_replace(fake, r"\D", "")
    # A country code that is no part of the canonical form stays.
    digits = F.concat(F.substring(own, F.lit(1), F.length(own) - F.length(digits)), digits)
    at = lambda i: F.regexp_count(F.substring(shown, F.lit(1), i), F.lit(r"[0-9]")) + 1
    numbers = F.array_join(F.transform(F.split(shown, ""), lambda c, i: F.when(c.rlike("[0-9]"), F.substring(digits, at(i), F.lit(1))).otherwise(c)), "")
    chars = lambda i: F.length(F.regexp_replace(F.substring(shown, F.lit(1), i), " ", "")) + 1
    spaced = F.array_join(F.transform(F.split(shown, ""), lambda c, i: F.when(c == " ", c).otherwise(F.substring(fake, chars(i), F.lit(1)))), "")
    quote = F.regexp_extract(shown, "[\"']$", 0)
    upper = (shown == F.upper(shown)) & (F.length(shown) > 1)
    words = F.when(upper, F.upper(fake)).otherwise(F.when(kind.isin("surname", "given_f", "given_m", "given_n"), F.initcap(fake)).otherwise(fake))
    return F.when(kind.isin("phone", "card", "ssn"), numbers).when(kind == "iban", spaced).when(kind == "secret", F.concat(fake, quote)).when(kind == "ip", fake).otherwise(words)


def replaced(text: Column, pattern: Column, to: Column) -> Column:
    """The text with every match of the pattern looked up in the map ``to``."""
    new = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), lambda h: F.coalesce(F.element_at(to, h), h))
    return F.array_join(F.zip_with(F.split(text, pattern, -1), F.concat(new, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")


def bare_mention(name: Column, text: Column) -> Column:
    """The pattern of a name without its context; of a word that is no name as well (by a list, or since the text has it in small letters), only where it is surely the person."""
    quoted = F.concat(F.lit(r"\Q"), name, F.lit(r"\E"))
    low = F.lower(name)
    word = low.isin(*_WORDS) | ((low != name) & F.rlike(text, F.concat(F.lit(_BEFORE + r"\Q"), low, F.lit(r"\E" + _AFTER))))
    return F.when(word, F.concat(F.lit(_NOT_AFTER), quoted, F.lit(_PERSONAL))).otherwise(quoted)


def _changed(docs: DataFrame, text_col: str, key: str) -> DataFrame:
    """row, text, n_found: every input row, its text with surrogates, and its entities by kind."""
    # The only scan of all texts; what follows sees the few that have matches.
    scanned = written(docs.select(F.struct(*docs.columns).alias("row"), found(F.col(text_col)).alias("hits")))
    text = F.col("row")[text_col].alias("text")
    # Equal texts have equal maps, so a map belongs to a text, not to a row.
    mark = [F.xxhash64(text).alias("m1"), F.crc32(F.encode(text, "UTF-8")).alias("m2")]
    with_hits = scanned.filter(F.size("hits") > 0).select("row", text, "hits", *mark)
    values = with_hits.select("m1", "m2", F.explode("hits").alias("value")).distinct().withColumn("whole", kind_of(F.col("value"))).filter("whole IS NOT NULL")
    parts = written(values.select("m1", "m2", "value", "whole", F.inline(parts_of(F.col("value"), F.col("whole")))))
    fakes = drawn(written(parts.select("kind", "canon").distinct()), key)
    told = written(parts.join(fakes, ["kind", "canon"]).withColumn("new", shown_as(F.col("kind"), F.col("fake"), F.col("shown"))))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "before", "new"))), lambda x: F.concat(x["before"], x["new"])), "")
    each = told.groupBy("m1", "m2", "value", "whole").agg(whole.alias("new")).withColumn("bare", F.lit(False))
    # Bare mentions of the names of a text, as they stand and in capitals.
    names = told.filter("whole = 'person'").select("m1", "m2", F.explode(F.array_distinct(F.array(F.struct(F.col("shown").alias("value"), "new"), F.struct(F.upper("shown").alias("value"), F.upper("new").alias("new"))))).alias("n"))
    names = names.groupBy("m1", "m2", F.col("n.value").alias("value")).agg(F.min("n.new").alias("new")).select("m1", "m2", "value", F.lit("person").alias("whole"), "new", F.lit(True).alias("bare"))
    known = each.unionByName(names).groupBy("m1", "m2", "value").agg(F.min_by("whole", "bare").alias("whole"), F.min_by("new", "bare").alias("new"), F.bool_or("bare").alias("bare"))
    longest = F.transform(F.array_sort(F.collect_list(F.when(F.col("bare"), F.struct((-F.length("value")).alias("n"), "value")))), lambda x: x["value"])
    maps = known.groupBy("m1", "m2").agg(F.map_from_entries(F.collect_list(F.struct("value", "new"))).alias("to"), F.map_from_entries(F.collect_list(F.struct("value", "whole"))).alias("kinds"), longest.alias("names"))
    names = F.transform("names", lambda n: bare_mention(n, F.col("text")))
    pattern = F.when(F.size("names") > 0, F.concat(F.lit(f"{_ANY}|{_BEFORE}(?:"), F.array_join(names, "|"), F.lit(f"){_AFTER}"))).otherwise(F.lit(_ANY))
    changed = with_hits.join(maps, ["m1", "m2"], "left").withColumn("to", F.coalesce("to", F.create_map().cast("map<string,string>"))).withColumn("pattern", pattern)
    changed = changed.withColumn("each", F.transform(F.regexp_extract_all("text", "pattern", F.lit(0)), lambda h: F.element_at("kinds", h)))
    counts = F.struct(*[(F.size("each") - F.size(F.array_remove("each", name))).cast("long").alias(name) for name in KINDS])
    none = F.struct(*[F.lit(0).cast("long").alias(name) for name in KINDS])
    calm = scanned.filter(F.col("hits").isNull() | (F.size("hits") <= 0))
    done = changed.select("row", replaced(F.col("text"), F.col("pattern"), F.col("to")).alias("text"), F.when(F.col("kinds").isNotNull(), counts).otherwise(none).alias("n_found"))
    return done.unionByName(calm.select("row", text, none.alias("n_found")))


def surrogates(docs: DataFrame, text_col: str = "text", key: str = KEY) -> DataFrame:
    """All rows and columns, the text with surrogates, and ``n_found``: entities by kind (in place of a column of that name)."""
    kept = [(F.col("text") if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns if c != "n_found"]
    return _changed(docs, text_col, key).select(*kept, "n_found")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = surrogates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "text", *[F.col(f"n_found.{k}").alias(f"n_{k}") for k in KINDS])


def private_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents with surrogates in their texts."""
    done = _changed(docs, "text", KEY)
    return done.select(*[(F.col("text") if c == "text" else F.length("text").cast("long") if c == "n_chars" else F.col("row")[c]).alias(c) for c in docs.columns])
