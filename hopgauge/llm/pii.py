"""Keyed surrogates for personal data, with DataFrame and SQL functions only.

Detected are e-mail addresses (letters of any script), telephone numbers (international ones behind a +, 3-3-4, five pairs of digits, and local ones of an area code from 0 and five to eight digits), payment cards
(4-4-4-4, 4-6-5, and 13 to 19 digits with a right check digit), IBANs, social security numbers (3-2-4), IPv4 and IPv6 addresses, secrets behind a name such as
``token =`` up to their quote or white space, or with a known beginning such as AKIA or ghp_, personal names behind a title up to a word that begins sentences, and later or earlier bare mentions of such a name in the same text.
Other names, postal addresses and numbers without these forms are not. A surrogate depends on the key, the kind and the normalized value alone, so that all
mentions of one entity, in whatever spelling, get the same one (coreference), in every document and run with the same key:

* cards, telephone numbers, social security numbers, IBANs: the digits go through a keyed permutation without fixed points and into the places of the old
  digits; cards keep their first digit and whether their check digit is right, telephone numbers what stands before the last nine digits (six, if there are
  fewer than ten), IBANs their country, the difference of their check digits to right ones and what stands before the last twelve digits;
* IPv4: a keyed permutation of the addresses that share the first octet (two, where private ranges begin there: 172, 192, 169), so private, local
  and public addresses stay what they are; IPv6: a keyed permutation of the last 96 bits;
* e-mails: a keyed name, digits at its end as many as before, and a keyed name for the domain under ``example`` and the old top level;
* secrets: keyed characters of the same length, hexadecimal if the old one was; known beginnings stay;
* names: the title stays and with it the gender; given names end by gender, family names are keyed alone, so "Mr Ann Bo", "Mr
  Bo" and a bare "Bo" still agree; all in the script of the old name (Latin, Cyrillic, Greek).

Permutations cannot collide, and no value is its own surrogate. They share their space with the real values, so that a number's surrogate may be another
real number. Keyed words (parts of names, of e-mails, secrets) are checked over the whole corpus as they will be written, with ending, script and domain: the
surrogate of a part of a name must differ from every capitalized word of the corpus, detected or not, those of addresses and secrets from the real ones, and
all from each other. Only those that do not get a word of the next attempt, again and again until none is left; words of later attempts are
longer, so this ends. What had to move (few: of n words about n squared / 2^37) is looked up by the texts that hold such words: as a map in
one row if there are at most FEW, else by a join on the words of each text. Texts without an entity are never joined or shuffled.

The key is a secret: there is no default one. ``query`` and the pipeline read it from the setting ``spark.hopgauge.surrogate.key`` and take a fresh random one
where it is not set, so that nobody can undo the surrogates.

Defined results: null texts stay null; texts without entities stay as they are; columns other than text are kept as they are and
rows one by one, whatever their doc_ids; an empty table gives an empty table.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hopgauge.llm.common import let, spent, table, written

#: Kinds of keyed words.
WORDS = ("secret", "mail", "domain", "given", "family")
#: Moved words that are sent along as one row.
FEW = 10_000
#: Titles by gender (fixed values): m, f, n for either.
TITLES = {"m": "Mr Herr Monsieur Señor Sr Господин Κύριος", "f": "Mrs Ms Miss Frau Madame Mme Señora Sra Госпожа Κυρία", "n": "Dr Prof"}
_ANY_TITLE = "|".join(sorted(" ".join(TITLES.values()).split(), key=len, reverse=True))
_FIRST = "".join(sorted({t[0] for t in " ".join(TITLES.values()).split()}))
_HEX = "[0-9A-Fa-f]{1,4}"
#: Words that begin sentences or stand between names, and are no names (fixed values).
NO_NAMES = (
    "A After All Also An And Are As At Before But By Can Could Did Do Each Every For From Had Has Have He Her Here His How However If In Is It Its Later Many Most My No Not Now Of On One Or Our She Since So Some Such "
    "That The Their Then There These They This Those Through To Today Was We Were What When Where Which While Who Why Will With Would Yesterday Yet You Your "
    "Aber Als Am Auch Auf Aus Bei Bis Da Dann Das Dem Den Denn Der Die Dies Diese Dieser Doch Ein Eine Er Es Für Haben Hat Ich Ihr Im Ist Mit Nach Nicht Noch Nur Oder Sein Seit Sie Sind Und Vom Von Vor War Was Wenn Wer Wie Wir Wo Zu Zum Zur "
    "Au Aux Avec Ce Ces Cette Dans De Des Du Elle En Et Il Ils Je La Le Les Mais Nous Ou Par Pas Pour Que Qui Sa Sans Son Sur Un Une Vous "
    "Con Cuando Del Desde El Ella Ellos Entre Era Esta Este Fue Hay Las Lo Los Muy Para Pero Por Porque Se Según Sin Sobre Su También Una Y Ya Yo "
    "А Без Бы Был Быть В Вот Все Вы Где Да Для До Его Если Ее Же За И Из Или Их К Как Когда Кто Мы На Не Но О Он Она Они От По При С Так То Только Ты У Что Это Я Η Και Με Να Ο Οι Στη Στο Τα Τη Της Το Του Των"
).split()
_NO_NAME = rf"(?!(?:{'|'.join(NO_NAMES)})(?![\p{{L}}'-]))"
#: Countries whose IBANs are found in lower case, too (fixed values).
_LOWER_IBAN = "at|be|bg|ch|cy|cz|de|dk|ee|es|fi|fr|gb|gr|hr|hu|ie|is|it|li|lt|lu|lv|mt|nl|no|pl|pt|ro|se|si|sk"
#: Beginnings of secrets that stay (fixed values).
KNOWN_SECRET = "AKIA|ASIA|ghp_|gho_|ghu_|ghs_|ghr_|xox[abprs]-|sk-"
#: Patterns by kind, in the order in which they are tried at a place.
PATTERNS = {
    # what stands behind the name up to its quote or white space, without a sentence's last sign; behind a colon only with a digit or sign in it
    "secret": (
        rf"""(?<=["'=: ])(?<=[=:]\s{{0,2}}["']?)(?<=(?i:token|secret|password|passwd|pwd|api_?key|access_?key)["']?\s{{0,2}}[=:]\s{{0,2}}["']?)(?!["'\s])"""
        rf"""(?:(?<==\s{{0,2}}["']?)|(?=[^\s"'<>]*[^\p{{L}}\s"'<>.,;:!?)\]}}]))[^\s"'<>]{{3,}}(?<![.,;:!?)\]}}])"""
    ),
    "email": r"(?=[\p{L}\p{N}._%+-])(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)*\.\p{L}{2,}",
    "known": rf"(?=[AgSsx])\b(?:{KNOWN_SECRET})[A-Za-z0-9_-]{{16,}}",
    "iban": r"(?=[A-Z])(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])" + rf"|(?=[a-z])(?<![A-Za-z0-9])(?:{_LOWER_IBAN})\d{{2}}(?: ?[a-z0-9]{{4}}){{2,7}}(?: ?[a-z0-9]{{1,3}})?(?![A-Za-z0-9])",
    "ipv6": rf"(?=[0-9A-Fa-f:])(?<![\w:.])(?:(?:{_HEX}:){{7}}{_HEX}|(?=[0-9A-Fa-f:]*\d)(?:(?:{_HEX}:){{1,6}}(?::{_HEX}){{1,6}}|::(?:{_HEX}:){{0,5}}{_HEX}))(?![\w:])",
    "ip": r"(?=\d)(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)",
    "card": r"(?=\d)(?<!\d)(?:\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{4}|\d{4}[ -]\d{6}[ -]\d{5}|\d{13,19})(?!\d)",
    "ssn": r"(?=\d)(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?=[\d+(])(?<!\d)(?:(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}|\+\d{1,3}(?:[ .-]?\(?\d{2,4}\)?){2,5}|0\d(?:[ .-]\d{2}){4}|0\d{1,4}[ /-]\d{5,8})(?!\d)",
    "name": rf"(?=[{_FIRST}])\b(?:{_ANY_TITLE})\b\.? {_NO_NAME}\p{{Lu}}[\p{{L}}'-]+(?: {_NO_NAME}\p{{Lu}}[\p{{L}}'-]+)*+",
}
_CONSONANTS, _VOWELS = "bdfgklmnprstvzhj", "aeio"
_CYRILLIC, _GREEK = "бдфгклмнпрствзхйаеио", "βδφγκλμνπρστψζχξαειο"
#: Words that a keyed name could be: all others of a corpus need no look.
FORM = "|".join(rf"^(?:[{a[:16]}][{a[16:]}]){{4,}}(?:{a[7]}|{a[7]}{a[16]}|{a[10]})?$" for a in (_CONSONANTS + _VOWELS, _CYRILLIC, _GREEK))


def kind_of(entity: Column) -> Column:
    """The kind of a detected entity; "bare" for mentions of a name without its title, "none" for digits that are no card after all."""
    whole = lambda k: entity.rlike(f"^(?:{PATTERNS[k]})$")
    digits = F.regexp_replace(entity, "[^0-9]", "")
    real = (F.length(digits) == 16) | (check_digit(F.substring(digits, F.lit(1), F.length(digits) - 1)).cast("string") == F.substring(digits, F.length(digits), F.lit(1)))
    kinds = F.when(entity.contains("@") & whole("email"), "email")
    for k in ("iban", "ipv6", "ip", "ssn"):
        kinds = kinds.when(whole(k), k)
    return kinds.when(whole("card"), F.when(real, "card").otherwise("none")).when(whole("phone"), "phone").when(whole("name"), "name").otherwise("secret")


def normal(kind: Column, entity: Column) -> Column:
    """The value that all spellings of an entity share."""
    digits = F.regexp_replace(entity, "[^0-9]", "")
    plain = F.when(kind.isin("email", "ipv6"), F.lower(entity)).when(kind.isin("card", "phone", "ssn"), digits).when(kind == "iban", F.upper(F.replace(entity, F.lit(" "), F.lit(""))))
    return plain.when(kind == "name", F.regexp_replace(entity, r"^(\S+?)\.? ", "$1 ")).otherwise(entity)


def gender(title: Column) -> Column:
    return F.when(title.isin(*TITLES["m"].split()), "m").when(title.isin(*TITLES["f"].split()), "f").otherwise("n")


class Keyed:
    """Expressions of one key. attempts: map of the moved words (kind|word) and their attempts, or None."""

    def __init__(self, key: str, attempts: Column | None = None) -> None:
        self.key, self.attempts = F.lit(key), attempts

    def hex(self, label: str, *values: Column) -> Column:
        return F.sha2(F.concat_ws("|", self.key, F.lit(label), *[v.cast("string") for v in values]).cast("binary"), 256)

    def number(self, label: str, *values: Column) -> Column:
        """A keyed number below 2^60."""
        return F.conv(F.substring(self.hex(label, *values), 1, 15), 16, 10).cast("long")

    def _turns(self, label: str, pair: Column, of_a: Column, of_b: Column, back: bool) -> Column:
        sign = -1 if back else 1

        def turn(s: Column, i: Column) -> Column:
            change_a = F.struct(F.pmod(s["a"] + sign * F.pmod(self.number(label, i, s["b"]), of_a), of_a).alias("a"), s["b"].alias("b"))
            change_b = F.struct(s["a"].alias("a"), F.pmod(s["b"] + sign * F.pmod(self.number(label, i, s["a"]), of_b), of_b).alias("b"))
            return F.when(i % 2 == 0, change_a).otherwise(change_b)

        return F.aggregate(F.sequence(F.lit(7), F.lit(0)) if back else F.sequence(F.lit(0), F.lit(7)), pair, turn)

    def permuted(self, label: str, a: Column, b: Column, of_a: Column, of_b: Column) -> Column:
        """A permutation without fixed points of the pairs (a < of_a, b < of_b): struct a, b. A Feistel network there, one on, and back."""
        of_a, of_b = of_a.cast("long"), of_b.cast("long")
        there = self._turns(label, F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")), of_a, of_b, False)
        one_on = let(there, lambda p: F.struct(F.when(p["b"] + 1 == of_b, F.pmod(p["a"] + 1, of_a)).otherwise(p["a"]).alias("a"), F.pmod(p["b"] + 1, of_b).alias("b")))
        return self._turns(label, one_on, of_a, of_b, True)

    def digits(self, label: str, old: Column) -> Column:
        """A permutation without fixed points of the digit strings of one length (2 to 18)."""
        n = F.length(old)
        u = F.floor(n / 2).cast("int")
        ten = lambda k: F.pow(F.lit(10.0), k).cast("long")
        pair = self.permuted(label, F.substring(old, F.lit(1), u).try_cast("long"), F.substring(old, u + 1, n - u).try_cast("long"), ten(u), ten(n - u))
        return let(pair, lambda p: F.concat(F.lpad(p["a"].cast("string"), u, F.lit("0")), F.lpad(p["b"].cast("string"), n - u, F.lit("0"))))

    def last_digits(self, label: str, old: Column, n: Column) -> Column:
        """old with its last n digits permuted."""
        kept = F.length(old) - n
        return F.concat(F.substring(old, F.lit(1), kept), self.digits(label, F.substring(old, kept + 1, n)))

    def attempt(self, kind: str, value: Column) -> Column:
        if self.attempts is None:
            return F.lit(0)
        return F.coalesce(F.try_element_at(self.attempts, F.concat(F.lit(f"{kind}|"), value)), F.lit(0))

    def word(self, kind: str, value: Column, attempt: Column | None = None) -> Column:
        """The surrogate of a word under its attempt: syllables, or keyed characters for secrets. Later attempts give longer ones."""

        def syllable(h: Column, i: Column) -> Column:
            byte = F.conv(F.substring(h, 2 * i + 1, F.lit(2)), 16, 10).cast("int")
            return F.concat(F.substring(F.lit(_CONSONANTS), F.pmod(F.floor(byte / 4), F.lit(16)).cast("int") + 1, F.lit(1)), F.substring(F.lit(_VOWELS), byte % 4 + 1, F.lit(1)))

        def made(k: Column) -> Column:
            if kind == "secret":
                return self.characters(value, k)
            count = F.lit({"given": 4, "domain": 4}.get(kind, 6)) + F.least(k, F.lit(20))
            return let(self.hex(kind, value, k), lambda h: F.array_join(F.transform(F.sequence(F.lit(0), count - 1), lambda i: syllable(h, i)), ""))

        return let(self.attempt(kind, value) if attempt is None else attempt, made)

    def characters(self, old: Column, k: Column) -> Column:
        known = F.regexp_extract(old, rf"^(?:{KNOWN_SECRET})", 0)
        size = F.length(old) - F.length(known) + F.greatest(F.lit(0), k - 2)
        blocks = F.sequence(F.lit(0), F.floor(size / 32).cast("int"))
        hexed = F.array_join(F.transform(blocks, lambda i: self.hex("secret", old, k, i)), "")
        mixed = F.regexp_replace(F.array_join(F.transform(blocks, lambda i: F.base64(F.unhex(self.hex("secret", old, k, i)))), ""), "[+/=]", "x")
        rest = F.substring(old, F.length(known) + 1, F.length(old))
        chars = F.when(rest.rlike("^[0-9a-f]+$"), hexed).when(rest.rlike("^[0-9A-F]+$"), F.upper(hexed)).when(rest.rlike("^[0-9A-Z]+$"), F.upper(mixed)).otherwise(mixed)
        made = F.concat(known, F.substring(chars, F.lit(1), size))
        # signs such as the dots of a web token stay in their places
        at = lambda x, i: F.substring(x, i, F.lit(1))
        signs = let(made, lambda m: F.array_join(F.transform(F.sequence(F.lit(1), F.length(m)), lambda i: F.when(at(old, i).rlike("[^A-Za-z0-9_+/-]"), at(old, i)).otherwise(at(m, i))), ""))
        return F.when(rest.rlike("[^A-Za-z0-9_+/-]") & rest.rlike("[A-Za-z0-9]"), signs).otherwise(made)


def check_digit(payload: Column) -> Column:
    """The Luhn digit (int) that follows a digit string."""

    def add(total: Column, i: Column) -> Column:
        d = F.substring(payload, F.length(payload) - i + 1, F.lit(1)).try_cast("int")
        return total + F.when(i % 2 == 1, 2 * d - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    return F.pmod(-F.aggregate(F.sequence(F.lit(1), F.length(payload)), F.lit(0), add), F.lit(10))


def iban_check(country: Column, rest: Column) -> Column:
    """The right check number (2 to 98) of an IBAN."""
    line = F.concat(rest, country, F.lit("00"))

    def add(total: Column, i: Column) -> Column:
        c = F.substring(line, i, F.lit(1))
        return F.when(c.rlike("[0-9]"), F.pmod(total * 10 + c.try_cast("int"), F.lit(97))).otherwise(F.pmod(total * 100 + F.ascii(c) - 55, F.lit(97)))

    return 98 - F.aggregate(F.sequence(F.lit(1), F.length(line)), F.lit(0), add)


def refilled(old: Column, digits: Column) -> Column:
    """old with its digits replaced by others, in order."""
    before = lambda i: F.length(F.regexp_replace(F.substring(old, F.lit(1), i), "[^0-9]", ""))
    char = lambda i: F.substring(old, i, F.lit(1))
    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(old)), lambda i: F.when(char(i).rlike("[0-9]"), F.substring(digits, before(i), F.lit(1))).otherwise(char(i))), "")


def words_in(kind: Column, entity: Column) -> Column:
    """array<struct<kind, word>>: the keyed words that the surrogate of an entity needs; empty for permuted kinds."""
    pair = lambda k, w: F.struct(F.lit(k).alias("kind"), w.alias("word"))
    mail, parts = F.lower(entity), F.split(normal(kind, entity), " ")
    names = F.concat(
        F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0))), lambda w: pair("given", F.concat(gender(F.get(parts, F.lit(0))), F.lower(w)))),
        F.array(pair("family", F.lower(F.element_at(parts, -1)))),
    )
    none = F.array().cast("array<struct<kind:string,word:string>>")
    return F.when(kind == "email", F.array(pair("mail", mail), pair("domain", F.substring_index(mail, "@", -1)))).when(kind == "name", names).when(kind == "secret", F.array(pair("secret", entity))).otherwise(none)


def scripted(latin: Column, old: Column) -> Column:
    """A Latin word in the script of an old one."""
    alike = _CONSONANTS + _VOWELS
    there = lambda letters: F.translate(latin, alike + alike.upper(), letters + letters.upper())
    return F.when(old.rlike(r"\p{IsCyrillic}"), there(_CYRILLIC)).when(old.rlike(r"\p{IsGreek}"), there(_GREEK)).otherwise(latin)


def surrogate(entity: Column, keyed: Keyed) -> Column:
    """The replacement of a detected entity."""
    only = F.regexp_replace(entity, "[^0-9]", "")

    def card(old: Column) -> Column:
        n = F.length(old)
        payload = F.concat(F.substring(old, 1, 1), keyed.digits("card", F.substring(old, F.lit(2), n - 2)))
        return refilled(entity, let(payload, lambda p: F.concat(p, F.pmod(check_digit(p) + F.substring(old, n, F.lit(1)).try_cast("int") - check_digit(F.substring(old, F.lit(1), n - 1)), F.lit(10)).cast("string"))))

    def phone(old: Column) -> Column:
        return refilled(entity, keyed.last_digits("phone", old, F.when(F.length(old) < 10, 6).otherwise(9)))

    def iban(old: Column) -> Column:
        country, check, rest = F.substring(old, 1, 2), F.substring(old, 3, 2).try_cast("int"), F.substring(old, F.lit(5), F.length(old))
        numbers = F.regexp_replace(rest, "[^0-9]", "")
        fresh = F.when(F.length(numbers) >= 2, refilled(rest, keyed.last_digits("iban", numbers, F.least(F.length(numbers), F.lit(12))))).otherwise(rest)
        made = let(fresh, lambda f: F.concat(country, F.lpad((F.pmod(iban_check(country, f) + check - iban_check(country, rest) - 2, F.lit(97)) + 2).cast("string"), 2, "0"), f))
        # spaces stand where they stood, and letters are as large
        sized = let(made, lambda m: F.when(entity.rlike("[a-z]"), F.lower(m)).otherwise(m))
        return let(sized, lambda m: F.when(entity.contains(" "), F.regexp_replace(m, "(.{4})(?=.)", "$1 ")).otherwise(m))

    def address(octets: Column) -> Column:
        byte = lambda i: F.get(octets, F.lit(i)).try_cast("int")
        two = byte(0).isin(172, 192, 169)
        long = keyed.permuted("ip", byte(1) * 16 + F.floor(byte(2) / 16), (byte(2) % 16) * 256 + byte(3), F.lit(4096), F.lit(4096))
        short = keyed.permuted("ip2", byte(2), byte(3), F.lit(256), F.lit(256))
        whole = let(long, lambda p: F.concat_ws(".", byte(0), F.floor(p["a"] / 16), (p["a"] % 16) * 16 + F.floor(p["b"] / 256), p["b"] % 256))
        return F.when(two, let(short, lambda p: F.concat_ws(".", byte(0), byte(1), p["a"], p["b"]))).otherwise(whole)

    def ipv6(old: Column) -> Column:
        """Groups are written out in full; the first two stay."""
        left, right = F.split(F.substring_index(old, "::", 1), ":"), F.split(F.when(old.contains("::"), F.substring_index(old, "::", -1)).otherwise(""), ":")
        groups = F.when(old.contains("::"), F.concat(left, F.array_repeat(F.lit("0"), 8 - F.size(left) - F.size(right)), right)).otherwise(left)

        def made(g: Column) -> Column:
            first = F.when(F.get(g, F.lit(0)) == "", "0").otherwise(F.get(g, F.lit(0)))  # of ::1
            half = lambda a, b, c: F.conv(F.concat(*[F.lpad(F.get(g, F.lit(i)), 4, "0") for i in (a, b, c)]), 16, 10).cast("long")
            pair = keyed.permuted("ipv6", half(2, 3, 4), half(5, 6, 7), F.lit(1 << 48), F.lit(1 << 48))
            text = let(pair, lambda p: F.lower(F.concat(F.lpad(F.hex(p["a"]), 12, "0"), F.lpad(F.hex(p["b"]), 12, "0"))))
            return let(text, lambda t: F.concat_ws(":", first, F.get(g, F.lit(1)), *[F.substring(t, 4 * i + 1, 4) for i in range(6)]))

        return let(groups, made)

    def email(old: Column) -> Column:
        local, domain = F.substring_index(old, "@", 1), F.substring_index(old, "@", -1)
        tail = F.regexp_extract(local, r"([._-]?[0-9]+)$", 1)
        digits = F.substring(F.regexp_replace(keyed.hex("email digits", old), "[a-f]", ""), 1, 18)
        return F.concat(keyed.word("mail", old), F.when(tail == "", "").otherwise(refilled(tail, F.rpad(digits, 64, "0"))), F.lit("@"), keyed.word("domain", domain), F.lit(".example."), F.substring_index(domain, ".", -1))

    def name(parts: Column) -> Column:
        of = gender(F.regexp_replace(F.get(parts, F.lit(0)), r"\.$", ""))
        n = F.size(parts)
        given = lambda w: scripted(F.initcap(F.concat(keyed.word("given", F.concat(of, F.lower(w))), ending(of))), w)
        every = F.transform(parts, lambda w, i: F.when(i == 0, w).when(i == n - 1, scripted(F.initcap(keyed.word("family", F.lower(w))), w)).otherwise(given(w)))
        return F.array_join(every, " ")

    def of_kind(k: Column) -> Column:
        made = F.when(k == "card", let(only, card)).when(k == "phone", let(only, phone)).when(k == "ssn", let(only, lambda o: refilled(entity, keyed.digits("ssn", o))))
        made = made.when(k == "ip", let(F.split(entity, r"\."), address)).when(k == "ipv6", let(F.lower(entity), ipv6)).when(k == "iban", let(F.upper(F.replace(entity, F.lit(" "), F.lit(""))), iban))
        return made.when(k == "email", let(F.lower(entity), email)).when(k == "name", let(F.split(entity, " "), name)).when(k == "none", entity).otherwise(keyed.word("secret", entity))

    return let(kind_of(entity), of_kind)


def _any_of(text: Column, parts: list[str]) -> Column:
    """Whether a text holds any of some strings: many times quicker than a pattern."""
    found = text.contains(parts[0])
    for p in parts[1:]:
        found = found | text.contains(p)
    return found


def may_name(text: Column) -> Column:
    return _any_of(text, _ANY_TITLE.split("|")) & text.rlike(rf"(?=[{_FIRST}])(?:{_ANY_TITLE})[. ]")


def pattern_of(text: Column) -> Column:
    """What to look for in a text: the patterns of the kinds that it may hold, in their order; empty if none. Most texts are told by their characters."""

    def of(digit: Column) -> Column:
        signed = text.contains("=") | text.contains(":")
        needs = {
            "secret": signed & _any_of(F.lower(text), ["token", "secret", "passw", "pwd", "key"]), "email": text.contains("@"), "known": _any_of(text, KNOWN_SECRET.replace("[abprs]-", "").split("|")),
            "iban": digit & text.rlike("[A-Z]{2}[0-9]{2}"), "ipv6": digit & (text.contains("::") | text.rlike("[0-9a-fA-F]:[0-9a-fA-F]{1,4}:")),
            "ip": digit & text.rlike(r"[0-9]\.[0-9]"), "card": digit & text.rlike("[0-9]{4}"), "ssn": digit & text.rlike("-[0-9]{2}-"), "phone": digit, "name": may_name(text),
        }
        return F.concat_ws("|", *[F.when(needs[kind], F.lit(f"(?:{p})")) for kind, p in PATTERNS.items()])

    return let(text.rlike("[0-9]"), of)


def titled(text: Column) -> Column:
    """array<string>: the titled names of a text."""
    return F.regexp_extract_all(text, F.lit(PATTERNS["name"]), F.lit(0))


def parts_of(names: Column) -> Column:
    """array<struct<word, of>>: the words of names without their titles, each with the first name that holds it, longest words first."""
    words = F.flatten(F.transform(names, lambda e: F.transform(F.slice(F.split(e, " "), 2, 9), lambda w: F.struct(F.length(w).alias("n"), w.alias("word")))))
    return F.array_sort(F.array_distinct(words), lambda a, b: F.when(a["n"] > b["n"], -1).when(a["n"] < b["n"], 1).when(a["word"] < b["word"], -1).when(a["word"] > b["word"], 1).otherwise(0))


def with_names(pattern: Column, text: Column) -> Column:
    """The pattern, and the bare words of the text's titled names, one or several in a row."""

    def added(names: Column) -> Column:
        one = F.concat(F.lit("(?:"), F.array_join(F.transform(parts_of(names), lambda p: p["word"]), "|"), F.lit(")"))
        return let(one, lambda o: F.concat(pattern, F.lit(r"|(?<![\p{L}\p{N}'-])"), o, F.lit("(?: "), o, F.lit(r")*(?![\p{L}\p{N}])")))

    named = F.when((pattern != "") & may_name(text), titled(text))
    return let(named, lambda names: F.when(F.size(names) > 0, added(names)).otherwise(pattern))


def entities(text: Column, pattern: Column) -> Column:
    """array<string>: what is detected in a text, in order."""
    return F.when(pattern != "", F.regexp_extract_all(text, pattern, F.lit(0))).when(text.isNotNull(), F.array().cast("array<string>"))


def detected(text: Column) -> Column:
    """array<string>: the entities of a text without bare mentions of names."""
    return let(pattern_of(text), lambda p: entities(text, p))


def ending(gender: Column) -> Column:
    """What given names end with."""
    return F.when(gender == "m", "n").when(gender == "f", "na").otherwise("s")


def written_form(kind: Column, word: Column, new: Column) -> Column:
    """What a word's surrogate (as ``made`` gives it) looks like in a text, in lower case: with its ending, in its script, with its domain."""
    given = scripted(F.concat(F.substring(new, F.lit(2), F.length(new)), ending(F.substring(word, 1, 1))), F.substring(word, F.lit(2), F.length(word)))
    domain = F.concat(new, F.lit(".example."), F.substring_index(word, ".", -1))
    return F.when(kind == "given", given).when(kind == "family", scripted(new, word)).when(kind == "domain", domain).otherwise(new)


def real_words(docs: DataFrame, words: DataFrame) -> DataFrame:
    """kind, form: what stands in the corpus that looks like a surrogate: capitalized words for names, whether they are detected as such or not, local parts and domains of addresses, secrets."""
    text = F.col("text").cast("string")
    capital = docs.where(text.isNotNull()).select(F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?<![\p{L}'-])\p{Lu}[\p{L}'-]+"), F.lit(0)))).alias("form"))
    capital = capital.select(F.lower("form").alias("form")).where(F.col("form").rlike(FORM)).distinct()
    names = capital.select(F.explode(F.array(F.lit("given"), F.lit("family"))).alias("kind"), "form")
    local = F.regexp_replace(F.substring_index("word", "@", 1), "[._-]?[0-9]+$", "")
    others = words.where(F.col("kind").isin("mail", "domain", "secret")).select("kind", F.when(F.col("kind") == "mail", local).otherwise(F.col("word")).alias("form"))
    return names.union(others).distinct()


def moved_words(docs: DataFrame, key: str) -> DataFrame:
    """word (kind|word), attempt of the words that cannot have the surrogate of attempt 0; a written table."""
    keyed = Keyed(key)
    found = docs.select(F.explode(detected(F.col("text").cast("string"))).alias("entity")).withColumn("kind", kind_of(F.col("entity")))
    words = found.select(F.explode(words_in(F.col("kind"), F.col("entity"))).alias("w")).select("w.kind", "w.word").distinct()
    
    def made(k: Column) -> Column:
        out = F.lit(None).cast("string")
        for kind in WORDS:
            # given names of each gender have endings of their own
            mark = F.substring("word", 1, 1) if kind == "given" else F.lit("")
            out = F.when(F.col("kind") == kind, F.concat(mark, keyed.word(kind, F.col("word"), k))).otherwise(out)
        return out

    settled = written(words.select("kind", "word", F.lit(0).alias("attempt"), made(F.lit(0)).alias("new")), "words")
    real = written(real_words(docs, settled), "real")
    attempt = 0
    while True:
        # of those with one surrogate the first stays; all go whose surrogate is a word of the corpus
        first = F.struct("attempt", F.xxhash64("word"), "word")
        ranks = settled.groupBy("kind", "new").agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("n"))
        bad = settled.join(ranks.where("n > 1"), ["kind", "new"]).where("word <> first.word").select("kind", "word")
        taken = settled.withColumn("form", written_form(F.col("kind"), F.col("word"), F.col("new"))).join(real, ["kind", "form"], "left_semi").select("kind", "word")
        bad = written(bad.unionByName(taken).distinct(), "bad")
        if bad.isEmpty():
            spent(bad)
            break
        attempt += 1
        again = bad.select("kind", "word", F.lit(attempt).alias("attempt"), made(F.lit(attempt)).alias("new"))
        after = written(settled.join(bad, ["kind", "word"], "left_anti").unionByName(again), "words")
        spent(settled, bad)
        settled = after
    moved = written(settled.where("attempt > 0").select(F.concat_ws("|", "kind", "word").alias("word"), "attempt"), "moved")
    spent(settled, real)
    return moved


def _looked_up(docs: DataFrame, moved: DataFrame, name: str) -> DataFrame:
    """docs with a column name: a map of the moved words that a text holds (or of all, if few) to their attempts, NULL if none."""
    count = moved.limit(FEW + 1).count()
    if not count:
        return docs.withColumn(name, F.lit(None).cast("map<string,int>"))
    if count <= FEW:
        # one row of at most FEW entries
        return docs.crossJoin(F.broadcast(moved.agg(F.map_from_entries(F.collect_list(F.struct("word", "attempt"))).alias(name))))
    keyed = written(docs.withColumn(name, F.expr("uuid()")), "documents")
    text = F.col("text").cast("string")
    held = keyed.select(name, F.explode(detected(text)).alias("entity")).select(name, F.explode(words_in(kind_of(F.col("entity")), F.col("entity"))).alias("w"))
    held = held.select(name, F.concat_ws("|", "w.kind", "w.word").alias("word")).distinct().join(moved, "word")
    maps = held.groupBy(name).agg(F.map_from_entries(F.collect_list(F.struct("word", "attempt"))).alias("m"))
    return keyed.join(maps, name, "left").drop(name).withColumnRenamed("m", name) if "m" not in docs.columns else keyed.join(maps.withColumnRenamed("m", name + "m"), name, "left").drop(name).withColumnRenamed(name + "m", name)


def key_of(spark: SparkSession) -> str:
    """The key of the setting, else a fresh one."""
    return spark.conf.get("spark.hopgauge.surrogate.key", None) or secrets.token_hex(32)


def replace_entities(docs: DataFrame, key: str) -> DataFrame:
    """docs with surrogates in text, and n_entities (0 for null texts). key: not empty, and secret."""
    if not key:
        raise ValueError("surrogates need a key")
    long = "_" * max(len(c) for c in docs.columns)
    name, lookup = "_of_text" + long, "_moved" + long
    columns = docs.columns
    docs = _looked_up(docs, moved_words(docs, key), lookup)
    keyed, text = Keyed(key, F.col(f"`{lookup}`")), F.col("text").cast("string")

    def renewed(found: Column, names: Column) -> Column:
        """Surrogates; a bare mention gets the parts of its titled name's."""
        fresh_names = F.transform(names, lambda e: F.struct(F.split(e, " ").alias("old"), F.split(surrogate(e, keyed), " ").alias("new")))

        def bare(e: Column, known: Column) -> Column:
            def part(w: Column) -> Column:
                holder = F.get(F.filter(known, lambda x: F.array_contains(F.slice(x["old"], 2, 9), w)), F.lit(0))
                return F.coalesce(F.get(F.slice(holder["new"], 2, 9), (F.array_position(F.slice(holder["old"], 2, 9), w) - 1).cast("int")), w)

            return F.array_join(F.transform(F.split(e, " "), part), " ")

        def each(known: Column) -> Column:
            words = F.flatten(F.transform(known, lambda x: F.slice(x["old"], 2, 9)))
            return F.transform(found, lambda e: F.when((F.size(known) > 0) & F.forall(F.split(e, " "), lambda w: F.array_contains(words, w)), bare(e, known)).otherwise(surrogate(e, keyed)))

        return let(fresh_names, each)

    def merged(found: Column, pattern: Column) -> Column:
        return F.array_join(F.flatten(F.zip_with(F.split(text, pattern, -1), renewed(found, titled(text)), lambda gap, new: F.array(gap, F.coalesce(new, F.lit(""))))), "")

    def made(pattern: Column) -> Column:
        def of(found: Column) -> Column:
            real = F.size(F.filter(found, lambda e: ~(e.rlike("^[0-9]{13,19}$|^[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}$") & (kind_of(e) == "none"))))
            return F.struct(F.when(F.size(found) > 0, merged(found, pattern)).otherwise(text).alias("text"), F.coalesce(real, F.lit(0)).cast("long").alias("n_entities"))

        return let(entities(text, pattern), of)

    # a column of one struct: the detection runs once for both fields
    new = let(let(pattern_of(text), lambda p: with_names(p, text)), made)
    others = [F.col(f"`{c}`") if c != "text" else F.col(f"`{name}`.text").alias("text") for c in columns if c != "n_entities"]
    return docs.withColumn(name, new).select(*others, F.when(text.isNull(), 0).otherwise(F.col(f"`{name}`.n_entities")).cast("long").alias("n_entities"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_entities(table(spark, sf_dir, "documents"), key_of(spark))
