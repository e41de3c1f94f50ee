"""Surrogates for personal data: keyed, type-consistent, distinct and the same wherever the entity is named."""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Mapping, Sequence
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clipwright.llm.common import cut, identity, let

# Common given names by script and gender.
GIVEN = {
    ("latin", "f"): "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Jane Anna Emma Sophie Marie Julia Laura Claire Camille Carmen Lucía Ingrid Katharina Giulia Olivia Fatima Aisha Priya Mei Yuki".split(),
    ("latin", "m"): "James John Robert Michael William David Richard Joseph Thomas Charles Paul Peter Stefan Hans Pierre Jacques Carlos Javier Miguel Giovanni Henrik Andreas Antoine Oliver Ahmed Mohammed Omar Raj Wei Hiroshi".split(),
    ("cyrillic", "f"): "Анна Мария Елена Ольга Наталья Екатерина Татьяна Ирина Светлана Людмила".split(),
    ("cyrillic", "m"): "Иван Сергей Дмитрий Алексей Николай Владимир Андрей Михаил Павел Борис".split(),
    ("greek", "f"): "Μαρία Ελένη Κατερίνα Βασιλική Σοφία Αγγελική Γεωργία Δήμητρα".split(),
    ("greek", "m"): "Γιώργος Δημήτρης Κώστας Γιάννης Νίκος Παναγιώτης Χρήστος Βασίλης".split(),
}
# Forms of address, words that announce a name, and words between given name and surname.
TITLES = "Mr Mrs Ms Miss Mx Dr Prof Professor Sir Lady Herr Frau Monsieur Madame Mme Mlle Señor Señora Sr Sra Don Doña Signor Signora Господин Госпожа Κύριος Κυρία".split()
CUES = "my name is|My name is|name:|Name:|signed by|Signed by|ich heiße|Ich heiße|mein Name ist|Mein Name ist|je m'appelle|Je m'appelle|me llamo|Me llamo|mi chiamo|Mi chiamo|меня зовут|Меня зовут|με λένε|Με λένε".split("|")
PARTICLES = "von van de der den del della di da dos la le bin ibn al el ter zu".split()
# Chinese surnames, signs of given names, and what follows a name.
HAN_SURNAMES = "王李张刘陈杨赵黄周吴徐孙朱马胡林郭何高罗"
HAN_GIVEN = "明华丽强军敏静伟芳娜秀英杰涛勇艳超平刚桂兰玉建国文斌宇浩凯欣怡佳雪梅"
HAN_TITLES = "先生 女士 小姐 太太 老师 教授 博士 医生".split()
# Signs that stand in for signs of the same kind.
ALPHABETS = ("0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ", "àâçèéêëîïôùûäöüñóíáú", "ÀÂÇÈÉÊËÎÏÔÙÛÄÖÜÑÓÍÁÚ",
             "аеиоуыэюя", "бвгджзйклмнпрстфхцчшщьъё", "АЕИОУЫЭЮЯ", "БВГДЖЗЙКЛМНПРСТФХЦЧШЩ", "αεηιουωάέήίόύώ", "βγδζθκλμνξπρσςτφχψ", "ΑΕΗΙΟΥΩ", "ΒΓΔΖΘΚΛΜΝΞΠΡΣΤΦΧΨ",
             HAN_SURNAMES, HAN_GIVEN)
HEX = ("0123456789abcdef", "ABCDEF")
# Further signs of given names, by which a name that stands alone is told.
HAN_MORE = "小晓红志春东云龙鹏慧琳莉俊鑫磊婷丹辉峰"
# The ranges that hold the letters of scripts, and signs of ordinary words that no name is made of.
SCRIPTS = {
    "Latin": (0x41, 0x24F), "Greek": (0x391, 0x3C9), "Cyrillic": (0x410, 0x44F), "Armenian": (0x531, 0x586), "Hebrew": (0x5D0, 0x5EA), "Arabic": (0x626, 0x63A), "Devanagari": (0x904, 0x939),
    "Bengali": (0x985, 0x9B9), "Thai": (0xE01, 0xE2E), "Georgian": (0x10D0, 0x10F0), "Hiragana": (0x3042, 0x3093), "Katakana": (0x30A2, 0x30F3), "Hangul": (0xAC00, 0xAC00 + 28 * 12),
}
HAN_WORDS = "马上 高兴 黄金 周末 高明 王国 李子 周到 林立 马力 高强 高山 黄河 高飞 林海 张开 陈年 杨柳 何必 何时 何人 罗马".split()
#: After so many attempts a surrogate gets longer, and after so many rounds of them settling gives up.
WIDE, MOST_ROUNDS = 8, 64


@cache
def script_letters() -> list[tuple[str, str]]:
    """For each script a pattern of its letters, upper and lower case apart, and letters to put in their place: those without marks of their own, as far as the script has such."""
    out = []
    for script, (first, last) in SCRIPTS.items():
        letters = [chr(c) for c in range(first, last + 1) if unicodedata.category(chr(c))[0] == "L" and not unicodedata.decomposition(chr(c)) or script == "Hangul"]
        letters = [c for c in letters if script in ("Hangul", "Hiragana", "Katakana") or script.upper() in unicodedata.name(c, "")]
        upper = "".join(c for c in letters if c.isupper() and len(c.lower()) == 1)[:26]
        lower = "".join(c for c in letters if not c.isupper())[-26:] if script != "Latin" else "bcdfghjklmnprstvwz"
        if upper:
            out.append((rf"^[\p{{Is{script}}}&&[\p{{Lu}}\p{{Lt}}]]$", upper))
        out.append((rf"^[\p{{Is{script}}}&&\p{{L}}]$", lower))
    return [*out, (r"^\p{IsHan}$", HAN_GIVEN), (r"^[\p{Lu}\p{Lt}]$", "BCDFGHJKLMNPRSTVWZ"), (r"^\p{L}$", "bcdfghjklmnprstvwz")]

Names = Mapping[tuple[str, str], Sequence[str]]

_START, _END = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
_WORD = r"\p{Lu}(?:\p{L}|['’-](?=\p{Lu}))++"
_BETWEEN = rf"(?:{'|'.join(PARTICLES)})"
_H = "[0-9A-Fa-f]{1,4}"
_TITLE = rf"(?:{'|'.join(TITLES)})"


def name_pattern(names: Names = GIVEN) -> str:
    """A person: one or two names after titles, a known given name before a surname, or two or three names after words that announce them; and Chinese names that stand alone or before a title."""
    given = "|".join(sorted({n for group in names.values() for n in group}, key=lambda n: (-len(n), n))) or r"\b\B"
    full = rf"(?:{given}) (?:(?:(?:{given})|\p{{Lu}}\.|{_BETWEEN}) ){{0,3}}{_WORD}{_END}"
    return "|".join(
        [
            rf"(?=\p{{Lu}})(?:{_TITLE}\b\.? ){{1,3}}(?:{full}|(?:{_BETWEEN} ){{0,2}}{_WORD}(?: (?:{_BETWEEN} ){{0,2}}{_WORD})?{_END})",
            rf"(?=\p{{Lu}}){full}",
            rf"(?=\p{{Lu}})(?<=(?:{'|'.join(CUES)}) ){_WORD}(?: {_WORD}){{1,2}}{_END}",
            rf"[{HAN_SURNAMES}]\p{{IsHan}}{{0,2}}(?=(?:{'|'.join(HAN_TITLES)}))",
            rf"(?!(?:{'|'.join(HAN_WORDS)}))[{HAN_SURNAMES}][{HAN_GIVEN}{HAN_MORE}]{{1,2}}{_END}",
            rf"(?<=(?:姓名|名字)[：:] {{0,1}})[{HAN_SURNAMES}]\p{{IsHan}}{{1,2}}{_END}",
        ]
    )


def pattern(names: Names = GIVEN, surnames_too: bool = False) -> str:
    """What may be personal data. Every kind begins where no word goes on, which is looked up once; what comes first then rules out most kinds.

    With `surnames_too`, any capitalised word is looked at besides. All repetitions are possessive or bounded.
    """
    kinds = [
        rf"(?=A)AKIA[0-9A-Z]{{16}}{_END}",
        r"(?=[ps])(?:password|passwd|pwd|secret)=[^\s\"']{6,}+",
        r"(?=[0-9a-f])[0-9a-f]{32,64}" + _END,
        rf"(?=[A-Z]{{2}}\d\d)[A-Z]{{2}}\d\d(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?{_END}",
        rf"(?={_H}:)(?:(?:{_H}:){{7}}{_H}|(?:{_H}:){{1,6}}(?::{_H}){{1,6}}|(?:{_H}:){{1,7}}:)(?![\p{{L}}\p{{N}}_:])",
        r"(?=\d)(?<!\.)\d{1,3}(?:\.\d{1,3}){3}(?![\p{L}\p{N}_]|\.\d)",
        rf"(?=\d)\d{{3}}-\d{{2}}-\d{{4}}{_END}",
        r"(?=[+(\d])(?<![.+-])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]\d{3,4}(?![\p{L}\p{N}_-])",
        rf"(?=\d)\d(?:[ -]?\d){{12,18}}{_END}",
        r"(?=[A-Za-z0-9._%+-])(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9-])",
        name_pattern(names),
    ]
    if surnames_too:
        kinds.append(rf"{_WORD}{_END}")
    return _START + "(?:" + "|".join(kinds) + ")"


PATTERN = pattern()


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """The checksum of a string of digits; a valid number has one that ten divides."""
    each = F.transform(F.reverse(F.split(digits, "")), lambda c, i: c.cast("int") * (1 + i % 2))
    return F.aggregate(each, F.lit(0), lambda a, v: a + F.when(v > 9, v - 9).otherwise(v))


def _mod97(iban: Column) -> Column:
    """An IBAN without spaces as a number, modulo 97; a valid one gives 1."""
    turned = F.concat(F.substring(iban, 5, 40), F.substring(iban, 1, 4))
    value = lambda c: F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: (a * F.when(value(c) > 9, 100).otherwise(10) + value(c)) % 97)


def entity_type(mention: Column) -> Column:
    """What a match of `pattern` is; null if nothing after all (an octet above 255, a wrong check digit, a clock time)."""
    octets = F.split(mention, "\\.")
    groups = F.filter(F.split(mention, ":"), lambda g: g != "")
    six = (F.size(groups) == 8) & ~mention.contains("::") | (F.size(groups) >= 3) & (F.size(groups) < 8) & mention.contains("::")
    # nine digits by threes are a number
    dialled = (F.length(_digits(mention)) >= 8) & ~mention.rlike(r"^\d{1,3}([ .])\d{3}\1\d{3}$")
    return (
        F.when(mention.rlike("^AKIA[0-9A-Z]{16}$"), "key")
        .when(mention.rlike("^(?:password|passwd|pwd|secret)="), "secret")
        .when(mention.contains("@"), "email")
        .when(mention.rlike("^[0-9a-f]{32,64}$"), "hex")
        .when(mention.rlike("^[A-Z]{2}\\d\\d[ A-Z0-9]{8,}$"), F.when(_mod97(F.replace(mention, F.lit(" "), F.lit(""))) == 1, "iban"))
        .when(mention.rlike("^[0-9A-Fa-f:]+$") & mention.contains(":"), F.when(six & mention.rlike("[0-9]"), "ipv6"))
        .when(mention.rlike(r"^\d{1,3}(?:\.\d{1,3}){3}$"), F.when(F.forall(octets, lambda o: o.cast("int") <= 255), "ip"))
        .when(mention.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when(mention.rlike(r"^\d(?:[ -]?\d){12,18}$"), F.when(_luhn(_digits(mention)) % 10 == 0, "card"))
        .when(mention.rlike(r"^[+(\d]"), F.when(dialled, "phone"))
        .when(mention.rlike(r"^\p{IsHan}"), "han")
        .otherwise("person")
    )


def person_parts(mention: Column) -> Column:
    """The words of a mention of a person, in order, as structs (kind, value); kind is `given`, `surname` or, for titles, initials and words between, null.

    Of several names the last is the surname and the others are given names; of one name after a title, it is the surname.
    """
    word = F.split(mention, " ")
    last = F.size(word) - 1
    kind = lambda w, i: F.when(i == last, "surname").when(~(w.rlike(rf"^{_TITLE}\.?$") | w.isin(*PARTICLES) | w.rlike(r"^\p{Lu}\.$")), "given")
    return F.transform(word, lambda w, i: F.struct(kind(w, i).alias("kind"), w.alias("value")))


def values(kind: Column, mention: Column) -> Column:
    """What a mention refers to, as structs (kind, value) that all mentions of the same thing share; a kind of null stands for a word that isn't replaced."""
    return F.when(kind == "person", person_parts(mention)).otherwise(F.array(F.struct(kind.alias("kind"), canonical(kind, mention).alias("value"))))


def canonical(kind: Column, mention: Column) -> Column:
    """The form that mentions of one entity share, for kinds other than persons. A phone number goes without its country."""
    return (
        F.when(kind == "email", F.lower(mention))
        .when(kind.isin("ssn", "card"), _digits(mention))
        .when(kind == "phone", F.right(_digits(mention), F.lit(10)))
        .when(kind == "secret", F.regexp_replace(mention, "^[a-z]+=", ""))
        .when(kind == "iban", F.replace(mention, F.lit(" "), F.lit("")))
        .when(kind == "ipv6", F.lower(mention))
        .otherwise(mention)
    )


def _stream(key: str, kind: Column | str, value: Column, attempt: Column) -> Column:
    """Blocks of 128 hex digits, without end in sight: four digits for each character of `value`."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    last = F.floor(F.length(value) / 32).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda b: F.sha2(F.concat_ws("\x1f", F.lit(key), kind, value, attempt.cast("string"), b.cast("string")), 512))


def _number(stream: Column, i: Column) -> Column:
    block = F.element_at(stream, F.floor(i / 32).cast("int") + 1)
    return F.conv(F.substring(block, i % 32 * 4 + 1, F.lit(4)), 16, 10).cast("int")


def _alike(value: Column, stream: Column, alphabets: Sequence[str] = ALPHABETS) -> Column:
    """Each sign replaced by one of its alphabet, or a letter without one by one of its script; others stay. `stream` is looked up for each sign: it has to be at hand."""

    def one(c: Column, r: Column) -> Column:
        out = F.when(F.lit(False), c)
        for letters in alphabets:
            out = out.when(F.instr(F.lit(letters), c) > 0, F.substring(F.lit(letters), r % len(letters) + 1, F.lit(1)))
        # letters that no alphabet lists go by their script and case
        other = F.when(F.lit(False), c)
        for letters, put in script_letters():
            other = other.when(c.rlike(letters), F.substring(F.lit(put), r % len(put) + 1, F.lit(1)))
        return out.when(c.rlike(r"^\p{L}$"), other).otherwise(c)

    return F.array_join(F.transform(F.split(value, ""), lambda c, i: let(_number(stream, i), lambda r: one(c, r))), "")


def given_surrogates(key: str, names: Names = GIVEN) -> dict[str, str]:
    """For each known given name another of its script and gender: each list is put into an order that `key` decides, and each name gives way to the next."""
    put: dict[str, str] = {}
    for group in names.values():
        ranked = sorted(dict.fromkeys(group), key=lambda n: hashlib.sha256(f"{key}|{n}".encode()).digest())
        for name, other in zip(ranked, ranked[1:] + ranked[:1]):
            put.setdefault(name, other)
    return put


def surrogate(key: str, kind: Column, value: Column, attempt: Column, names: Names = GIVEN) -> Column:
    """The replacement of a canonical value. From the eighth attempt on it may be longer, so there is always another."""
    given = F.struct(kind.alias("kind"), value.alias("value"), attempt.alias("attempt"), _stream(key, kind, value, attempt).alias("stream"))
    return let(given, lambda e: _surrogate(key, e["kind"], e["value"], e["attempt"], e["stream"], names))


def _surrogate(key: str, kind: Column, value: Column, attempt: Column, stream: Column, names: Names) -> Column:
    wide = attempt >= WIDE
    extra = F.greatest(attempt - WIDE + 1, F.lit(0))
    more = F.when(wide, F.substring(stream[0], F.lit(1), extra)).otherwise("")
    # names get longer by letters of their own script, behind the last one
    longer = F.concat(value, F.repeat(F.lower(F.right(value, F.lit(1))), extra))
    n = F.length(value)

    local, domain = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    site = F.regexp_replace(domain, r"\.[a-z]+$", "")
    email = F.concat(_alike(local, stream), more, F.lit("@"), let(_stream(key, "site", domain, F.lit(0)), lambda st: _alike(site, st)), F.regexp_extract(domain, r"\.[a-z]+$", 0))

    def octet(o: Column, i: Column) -> Column:
        r = _number(stream, i)
        # an address keeps its octets' lengths at first, and is any address when these are taken
        return F.when(wide, r % 256).when(F.length(o) == 3, 100 + r % 156).when(F.length(o) == 2, 10 + r % 90).otherwise(r % 10).cast("string")

    ip = F.array_join(F.transform(F.split(value, "\\."), octet), ".")
    signs = F.split(value, "")

    def phone_digit(c: Column, i: Column) -> Column:
        r = _number(stream, i)
        return F.when(i == 0, (2 + r % 8).cast("string")).otherwise((r % 10).cast("string"))

    phone = F.array_join(F.transform(signs, phone_digit), "")
    body = F.array_join(F.transform(F.slice(signs, 1, F.greatest(n - 1, F.lit(1))), lambda c, i: F.when(i == 0, c).otherwise((_number(stream, i) % 10).cast("string"))), "")
    card = let(body, lambda b: F.concat(b, ((10 - _luhn(F.concat(b, F.lit("0"))) % 10) % 10).cast("string")))
    fixed = F.concat(F.substring(value, 1, 4), _alike(F.substring(value, 5, 64), stream))
    land = F.substring(value, 1, 2)
    checked = lambda account: F.concat(land, F.lpad((98 - _mod97(F.concat(land, F.lit("00"), account))).cast("string"), 2, "0"), account)
    iban = let(_alike(F.substring(value, 5, 40), stream), checked)

    put = given_surrogates(key, names)
    known = F.create_map(*[F.lit(x) for pair in put.items() for x in pair]) if put else F.create_map().cast("map<string,string>")
    given = F.coalesce(F.try_element_at(known, value), _alike(longer, stream))

    return (
        F.when(kind == "email", email)
        .when(kind == "ip", ip)
        .when(kind == "phone", phone)
        .when(kind == "card", card)
        .when(kind == "hex", _alike(value, stream, HEX))
        .when(kind == "ipv6", _alike(value, stream, HEX))
        .when(kind == "iban", iban)
        .when(kind == "key", fixed)
        .when(kind == "given", given)
        .when(kind == "surname", _alike(longer, stream))
        .when(kind == "han", F.concat(_alike(F.substring(value, 1, 1), stream, (HAN_SURNAMES,)), F.array_join(F.transform(F.slice(signs, 2, F.greatest(n - 1, F.lit(0))), lambda c, i: F.substring(F.lit(HAN_GIVEN), _number(stream, i + 1) % len(HAN_GIVEN) + 1, F.lit(1))), ""), F.when(wide, _alike(F.repeat(F.right(value, F.lit(1)), extra), F.transform(stream, lambda b: F.sha2(b, 512)), (HAN_SURNAMES + HAN_GIVEN,))).otherwise("")))
        .otherwise(F.concat(_alike(value, stream), F.when(kind == "ssn", F.lit("")).otherwise(more)))
    )


def _render(kind: Column, mention: Column, value: Column) -> Column:
    """The surrogate `value` in the form that the mention has: its separators, its prefix, its country, its capitals."""
    skip = F.when(kind == "phone", F.greatest(F.length(_digits(mention)) - F.length(value), F.lit(0))).otherwise(0)

    def put(state: Column, c: Column) -> Column:
        sign = c != " "
        taken = F.when(kind == "iban", sign).otherwise(c.rlike("[0-9]"))
        at = state["i"] - skip
        return F.struct(
            F.concat(state["out"], F.when(taken & (at >= 0), F.substring(value, at + 1, F.lit(1))).otherwise(c)).alias("out"),
            (state["i"] + taken.cast("int")).alias("i"),
        )

    spaced = F.aggregate(F.split(mention, ""), F.struct(F.lit("").alias("out"), F.lit(0).alias("i")), put)["out"]
    return (
        F.when(kind.isin("ssn", "card", "phone", "iban"), spaced)
        .when(kind == "secret", F.concat(F.regexp_extract(mention, "^[a-z]+=", 0), value))
        .when(kind.isin("email", "ipv6") & (mention == F.upper(mention)), F.upper(value))
        .otherwise(value)
    )


def settle(entities: DataFrame, key: str, names: Names = GIVEN) -> DataFrame:
    """A surrogate for each distinct (kind, value), unlike every other one and every real value of its kind.

    Values whose surrogate is taken try again with the next hash, those settled first keeping theirs. A known given name
    gives way to another known one, which may well be real too: it is the surname that tells a person from the real ones. Names,
    mail addresses, secrets and tokens get longer from attempt WIDE on, so there are always others. Of addresses, phone, card and social security
    numbers there are as many as their digits allow: where those run out, MOST_ROUNDS rounds end in an error, and nothing is let through unsettled.
    """
    fixed = F.array(*[F.lit(n) for group in names.values() for n in group]) if names else F.array().cast("array<string>")
    free = ~((F.col("kind") == "given") & F.array_contains(fixed, F.col("value")))
    now = cut(entities.select("kind", "value").distinct().withColumn("attempt", F.lit(0)).withColumn("free", free))
    for _ in range(MOST_ROUNDS):
        tried = now.withColumn("surrogate", surrogate(key, F.col("kind"), F.col("value"), F.col("attempt"), names))
        order = Window.partitionBy("kind", "surrogate").orderBy("free", "attempt", "value")
        real = now.select("kind", F.col("value").alias("surrogate"), F.lit(True).alias("real"))
        ranked = tried.withColumn("again", F.row_number().over(order) > 1).join(real, ["kind", "surrogate"], "left")
        again = F.col("free") & (F.col("again") | F.col("real").isNotNull() | ((F.col("kind") == "given") & F.array_contains(fixed, F.col("surrogate"))))
        ranked = cut(ranked.select("kind", "value", "attempt", "free", "surrogate", again.alias("again")))
        if ranked.where("again").isEmpty():
            return ranked.select("kind", "value", "surrogate", "attempt")
        now = ranked.select("kind", "value", (F.col("attempt") + F.col("again").cast("int")).alias("attempt"), "free")
    kinds = sorted(r["kind"] for r in now.where("attempt > 0").select("kind").distinct().collect())
    raise RuntimeError(f"after {MOST_ROUNDS} rounds some surrogates are still taken; kinds with collisions: {', '.join(kinds)}")


def replace_personal_data(docs: DataFrame, key: str = "surrogate", names: Names = GIVEN) -> DataFrame:
    """`docs` (doc_id, text) with every detected entity replaced by its surrogate.

    Returns doc_id, text, n_entities (mentions replaced) and kinds (sorted distinct kinds). Detected are e-mail
    addresses, IPv4 and IPv6 addresses, phone, card, account (IBAN) and social security numbers, access keys, hex tokens, secrets
    after `password=` and the like, and persons: by a title, by a given name of `names` (by script and gender), after words that
    announce a name, and Chinese names before a title, after `姓名：`, or alone if given-name signs follow the surname and no common word begins there. A surrogate is decided by
    `key` and the entity, so it is the same in all documents. Given names and surnames have surrogates of their
    own: a person named in full, by title and surname or, later in the document or before, by the surname alone is the same one
    in the output. Known given names keep gender and script, letters their script, case and kind, digits stay
    digits, card and account numbers keep their network or country and valid check digits, phone numbers their country code, addresses of one site share one.
    No two entities get the same surrogate, and none gets a real one.

    A null text stays null; a very long one is searched as a whole, with patterns that never go back; empty texts and those without entities stay as they are, with 0. Each row goes by its own
    text, so ids may be null or repeated. An empty table gives no rows; other columns don't matter.

    A surrogate is computed from the entity where it stands; what is settled between documents are only the few that collide, so
    neither texts nor the entities of a document are brought together.
    """
    first, second = F.lit(pattern(names)), F.lit(pattern(names, True))
    found = docs.select(identity("text").alias("_key"), F.explode(F.array_distinct(F.regexp_extract_all("text", first, F.lit(0)))).alias("mention"))
    found = found.withColumn("kind", entity_type(F.col("mention"))).where("kind is not null")
    found = found.select("_key", F.explode(values(F.col("kind"), F.col("mention"))).alias("v")).select("_key", "v.*").where("kind is not null")
    found = cut(found.distinct())
    collided = settle(found, key, names).where("attempt > 0").select("kind", "value", "attempt")
    odd = found.join(collided, ["kind", "value"]).groupBy("_key").agg(F.map_from_entries(F.collect_set(F.struct(F.concat_ws("|", "kind", "value"), "attempt"))).alias("_odd"))

    # texts with a collision are few: unless they aren't, they come to the texts, and not the other way round
    odd = cut(odd)
    odd = F.broadcast(odd) if odd.count() <= 100_000 else odd
    rows = docs.select("doc_id", "text", identity("text").alias("_key")).join(odd, "_key", "left")
    typed = lambda found: F.transform(found, lambda m: F.struct(m.alias("m"), entity_type(m).alias("kind")))
    rows = rows.select("doc_id", "text", "_odd", typed(F.regexp_extract_all("text", first, F.lit(0))).alias("_met"))
    people = F.flatten(F.transform(F.filter("_met", lambda x: x["kind"] == "person"), lambda x: person_parts(x["m"])))
    rows = rows.withColumn("_people", F.array_distinct(F.filter(people, lambda p: p["kind"].isNotNull())))
    # where there are people, capitalised words are looked at again: a lone word counts if it is part of the name of one of them
    named = lambda m: F.try_element_at(F.filter("_people", lambda p: p["value"] == m), F.lit(1))["kind"]
    lone = lambda m: m.rlike(rf"^{_WORD}$") & ~m.rlike("^AKIA[0-9A-Z]{16}$")
    again = F.transform(F.regexp_extract_all("text", second, F.lit(0)), lambda m: F.struct(m.alias("m"), F.when(lone(m), named(m)).otherwise(entity_type(m)).alias("kind")))
    wide = F.size("_people") > 0
    rows = rows.withColumn("_pieces", F.when(wide, F.split("text", second, -1)).when(F.size("_met") > 0, F.split("text", first, -1)))
    rows = rows.withColumn("_met", F.when(wide, again).otherwise(F.col("_met")))
    attempt = lambda p: F.coalesce(F.try_element_at(F.col("_odd"), F.concat_ws("|", p["kind"], p["value"])), F.lit(0))
    puts = lambda x: F.transform(values(x["kind"], x["m"]), lambda p: F.when(p["kind"].isNull(), p["value"]).otherwise(surrogate(key, p["kind"], p["value"], attempt(p), names)))
    rows = rows.withColumn("_met", F.transform("_met", lambda x: F.struct(x["m"].alias("m"), x["kind"].alias("kind"), F.when(x["kind"].isNotNull(), puts(x)).alias("puts"))))
    put = lambda x: F.when(x["kind"].isNull(), x["m"]).when(x["kind"] == "person", F.array_join(x["puts"], " ")).otherwise(_render(x["kind"], x["m"], x["puts"][0]))
    rows = rows.withColumn("_put", F.transform("_met", put))
    kind = lambda x: F.when(x["kind"].isin("given", "surname", "han"), "person").otherwise(x["kind"])
    rows = rows.withColumn("_kinds", F.coalesce(F.filter(F.transform("_met", kind), lambda k: k.isNotNull()), F.array().cast("array<string>")))
    text = F.array_join(F.zip_with("_pieces", "_put", lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    return rows.select(
        "doc_id",
        F.when(F.size("_kinds") > 0, text).otherwise(F.col("text")).alias("text"),
        F.size("_kinds").cast("long").alias("n_entities"),
        F.array_sort(F.array_distinct("_kinds")).alias("kinds"),
    )
