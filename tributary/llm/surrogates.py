"""Surrogates for personal data and secrets; DataFrame functions only.

One regular expression finds entities. Where it finds names or secrets, the same text is searched again for their other mentions: names without a form
of address, secrets without their key word. Each distinct entity (its kind and its normal form, so that spellings of one phone number are one
entity) gets a replacement derived from a secret key: same kind, same format, given names of the same script and of the gender that most forms of address
before them tell. Replacements that two entities would share, or that are entities of the texts themselves, are derived anew with a higher attempt
number until none is left, so different entities stay different and equal ones stay equal throughout the corpus. Forms that run out of
alternatives get longer. Then each text's pieces between entities and its replacements are joined in turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, join_counted

# Forms of address by gender, and particles of family names.
FEMALE = "Mrs|Ms|Miss|Frau|Mme|Mlle|Madame|Señora|Sra|г-жа|госпожа|κυρία|տիկին|Տիկին"
MALE = "Mr|Herr|Monsieur|Señor|Sr|г-н|господин|κύριος|պարոն|Պարոն"
NEUTRAL = "Dr|Prof"
PARTICLES = "van|von|vom|der|den|de|del|della|di|da|dos|das|la|le|du|ter|ten|zu|zur|bin|ibn|al|el"

#: A part of a name: capital, letters, and further parts behind an apostrophe or hyphen.
NAME = r"(?:\p{Lu}\p{L}{1,30}+|\p{Lu}(?=['’]\p{Lu}))(?:['’-]\p{Lu}\p{L}{1,30}+){0,3}"
ADDRESS = rf"(?:(?:{FEMALE}|{MALE}|{NEUTRAL})\.?|M\.)[ \xa0](?:\p{{Lu}}\.[ \xa0]?){{0,2}}"
#: Key words of secrets; whatever stands behind the second kind's colon is taken, behind the first kind's no short word of letters, which may be prose.
SECRET_WORD, PASS_WORD = r"secret|token|api[_-]?key", r"password|passwd|pwd|passphrase|passcode"
#: Blanks of any number, as in aligned settings. The first two letters of all key words are tried first, as secrets are looked for at every place.
_LEAD = r"[\"']?\s*+"
SECRET_LEAD = rf"(?=[Pp][AaWw]|[Ss][Ee]|[Tt][Oo]|[Aa][PpUu]|[Bb][Ee])(?:(?i:{PASS_WORD}){_LEAD}[=:]\s*+(?!(?:null|true|false)(?![\p{{L}}\p{{N}}_]))|(?i:{SECRET_WORD}){_LEAD}(?:=\s*+|:\s*+(?![\p{{L}}]{{1,5}}+(?![^\s,;.)}}\]])))|(?i:authorization){_LEAD}[=:]\s*+[\"']?(?i:basic|bearer|digest|token)[ \t]++|(?i:bearer)[ \t]++(?=[A-Za-z._~+/=-]*+\d)(?=[^\s\"',;]{{8}}))"
_QUOTED = r"\"(?!\")[^\n]+?(?<!\\)\"|'(?!')[^\n]+?(?<!\\)'"
#: Up to the closing quote, else up to a blank, comma or semicolon. A quote inside begins a quoted part unless what ends a value is behind it; one that isn't closed is a sign like others.
_PLAIN = r"(?:[^\s\"',;]|\"(?=[^\s\"',;:)}\]>/])(?:[^\"\n]*+\")?|'(?=[^\s\"',;:)}\]>/])(?:[^'\n]*+')?)++"
SECRET_VALUE = rf"(?:{_QUOTED}|[\"']?{_PLAIN})"
#: All of a private key between its first and its last line, to the end of the text where that is missing.
KEY_LEAD, KEY_END = r"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----", r"-----END "
KEY_BLOCK = rf"{KEY_LEAD}(?:(?!{KEY_END})[\s\S])++"
OCTET, HEX = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)", "[0-9A-Fa-f]{1,4}"
#: Characters of a mail's local part, which is read from its first letter, digit or underscore on, from no place further on.
_LOCAL = r"\p{L}\p{M}\p{N}._%+'-"
#: By kind, in the order in which they are tried at a place.
PATTERNS = {
    "email": rf"(?:(?<![{_LOCAL}])|(?<=(?<![{_LOCAL}])[.%+'-]{{1,3}}))[\p{{L}}\p{{N}}_][{_LOCAL}]*+@(?:[\p{{L}}\p{{M}}\p{{N}}-]{{1,63}}+\.){{1,8}}(?:xn--[a-z0-9-]{{2,59}}|\p{{L}}{{2,24}})",
    "key_block": KEY_BLOCK,
    "secret": SECRET_LEAD + SECRET_VALUE,
    "access_key": r"AKIA[A-Z0-9]{16}(?![A-Za-z0-9])",
    "iban": r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])|[a-z]{2}\d{2}(?: ?[a-z]{4})?(?: ?\d{4}){3,7}(?: ?\d{1,3})?(?![A-Za-z0-9])",
    "ip6": rf"(?:(?:{HEX}:){{7}}{HEX}|(?=[0-9A-Fa-f:]{{0,38}}\d)(?:{HEX}:){{1,6}}(?::{HEX}){{1,6}})(?![:\p{{L}}\p{{N}}])",
    "card": r"\d{4}(?:[ -]?\d{4}){3}(?!\d)|\d{19}(?!\d)|3[47]\d\d[ -]?\d{6}[ -]?\d{5}(?!\d)|3[0689]\d\d[ -]?\d{6}[ -]?\d{4}(?!\d)|4\d{12}(?!\d)",
    "phone": r"(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)|\d{2,4})[ .-]\d{3}[ .-]\d{4}(?!\d)|\+\d{9,15}(?!\d)|\+(?=(?:[ ./()-]{0,2}\d){8,15}(?!\d))\d{1,4}(?:[ ./()-]{1,2}\d{1,8}){1,6}(?!\d)"
    r"|0\d(?:[ .-]\d\d){4}(?!\d)|0\d{1,4}[ /-]\d{3,4}[ -]?\d{3,4}(?!\d)|[2-9](?=\d{9}(?!\d))(?<=(?i:tel|phone|mobile|cell|fax|call)[.:]{0,2} {0,3}\d)\d{9}",
    "national_id": r"\d{3}-\d{2}-\d{4}(?!\d)|\d{3} \d{2} \d{4}(?!\d)",
    "ip": rf"(?<!\d\.){OCTET}(?:\.{OCTET}){{3}}(?!\d|\.\d)",
    "name": rf"{ADDRESS}(?:{NAME}[ \xa0])?(?:(?:{PARTICLES})[ \xa0]){{0,3}}{NAME}",
}
#: Entities begin where no letter, digit or underscore is before; secrets do anywhere, as their key words end longer names (client_secret, accessToken).
ENTITY = r"(?<![\p{L}\p{N}_])(?:" + "|".join(PATTERNS.values()) + ")|" + PATTERNS["secret"]
#: What may be a name's other mention, and isn't the key of a secret.
BARE_NAME = rf"|(?<![\p{{L}}\p{{N}}_]){NAME}(?![\p{{L}}\p{{N}}_]|[\"']?\s*+[=:])"
#: Secrets of so many characters are looked for without their key word.
BARE_SECRET = 6
#: Kinds whose entity is its digits; a mention keeps its own blanks, brackets and dashes.
DIGITS = ("card", "phone", "national_id")
#: From this attempt on forms get longer by a digit with each one; after the last there is an error.
LONGER, LAST_ATTEMPT = 6, 64

# Given names by script and gender, and syllables of family names by script.
GIVEN = {
    ("latin", "female"): "Anna Clara Diana Elena Flora Greta Helena Irene Julia Klara Laura Maria Nora Olivia Paula Rosa".split(),
    ("latin", "male"): "Adam Bruno Carl David Emil Felix Georg Henri Ivan Jonas Karl Lucas Martin Noel Oscar Paul".split(),
    ("latin", "any"): "Alex Andrea Charlie Eden Jordan Kim Lou Mika Noa Robin Sam Sascha".split(),
    ("cyrillic", "female"): "Анна Вера Дарья Елена Ирина Мария Нина Ольга".split(),
    ("cyrillic", "male"): "Антон Борис Виктор Глеб Денис Иван Олег Павел".split(),
    ("cyrillic", "any"): "Женя Саша Валя Никита".split(),
    ("greek", "female"): "Άννα Ελένη Ειρήνη Μαρία Νίκη Σοφία".split(),
    ("greek", "male"): "Αλέξης Γιώργος Δημήτρης Κώστας Νίκος Πέτρος".split(),
    ("greek", "any"): "Άγγελος Χρύσα Φώτης".split(),
    ("armenian", "female"): "Անի Աննա Արփի Գայանե Լիլիթ Մարիամ Նարե Սոնա".split(),
    ("armenian", "male"): "Արամ Արման Գոռ Դավիթ Կարեն Հայկ Տիգրան Վահե".split(),
    ("armenian", "any"): "Արշալույս Երջանիկ Արև".split(),
}
SYLLABLES = {
    "latin": "ba be bi bo da de di do fa fe fi fo la le li lo ma me mi mo na ne ni no ra re ri ro sa se si so".split(),
    "cyrillic": "ба бе би бо да де ди до ла ле ли ло ма ме ми мо".split(),
    "greek": "βα βε βι βο δα δε δι δο λα λε λι λο μα με μι μο".split(),
    "armenian": "բա բե բի բո դա դե դի դո լա լե լի լո մա մե մի մո".split(),
}

# Letters by script, small and capital; scripts without case have one kind.
_range = lambda first, last: "".join(c for c in map(chr, range(ord(first), ord(last) + 1)) if c.isalpha())
LETTERS = {
    "Cyrillic": (_range("а", "я"), _range("А", "Я")), "Greek": (_range("α", "ω"), _range("Α", "Ω")), "Armenian": (_range("ա", "ֆ"), _range("Ա", "Ֆ")), "Georgian": (_range("ა", "ჰ"),) * 2,
    "Hebrew": (_range("א", "ת"),) * 2, "Arabic": (_range("ب", "غ"),) * 2, "Devanagari": (_range("क", "ह"),) * 2, "Thai": (_range("ก", "ฮ"),) * 2, "Han": (_range("一", "仿"),) * 2,
    "Hiragana": (_range("か", "ろ"),) * 2, "Katakana": (_range("カ", "ロ"),) * 2, "Hangul": (_range("가", "갿"),) * 2, "Latin": (_range("a", "z"), _range("A", "Z")),
}
#: For signs of secrets; fewer would leave too many of them in place by chance.
SIGNS = "!#$%&()*+-./:<=>?@[]^_{|}~"


def _byte(digest: Column, at: Column | int) -> Column:
    """One of the 64 bytes of a hexadecimal digest."""
    place = F.lit(at) if isinstance(at, int) else at % 64
    return F.conv(F.substr(digest, place * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _pick(options: list[str], number: Column) -> Column:
    return F.element_at(F.split(F.lit(" ".join(options)), " "), number % len(options) + 1)


def _sign(c: Column, n: Column) -> Column:
    """A letter of the same script and case for a letter, of any other script a Latin one; a digit for a digit; a sign for all else."""
    of = lambda options: F.substr(F.lit(options), n % len(options) + 1, F.lit(1))
    out = F.when(c.rlike(r"^\p{N}$"), (n % 10).cast("string"))
    for script, (small, capital) in LETTERS.items():
        letter = c.rlike(r"^\p{L}$") if script == "Latin" else c.rlike(rf"^[\p{{Is{script}}}&&\p{{L}}]$")
        out = out.when(letter & c.rlike(r"^\p{Lu}$"), of(capital)).when(letter, of(small))
    return out.otherwise(of(SIGNS))


#: For _alike: letters of other scripts are replaced too, signs stay.
LETTERS_ONLY = "letters"


def _alike(text: Column, digest: Column, secret: Column | str | None = None) -> Column:
    """Digits become digits, A-Z and a-z letters of the same case; other characters stay, other letters not with LETTERS_ONLY.

    Of secrets only blanks stay as they are but by chance; there `secret` says whether the text is hexadecimal, whose characters become hexadecimal digits.
    """

    def whole(given: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            n = _byte(given["digest"], i)
            plain = F.when(c.between("0", "9"), (n % 10).cast("string")).when(c.between("a", "z"), F.char(97 + n % 26)).when(c.between("A", "Z"), F.char(65 + n % 26))
            if secret is None:
                return plain.otherwise(c)
            if isinstance(secret, str):
                return plain.when(c.rlike(r"^\p{L}$"), _sign(c, n)).otherwise(c)
            return F.when(given["hexadecimal"], F.lower(F.hex(n % 16))).otherwise(plain.when(c.rlike(r"^\s$"), c).otherwise(_sign(c, n)))

        return F.array_join(F.transform(F.split(text, ""), one), "")

    # Bound once, as what stands in a lambda is worked out for each character.
    hexadecimal = secret if isinstance(secret, Column) else F.lit(False)
    return F.transform(F.array(F.struct(digest.alias("digest"), hexadecimal.alias("hexadecimal"))), whole)[0]


def _luhn(digits: Column) -> Column:
    """The sum over digits of the Luhn check, every second one from the last but one doubled, modulo 10."""
    doubled = lambda i: (F.length(digits) - i) % 2 == 0
    values = F.transform(F.split(digits, ""), lambda c, i: F.when(doubled(i), c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int")))
    return F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10


def surrogate(kind: Column, norm: Column, gender: Column, key: str, attempt: int) -> Column:
    """The replacement of a normal form: a function of the key, the kind, the form, a given name's gender (female, male or any) and the attempt."""
    seed = lambda what: F.sha2(F.concat(F.lit(f"{key}\x00{attempt}\x00"), kind, F.lit("\x00"), what), 512)
    digest = seed(norm)
    more = "" if attempt < 3 else f"{attempt}"  # short forms run out of alternatives
    longer = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(attempt - LONGER + 1)), lambda i: (_byte(digest, i + 30) % 10).cast("string")), "") if attempt >= LONGER else F.lit("")
    local, domain = F.substring_index(norm, "@", 1), F.substring_index(norm, "@", -1)
    top = F.concat(F.lit("."), F.substring_index(domain, ".", -1))
    hosts = F.substr(domain, F.lit(1), F.length(domain) - F.length(top))
    email = F.concat(_alike(local, digest, LETTERS_ONLY), F.lit(more), F.lit("@"), _alike(hosts, F.sha2(F.concat(F.lit(f"{key}\x00domain\x00"), domain), 512), LETTERS_ONLY), top)
    # Phones keep their leading digit, cards their network; groups of digits hold no kept digit otherwise.
    body = lambda from_: F.concat(F.substr(norm, F.lit(1), F.lit(from_)), _alike(F.substr(norm, F.lit(from_ + 1)), digest))
    card = body(1)
    unchecked = F.substr(card, F.lit(1), F.length(card) - 1)
    valid = F.concat(unchecked, ((10 - _luhn(F.concat(unchecked, F.lit("0")))) % 10).cast("string"))
    card = F.concat(F.when(_luhn(norm) == 0, valid).otherwise(card), longer)
    private = F.regexp_extract(norm, r"^(10\.|192\.168\.)", 1)
    # Ranges of addresses run out: private ones go on in 10., then all in any range, at last in local addresses of the sixth version, of which there are 2 ** 120.
    if attempt >= 4:
        private = F.when((private == "") | F.lit(attempt >= 12), "").otherwise("10.")
    n_octets = F.when(private == "", 4).when(private == "10.", 3).otherwise(2)
    octets = F.array_join(F.transform(F.sequence(F.lit(0), n_octets - 1), lambda i: (_byte(digest, i) % 254 + 1).cast("string")), ".")
    ip6 = F.concat(F.lit("fd"), F.regexp_replace(F.substr(digest, F.lit(1), F.lit(30)), "^(..)" + "(....)" * 7 + "$", "$1:$2:$3:$4:$5:$6:$7:$8"))
    ip = F.concat(private, octets) if attempt < 20 else ip6
    access = F.concat(F.lit("AKIA"), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: _pick(list("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), _byte(digest, i))), ""))
    hexadecimal = norm.rlike("^[0-9a-f]+$")
    script = F.when(norm.rlike(r"^\p{IsCyrillic}"), "cyrillic").when(norm.rlike(r"^\p{IsGreek}"), "greek").when(norm.rlike(r"^\p{IsArmenian}"), "armenian").otherwise("latin")
    given = family = None
    for which, parts in SYLLABLES.items():
        made = F.initcap(F.concat(*(_pick(parts, _byte(digest, i)) for i in range(4 + min(attempt, 12)))))
        family = F.when(script == which, made) if family is None else family.when(script == which, made)
    # Given names are few: from the third attempt on they get syllables.
    extras = {w: F.concat(F.lit(""), *(_pick(SYLLABLES[w], _byte(digest, i + 2)) for i in range(attempt - 2))) for w in SYLLABLES}
    for (which, of), names in GIVEN.items():
        made = F.concat(_pick(names, _byte(digest, 0) * 256 + _byte(digest, 1)), extras[which])
        fits = (gender == of) & (script == which)
        given = F.when(fits, made) if given is None else given.when(fits, made)
    return (
        F.when(kind == "email", email).when(kind == "card", card).when(kind == "phone", F.concat(body(1), longer)).when(kind == "national_id", F.concat(F.lit("9"), _alike(F.substr(norm, F.lit(2)), digest), longer))
        .when(kind == "ip", ip).when(kind == "ip6", ip6).when(kind == "access_key", access).when(kind == "iban", F.concat(F.substr(norm, F.lit(1), F.lit(2)), _alike(F.substr(norm, F.lit(3)), digest), longer))
        .when(kind == "secret", F.concat(_alike(norm, digest, hexadecimal), F.lit(more))).when(kind == "family", family).otherwise(given)
    )


def _part(kind: Column, norm: Column, lead: Column, form: Column, gender: Column | None = None) -> Column:
    return F.struct(kind.alias("kind"), norm.alias("norm"), lead.alias("lead"), form.alias("form"), (F.lit(None).cast("string") if gender is None else gender).alias("gender"))


def _parts(surface: Column) -> Column:
    """An entity's parts as (kind, norm, lead, form, gender): names have one or two, the rest one. lead stays before the replacement, form is filled with it."""
    empty, digits = F.lit(""), F.regexp_replace(surface, r"\D", "")
    is_ = lambda kind: surface.rlike("^(?:" + PATTERNS[kind] + ")$") | (surface.rlike(r"^\d{10}$") if kind == "phone" else F.lit(False))
    of_secret = lambda n: F.regexp_extract(surface, rf"(?s)^({SECRET_LEAD}[\"']?)(.*?)([\"']?)$", n)
    of_name = lambda n: F.regexp_extract(surface, rf"^({ADDRESS})(?:({NAME})[ \xa0])?((?:(?:{PARTICLES})[ \xa0]){{0,3}})({NAME})$", n)
    gender = F.when(surface.rlike(rf"^(?:{FEMALE})\b"), "female").when(surface.rlike(rf"^(?:{MALE}|M\.)(?!\p{{L}})"), "male")
    address, first, last = of_name(1), of_name(2), of_name(4)
    between = F.substr(surface, F.length(address) + F.length(first) + 1, F.length(surface) - F.length(address) - F.length(first) - F.length(last))
    family = lambda lead: _part(F.lit("family"), F.initcap(last), lead, last)
    names = F.when(first != "", F.array(_part(F.lit("given"), F.initcap(first), address, first, gender), family(between))).otherwise(F.array(family(F.concat(address, between))))
    left, right = F.split(F.lower(surface), "::")[0], F.when(surface.contains("::"), F.substring_index(F.lower(surface), "::", -1))
    groups = F.concat(F.split(left, ":"), F.array_repeat(F.lit("0"), F.greatest(F.lit(0), 8 - F.size(F.split(left, ":")) - F.coalesce(F.size(F.split(right, ":")), F.lit(0)))), F.coalesce(F.split(right, ":"), F.array().cast("array<string>")))
    norms = {"iban": F.upper(F.replace(surface, F.lit(" "))), "ip6": F.array_join(F.transform(groups, lambda g: F.lpad(g, 4, "0")), ":")} | dict.fromkeys(DIGITS, digits)
    out = F.when(is_("email"), F.array(_part(F.lit("email"), F.lower(surface), empty, empty)))
    block = F.regexp_extract(surface, rf"^{KEY_LEAD}", 0)
    out = out.when(block != "", F.array(_part(F.lit("secret"), F.substr(surface, F.length(block) + 1), block, empty)))
    out = out.when(of_secret(1) != "", F.array(_part(F.lit("secret"), of_secret(2), of_secret(1), of_secret(3))))
    # Rarer lengths of card numbers are other numbers unless their check digit is right.
    out = out.when(is_("card") & F.length(digits).isin(13, 14, 19) & (_luhn(digits) != 0), F.slice(F.array(_part(F.lit("card"), digits, empty, empty)), 1, 0))
    for kind in ("access_key", "iban", "ip6", "card", "phone", "national_id", "ip"):
        out = out.when(is_(kind), F.array(_part(F.lit(kind), norms.get(kind, surface), empty, surface if kind in (*DIGITS, "iban") else empty)))
    return out.otherwise(names)


def _filled(form: Column, kind: Column, new: Column) -> Column:
    """The mention's own format with the replacement in it: digits into its digits' places and more behind them, capitals for capitals, a secret's closing quote."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    wanted = F.when(kind == "iban", "[A-Za-z0-9]").otherwise("[0-9]")
    new = F.when((kind == "iban") & (F.lower(form) == form), F.lower(new)).otherwise(new)

    def step(a: Column, c: Column) -> Column:
        takes = F.regexp_like(c, wanted)
        return F.struct(F.concat(a["out"], F.when(takes, F.substr(new, a["at"] + 1, F.lit(1))).otherwise(c)).alias("out"), (a["at"] + F.when(takes, 1).otherwise(0)).alias("at"))

    spread = F.aggregate(F.split(form, ""), start, step, lambda a: F.concat(a["out"], F.substr(new, a["at"] + 1)))
    capitals = (F.length(form) > 1) & (F.upper(form) == form)
    return F.when(kind.isin(*DIGITS, "iban"), spread).when(kind == "secret", F.concat(new, form)).when(kind.isin("family", "given"), F.when(capitals, F.upper(new)).otherwise(new)).otherwise(new)


def _identified(docs: DataFrame, *more: Column) -> DataFrame:
    """doc (null ids count as the smallest), digest and text: what tells texts apart, repeated ids or not."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("doc"), F.xxhash64("text").alias("digest"), F.col("text").cast("string").alias("text"), *more)


def mentions(docs: DataFrame) -> DataFrame:
    """A row for each part of each entity: doc, digest, pos (number of the match in its text), part, kind, norm, lead, form, gender. Null texts have none.

    A text's first row also has extra, what is searched for there besides ENTITY, and unchanged, the matches (pos, part, text) that turned out to be no entity.
    """
    first = _identified(docs).withColumn("found", F.regexp_extract_all("text", F.lit(ENTITY), F.lit(0))).where(F.size("found") > 0)
    told = first.withColumn("parts", F.transform("found", _parts)).withColumn("flat", F.flatten("parts"))
    names = F.array_distinct(F.transform(F.filter("flat", lambda p: p["kind"].isin("given", "family")), lambda p: F.struct(F.lower(p["form"]).alias("term"), p["kind"].alias("kind"), p["norm"].alias("norm"))))
    secrets = F.array_distinct(F.transform(F.filter("flat", lambda p: (p["kind"] == "secret") & (F.length(p["norm"]) >= BARE_SECRET)), lambda p: p["norm"]))
    told = told.withColumns({"names": names, "secrets": secrets})
    longest_first = F.reverse(F.array_sort(F.transform("secrets", lambda s: F.struct(F.length(s).alias("n"), s.alias("s")))))
    quoted = F.transform(longest_first, lambda s: F.concat(F.lit(r"|\Q"), F.replace(s["s"], F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E")))
    extra = F.concat(F.when(F.size("names") > 0, BARE_NAME).otherwise(""), F.array_join(quoted, ""))
    told = told.withColumn("extra", extra)
    again = F.when(F.col("extra") == "", F.col("found")).when(F.size("secrets") == 0, F.regexp_extract_all("text", F.lit(ENTITY + BARE_NAME), F.lit(0))).otherwise(F.regexp_extract_all("text", F.concat(F.lit(ENTITY), "extra"), F.lit(0)))

    def read(surface: Column) -> Column:
        known = F.filter("names", lambda n: n["term"] == F.lower(surface))
        bare = F.array(_part(known[0]["kind"], known[0]["norm"], F.lit(""), surface))
        secret = F.array(_part(F.lit("secret"), surface, F.lit(""), F.lit("")))
        no_entity = surface.rlike(f"^(?:{NAME})$") & ~surface.rlike("^" + PATTERNS["access_key"])
        return F.when(F.array_contains("secrets", surface), secret).when(F.size(known) > 0, bare).when(no_entity, F.slice(secret, 1, 0)).otherwise(_parts(surface))

    told = told.withColumn("found", again).withColumn("parts", F.when(F.col("extra") == "", F.col("parts")).otherwise(F.transform("found", read)))
    unchanged = F.filter(F.transform("found", lambda s, i: F.struct(i.alias("pos"), F.lit(0).alias("part"), s.alias("text"))), lambda s: F.size(F.col("parts")[s["pos"]]) == 0)
    listed = F.flatten(F.transform("parts", lambda ps, i: F.transform(ps, lambda p, k: F.struct(i.alias("pos"), k.alias("part"), p.alias("p")))))
    rows = told.select("doc", "digest", "extra", unchanged.alias("unchanged"), F.posexplode(listed).alias("place", "m"))
    only_first = lambda c: F.when(F.col("place") == 0, F.col(c)).alias(c)
    return rows.select("doc", "digest", "m.pos", "m.part", "m.p.*", only_first("extra"), only_first("unchanged"))


def surrogate_table(found: DataFrame, key: str) -> DataFrame:
    """kind, norm, surrogate and n (mentions) for each distinct entity; within a kind no two surrogates are equal and none is an entity found. No secret is part of its surrogate."""
    women, men = (F.count_if(F.col("gender") == g) for g in ("female", "male"))
    gender = F.when(women > men, "female").when(men > women, "male").otherwise("any")
    entities = checkpoint(found.groupBy("kind", "norm").agg(gender.alias("gender"), F.count("*").alias("n")))
    pending, done = entities, None
    for attempt in range(LAST_ATTEMPT):
        made = pending.select("kind", "norm", "n", surrogate(F.col("kind"), F.col("norm"), F.col("gender"), key, attempt).alias("surrogate"))
        made = made.where((F.col("kind") != "secret") | ~F.col("surrogate").contains(F.col("norm")))
        winners = made.groupBy("kind", "surrogate").agg(F.min(F.struct("norm", "n")).alias("w")).select("kind", "surrogate", "w.*")
        good = winners.join(entities.select("kind", F.col("norm").alias("surrogate")), ["kind", "surrogate"], "left_anti")
        if done is not None:
            good = good.join(done.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
        good = checkpoint(good.select("kind", "norm", "surrogate", "n"))
        done = good if done is None else checkpoint(done.union(good))
        pending = checkpoint(pending.join(good, ["kind", "norm"], "left_anti"))
        if pending.isEmpty():
            return done
    raise RuntimeError(f"entities without surrogates after {LAST_ATTEMPT} attempts")


def replace_entities(docs: DataFrame, key: str) -> DataFrame:
    """docs with surrogates in text, n_chars set anew where docs has it, and n_entities. Other columns stay, whatever their names; one named n_entities is replaced.

    Null texts stay null; texts without entities, empty ones too, stay as they are. Rows that repeat come back as often.
    """
    found = checkpoint(mentions(docs))
    replaced = join_counted(found, surrogate_table(found, key), ["kind", "norm"])
    text = F.concat("lead", _filled(F.col("form"), F.col("kind"), F.col("surrogate")))
    lists = replaced.groupBy("doc", "digest").agg(
        F.collect_set(F.struct("pos", "part", text.alias("text"))).alias("new"), F.max("extra").alias("extra"), F.flatten(F.collect_set("unchanged")).alias("unchanged")
    )
    joined = _identified(docs, F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")).join(lists, ["doc", "digest"], "left")
    between = F.when(F.col("extra") == "", F.split("text", ENTITY)).when(F.col("extra") == BARE_NAME, F.split("text", ENTITY + BARE_NAME)).otherwise(F.split("text", F.concat(F.lit(ENTITY), "extra")))
    pieces = F.concat(F.transform(between, lambda b, i: F.struct(i.alias("pos"), F.lit(-1).alias("part"), b.alias("text"))), "new", F.array_distinct("unchanged"))
    new = F.when(F.col("new").isNull(), F.col("text")).otherwise(F.array_join(F.transform(F.array_sort(pieces), lambda p: p["text"]), ""))
    done = joined.select("row", new.alias("text"), F.coalesce(F.size(F.filter("new", lambda s: s["part"] == 0)), F.lit(0)).alias("n_entities"))
    set_anew = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    kept = [set_anew.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns if c != "n_entities"]
    return done.select(*kept, "n_entities")
