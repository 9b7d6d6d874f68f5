"""Keyed surrogates for personal data, in DataFrame functions alone.

Found are e-mail addresses, IBANs, card numbers (13 to 19 digits), US social security numbers, phone
numbers, IPv4 addresses and names with a title or an honorific (Latin, Cyrillic, Greek, Arabic and
Chinese characters). In a document with such a name, every other capitalised word (or word of a
script without capitals) that is a part of it is found too, so that "Mr. John Smith", "John Smith"
and "Smith" stay one person. Patterns repeat characters or possessive groups only, so that no text,
however long or hostile, makes the engine recurse.

A surrogate is derived from a keyed hash of the entity's kind and normal form, so all mentions of an
entity have the same one, in every document and in every format. Names are replaced part by part:
a family name is the same beside any given name. Surrogates keep the mention's format (separators,
letter case, title, the digits before a phone number's last ten, top-level domain, issuer digit) and what makes it a true one of its
kind: a card's Luhn sum, an IBAN's remainder, a social security number's valid ranges, a name's
script and gender (by the title; a title of either gender takes the one that the given name has
most often in the corpus).

Distinct entities keep distinct surrogates: the table of distinct entities is checked for two
entities with one surrogate and for surrogates that are themselves entities of the corpus; those
are derived anew with the next attempt number, which makes names and addresses longer, until none
is left. Numbers can't grow: where a corpus has so many of one format (kind, length, a card's first digit) that they
fill more than an eighth of it (`CROWDED`), a keyed permutation of the whole format (a Feistel network over
its digits) takes the place of the hash. It is distinct by construction and ends on any corpus; in such a format a
surrogate may be another number of the corpus, and a social security number may leave the valid ranges. No text is shuffled for that; the replacements return to the documents by their id and
the text's hash, broadcast if they are few.

Null texts stay null, texts without entities are unchanged. Repeated rows are each replaced alike.
Rows of one id with different texts are told apart by the text. A column that has the name of the
count is replaced; other columns stay, whatever their names.
"""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.tables import drop, free_names, save, small

ATTEMPTS = 24
#: Numbers of a format are permuted where this many times their number exceeds the format's surrogates.
CROWDED = 8
#: Rows and bytes up to which the replacements are broadcast.
FEW_ROWS, FEW_BYTES = 50_000, 32 << 20

#: Titles by gender, and honorifics after a name.
_MALE = "Mr|Herr|Herrn|Monsieur|Señor|Sr|господин|г-н|السيد"
_FEMALE = "Mrs|Ms|Miss|Frau|Madame|Mme|Mademoiselle|Señora|Señorita|Sra|госпожа|г-жа|السيدة"
_EITHER = "Dr|Prof|Professor|Doctor|доктор|профессор|الدكتور|الدكتورة"
_HONORIFIC = "さん|様|氏|先生|女士"
_TITLES = rf"(?:(?:{_MALE}|{_FEMALE}|{_EITHER})\.? ){{1,3}}+"
#: Kinds in the order in which they are tried at a place.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]++\.(?=[A-Za-z]{2}|[A-Za-z0-9-]++\.))++[A-Za-z]{2,}+",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:(?: [A-Z0-9]{4}){3,7}(?: [A-Z0-9]{1,3})?|[A-Z0-9]{11,30})(?![A-Za-z0-9])",
    "card": r"(?<![A-Za-z0-9+])(?:[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{1,7}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}|[0-9]{13,19})(?![A-Za-z0-9])",
    "ssn": r"(?<![A-Za-z0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9-])",
    "phone": r"(?<![A-Za-z0-9+])(?:(?:\+?[0-9]{1,3}[ .-]?)?\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}|\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,4}|(?:1[.-])?[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![A-Za-z0-9])",
    "ip": r"(?<![A-Za-z0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![A-Za-z0-9]|\.[0-9])",
    "name": rf"(?<![\p{{L}}\p{{N}}]){_TITLES}(?!(?:{_MALE}|{_FEMALE}|{_EITHER})(?!\p{{L}}))(?:\p{{Lu}}[\p{{L}}'-]++(?: \p{{Lu}}[\p{{L}}'-]++){{0,2}}+|\p{{IsArabic}}++)|(?<!\p{{IsHan}})\p{{IsHan}}{{1,4}}?(?:{_HONORIFIC})",
}
#: Words that may be a part of a name that the document has with a title.
WORD = r"(?<![\p{L}\p{N}])(?:\p{Lu}[\p{L}'-]++|\p{IsArabic}++)|(?<!\p{IsHan})\p{IsHan}{1,4}+(?!\p{IsHan})"
# what a match may start with is looked at once for the four kinds of numbers
_NUMBERS = "|".join(f"(?:{PATTERNS[k]})" for k in ("card", "ssn", "phone", "ip"))
PATTERN = f"(?:{PATTERNS['email']})|(?:(?=[A-Z]{{2}}[0-9]){PATTERNS['iban']})|(?:(?=[0-9+(])(?:{_NUMBERS}))|(?:{PATTERNS['name']})"
WITH_WORDS = f"{PATTERN}|(?:{WORD})"
_TITLE, _AFTER = rf"^{_TITLES}", f"(?:{_HONORIFIC})$"


def _kind(mention: Column) -> Column:
    return F.coalesce(*[F.when(mention.rlike(f"^(?:{p})$"), F.lit(k)) for k, p in PATTERNS.items()], F.lit("word"))


def _script(token: Column) -> Column:
    named = {"cyrillic": r"\p{IsCyrillic}", "greek": r"\p{IsGreek}", "arabic": r"\p{IsArabic}", "han": r"\p{IsHan}"}
    return F.coalesce(*[F.when(token.rlike(p), F.lit(k)) for k, p in named.items()], F.lit("latin"))


def find_entities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Mentions: (id, text_hash, named, position from 0, mention, kind). Documents with a name
    (`named`) have their words too (kind word), of which most are no entities."""
    text = F.col("text")
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = rows.select("id", "text", F.xxhash64("text").alias("text_hash"), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)).alias("found")).where(F.size("found") > 0)
    rows = rows.withColumn("named", F.exists("found", lambda m: m.rlike(f"{_TITLE}|{_AFTER}")))
    found = F.when(F.col("named"), F.regexp_extract_all(text, F.lit(WITH_WORDS), F.lit(0))).otherwise(F.col("found"))
    m = rows.select("id", "text_hash", "named", F.posexplode(found).alias("position", "mention")).distinct()
    return m.withColumn("kind", _kind(F.col("mention")))


def entity_parts(mentions: DataFrame) -> DataFrame:
    """mentions with part (from 0), part_kind, norm and token: names have a part for each of their
    words (the last one is the family name), other entities one; words that are no part of a name of their document have no norm."""
    kind, mention = F.col("kind"), F.col("mention")
    digits = F.regexp_replace("mention", "[^0-9]", "")
    plain = mentions.where(~kind.isin("name", "word")).select(
        "*", F.lit(0).alias("part"), kind.alias("part_kind"),
        F.when(kind == "phone", F.right(digits, F.lit(10))).when(kind.isin("card", "ssn"), digits).when(kind == "iban", F.regexp_replace("mention", " ", ""))
        .when(kind == "ip", F.regexp_replace("mention", r"(?<![0-9])0+(?=[0-9])", "")).otherwise(F.lower("mention")).alias("norm"),
    )
    # a name's gender: that of its last title which has one
    gender = F.when(mention.rlike(rf"(?:^| )(?:{_FEMALE})\.? |女士$"), "f").when(mention.rlike(rf"(?:^| )(?:{_MALE})\.? "), "m").otherwise("u")
    tokens = F.split(F.lower(F.regexp_replace(F.regexp_replace("mention", _TITLE, ""), _AFTER, "")), " ")
    names = mentions.where(kind == "name").select("*", gender.alias("own"), F.size(tokens).alias("n"), F.posexplode(tokens).alias("part", "token"))
    names = names.select("*", F.when(F.col("part") == F.col("n") - 1, "family").otherwise("given").alias("part_kind"), _script(F.col("token")).alias("script"))
    given = names.where("part_kind = 'given'").groupBy("token").agg(F.sum((F.col("own") == "f").cast("int") - (F.col("own") == "m").cast("int")).alias("lean"))
    names = names.join(small(given), "token", "left")
    known = F.when(F.col("own") != "u", F.col("own")).when(F.col("lean") > 0, "f").when(F.col("lean") < 0, "m").otherwise("u")
    slavic = F.when(F.col("token").rlike("[ая]$"), "f").otherwise("m")
    of_part = F.when(F.col("part_kind") == "given", known).when(F.col("script") == "cyrillic", slavic).otherwise("u")
    names = names.withColumn("norm", F.concat_ws("|", "script", of_part, "token"))
    held = names.groupBy("id", "text_hash", "token").agg(F.min(F.struct("part_kind", "norm")).alias("held"))
    words = mentions.where(kind == "word").withColumn("token", F.lower("mention"))
    same = words["id"].eqNullSafe(held["id"]) & (words["text_hash"] == held["text_hash"]) & (words["token"] == held["token"])
    words = words.join(held, same, "left").select(*[words[c] for c in mentions.columns], F.lit(0).alias("part"), F.col("held.part_kind").alias("part_kind"), F.col("held.norm").alias("norm"))
    columns = [*mentions.columns, "part", "part_kind", "norm"]
    return plain.select(columns).unionByName(names.select(columns)).unionByName(words.select(columns))


def _byte(hexed: Column, i: Column) -> Column:
    """The i-th of 64 bytes of a hex string, as an integer."""
    return F.conv(F.substr(hexed, F.pmod(i, F.lit(64)) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _number(hexed: Column, at: int, below: int) -> Column:
    """A number from 1 to below, by six bytes of the hash."""
    return F.pmod(F.conv(F.substr(hexed, F.lit(at * 2 + 1), F.lit(12)), 16, 10).cast("bigint"), F.lit(below)) + 1


def _once(value: Column, fn: Callable[[Column], Column]) -> Column:
    """fn of a value that is computed once, however often fn uses it (in a loop over characters, say)."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def _chars(s: Column, hexed: Column) -> Column:
    """s with each ASCII letter and digit replaced by one of its kind that the hash names."""

    def one(h: Column, c: Column, i: Column) -> Column:
        b = _byte(h, i)
        return (
            F.when(c.rlike("^[0-9]$"), F.pmod(b, F.lit(10)).cast("string"))
            .when(c.rlike("^[a-z]$"), F.char(F.pmod(b, F.lit(26)) + 97))
            .when(c.rlike("^[A-Z]$"), F.char(F.pmod(b, F.lit(26)) + 65))
            .otherwise(c)
        )

    return _once(hexed, lambda h: F.array_join(F.transform(F.split(s, ""), lambda c, i: one(h, c, i)), ""))


def luhn_sum(digits: Column) -> Column:
    """Sum of a card number's digits, every second from the right doubled."""

    def one(c: Column, i: Column) -> Column:
        d = c.cast("int")
        return F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), one), F.lit(0), lambda s, x: s + x)


def iban_remainder(iban: Column) -> Column:
    """The number that an IBAN stands for, modulo 97; 1 for valid ones."""
    moved = F.concat(F.substr(iban, F.lit(5)), F.left(iban, F.lit(4)))

    def step(s: Column, c: Column) -> Column:
        return F.when(c.rlike("^[0-9]$"), F.pmod(s * 10 + c.cast("int"), F.lit(97))).otherwise(F.pmod(s * 100 + F.ascii(c) - 55, F.lit(97)))

    return F.aggregate(F.split(moved, ""), F.lit(0), step)


def _fill(mention: Column, slot: str, new: Column) -> Column:
    """mention with the characters that match `slot` replaced by those of `new`, in order."""
    around, chars = F.split(mention, slot, -1), F.split(new, "")
    return F.array_join(F.zip_with(around, chars, lambda a, c: F.concat(a, F.coalesce(c, F.lit("")))), "")


#: Sounds of generated names by script: first and second half of a syllable.
SOUNDS = {
    "latin": ("b d f g k l m n p r s t v z br dr kl st", "a e i o u"),
    "cyrillic": ("б д ф г к л м н п р с т в з бр др кл ст", "а е и о у"),
    "greek": ("β δ φ γ κ λ μ ν π ρ σ τ ζ θ", "α ε ι ο"),
    "arabic": ("ب د ف ك ل م ن ر س ت ز ح", "ا ي و"),
    "han": ("田 中 山 川 村 木 林 森 石 原 小 高 松 本 上 大 野 井 佐 金 北 南 西 東", ""),
}
#: Endings of given and family names by script and gender.
ENDINGS = {("latin", "f"): "na", ("latin", "m"): "n", ("cyrillic", "f"): "ва", ("cyrillic", "m"): "в", ("greek", "f"): "α", ("greek", "m"): "ς"}


def _generated(hexed: Column, script: Column, gender: Column, attempt: Column) -> Column:
    """A name of three syllables (one more with each attempt) and its gender's ending."""

    def choice(half: int) -> Column:
        out = F.lit(None).cast("array<string>")
        for k, sounds in SOUNDS.items():
            out = F.when(script == k, F.array(*[F.lit(x) for x in sounds[half].split(" ")])).otherwise(out)
        return out

    def pick(values: Column, h: Column, i: Column) -> Column:
        return F.element_at(values, F.pmod(_byte(h, i), F.size(values)) + 1)

    ending = F.lit("")
    for (s, g), e in ENDINGS.items():
        ending = F.when((script == s) & (gender == g), e).otherwise(ending)
    syllables = _once(hexed, lambda h: F.array_join(F.transform(F.sequence(F.lit(0), attempt + 2), lambda i: F.concat(pick(choice(0), h, 2 * i), pick(choice(1), h, 2 * i + 1))), ""))
    return F.initcap(F.concat(syllables, ending))


def _space(kind: Column, norm: Column) -> Column:
    """How many surrogates a number's format has; null for what can grow."""
    length = F.length(norm)
    return F.when(kind == "phone", 8 * F.pow(F.lit(10.0), length - 1)).when(kind == "ssn", F.lit(665.0 * 99 * 9999)).when(kind == "card", F.pow(F.lit(10.0), length - 2)).when(kind == "ip", F.lit(254.0**4))


def with_crowded(entities: DataFrame) -> DataFrame:
    """entities with crowded: whether those of their format fill too much of it for chosen numbers."""
    kind, norm = F.col("kind"), F.col("norm")
    format_ = F.when(_space(kind, norm).isNotNull(), F.concat_ws("|", kind, F.when(kind != "ip", F.length(norm)), F.when(kind == "card", F.left(norm, F.lit(1)))))
    counts = entities.groupBy(format_.alias("format")).agg(F.count("*").alias("n"), F.first(_space(kind, norm)).alias("space")).where(f"n * {CROWDED} > space")
    full = [r.format for r in counts.collect()]  # formats, a few dozen at most
    return entities.withColumn("crowded", F.coalesce(format_.isin(full), F.lit(False)) if full else F.lit(False))


def _permuted(value: Column, name: Column, left_size: Column, right_size: Column, key: str) -> Column:
    """A keyed permutation of the numbers below left_size * right_size: eight rounds in which one half is shifted by a hash of the other."""

    def shift(r: Column, half: Column, size: Column) -> Column:
        hexed = F.sha2(F.concat_ws("|", F.lit(key), F.lit("permutation"), name, r, half).cast("binary"), 256)
        return F.pmod(F.conv(F.substr(hexed, F.lit(1), F.lit(12)), 16, 10).cast("bigint"), size)

    def step(acc: Column, r: Column) -> Column:
        a, b = acc["a"], acc["b"]
        return F.struct(F.when(r % 2 == 0, F.pmod(a + shift(r, b, left_size), left_size)).otherwise(a).alias("a"), F.when(r % 2 == 1, F.pmod(b + shift(r, a, right_size), right_size)).otherwise(b).alias("b"))

    start = F.struct(F.floor(value / right_size).cast("bigint").alias("a"), F.pmod(value, right_size).alias("b"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(7)), start, step, lambda acc: acc["a"] * right_size + acc["b"])


def _permuted_digits(digits: Column, name: Column, key: str) -> Column:
    """A keyed permutation of the digit strings of one length (18 at most)."""
    n = F.length(digits)
    ten = lambda k: F.rpad(F.lit("1"), k + 1, "0").cast("bigint")
    half = F.floor(n / 2).cast("int")
    return F.lpad(_permuted(digits.cast("bigint"), F.concat_ws("|", name, n), ten(half), ten(n - half), key).cast("string"), n, "0")


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """(kind, norm, attempt, crowded) with surrogate: the new normal form."""
    kind, norm, attempt = F.col("kind"), F.col("norm"), F.col("attempt")
    hexed = F.sha2(F.concat_ws("|", F.lit(key), kind, norm, attempt).cast("binary"), 512)
    local, domain = F.substring_index("norm", "@", 1), F.substring_index("norm", "@", -1)
    top = F.substring_index(domain, ".", -1)
    labels = F.substr(domain, F.lit(1), F.length(domain) - F.length(top))
    of_domain = F.sha2(F.concat_ws("|", F.lit(key), F.lit("domain"), domain).cast("binary"), 512)
    longer = F.when(attempt > 2, F.substr(hexed, F.lit(100), attempt)).otherwise("")
    email = F.concat(_chars(local, hexed), longer, F.lit("@"), _chars(labels, of_domain), top)
    ip = F.concat_ws(".", *[(F.pmod(_byte(hexed, F.lit(i)), F.lit(254)) + 1).cast("string") for i in range(4)])
    phone = F.concat((F.pmod(_byte(hexed, F.lit(63)), F.lit(8)) + 2).cast("string"), _chars(F.expr("substr(norm, 2)"), hexed))
    ssn = F.concat(*[F.lpad(_number(hexed, 6 * i, below).cast("string"), width, "0") for i, (below, width) in enumerate(((665, 3), (99, 2), (9999, 4)))])
    crowded = F.col("crowded")
    octets = F.split("norm", "[.]")
    number = F.aggregate(octets, F.lit(0).cast("bigint"), lambda acc, x: acc * 256 + x.cast("bigint"))
    moved = _permuted(number, kind, F.lit(65536).cast("bigint"), F.lit(65536).cast("bigint"), key)
    ip = F.when(crowded, _once(moved, lambda v: F.concat_ws(".", *[F.shiftright(v, 24 - 8 * i).bitwiseAND(255).cast("string") for i in range(4)]))).otherwise(ip)
    phone = F.when(crowded, _permuted_digits(norm, kind, key)).otherwise(phone)
    ssn = F.when(crowded, _permuted_digits(norm, kind, key)).otherwise(ssn)
    middle = F.substr(norm, F.lit(2), F.length(norm) - 2)
    rest = F.concat(F.left(norm, F.lit(1)), F.when(crowded, _permuted_digits(middle, F.concat_ws("|", kind, F.left(norm, F.lit(1))), key)).otherwise(_chars(middle, hexed)))
    card = F.concat(rest, F.pmod(luhn_sum(norm) - luhn_sum(F.concat(rest, F.lit("0"))), F.lit(10)).cast("string"))
    account, country = _chars(F.expr("substr(norm, 5)"), hexed), F.left(norm, F.lit(2))
    check = 98 - iban_remainder(F.concat(country, F.lit("00"), account))
    check = F.when(iban_remainder(norm) == 1, check).otherwise(check + 1)  # a false one stays false
    iban = F.concat(country, F.lpad(check.cast("string"), 2, "0"), account)
    script, gender = F.split_part("norm", F.lit("|"), F.lit(1)), F.split_part("norm", F.lit("|"), F.lit(2))
    named = _generated(hexed, script, gender, attempt)
    new = F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "phone", phone).when(kind == "ssn", ssn).when(kind == "iban", iban).when(kind == "card", card).otherwise(named)
    return entities.select("kind", "norm", "attempt", "crowded", new.alias("surrogate"))


def distinct_surrogates(parts: DataFrame, key: str) -> DataFrame:
    """(part_kind, norm, surrogate) of all distinct entities; no surrogate twice among those of a
    kind (all names are one), and none that is an entity of the corpus (but in crowded formats)."""
    is_name = F.col("kind").isin("given", "family")
    group = F.when(is_name, "name").otherwise(F.col("kind"))
    entities = parts.where("norm IS NOT NULL").select(F.col("part_kind").alias("kind"), "norm").distinct().withColumn("attempt", F.lit(0))
    entities = save(with_crowded(entities), "entities")
    table = save(surrogates(entities, key), "surrogates")
    drop(entities)
    for _ in range(ATTEMPTS):
        # what a text would show
        own = table.select("*", group.alias("group"), F.lower("surrogate").alias("shown"), F.concat_ws("|", "kind", "norm").alias("who"))
        taken = own.groupBy("group", "shown").agg(F.min("who").alias("keeper"), F.count("*").alias("n")).where("n > 1").drop("n")
        real = own.select("group", F.lower(F.when(is_name, F.split_part("norm", F.lit("|"), F.lit(3))).otherwise(F.col("norm"))).alias("shown"), F.lit(True).alias("real")).distinct()
        checked = own.join(taken, ["group", "shown"], "left").join(real, ["group", "shown"], "left")
        clash = ~F.col("crowded") & (F.coalesce("real", F.lit(False)) | F.coalesce(F.col("keeper") != F.col("who"), F.lit(False)))
        checked = save(checked.select("kind", "norm", "attempt", "crowded", clash.alias("clash")), "checked")
        if checked.where("clash").isEmpty():
            drop(checked)
            out = table.select(F.col("kind").alias("part_kind"), "norm", "surrogate")
            out.stored_at = table.stored_at
            return out
        new = save(surrogates(checked.select("kind", "norm", (F.col("attempt") + F.col("clash").cast("int")).alias("attempt"), "crowded"), key), "surrogates")
        drop(checked)
        drop(table)
        table = new
    raise RuntimeError(f"surrogates still collide after {ATTEMPTS} attempts")


def _in_format(mention: Column, kind: Column, surrogate: Column) -> Column:
    """The surrogate in the mention's format; names come part by part, in `surrogate` joined again."""
    digits = F.regexp_replace(mention, "[^0-9]", "")
    numbers = F.concat(F.left(digits, F.length(digits) - F.length(surrogate)), surrogate)
    title, after = F.regexp_extract(mention, _TITLE, 0), F.regexp_extract(mention, _AFTER, 0)
    name = F.substr(mention, F.length(title) + 1)
    capitals = (F.upper(name) == name) & (F.lower(name) != name)
    cased = F.when(capitals & (F.length(name) > 1), F.upper(surrogate)).otherwise(surrogate)
    return (
        F.when(kind.isin("phone", "card", "ssn"), _fill(mention, "[0-9]", numbers))
        .when(kind == "iban", _fill(mention, "[A-Z0-9]", surrogate))
        .when(kind == "name", F.concat(title, cased, after))
        .when(kind == "word", cased)
        .when((kind == "email") & (F.upper(mention) == mention), F.upper(surrogate))
        .otherwise(surrogate)
    )


def pseudonymise(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text", count_col: str = "n_entities") -> DataFrame:
    """docs with text_col replaced, and count_col: the number of mentions that were. Who knows the
    key can look surrogates up by trying entities, so it is kept secret."""
    if not key:
        raise ValueError("surrogates need a key")
    mentions = save(find_entities(docs, id_col, text_col), "mentions")
    parts = save(entity_parts(mentions), "parts")
    table = distinct_surrogates(parts, key)
    shown = parts.join(small(table, FEW_ROWS), ["part_kind", "norm"], "left")
    whole = shown.groupBy("id", "text_hash", "named", "position", "mention", "kind").agg(F.array_sort(F.collect_list(F.struct("part", "surrogate"))).alias("p"))
    joined = F.array_join(F.transform("p", lambda x: x["surrogate"]), " ")
    known = F.size(F.filter("p", lambda x: x["surrogate"].isNotNull())) > 0
    whole = whole.select("id", "text_hash", "named", "position", known.alias("known"), F.when(known, _in_format(F.col("mention"), F.col("kind"), joined)).otherwise(F.col("mention")).alias("new"))
    t_id, t_hash, t_named, t_new, t_n = free_names(docs, "id", "hash", "named", "new", "n")
    by_text = whole.groupBy(F.col("id").alias(t_id), F.col("text_hash").alias(t_hash)).agg(F.first("named").alias(t_named), F.array_sort(F.collect_list(F.struct("position", "new"))).alias(t_new), F.sum(F.col("known").cast("bigint")).alias(t_n))
    by_text = save(by_text.withColumn(t_new, F.transform(t_new, lambda x: x["new"])), "replacements")
    for t in (parts, mentions, table):
        drop(t)
    size = by_text.agg(F.count("*"), F.coalesce(F.sum(F.aggregate(t_new, F.lit(0).cast("bigint"), lambda s, x: s + F.length(x) + 16)), F.lit(0))).first()
    side = F.broadcast(by_text) if size[0] <= FEW_ROWS and size[1] <= FEW_BYTES else by_text
    rest = docs.drop(count_col)
    text = rest[f"`{text_col}`"]
    both = rest.join(side, rest[f"`{id_col}`"].eqNullSafe(side[t_id]) & (F.xxhash64(text) == side[t_hash]), "left")
    around = F.when(F.col(t_named), F.split(text, WITH_WORDS, -1)).otherwise(F.split(text, PATTERN, -1))
    done = F.array_join(F.zip_with(around, F.col(t_new), lambda a, n: F.concat(a, F.coalesce(n, F.lit("")))), "")
    new = F.when(F.col(t_new).isNotNull(), done).otherwise(text)
    return both.select(*[new.alias(c) if c == text_col else rest[f"`{c}`"] for c in rest.columns], F.coalesce(F.col(t_n), F.lit(0)).cast("bigint").alias(count_col))


def session_key(spark: SparkSession) -> str:
    """The key that the session's setting gridloom.pii.key names; where it is unset, a new one that
    nobody knows: surrogates then can't be looked up, nor compared between runs."""
    return spark.conf.get("gridloom.pii.key", None) or secrets.token_hex(32)


def op8_pii_surrogates(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pseudonymise(docs, session_key(spark)).select("doc_id", "n_entities", "text")
