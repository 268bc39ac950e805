"""Surrogates for personal data, with DataFrame functions only.

Entities (addresses of mail and of the network, phone, card and account
numbers, secrets, names after a title) are detected by one pattern.  Every
distinct entity gets a replacement derived from a key: of the same type and
format (separators, lengths, letter case, the check digit of a card number),
names by gender and script.  Mentions of one entity, however they are spelt,
get the same replacement.  Replacements that meet one another or an entity
that occurs are derived anew until all are distinct.

Only rows with entities are shuffled.  Mentions meet the table of replacements
in a shuffle; an entity with many mentions has a copy for every ``MENTIONS`` of
them, so that one that a third of all rows mention is spread.  Joins on
entities are sort-merge joins whatever their estimated size, so that the
driver holds no table of entities.

Defined results: null stays null; empty texts and texts without entities are
returned as they are; repeated rows are replaced alike; null ids are allowed;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstead.session import written

KEY = "loomstead-surrogates-1"
MENTIONS = 256
ROUNDS = 60

# Patterns of entities, in the order in which they are tried.
MALE_TITLES = r"Mr|Mister|Herr|Monsieur|Señor|Sr\.|г-н|господин"
FEMALE_TITLES = r"Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra\.|г-жа|госпожа"
# Words with capitals within and parts after hyphens or apostrophes, and initials; as many as follow, up to the next title.
WORD = r"(?:(?:\p{Lu}\.)++(?:-\p{Lu}\.)*+|\p{Lu}[\p{L}\p{M}]*+(?:['’-][\p{L}\p{M}]++)*+)"
NAME = rf"{WORD}(?: ?(?<=[ .])(?!(?:{MALE_TITLES}|{FEMALE_TITLES})\.? \p{{Lu}}){WORD})*+"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@(?:[A-Za-z0-9\-]++\.){1,126}[A-Za-z]{2,24}",  # a name has 127 labels at most
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": r"(?<![\d\-])\d{4}([ \-]?)\d{4}\1\d{4}\1\d{4}(?!\d)",
    "phone": r"(?<![\w])\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .\-]?\d{2,4}){2,4}(?!\d)|(?<![\w(])\(\d{3}\) \d{3}-\d{4}(?!\d)",
    "ssn": r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])",
    "secret": r"(?<![A-Za-z0-9])(?:[0-9a-f]{64}|[0-9a-f]{40}|[0-9a-f]{32}|[0-9A-F]{64}|[0-9A-F]{40}|[0-9A-F]{32})(?![A-Za-z0-9])",
    "male": rf"(?<![\p{{L}}])(?:{MALE_TITLES})\.? {NAME}",
    "female": rf"(?<![\p{{L}}])(?:{FEMALE_TITLES})\.? {NAME}",
}
# Entities begin where no ASCII letter or digit stands before, numbers also after a letter and titles after a digit:
# this look spares the patterns most places.
BEGIN = r"(?:(?<![A-Za-z0-9])|(?=\d)(?<=[A-Za-z])|(?=[MHFSг])(?<=\d))"
ANY = (BEGIN + "(?:" + "|".join(f"(?:{p})" for p in PATTERNS.values()) + ")").replace(r"([ \-]?)\d{4}\1\d{4}\1\d{4}", r"(?:(?:\d{4}){3}|(?: \d{4}){3}|(?:-\d{4}){3})")

# Country calling codes (those of one and two digits; the others have three).
CALLING_CODE = r"^\+(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"

# Given names by gender and syllables of surnames, by script.
GIVEN = {
    ("male", "latin"): "Adrian Bruno Casper Dario Emil Felix Gustav Hugo Ivo Jonas Karel Leon".split(),
    ("female", "latin"): "Alma Bianca Clara Dora Elsa Frida Greta Hanna Ida Johanna Klara Lena".split(),
    ("male", "cyrillic"): "Антон Борис Виктор Глеб Денис Егор Захар Игорь Кирилл Лев Макар Никита".split(),
    ("female", "cyrillic"): "Анна Белла Вера Галина Дарья Елена Жанна Зоя Инна Клара Лидия Майя".split(),
}
SYLLABLES = {
    "latin": "bar ben dal den far fin gar gil hol ken lan lor mar nor pel rin sal tor van wes zel mon tal rud".split(),
    "cyrillic": "бар вел гор дан жел зар кам лар мир нов ост пер ров сав тар улв фил хол цер чар шам щед юр ям".split(),
}


def kind_of(mention: Column) -> Column:
    """Type of a mention found by ``ANY``."""
    out = None
    for kind, pattern in PATTERNS.items():
        hit = mention.rlike(f"^(?:{pattern})$")
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise("phone")


def norm_of(kind: Column, mention: Column) -> Column:
    """What mentions of one entity have in common."""
    digits = F.regexp_replace(mention, r"\D", "")
    name = F.lower(F.regexp_replace(mention, rf"^(?:{MALE_TITLES}|{FEMALE_TITLES})\.? ", ""))
    return (
        F.when(kind.isin("card", "ssn"), digits).when(kind == "phone", F.concat(F.when(mention.startswith("+"), "+").otherwise(""), digits))
        .when(kind == "iban", F.upper(F.regexp_replace(mention, " ", "")))
        .when(kind.isin("male", "female"), name)
        .otherwise(F.lower(mention))
    )


def _hash(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\u0001", F.lit(KEY), *parts), 256)


def _pick(h: Column, i: Column | int, n: int) -> Column:
    """A number below ``n`` from bytes ``i`` of a hash."""
    at = (F.lit(i) if isinstance(i, int) else i) * 3 % 60 + 1
    return (F.conv(F.substr(h, at.cast("int"), F.lit(4)), 16, 10).cast("int") % n).cast("int")


def _letters(value: Column, h: Column) -> Column:
    """Letters become letters and digits digits; all else stays."""
    one = lambda c, i: (
        F.when(c.rlike("^[0-9]$"), _pick(h, i, 10).cast("string"))
        .when(c.rlike("^[a-z]$"), F.char(F.lit(97) + _pick(h, i, 26)))
        .when(c.rlike("^[A-Z]$"), F.char(F.lit(65) + _pick(h, i, 26)))
        .otherwise(c)
    )
    return F.array_join(F.transform(F.split(value, ""), one), "")


def _luhn(digits: Column) -> Column:
    """Luhn sum of a digit string, modulo 10 (the last digit has weight 1)."""
    turned = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.coalesce(c.try_cast("int"), F.lit(0)) * F.when(i % 2 == 1, 2).otherwise(1))
    return F.aggregate(turned, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x)) % 10


def surrogate_of(kind: Column, norm: Column, attempt: Column) -> Column:
    """Replacement of an entity's normal form, of the same length and kind of characters."""
    h = _hash(kind, norm, attempt.cast("string"))
    domain = F.regexp_extract(norm, "@(.*)$", 1)
    stem, top = F.regexp_extract(domain, r"^(.*)\.[^.]*$", 1), F.regexp_extract(domain, r"(\.[^.]*)$", 1)
    more = F.substr(h, F.lit(1), F.floor(attempt / 20).cast("int"))  # where short names crowd, longer ones
    email = F.concat(_letters(F.regexp_extract(norm, "^(.*)@", 1), h), more, F.lit("@"), _letters(stem, _hash(F.lit("domain"), domain)), top)
    octet = lambda i: (_pick(h, i, 254) + 1).cast("string")
    ip = F.concat_ws(".", octet(0), octet(1), octet(2), octet(3))
    card = _letters(F.substr(norm, F.lit(1), F.length(norm) - 1), h)
    last = F.pmod(_luhn(norm) - _luhn(F.concat(card, F.lit("0"))), F.lit(10))
    card = F.concat(card, last.cast("string"))
    iban = F.concat(F.substr(norm, F.lit(1), F.lit(2)), _letters(F.substr(norm, F.lit(3)), h))
    secret = F.array_join(F.transform(F.split(norm, ""), lambda c, i: F.when(c.rlike("^[0-9a-f]$"), F.substr(h, (i % 64 + 1).cast("int"), F.lit(1))).otherwise(c)), "")
    # The country code stays, in whatever format the number is written.
    code = F.regexp_extract(norm, CALLING_CODE, 0)
    phone = F.concat(F.substr(code, F.lit(2)), _letters(F.substr(norm, F.length(code) + 1), h))
    names = None
    for script in ("cyrillic", "latin"):
        syllables = F.array(*map(F.lit, SYLLABLES[script]))
        count = F.lit(3) + F.floor(attempt / 8).cast("int")
        surname = F.initcap(F.array_join(F.transform(F.sequence(F.lit(0), count), lambda i: F.get(syllables, _pick(h, i + 5, 24))), ""))  # noqa: B023
        given = F.when(kind == "male", F.get(F.array(*map(F.lit, GIVEN["male", script])), _pick(h, 1, 12))).otherwise(
            F.get(F.array(*map(F.lit, GIVEN["female", script])), _pick(h, 1, 12))
        )
        full = F.when(norm.contains(" "), F.concat_ws(" ", given, surname)).otherwise(surname)
        names = F.when(norm.rlike(r"\p{IsCyrillic}"), full) if names is None else names.otherwise(full)
    return (
        F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "card", card).when(kind == "iban", iban)
        .when(kind == "secret", secret).when(kind.isin("male", "female"), names).otherwise(phone)
    )


def shaped(kind: Column, mention: Column, norm: Column, surrogate: Column) -> Column:
    """The surrogate in a mention's own format."""
    spread = F.array_join(
        F.transform(
            F.split(mention, ""),
            lambda c, i: F.when(
                c.rlike("^[0-9A-Za-z]$"), F.substr(surrogate, F.length(F.regexp_replace(F.substr(mention, F.lit(1), (i + 1).cast("int")), "[^0-9A-Za-z]", "")), F.lit(1))
            ).otherwise(c),
        ),
        "",
    )
    title = F.regexp_extract(mention, rf"^((?:{MALE_TITLES}|{FEMALE_TITLES})\.? )", 1)
    cased = F.when((mention == F.upper(mention)) & (mention != F.lower(mention)), F.upper(surrogate)).otherwise(surrogate)
    return (
        F.when(kind.isin("phone", "card", "ssn", "iban"), spread)
        .when(kind.isin("male", "female"), F.concat(title, surrogate)).otherwise(cased)
    )


def assign(entities: DataFrame) -> DataFrame:
    """``kind``, ``norm`` and distinct ``surrogate`` of each distinct entity.

    A round keeps, of the entities that got one surrogate, the least, if no
    entity and no surrogate kept before looks so; the others go on.
    """
    # Names of either gender look alike, and no look depends on case.
    look = lambda value: F.concat(F.when(F.col("kind").isin("male", "female"), "name").otherwise(F.col("kind")), F.lit(":"), F.lower(value))
    plain = F.regexp_replace("norm", r"^\+", "")
    todo, kept = entities, None
    taken = entities.select(look(plain).alias("look"))
    for attempt in range(ROUNDS):
        made = todo.withColumn("surrogate", surrogate_of(F.col("kind"), F.col("norm"), F.lit(attempt)))
        made = written(made.withColumn("look", look(F.col("surrogate"))))
        first = made.withColumn("r", F.row_number().over(Window.partitionBy("look").orderBy("norm", "kind"))).where("r = 1").drop("r")
        good = written(first.join(taken.hint("shuffle_merge"), "look", "left_anti").select("kind", "norm", "surrogate", "look"))
        told = good.select("kind", "norm", "surrogate")
        kept = told if kept is None else kept.union(told)
        todo = written(made.select("kind", "norm").join(good.hint("shuffle_merge"), ["kind", "norm"], "left_anti"))
        if not todo.limit(1).count():
            return kept
        taken = taken.union(good.select("look"))
    raise RuntimeError(f"surrogates still collide after {ROUNDS} rounds")


def replace_private(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, the ``text`` with replacements, and ``n_entities`` (mentions) for each row of ``docs``."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    has = F.coalesce(F.col("text").rlike(ANY), F.lit(False))
    dirty = base.where(has).withColumn("row", F.xxhash64("text"))
    found = dirty.select("doc_id", "row", F.posexplode(F.regexp_extract_all("text", F.lit(ANY), F.lit(0))).alias("at", "mention"))
    found = found.distinct().withColumn("kind", kind_of(F.col("mention"))).withColumn("norm", norm_of(F.col("kind"), F.col("mention")))
    found = written(found)
    counted = written(found.groupBy("kind", "norm").agg(F.ceil(F.count("*") / MENTIONS).alias("copies")))
    heavy = F.broadcast(counted.where("copies > 1"))  # at most one for every MENTIONS mentions
    copies = F.coalesce("copies", F.lit(1))
    table = assign(counted.select("kind", "norm")).join(heavy, ["kind", "norm"], "left").withColumn("salt", F.explode(F.sequence(F.lit(0), copies - 1))).drop("copies")
    salted = found.join(heavy, ["kind", "norm"], "left").withColumn("salt", F.pmod(F.xxhash64("doc_id", "row", "at"), copies))
    mapped = salted.join(table.hint("shuffle_merge"), ["kind", "norm", "salt"])
    mapped = mapped.select("doc_id", "row", "at", shaped(F.col("kind"), F.col("mention"), F.col("norm"), F.col("surrogate")).alias("by"))
    lists = mapped.groupBy("doc_id", "row").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "by"))), lambda x: x["by"]).alias("by"))
    joined = dirty.alias("d").join(lists.alias("l"), F.col("d.doc_id").eqNullSafe(F.col("l.doc_id")) & (F.col("d.row") == F.col("l.row")))
    rest = F.split("text", ANY, -1)
    text = F.array_join(F.transform(rest, lambda p, i: F.concat(p, F.coalesce(F.get("by", i), F.lit("")))), "")
    replaced = joined.select(F.col("d.doc_id").alias("doc_id"), text.alias("text"), F.size("by").cast("bigint").alias("n_entities"))
    return base.where(~has).select("doc_id", "text", F.lit(0).cast("bigint").alias("n_entities")).union(replaced)
