"""Text, identity and list functions as column expressions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# The UUID standard's name space, and that of stored facts, whose identifiers must stay the same.
NAMESPACE_DNS = "6ba7b8109dad11d180b400c04fd430c8"
NAMESPACE_FACTS = "e2de504c45bb4531952ff33a6f60c945"


def blank_to_null(value: Column) -> Column:
    return F.nullif(F.trim(value), F.lit(""))


def slug_or_error(value: Column) -> Column:
    """Trimmed; blank is null; other characters than letters, digits, dot, underscore and hyphen are an error."""
    v = blank_to_null(value)
    return F.when(v.isNull(), v).when(v.rlike("^[a-zA-Z0-9._-]+$"), v).otherwise(F.raise_error(F.concat(F.lit("bad slug: "), v)).cast("string"))


def default_project(value: Column, default: str = "default") -> Column:
    return F.coalesce(blank_to_null(value), F.lit(default))


def surface(*headers: Column, fallback: str = "unknown") -> Column:
    return F.coalesce(*(F.substring(blank_to_null(F.lower(h)), 1, 64) for h in headers), F.lit(fallback))


def project_slug(raw: Column) -> Column:
    """Lower case, runs of other characters as one hyphen, reserved device names prefixed."""
    s = F.regexp_replace(F.regexp_replace(F.lower(raw), "[^a-z0-9-]+", "-"), "-{2,}", "-")
    s = F.regexp_replace(s, "^-+|-+$", "")
    return F.when(s.rlike("^(con|prn|aux|nul|com[1-9]|lpt[1-9])$"), F.concat(F.lit("proj-"), s)).otherwise(s)


def title_slug(title: Column) -> Column:
    """ASCII letters and digits, hyphenated; common accented Latin letters lose their accents, other characters go."""
    plain = F.translate(F.lower(title), "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
    s = F.regexp_replace(F.regexp_replace(plain, "[^\\x00-\\x7F]", ""), "[^a-z0-9]+", "-")
    return F.coalesce(F.nullif(F.regexp_replace(s, "^-+|-+$", ""), F.lit("")), F.lit("untitled"))


def content_hash(text: Column) -> Column:
    return F.md5(text)


def uuid5(name: Column, namespace: str = NAMESPACE_DNS) -> Column:
    """Deterministic identifier of a name: SHA-1 of namespace and name, with version and variant set."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex((F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 8))
    return F.concat_ws(
        "-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12)
    )


def fact_id(data: Column, user: Column, lane: Column, persona: Column, namespace: str = NAMESPACE_FACTS) -> Column:
    """Identifier of a fact: lane and persona keep their places where one of them is absent, and add nothing where both are."""
    blank = F.lit("")
    parted = F.concat(F.lit(":"), F.coalesce(lane, blank), F.lit(":"), F.coalesce(persona, blank))
    return uuid5(F.concat(F.md5(data), F.lit(":"), user, F.when(lane.isNull() & persona.isNull(), blank).otherwise(parted)), namespace)


def summary_id(project: Column, day: Column, start: Column, end: Column) -> Column:
    return F.concat(F.lit("session-"), day.cast("string"), F.lit("-"), F.substring(F.sha2(F.concat_ws("|", project, start, end), 256), 1, 8))


def word_tokens(text: Column) -> Column:
    """Lower case, split at white space, edge punctuation trimmed."""
    return F.filter(F.transform(F.split(F.lower(text), "\\s+"), lambda w: F.regexp_replace(w, r"^[\p{Punct}]+|[\p{Punct}]+$", "")), lambda w: w != "")


def ngrams(text: Column, n: int = 3) -> Column:
    """Distinct n-grams of a text.  Neighbouring words meet by zipping the list with itself shifted: a lambda that
    indexed the list would have it split anew for every n-gram."""
    words = F.filter(F.split(F.lower(text), "[^a-z0-9_]+"), lambda w: w != "")
    rest = lambda i: F.slice(words, i + 1, F.greatest(F.size(words) - n + 1, F.lit(0)))
    grams = rest(0)
    for i in range(1, n):
        grams = F.zip_with(grams, rest(i), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.coalesce(F.array_distinct(grams), F.array().cast("array<string>"))


def leaks(a: Column, b: Column, n: int = 3) -> Column:
    return F.arrays_overlap(ngrams(a, n), ngrams(b, n))


def wiki_links(text: Column) -> Column:
    """Targets of [[target|alias#heading]], trimmed, each once, in order."""
    found = F.regexp_extract_all(text, F.lit(r"\[\[([^\]|#]+)[^\]]*\]\]"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(found, lambda t: F.trim(t)), lambda t: t != ""))


def turn_headers(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?m)^## (\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?Z) (?:user|assistant|system)\b"), F.lit(1))


def reaction_total(reactions: Column) -> Column:
    """Sum of count less own over an array of structs (count, me, kind)."""
    return F.aggregate(reactions, F.lit(0).cast("bigint"), lambda s, r: s + F.greatest(r["count"] - r["me"].cast("bigint"), F.lit(0)))


def snowflake_time(id_: Column) -> Column:
    return F.timestamp_millis(F.shiftright(id_, 22) + F.lit(1420070400000))


def verdict(raw: Column) -> Column:
    """A judge's JSON, fenced or bare; whatever can't be read says no with confidence 0."""
    bare = F.regexp_replace(raw, r"(?s)^\s*```(?:json)?\s*|\s*```\s*$", "")
    got = F.from_json(bare, "contradicts boolean, confidence double")
    return F.struct(F.coalesce(got["contradicts"], F.lit(False)).alias("contradicts"), F.coalesce(got["confidence"], F.lit(0.0)).alias("confidence"))


def front_matter(text: Column) -> Column:
    """Flat keys of a fenced header as a map; an empty map without one."""
    head = F.regexp_extract(text, r"(?s)^---\r?\n(.*?)\r?\n---", 1)
    lines = F.filter(F.split(head, "\r?\n"), lambda x: x.contains(":"))
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)), F.trim(F.substr(x, F.instr(x, ":") + 1))))
    return F.map_from_entries(pairs)


def body(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)^---\r?\n.*?\r?\n---\r?\n?", "")


def rare_tokens(text: Column) -> Column:
    """Mail addresses and numbers of three digits or more."""
    return F.regexp_extract_all(text, F.lit(r"[\w.-]+@[\w.-]+|\d{3,}"), F.lit(0))


# What makes a word an entity by its shape alone.
ENTITY_SHAPES = (
    r"^[\w.-]+@[\w.-]+$", r"^@\w+$", r"^[A-Za-z0-9-]+\.[A-Za-z]{2,}(/[\w./-]*)?$", r"^(?:.*[a-zA-Z].*[\\/].*|.*[\\/].*[a-zA-Z].*)$", r"^[A-Z]{2,5}$",
    r"^[A-Za-z0-9+/=]*(?:[0-9][A-Za-z0-9+/=]*[A-Za-z]|[A-Za-z][A-Za-z0-9+/=]*[0-9])[A-Za-z0-9+/=]*$",
)
EDGES = r"^[('\"`‘“…]+|[)'\"`,.;:!?’”]+$"


def entity_tokens(text: Column) -> Column:
    """Words shaped like a mail address, handle, domain, path, short name in capitals or code of letters and digits, without
    marks at their edges, and numbers of three digits or more; each once."""
    bare = F.transform(F.split(text, r"[ \t\n\f\r]+"), lambda w: F.regexp_replace(w, EDGES, ""))
    least = {3: 4, 5: 12}

    def shaped(w: Column) -> Column:
        hits = [w.rlike(p) & (F.length(w) >= least.get(i, 1)) for i, p in enumerate(ENTITY_SHAPES)]
        return reduce(or_, hits)

    return F.array_distinct(F.concat(F.filter(bare, shaped), F.regexp_extract_all(text, F.lit(r"\d{3,}"), F.lit(0))))


def capped(text: Column, limit: int) -> Column:
    """The first ``limit`` characters and a mark that more followed."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("\n..."))).otherwise(text)


def byte_pieces(text: Column, budget: int) -> Column:
    """The text in pieces of at most ``budget`` bytes, cut between characters (a character has four bytes at most)."""
    step = budget // 4
    n = F.greatest(F.ceil(F.length(text) / step), F.lit(0)).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.substr(text, (i - 1) * step + 1, F.lit(step)))).otherwise(F.array().cast("array<string>"))
