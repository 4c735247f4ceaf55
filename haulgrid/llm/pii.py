"""Surrogates for personal data: every detected entity gets a keyed replacement of its own type, the same one wherever it
appears and no one else's. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulgrid.llm.common import stored

#: Titles that show the gender of the name after them.
FEMALE = ("Mrs", "Ms", "Miss", "Madam", "Madame", "Mme", "Frau", "Señora", "Doña")
MALE = ("Mr", "Sir", "Monsieur", "Herr", "Señor", "Don")
_NAME = r"\p{Lu}\p{Ll}{1,60}(?!\p{Ll})"
_TITLE = "(?:" + "|".join(sorted((*FEMALE, *MALE), key=len, reverse=True)) + r")\.?"

#: Kinds in the order in which they are tried at a place. All parts are bounded: an address as mail and name servers bound it (64
#: before the @, labels of 63, 127 labels), a name by 60 letters. What is longer is none, and costs neither stack nor time.
KINDS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,125}\.[A-Za-z]{2,63}",
    "ip": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\.[0-9])",
    "card": r"(?<![0-9])[0-9]{4}(?:[ -]?[0-9]{4}){3}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"\+[0-9]{1,3}[ .-]?\(?[0-9]{1,4}\)?(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])|(?<![0-9])\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9])|(?<![0-9-])[0-9]{3}-[0-9]{3}-[0-9]{4}(?![0-9-])",
    "person": rf"(?<!\p{{L}}){_TITLE} {_NAME}(?: {_NAME})?",
}
PATTERN = "|".join(f"(?:{p})" for p in KINDS.values())
#: Without one of these a text is not searched.
HINT = rf"[@0-9]|{_TITLE} \p{{Lu}}"

_LATIN, _CYRILLIC, _GREEK = "abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнопрстуфхцчшщэюя", "αβγδεζηθικλμνξοπρστυφχψω"
_CONSONANTS, _VOWELS = "bcdfgklmnprstvz", "aeiou"


def kind_of(entity: Column) -> Column:
    """The kind whose pattern the entity is; the first in order."""
    out = None
    for kind in reversed(KINDS):
        # The neighbours that look-arounds saw are not in the entity, and nothing is there to contradict them.
        hit = entity.rlike(f"^(?:{KINDS[kind]})$")
        out = F.when(hit, F.lit(kind)) if out is None else F.when(hit, F.lit(kind)).otherwise(out)
    return out


def _is_female(name: Column) -> Column:
    return F.lower(name).rlike("^(?:" + "|".join(t.lower() for t in FEMALE) + r")\b")


def canonical_parts(kind: Column, entity: Column) -> Column:
    """What of an entity gets surrogates, in a form that all its spellings share: numbers as their digits (a phone without
    a country code has the 1 that its form implies), persons as the class of the title and, each for itself, the names
    after it, anything else in lower case. Names with titles of one class and equal surnames so share the surname."""
    digits = F.regexp_replace(entity, "[^0-9]", "")
    words = F.slice(F.split(F.lower(entity), " "), 2, 2)
    title = F.when(_is_female(entity), F.lit("mrs ")).otherwise(F.lit("mr "))
    return (
        F.when(kind == "person", F.transform(words, lambda w: F.concat(title, w)))
        .when((kind == "phone") & ~entity.startswith("+"), F.array(F.concat(F.lit("1"), digits)))
        .when(kind.isin("card", "ssn", "phone"), F.array(digits))
        .otherwise(F.array(F.lower(entity)))
    )


def _pick(letters: str, value: Column) -> Column:
    return F.substring(F.lit(letters), F.pmod(value, F.lit(len(letters))).cast("int") + 1, F.lit(1))


def check_sum(digits: Column) -> Column:
    """Luhn sum of the first 16 of an array of digits, modulo 10: 0 for a valid card number."""
    doubled = F.transform(F.slice(digits, 1, 16), lambda c, i: c.try_cast("int") * F.when(i % 2 == 0, 2).otherwise(1))
    return F.aggregate(doubled, F.lit(0), lambda s, d: s + d - F.when(d > 9, 9).otherwise(0)) % 10


def surrogate(kind: Column, canonical: Column, secret: str, attempt: Column) -> Column:
    """The replacement of a canonical entity: an HMAC-like digest of key, kind, entity and attempt chooses every character
    within its class, so punctuation, digits, script and (for persons) gender stay, and at first the length. Every further
    attempt makes a name longer by two letters, and from the fourth on an email by one: there is always a free one.
    The leading 1 of eleven-digit phones stays, as spellings without it must tell numbers apart too. The last digit of a card is
    chosen so that its check sum stays: valid numbers get valid ones, others none that look valid."""
    inner = F.sha2(F.concat_ws("|", F.lit(secret), kind, canonical, attempt.cast("string")), 256)
    more = F.when(kind == "person", 2 * attempt).when(kind == "email", F.greatest(attempt - 3, F.lit(0))).otherwise(F.lit(0)).cast("int")
    length = F.length(canonical) + more
    # Enough digits for any length: a digest per 32 characters.
    blocks = F.sequence(F.lit(0), F.floor(length / 32).cast("int"))
    stream = F.array_join(F.transform(blocks, lambda k: F.sha2(F.concat_ws("|", F.lit(secret), inner, k.cast("string")), 256)), "")
    value = lambda i: F.conv(F.substring(stream, 2 * i + 1, F.lit(2)), 16, 10).cast("int")
    female = _is_female(canonical)
    title = F.length(F.regexp_extract(canonical, r"^[^ ]+ ", 0))
    tail = F.length(F.regexp_extract(canonical, r"\.[^.]*$", 0))  # the top-level domain

    def letter(c: Column, i: Column) -> Column:
        v = value(i)
        return (
            F.when(c.rlike("[0-9]"), F.when(v == 0, F.lit("7")).otherwise(F.pmod(v, F.lit(10)).cast("string")))
            .when(c.rlike(r"\p{IsCyrillic}"), _pick(_CYRILLIC, v)).when(c.rlike(r"\p{IsGreek}"), _pick(_GREEK, v))
            .when(c.rlike(r"\p{L}"), _pick(_LATIN, v)).otherwise(c)
        )

    def named(c: Column, i: Column) -> Column:
        v = value(i)
        plain = F.when(F.pmod(i, F.lit(2)) == 0, _pick(_CONSONANTS, v)).otherwise(_pick(_VOWELS, v))
        ending = F.when(i + 1 == length, F.when(female, F.lit("a")).otherwise(F.lit("o"))).otherwise(plain)
        return F.when(i < title, c).when(c.rlike(r"\p{IsCyrillic}|\p{IsGreek}"), letter(c, i)).when(c.rlike(r"\p{L}"), ending).otherwise(c)

    chars = F.split(canonical, "")
    longer = F.concat(chars, F.array_repeat(F.substring(canonical, -1, 1), more))
    mailed = F.concat(F.array_repeat(F.lit("x"), more), chars)
    prefix = F.when((kind == "phone") & canonical.rlike("^1[0-9]{10}$"), 1).otherwise(0)
    # The last of sixteen digits has weight 1, so the sum without it tells the digit that is needed.
    body = F.transform(F.slice(chars, 1, 15), letter)
    last = F.pmod(check_sum(chars) - check_sum(body), F.lit(10)).cast("string")
    octets = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: (F.pmod(value(k), F.lit(254)) + 1).cast("string")), ".")
    return (
        F.when(kind == "ip", octets)
        .when(kind == "card", F.concat(F.array_join(body, ""), last))
        .when(kind == "person", F.array_join(F.transform(longer, named), ""))
        .when(kind == "email", F.array_join(F.transform(mailed, lambda c, i: F.when(i >= length - tail, c).otherwise(letter(c, i))), ""))
        .otherwise(F.array_join(F.transform(chars, lambda c, i: F.when(i < prefix, c).otherwise(letter(c, i))), ""))
    )


def assign_surrogates(entities: DataFrame, secret: str, most_attempts: int = 64) -> DataFrame:
    """`kind, canonical, surrogate` for the distinct entities (`kind, canonical`, see `canonical_parts`), a stored table.

    Collision checks: a surrogate that two entities of a kind share, or that is itself an entity of the corpus, goes to none
    but the least of those entitled; the others try again with the next attempt number, against everything assigned.
    """
    real = stored(entities.distinct(), "entities")
    trial = real.withColumn("attempt", F.lit(0))
    for _ in range(most_attempts):
        trial = stored(trial.select("kind", "canonical", "attempt", surrogate(F.col("kind"), F.col("canonical"), secret, F.col("attempt")).alias("surrogate")), "trial")
        owners = trial.groupBy("kind", "surrogate").agg(F.min(F.struct("attempt", "canonical")).alias("_first"))
        taken = real.select("kind", F.col("canonical").alias("surrogate"), F.lit(True).alias("_real"))
        judged = trial.join(owners, ["kind", "surrogate"]).join(taken, ["kind", "surrogate"], "left")
        lost = F.coalesce("_real", F.lit(False)) | (F.col("_first.canonical") != F.col("canonical"))
        judged = stored(judged.select("kind", "canonical", "attempt", "surrogate", lost.alias("lost")), "judged")
        if judged.filter("lost").isEmpty():
            return judged.select("kind", "canonical", "surrogate")
        trial = judged.select("kind", "canonical", (F.col("attempt") + F.col("lost").cast("int")).alias("attempt"))
    raise ValueError(f"no distinct surrogates after {most_attempts} attempts: a kind has more entities than replacements")


def _as_written(kind: Column, entity: Column, first: Column, second: Column) -> Column:
    """The surrogates of an entity's one or two parts in its own spelling: its separators, capitals and title."""
    upper = entity.rlike(r"\p{Lu}")
    grown = F.greatest(F.length(first) - F.length(entity), F.lit(0))
    own = lambda i: F.substring(entity, F.greatest(i - grown, F.lit(0)) + 1, F.lit(1))
    cased = F.transform(F.split(first, ""), lambda c, i: F.when(own(i).rlike(r"\p{Lu}"), F.upper(c)).otherwise(c))
    # Digits are counted from the right: a spelling may lack the country code.
    after = lambda i: F.length(F.regexp_replace(F.substring(entity, i + 1, F.length(entity)), "[^0-9]", ""))
    numbered = F.transform(F.split(entity, ""), lambda c, i: F.when(c.rlike("[0-9]"), F.substring(first, F.length(first) - after(i) + 1, F.lit(1))).otherwise(c))
    name = lambda word: F.initcap(F.regexp_extract(word, "[^ ]+$", 0))
    return (
        F.when(kind == "person", F.concat_ws(" ", F.regexp_extract(entity, "^[^ ]+", 0), name(first), name(second)))
        .when(kind.isin("card", "ssn", "phone"), F.array_join(numbered, ""))
        .when(upper, F.array_join(cased, ""))
        .otherwise(first)
    )


def pseudonymise(keyed: DataFrame, secret: str) -> DataFrame:
    """`keyed` (`_row`, `text`, more) with `text` replaced and `entities` added: array of (place, kind, entity, surrogate).

    Matches are leftmost and do not overlap. Spellings of one canonical form (`canonical_parts`) are the same entity. Texts come back from one join by `_row`; the assignment is joined by entity, which adaptive execution
    splits where an entity is in very many texts. Null texts stay null and, as empty ones, have no entities.
    """
    hinted = F.col("text").rlike(HINT)
    found = F.when(hinted, F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0)))
    entities = keyed.select("_row", F.posexplode(found).alias("place", "entity")).withColumn("kind", kind_of(F.col("entity")))
    parts = canonical_parts(F.col("kind"), F.col("entity"))
    places = stored(entities.select("_row", "place", "kind", "entity", F.posexplode(parts).alias("part", "canonical")), "places")
    known = assign_surrogates(places.select("kind", "canonical"), secret)
    item = F.struct("place", "part", "kind", "entity", "surrogate")
    items = places.join(known, ["kind", "canonical"]).groupBy("_row").agg(F.array_sort(F.collect_list(item)).alias("_items"))
    # The second part of an entity stands right behind the first.
    both = F.transform("_items", lambda x, i: F.struct(x.alias("x"), F.get("_items", i + 1).alias("y")))
    whole = F.filter(both, lambda b: b["x"]["part"] == 0)

    def written(b: Column) -> Column:
        second = F.when(b["y"]["place"] == b["x"]["place"], b["y"]["surrogate"])
        made = _as_written(b["x"]["kind"], b["x"]["entity"], b["x"]["surrogate"], second)
        return F.struct(b["x"]["place"].alias("place"), b["x"]["kind"].alias("kind"), b["x"]["entity"].alias("entity"), made.alias("surrogate"))

    by_row = items.select("_row", F.transform(whole, written).alias("_entities"))
    gaps = F.split("text", PATTERN, -1)
    pieces = F.zip_with(gaps, F.col("_entities.surrogate"), lambda g, s: F.concat(g, F.coalesce(s, F.lit(""))))
    none = F.array().cast("array<struct<place:int,kind:string,entity:string,surrogate:string>>")
    joined = keyed.join(by_row, "_row", "left")
    text = F.when(F.col("_entities").isNull(), F.col("text")).otherwise(F.array_join(pieces, ""))
    return joined.withColumn("text", text).withColumn("entities", F.coalesce("_entities", none)).drop("_entities")
