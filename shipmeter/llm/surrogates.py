"""Personal data replaced by keyed surrogates of the same type and form.

Entities are found by one pattern.  A surrogate is a keyed permutation of the entity's
letters and digits: in each of four rounds every other character moves within its own
alphabet by an amount hashed from the key and the characters that stay, so two
entities of one form never share a surrogate, an entity has the same one everywhere,
and punctuation, case, script and length stay.  Card numbers keep their check digit,
addresses their number range; given names move within the names of their gender and
script.

What the permutation alone does not exclude is checked over the whole corpus: a surrogate
that stands for two entities, or that is itself an entity of the corpus, is dealt anew
with the next attempt number until none is left.  The check shuffles distinct entities,
not texts.  DataFrame functions only.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shipmeter.session import materialize

ROUNDS = 4
ATTEMPTS = 6
LATIN, CYRILLIC, DIGITS = "abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "0123456789"

#: Given names by gender and script; a name is replaced by another of its list.
NAMES = {
    "female": "Anna Alice Clara Diana Elena Emma Eva Greta Helen Irene Julia Karin Laura Lucy Maria Martha Nina Olivia Paula Rosa Sarah Sofia".split(),
    "male": "Adam Albert Anton Bruno Carl David Eric Felix Frank George Hans Henry Jack James John Lucas Mark Martin Oscar Paul Peter Robert Thomas Victor".split(),
    "female_cyrillic": "Анна Вера Дарья Елена Ирина Мария Наталья Ольга Светлана Татьяна".split(),
    "male_cyrillic": "Алексей Борис Виктор Дмитрий Иван Михаил Николай Олег Павел Сергей".split(),
}
TITLES = "Mrs Ms Miss Mr Dr Prof Frau Herr Madame Mme Monsieur Señora Sra Señor Sr".split()

_OCTET = "(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_SURNAME = "\\p{Lu}\\p{L}+"
PATTERNS = {
    "email": "(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)*?\\.[A-Za-z]{2,}+(?![A-Za-z0-9-])",
    "ip": f"(?<![0-9.])(?:{_OCTET}\\.){{3}}{_OCTET}(?![0-9]|\\.[0-9])",
    "card": "(?<![0-9A-Za-z])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])",
    "ssn": "(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": "(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "phone": "(?<![0-9A-Za-z.+])(?:\\+[0-9]{1,3}[ .-]?(?:\\([0-9]{1,4}\\)[ .-]?)?|\\([0-9]{2,4}\\)[ .-]?|[0-9]{3}[ .-])[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}(?![0-9A-Za-z])",
    "name": f"(?<!\\p{{L}})(?:(?:{'|'.join(TITLES)})\\.? {_SURNAME}(?: {_SURNAME})?|(?:{'|'.join(n for names in NAMES.values() for n in names)}) {_SURNAME})",
}
ENTITY = "|".join(PATTERNS.values())


def kind_of(value: Column) -> Column:
    digits = F.length(F.regexp_replace(value, "[^0-9]", ""))
    return (
        F.when(value.contains("@"), "email")
        .when(value.rlike(f"^(?:{_OCTET}\\.){{3}}{_OCTET}$"), "ip")
        .when(value.rlike("^[A-Z]{2}[0-9]{2}"), "iban")
        .when(value.rlike("^\\p{L}"), "name")
        .when((digits >= 13) & value.rlike("^[0-9 -]+$"), "card")
        .when(value.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ssn")
        .otherwise("phone")
    )


def core(kind: Column, value: Column) -> Column:
    """What two spellings of one entity share: no case and, but for mail, no punctuation."""
    plain = F.lower(value)
    return (
        F.when(kind.isin("email", "ip"), plain)
        .when(kind == "name", F.regexp_replace(plain, "\\.", ""))
        .otherwise(F.regexp_replace(plain, "[^\\p{L}\\p{N}]", ""))
    )


def _moved(c: Column, by: Column) -> Column:
    out = c
    for alphabet in (LATIN, CYRILLIC, DIGITS):
        place = F.call_function("instr", F.lit(alphabet), c)
        at = F.pmod(place - 1 + by, F.lit(len(alphabet))) + 1
        out = F.when(place > 0, F.call_function("substring", F.lit(alphabet), at.cast("int"), F.lit(1))).otherwise(out)
    return out


def permuted(text: Column, tweak: Column) -> Column:
    """A keyed permutation of the lower-case letters and digits of ``text``."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")

    def turn(held: Column, r: Column) -> Column:
        still = F.array_join(F.transform(held, lambda c, i: F.when((i + r) % 2 == 1, c).otherwise(F.lit("\x01"))), "")
        digest = F.sha2(F.concat_ws("\x02", tweak, r.cast("string"), still), 256)

        def by(i: Column) -> Column:
            return F.conv(F.call_function("substring", digest, (i % 16) * 4 + 1, F.lit(4)), 16, 10).cast("int")

        return F.transform(held, lambda c, i: F.when((i + r) % 2 == 0, _moved(c, by(i))).otherwise(c))

    return F.array_join(F.aggregate(F.array(*map(F.lit, range(ROUNDS))), chars, turn), "")


def _luhn(digits: Column) -> Column:
    """The check digit of a string of digits."""
    each = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), lambda c, i: F.when(i % 2 == 0, c.cast("int") * 2).otherwise(c.cast("int")))
    total = F.aggregate(each, F.lit(0), lambda acc, d: acc + F.when(d > 9, d - 9).otherwise(d))
    return (10 - total % 10) % 10


def _card(digits: Column, tweak: Column) -> Column:
    """Keeps the distance of the last digit from the right check digit: valid stays valid."""
    body = F.call_function("substring", digits, F.lit(1), F.length(digits) - 1)
    off = F.call_function("substring", digits, F.length(digits), F.lit(1)).cast("int") - _luhn(body)
    new = permuted(body, tweak)
    return F.concat(new, F.pmod(_luhn(new) + off, F.lit(10)).cast("string"))


def _ip(value: Column, tweak: Column) -> Column:
    octets = F.transform(F.split(value, "\\."), lambda x: x.cast("long"))
    halves = F.struct((octets[0] * 256 + octets[1]).alias("a"), (octets[2] * 256 + octets[3]).alias("b"))

    def turn(acc: Column, r: Column) -> Column:
        digest = F.sha2(F.concat_ws("\x02", tweak, r.cast("string"), acc.b.cast("string")), 256)
        by = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
        return F.struct(acc.b.alias("a"), F.pmod(acc.a + by, F.lit(65536)).cast("long").alias("b"))

    def dotted(x: Column) -> Column:
        return F.concat_ws(".", (x / 256).cast("long"), x % 256)

    return F.aggregate(F.array(*map(F.lit, range(ROUNDS))), halves, turn, lambda acc: F.concat_ws(".", dotted(acc.a), dotted(acc.b)))


def _name(value: Column, tweak: Column, key: str, attempt: Column) -> Column:
    def word(w: Column) -> Column:
        out = permuted(w, tweak)
        for label, names in NAMES.items():
            low = sorted((n.lower() for n in names), key=lambda n: hashlib.sha256(f"{key}|{label}|{n}".encode()).digest())
            listed = F.array(*map(F.lit, low))
            at = F.array_position(listed, w)
            step = 1 + F.pmod(attempt, F.lit(len(low) - 1))  # never back to the name itself
            out = F.when(at > 0, F.element_at(listed, (F.pmod(at - 1 + step, F.lit(len(low))) + 1).cast("int"))).otherwise(out)
        return F.when(w.isin(*[t.lower() for t in TITLES]), w).otherwise(out)

    return F.array_join(F.transform(F.split(value, " "), word), " ")


def surrogate_core(kind: Column, value: Column, attempt: Column, key: str) -> Column:
    """The surrogate of an entity's ``core``."""
    tweak = F.concat_ws("\x02", F.lit(key), kind, attempt.cast("string"))
    tail = F.substring_index(value, ".", -1)
    mail = F.concat(permuted(F.call_function("substring", value, F.lit(1), F.length(value) - F.length(tail) - 1), F.concat_ws("\x02", tweak, tail)), F.lit("."), tail)
    country = F.substring(value, 1, 2)
    iban = F.concat(country, permuted(F.call_function("substring", value, F.lit(3)), F.concat_ws("\x02", tweak, country)))
    return (
        F.when(kind == "email", mail)
        .when(kind == "ip", _ip(value, tweak))
        .when(kind == "card", _card(value, tweak))
        .when(kind == "name", _name(value, tweak, key, attempt))
        .when(kind == "iban", iban)
        .otherwise(permuted(value, tweak))
    )


def _shaped(kind: Column, value: Column, new: Column) -> Column:
    """``new`` with the punctuation and the capitals of ``value``."""
    skip = F.when(kind == "email", F.lit("\x01")).when(kind == "name", F.lit("\\.")).otherwise(F.lit("[^\\p{L}\\p{N}]"))
    chars = F.filter(F.split(value, ""), lambda c: c != "")

    def placed(c: Column, i: Column) -> Column:
        nth = F.length(F.regexp_replace(F.call_function("substring", value, F.lit(1), i + 1), skip, F.lit("")))
        fresh = F.call_function("substring", new, nth, F.lit(1))
        return F.when(c.rlike("^\\p{Lu}$"), F.upper(fresh)).when(F.regexp_replace(c, skip, F.lit("")) == "", c).otherwise(fresh)

    given = F.transform(F.split(value, " "), lambda w: F.upper(w) == w)
    words = F.zip_with(F.split(new, " "), given, lambda w, up: F.when(up, F.upper(w)).otherwise(F.initcap(w)))
    titled = F.array_join(words, " ")
    return F.when(kind == "ip", new).when(kind == "name", titled).otherwise(F.array_join(F.transform(chars, placed), ""))


def surrogate(value: Column, attempt: Column, key: str) -> Column:
    kind = kind_of(value)
    return _shaped(kind, value, surrogate_core(kind, core(kind, value), attempt, key))


def _found(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``row`` (all columns), ``id``, ``text``, ``key`` (digest of the text), ``values`` (entities in order)."""
    text = F.col(text_col).cast("string")
    values = F.coalesce(F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0)), F.array().cast("array<string>"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return docs.select(row.alias("row"), F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("key"), values.alias("values"))


def entities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Distinct ``kind`` and ``core`` of all entities."""
    value = _found(docs, id_col, text_col).select(F.explode("values").alias("value")).distinct()
    return value.select(kind_of(F.col("value")).alias("kind"), core(kind_of(F.col("value")), F.col("value")).alias("core")).distinct()


def settle(found: DataFrame, key: str) -> DataFrame:
    """``kind``, ``core``, ``attempt``, ``surrogate``: distinct, and no surrogate an entity itself.

    Some forms are too short for that (if all ten digits occur, one of them replaces
    another).  After ``ATTEMPTS`` rounds all entities of such a form take attempt -1 together,
    which as one permutation still keeps them distinct.
    """
    table = found.withColumn("attempt", F.lit(0))
    real = found.select("kind", F.col("core").alias("surrogate"), F.lit(True).alias("real"))
    form = F.regexp_replace(F.regexp_replace(F.col("core"), f"[{DIGITS}]", "0"), "\\p{Ll}", "a")
    for turn in range(ATTEMPTS + 1):
        drawn = table.withColumn("surrogate", surrogate_core(F.col("kind"), F.col("core"), F.col("attempt"), key))
        drawn = materialize(drawn, "surrogates")
        owner = drawn.groupBy("kind", "surrogate").agg(F.min("core").alias("owner"))
        judged = drawn.join(owner, ["kind", "surrogate"]).join(real, ["kind", "surrogate"], "left")
        bad = (F.col("core") != F.col("owner")) | F.coalesce("real", F.lit(False))
        judged = materialize(judged.select("kind", "core", "attempt", "surrogate", bad.alias("bad")), "judged")
        if judged.filter("bad").isEmpty():
            return drawn
        if turn < ATTEMPTS:
            table = judged.select("kind", "core", (F.col("attempt") + F.col("bad").cast("int")).alias("attempt"))
    formed = judged.withColumn("form", form)
    crowded = formed.filter("bad").select("kind", "form", F.lit(-1).alias("last")).distinct()
    table = formed.join(crowded, ["kind", "form"], "left").select("kind", "core", F.coalesce("last", "attempt").alias("attempt"))
    drawn = table.withColumn("surrogate", surrogate_core(F.col("kind"), F.col("core"), F.col("attempt"), key))
    return materialize(drawn, "surrogates")


def replace(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the entities in ``text_col`` replaced, ``n_entities`` and ``kinds`` added.

    ``key`` is the secret that decides all surrogates.  A null text stays null and has no
    entities; a text without entities is unchanged.  Repeated rows and all other columns,
    whatever their names, are kept; ``n_entities`` and ``kinds`` replace columns so named.
    """
    rows = _found(docs, id_col, text_col)
    settled = settle(materialize(entities(docs, id_col, text_col), "entities"), key)
    again = settled.filter("attempt <> 0").select("kind", "core", "attempt")
    if again.isEmpty():
        new = F.transform("values", lambda v: surrogate(v, F.lit(0), key))
    else:
        each = rows.select("id", "key", "values").distinct().select("id", "key", F.posexplode("values").alias("pos", "value"))
        each = each.withColumn("kind", kind_of(F.col("value"))).withColumn("core", core(F.col("kind"), F.col("value")))
        tried = each.join(again, ["kind", "core"]).groupBy("id", "key").agg(
            F.map_from_entries(F.collect_list(F.struct("pos", "attempt"))).alias("tried")
        )
        tried = tried.select(F.col("id").alias("i"), F.col("key").alias("k"), "tried")
        rows = rows.join(tried, F.col("id").eqNullSafe(F.col("i")) & (F.col("key") == F.col("k")), "left")
        new = F.transform("values", lambda v, n: surrogate(v, F.coalesce(F.col("tried")[n], F.lit(0)), key))
    gaps = F.split("text", ENTITY, -1)
    rebuilt = F.array_join(F.flatten(F.zip_with(gaps, new, lambda g, s: F.array(g, F.coalesce(s, F.lit(""))))), "")
    kinds = F.array_sort(F.array_distinct(F.transform("values", kind_of)))
    made = {
        text_col: F.when(F.size("values") > 0, rebuilt).otherwise(F.col("text")),
        "n_entities": F.size("values").cast("long"),
        "kinds": F.array_join(kinds, ","),
    }
    kept = [made[c].alias(c) if c in made else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    return rows.select(*kept, *[v.alias(c) for c, v in made.items() if c not in docs.columns])
