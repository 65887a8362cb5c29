"""Surrogates for personal data, in DataFrame functions only.

Entities are found by patterns, and each gets a replacement derived from a secret key:
of the same kind, gender, script and format. One entity has one surrogate wherever and
however it is written; two entities never share one, and none is an entity of the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agoralytics.llm.common import cut_lineage

# Given names by gender and script, from which surrogates are made and by which names are found.
MALE = ("James", "Thomas", "Daniel", "Peter", "Martin", "Lukas", "Pierre", "Antoine", "Carlos", "Miguel")
FEMALE = ("Mary", "Anna", "Sarah", "Julia", "Martina", "Claire", "Sophie", "Camille", "Carmen", "Lucia")
MALE_CYRILLIC = ("Иван", "Дмитрий", "Алексей", "Павел")
FEMALE_CYRILLIC = ("Анна", "Мария", "Елена", "Ольга")
#: Titles by gender; those of neither leave the gender to the given name.
TITLES = {"m": ("Mr", "Herr", "Monsieur", "Señor", "Господин"), "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Госпожа"), "n": ("Dr", "Prof")}
#: Syllables of made-up surnames by script.
LATIN = ("bar", "ben", "cor", "dal", "fen", "gar", "hol", "kel", "lan", "mor", "nor", "pel", "ras", "sol", "tam", "ver")
CYRILLIC = ("бар", "вел", "гор", "дан", "кол", "лан", "мор", "нов", "пет", "рас", "сол", "тем", "фед", "чер", "шум", "ян")

_NAME_WORD = r"\p{Lu}[\p{L}'’-]+"
_TITLES = "|".join(t for group in TITLES.values() for t in group)
_GIVEN = "|".join(dict.fromkeys(MALE + FEMALE + MALE_CYRILLIC + FEMALE_CYRILLIC))
_SECRET_NAME = r"(?i:(?:token|secret|passw(?:or)?d|passwd|pwd|api[_-]?key|access[_-]?key|auth)\w{0,20}[\"']?\s{0,3}[:=]\s{0,3}[\"']?)"

#: Kind and pattern of every entity; where two begin at one place, the first of this order wins.
PATTERNS = {
    "EMAIL": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]{1,63}(?:\.[\p{L}\p{N}-]{1,63}){0,8}\.\p{L}{2,24}",
    "SECRET": rf"(?<![\p{{L}}\p{{N}}]){_SECRET_NAME}[^\s\"',;]{{6,}}+|(?<![\p{{L}}\p{{N}}])(?:(?=[A-Fa-f]*+\d)(?=\d*+[A-Fa-f])\p{{XDigit}}{{32,}}+|AKIA[0-9A-Z]{{16}}|gh[pousr]_\w{{20,}}+|sk-[\w-]{{16,}}+|eyJ[\w-]{{10,}}+\.[\w-]++(?:\.[\w-]++)?)(?![\p{{L}}\p{{N}}])",
    "IBAN": r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "IPV6": r"(?<![\p{XDigit}:])(?:\p{XDigit}{1,4}:){7}\p{XDigit}{1,4}(?![\p{XDigit}:])",
    "IP": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\d|\.\d)",
    "PHONE": r"(?<![\p{L}\p{N}(+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{2,4}\)[ .-]?\d{2,4}(?:[ .-]?\d{2,4}){1,2}|\d{3}[ .-]\d{3}[ .-]\d{4})(?!\d)",
    "SSN": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "CARD": r"(?<!\d)\d(?:[ -]?\d){12,18}(?!\d)",
    "NAME": rf"(?<!\p{{L}})(?:(?:{_TITLES})\.? +{_NAME_WORD}(?: +{_NAME_WORD}){{0,2}}|(?:{_GIVEN}) +{_NAME_WORD})",
}
PATTERN = "|".join(f"(?:{p})" for p in PATTERNS.values())


def kind_of(raw: Column) -> Column:
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(PATTERNS.items()):
        out = F.when(raw.rlike(f"^(?:{pattern})$"), F.lit(kind)).otherwise(out)
    return out


def _any(word: Column, names: tuple[str, ...]) -> Column:
    return F.lower(word).isin([n.lower() for n in names])


def parts_of(raw: Column) -> Column:
    """Array of (kind, raw): what an entity is put together from; kind is null for what stays."""
    none = F.lit(None).cast("string")

    def part(kind: Column, text: Column) -> Column:
        return F.struct(kind.alias("kind"), text.alias("raw"))

    name = F.regexp_extract(raw, f"^({_SECRET_NAME})?(.*)$", 1)
    secret = F.array(part(none, name), part(F.lit("SECRET"), F.regexp_extract(raw, f"^({_SECRET_NAME})?(.*)$", 2)))
    def names(raw: Column) -> Column:
        lead = F.regexp_extract(raw, rf"^((?:{_TITLES})\.? +)", 1)
        rest = F.substring(raw, F.length(lead) + 1, F.length(raw))
        pieces = F.split(rest, "(?<=[^ ])(?= )|(?<= )(?=[^ ])", -1)
        bare = F.regexp_replace(lead, r"\.? +$", "")
        by_title = F.when(_any(bare, TITLES["m"]), "m").when(_any(bare, TITLES["f"]), "f")

        def one(p: Column, i: Column) -> Column:
            gender = F.coalesce(F.when(_any(p, MALE + MALE_CYRILLIC), "m").when(_any(p, FEMALE + FEMALE_CYRILLIC), "f"), by_title, F.lit("n"))
            kind = F.when(p.rlike("^ *$"), none).when(i == F.size(pieces) - 1, "SURNAME").otherwise(F.concat(F.lit("GIVEN_"), gender))
            return part(kind, p)

        return F.concat(F.array(part(none, lead)), F.transform(pieces, one))

    kind = kind_of(raw)
    return F.when(kind == "SECRET", secret).when(kind == "NAME", names(raw)).otherwise(F.array(part(kind, raw)))


def canon(kind: Column, raw: Column) -> Column:
    """What all ways to write one entity have in common."""
    digits = F.regexp_replace(raw, "[^0-9]", "")
    return (
        F.when((kind == "PHONE") & raw.startswith("+"), digits)
        .when(kind == "PHONE", F.substring(digits, F.greatest(F.length(digits) - 9, F.lit(1)), F.lit(10)))
        .when(kind.isin("CARD", "SSN"), digits)
        .when(kind == "IBAN", F.regexp_replace(raw, " ", ""))
        .when(kind == "SECRET", raw)
        .otherwise(F.lower(raw))
    )


def _draw(key: str, *of: Column) -> Column:
    """A number from 0 to 2^32 - 1 that nobody can tell without the key."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), *of), 256), 1, 8), 16, 10).cast("long")


def _pick(values, draw: Column) -> Column:
    return F.element_at(F.array(*(F.lit(v) for v in values)), (draw % len(values) + 1).cast("int"))


def _check_digit(digits: Column) -> Column:
    """The digit that makes a number pass the card checksum, given the digits before it."""
    size = F.length(digits)
    terms = F.transform(F.sequence(F.lit(1), size), lambda i: (
        F.substring(digits, i, F.lit(1)).cast("int") * F.when((size - i) % 2 == 0, 2).otherwise(1)
    ))
    total = F.aggregate(terms, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x))
    return ((10 - total % 10) % 10).cast("string")


def surrogate(kind: Column, entity: Column, attempt: Column, key: str) -> Column:
    """The replacement of a canonical entity at an attempt: letters for letters, digits for digits, in the same case and script."""
    hexadecimal = entity.rlike(r"^\p{XDigit}+$")
    later, late = attempt >= 1, attempt >= 8

    def like(text: Column, base_hex: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            r = _draw(key, kind, entity, attempt.cast("string"), i.cast("string"))

            def letter(first: int, n: int) -> Column:
                return F.char(F.lit(first) + (r % n).cast("int")) if first < 128 else _pick([chr(first + k) for k in range(n)], r)

            return (
                F.when(c.rlike("^[0-9]$"), (r % 10).cast("string"))
                .when(base_hex & c.rlike("^[a-f]$"), letter(97, 6)).when(base_hex & c.rlike("^[A-F]$"), letter(65, 6))
                .when(c.rlike(r"^\p{IsCyrillic}$"), F.when(c == F.lower(c), letter(0x430, 32)).otherwise(letter(0x410, 32)))
                .when(c.rlike(r"^\p{L}$"), F.when(c == F.lower(c), letter(97, 26)).otherwise(letter(65, 26)))
                # Signs stay, but an entity made of signs could never differ from itself.
                .when(later & (c != "@") & (c != ".") & ~text.rlike(r"[\p{L}0-9]"), letter(97, 26))
                .otherwise(c)
            )

        return F.array_join(F.transform(F.split(text, "", -1), one), "")

    def more(first: int, n: int, when: Column) -> Column:
        """Characters that make a value longer with every attempt, once those of its length may be used up."""
        drawn = F.transform(F.sequence(F.lit(1), attempt.cast("int")), lambda i: F.char(F.lit(first) + (_draw(key, kind, entity, attempt.cast("string"), F.lit("more"), i.cast("string")) % n).cast("int")))
        return F.when(when, F.array_join(drawn, "")).otherwise("")

    no = F.lit(False)
    r = _draw(key, kind, entity, attempt.cast("string"))
    octets = F.transform(F.split(entity, r"\."), lambda _, i: (_draw(key, kind, entity, attempt.cast("string"), i.cast("string")) % 254 + 1).cast("string"))
    digits = like(entity, no)
    body = F.substring(digits, F.lit(1), F.length(digits) - 1)
    valid = F.substring(entity, F.length(entity), F.lit(1)) == _check_digit(F.substring(entity, F.lit(1), F.length(entity) - 1))
    cyrillic = entity.rlike(r"\p{IsCyrillic}")

    def made(syllables) -> Column:
        size = F.lit(3) + attempt.cast("int")
        return F.array_join(F.transform(F.sequence(F.lit(1), size), lambda i: _pick(syllables, _draw(key, kind, entity, attempt.cast("string"), i.cast("string")))), "")

    def given(latin, other) -> Column:
        # the lists are short: from the second attempt on a syllable is added for distinctness
        name = F.lower(F.when(cyrillic, _pick(other, r)).otherwise(_pick(latin, r)))
        syllables = F.when(attempt == 0, "").otherwise(F.when(cyrillic, made(CYRILLIC)).otherwise(made(LATIN)))
        return F.concat(name, F.when(attempt == 0, "").otherwise("-"), syllables)

    return (
        F.when(kind == "EMAIL", F.concat(more(97, 26, attempt >= 2), like(F.regexp_extract(entity, r"^(.*)\.[^.]*$", 1), no), F.lit(".example")))
        .when(kind == "IP", F.array_join(octets, "."))
        .when(kind == "IPV6", like(entity, F.lit(True)))
        .when(kind == "CARD", F.when(valid & ~late, F.concat(body, _check_digit(body))).otherwise(F.concat(digits, more(48, 10, late))))
        .when(kind == "IBAN", F.concat(F.substring(entity, 1, 2), like(F.substring(entity, F.lit(3), F.length(entity)), no), more(48, 10, late)))
        .when(kind == "SECRET", F.concat(like(entity, hexadecimal), more(97, 6, late)))
        .when(kind == "GIVEN_m", given(MALE, MALE_CYRILLIC))
        .when(kind == "GIVEN_f", given(FEMALE, FEMALE_CYRILLIC))
        .when(kind == "GIVEN_n", given(MALE + FEMALE, MALE_CYRILLIC + FEMALE_CYRILLIC))
        .when(kind == "SURNAME", F.when(cyrillic, made(CYRILLIC)).otherwise(made(LATIN)))
        .otherwise(F.concat(digits, more(48, 10, late)))
    )


def rendered(kind: Column, raw: Column, value: Column) -> Column:
    """A surrogate in the format in which the entity is written: its separators, its case."""
    digits = F.length(F.regexp_replace(raw, "[^0-9]", ""))
    signs = F.length(F.regexp_replace(raw, "[^0-9A-Z]", ""))

    def fill(keep: str, total: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            seen = F.length(F.regexp_replace(F.substring(raw, F.lit(1), i + 1), keep, ""))
            place = F.length(value) - (total - seen)
            return F.when((F.regexp_replace(c, keep, "") != "") & (place > 0), F.substring(value, place, F.lit(1))).otherwise(c)

        return F.array_join(F.transform(F.split(raw, "", -1), one), "")

    upper = (raw == F.upper(raw)) & (raw != F.lower(raw))
    name = F.when(upper & (F.length(raw) > 1), F.upper(value)).otherwise(F.initcap(value))
    return (
        F.when(kind.isin("PHONE", "CARD", "SSN"), fill("[^0-9]", digits))
        .when(kind == "IBAN", fill("[^0-9A-Z]", signs))
        .when(kind == "SECRET", value)
        .when(kind == "SURNAME", name).when(kind.startswith("GIVEN"), name)
        .otherwise(F.when(upper, F.upper(value)).otherwise(value))
    )


def in_one_country(coded: DataFrame) -> DataFrame:
    """Phone numbers without a country code get that of the same number with one, if all that have one agree on it."""
    phones = coded.where("kind = 'PHONE'")
    written = phones.where(F.col("raw").startswith("+") & (F.length("canon") > 10))
    whole = (
        written.groupBy(F.expr("right(canon, 10)").alias("local"))
        .agg(F.min("canon").alias("whole"), F.max("canon").alias("other")).where("whole = other").drop("other")
    )
    bare = (F.col("kind") == "PHONE") & ~F.col("raw").startswith("+")
    joined = coded.withColumn("local", F.when(bare, F.col("canon"))).join(whole, "local", "left")
    return joined.withColumn("canon", F.coalesce("whole", "canon")).drop("local", "whole")


def assign(entities: DataFrame, key: str) -> DataFrame:
    """(kind, canon, value) for the distinct entities(kind, canon): no two of a kind share a value, none is an entity.

    Those that lose a collision, or hit a real entity, try again; of those that collide the
    smallest keeps the value. Mail addresses from the third attempt on, and numbers and secrets from the
    ninth, grow with every attempt, so there is always a free value left, however many entities there are.
    """
    tasks = int(entities.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    real = cut_lineage(entities.distinct())
    wanted, attempt, done = real, 0, None
    while True:
        # Making a surrogate costs far more than moving an entity: few entities are many tasks' work.
        tried = cut_lineage(wanted.repartition(tasks, "kind", "canon").withColumn("value", surrogate(F.col("kind"), F.col("canon"), F.lit(attempt), key)))
        free = tried.join(real.select("kind", F.col("canon").alias("value")), ["kind", "value"], "left_anti")
        if done is not None:
            free = free.join(done.select("kind", "value"), ["kind", "value"], "left_anti")
        won = cut_lineage(free.groupBy("kind", "value").agg(F.min("canon").alias("canon")).select("kind", "canon", "value"))
        done = won if done is None else done.unionByName(won)
        wanted = cut_lineage(wanted.join(won, ["kind", "canon"], "left_anti"))
        if wanted.isEmpty():
            return done
        attempt += 1


def replace_private(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, n_entities and the text with surrogates of every row of documents(doc_id, text).

    A missing text stays missing and has no entities; a text without entities stays as it
    is. Ids may be missing or repeat, other columns don't matter; no rows give no rows.
    The same key gives the same surrogates for the same set of entities.
    """
    found = F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0))
    texts = docs.select("text").where(F.col("text").rlike(PATTERN))
    # Texts are told apart by a digest, so that copies are worked on once.
    coded = cut_lineage(
        texts.select(F.md5("text").alias("code"), found.alias("found")).dropDuplicates(["code"])
        .select("code", F.posexplode("found").alias("at", "raw"))
        .select("code", "at", F.posexplode(parts_of(F.col("raw"))).alias("part", "p"))
        .select("code", "at", "part", "p.kind", "p.raw", canon(F.col("p.kind"), F.col("p.raw")).alias("canon"))
    )
    coded = in_one_country(coded)
    values = assign(coded.where("kind is not null").select("kind", "canon"), key)
    pieces = coded.join(values, ["kind", "canon"], "left").select(
        "code", "at", "part", F.when(F.col("value").isNull(), F.col("raw")).otherwise(rendered(F.col("kind"), F.col("raw"), F.col("value"))).alias("new")
    )
    ordered = F.sort_array(F.collect_list(F.struct("at", "part", "new")))
    joined = pieces.groupBy("code").agg(ordered.alias("pieces")).select(
        F.col("code").alias("found_code"), "pieces", (F.element_at("pieces", -1)["at"] + 1).alias("n")
    )
    held = docs.select("doc_id", "text", F.md5("text").alias("code")).join(joined, F.col("code") == F.col("found_code"), "left")
    between = F.split("text", PATTERN, -1)
    lead = F.transform("pieces", lambda p: F.concat(F.when(p["part"] == 0, F.get(between, p["at"])).otherwise(""), p["new"]))
    text = F.concat(F.array_join(lead, ""), F.element_at(between, -1))
    return held.select(
        "doc_id",
        F.coalesce("n", F.lit(0)).cast("long").alias("n_entities"),
        F.when(F.col("n").isNull(), F.col("text")).otherwise(text).alias("text"),
    )
