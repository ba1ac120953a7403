"""PII: detected entities get keyed surrogates of their type, format, script and gender (DataFrame operations only).

1. One pattern finds e-mail addresses, IPv4 addresses, card and phone numbers, hexadecimal keys and names after a
   title. A mention is reduced to its entity: type and normal form (lower case; digits only for cards and phones), so that
   all spellings of an entity in all documents are one.
2. Each distinct entity gets a candidate from ``sha2(key, type, normal form, attempt)``: letters for letters, digits for
   digits, octets for octets, a valid check digit where the card has one, a name with the ending of the title's gender in
   the script of the name.
3. Collision checks: a candidate that another entity of the type holds (names of any gender are one type), or that is
   itself an entity of the corpus, is drawn again, and
   so on until none collides. After a few draws a surrogate gets one more place a draw, so a space that the corpus fills
   does not end the search. Different entities keep different surrogates, one entity has one everywhere.
4. Mentions meet their surrogates by a join (a very frequent entity is a splittable skewed key), take on the mention's
   own punctuation and case, and are put between the parts of the text that the pattern left.

Defined cases: null texts stay null and empty ones empty; repeated rows are rewritten alike; a null ``doc_id`` is a
document like others; texts without entities are unchanged; an empty table gives an empty result; other columns pass
through, columns named like a new one are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopy.llm.line_dedup import row_id
from canopy.session import scratch_path

# Titles by gender, and syllables and endings of names by script.
FEMALE = ["Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Madame", "Mme", "Госпожа"]
MALE = ["Mr", "Herr", "Señor", "Sr", "Monsieur", "Господин"]
NEUTRAL = ["Dr", "Prof"]
SYLLABLES = {"latin": "ba be bo da de do fa fe ga go ka ke la le lo ma me mo na ne ra re sa se ta te va ve".split(),
             "cyrillic": "ба бе бо да де до га го ка ке ла ле ло ма ме мо на не ра ре са се та те ва ве".split()}
ENDINGS = {("latin", "f"): ["lia", "na", "ra", "ta"], ("latin", "m"): ["lius", "no", "ron", "tus"], ("latin", "n"): ["len", "nis", "rin", "tel"],
           ("cyrillic", "f"): ["лия", "на", "ра", "та"], ("cyrillic", "m"): ["лий", "нов", "рон", "тин"],
           ("cyrillic", "n"): ["лен", "нис", "рин", "тель"]}

EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}"
IP = r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9])"
CARD = r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])"
PHONE = (r"\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])|\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9])"
         r"|(?<![0-9])[0-9]{3}[-.][0-9]{3}[-.][0-9]{4}(?![0-9])")
KEY = r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![A-Za-z0-9])"
NAME = (r"(?<!\p{L})(?:" + "|".join(FEMALE + MALE + NEUTRAL) + r")\.? \p{Lu}[\p{L}'-]+(?: \p{Lu}[\p{L}'-]+)?")
PATTERN = "|".join([EMAIL, KEY, IP, PHONE, CARD, NAME])
TITLE = r"^(?:" + "|".join(FEMALE + MALE + NEUTRAL) + r")\.? "
#: Draws in the space of the entity's own format; each later one has one more letter, digit or syllable.
FREE_DRAWS = 3
#: Letters of a local part that is drawn where an address has nothing else to draw.
LOCAL_PART = 8
LETTERS = "abcdefghijklmnopqrstuvwxyz"
TYPES = ["email", "key", "ip", "phone", "card", "name"]


def kind_of(raw: Column) -> Column:
    """Type of a mention; of a name also gender and script."""
    gender = (F.when(raw.rlike(rf"^(?:{'|'.join(FEMALE)})\.? "), "f").when(raw.rlike(rf"^(?:{'|'.join(MALE)})\.? "), "m").otherwise("n"))
    script = F.when(F.regexp_replace(raw, TITLE, "").rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")
    return (F.when(raw.rlike(f"^(?:{EMAIL})$"), "email").when(raw.rlike(f"^(?:{KEY})$"), "key").when(raw.rlike(f"^(?:{IP})$"), "ip")
            .when(raw.rlike(f"^(?:{PHONE})$"), "phone").when(raw.rlike(f"^(?:{CARD})$"), "card")
            .otherwise(F.concat(F.lit("name-"), gender, F.lit("-"), script)))


def normal_form(kind: Column, raw: Column) -> Column:
    return (F.when(kind.isin("phone", "card"), F.regexp_replace(raw, "[^0-9]", ""))
            .when(kind.startswith("name"), F.lower(F.regexp_replace(raw, TITLE, ""))).otherwise(F.lower(raw)))


def _number(digest: Column, place: Column | int) -> Column:
    """Two hexadecimal digits of a digest as a number, wrapping after 32 places."""
    at = F.pmod(place if isinstance(place, Column) else F.lit(place), F.lit(32)) * 2 + 1
    return F.conv(digest.substr(at.cast("int"), F.lit(2)), 16, 10).cast("int")


def _pick(values: list[str], number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), F.pmod(number, F.lit(len(values))) + 1)


def _check_sum(digits: Column) -> Column:
    """Luhn sum of a string of digits, modulo 10."""
    places = F.sequence(F.lit(1), F.length(digits))

    def worth(i: Column) -> Column:
        d = digits.substr((F.length(digits) - i + 1).cast("int"), F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.pmod(F.aggregate(F.transform(places, worth), F.lit(0), lambda a, b: a + b), F.lit(10))


def with_candidates(entities: DataFrame, secret: str, attempt: int) -> DataFrame:
    """``entities`` with ``surrogate``, the surrogate's normal form that each draws at an attempt."""
    # Digests are columns of their own, so that each is made once a row.
    seed = [F.lit(secret), F.col("kind"), F.col("norm"), F.lit(str(attempt))]
    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.length("norm") / 32).cast("int")), lambda b: F.sha2(
        F.concat_ws("\u0001", *seed, b.cast("string")), 256))
    drawn = entities.withColumns({"__blocks": blocks, "__more": F.sha2(F.concat_ws("\u0001", *seed, F.lit("more")), 256)})
    return drawn.withColumn("surrogate", _candidate(max(0, attempt - FREE_DRAWS + 1))).drop("__blocks", "__more")


def _candidate(extra: int) -> Column:
    kind, norm, blocks, further = map(F.col, ("kind", "norm", "__blocks", "__more"))
    digest = F.element_at(blocks, 1)

    def shaped(text: Column, letters: str) -> Column:
        """Digits for digits and letters for letters, the rest as it is."""
        def drawn(c: Column, i: Column) -> Column:
            n = _number(F.element_at(blocks, (F.floor(i / 32) + 1).cast("int")), i)
            return (F.when(c.rlike("[0-9]"), F.pmod(n, F.lit(10)).cast("string"))
                    .when(c.rlike("[a-z]"), F.lit(letters).substr((F.pmod(n, F.lit(len(letters))) + 1).cast("int"), F.lit(1))).otherwise(c))

        return F.array_join(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), drawn), "")

    def more(n: int, values: str) -> Column:
        """``n`` further characters."""
        return F.translate(F.substring(further, 1, n), "0123456789abcdef", values)

    digits = more(extra, "0123456789012345")
    octets = F.concat_ws(".", *[(F.lit(1) + F.pmod(_number(digest, 2 * k) * 256 + _number(digest, 2 * k + 1), F.lit(254))).cast("string") for k in range(4)])
    ip = F.concat(octets, F.lit(":"), digits) if extra else octets  # a port, as an address has no fifth octet
    drawn_body = F.concat(shaped(F.expr("left(norm, length(norm) - 1)"), "a"), digits)
    check = F.pmod(F.lit(10) - _check_sum(F.concat(drawn_body, F.lit("0"))), F.lit(10)).cast("string")
    numbers = F.concat(shaped(norm, "a"), digits)
    card = F.when(_check_sum(norm) == 0, F.concat(drawn_body, check)).otherwise(numbers)
    # The host keeps its last label, the rest of an address is drawn.
    address = F.regexp_extract(norm, r"^(.*\.)[^.]+$", 1)
    letters = "abcdefghijklmnop"
    email = F.concat(F.when(address.rlike("[a-z0-9]"), more(extra, letters)).otherwise(more(LOCAL_PART + extra, letters)),
                     shaped(address, LETTERS), F.regexp_extract(norm, r"([^.]+)$", 1))
    name = F.lit(None).cast("string")
    for script, syllables in SYLLABLES.items():
        def word(place: int, end: Column, syllables=syllables) -> Column:
            return F.concat(_pick(syllables, _number(digest, place)), _pick(syllables, _number(digest, place + 1)), end)

        def ending(place: int, gender: str, script=script) -> Column:
            return _pick(ENDINGS[script, gender], _number(digest, place))

        longer = [_pick(syllables, _number(further, k)) for k in range(extra)]
        family = F.concat(*longer, _pick(syllables, _number(digest, 7)), word(3, ending(5, "n")))
        gendered = F.when(kind == f"name-f-{script}", ending(2, "f")).when(kind == f"name-m-{script}", ending(2, "m")).otherwise(ending(2, "n"))
        whole = F.when(norm.contains(" "), F.concat(word(0, gendered), F.lit(" "), family)).otherwise(family)
        name = F.when(kind.endswith(f"-{script}"), whole).otherwise(name)
    return (F.when(kind == "ip", ip).when(kind == "card", card).when(kind == "phone", numbers)
            .when(kind == "key", F.concat(shaped(norm, "abcdef"), digits)).when(kind == "email", email).otherwise(name))


def surrogates(entities: DataFrame, secret: str) -> DataFrame:
    """``entities(kind, norm)``, distinct -> ``kind, norm, surrogate``, all different within an entity type (all kinds of
    names are one) and no entity of the type among them."""
    spark = entities.sparkSession
    folder = scratch_path(spark, "surrogates")
    entities.select("kind", "norm").write.parquet(f"{folder}/entities")
    entities = spark.read.parquet(f"{folder}/entities")
    kind_type = F.when(F.col("kind").startswith("name"), "name").otherwise(F.col("kind")).alias("type")
    taken_names = entities.select(kind_type, F.col("norm").alias("surrogate"))
    settled, waiting, attempt = None, entities, 0
    while True:
        drawn = with_candidates(waiting, secret, attempt).select("kind", "norm", "surrogate", kind_type)
        taken = taken_names if settled is None else taken_names.unionByName(settled.select(kind_type, "surrogate"))
        free = drawn.join(taken, ["type", "surrogate"], "left_anti")
        first = Window.partitionBy("type", "surrogate").orderBy("norm", "kind")
        won = free.withColumn("place", F.row_number().over(first)).where(F.col("place") == 1).drop("place")
        won.select("kind", "norm", "surrogate").write.parquet(f"{folder}/won-{attempt}")
        won = spark.read.parquet(f"{folder}/won-{attempt}")
        settled = spark.read.parquet(*[f"{folder}/won-{k}" for k in range(attempt + 1)])
        waiting.join(won, ["kind", "norm"], "left_anti").write.parquet(f"{folder}/waiting-{attempt}")
        waiting = spark.read.parquet(f"{folder}/waiting-{attempt}")
        if waiting.isEmpty():
            return settled
        attempt += 1


def _rendered(kind: Column, raw: Column, surrogate: Column) -> Column:
    """A surrogate in the form of the mention: its punctuation, its case, its title."""
    marks = F.filter(F.split(raw, ""), lambda c: c != "")
    digit_no = F.transform(F.sequence(F.lit(1), F.size(marks)), lambda i: F.length(F.regexp_replace(raw.substr(F.lit(1), i), "[^0-9]", "")))
    filled = F.array_join(F.zip_with(marks, digit_no, lambda c, n: F.when(c.rlike("[0-9]"), surrogate.substr(n, F.lit(1))).otherwise(c)), "")
    filled = F.concat(filled, F.expr("substring(surrogate, length(regexp_replace(raw, '[^0-9]', '')) + 1)"))
    cased = F.when(raw == F.upper(raw), F.upper(surrogate)).otherwise(surrogate)
    return (F.when(kind.isin("phone", "card"), filled).when(kind.startswith("name"), F.concat(F.regexp_extract(raw, TITLE, 0), F.initcap(surrogate)))
            .otherwise(cased))


def replace_entities(docs: DataFrame, secret: str, text: str = "text") -> DataFrame:
    """``docs`` with the entities of ``text`` replaced, and ``n_entities`` and ``n_<type>`` of each type."""
    pattern = F.lit(PATTERN)
    rows = docs.withColumn("__row", row_id(F.col(text)))
    found = rows.select("doc_id", "__row", F.regexp_extract_all(text, pattern, F.lit(0)).alias("raws")).where(F.size("raws") > 0)
    mentions = (found.distinct().select("doc_id", "__row", F.posexplode("raws").alias("pos", "raw"))
                .withColumn("kind", kind_of(F.col("raw"))).withColumn("norm", normal_form(F.col("kind"), F.col("raw"))))
    folder = scratch_path(docs.sparkSession, "mentions")
    mentions.write.parquet(folder)
    mentions = docs.sparkSession.read.parquet(folder)
    made = surrogates(mentions.select("kind", "norm").distinct(), secret)
    replaced = mentions.join(made, ["kind", "norm"]).select(
        "doc_id", "__row", "kind", "pos", _rendered(F.col("kind"), F.col("raw"), F.col("surrogate")).alias("new"))
    counts = [F.count_if(F.col("kind").startswith(t)).alias(f"n_{t}") for t in TYPES]
    by_doc = replaced.groupBy(F.col("doc_id").alias("__id"), F.col("__row").alias("__own")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "new"))), lambda m: m["new"]).alias("__new"),
        F.count(F.lit(1)).alias("n_entities"), *counts)
    numbers = ["n_entities", *(f"n_{t}" for t in TYPES)]
    joined = rows.drop(*numbers).join(by_doc, rows["doc_id"].eqNullSafe(F.col("__id")) & (rows["__row"] == F.col("__own")), "left")
    between = F.split(F.col(text), PATTERN, -1)
    rebuilt = F.array_join(F.transform(F.arrays_zip(between.alias("part"), F.col("__new").alias("new")), lambda z: F.concat(
        F.coalesce(z["part"], F.lit("")), F.coalesce(z["new"], F.lit("")))), "")
    own = [F.when(F.col("__new").isNotNull(), rebuilt).otherwise(F.col(text)).alias(text) if c == text else F.col(c)
           for c in docs.columns if c not in numbers]
    return joined.select(*own, *[F.coalesce(F.col(n), F.lit(0)).cast("bigint").alias(n) for n in numbers])
